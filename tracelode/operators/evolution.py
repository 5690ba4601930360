"""How memories supersede one another: proposal policy, claims, derived status, lineages, governance.

Edges (repo_key, predecessor_id, successor_id, ...) are the authority; status is always derived.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelode.functions import columns as C
from tracelode.functions.tables import jumps, top_per_group

#: Which relation supersedes a memory of a type.
RELATIONS = {"work_state": "work_state_update", "user_preference": "preference_override", "repository_knowledge": "knowledge_obsolete"}
KNOWLEDGE_RELATIONS = ("knowledge_obsolete", "knowledge_contradiction")


def supersede_relation(memory_type: Column) -> Column:
    """The relation of a supersession by its successor's type; null for types that only append."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in RELATIONS.items() for x in pair)), memory_type)


def evolution_id(repo_key: Column, relation: Column, predecessor: Column, successor: Column) -> Column:
    return C.typed_id("evo", repo_key=repo_key, relation_kind=relation, predecessor_id=predecessor, successor_id=successor)


def resolve(proposals: DataFrame, memories: DataFrame) -> DataFrame:
    """What becomes of each proposal: outcome applied, kept_both or rejected, and why.

    proposals: proposal_id, repo_key, decision, relation_kind, proposer, predecessor_id, successor_id.
    memories: memory_id, repo_key, memory_type, subject_key, status, origin, restored_from,
    restore_predecessor_id, source_order (struct). Rules are tried in order; the first that
    holds decides.
    """
    fields = F.struct("memory_id", "repo_key", "memory_type", "subject_key", "status", "origin", "restored_from", "restore_predecessor_id", "source_order")
    p = memories.select(F.col("memory_id").alias("predecessor_id"), fields.alias("p"))
    s = memories.select(F.col("memory_id").alias("successor_id"), fields.alias("s"))
    rows = proposals.join(p, "predecessor_id", "left").join(s, "successor_id", "left")
    kind, relation = F.col("s.memory_type"), F.col("relation_kind")
    order = C.compare_order(F.col("p.source_order"), F.col("s.source_order"))
    restore = (F.col("s.origin") == "restored") & (F.col("s.restore_predecessor_id") == F.col("p.memory_id")) & F.col("s.restored_from").isNotNull()
    must_be_newer = (kind == "user_preference") | (F.col("proposer") == "capture_model")
    fits = F.when(kind == "work_state", relation == "work_state_update").when(kind == "user_preference", relation == "preference_override").when(kind == "repository_knowledge", relation.isin(*KNOWLEDGE_RELATIONS))
    rules = [
        (F.col("s.memory_id").isNull(), "rejected", "unknown_successor"),
        ((F.col("s.repo_key") != F.col("repo_key")) | F.coalesce(F.col("p.repo_key") != F.col("repo_key"), F.lit(False)), "rejected", "wrong_namespace"),
        (F.col("decision") == "keep_both", "kept_both", None),
        (F.col("p.memory_id").isNull(), "rejected", "unknown_predecessor"),
        (F.col("p.memory_id") == F.col("s.memory_id"), "rejected", "self_edge"),
        (F.col("p.status") != "active", "rejected", "inactive_predecessor"),
        (kind == "task_experience", "rejected", "append_only_experience"),
        (F.col("p.memory_type") != kind, "kept_both", "cross_type"),
        (~F.col("p.subject_key").eqNullSafe(F.col("s.subject_key")), "kept_both", "different_subject"),
        ((relation == "explicit_restore") & ~F.coalesce(restore, F.lit(False)), "rejected", "invalid_restore"),
        (relation == "explicit_restore", "applied", None),
        (fits.isNull(), "rejected", "wrong_type"),
        (~fits, "rejected", "wrong_relation"),
        ((kind == "work_state") | ~must_be_newer, "applied", None),
        (order.isNull(), "kept_both", "incomparable_source_order"),
        (order >= 0, "rejected", "successor_not_newer"),
    ]
    decided = F.lit(None).cast("struct<outcome:string,error_code:string>")
    verdict = lambda outcome, code: F.struct(F.lit(outcome).alias("outcome"), F.lit(code).cast("string").alias("error_code"))
    decided = verdict("applied", None)
    for condition, outcome, code in reversed(rules):
        decided = F.when(condition, verdict(outcome, code)).otherwise(decided)
    return rows.withColumn("_v", decided).select("proposal_id", "_v.outcome", "_v.error_code")


def claims(edges: DataFrame) -> DataFrame:
    """One successor for each predecessor, the first by created_at_ms and id; later ones are conflicting_successor."""
    first = edges.groupBy("repo_key", "predecessor_id").agg(F.min(F.struct("created_at_ms", "successor_id")).alias("w"))
    won = (F.col("created_at_ms") == F.col("w.created_at_ms")) & (F.col("successor_id") == F.col("w.successor_id"))
    return edges.join(first, ["repo_key", "predecessor_id"]).withColumn("state", F.when(won, "claimed").otherwise("conflicting_successor")).drop("w")


def with_status(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds status: superseded if an edge leaves the memory, else active."""
    left = edges.select(F.col("repo_key"), F.col("predecessor_id").alias("memory_id")).distinct().withColumn("_left", F.lit(True))
    return memories.join(left, ["repo_key", "memory_id"], "left").withColumn("status", F.when(F.col("_left"), "superseded").otherwise("active")).drop("_left")


def lineages(edges: DataFrame) -> DataFrame:
    """For each memory on an edge: its lineage's tip, its distance from it, and whether it leads into a cycle.

    At most one edge leaves a memory, so all memories with one tip are one component.
    """
    return jumps(edges.select(F.col("predecessor_id").alias("node"), F.col("successor_id").alias("next"))).withColumnRenamed("node", "memory_id")


def histories(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """(memory_id, tip, depth, status, position): every memory with its place from the lineage's oldest, roots first."""

    placed = lineages(edges).select("memory_id", "tip", "depth")
    rows = with_status(memories, edges).join(placed, "memory_id", "left").withColumns({"tip": F.coalesce("tip", "memory_id"), "depth": F.coalesce("depth", F.lit(0))})
    # A lineage is one memory's history, not a hot key; it is sorted as a whole.
    order = Window.partitionBy("tip").orderBy(F.desc("depth"), "memory_id")
    return rows.select("memory_id", "tip", F.col("depth").cast("long").alias("depth"), "status", (F.row_number().over(order) - 1).cast("long").alias("position"))


def reachable(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether each pair's successor_id lies on the way from its predecessor_id: the same tip, and nearer to it by more steps.

    On a chain without branches to the front, a memory is reached exactly if following the
    predecessor for the difference of depths ends there. Adds reached and steps.
    """
    at = lineages(edges)
    a = at.select(F.col("memory_id").alias("predecessor_id"), F.col("tip").alias("a_tip"), F.col("depth").alias("a_depth"))
    b = at.select(F.col("memory_id").alias("successor_id"), F.col("tip").alias("b_tip"), F.col("depth").alias("b_depth"))
    rows = pairs.join(a, "predecessor_id", "left").join(b, "successor_id", "left")
    # Where two edges meet in one memory, both sides have the tip and depths of a chain; the edges themselves tell them apart.
    meets = edges.groupBy("successor_id").count().where("count > 1").limit(1).count()
    near = F.coalesce((F.col("a_tip") == F.col("b_tip")) & (F.col("a_depth") > F.col("b_depth")), F.lit(False))
    if not meets:
        return rows.select("predecessor_id", "successor_id", near.alias("reached"), F.when(near, F.col("a_depth") - F.col("b_depth")).alias("steps"))
    walkers = rows.where(near).select("predecessor_id", "successor_id", F.col("predecessor_id").alias("at"), (F.col("a_depth") - F.col("b_depth")).alias("steps"), (F.col("a_depth") - F.col("b_depth")).alias("left"))
    from tracelode.functions.tables import stored

    hops = stored(edges.select(F.col("predecessor_id").alias("at"), F.col("successor_id").alias("to")), "hops")
    done, power = None, 0
    longest = walkers.agg(F.max("left")).first()[0] or 0
    while 1 << power <= longest:
        moved = walkers.join(hops, "at", "left")
        takes = F.col("left").bitwiseAND(F.lit(1 << power)) > 0
        walkers = stored(moved.select("predecessor_id", "successor_id", F.when(takes, F.col("to")).otherwise(F.col("at")).alias("at"), "steps", "left"), "walkers")
        hops = stored(hops.join(hops.select(F.col("at").alias("to"), F.col("to").alias("far")), "to").select("at", F.col("far").alias("to")), "hops")
        power += 1
    done = walkers.select("predecessor_id", "successor_id", (F.col("at") == F.col("successor_id")).alias("ok"), "steps")
    out = pairs.join(done, ["predecessor_id", "successor_id"], "left")
    return out.select("predecessor_id", "successor_id", F.coalesce("ok", F.lit(False)).alias("reached"), F.when(F.col("ok"), F.col("steps")).alias("steps"))


def restorable(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """(memory_id, tip, active_tips, can_restore): a superseded memory can be restored if its lineage has one active tip."""
    rows = histories(memories, edges)
    tips = rows.groupBy("tip").agg(F.count_if(F.col("status") == "active").alias("active_tips"))
    return rows.join(tips, "tip").select("memory_id", "tip", "active_tips", ((F.col("status") == "superseded") & (F.col("active_tips") == 1)).alias("can_restore"))


def open_heads(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """Active work states that are open, by repository and workstream; heads counts those of one key."""
    rows = with_status(memories, edges).where("status = 'active' and memory_type = 'work_state' and state = 'open' and workstream_key is not null")
    return rows.groupBy("repo_key", "workstream_key").agg(F.min("memory_id").alias("head_id"), F.count("*").alias("heads"))


def advances(memories: DataFrame, edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """Edges that the system adds: a new work state that no proposal names as a successor supersedes its workstream's one open head.

    memories: as open_heads takes them, and is_new (from the batch being captured), created_at_ms, facts
    (ids); edges: what holds; proposed: successor_id. The head is sought among memories that were
    there before the batch. Of several new states of a workstream each supersedes the one before
    it, the first the head, so a predecessor has one successor. Edges are content-addressed, and
    where a new state has an edge already none is made, so a second run adds nothing.
    Gives evolution_id, repo_key, predecessor_id, successor_id, relation, proposer, supporting_fact_ids, created_at_ms.
    """
    stream = ["repo_key", "workstream_key"]
    new = memories.where("is_new and memory_type = 'work_state' and workstream_key is not null").join(proposed.select(F.col("successor_id").alias("memory_id")), "memory_id", "left_anti")
    heads = open_heads(memories.where("not is_new"), edges).where("heads = 1").select(*stream, "head_id")
    # A workstream's new states of one batch, which a session's limits bound.
    order = Window.partitionBy(*stream).orderBy("created_at_ms", "memory_id")
    rows = new.join(heads, stream).withColumn("predecessor_id", F.coalesce(F.lag("memory_id").over(order), "head_id"))
    rows = rows.join(edges.select("repo_key", F.col("successor_id").alias("memory_id")).distinct(), ["repo_key", "memory_id"], "left_anti")
    relation = F.lit("work_state_update")
    identity = evolution_id(F.col("repo_key"), relation, F.col("predecessor_id"), F.col("memory_id"))
    return rows.select(
        identity.alias("evolution_id"), "repo_key", "predecessor_id", F.col("memory_id").alias("successor_id"), relation.alias("relation"), F.lit("system").alias("proposer"),
        F.array_sort(F.array_distinct("facts")).alias("supporting_fact_ids"), "created_at_ms")


def effective_promotions(promotions: DataFrame) -> DataFrame:
    """Promotions that no other one replaces."""
    return promotions.join(promotions.where("replaces is not null").select(F.col("replaces").alias("promotion_id")), "promotion_id", "left_anti")


def shadowed(globals_: DataFrame, locals_: DataFrame) -> DataFrame:
    """Global preferences without those of whose subject another memory exists in the repository: subject_key, memory_id, shadowed_by.

    shadowed_by counts the local memories that shadow it; rows with 0 are in force.
    """
    counts = locals_.groupBy("subject_key").agg(F.count("*").alias("n"))
    own = locals_.select("subject_key", "memory_id").distinct().withColumn("_own", F.lit(1))
    rows = globals_.join(counts, "subject_key", "left").join(own, ["subject_key", "memory_id"], "left")
    return rows.select("subject_key", "memory_id", (F.coalesce("n", F.lit(0)) - F.coalesce("_own", F.lit(0))).cast("long").alias("shadowed_by"))


def governance(preferences: DataFrame, promotions: DataFrame) -> DataFrame:
    """Whether each preference can become a global one: promoted, ineligible, conflict or eligible.

    preferences: memory_id, subject_key, status, memory_type; promotions: promotion_id, memory_id, subject_key, replaces.
    A conflict is an effective promotion of the same subject by another memory.
    """
    force = effective_promotions(promotions)
    own = force.select("memory_id").distinct().withColumn("_own", F.lit(True))
    by_subject = force.groupBy("subject_key").agg(F.count("*").alias("n"))
    rows = preferences.join(own, "memory_id", "left").join(by_subject, "subject_key", "left")
    state = F.when(F.col("_own"), "promoted").when((F.col("status") != "active") | (F.col("memory_type") != "user_preference"), "ineligible").when(F.col("n") > 0, "conflict").otherwise("eligible")
    return rows.select("memory_id", "subject_key", state.alias("state"))


def library(repository: DataFrame, global_: DataFrame) -> DataFrame:
    """Both scopes as one list; a memory that is in both shows its global row."""
    rows = repository.withColumn("scope", F.lit("repository")).unionByName(global_.withColumn("scope", F.lit("global")))
    return top_per_group(rows, ["memory_id"], [F.col("scope")], 1).drop("rank")


def library_page(rows: DataFrame, size: int, after: Any = None) -> DataFrame:
    """A page of the library in the order of memory_id, after a memory that must be among the rows, else ValueError.

    rows: the library as it is filtered for the request. next_cursor is the page's last id in its last row, if more follow.
    """
    if after is not None:
        if rows.where(F.col("memory_id") == after).isEmpty():
            raise ValueError("cursor_invalid")
        rows = rows.where(F.col("memory_id") > after)
    # The page and one row more, so the windows hold size + 1 rows.
    some = rows.orderBy("memory_id").limit(size + 1)
    some = some.withColumn("_n", F.row_number().over(Window.orderBy("memory_id"))).withColumn("_following", F.lead("memory_id").over(Window.orderBy("memory_id")))
    return some.withColumn("next_cursor", F.when((F.col("_n") == size) & F.col("_following").isNotNull(), F.col("memory_id"))).where(F.col("_n") <= size).drop("_n", "_following")


def proposal_violations(proposals: DataFrame) -> DataFrame:
    """Rules that extracted memory proposals break, one row for each proposal.

    proposals: proposal_id, memory_type, cited (ids), facts (struct<fact_id, role>), workstream_key, candidate_keys, work_states.
    """
    ids = F.transform("facts", lambda f: f["fact_id"])
    by_user = F.transform(F.filter("facts", lambda f: f["role"] == "user"), lambda f: f["fact_id"])
    rules = {
        "cites_nothing": F.size("cited") == 0,
        "cites_unknown": F.size(F.array_except("cited", ids)) > 0,
        "preference_not_by_user": (F.col("memory_type") == "user_preference") & (F.size(F.array_intersect("cited", by_user)) == 0),
        "unknown_workstream": (F.col("memory_type") == "work_state") & ~F.coalesce(F.array_contains("candidate_keys", F.col("workstream_key")), F.lit(False)),
        "many_work_states": F.col("work_states") > 1,
    }
    return proposals.select("proposal_id", C.violations(**rules).alias("violations"))
