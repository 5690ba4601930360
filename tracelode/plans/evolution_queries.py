"""Queries of evolution, scopes and proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelode.functions import columns as C
from tracelode.functions.tables import stored
from tracelode.operators import evolution
from tracelode.plans.adapters import ORDERS_SQL, PREFERENCES_SQL, none, order_edges, order_memories, preferences, promotions, table
from tracelode.plans.registry import query

def neighbour():
    """A customer's memories in the order of their ids."""
    return Window.partitionBy("customer").orderBy("memory_id")


def order_place(rows: DataFrame) -> DataFrame:
    """Adds the place in a source: three sessions, of which every fourth row lacks a trusted time."""
    at = F.when(F.col("memory_id") % 4 != 0, F.col("created_at_ms"))
    return rows.withColumn("source_order", F.struct(F.lit("A").alias("provider"), (F.col("memory_id") % 3).cast("string").alias("session_id"), F.lit(1).alias("generation"), F.col("memory_id").alias("event_index"), at.alias("timestamp_ms")))


PLACE_SQL = """
    place AS (SELECT *, CAST(memory_id % 3 AS VARCHAR) AS session_id, CASE WHEN memory_id % 4 <> 0 THEN created_at_ms END AS ts, lag(memory_id) OVER (PARTITION BY customer ORDER BY memory_id) AS before FROM ost),
    duo AS (
        SELECT s.memory_id AS successor_id, s.memory_type AS s_type, p.memory_id AS predecessor_id, p.memory_type AS p_type, p.status AS p_status, s.repo_key AS s_repo, p.repo_key AS p_repo,
               CASE WHEN s.session_id = p.session_id THEN sign(p.memory_id - s.memory_id)
                    WHEN s.ts IS NULL OR p.ts IS NULL THEN NULL
                    WHEN p.ts <> s.ts THEN sign(p.ts - s.ts) WHEN p.session_id > s.session_id THEN 1 WHEN p.session_id < s.session_id THEN -1 ELSE sign(p.memory_id - s.memory_id) END AS cmp
        FROM place s LEFT JOIN place p ON p.memory_id = s.before)
"""


@query(f"""
    WITH {ORDERS_SQL}, {PLACE_SQL},
    pr AS (
        SELECT *, CASE WHEN successor_id % 11 = 0 THEN 'explicit_restore' WHEN successor_id % 13 = 0 THEN 'other' ELSE CASE s_type WHEN 'work_state' THEN 'work_state_update' WHEN 'user_preference' THEN 'preference_override' WHEN 'repository_knowledge' THEN 'knowledge_obsolete' ELSE 'none' END END AS relation,
               CASE WHEN successor_id % 5 = 0 THEN 'keep_both' ELSE 'supersede' END AS decision, CASE WHEN successor_id % 2 = 0 THEN 'capture_model' ELSE 'user' END AS proposer, CASE WHEN successor_id % 17 = 0 THEN 'elsewhere' ELSE s_repo END AS repo
        FROM duo),
    v AS (
        SELECT successor_id AS proposal_id, CASE
            WHEN s_repo <> repo OR coalesce(p_repo <> repo, false) THEN 'rejected:wrong_namespace' WHEN decision = 'keep_both' THEN 'kept_both:' WHEN predecessor_id IS NULL THEN 'rejected:unknown_predecessor'
            WHEN p_status <> 'active' THEN 'rejected:inactive_predecessor' WHEN s_type = 'task_experience' THEN 'rejected:append_only_experience' WHEN p_type <> s_type THEN 'kept_both:cross_type'
            WHEN relation = 'explicit_restore' THEN 'rejected:invalid_restore' WHEN relation = 'other' THEN 'rejected:wrong_relation'
            WHEN s_type = 'work_state' OR (s_type = 'repository_knowledge' AND proposer <> 'capture_model') THEN 'applied:'
            WHEN cmp IS NULL THEN 'kept_both:incomparable_source_order' WHEN cmp >= 0 THEN 'rejected:successor_not_newer' ELSE 'applied:' END AS v
        FROM pr)
    SELECT proposal_id, split_part(v, ':', 1) AS outcome, nullif(split_part(v, ':', 2), '') AS error_code FROM v
""")
def evo01_policy(spark: SparkSession, d: str) -> DataFrame:
    rows = evolution.with_status(order_place(order_memories(spark, d)), order_edges(spark, d))
    rows = rows.withColumns({"origin": F.lit("captured"), "restored_from": none("long"), "restore_predecessor_id": none("long")})
    key = F.col("successor_id")
    proposals = rows.select(
        F.col("memory_id").alias("proposal_id"), F.col("memory_id").alias("successor_id"), F.lag("memory_id").over(neighbour()).alias("predecessor_id"), F.col("repo_key").alias("own"), F.col("memory_type").alias("kind"),
    ).select(
        "proposal_id", "successor_id", "predecessor_id", F.when(key % 17 == 0, "elsewhere").otherwise(F.col("own")).alias("repo_key"), F.when(key % 5 == 0, "keep_both").otherwise("supersede").alias("decision"),
        F.when(key % 11 == 0, "explicit_restore").when(key % 13 == 0, "other").otherwise(F.coalesce(evolution.supersede_relation(F.col("kind")), F.lit("none"))).alias("relation_kind"),
        F.when(key % 2 == 0, "capture_model").otherwise("user").alias("proposer"))
    return evolution.resolve(proposals, rows)


@query(f"WITH {ORDERS_SQL}, {PLACE_SQL} SELECT predecessor_id, successor_id, CAST(cmp AS INTEGER) AS comparison FROM duo WHERE predecessor_id IS NOT NULL")
def evo02_order(spark: SparkSession, d: str) -> DataFrame:
    rows = order_place(order_memories(spark, d))
    rows = rows.select("memory_id", F.col("source_order").alias("s"), F.lag(F.struct("memory_id", "source_order")).over(neighbour()).alias("p")).where("p is not null")
    return rows.select(F.col("p.memory_id").alias("predecessor_id"), F.col("memory_id").alias("successor_id"), C.compare_order(F.col("p.source_order"), F.col("s")).alias("comparison"))


@query(f"""
    WITH {ORDERS_SQL},
    c AS (SELECT * FROM oe UNION ALL SELECT repo_key, memory_id, lead(memory_id, 2) OVER (PARTITION BY customer ORDER BY memory_id), memory_id - memory_id % 4 FROM om)
    SELECT predecessor_id, successor_id, CASE WHEN row_number() OVER (PARTITION BY predecessor_id ORDER BY created_at_ms, successor_id) = 1 THEN 'claimed' ELSE 'conflicting_successor' END AS state FROM c WHERE successor_id IS NOT NULL
""")
def evo03_claims(spark: SparkSession, d: str) -> DataFrame:
    more = order_memories(spark, d).select("repo_key", F.col("memory_id").alias("predecessor_id"), F.lead("memory_id", 2).over(neighbour()).alias("successor_id"), (F.col("memory_id") - F.col("memory_id") % 4).alias("created_at_ms"))
    return evolution.claims(order_edges(spark, d).unionByName(more.where("successor_id is not null"))).select("predecessor_id", "successor_id", "state")


@query(f"WITH {ORDERS_SQL} SELECT memory_id, memory_type, status FROM ost")
def evo04_status(spark: SparkSession, d: str) -> DataFrame:
    return evolution.with_status(order_memories(spark, d), order_edges(spark, d)).select("memory_id", "memory_type", "status")


@query("""
    WITH o AS (SELECT o_orderkey AS memory_id, o_custkey AS customer, lead(o_orderkey) OVER w AS following, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
    SELECT memory_id, customer % 13 = 0 AS cyclic, CASE WHEN customer % 13 <> 0 THEN last END AS tip FROM o WHERE customer % 13 = 0 OR memory_id <> last OR EXISTS (SELECT 1 FROM o p WHERE p.following = o.memory_id)
""")
def evo05_cycles(spark: SparkSession, d: str) -> DataFrame:
    whole = Window.partitionBy("customer")
    rows = order_memories(spark, d).select(F.col("memory_id").alias("predecessor_id"), F.coalesce(F.lead("memory_id").over(neighbour()), F.when(F.col("customer") % 13 == 0, F.min("memory_id").over(whole))).alias("successor_id"))
    return evolution.lineages(rows.where("successor_id is not null")).select("memory_id", "cyclic", "tip")


@query(f"""
    WITH {ORDERS_SQL}, p AS (SELECT memory_id AS predecessor_id, tip, depth, lead(memory_id, 3) OVER w AS successor_id, lead(tip, 3) OVER w AS far, lead(depth, 3) OVER w AS far_depth FROM oline WINDOW w AS (PARTITION BY customer ORDER BY memory_id))
    SELECT predecessor_id, successor_id, tip = far AS reached, CASE WHEN tip = far THEN CAST(depth - far_depth AS BIGINT) END AS steps FROM p WHERE successor_id IS NOT NULL
""")
def evo06_reach(spark: SparkSession, d: str) -> DataFrame:
    pairs = order_memories(spark, d).select(F.col("memory_id").alias("predecessor_id"), F.lead("memory_id", 3).over(neighbour()).alias("successor_id")).where("successor_id is not null")
    return evolution.reachable(order_edges(spark, d), pairs)


@query(f"""WITH {ORDERS_SQL} SELECT memory_id, tip, CAST(depth AS BIGINT) AS depth, status, CAST(max(depth) OVER (PARTITION BY tip) - depth AS BIGINT) AS position FROM oline""")
def evo07_lineage(spark: SparkSession, d: str) -> DataFrame:
    return evolution.histories(order_memories(spark, d), order_edges(spark, d))


@query(f"WITH {ORDERS_SQL} SELECT memory_id, tip, CAST(1 AS BIGINT) AS active_tips, status = 'superseded' AS can_restore FROM oline")
def evo08_tips(spark: SparkSession, d: str) -> DataFrame:
    return evolution.restorable(order_memories(spark, d), order_edges(spark, d))


@query(f"WITH {ORDERS_SQL} SELECT memory_id, CASE memory_type WHEN 'work_state' THEN 'work_state_update' WHEN 'user_preference' THEN 'preference_override' WHEN 'repository_knowledge' THEN 'knowledge_obsolete' END AS relation FROM om")
def evo09_relation(spark: SparkSession, d: str) -> DataFrame:
    return order_memories(spark, d).select("memory_id", evolution.supersede_relation(F.col("memory_type")).alias("relation"))


@query("""
    WITH p AS (SELECT event_id, event_id % 4 AS n, CASE event_id % 3 WHEN 0 THEN 'user_preference' WHEN 1 THEN 'work_state' ELSE 'repository_knowledge' END AS memory_type, event_type FROM events)
    SELECT event_id AS proposal_id, array_to_string(list_filter([CASE WHEN n = 0 THEN 'cites_nothing' END, CASE WHEN n = 1 THEN 'cites_unknown' END, CASE WHEN event_id % 5 = 0 THEN 'many_work_states' END,
        CASE WHEN memory_type = 'user_preference' AND n <> 2 THEN 'preference_not_by_user' END, CASE WHEN memory_type = 'work_state' AND event_type <> 'click' THEN 'unknown_workstream' END], lambda x: x IS NOT NULL), ',') AS violations FROM p
""")
def evo11_proposals(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 4
    fact = lambda i, role: F.struct(F.lit(i).alias("fact_id"), F.lit(role).alias("role"))
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("proposal_id"), F.when(F.col("event_id") % 3 == 0, "user_preference").when(F.col("event_id") % 3 == 1, "work_state").otherwise("repository_knowledge").alias("memory_type"),
        F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit("b"), F.lit("x"))).when(n == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))).alias("cited"),
        F.array(fact("a", "user"), fact("b", "assistant")).alias("facts"), F.col("event_type").alias("workstream_key"), F.array(F.lit("click"), F.lit("none")).alias("candidate_keys"), F.when(F.col("event_id") % 5 == 0, 2).otherwise(1).alias("work_states"))
    return evolution.proposal_violations(rows).select("proposal_id", F.array_join("violations", ",").alias("violations"))


@query("""
    WITH w AS (SELECT o_orderkey AS memory_id, 'repo' || (o_custkey % 10) AS repo_key, o_custkey, o_orderkey % 7 <> 0 AND lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IS NOT NULL AS superseded, o_orderstatus, o_orderpriority FROM orders)
    SELECT repo_key, CAST(o_custkey AS VARCHAR) AS workstream_key, min(memory_id) AS head_id, count(*) AS heads FROM w WHERE NOT superseded AND o_orderpriority LIKE '3%' AND o_orderstatus <> 'F' GROUP BY ALL
""")
def evo12_open_heads(spark: SparkSession, d: str) -> DataFrame:
    state = table(spark, d, "orders").select(F.col("o_orderkey").alias("memory_id"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"))
    return evolution.open_heads(order_memories(spark, d).join(state, "memory_id").withColumn("workstream_key", F.col("subject_key")), order_edges(spark, d))


@query(f"""
    WITH {PREFERENCES_SQL}, s AS (SELECT subject_key, count(*) AS n FROM force GROUP BY ALL)
    SELECT memory_id, pre.subject_key, CASE WHEN memory_id IN (SELECT memory_id FROM force) THEN 'promoted' WHEN status <> 'active' OR memory_type <> 'user_preference' THEN 'ineligible' WHEN n > 0 THEN 'conflict' ELSE 'eligible' END AS state
    FROM pre LEFT JOIN s USING (subject_key)
""")
def evo13_governance(spark: SparkSession, d: str) -> DataFrame:
    return evolution.governance(preferences(spark, d), promotions(spark, d))


@query("""
    SELECT memory_id, scope, name FROM (SELECT c_custkey AS memory_id, 'repository' AS scope, c_name AS name FROM customer UNION ALL SELECT s_suppkey, 'global', s_name FROM supplier)
    QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY scope) = 1
""")
def evo14_library(spark: SparkSession, d: str) -> DataFrame:
    return evolution.library(table(spark, d, "customer").select(F.col("c_custkey").alias("memory_id"), F.col("c_name").alias("name")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("memory_id"), F.col("s_name").alias("name")))


@query("""
    WITH g AS (SELECT s_suppkey AS memory_id, 'global' AS scope, s_name AS name FROM supplier), p AS (SELECT *, row_number() OVER (ORDER BY memory_id) AS n, count(*) OVER () AS left_over FROM g WHERE memory_id > 3)
    SELECT memory_id, scope, name, CASE WHEN n = 5 AND left_over > 5 THEN memory_id END AS next_cursor FROM p WHERE n <= 5
""")
def top05_library_page(spark: SparkSession, d: str) -> DataFrame:
    return evolution.library_page(evo14_library(spark, d).where("scope = 'global'"), 5, 3)


@query(f"WITH {PREFERENCES_SQL} SELECT promotion_id, subject_key, replaces FROM force")
def jn05_effective_promotions(spark: SparkSession, d: str) -> DataFrame:
    return evolution.effective_promotions(promotions(spark, d)).select("promotion_id", "subject_key", "replaces")


@query(f"""WITH {PREFERENCES_SQL} SELECT f.subject_key, f.memory_id, (SELECT count(*) FROM pre p WHERE p.subject_key = f.subject_key AND p.memory_id <> f.memory_id) AS shadowed_by FROM force f""")
def jn06_shadow(spark: SparkSession, d: str) -> DataFrame:
    return evolution.shadowed(evolution.effective_promotions(promotions(spark, d)), preferences(spark, d))


ADVANCE_SQL = """
    w AS (SELECT o_orderkey AS memory_id, 'repo' || (o_custkey % 10) AS repo_key, CAST(o_custkey AS VARCHAR) AS stream, o_orderkey % 7 <> 0 AND lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IS NOT NULL AS superseded, o_orderstatus, o_orderpriority LIKE '3%' AS is_state FROM orders),
    h AS (SELECT repo_key, stream, min(memory_id) AS head_id FROM w WHERE NOT superseded AND is_state AND o_orderstatus <> 'F' GROUP BY ALL HAVING count(*) = 1),
    n AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber + 100000000 AS memory_id, l_orderkey * 10 + l_linenumber AS made, l_linenumber, o_custkey, 'repo' || (o_custkey % 10) AS repo_key, CAST(o_custkey AS VARCHAR) AS stream FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 2),
    a AS (SELECT n.repo_key, coalesce(lag(n.memory_id) OVER (PARTITION BY n.repo_key, n.stream ORDER BY made, n.memory_id), head_id) AS predecessor_id, n.memory_id AS successor_id FROM n JOIN h USING (repo_key, stream) WHERE n.memory_id % 5 <> 0)
"""


@query(f"WITH {ADVANCE_SQL} SELECT repo_key, predecessor_id, successor_id, 'superseded' AS head_status, CAST(0 AS BIGINT) AS added_again FROM a")
def evo10_advance(spark: SparkSession, d: str) -> DataFrame:
    """New work states (lines of orders) advance their customers' open heads unless a proposal names them; a second run over the edges adds nothing."""
    state = table(spark, d, "orders").select(F.col("o_orderkey").alias("memory_id"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"))
    columns = ("memory_id", "repo_key", "memory_type", "workstream_key", "state", "created_at_ms", "facts", "is_new")
    facts = F.array(F.col("memory_id").cast("string"))
    known = order_memories(spark, d).join(state, "memory_id").withColumns({"workstream_key": F.col("subject_key"), "facts": facts, "is_new": F.lit(False)}).select(*columns)
    lines = table(spark, d, "lineitem").where("l_linenumber <= 2").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    new = lines.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber") + 100_000_000).alias("memory_id"), F.concat(F.lit("repo"), F.col("o_custkey") % 10).alias("repo_key"), F.lit("work_state").alias("memory_type"),
        F.col("o_custkey").cast("string").alias("workstream_key"), F.lit("open").alias("state"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("created_at_ms"), F.array(F.lit("f")).alias("facts"), F.lit(True).alias("is_new")).distinct()
    both, edges = stored(known.unionByName(new), "memories"), order_edges(spark, d)
    proposed = new.where("memory_id % 5 = 0").select(F.col("memory_id").alias("successor_id"))
    made = stored(evolution.advances(both, edges, proposed), "advances")
    whole = edges.unionByName(made.select(*edges.columns))
    again = evolution.advances(both, whole, proposed).count()
    heads = evolution.with_status(both, whole).select("repo_key", F.col("memory_id").alias("predecessor_id"), F.col("status").alias("head_status"))
    return made.select("repo_key", "predecessor_id", "successor_id").join(heads, ["repo_key", "predecessor_id"]).withColumn("added_again", F.lit(again).cast("long"))
