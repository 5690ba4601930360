"""Trace layer: pairing of calls and results, episodes, outcomes, source facts and task experiences.

A trace event has provider, session_id, event_index, block (order inside one raw event), event_id,
kind (message, tool_call, tool_result, metadata), role, text, tool_name, call_id, command,
exit_code, tool_status, is_command_result, observed_outcome, file_changes and event_sha256;
operators ask for those that they name only. Events of one raw event are in the order of
their blocks; without that column each raw event is one event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelode.functions import columns as C
from tracelode.functions.arrow import evidence_column, prefixes_at, verification
from tracelode.functions.tables import running_sum

#: At most so many facts are evidence of one experience.
EVIDENCE = 128
TITLE_BYTES = 256


#: Facts of one block are numbered below this.
BLOCK_FACTS = 10_000


def placed(events: DataFrame) -> DataFrame:
    """Events with a block, 0 where the column is missing."""
    return events if "block" in events.columns else events.withColumn("block", F.lit(0))


def paired_calls(events: DataFrame) -> DataFrame:
    """Each tool call with the first result of its call id after it.

    Of calls with one id in a session the first counts; duplicates is the number of the others.
    A result before its call pairs with nothing. Calls without a result have null result columns.
    Gives session_id, call_id, call_index, duplicates, result_index, result_outcome.
    """
    keyed = placed(events).where("call_id is not null")
    at = F.struct("event_index", "block")
    calls = keyed.where("kind = 'tool_call'").groupBy("session_id", "call_id").agg(F.min(at).alias("call"), (F.count("*") - 1).alias("duplicates"))
    results = keyed.where("kind = 'tool_result'").select("session_id", "call_id", at.alias("at"), event_outcome().alias("o"))
    first = results.join(calls, ["session_id", "call_id"]).where("at > call").groupBy("session_id", "call_id").agg(F.min(F.struct("at", "o")).alias("r"))
    out = calls.join(first, ["session_id", "call_id"], "left")
    return out.select("session_id", "call_id", F.col("call.event_index").alias("call_index"), "duplicates", F.col("r.at.event_index").alias("result_index"), F.col("r.o").alias("result_outcome"))


def typed_pairs(events: DataFrame) -> DataFrame:
    """paired_calls where a result answers only a call that expects its type.

    events have output_type besides: of a call what it expects, of a result what it is. A result
    of another type leaves the call open for the next. Adds mismatched, the number of those before
    the call was answered (all, if it never was), and violation, duplicate_call_id where the id occurs again.
    """
    keyed = placed(events).where("call_id is not null")
    at = F.struct("event_index", "block")
    calls = keyed.where("kind = 'tool_call'").groupBy("session_id", "call_id").agg(F.min(F.struct(at.alias("at"), "output_type")).alias("c"), (F.count("*") - 1).alias("duplicates"))
    results = keyed.where("kind = 'tool_result'").select("session_id", "call_id", at.alias("at"), F.col("output_type").alias("is"), event_outcome().alias("o"))
    after = results.join(calls, ["session_id", "call_id"]).where("at > c.at").withColumn("fits", F.col("is").eqNullSafe(F.col("c.output_type")))
    # Few values of a call go on: its first fitting result, and the places of the others, counted before it.
    first = after.where("fits").groupBy("session_id", "call_id").agg(F.min(F.struct("at", "o")).alias("r"))
    others = after.where("not fits").join(first, ["session_id", "call_id"], "left").where("r is null or at < r.at").groupBy("session_id", "call_id").agg(F.count("*").alias("mismatched"))
    out = calls.join(first, ["session_id", "call_id"], "left").join(others, ["session_id", "call_id"], "left")
    return out.select(
        "session_id", "call_id", F.col("c.at.event_index").alias("call_index"), F.col("r.at.event_index").alias("result_index"), F.col("r.o").alias("result_outcome"),
        F.coalesce("mismatched", F.lit(0)).cast("long").alias("mismatched"), F.when(F.col("duplicates") > 0, "duplicate_call_id").alias("violation"))


def event_outcome() -> Column:
    """Of a result: what was observed, else by exit code, else by status, else unknown."""
    by_code = F.when(F.col("exit_code") == 0, "success").when(F.col("exit_code").isNotNull(), "failure")
    by_status = F.when(F.col("tool_status").isin("success", "completed"), "success").when(F.col("tool_status").isin("failure", "failed", "error"), "failure")
    return F.coalesce("observed_outcome", by_code, by_status, F.lit("unknown"))


def is_user() -> Column:
    return F.coalesce((F.col("kind") == "message") & (F.col("role") == "user"), F.lit(False))


def is_signal() -> Column:
    """Whether an event after a committed episode opens a continuation."""
    said = (F.col("kind") == "message") & (F.coalesce("text", F.lit("")) != "")
    called = (F.col("kind") == "tool_call") & (F.coalesce("tool_name", F.lit("")) != "") & (F.coalesce("call_id", F.lit("")) != "")
    came = (F.col("kind") == "tool_result") & ((F.coalesce("text", F.lit("")) != "") | (F.coalesce("tool_status", F.lit("")) != "") | F.col("exit_code").isNotNull())
    return F.coalesce(said | called | came, F.lit(False))


def with_episode(events: DataFrame) -> DataFrame:
    """Adds episode: the number of user messages in the session up to the event; 0 stands before the first."""
    return running_sum(placed(events), ["session_id"], "event_index", F.when(is_user(), 1).otherwise(0), "episode", ties=("block",))


def episodes(events: DataFrame, final_boundary: str | None = "manual_finalize") -> DataFrame:
    """One row for each closed episode: a user message and all up to the next one.

    Events before a session's first user message belong to none. The last episode closes only
    by a final boundary, at the session's event count; without one it stays open and gives no row.
    Gives session_id, episode, start_index, end_index (exclusive), boundary_kind, n_events, outcome.
    """
    marked = with_episode(events)
    results = (F.col("kind") == "tool_result") & F.col("observed_outcome").isin("success", "failure")
    codes = (F.col("kind") == "tool_result") & F.coalesce("is_command_result", F.lit(False)) & F.col("exit_code").isNotNull()
    spans = marked.where("episode > 0").groupBy("session_id", "episode").agg(
        F.min("event_index").alias("start_index"), F.max("event_index").alias("last_index"), F.count("*").alias("n_events"),
        F.count_if(results).alias("seen"), F.count_if(results & (F.col("observed_outcome") == "success")).alias("seen_good"),
        F.count_if(codes).alias("codes"), F.count_if(codes & (F.col("exit_code") == 0)).alias("codes_good"),
    )
    following = spans.select("session_id", (F.col("episode") - 1).alias("episode"), F.col("start_index").alias("next_start"))
    joined = spans.join(following, ["session_id", "episode"], "left")
    closed = joined if final_boundary else joined.where("next_start is not null")
    return closed.select(
        "session_id", "episode", "start_index", F.coalesce("next_start", F.col("last_index") + 1).alias("end_index"),
        F.when(F.col("next_start").isNotNull(), "next_user").otherwise(F.lit(final_boundary)).alias("boundary_kind"),
        "n_events", outcome(F.col("seen"), F.col("seen_good"), F.col("codes"), F.col("codes_good")).alias("outcome"),
    )


def outcome(seen: Column, seen_good: Column, codes: Column, codes_good: Column) -> Column:
    """Observed results decide if there are any, else command exit codes: all, none or some good; unknown without either."""
    n, good = F.when(seen > 0, seen).otherwise(codes), F.when(seen > 0, seen_good).otherwise(codes_good)
    return F.when(n == 0, "unknown").when(good == n, "success").when(good == 0, "failure").otherwise("partial")


def continuations(events: DataFrame, closed: DataFrame) -> DataFrame:
    """What comes after a session's last committed end without a user message opens an episode linked to the last.

    closed: session_id, episode_id, end_index of committed episodes. Gives session_id,
    start_index, continues_episode_id for sessions whose first signal after the end isn't a user's.
    """
    last = closed.groupBy("session_id").agg(F.max(F.struct("end_index", "episode_id")).alias("last"))
    after = events.join(last, "session_id").where("event_index >= last.end_index")
    first = after.where(is_signal()).groupBy("session_id").agg(F.min(F.struct("event_index", is_user().alias("user"), F.col("last.episode_id").alias("id"))).alias("f"))
    return first.where("not f.user").select("session_id", F.col("f.event_index").alias("start_index"), F.col("f.id").alias("continues_episode_id"))


def first_close_wins(closes: DataFrame) -> DataFrame:
    """Of closes of one session at one end the first committed stands; the others are marked closure_lost.

    closes: session_id, end_index, start_index, boundary_kind, committed.
    """
    first = closes.groupBy("session_id", "end_index").agg(F.min(F.struct("committed", "start_index", "boundary_kind")).alias("w"))
    won = (F.col("committed") == F.col("w.committed")) & (F.col("start_index") == F.col("w.start_index")) & (F.col("boundary_kind") == F.col("w.boundary_kind"))
    return closes.join(first, ["session_id", "end_index"]).withColumn("state", F.when(won, "closed").otherwise("closure_lost")).drop("w")


def facts(events: DataFrame, repo_key: Column | None = None) -> DataFrame:
    """Immutable source facts of each event inside an episode, in order, with ids of their content and place.

    A result's facts refer to the latest call before it with its call id in the same episode; a
    result that has none leaves a tool message if it has text. fact_ordinal numbers the facts of
    a raw event in the order of its blocks.
    """
    marked = with_episode(events).where("episode > 0")
    near = Window.partitionBy("session_id", "episode", "call_id").orderBy("event_index", "block").rowsBetween(Window.unboundedPreceding, -1)
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    called = (F.col("kind") == "tool_call") & has("tool_name") & has("call_id")
    keyed = marked.withColumn("_call", F.when(called, F.col("event_index"))).withColumn("_run", F.when(called & has("command"), F.col("event_index")))
    with_id, without = keyed.where("call_id is not null"), keyed.where("call_id is null")
    linked = with_id.withColumn("_call", F.last("_call", True).over(near)).withColumn("_run", F.last("_run", True).over(near))
    rows = linked.unionByName(without.withColumn("_call", F.lit(None).cast("long")).withColumn("_run", F.lit(None).cast("long")))
    return rows.select("session_id", "episode", "event_index", "block", F.posexplode(fact_specifications()).alias("_pos", "f")).select(
        "session_id", "episode", "event_index", (F.col("block") * BLOCK_FACTS + F.col("_pos")).alias("fact_ordinal"), "f.*",
    ).withColumn("fact_id", C.typed_id(
        "fact", repo_key=F.lit(None).cast("string") if repo_key is None else repo_key, session_id=F.col("session_id").cast("string"),
        event_index=F.col("event_index"), fact_ordinal=F.col("fact_ordinal"), fact_kind=F.col("fact_kind"), role=F.col("role"), value=F.col("value"),
    ))


def fact_specifications() -> Column:
    """array<struct<fact_kind, role, value, outcome, exit_code, call_index, check_name>> of one event."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""

    def spec(kind: str, value: Column, role: Column | None = None, **attributes: Column) -> Column:
        none = {"outcome": "string", "exit_code": "int", "call_index": "long", "check_name": "string"}
        return F.struct(
            F.lit(kind).alias("fact_kind"), (F.lit(None).cast("string") if role is None else role).alias("role"), value.alias("value"),
            *((attributes[k] if k in attributes else F.lit(None).cast(t)).cast(t).alias(k) for k, t in none.items()),
        )

    called = (F.col("kind") == "tool_call") & has("tool_name") & has("call_id")
    came = (F.col("kind") == "tool_result") & has("call_id")
    run = came & F.coalesce("is_command_result", F.lit(False)) & F.col("_run").isNotNull()
    result, check = event_outcome(), verification(F.when(F.coalesce("is_command_result", F.lit(False)), F.col("command")))
    spoken = (F.col("kind") == "message") & has("text") & F.col("role").isin("user", "assistant", "tool", "system")
    one = F.array(
        F.when(spoken, spec("message", F.col("text"), F.col("role"))),
        F.when(called, spec("tool_call", F.col("tool_name"))),
        F.when(called & has("command"), spec("command", F.col("command"))),
    )
    changes = F.transform(F.coalesce("file_changes", F.array().cast("array<struct<operation:string,path:string,destination:string>>")), lambda c: spec("file_change", c["path"]))
    two = F.array(
        F.when(came & F.col("_call").isNotNull(), spec("tool_result", F.coalesce("tool_status", result), outcome=result, call_index=F.col("_call"))),
        F.when(run, spec("command_result", F.coalesce("command", "tool_status", result), outcome=result, exit_code=F.col("exit_code"), call_index=F.col("_run"))),
        F.when(run & check.isNotNull(), spec("verification", F.col("command"), outcome=result, call_index=F.col("_run"), check_name=check)),
        F.when(came & F.col("_call").isNull() & F.col("_run").isNull() & has("text"), spec("message", F.col("text"), F.lit("tool"))),
    )
    return F.filter(F.concat(one, changes, two), lambda s: s.isNotNull())


def resume_checkpoint(events: DataFrame, closed: DataFrame) -> DataFrame:
    """Where the next import of each session starts: its first signal that no closed episode covers.

    Gives session_id, resume_index (the event count if all is closed), call_ids seen before it,
    sorted, and file_changes counted before it.
    """
    ends = closed.groupBy("session_id").agg(F.max("end_index").alias("closed_to"))
    joined = events.join(ends, "session_id", "left").withColumn("_open", is_signal() & (F.col("event_index") >= F.coalesce("closed_to", F.lit(0))))
    at = joined.groupBy("session_id").agg(F.coalesce(F.min(F.when(F.col("_open"), F.col("event_index"))), F.max("event_index") + 1).alias("resume_index"))
    before = events.join(at, "session_id").where("event_index < resume_index").groupBy("session_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "tool_call", F.col("call_id")))).alias("call_ids"),
        F.sum(F.size(F.coalesce("file_changes", F.array()))).alias("file_changes"),
    )
    return at.join(before, "session_id", "left").select(
        "session_id", "resume_index", F.coalesce("call_ids", F.array().cast("array<string>")).alias("call_ids"), F.coalesce("file_changes", F.lit(0)).alias("file_changes"))


def prefix_at_ends(events: DataFrame, closed: DataFrame) -> DataFrame:
    """The prefix hash of each session up to each closed end; a session is folded once for all its ends."""
    records = events.select(F.col("session_id").alias("key"), F.col("event_index").alias("place"), F.col("event_sha256").alias("digest"))
    ends = closed.select(F.col("session_id").alias("key"), F.col("end_index").alias("place"))
    return prefixes_at(records, ends).select(F.col("key").alias("session_id"), F.col("place").alias("end_index"), "prefix_sha256")


def priority() -> Column:
    """Of facts for evidence: failures, verifications, actions, user messages, then the rest."""
    return (
        F.when(F.col("outcome") == "failure", 0).when(F.col("fact_kind") == "verification", 1)
        .when(F.col("fact_kind").isin("file_change", "command", "tool_call"), 2).when((F.col("fact_kind") == "message") & (F.col("role") == "user"), 3).otherwise(4)
    )


def experiences(fact_rows: DataFrame, limit: int = EVIDENCE) -> DataFrame:
    """One task experience for each episode: title, goal, actions, blockers, checks and the evidence's ids.

    Evidence is at most limit facts: the opening, then in the order of priority and place, each
    with the call or command that it refers to; one that doesn't fit with it is passed over.
    Lists keep the order of places. They are bounded by the import's limit of a session.
    """
    place = F.struct("event_index", "fact_ordinal")
    ordered = lambda condition, value: F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct(place.alias("p"), value.alias("v"))))), lambda x: x["v"])
    goal = (F.col("fact_kind") == "message") & (F.col("role") == "user")
    refers = F.when(F.col("fact_kind") == "tool_result", "tool_call").when(F.col("fact_kind").isin("command_result", "verification"), "command")
    sides = fact_rows.where("fact_kind in ('tool_call', 'command')").select("session_id", "episode", F.col("event_index").alias("call_index"), F.col("fact_kind").alias("_refers"), F.col("fact_id").alias("needs"))
    rows = fact_rows.withColumn("_refers", refers).join(sides, ["session_id", "episode", "call_index", "_refers"], "left")
    one = F.struct(place.alias("at"), priority().alias("priority"), "fact_id", "needs")
    out = rows.groupBy("session_id", "episode").agg(
        F.min(F.when(goal, F.struct(place.alias("p"), F.col("value").alias("v"), F.col("fact_id").alias("id")))).alias("_goal"),
        ordered(F.col("fact_kind").isin("file_change", "command", "tool_call"), F.col("value")).alias("actions"),
        ordered(F.col("outcome") == "failure", F.col("value")).alias("blockers"),
        ordered(F.col("fact_kind") == "verification", F.col("fact_id")).alias("verification_ids"),
        F.array_sort(F.collect_list(one)).alias("_facts"),
        F.count("*").alias("n_facts"),
    )
    marked = F.transform("_facts", lambda f: F.struct(f["at"].alias("at"), f["priority"].alias("priority"), F.coalesce(f["fact_id"] == F.col("_goal.id"), F.lit(False)).alias("opening"), f["fact_id"].alias("fact_id"), f["needs"].alias("needs")))
    # All facts of an episode within the limit are evidence; only longer ones are chosen from.
    long = evidence_column(limit)(F.when(F.col("n_facts") > limit, marked))
    first_line = F.element_at(F.concat(C.lines(F.col("goal"), 1), F.array(F.lit("Untitled task"))), 1)
    out = out.withColumn("goal", F.col("_goal.v")).withColumn("evidence_ids", F.coalesce(long, F.transform("_facts", lambda f: f["fact_id"])))
    return out.withColumn("title", C.byte_cut(first_line, TITLE_BYTES)).drop("_goal", "_facts")


def workstream_keys(text: Column, episode_key: Column, repo_key: Column) -> Column:
    """The episode's own key and one for each issue number that the text names as #n, sorted."""
    numbers = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![A-Za-z0-9])#([1-9][0-9]*)\b"), F.lit(1))
    issues = F.transform(numbers, lambda n: F.concat(F.lit("issue:"), repo_key, F.lit("#"), n))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.concat(F.lit("task:"), episode_key)), issues)))


def only_new(candidates: DataFrame, existing: DataFrame, key: str, content: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is new, and rows that clash with an existing one of other content. Repeats of existing rows are in neither."""
    known = existing.select(key, F.col(content).alias("_known"))
    new = candidates.join(known, key, "left_anti")
    clash = candidates.join(known, key).where(~F.col(content).eqNullSafe(F.col("_known"))).drop("_known")
    return new, clash


# The patch grammar's marks.
PATCH_BEGIN, PATCH_END = "*** Begin Patch", "*** End Patch"
PATCH_LINE = r"^\*\*\* (Add|Update|Delete) File: (.+)$"
PATCH_MOVE = r"^\*\*\* Move to: (.+)$"


def patch_changes(patch: Column) -> Column:
    """The file changes of a patch text in order: array<struct<operation, path, destination>>; null if it isn't a whole patch.

    A move line turns the update before it into a move.
    """
    rows = F.split(F.trim(patch), "\n")
    whole = (F.element_at(rows, 1) == PATCH_BEGIN) & (F.element_at(rows, -1) == PATCH_END) & (F.size(rows) >= 2)
    marks = F.filter(rows, lambda x: x.rlike(PATCH_LINE) | x.rlike(PATCH_MOVE))
    change = lambda m, following: F.struct(
        F.when(following.rlike(PATCH_MOVE) & m.rlike(r"^\*\*\* Update"), "move").otherwise(F.lower(F.regexp_extract(m, PATCH_LINE, 1))).alias("operation"),
        F.regexp_extract(m, PATCH_LINE, 2).alias("path"),
        F.when(following.rlike(PATCH_MOVE), F.regexp_extract(following, PATCH_MOVE, 1)).alias("destination"),
    )
    pairs = F.zip_with(marks, F.concat(F.slice(marks, 2, F.greatest(F.size(marks), F.lit(1))), F.array(F.lit(""))), lambda m, n: F.when(m.rlike(PATCH_LINE), change(m, n)))
    return F.when(whole, F.filter(pairs, lambda x: x.isNotNull()))


def patch_violations(changes: Column, patch: Column, most: int = 4096) -> Column:
    """Limits that a patch breaks: size, number of changes, paths that are too long or hold control characters."""
    paths = F.flatten(F.transform(changes, lambda c: F.array(c["path"], F.coalesce(c["destination"], F.lit("")))))
    return C.violations(
        patch_too_long=F.length(patch) > 4 << 20, too_many_lines=F.size(F.split(patch, "\n")) > 100_000, too_many_changes=F.size(changes) > most,
        path_too_long=F.exists(paths, lambda p: F.length(p) > 4096), path_control=F.exists(paths, lambda p: p.rlike(r"\p{Cc}|\p{Zl}|\p{Zp}")), not_a_patch=changes.isNull(),
    )
