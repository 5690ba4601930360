"""Queries of the trace layer and of functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import columns as C
from tracelode.functions.arrow import prefixes_at, shell_reads, verification
from tracelode.functions.tables import running_sum
from tracelode.operators import traces
from tracelode.plans.adapters import COMMANDS, EVENTS_SQL, messages, none, table, tool_events
from tracelode.plans.registry import query


@query("""
    WITH m AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS episode FROM conversations),
    s AS (SELECT conv_id AS session_id, CAST(episode AS BIGINT) AS episode, min(turn) AS start_index, max(turn) AS last, count(*) AS n_events FROM m WHERE episode > 0 GROUP BY ALL),
    n AS (SELECT *, lead(start_index) OVER (PARTITION BY session_id ORDER BY episode) AS following FROM s)
    SELECT session_id, episode, start_index, coalesce(following, last + 1) AS end_index, CASE WHEN following IS NULL THEN 'manual_finalize' ELSE 'next_user' END AS boundary_kind, n_events, 'unknown' AS outcome FROM n
""")
def epi01_episodes(spark: SparkSession, d: str) -> DataFrame:
    return traces.episodes(messages(spark, d))


@query(f"""
    WITH {EVENTS_SQL},
    s AS (
        SELECT session_id, CAST(episode AS BIGINT) AS episode, min(event_index) AS start_index,
               count(*) FILTER (WHERE kind = 'tool_result' AND observed_outcome IS NOT NULL) AS seen, count(*) FILTER (WHERE kind = 'tool_result' AND observed_outcome = 'success') AS good,
               count(*) FILTER (WHERE is_command_result AND exit_code IS NOT NULL) AS codes, count(*) FILTER (WHERE is_command_result AND exit_code = 0) AS zero
        FROM ev_ep WHERE episode > 0 GROUP BY ALL),
    t AS (SELECT *, CASE WHEN seen > 0 THEN seen ELSE codes END AS n, CASE WHEN seen > 0 THEN good ELSE zero END AS g FROM s)
    SELECT session_id, episode, start_index, CASE WHEN n = 0 THEN 'unknown' WHEN g = n THEN 'success' WHEN g = 0 THEN 'failure' ELSE 'partial' END AS outcome FROM t
""")
def epi04_outcome(spark: SparkSession, d: str) -> DataFrame:
    return traces.episodes(tool_events(spark, d)).select("session_id", "episode", "start_index", "outcome")


@query(f"""
    WITH {EVENTS_SQL},
    e AS (SELECT session_id, min(event_index) FILTER (WHERE episode = 1) AS close_index, min(event_index) FILTER (WHERE episode = 1) + 1 AS end_index FROM ev_ep GROUP BY session_id HAVING close_index IS NOT NULL),
    a AS (
        SELECT v.session_id, v.event_index, v.role = 'user' AS is_user, e.close_index, row_number() OVER (PARTITION BY v.session_id ORDER BY v.event_index) AS n
        FROM ev v JOIN e USING (session_id) WHERE v.event_index >= e.end_index AND v.kind <> 'metadata')
    SELECT session_id, event_index AS start_index, close_index AS continues_episode_id FROM a WHERE n = 1 AND is_user IS NOT TRUE
""")
def epi02_continuations(spark: SparkSession, d: str) -> DataFrame:
    events = tool_events(spark, d)
    first = traces.with_episode(events).where("episode = 1").groupBy("session_id").agg((F.min("event_index") + 1).alias("end_index"), F.min("event_index").alias("episode_id"))
    return traces.continuations(events, first)


@query("""
    WITH c AS (
        SELECT conv_id AS session_id, turn - turn % 2 AS end_index, turn AS start_index, role AS boundary_kind, 7 * turn % 5 AS committed FROM conversations)
    SELECT session_id, end_index, start_index, boundary_kind, CAST(committed AS BIGINT) AS committed,
           CASE WHEN row_number() OVER (PARTITION BY session_id, end_index ORDER BY committed, start_index, boundary_kind) = 1 THEN 'closed' ELSE 'closure_lost' END AS state FROM c
""")
def epi03_first_close(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return traces.first_close_wins(c.select(F.col("conv_id").alias("session_id"), (F.col("turn") - F.col("turn") % 2).alias("end_index"), F.col("turn").alias("start_index"), F.col("role").alias("boundary_kind"), (7 * F.col("turn") % 5).alias("committed")))


@query("""
    WITH m AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS episode FROM conversations),
    s AS (SELECT conv_id, episode, min(turn) AS a, max(turn) + 1 AS b FROM m WHERE episode > 0 GROUP BY ALL),
    e AS (SELECT conv_id AS session_id, coalesce(lead(a) OVER (PARTITION BY conv_id ORDER BY episode), b) AS end_index FROM s),
    p AS (SELECT session_id, end_index, list(sha256(c.text) ORDER BY c.turn) AS digests FROM e JOIN conversations c ON c.conv_id = session_id AND c.turn < end_index GROUP BY ALL)
    SELECT session_id, end_index, list_reduce(list_prepend(sha256('tracelode:raw-prefix:v1'), digests), lambda h, x: sha256(unhex(h) || unhex(x))) AS prefix_sha256 FROM p
""")
def epi05_prefix_hash(spark: SparkSession, d: str) -> DataFrame:
    events = messages(spark, d)
    return traces.prefix_at_ends(events, traces.episodes(events))


@query(f"""
    WITH {EVENTS_SQL},
    o AS (SELECT session_id, max(episode) AS last FROM ev_ep GROUP BY session_id),
    c AS (SELECT session_id, min(event_index) AS closed_to FROM ev_ep JOIN o USING (session_id) WHERE episode = last AND last > 1 GROUP BY session_id),
    a AS (
        SELECT v.session_id, coalesce(min(v.event_index) FILTER (WHERE v.kind <> 'metadata' AND v.event_index >= coalesce(c.closed_to, 0)), max(v.event_index) + 1) AS resume_index
        FROM ev v LEFT JOIN c USING (session_id) GROUP BY v.session_id)
    SELECT a.session_id, a.resume_index, coalesce(list_sort(list_distinct(list(v.call_id) FILTER (WHERE v.kind = 'tool_call'))), []) AS call_ids, CAST(count(v.path) AS BIGINT) AS file_changes
    FROM a LEFT JOIN ev v ON v.session_id = a.session_id AND v.event_index < a.resume_index GROUP BY ALL
""")
def epi06_resume_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    events = tool_events(spark, d)
    return traces.resume_checkpoint(events, traces.episodes(events, final_boundary=None))


CALLS_SQL = f"""
    WITH {EVENTS_SQL},
    c AS (SELECT session_id, call_id, min(event_index) AS call_index, count(*) - 1 AS duplicates FROM ev WHERE kind = 'tool_call' GROUP BY ALL),
    r AS (SELECT c.session_id, c.call_id, min(v.event_index) AS result_index, min_by(v.outcome, v.event_index) AS result_outcome FROM c JOIN ev_out v ON v.session_id = c.session_id AND v.call_id = c.call_id AND v.kind = 'tool_result' AND v.event_index > c.call_index GROUP BY ALL)
    SELECT c.*, r.result_index, r.result_outcome FROM c LEFT JOIN r USING (session_id, call_id)
"""


@query(CALLS_SQL)
def trc05_call_pairing(spark: SparkSession, d: str) -> DataFrame:
    return traces.paired_calls(tool_events(spark, d))


@query(f"""
    WITH {EVENTS_SQL},
    y AS (SELECT session_id, event_index, call_id, kind, outcome, CASE WHEN (CAST(split_part(call_id, ':', 2) AS INTEGER) % 3 = 0) AND tool_status IS DISTINCT FROM 'failed' THEN 'custom' ELSE 'function' END AS output_type FROM ev_out WHERE call_id IS NOT NULL),
    c AS (SELECT session_id, call_id, min(event_index) AS call_index, min_by(output_type, event_index) AS expects, count(*) AS n FROM y WHERE kind = 'tool_call' GROUP BY ALL),
    a AS (SELECT c.*, y.event_index, y.outcome, y.output_type = expects AS fits FROM c JOIN y USING (session_id, call_id) WHERE y.kind = 'tool_result' AND y.event_index > call_index),
    f AS (SELECT session_id, call_id, min(event_index) AS result_index, min_by(outcome, event_index) AS result_outcome FROM a WHERE fits GROUP BY ALL)
    SELECT c.session_id, c.call_id, c.call_index, f.result_index, f.result_outcome,
           (SELECT count(*) FROM a WHERE a.session_id = c.session_id AND a.call_id = c.call_id AND NOT fits AND (f.result_index IS NULL OR a.event_index < f.result_index)) AS mismatched,
           CASE WHEN c.n > 1 THEN 'duplicate_call_id' END AS violation
    FROM c LEFT JOIN f USING (session_id, call_id)
""")
def trc05_typed_pairing(spark: SparkSession, d: str) -> DataFrame:
    """Calls of two kinds; of every third call id a failed result is of the other kind and leaves the call open."""
    custom = (F.split("call_id", ":")[1].cast("int") % 3 == 0) & ~F.coalesce(F.col("tool_status") == "failed", F.lit(False))
    return traces.typed_pairs(tool_events(spark, d).withColumn("output_type", F.when(custom, "custom").otherwise("function")))


@query("""
    WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
    SELECT event_id, array_to_string(CASE k % 6 WHEN 0 THEN ['src/a' || k || '.py', 'src/b.py'] WHEN 1 THEN ['src/a' || k || '.py'] WHEN 2 THEN ['docs/' || k || '.md', 'notes'] WHEN 3 THEN ['log/' || k || '.txt'] ELSE [] END, ',') AS paths FROM e
""")
def src20_shell_reads(spark: SparkSession, d: str) -> DataFrame:
    """The files that each event's command reads: several, through a pipe, in a shell's script, by redirection, none, and a line that can't be read."""
    k = F.get_json_object("props", "$.k")
    forms = ("cat src/a{}.py src/b.py", "sed -n '1,20p' src/a{}.py | head -n 5", "bash -lc \"head -5 docs/{}.md; grep x y > out.txt && cat notes\"", "tail -n 3 < log/{}.txt", "make build", "cat 'src/{}")
    command = F.element_at(F.array(*(F.replace(F.lit(x), F.lit("{}"), k) for x in forms)), k.cast("int") % len(forms) + 1)
    return table(spark, d, "events").select("event_id", F.array_join(shell_reads(command), ",").alias("paths"))


FACTS_SQL = f"""
    WITH {EVENTS_SQL},
    l AS (
        SELECT *, max(CASE WHEN kind = 'tool_call' THEN event_index END) OVER w AS call_index, max(CASE WHEN kind = 'tool_call' AND command IS NOT NULL THEN event_index END) OVER w AS run_index
        FROM ev_ep WHERE episode > 0 WINDOW w AS (PARTITION BY session_id, episode, call_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (
        SELECT session_id, episode, event_index, 0 AS o, 'message' AS fact_kind, role, text AS value, NULL AS outcome, NULL AS exit_code, NULL AS call_index, NULL AS check_name FROM l WHERE kind = 'message'
        UNION ALL SELECT session_id, episode, event_index, 1, 'tool_call', NULL, tool_name, NULL, NULL, NULL, NULL FROM l WHERE kind = 'tool_call'
        UNION ALL SELECT session_id, episode, event_index, 2, 'command', NULL, command, NULL, NULL, NULL, NULL FROM l WHERE kind = 'tool_call' AND command IS NOT NULL
        UNION ALL SELECT session_id, episode, event_index, 3, 'file_change', NULL, path, NULL, NULL, NULL, NULL FROM l WHERE path IS NOT NULL
        UNION ALL SELECT session_id, episode, event_index, 4, 'tool_result', NULL, tool_status, outcome, NULL, call_index, NULL FROM l WHERE kind = 'tool_result' AND call_index IS NOT NULL
        UNION ALL SELECT session_id, episode, event_index, 5, 'command_result', NULL, command, outcome, exit_code, run_index, NULL FROM l WHERE is_command_result AND run_index IS NOT NULL
        UNION ALL SELECT session_id, episode, event_index, 6, 'verification', NULL, command, outcome, NULL, run_index, CASE WHEN command LIKE '%pytest%' THEN 'pytest' ELSE 'cargo' END FROM l WHERE is_command_result AND run_index IS NOT NULL AND command <> 'make build'
        UNION ALL SELECT session_id, episode, event_index, 7, 'message', 'tool', text, NULL, NULL, NULL, NULL FROM l WHERE kind = 'tool_result' AND call_index IS NULL AND run_index IS NULL AND text IS NOT NULL),
    g AS (SELECT * EXCLUDE (o), CAST(row_number() OVER (PARTITION BY session_id, event_index ORDER BY o) - 1 AS INTEGER) AS fact_ordinal FROM f),
    facts AS (
        SELECT session_id, CAST(episode AS BIGINT) AS episode, event_index, fact_ordinal, fact_kind, role, value, outcome, CAST(exit_code AS INTEGER) AS exit_code, CAST(call_index AS BIGINT) AS call_index, check_name,
               'fact_' || sha256(CAST(to_json({{'event_index': event_index, 'fact_kind': fact_kind, 'fact_ordinal': fact_ordinal, 'repo_key': NULL, 'role': role, 'session_id': CAST(session_id AS VARCHAR), 'value': value}}) AS VARCHAR)) AS fact_id
        FROM g)
"""


@query(FACTS_SQL + " SELECT * FROM facts")
def trc14_facts(spark: SparkSession, d: str) -> DataFrame:
    return traces.facts(tool_events(spark, d))


@query(FACTS_SQL + """,
    r AS (
        SELECT *, row_number() OVER (PARTITION BY session_id, episode ORDER BY CASE WHEN outcome = 'failure' THEN 0 WHEN fact_kind = 'verification' THEN 1 WHEN fact_kind IN ('file_change', 'command', 'tool_call') THEN 2 WHEN fact_kind = 'message' AND role = 'user' THEN 3 ELSE 4 END, event_index, fact_ordinal) AS n
        FROM facts)
    SELECT session_id, episode, min_by(value, event_index * 100 + fact_ordinal) FILTER (WHERE fact_kind = 'message' AND role = 'user') AS goal, count(*) AS n_facts,
           coalesce(array_to_string(list(value ORDER BY event_index, fact_ordinal) FILTER (WHERE fact_kind IN ('file_change', 'command', 'tool_call')), '|'), '') AS actions,
           coalesce(array_to_string(list(value ORDER BY event_index, fact_ordinal) FILTER (WHERE outcome = 'failure'), '|'), '') AS blockers,
           count(*) FILTER (WHERE fact_kind = 'verification') AS verifications, count(*) FILTER (WHERE n <= 128) AS evidence, goal AS title
    FROM r GROUP BY session_id, episode
""")
def epi08_experience(spark: SparkSession, d: str) -> DataFrame:
    rows = traces.experiences(traces.facts(tool_events(spark, d)))
    return rows.select("session_id", "episode", "goal", "n_facts", F.array_join("actions", "|").alias("actions"), F.array_join("blockers", "|").alias("blockers"), F.size("verification_ids").cast("long").alias("verifications"), F.size("evidence_ids").cast("long").alias("evidence"), "title")


EVIDENCE_SQL = FACTS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
    ep AS (SELECT * REPLACE (session_id // 3 AS session_id, 0 AS episode), lpad(CAST(event_index AS VARCHAR), 12, '0') || lpad(CAST(fact_ordinal AS VARCHAR), 4, '0') AS place FROM facts),
    need AS (
        SELECT e.*, c.fact_id AS needs, CASE WHEN e.outcome = 'failure' THEN 0 WHEN e.fact_kind = 'verification' THEN 1 WHEN e.fact_kind IN ('file_change', 'command', 'tool_call') THEN 2 WHEN e.fact_kind = 'message' AND e.role = 'user' THEN 3 ELSE 4 END AS priority,
               e.place = min(CASE WHEN e.fact_kind = 'message' AND e.role = 'user' THEN e.place END) OVER (PARTITION BY e.session_id) AS opening
        FROM ep e LEFT JOIN ep c ON c.session_id = e.session_id AND c.event_index = e.call_index
             AND c.fact_kind = CASE WHEN e.fact_kind = 'tool_result' THEN 'tool_call' WHEN e.fact_kind IN ('command_result', 'verification') THEN 'command' END),
    tried AS (SELECT session_id, fact_id, needs, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(opening, false) DESC, priority, place) AS n FROM need),
    step AS (
        SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS chosen FROM tried
        UNION ALL
        SELECT s.session_id, t.n, CASE WHEN list_contains(s.chosen, t.fact_id) THEN s.chosen
               WHEN t.needs IS NULL OR list_contains(s.chosen, t.needs) THEN list_append(s.chosen, t.fact_id)
               WHEN len(s.chosen) + 2 <= 128 THEN list_append(list_append(s.chosen, t.needs), t.fact_id) ELSE s.chosen END
        FROM step s JOIN tried t ON t.session_id = s.session_id AND t.n = s.n + 1 WHERE len(s.chosen) < 128)
    SELECT session_id, unnest(max_by(chosen, n)) AS fact_id FROM step GROUP BY session_id
"""


@query(EVIDENCE_SQL)
def epi07_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Long episodes of three sessions' facts each, so that evidence has to be chosen."""
    facts = traces.facts(tool_events(spark, d)).withColumn("session_id", F.floor(F.col("session_id") / 3)).withColumn("episode", F.lit(0).cast("long"))
    return traces.experiences(facts).select("session_id", F.explode("evidence_ids").alias("fact_id"))


@query(f"""
    WITH {EVENTS_SQL},
    k AS (SELECT session_id, event_index, md5(call_id) AS memory_id, kind || coalesce(command, '') AS content FROM ev WHERE call_id IS NOT NULL)
    SELECT (SELECT count(DISTINCT memory_id) FROM k WHERE memory_id NOT IN (SELECT memory_id FROM k WHERE event_index % 2 = 0)) AS created,
           (SELECT count(*) FROM (SELECT DISTINCT a.memory_id, a.content FROM k a JOIN (SELECT memory_id, min(content) AS known FROM k WHERE event_index % 2 = 0 GROUP BY memory_id) b USING (memory_id) WHERE a.event_index % 2 = 1 AND a.content <> b.known)) AS conflicts
""")
def epi11_reimport(spark: SparkSession, d: str) -> DataFrame:
    rows = tool_events(spark, d).where("call_id is not null").select("event_index", F.md5(F.col("call_id").cast("binary")).alias("memory_id"), F.concat("kind", F.coalesce("command", F.lit(""))).alias("content"))
    existing = rows.where("event_index % 2 = 0").groupBy("memory_id").agg(F.min("content").alias("content"))
    new, clash = traces.only_new(rows.where("event_index % 2 = 1"), existing, "memory_id", "content")
    return new.agg(F.countDistinct("memory_id").alias("created")).join(F.broadcast(clash.select("memory_id", "content").distinct().agg(F.count("*").alias("conflicts"))))


@query("""
    WITH t AS (SELECT doc_id, lang, text || ' see #' || (doc_id % 90 + 1) || ' and a#7, #12x (#' || (doc_id % 7) || ')' AS text FROM documents)
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(['task:' || doc_id], list_transform(regexp_extract_all(text, '(?:^|[^A-Za-z0-9])#([1-9][0-9]*)\\b', 1), lambda n: 'issue:' || lang || '#' || n)))), ',') AS keys FROM t
""")
def epi12_workstream_keys(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("text", F.lit(" see #"), F.col("doc_id") % 90 + 1, F.lit(" and a#7, #12x (#"), F.col("doc_id") % 7, F.lit(")"))
    return table(spark, d, "documents").select("doc_id", F.array_join(traces.workstream_keys(text, F.col("doc_id").cast("string"), F.col("lang")), ",").alias("keys"))


@query("""
    WITH l AS (SELECT user_id, event_id, value, event_type FROM events)
    SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS purchases FROM l
""")
def win01_running_count(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return running_sum(rows, ["user_id"], "event_id", F.when(F.col("event_type") == "purchase", 1).otherwise(0), "purchases").drop("event_type")


@query("""SELECT conv_id, turn, 'evt_' || sha256(CAST(to_json({'role': role, 'session': CAST(conv_id AS VARCHAR), 'turn': turn}) AS VARCHAR)) AS typed, 'evt_' || substr(sha256(conv_id || chr(31) || turn || chr(31) || 'None'), 1, 20) AS stable FROM conversations""")
def fn01_typed_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", C.typed_id("evt", session=F.col("conv_id").cast("string"), role=F.col("role"), turn=F.col("turn")).alias("typed"), C.stable_id("evt", F.col("conv_id"), F.col("turn"), none("string")).alias("stable"))


@query("""
    WITH c AS (SELECT conv_id, list(sha256(text) ORDER BY turn) AS digests FROM conversations GROUP BY conv_id)
    SELECT conv_id, list_reduce(list_prepend(sha256('tracelode:raw-prefix:v1'), digests), lambda h, x: sha256(unhex(h) || unhex(x))) AS prefix FROM c
""")
def fn02_prefix_chain(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("place"), F.sha2("text", 256).alias("digest"))
    ends = rows.groupBy("key").agg((F.max("place") + 1).alias("place"))
    return prefixes_at(rows, ends).select(F.col("key").alias("conv_id"), F.col("prefix_sha256").alias("prefix"))


@query("""SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key FROM conversations""")
def fn03_machine_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", C.machine_key(F.col("text")).alias("key"))


@query("""SELECT doc_id, CAST(ceil(strlen(text) / 2) AS BIGINT) AS tokens FROM documents""")
def fn04_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.tokens_estimate(F.col("text")).alias("tokens"))


@query("""SELECT lang, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95 FROM documents GROUP BY lang""")
def fn05_percentile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(C.nearest_rank("n_chars", 0.5).cast("long").alias("p50"), C.nearest_rank("n_chars", 0.95).cast("long").alias("p95"))


@query("""
    WITH q AS (SELECT list(CAST(x AS DOUBLE) ORDER BY i) AS q FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id = 0))
    SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS similarity FROM embeddings, q
""")
def fn06_cosine(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    one = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return rows.join(F.broadcast(one)).select("vec_id", F.round(C.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


@query("""
    WITH k AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ['k'] WHEN 1 THEN ['k', 'z'] ELSE ['a', 'b'] END AS keys FROM events)
    SELECT event_id, array_to_string(list_sort(list_concat(list_transform(list_filter(['b', 'k'], lambda x: NOT list_contains(keys, x)), lambda x: 'missing:' || x), list_transform(list_filter(keys, lambda x: NOT list_contains(['b', 'k'], x)), lambda x: 'unknown:' || x))), ',') AS violations FROM k
""")
def fn07_closed_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = F.json_object_keys(F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.lit('{"k": 1, "z": 2}')).otherwise(F.lit('{"a": 1, "b": 2}')))
    return table(spark, d, "events").select("event_id", F.array_join(C.key_violations(keys, ["k", "b"]), ",").alias("violations"))


@query("""
    SELECT doc_id, CASE WHEN strlen(text) <= 81 THEN text ELSE regexp_replace(substr(text, 1, list_max(list_filter(range(0, 82), lambda i: strlen(substr(text, 1, i)) <= 81))), '\\s+$', '') END AS head FROM documents
""")
def fn08_byte_cut(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.byte_cut(F.col("text"), 81).alias("head"))


@query("""
    SELECT doc_id, array_to_string(list_filter([CASE WHEN strlen(text) > 2000 THEN 'content_too_long' END, CASE WHEN lang <> 'en' THEN 'other_language' END, CASE WHEN n_chars <> length(text) THEN 'wrong_length' END], lambda x: x IS NOT NULL), ',') AS violations FROM documents
""")
def val01_violations(spark: SparkSession, d: str) -> DataFrame:
    rules = C.violations(content_too_long=F.octet_length("text") > 2000, other_language=F.col("lang") != "en", wrong_length=F.col("n_chars") != F.length("text"))
    return table(spark, d, "documents").select("doc_id", F.array_join(rules, ",").alias("violations"))


PROGRAMS = ("pytest", "mypy", "tox", "nox", "ruff", "make", "npm", "pnpm", "yarn", "bun", "cargo", "go", "gradle", "gradlew", "mvn", "mvnw", "echo")
ARGUMENTS = ("check", "test", "run test", "run build", "run start", "-q lint", "'vet' ./...", '"format" x', "build", "")
WRAPPERS = ("", "uv run ", "./", "/usr/bin/", "uv run ./")


@query(f"""
    WITH e AS (SELECT event_id, {list(PROGRAMS)}[event_id % 17 + 1] AS p, {[a.replace("'", "''") for a in ARGUMENTS]}[event_id % 10 + 1] AS a, event_id % 83 = 0 AS open FROM events),
    w AS (SELECT *, string_split(replace(replace(a, chr(39), ''), '"', ''), ' ') AS r FROM e)
    SELECT event_id, CASE
        WHEN open THEN NULL
        WHEN p IN ('pytest', 'mypy', 'tox', 'nox', 'gradle', 'gradlew', 'mvn', 'mvnw') THEN p
        WHEN p = 'ruff' AND r[1] IN ('check', 'format') THEN p
        WHEN p = 'make' AND list_has_any(r, ['check', 'ci', 'lint', 'test']) THEN p
        WHEN p IN ('npm', 'pnpm', 'yarn', 'bun') AND (r[1] = 'test' OR (r[1] = 'run' AND r[2] IN ('build', 'test'))) THEN p
        WHEN p = 'cargo' AND r[1] IN ('build', 'check', 'test') THEN p
        WHEN p = 'go' AND r[1] IN ('build', 'test', 'vet') THEN p END AS check_name FROM w
""".replace(str([a.replace("'", "''") for a in ARGUMENTS]), "[" + ", ".join("'" + a.replace("'", "''") + "'" for a in ARGUMENTS) + "]"))
def trc13_verification(spark: SparkSession, d: str) -> DataFrame:
    """Programs with arguments, quotes and wrappers; each 83rd has a quote that doesn't close."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int"))
    command = F.concat(pick(WRAPPERS), pick(PROGRAMS), F.lit(" "), pick(ARGUMENTS), F.when(F.col("event_id") % 83 == 0, " 'open").otherwise(""))
    return table(spark, d, "events").select("event_id", verification(command).alias("check_name"))


@query("""
    WITH p AS (SELECT p_partkey, 'a/' || p_size || '.py' AS a, 'b/' || p_brand AS b FROM part)
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'add ' || a || ';delete ' || b WHEN 1 THEN 'move ' || a || ' to ' || b WHEN 2 THEN 'update ' || a || ';move ' || b || ' to ' || a ELSE NULL END AS changes FROM p
""")
def trc08_patch_changes(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.concat(F.lit("a/"), F.col("p_size"), F.lit(".py")), F.concat(F.lit("b/"), F.col("p_brand"))
    body = F.when(
        F.col("p_partkey") % 4 == 0, F.concat(F.lit("*** Add File: "), a, F.lit("\n+x\n*** Delete File: "), b)).when(
        F.col("p_partkey") % 4 == 1, F.concat(F.lit("*** Update File: "), a, F.lit("\n*** Move to: "), b, F.lit("\n@@\n-x\n+y"))).when(
        F.col("p_partkey") % 4 == 2, F.concat(F.lit("*** Update File: "), a, F.lit("\n@@\n-x\n*** Update File: "), b, F.lit("\n*** Move to: "), a))
    patch = F.coalesce(F.concat(F.lit("*** Begin Patch\n"), body, F.lit("\n*** End Patch")), F.lit("no patch"))
    said = F.transform(traces.patch_changes(patch), lambda c: F.concat(c["operation"], F.lit(" "), c["path"], F.coalesce(F.concat(F.lit(" to "), c["destination"]), F.lit(""))))
    return table(spark, d, "part").select("p_partkey", F.array_join(said, ";").alias("changes"))


@query("""
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'owner/name' || page_id WHEN 1 THEN 'owner/deep/name' ELSE NULL END AS repo_key, CASE page_id % 4 WHEN 0 THEN 'src/a' || page_id || '.py' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'a/b' END AS path FROM pages
""")
def trc15_keys_and_paths(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    url = F.when(n % 3 == 0, F.concat(F.lit("git@host.example:Owner/Name"), n, F.lit(".git"))).when(n % 3 == 1, "https://host.example/owner/deep/name/").otherwise("nothing")
    path = F.when(n % 4 == 0, F.concat(F.lit("./src//a"), n, F.lit(".py"))).when(n % 4 == 1, "/etc/x").when(n % 4 == 2, "a/../b").otherwise("a/./b")
    return table(spark, d, "pages").select("page_id", C.repo_key(url).alias("repo_key"), C.safe_path(path).alias("path"))


@query("""
    WITH l AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS line, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) - 1 AS i FROM documents)
    SELECT doc_id, CAST(i AS BIGINT) AS event_index, sha256(line) AS event_sha256, CAST(strlen(line) AS BIGINT) AS bytes FROM l
""")
def src01_lines(spark: SparkSession, d: str) -> DataFrame:
    from tracelode.sources.transcripts import raw_lines

    sessions = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_path"), F.octet_length("text").alias("length"), F.encode("text", "UTF-8").alias("content"))
    # Documents aren't sessions, so no limit of sessions holds for them.
    return raw_lines(sessions, (1 << 63) - 1, (1 << 31) - 1).select(F.col("source_path").cast("long").alias("doc_id"), "event_index", "event_sha256", F.octet_length("line").cast("long").alias("bytes"))
