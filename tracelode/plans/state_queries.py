"""Queries of queues, joins, sets, pages, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelode.functions.tables import shared_folder, stored, top_per_group
from tracelode.operators import state
from tracelode.plans.adapters import EVENTS_SQL, JOBS_SQL, MEMORIES_SQL, NOW_MS, ORDERS_SQL, PREFERENCES_SQL, TYPES, jobs, memories, messages, order_edges, order_memories, preferences, promotions, table, tool_events
from tracelode.plans.registry import query
from tracelode.sources import lake
from tracelode.streaming.episodes import CLOSED, CONTROL, EVENT_SCHEMA, close_episodes, start_table


@query(f"WITH {ORDERS_SQL} SELECT memory_id, memory_type, status FROM ost WHERE status = 'active'")
def jn01_status_join(spark: SparkSession, d: str) -> DataFrame:
    from tracelode.operators.evolution import with_status

    status = with_status(order_memories(spark, d).select("repo_key", "memory_id"), order_edges(spark, d)).where("status = 'active'")
    return order_memories(spark, d).join(status, ["repo_key", "memory_id"]).select("memory_id", "memory_type", "status")


@query("""
    WITH a AS (SELECT p_partkey, unnest([p_partkey, p_partkey * 3, p_size]) AS id, unnest([0, 1, 2]) AS pos FROM part)
    SELECT p_partkey, coalesce(array_to_string(list(c_custkey ORDER BY pos) FILTER (WHERE c_custkey IS NOT NULL), ','), '') AS found, count(*) FILTER (WHERE c_custkey IS NULL) AS missing FROM a LEFT JOIN customer ON c_custkey = id GROUP BY p_partkey
""")
def jn03_facts_by_id(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "part").select("p_partkey", F.posexplode(F.array("p_partkey", F.col("p_partkey") * 3, F.col("p_size").cast("long"))).alias("pos", "id"))
    rows = asked.join(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(True).alias("there")), "id", "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("there"), F.struct("pos", "id"))))
    return rows.groupBy("p_partkey").agg(F.array_join(F.transform(kept, lambda x: x["id"].cast("string")), ",").alias("found"), F.count_if(F.col("there").isNull()).alias("missing"))


@query("""SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def jn04_allowed_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query(f"""
    WITH {ORDERS_SQL}
    SELECT e.predecessor_id, e.successor_id, p.memory_type AS predecessor_type, s.memory_type AS successor_type, x.status AS predecessor_status
    FROM oe e LEFT JOIN om p ON p.memory_id = e.predecessor_id LEFT JOIN om s ON s.memory_id = e.successor_id LEFT JOIN ost x ON x.memory_id = e.predecessor_id
""")
def jn07_proposal_lookup(spark: SparkSession, d: str) -> DataFrame:
    from tracelode.operators.evolution import with_status

    rows, edges = order_memories(spark, d), order_edges(spark, d)
    p = with_status(rows, edges).select(F.col("memory_id").alias("predecessor_id"), F.col("memory_type").alias("predecessor_type"), F.col("status").alias("predecessor_status"))
    s = rows.select(F.col("memory_id").alias("successor_id"), F.col("memory_type").alias("successor_type"))
    return edges.select("predecessor_id", "successor_id").join(p, "predecessor_id", "left").join(s, "successor_id", "left")


@query("""
    WITH r AS (SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN event_type END AS repo_key FROM events), w AS (SELECT * FROM (VALUES (NULL, 'global'), ('click', 'clicks'), ('error', 'errors')) t(repo_key, name))
    SELECT event_id, name FROM r JOIN w ON r.repo_key IS NOT DISTINCT FROM w.repo_key
""")
def jn08_null_safe(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(None, "global"), ("click", "clicks"), ("error", "errors")], "wanted string, name string")
    rows = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("event_type")).alias("repo_key"))
    return rows.join(F.broadcast(names), F.col("repo_key").eqNullSafe(F.col("wanted"))).select("event_id", "name")


INDEX_SQL = """
    e AS (SELECT doc_id, sha256(text) AS f FROM documents WHERE doc_id % 11 <> 0), a AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS f FROM documents WHERE doc_id % 5 <> 0)
"""


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return docs.where("doc_id % 11 <> 0").select("doc_id", F.sha2("text", 256).alias("f")), docs.where("doc_id % 5 <> 0").select("doc_id", F.sha2(changed, 256).alias("f"))


@query(f"""
    WITH {INDEX_SQL} SELECT coalesce(e.doc_id, a.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN e.doc_id IS NULL THEN 'extra' ELSE 'changed' END AS state FROM e FULL JOIN a ON e.doc_id = a.doc_id WHERE e.f IS DISTINCT FROM a.f
""")
def jn10_index_diff(spark: SparkSession, d: str) -> DataFrame:
    return state.parity(*_index(spark, d), "doc_id", "f")


@query(f"WITH {INDEX_SQL} SELECT DISTINCT doc_id FROM ((SELECT * FROM e EXCEPT ALL SELECT * FROM a) UNION ALL (SELECT * FROM a EXCEPT ALL SELECT * FROM e))")
def set02_changed(spark: SparkSession, d: str) -> DataFrame:
    return state.to_requeue(*_index(spark, d), "doc_id", ["f"])


@query(f"WITH {INDEX_SQL} SELECT CAST(count(*) AS BIGINT) AS differences, count(*) = 0 AS parity FROM ((SELECT * FROM e EXCEPT ALL SELECT * FROM a) UNION ALL (SELECT * FROM a EXCEPT ALL SELECT * FROM e))")
def set01_parity(spark: SparkSession, d: str) -> DataFrame:
    e, a = _index(spark, d)
    return e.exceptAll(a).unionByName(a.exceptAll(e)).agg(F.count("*").alias("differences"), (F.count("*") == 0).alias("parity"))


@query("""
    WITH k AS (SELECT c_custkey, [c_nationkey, c_custkey % 10, c_custkey % 7] AS candidates, [c_nationkey, c_custkey % 5] AS open FROM customer)
    SELECT c_custkey, array_to_string(list_sort(list_distinct(list_intersect(candidates, open))), ',') AS closable, array_to_string(list_sort(list_distinct(candidates)), ',') AS normal FROM k
""")
def set03_intersection(spark: SparkSession, d: str) -> DataFrame:
    candidates, opened = F.array(F.col("c_nationkey").cast("long"), F.col("c_custkey") % 10, F.col("c_custkey") % 7), F.array(F.col("c_nationkey").cast("long"), F.col("c_custkey") % 5)
    said = lambda a: F.array_join(F.array_sort(F.array_distinct(a)).cast("array<string>"), ",")
    return table(spark, d, "customer").select("c_custkey", said(F.array_intersect(candidates, opened)).alias("closable"), said(candidates).alias("normal"))


@query("""
    WITH s AS (SELECT l_orderkey, list_distinct(list(l_partkey % 5)) AS captured, list_distinct(list(l_suppkey % 5)) AS recalled, list_distinct(list(l_linenumber % 5)) AS injected FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, array_to_string(list_sort(list_intersect(list_intersect(captured, recalled), injected)), ',') AS continuous,
           len(list_filter(injected, lambda x: NOT list_contains(recalled, x))) = 0 AND len(list_filter(recalled, lambda x: NOT list_contains(captured, x))) = 0 AS narrows FROM s
""")
def set04_continuity(spark: SparkSession, d: str) -> DataFrame:
    from tracelode.operators.evaluation import continuity

    ids = lambda c: F.collect_set((F.col(c) % 5).cast("long"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(ids("l_partkey").alias("captured"), ids("l_suppkey").alias("recalled"), ids("l_linenumber").alias("injected"))
    return continuity(rows).select("l_orderkey", F.array_join(F.col("continuous").cast("array<string>"), ",").alias("continuous"), "narrows")


@query(f"""WITH {JOBS_SQL} SELECT repo_key, {", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in state.INDEX_STATES)} FROM jobs GROUP BY repo_key""")
def agg01_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    return state.zero_filled(jobs(spark, d), ["repo_key"], "status", state.INDEX_STATES)


@query(f"WITH {JOBS_SQL} SELECT count(*) AS jobs, CAST(coalesce(sum(attempts), 0) AS BIGINT) AS attempts, count(*) FILTER (WHERE status = 'pending') AS pending, count(DISTINCT repo_key) AS repositories, CAST(coalesce(sum(attempts) FILTER (WHERE status = 'none'), 0) AS BIGINT) AS conflicted FROM jobs")
def agg02_counts(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).agg(F.count("*").alias("jobs"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"), F.count_if(F.col("status") == "pending").alias("pending"), F.countDistinct("repo_key").alias("repositories"), F.coalesce(F.sum(F.when(F.col("status") == "none", F.col("attempts"))), F.lit(0)).alias("conflicted"))


@query(f"""
    WITH {JOBS_SQL},
    i AS (SELECT customer, max(job_id) FILTER (WHERE job_id % 2 = 0) AS m FROM jobs GROUP BY ALL HAVING m IS NOT NULL), o AS (SELECT customer, bool_or(status <> 'indexed') AS open FROM jobs WHERE customer % 5 <> 0 GROUP BY ALL),
    s AS (SELECT customer, count(*) FILTER (WHERE attempts = 4) AS f, count(*) FILTER (WHERE attempts = 3) AS p FROM jobs GROUP BY ALL)
    SELECT customer, CAST(coalesce(m, -1) AS BIGINT) AS source_cursor, CAST(CASE WHEN coalesce(open, false) THEN -1 ELSE coalesce(m, -1) END AS BIGINT) AS index_cursor, CASE WHEN f > 0 THEN 'failed' WHEN p > 0 THEN 'pending' ELSE 'complete' END AS semantic_state
    FROM s LEFT JOIN i USING (customer) LEFT JOIN o USING (customer)
""")
def agg03_cursors(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs(spark, d)
    imports = rows.where("job_id % 2 = 0").select("customer", F.col("job_id").alias("committed_index"))
    semantic = rows.select("customer", F.when(F.col("attempts") == 4, "failed").when(F.col("attempts") == 3, "pending").otherwise("completed").alias("status"))
    return state.cursors(imports, rows.where("customer % 5 <> 0"), semantic, ["customer"])


@query("""SELECT doc_id, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 12""")
def win05_top_per_group(spark: SparkSession, d: str) -> DataFrame:
    return top_per_group(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 12).drop("rank")


@query("""SELECT source, doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('seed' || chr(0) || doc_id), doc_id) <= 7""")
def win07_stratified(spark: SparkSession, d: str) -> DataFrame:
    from tracelode.operators.evaluation import stratified

    return stratified(table(spark, d, "documents"), "lang", "doc_id", 7, "seed").select("source", "doc_id", "lang")


@query("""SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id""")
def win10_latest(spark: SparkSession, d: str) -> DataFrame:
    return state.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", ["event_id"])


@query("""
    WITH s AS (SELECT l_orderkey, l_linenumber > lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS up FROM lineitem) SELECT l_orderkey AS run_id, bool_and(coalesce(up, true)) AS ordered FROM s GROUP BY ALL
""")
def win11_increasing(spark: SparkSession, d: str) -> DataFrame:
    from tracelode.operators.evaluation import steps_increase

    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber", F.struct("l_partkey", "l_suppkey", "l_linenumber").alias("o"))
    return steps_increase(rows, "run_id", "l_linenumber", "o")


@query(f"""WITH {MEMORIES_SQL} SELECT memory_id, memory_type FROM mem ORDER BY list_position({list(TYPES)}, memory_type), created_at_ms DESC, memory_id LIMIT 100""")
def top01_order(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).orderBy(F.array_position(F.array(*map(F.lit, TYPES)), F.col("memory_type")), F.desc("created_at_ms"), "memory_id").limit(100).select("memory_id", "memory_type")


@query(f"""
    WITH {JOBS_SQL} SELECT job_id, CAST(attempts + 1 AS INTEGER) AS attempts, 'worker' AS owner FROM jobs WHERE attempts < 3 AND (status IN ('pending', 'failed', 'stale') OR (status = 'leased' AND lease_expires_ms <= {NOW_MS})) ORDER BY created_ms, job_id LIMIT 50
""")
def top02_claim(spark: SparkSession, d: str) -> DataFrame:
    return state.claim(jobs(spark, d), F.lit(NOW_MS), 50, "worker", 60_000).select("job_id", "attempts", "owner")


@query("""SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 20""")
def top03_recent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type in ('error', 'signup')").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "event_type")


@query("""
    WITH p AS (SELECT o_orderkey AS job_id, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 51)
    SELECT job_id, CASE WHEN n = 50 AND (SELECT count(*) FROM p) > 50 THEN rtrim(translate(base64(CAST(CAST(to_json({'after': CAST(job_id AS VARCHAR), 'repo': 'r'}) AS VARCHAR) AS BLOB)), '+/', '-_'), '=') END AS next_cursor FROM p WHERE n <= 50
""")
def top04_page(spark: SparkSession, d: str) -> DataFrame:
    return state.page(jobs(spark, d).select("job_id"), "job_id", 50, F.lit("r"), F.lit(100))


@query(f"""
    WITH {JOBS_SQL} SELECT job_id, attempts < 3 AND (status IN ('pending', 'failed', 'stale') OR (status = 'leased' AND lease_expires_ms <= {NOW_MS})) AS eligible,
           CASE WHEN NOT (status = 'leased' AND owner = 'w1' AND lease_expires_ms > {NOW_MS}) THEN 'lease_lost' WHEN job_id % 2 = 0 THEN 'indexed' ELSE 'failed' END AS reported FROM jobs
""")
def job01_lease(spark: SparkSession, d: str) -> DataFrame:
    rows, now = jobs(spark, d), F.lit(NOW_MS)
    reports = rows.select("job_id", F.lit("w1").alias("owner"), (F.col("job_id") % 2 == 0).alias("ok"))
    return rows.select("job_id", state.eligible(now).alias("eligible")).join(state.finish(rows, reports, now).withColumnRenamed("status", "reported"), "job_id")


@query(f"WITH {JOBS_SQL} SELECT job_id, CASE WHEN status = 'indexed' AND profile <> 'p1' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'indexed' AND profile <> 'p1' THEN 0 ELSE attempts END AS attempts, status = 'indexed' AND profile <> 'p1' AS requeued FROM jobs")
def job02_requeue(spark: SparkSession, d: str) -> DataFrame:
    return state.requeue(jobs(spark, d), F.lit("p1")).select("job_id", "status", "attempts", "requeued")


@query("""
    WITH c AS (SELECT c_custkey AS key, c_custkey % 4 AS now, c_custkey % 3 AS expected, c_custkey % 3 + 1 AS next FROM customer)
    SELECT key, CASE WHEN now = next THEN 'repeated' WHEN now = expected THEN 'advanced' ELSE 'conflict' END AS state, CAST(CASE WHEN now <> next AND now = expected THEN next ELSE now END AS BIGINT) AS cursor FROM c
""")
def job04_swap_cursor(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return state.swap_cursor(c.where("key % 4 <> 0").withColumn("cursor", F.col("key") % 4), c.select("key", (F.col("key") % 3).alias("expected"), (F.col("key") % 3 + 1).alias("next")))


@query("""
    WITH f AS (SELECT s_suppkey, s_suppkey % 20 AS events, md5(s_name) AS digest FROM supplier), i AS (SELECT s_suppkey, s_suppkey % 25 AS cursor, CASE WHEN s_suppkey % 2 = 0 THEN md5(s_name) ELSE '' END AS digest FROM supplier WHERE s_suppkey % 3 <> 0)
    SELECT f.s_suppkey AS source, CASE WHEN cursor IS NULL THEN 'new' WHEN events < cursor THEN 'invalid' WHEN f.digest = i.digest THEN 'already_imported' ELSE 'incremental' END AS state FROM f LEFT JOIN i USING (s_suppkey)
""")
def src15_source_states(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("source", F.col("s_suppkey")).withColumn("m", F.md5(F.encode("s_name", "UTF-8")))
    found = s.select("source", F.col("m").alias("digest"), (F.col("source") % 20).alias("events"))
    return state.source_states(found, s.where("source % 3 <> 0").select("source", F.when(F.col("source") % 2 == 0, F.col("m")).otherwise("").alias("digest"), (F.col("source") % 25).alias("cursor")))


@query(f"""
    WITH {JOBS_SQL}, s AS (SELECT customer, count(*) FILTER (WHERE status = 'indexed') AS done, count(*) FILTER (WHERE status = 'leased') AS failed, count(*) FILTER (WHERE status = 'pending') AS skipped FROM jobs GROUP BY ALL)
    SELECT *, CASE WHEN done > 0 AND failed > 0 THEN 'partial' WHEN failed > 0 THEN 'failed' WHEN done > 0 THEN 'complete' ELSE 'noop' END AS outcome FROM s
""")
def agg24_onboarding(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs(spark, d).withColumn("state", F.when(F.col("status") == "indexed", "done").when(F.col("status") == "leased", "failed").otherwise("skipped"))
    return state.onboarding_outcome(rows, ["customer"])


@query("""
    WITH c AS (SELECT c_nationkey AS ordinal, bool_and(c_acctbal > -500) AS ok, 'fix nation ' || c_nationkey AS remediation FROM customer GROUP BY ALL)
    SELECT CASE WHEN bool_or(NOT ok) THEN 'degraded' ELSE 'healthy' END AS status, count(*) FILTER (WHERE NOT ok) AS failing, min_by(remediation, ordinal) FILTER (WHERE NOT ok) AS remediation FROM c
""")
def agg19_health(spark: SparkSession, d: str) -> DataFrame:
    checks = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("ordinal")).agg(F.bool_and(F.col("c_acctbal") > -500).alias("ok"))
    return state.health(checks.withColumn("remediation", F.concat(F.lit("fix nation "), "ordinal")))


@query("""SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS failed, max(event_id) FILTER (WHERE event_type = 'purchase') AS latest_retry FROM events GROUP BY user_id""")
def agg20_receipts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("receipt_id"), F.col("ts").alias("at_ms"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "retry").otherwise("ok").alias("outcome"))
    return state.receipts(rows, ["user_id"])


@query("""SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(md5(l_partkey || ':' || l_suppkey)))), ',') AS fingerprints FROM lineitem GROUP BY l_orderkey""")
def agg21_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    one = F.md5(F.encode(F.concat_ws(":", "l_partkey", "l_suppkey"), "UTF-8"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(one)), ",").alias("fingerprints"))


@query(f"""
    WITH {PREFERENCES_SQL}, twice AS (SELECT person_id, subject_key FROM force GROUP BY ALL HAVING count(*) > 1), m AS (SELECT memory_id, status, subject_key FROM pre WHERE memory_id % 6 <> 0)
    SELECT promotion_id, 'owner_mismatch' AS issue FROM pro WHERE person_id = 10
    UNION ALL SELECT promotion_id, 'broken_replacement' FROM pro WHERE replaces IS NOT NULL AND replaces NOT IN (SELECT promotion_id FROM pro)
    UNION ALL SELECT promotion_id, 'duplicate_subject' FROM force JOIN twice USING (person_id, subject_key)
    UNION ALL SELECT promotion_id, CASE WHEN m.status IS NULL THEN 'missing_memory' WHEN m.status <> 'active' THEN 'superseded_memory' ELSE 'subject_mismatch' END FROM pro LEFT JOIN m USING (memory_id) WHERE m.status IS NULL OR m.status <> 'active' OR m.subject_key <> pro.subject_key
""")
def agg25_library_issues(spark: SparkSession, d: str) -> DataFrame:
    people = spark.range(10).withColumnRenamed("id", "person_id")
    return state.library_issues(promotions(spark, d), people, preferences(spark, d).where("memory_id % 6 <> 0"))


@query(f"""
    WITH {MEMORIES_SQL} SELECT memory_id, repo_key, memory_type, sha256(content) AS content_sha256 FROM mem
""")
def snk01_immutable_write(spark: SparkSession, d: str) -> DataFrame:
    """Writes half of the memories, then all of them: the second write adds the other half alone."""
    rows = memories(spark, d).select("memory_id", "repo_key", "memory_type", F.sha2("content", 256).alias("content_sha256"), "doc_id")
    path = f"{shared_folder(spark)}/memories-{uuid.uuid4().hex}"
    lake.write_immutable(rows.where("doc_id % 2 = 0").drop("doc_id"), path)
    lake.write_immutable(rows.drop("doc_id"), path)
    return spark.read.parquet(path).select("memory_id", "repo_key", "memory_type", "content_sha256")


@query("""
    SELECT doc_id, lang AS repo_key, sha256(CASE WHEN lang = 'en' THEN text || '2' ELSE text END) AS content_sha256 FROM documents WHERE lang <> 'en' OR doc_id % 3 <> 0
""")
def snk03_replace_partition(spark: SparkSession, d: str) -> DataFrame:
    """Writes an index by repository, then replaces one repository's partition by fewer, other rows."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("repo_key"), "text")
    lake.replace_partitions(docs.select("doc_id", "repo_key", F.sha2("text", 256).alias("content_sha256")), path)
    lake.replace_partitions(docs.where("repo_key = 'en' and doc_id % 3 <> 0").select("doc_id", "repo_key", F.sha2(F.concat("text", F.lit("2")), 256).alias("content_sha256")), path)
    return spark.read.parquet(path)


@query("""
    WITH c AS (SELECT memory_id, doc FROM (SELECT c_custkey AS memory_id, c_name AS doc FROM customer) WHERE memory_id NOT IN (SELECT s_suppkey FROM supplier)), n AS (SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name || '2' FROM supplier)
    SELECT * FROM c UNION ALL SELECT * FROM n
""")
def snk02_upsert(spark: SparkSession, d: str) -> DataFrame:
    current = table(spark, d, "customer").select(F.col("c_custkey").alias("memory_id"), F.col("c_name").alias("doc"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("memory_id"), F.col("s_name").alias("doc"))
    return lake.upserted(current, s.unionByName(s.withColumn("doc", F.concat("doc", F.lit("2")))))


@query(f"""
    WITH {PREFERENCES_SQL} SELECT count(*) AS memories, count(promotion_id) AS referenced, count(promotion_id) > 0 AS blocked FROM pre LEFT JOIN pro USING (memory_id) WHERE pre.subject_key = 3
""")
def snk05_reset_preview(spark: SparkSession, d: str) -> DataFrame:
    return lake.reset_preview(preferences(spark, d).withColumn("repo_key", F.col("subject_key").cast("string")), promotions(spark, d), "3")


@query("""
    WITH f AS (SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, url AS path, page_id % 17 AS modified FROM pages),
    t AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY modified DESC, path) AS turn FROM f), k AS (SELECT folder FROM f GROUP BY folder ORDER BY max(modified) DESC, folder LIMIT 1024)
    SELECT path, CAST(turn AS INTEGER) AS turn, modified, (SELECT count(*) FROM f) AS all_files FROM t SEMI JOIN k USING (folder) WHERE turn <= 16 ORDER BY turn, modified DESC, path LIMIT 64
""")
def src09_discovery(spark: SparkSession, d: str) -> DataFrame:
    from tracelode.sources.transcripts import discover

    files = table(spark, d, "pages").select(F.col("url").alias("path"), (F.col("page_id") % 17).alias("modified"))
    return discover(files, most=64).select("path", "turn", "modified", "all_files")


@query("""
    WITH m AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS episode FROM conversations),
    s AS (SELECT conv_id, episode, min(turn) AS start_index, max(turn) + 1 AS last, count(*) AS n_events FROM m WHERE episode > 0 GROUP BY ALL)
    SELECT CAST(conv_id AS VARCHAR) AS session_id, start_index, coalesce(lead(start_index) OVER (PARTITION BY conv_id ORDER BY episode), last) AS end_index,
           CASE WHEN lead(start_index) OVER (PARTITION BY conv_id ORDER BY episode) IS NULL THEN 'manual_finalize' ELSE 'next_user' END AS boundary_kind, n_events FROM s
""")
def str01_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Replays conversations as a stream of files, one micro-batch after another, and then closes every session."""
    rows = stored(stream_messages(spark, d), "messages")
    last = closing(rows.groupBy("session_id").agg((F.max("event_index") + 1).alias("event_index")), "manual_finalize")
    found = streamed(spark, [rows.where("event_index < 3"), rows.where("event_index >= 2").unionByName(last)])  # turn 2 comes twice
    return found.select("session_id", "start_index", "end_index", "boundary_kind", "n_events")


def stream_messages(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select(F.col("session_id").cast("string").alias("session_id"), "event_index", "kind", "role", "text", "event_sha256")


def closing(at: DataFrame, boundary: str) -> DataFrame:
    """Control rows that close sessions before an index, from (session_id, event_index)."""
    empty = F.lit("")
    return at.select("session_id", "event_index", F.lit(CONTROL).alias("kind"), F.lit(boundary).alias("role"), empty.alias("text"), empty.alias("event_sha256"))


def streamed(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    """Episodes of a stream to which the parts are added one after another, each read by a run of its own."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        events = spark.readStream.schema(EVENT_SCHEMA).parquet(f"{folder}/in")
        start_table(close_episodes(events), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(CLOSED).parquet(f"{folder}/out")


@query(f"""
    WITH {EVENTS_SQL},
    p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_index) - 1 AS place FROM ev),
    u AS (SELECT session_id, place AS start_index, lead(place) OVER (PARTITION BY session_id ORDER BY place) AS following FROM p WHERE kind = 'message' AND role = 'user'),
    n AS (SELECT session_id, max(place) + 1 AS n FROM p GROUP BY ALL),
    e AS (SELECT session_id, start_index, coalesce(following, n) AS end_index, CASE WHEN following IS NULL THEN 'session_end' ELSE 'next_user' END AS boundary_kind FROM u JOIN n USING (session_id)),
    c AS (SELECT e.session_id, e.end_index, p.call_id, max_by(p.kind, p.place) AS last FROM e JOIN p ON p.session_id = e.session_id AND p.place < e.end_index AND p.call_id IS NOT NULL AND p.kind IN ('tool_call', 'tool_result') GROUP BY ALL),
    w AS (SELECT session_id, end_index, string_agg(call_id, ',' ORDER BY call_id) AS pending FROM c WHERE last = 'tool_call' GROUP BY ALL)
    SELECT CAST(e.session_id AS VARCHAR) AS session_id, e.start_index, e.end_index, boundary_kind, e.end_index - e.start_index AS n_events, coalesce(pending, '') AS pending FROM e LEFT JOIN w ON e.session_id = w.session_id AND e.end_index = w.end_index
""")
def str02_pending_calls(spark: SparkSession, d: str) -> DataFrame:
    """Tool sessions in two parts, the later one first: its rows wait in the state until the gap before them is filled."""
    rows = tool_events(spark, d)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("event_index")) - 1
    rows = rows.select(F.col("session_id").cast("string").alias("session_id"), place.cast("long").alias("event_index"), "kind", "role", "text", "event_sha256", "tool_name", "call_id", "tool_status", "exit_code")
    rows = stored(rows, "events")
    ends = rows.groupBy("session_id").agg((F.max("event_index") + 1).alias("event_index"))
    half = rows.join(ends.select("session_id", F.floor(F.col("event_index") / 2).alias("half")), "session_id")
    later, first = (half.where(c).drop("half") for c in ("event_index >= half", "event_index < half"))
    found = streamed(spark, [later.unionByName(closing(ends, "session_end"), allowMissingColumns=True), first])
    return found.select("session_id", "start_index", "end_index", "boundary_kind", "n_events", F.array_join(F.array_sort("pending_calls"), ",").alias("pending"))


@query("""
    WITH m AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, coalesce(text, '') <> '' AS says, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    h AS (SELECT *, (n + 1) // 2 AS half FROM m),
    u AS (SELECT session_id, turn AS start_index, FALSE AS late FROM h WHERE role = 'user'),
    b AS (SELECT session_id, min(turn) FILTER (WHERE turn >= half AND (role = 'user' OR says)) AS first_signal, min(half) AS half, min(n) AS n, min(turn) FILTER (WHERE role = 'user') AS opened FROM h GROUP BY ALL),
    s AS (SELECT * FROM u UNION ALL SELECT session_id, first_signal, TRUE FROM b WHERE opened < half AND first_signal IS NOT NULL AND NOT EXISTS (SELECT 1 FROM u WHERE u.session_id = b.session_id AND u.start_index = b.first_signal)),
    o AS (SELECT *, lead(start_index) OVER w AS following, lag(start_index) OVER w AS before FROM s WINDOW w AS (PARTITION BY session_id ORDER BY start_index))
    SELECT session_id, start_index, CASE WHEN start_index < half THEN least(half, coalesce(following, n)) ELSE coalesce(following, n) END AS end_index,
           CASE WHEN start_index < half AND half <= coalesce(following, n) THEN 'turn_end' WHEN following IS NULL THEN 'session_end' ELSE 'next_user' END AS boundary_kind, CASE WHEN late THEN before END AS continues_from
    FROM o JOIN b USING (session_id)
""")
def str04_late_events(spark: SparkSession, d: str) -> DataFrame:
    """Sessions closed after their first half; what comes later continues the closed episode and never rewrites it."""
    rows = stored(stream_messages(spark, d), "messages")
    ends = rows.groupBy("session_id").agg(F.count("*").alias("n"))
    half = F.floor((F.col("n") + 1) / 2)
    cut = stored(rows.join(ends, "session_id").withColumn("half", half), "halves")
    first, later = (cut.where(c).drop("n", "half") for c in ("event_index < half", "event_index >= half"))
    parts = [first.unionByName(closing(ends.select("session_id", half.alias("event_index")), "turn_end")), later.unionByName(closing(ends.select("session_id", F.col("n").alias("event_index")), "session_end"))]
    return streamed(spark, parts).select("session_id", "start_index", "end_index", "boundary_kind", "continues_from")


@query("""
    WITH m AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS episode FROM conversations),
    s AS (SELECT conv_id, episode, min(turn) AS start_index, max(turn) + 1 AS last, count(*) AS n_events FROM m WHERE episode > 0 GROUP BY ALL)
    SELECT CAST(conv_id AS VARCHAR) AS session_id, start_index, coalesce(lead(start_index) OVER (PARTITION BY conv_id ORDER BY episode), last) AS end_index, n_events, CAST(1 AS BIGINT) AS times FROM s
""")
def str05_delivered_often(spark: SparkSession, d: str) -> DataFrame:
    """Every row a hundred times in one delivery, and the whole delivery twice: each episode is closed once."""
    rows = stream_messages(spark, d)
    last = closing(rows.groupBy("session_id").agg((F.max("event_index") + 1).alias("event_index")), "manual_finalize")
    many = stored(rows.unionByName(last).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(100)))).drop("copy"), "many")
    found = streamed(spark, [many, many])
    return found.groupBy("session_id", "start_index", "end_index", "n_events").agg(F.count("*").alias("times"))


@query("""
    WITH s AS (SELECT s_nationkey AS repo, s_suppkey AS source, s_suppkey % 3 = 0 AS done, s_suppkey % 6 = 1 AS changes FROM supplier),
    r AS (SELECT c_custkey AS request, c_nationkey AS repo, c_custkey % 10 AS kind, c_custkey % 4 = 0 AS takes_all FROM customer),
    ch AS (SELECT request, source, changes, done FROM r JOIN s USING (repo) WHERE takes_all AND NOT done UNION ALL SELECT request, source, changes, done FROM r JOIN s USING (repo) WHERE NOT takes_all AND source % 5 = request % 5),
    g AS (SELECT request, count(*) AS n, bool_or(changes) AS changes, count(*) FILTER (WHERE NOT done) AS todo FROM ch GROUP BY ALL),
    p AS (SELECT r.*, coalesce(n, 0) AS n, coalesce(g.changes, FALSE) AS changes, coalesce(todo, 0) AS todo, NOT takes_all AND (kind = 3 OR kind = 7 AND coalesce(n, 0) > 0) AS wrong FROM r LEFT JOIN g USING (request)),
    q AS (SELECT *, CASE WHEN wrong THEN 'invalid_selection' WHEN n = 0 THEN 'nothing_selected' ELSE 'ready' END AS state FROM p)
    SELECT request AS request_id, state, CASE WHEN state <> 'ready' OR kind = 9 THEN 'unknown_consent' WHEN kind = 1 THEN 'consent_expired' WHEN changes THEN 'snapshot_stale' WHEN todo = 0 THEN 'noop' ELSE 'applied' END AS outcome,
           CASE WHEN state = 'ready' AND kind NOT IN (1, 9) AND NOT changes THEN todo ELSE 0 END AS to_import FROM q
""")
def job06_onboarding(spark: SparkSession, d: str) -> DataFrame:
    """Customers ask to import suppliers of their nation: selections, consents that expire or name another snapshot, and sources that change before they are given."""
    sources = table(spark, d, "supplier").select(F.col("s_nationkey").alias("repo_key"), F.col("s_suppkey").alias("source_id"), F.md5(F.encode("s_name", "UTF-8")).alias("fingerprint"), F.when(F.col("s_suppkey") % 3 == 0, "already_imported").otherwise("new").alias("import_state"))
    asks = table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_nationkey").alias("repo_key"))
    five = stored(sources.withColumn("five", F.col("source_id") % 5).groupBy("repo_key", "five").agg(F.array_sort(F.collect_list("source_id")).alias("some")), "fifths")
    kind = F.col("request_id") % 10
    asks = asks.withColumn("five", F.col("request_id") % 5).join(five, ["repo_key", "five"], "left").withColumn("some", F.coalesce("some", F.array().cast("array<bigint>")))
    named = F.when(kind == 3, F.array_append("some", F.lit(-1).cast("long"))).when((kind == 7) & (F.size("some") > 0), F.concat("some", F.slice("some", 1, 1))).otherwise(F.col("some"))
    # Lists of each request are made where they are read, not written.
    requests = asks.select("request_id", "repo_key", F.when(F.col("request_id") % 4 != 0, named).alias("selected"), (F.col("request_id") * 1000).alias("at_ms"))
    previews = state.onboarding_preview(requests, sources, 500)
    consents = previews.select("request_id", F.when(kind == 9, "another").otherwise(F.coalesce("snapshot_id", F.lit("none"))).alias("snapshot_id"), (F.col("expires_ms") + F.when(kind == 1, 1).otherwise(0)).alias("at_ms"))
    later = sources.withColumn("fingerprint", F.when(F.col("source_id") % 6 == 1, F.md5(F.encode("fingerprint", "UTF-8"))).otherwise(F.col("fingerprint")))
    found = state.onboarding_apply(consents, previews, later)
    return previews.select("request_id", "state").join(found, "request_id").select("request_id", "state", "outcome", F.size("to_import").cast("long").alias("to_import"))
