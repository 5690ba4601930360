"""Queries of the import path: the provided events as transcripts of each provider, read back by its normalizer."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions.arrow import prefixes_at
from tracelode.functions.tables import shared_folder, stored
from tracelode.plans.adapters import TRANSCRIPTS_SQL, transcripts_of
from tracelode.plans.registry import query
from tracelode.sources import line_source, transcripts


def imported(spark: SparkSession, d: str, provider: str) -> DataFrame:
    events = transcripts.NORMALIZERS[provider](transcripts.raw_lines(transcripts_of(spark, d, provider)))
    change = F.try_element_at("file_changes", F.lit(1))
    return events.select(
        "session_id", "event_index", "block", "kind", "role", "text", "tool_name", "call_id", "command", "exit_code", "tool_status", "is_command_result", "observed_outcome",
        change["operation"].alias("operation"), change["path"].alias("path"))


@query(f"""
    WITH {TRANSCRIPTS_SQL}
    SELECT 'sA-' || user_id AS session_id, event_index, 0 AS block, CASE event_type WHEN 'signup' THEN 'message' WHEN 'click' THEN 'tool_call' WHEN 'view' THEN 'metadata' ELSE 'tool_result' END AS kind,
           CASE WHEN event_type = 'signup' THEN 'user' END AS role, CASE WHEN event_type = 'signup' THEN props || chr(10) || 'end' WHEN result THEN 'Process exited with code ' || code || chr(10) || 'Final output:' || chr(10) || props END AS text,
           CASE WHEN event_type = 'click' THEN CASE WHEN k % 2 = 0 THEN 'exec_command' ELSE 'lookup' END END AS tool_name, CASE WHEN event_type = 'click' OR result THEN call END AS call_id,
           CASE WHEN k % 2 = 0 AND (event_type = 'click' OR result AND called) THEN command END AS command, CASE WHEN k % 2 = 0 AND result AND called THEN code END AS exit_code,
           CAST(NULL AS VARCHAR) AS tool_status, result AND called AND k % 2 = 0 AS is_command_result, CAST(NULL AS VARCHAR) AS observed_outcome, CAST(NULL AS VARCHAR) AS operation, CAST(NULL AS VARCHAR) AS path
    FROM cb
    UNION ALL SELECT DISTINCT 'sA-' || user_id, 0, 0, 'metadata', NULL, NULL, NULL, NULL, NULL, CAST(NULL AS INTEGER), NULL, FALSE, NULL, NULL, NULL FROM events
""")
def src06_provider_a(spark: SparkSession, d: str) -> DataFrame:
    """Records of envelopes: texts, calls with their commands, results with the codes of their outputs (trc02, trc03, trc04, trc06)."""
    return imported(spark, d, "A")


@query(f"""
    WITH {TRANSCRIPTS_SQL},
    b AS (SELECT *, unnest(CASE WHEN event_type = 'click' THEN [0, 1] ELSE [0] END) AS block FROM ca),
    t AS (SELECT *, CASE WHEN event_type = 'signup' OR event_type = 'click' AND block = 0 THEN 'message' WHEN event_type = 'click' THEN 'tool_call' WHEN result THEN 'tool_result' ELSE 'metadata' END AS kind FROM b)
    SELECT 'sB-' || user_id AS session_id, event_index, block, kind, CASE WHEN kind = 'message' THEN CASE WHEN event_type = 'click' THEN 'assistant' ELSE 'user' END END AS role,
           CASE WHEN event_type = 'signup' THEN props WHEN kind = 'message' THEN 'next' WHEN kind = 'tool_result' THEN 'done' END AS text,
           CASE WHEN kind = 'tool_call' THEN CASE WHEN k % 2 = 0 THEN 'Bash' WHEN k % 4 = 1 THEN 'Edit' ELSE 'Lookup' END END AS tool_name, CASE WHEN kind IN ('tool_call', 'tool_result') THEN call END AS call_id,
           CASE WHEN k % 2 = 0 AND (kind = 'tool_call' OR kind = 'tool_result' AND called) THEN command END AS command, CASE WHEN k % 2 = 0 AND kind = 'tool_result' AND called THEN code END AS exit_code,
           CASE WHEN kind = 'tool_result' THEN CASE WHEN code = 0 THEN 'success' ELSE 'error' END END AS tool_status, kind = 'tool_result' AND called AND k % 2 = 0 AS is_command_result, CAST(NULL AS VARCHAR) AS observed_outcome,
           CASE WHEN kind = 'tool_result' AND called AND k % 4 = 1 AND code = 0 THEN 'update' END AS operation, CASE WHEN kind = 'tool_result' AND called AND k % 4 = 1 AND code = 0 THEN 'src/m' || k || '.py' END AS path
    FROM t
    UNION ALL SELECT DISTINCT 'sB-' || user_id, 0, 0, 'metadata', NULL, NULL, NULL, NULL, NULL, CAST(NULL AS INTEGER), NULL, FALSE, NULL, NULL, NULL FROM events
""")
def src07_provider_b(spark: SparkSession, d: str) -> DataFrame:
    """Records of content blocks: an event for each block, changes of files by edits that didn't fail (trc07, trc10)."""
    return imported(spark, d, "B")


@query(f"""
    WITH {TRANSCRIPTS_SQL},
    b AS (SELECT *, unnest(CASE WHEN result THEN [0, 1, 2] ELSE [0] END) AS block FROM ca)
    SELECT 'sC-' || user_id AS session_id, event_index, block, ['message', 'tool_call', 'tool_result'][block + 1] AS kind, CASE WHEN block = 0 THEN 'user' END AS role,
           CASE block WHEN 0 THEN event_type WHEN 2 THEN 'done' END AS text, CASE WHEN block = 1 THEN 'shell' END AS tool_name, CASE WHEN block > 0 THEN call END AS call_id, CASE WHEN block > 0 THEN command END AS command,
           CASE WHEN block = 2 AND k % 2 = 0 THEN code END AS exit_code, CASE WHEN block = 2 THEN CASE WHEN code = 0 THEN 'completed' ELSE 'error' END END AS tool_status, block = 2 AND k % 2 = 0 AS is_command_result,
           CASE WHEN block = 2 THEN CASE WHEN code = 0 THEN 'success' ELSE 'failure' END END AS observed_outcome,
           CASE WHEN block = 2 AND k % 2 = 0 THEN 'update' END AS operation, CASE WHEN block = 2 AND k % 2 = 0 THEN 'src/m' || k || '.py' END AS path FROM b
""")
def src08_provider_c(spark: SparkSession, d: str) -> DataFrame:
    """Batches that start with a user message; outcomes as observed (trc11)."""
    return imported(spark, d, "C")


@query("""
    SELECT '/work/s' || p || '-' || user_id || '.jsonl' AS source_path, p AS provider, 's' || p || '-' || user_id AS session_id, count(*) + 1 AS records
    FROM events, (SELECT unnest(['A', 'B', 'C']) AS p) GROUP BY user_id, p
""")
def src05_providers(spark: SparkSession, d: str) -> DataFrame:
    """Each transcript's provider and session, told by its records (trc03)."""
    files = [transcripts_of(spark, d, p) for p in "ABC"]
    return transcripts.sources(transcripts.raw_lines(files[0].union(files[1]).union(files[2])))


@query("""
    WITH s AS (SELECT user_id, count(*) + 1 AS n FROM events GROUP BY user_id)
    SELECT '/work/sA-' || user_id || '.jsonl' AS source_path, CASE WHEN n > 60 THEN 1 ELSE n END AS records, CASE WHEN n > 60 THEN 'too_many_events' END AS violation FROM s
""")
def src02_limits(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of more than 60 records are one row with a violation."""
    lines = transcripts.raw_lines(transcripts_of(spark, d, "A"), most_events=60)
    return lines.groupBy("source_path", "violation").agg(F.count("*").alias("records"))


@query("""
    WITH s AS (SELECT user_id, count(*) + 1 AS n FROM events GROUP BY user_id)
    SELECT '/work/sA-' || user_id || '.jsonl' AS source_path, CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN n WHEN 2 THEN n + 3 ELSE n // 2 END AS cursor, n AS events,
           ['new', 'already_imported', 'truncated', 'source_rewritten', 'incremental'][user_id % 5 + 1] AS state FROM s
""")
def src03_resume(spark: SparkSession, d: str) -> DataFrame:
    """What became of each source's committed prefix: by the user's number none, whole, longer than the source, changed or a half (src04)."""
    lines = transcripts.raw_lines(transcripts_of(spark, d, "A"))
    turn = F.regexp_extract("key", r"(\d+)\.jsonl$", 1).cast("int") % 5
    records = lines.select(F.col("source_path").alias("key"), F.col("event_index").alias("place"), F.col("event_sha256").alias("digest"))
    n = F.count("*")
    ends = records.groupBy("key").agg(n.alias("n")).where(turn > 0).select("key", F.when(turn == 1, F.col("n")).when(turn == 2, F.col("n") + 3).otherwise(F.floor(F.col("n") / 2)).alias("place"))
    at = prefixes_at(records, ends).select(F.col("key").alias("source_path"), F.col("place").alias("cursor"), F.when(turn == 3, F.sha2("prefix_sha256", 256)).otherwise(F.col("prefix_sha256")).alias("prefix_sha256"))
    return transcripts.resume_suffix(lines, at)


def _folder_of_files(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """A new folder, and provider A's transcripts as (source_path in it, turn: the user's number modulo 5, lines)."""
    folder = f"{shared_folder(spark)}/transcripts-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder}"
    name = F.regexp_extract("source_path", r"([^/]+)$", 1)
    turn = F.regexp_extract("source_path", r"(\d+)\.jsonl$", 1).cast("int") % 5
    lines = F.split(F.decode("content", "UTF-8"), "\n")
    return folder, transcripts_of(spark, d, "A").select(F.concat(F.lit(folder + "/"), name).alias("source_path"), turn.alias("turn"), lines.alias("lines"))


def _first(n: Column) -> Column:
    """The first n lines of each file, each with its end, as bytes."""
    return F.encode(F.concat(F.array_join(F.slice("lines", F.lit(1), n), "\n"), F.lit("\n")), "UTF-8").alias("content")


@query("""
    WITH s AS (SELECT user_id, count(*) + 1 AS n, user_id % 5 AS turn FROM events GROUP BY user_id),
    c AS (SELECT *, CASE turn WHEN 0 THEN 0 WHEN 1 THEN n WHEN 2 THEN n ELSE n // 2 END AS cursor, CASE turn WHEN 2 THEN n - 1 ELSE n END AS now FROM s)
    SELECT 'sA-' || user_id || '.jsonl' AS source, turn AS turn, cursor, CASE WHEN turn = 2 THEN 'truncated' END AS violation, CASE WHEN turn = 2 THEN 0 ELSE now - cursor END AS read,
           CASE WHEN turn <> 2 AND now > cursor THEN cursor END AS first_read, turn <> 2 AS all_but_prefix
    FROM c
""")
def src03_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts as files that grow: cursors after a first import, then what follows them alone is read. By the user's number a source is new, unchanged, shorter or twice as long.

    all_but_prefix: the bytes read and those before the cursor are the whole file.
    """
    folder, files = _folder_of_files(spark, d)
    files = stored(files.withColumn("n", F.size("lines")), "files")
    half = F.when(F.col("turn") >= 3, F.floor(F.col("n") / 2).cast("int")).otherwise(F.col("n"))
    line_source.write_files(files.where("turn > 0").select("source_path", _first(half)))
    zero = F.lit(0).cast("long")
    start = files.select("source_path", zero.alias("byte"), zero.alias("event_index"), F.lit(None).cast("string").alias("prefix_sha256"))
    known = stored(line_source.next_cursors(line_source.read_suffixes(start.join(files.where("turn > 0"), "source_path", "left_semi"))), "cursors")
    line_source.write_files(files.where("turn <> 1").select("source_path", _first(F.when(F.col("turn") == 2, F.col("n") - 1).otherwise(F.col("n")))))
    cursors = stored(known.unionByName(start.join(known, "source_path", "left_anti")), "cursors")
    found = stored(line_source.read_suffixes(cursors), "suffixes").groupBy("source_path").agg(
        F.max("violation").alias("violation"), F.count("line").alias("read"), F.min(F.when(F.col("line").isNotNull(), F.col("event_index"))).alias("first_read"), F.sum(F.col("stop") - F.col("start")).alias("bytes"))
    whole = line_source.scan(spark, folder).groupBy("source_path").agg(F.max("stop").alias("size"))
    rows = cursors.join(files.select("source_path", "turn"), "source_path").join(whole, "source_path").join(found, "source_path", "left")
    return rows.select(
        F.regexp_extract("source_path", r"([^/]+)$", 1).alias("source"), F.col("turn").cast("long").alias("turn"), F.col("event_index").alias("cursor"), "violation", F.coalesce("read", zero).alias("read"), "first_read",
        (F.col("byte") + F.coalesce("bytes", zero) == F.col("size")).alias("all_but_prefix"))


@query("""
    WITH s AS (SELECT user_id, count(*) + 1 AS n FROM events GROUP BY user_id)
    SELECT 'sA-' || user_id || '.jsonl' AS source, n AS lines, n AS distinct_starts FROM s
""")
def src03_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same files followed by a stream while they grow in two steps: each line comes once, in whatever batch."""
    folder, files = _folder_of_files(spark, d)
    files = stored(files.withColumn("n", F.size("lines")), "files")
    for part in (2, 1):
        line_source.write_files(files.select("source_path", _first(F.ceil(F.col("n") / part).cast("int"))))
        lines = line_source.appended(spark, folder).writeStream.format("parquet").option("path", f"{folder}-out").option("checkpointLocation", f"{folder}-checkpoint")
        lines.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{folder}-out").groupBy("source_path").agg(F.count("*").alias("lines"), F.countDistinct("start").alias("distinct_starts"))
    return found.select(F.regexp_extract("source_path", r"([^/]+)$", 1).alias("source"), "lines", "distinct_starts")


@query("""
    SELECT '/work/s' || p || '-' || user_id || '.jsonl' AS source_path, user_id % 3 = user_id % 2 AS matches
    FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(['A', 'B']) AS p)
""")
def src10_repository(spark: SparkSession, d: str) -> DataFrame:
    """Whether each transcript's working folders lie in the repository that its user's number asks for."""
    lines = transcripts.raw_lines(transcripts_of(spark, d, "A").union(transcripts_of(spark, d, "B")))
    user = F.regexp_extract("source_path", r"(\d+)\.jsonl$", 1).cast("int")
    roots = lines.select("source_path").distinct().select("source_path", F.concat(F.lit("/repo"), user % 2).alias("root"))
    return transcripts.one_repository(transcripts.working_folders(lines), roots)


@query(f"""
    WITH {TRANSCRIPTS_SQL}, c AS (SELECT user_id, count(*) AS changes FROM ca WHERE result AND called AND k % 4 = 1 AND code = 0 GROUP BY user_id)
    SELECT '/work/sB-' || user_id || '.jsonl' AS source_path, changes, 'too_many_file_changes' AS violation FROM c WHERE changes > 2
""")
def trc09_change_limit(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that change more than two files."""
    return transcripts.change_violations(transcripts.provider_b(transcripts.raw_lines(transcripts_of(spark, d, "B"))), 2)
