"""Queries of the Markdown truth: given tables as files with planted faults, scanned back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.plans.adapters import MEMORIES_SQL, ORDERS_SQL, memories, order_edges, table
from tracelode.plans.registry import query
from tracelode.sources import truth


def spoiled(files: DataFrame, key: Column, line: str, every: int) -> DataFrame:
    """Files (path, value) of which those with 1 to 9 as the remainder of their key have a fault each; line: a key of the front matter whose value is a string."""
    v, n = F.col("value"), key % every
    at = lambda new: F.replace(v, F.lit(f"\n{line}: \""), F.lit(new))
    value = (
        F.when(n == 1, F.concat(F.lit(" "), v)).when(n == 2, at(f"\n{line}: ")).when(n == 3, at(f"\nx{line}: \"")).when(n == 5, F.replace(v, F.lit("\nrecord_kind: \""), F.lit("\nrecord_kind: \"x")))
        .when(n == 6, F.replace(v, F.lit("\n---\n"), F.lit("\n--\n"))).when(n == 7, at(f"\nno mark\n{line}: \"")).when(n == 8, F.lit("")).when(n == 9, F.regexp_replace(v, "\nrepo_key: \"[^\n]*", "\nrepo_key: 7")).otherwise(v))
    path = F.when(n == 4, F.regexp_replace("path", "/[^/]+/", "/elsewhere/")).otherwise(F.col("path"))
    return files.select(path.alias("path"), value.alias("value"))


def issue_sql(n: str) -> str:
    return f"CASE {n} WHEN 1 THEN 'no_front_matter' WHEN 2 THEN 'not_json' WHEN 3 THEN 'not_canonical' WHEN 4 THEN 'not_at_its_path' WHEN 5 THEN 'not_canonical' WHEN 6 THEN 'unterminated' WHEN 7 THEN 'bad_line' WHEN 8 THEN 'empty_or_too_large' WHEN 9 THEN 'wrong_identity' END"


def read(rows: DataFrame, *fields: str) -> DataFrame:
    """A scan's rows with the given fields as text and the body's digest, where it is a record."""
    sound = F.col("state") == "record"
    return rows.select("path", "state", "issue", *(F.when(sound, truth.json_string(F.element_at("fields", f))).alias(f) for f in fields), F.when(sound, F.sha2("body", 256)).alias("body_sha256"))


@query(f"""
    WITH {MEMORIES_SQL},
    f AS (SELECT *, substr(sha256(lang), 1, 16) AS s, {issue_sql("doc_id % 23")} AS fault FROM mem WHERE doc_id % 31 <> 30),
    p AS (SELECT 'memory/' || CASE WHEN doc_id % 23 = 4 THEN 'elsewhere' ELSE s END || '/' || memory_type || '/' || memory_id || '.md' AS path, CASE WHEN doc_id % 29 = 28 AND fault IS NULL THEN 'duplicate_identity' ELSE fault END AS issue, category, title, content FROM f
          UNION ALL SELECT 'memory/' || s || '/copy/' || memory_id || '.md', CASE WHEN fault IS NULL THEN 'duplicate_identity' END, category, title, content FROM f WHERE doc_id % 29 = 28)
    SELECT path, CASE WHEN issue IS NULL THEN 'record' ELSE 'issue' END AS state, issue, CASE WHEN issue IS NULL THEN category END AS category, CASE WHEN issue IS NULL THEN title END AS title, CASE WHEN issue IS NULL THEN sha256(content) END AS body_sha256 FROM p
""")
def src12_memory_truth(spark: SparkSession, d: str) -> DataFrame:
    """Memories as files: faults of each kind, some ids twice under another type, and files of other folders and endings, which no scan lists."""
    rows = memories(spark, d).where("doc_id % 31 <> 30").withColumn("schema_version", F.lit(1))
    n = F.col("doc_id")
    files = spoiled(_numbered(rows, truth.MEMORY), n, "category", 23)
    copies = truth.render(rows.where(n % 29 == 28).withColumn("memory_type", F.lit("copy")), truth.MEMORY)
    others = truth.render(rows.where(n % 19 == 3), truth.MEMORY).select(F.explode(F.array(F.concat(F.lit("old/"), "path"), F.concat("path", F.lit(".swp")))).alias("path"), "value")
    return read(truth.scan(files.unionByName(copies).unionByName(others), truth.MEMORY), "category", "title")


@query(f"""
    WITH {ORDERS_SQL},
    f AS (SELECT *, 'evo_' || predecessor_id AS evolution_id, {issue_sql("predecessor_id % 41")} AS issue FROM oe)
    SELECT 'evolution/' || CASE WHEN predecessor_id % 41 = 4 THEN 'elsewhere' ELSE substr(sha256(repo_key), 1, 16) END || '/' || evolution_id || '.md' AS path, CASE WHEN issue IS NULL THEN 'record' ELSE 'issue' END AS state, issue,
           CASE WHEN issue IS NULL THEN CAST(predecessor_id AS VARCHAR) END AS predecessor_id, CASE WHEN issue IS NULL THEN CAST(successor_id AS VARCHAR) END AS successor_id, CASE WHEN issue IS NULL THEN sha256('because' || chr(10) || '---' || chr(10) || successor_id) END AS body_sha256
    FROM f
""")
def src13_evolution_truth(spark: SparkSession, d: str) -> DataFrame:
    """Edges between orders as evolution files, whose reasons hold the mark that ends the front matter."""
    rows = order_edges(spark, d).select(
        "repo_key", "created_at_ms", F.col("predecessor_id").alias("n"), F.concat(F.lit("evo_"), "predecessor_id").alias("evolution_id"), F.col("predecessor_id").cast("string").alias("predecessor_id"), F.col("successor_id").cast("string").alias("successor_id"),
        F.lit("refines").alias("relation_kind"), F.concat(F.lit("because\n---\n"), "successor_id").alias("reason"))
    return read(truth.scan(spoiled(_numbered(rows, truth.EVOLUTION), F.col("n"), "relation_kind", 41), truth.EVOLUTION), "predecessor_id", "successor_id")


def _numbered(rows: DataFrame, record: truth.Record) -> DataFrame:
    """Rendered files beside all columns of their rows."""
    return rows.select("*", *truth.rendered(rows.columns, record))


@query("""
    WITH s AS (SELECT s_suppkey AS k, 'promotion_' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS id, CASE s_suppkey % 17 WHEN 1 THEN 'no_front_matter' WHEN 2 THEN 'not_json' WHEN 3 THEN 'not_canonical' WHEN 4 THEN 'not_at_its_path' WHEN 5 THEN 'not_canonical' WHEN 6 THEN 'unterminated' WHEN 7 THEN 'bad_line' WHEN 8 THEN 'empty_or_too_large' END AS issue FROM supplier),
    p AS (SELECT 'global-preferences/' || CASE WHEN k % 17 = 4 THEN 'promotion_of_' || k ELSE id END || '.md' AS path, issue, k FROM s
          UNION ALL SELECT 'global-preferences/notes-' || k || '.md', 'unexpected_entry', k FROM s WHERE k % 13 = 2
          UNION ALL SELECT 'global-preferences/.' || id || '.md.tmp', 'stage', k FROM s WHERE k % 11 = 5)
    SELECT path, CASE WHEN issue IS NULL THEN 'record' WHEN issue = 'stage' THEN 'stage' ELSE 'issue' END AS state, nullif(issue, 'stage') AS issue, CASE WHEN issue IS NULL THEN 'person_0' END AS person_id, CASE WHEN issue IS NULL THEN sha256('Use ' || k || ' everywhere.') END AS body_sha256 FROM p
    UNION ALL SELECT 'person.md', 'record', NULL, 'person_0', sha256('One person.')
    UNION ALL SELECT 'library', CASE WHEN count(issue) FILTER (WHERE issue <> 'stage') > 0 THEN 'invalid' ELSE 'ready' END, CAST(count(issue) FILTER (WHERE issue <> 'stage') AS VARCHAR), NULL, NULL FROM p
""")
def src14_library_truth(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as promotions of one person, with faults, entries that don't belong there and files that interrupted writes left; and the library's state over all."""
    key = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(
        "s_suppkey", F.concat(F.lit("promotion_"), F.lpad(key.cast("string"), 6, "0")).alias("promotion_id"), F.lit("person_0").alias("person_id"), F.col("s_nationkey").cast("string").alias("subject_key"),
        F.struct(F.col("s_name").alias("memory_id")).alias("source"), key.alias("created_at_ms"), F.concat(F.lit("Use "), key, F.lit(" everywhere.")).alias("description"))
    whole = _numbered(rows, truth.PROMOTION)
    files = spoiled(whole, F.when(key % 17 == 9, 0).when(key % 17 == 4, 0).otherwise(key), "person_id", 17)
    moved = whole.where(key % 17 == 4).select(F.concat(F.lit("global-preferences/promotion_of_"), key, F.lit(".md")).alias("path"), "value")
    kept = files.join(whole.where(key % 17 == 4).select("path"), "path", "left_anti")
    notes = whole.where(key % 13 == 2).select(F.concat(F.lit("global-preferences/notes-"), key, F.lit(".md")).alias("path"), "value")
    stages = whole.where(key % 11 == 5).select(F.concat(F.lit("global-preferences/."), "promotion_id", F.lit(".md.tmp")).alias("path"), "value")
    owner = table(spark, d, "region").where("r_regionkey = 0").select(F.concat(F.lit("person_"), "r_regionkey").alias("person_id"), F.lit(0).alias("created_at_ms"), F.lit("One person.").alias("description"))
    every = kept.unionByName(moved).unionByName(notes).unionByName(stages).unionByName(truth.render(owner, truth.PERSON))
    people, promoted = truth.scan(every, truth.PERSON), truth.scan(every, truth.PROMOTION)
    none = F.lit(None).cast("string")
    whole_state = truth.library_state(people, promoted).select(F.lit("library").alias("path"), "state", F.col("issues").cast("string").alias("issue"), none.alias("person_id"), none.alias("body_sha256"))
    return read(promoted, "person_id").unionByName(read(people, "person_id")).unionByName(whole_state)
