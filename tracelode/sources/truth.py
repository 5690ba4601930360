"""Markdown files as the truth of records: front matter of ``key: json`` lines and a body, rendered and scanned back."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions.tables import stored

MOST_BYTES = 64 << 20


def slug(repo_key: Column) -> Column:
    return F.substring(F.sha2(repo_key, 256), 1, 16)


class Record(NamedTuple):
    """A kind of record: its front matter's keys in order, its body's name, what identifies it, and where it lies.

    listed: the paths that a scan of the kind looks at; named: those of them that are records;
    stage: those that an interrupted write left behind. path: the one place of a record, from its
    identifying values in order. unique: how many of those values must be its own.
    """

    kind: str
    keys: tuple[str, ...]
    body: str
    identity: tuple[str, ...]
    listed: str
    named: str
    path: Callable[..., Column]
    unique: int
    stage: str = "^$"


# The formats' keys, in the order in which a file has them.
MEMORY = Record(
    "coding_memory",
    ("schema_version", "record_kind", "memory_id", "repo_key", "memory_type", "title", "category", "tags", "created_at_ms", "episode_id", "origin", "restored_from", "restore_predecessor_id", "source_order_key", "payload", "evidence", "facts"),
    "content", ("repo_key", "memory_id", "memory_type"), r"^memory/[^/]+/[^/]+/[^/]+\.md$", r"\.md$",
    lambda repo, memory, kind: F.concat(F.lit("memory/"), slug(repo), F.lit("/"), kind, F.lit("/"), memory, F.lit(".md")), 2)
EVOLUTION = Record(
    "evolution",
    ("schema_version", "record_kind", "evolution_id", "repo_key", "relation_kind", "predecessor_id", "successor_id", "proposal_id", "supporting_fact_ids", "source_order_key", "proposer", "evidence", "created_at_ms"),
    "reason", ("repo_key", "evolution_id"), r"^evolution/[^/]+/[^/]+\.md$", r"\.md$",
    lambda repo, evolution: F.concat(F.lit("evolution/"), slug(repo), F.lit("/"), evolution, F.lit(".md")), 2)
PERSON = Record("person", ("schema_version", "record_kind", "person_id", "created_at_ms"), "description", ("person_id",), r"^\.?person\.md(\..*)?$", r"^person\.md$", lambda person: F.lit("person.md"), 1, r"^\.person\.md\.")
PROMOTION = Record(
    "global_preference_promotion",
    ("schema_version", "record_kind", "promotion_id", "person_id", "subject_key", "source", "replaces_promotion_id", "created_at_ms"),
    "description", ("promotion_id",), "^global-preferences/[^/]+$", r"/promotion_[^/]*\.md$",
    lambda promotion: F.concat(F.lit("global-preferences/"), promotion, F.lit(".md")), 1, r"/\.promotion_[^/]*\.md\.")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path under the root, value: the whole text) of all files; names that start with a dot or underscore Spark doesn't list."""
    bare = lambda p: re.sub(r"^[^:/]+:(//[^/]*)?", "", p)
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    at = F.regexp_replace(F.col("_metadata.file_path"), r"^[^:/]+:(//[^/]*)?", "")
    return rows.select(F.substring(at, len(bare(root.rstrip("/"))) + 2, 1 << 20).alias("path"), "value")


def rendered(columns: list[str], record: Record) -> tuple[Column, Column]:
    """path and value of a row as a file: a column for each key but record_kind, and for the body; a column that is missing is null."""
    def text(key: str) -> Column:
        value = F.lit(record.kind) if key == "record_kind" else F.col(key) if key in columns else F.lit(None).cast("string")
        boxed = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
        return F.concat(F.lit(f"{key}: "), boxed.substr(F.lit(6), F.length(boxed) - 6))

    value = F.concat_ws("\n", F.lit("---"), *map(text, record.keys), F.lit("---"), F.coalesce(F.col(record.body), F.lit("")), F.lit(""))
    return record.path(*(F.col(k) for k in record.identity)).alias("path"), value.alias("value")


def render(rows: DataFrame, record: Record) -> DataFrame:
    """(path, value) of records as files."""
    return rows.select(*rendered(rows.columns, record))


def json_string(value: Column) -> Column:
    """The string that a JSON text is; null if it is another kind of value."""
    boxed = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")
    return F.when(value.startswith('"'), boxed["v"])


def scan(files: DataFrame, record: Record) -> DataFrame:
    """Every file (path, value) that a scan of the kind looks at, as a record or with the first rule that it breaks.

    Gives path, state (record, issue or stage: left by an interrupted write), issue, fields (JSON
    texts by key), body, content_sha256. Issues: unexpected_entry, empty_or_too_large (null too),
    no_front_matter, unterminated, bad_line, not_json, not_canonical (keys, their order, or another
    kind), wrong_identity, not_at_its_path, duplicate_identity (every file of the identity). Columns
    beside path and value are not read; an empty table gives no rows.
    """
    value, path = F.col("value"), F.col("path")
    end = F.locate("\n---\n", value, 5)
    lines = F.split(value.substr(F.lit(5), end - 5), "\n")
    rows = files.select("path", "value").where(path.rlike(record.listed)).withColumn("_lines", F.when(end > 0, lines))
    rows = rows.withColumns({"_names": F.transform("_lines", lambda x: F.regexp_extract(x, r"^(.*?): ", 1)), "_values": F.transform("_lines", lambda x: F.regexp_extract(x, r"(?s)^.*?: (.*)$", 1))})
    marked = F.forall("_lines", lambda x: F.contains(x, F.lit(": ")))
    shape = (
        F.when(path.rlike(record.stage), "stage").when(~path.rlike(record.named), "unexpected_entry")
        .when(F.coalesce(F.octet_length("value"), F.lit(0)) == 0, "empty_or_too_large").when(F.octet_length("value") > MOST_BYTES, "empty_or_too_large")
        .when(~value.startswith("---\n") | ~value.endswith("\n"), "no_front_matter").when(end == 0, "unterminated")
        .when(~marked | (F.size(F.array_distinct("_names")) < F.size("_names")), "bad_line").when(F.exists("_values", lambda x: F.try_parse_json(x).isNull()), "not_json")
        .when(F.col("_names") != F.array(*map(F.lit, record.keys)), "not_canonical"))
    fields = F.when(F.col("_shape").isNull(), F.map_from_arrays("_names", "_values"))
    body = F.when(F.col("_shape").isNull(), value.substr(end + 5, F.greatest(F.length("value") - end - 5, F.lit(0))))
    rows = rows.withColumn("_shape", shape).withColumns({"fields": fields, "body": body, "content_sha256": F.sha2("value", 256)})
    rows = rows.withColumn("_id", F.array(*(json_string(F.element_at("fields", k)) for k in record.identity)))
    issue = (
        F.when(F.col("_shape").isNotNull(), F.col("_shape")).when(F.element_at("fields", "record_kind") != f'"{record.kind}"', "not_canonical")
        .when(F.exists("_id", lambda x: x.isNull() | (x == "")), "wrong_identity")
        .when(path != record.path(*(F.col("_id")[i] for i in range(len(record.identity)))), "not_at_its_path"))
    # Files with issues are told apart by their paths, so that they aren't one key of the join.
    own = F.when(F.col("_issue").isNull(), F.to_json(F.slice("_id", 1, record.unique))).otherwise(path)
    # Written, so that texts are parsed once for both uses, and no filter pulls the rules' expressions apart again.
    rows = stored(rows.withColumn("_issue", issue).withColumn("_own", own).select("path", "_issue", "_own", "fields", "body", "content_sha256"), "truth")
    twice = rows.where("_issue is null").groupBy("_own").agg(F.count("*").alias("_times")).where("_times > 1")
    rows = rows.join(twice, "_own", "left").withColumn("_issue", F.when(F.col("_times") > 1, "duplicate_identity").otherwise(F.col("_issue")))
    state = F.when(F.col("_issue").isNull(), "record").when(F.col("_issue") == "stage", "stage").otherwise("issue")
    return rows.select("path", state.alias("state"), F.when(F.col("_issue") != "stage", F.col("_issue")).alias("issue"), "fields", "body", "content_sha256")


def library_state(people: DataFrame, promotions: DataFrame) -> DataFrame:
    """One row over both scans: persons, promotions, issues, and state: absent, ready, invalid, or person_missing where promotions are there without their person."""
    count = lambda rows, a, b: rows.agg(F.count_if(F.col("state") == "record").alias(a), F.count_if(F.col("state") == "issue").alias(b))
    rows = count(people, "persons", "_a").join(F.broadcast(count(promotions, "promotions", "_b")))
    issues = F.col("_a") + F.col("_b")
    state = F.when(issues > 0, "invalid").when((F.col("persons") == 0) & (F.col("promotions") > 0), "person_missing").when(F.col("persons") == 0, "absent").otherwise("ready")
    return rows.select("persons", "promotions", issues.alias("issues"), state.alias("state"))
