"""Tables at rest: immutable writes, index partitions, exports, resets, Markdown truth, reports and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.functions import columns as C
from tracelode.operators.traces import only_new


def repo_slug(repo_key: str = "repo_key"):
    return F.substring(F.sha2(F.col(repo_key), 256), 1, 16)


def write_immutable(rows: DataFrame, path: str, key: str = "memory_id", digest: str = "content_sha256", partitions: tuple[str, ...] = ("repo_slug", "memory_type")) -> None:
    """Adds rows whose key isn't there yet; repeats do nothing, and a key with another digest is an error before anything is written."""
    spark = rows.sparkSession
    rows = rows.withColumn("repo_slug", repo_slug()) if "repo_slug" in partitions and "repo_slug" not in rows.columns else rows
    twice = rows.groupBy(key).agg(F.countDistinct(digest).alias("_n")).where("_n > 1")
    if not twice.isEmpty():
        raise ValueError(f"conflicting rows for one {key}")
    rows = rows.dropDuplicates([key])
    if exists(spark, path):
        rows, clash = only_new(rows, spark.read.parquet(path), key, digest)
        if not clash.isEmpty():
            raise ValueError(f"{key} is there with another {digest}")
    rows.write.mode("append").partitionBy(*partitions).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path, in any store that Spark reads, is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def replace_partitions(rows: DataFrame, path: str, partitions: tuple[str, ...] = ("repo_key",)) -> None:
    """Overwrites the partitions that rows have, and no other ones."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def upserted(current: DataFrame, changes: DataFrame, key: str = "memory_id") -> DataFrame:
    """The index after changes: all documents of a changed memory are replaced by its new ones."""
    return current.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of each file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_replace("path", r"^.*?([^/]+)$", "$1").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def export_namespace(rows: DataFrame, repo_key: str, path: str) -> DataFrame:
    """Writes a repository's rows and gives the manifest of what was written."""
    rows.where(F.col("repo_key") == repo_key).write.mode("errorifexists").parquet(path)
    return manifest(rows.sparkSession, path)


def reset_preview(memories: DataFrame, promotions: DataFrame, repo_key: str) -> DataFrame:
    """What a reset of a repository would delete, and whether promotions still refer to it."""
    own = memories.where(F.col("repo_key") == repo_key)
    held = own.join(promotions.select("memory_id"), "memory_id", "left_semi").agg(F.count("*").alias("referenced"))
    return own.agg(F.count("*").alias("memories")).join(F.broadcast(held)).withColumn("blocked", F.col("referenced") > 0)


def write_exclusive(rows: DataFrame, path: str) -> None:
    """Writes JSON where nothing is; what is there already is an error."""
    rows.write.mode("errorifexists").json(path)


def read_outcomes(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """One JSON document in each file; a key that two files have is an error as soon as it is read."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    checked = rows.join(counts, key)
    return checked.where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("duplicate outcome "), F.col(key).cast("string"))).cast("boolean"))).drop("_n")


def read_markdown(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Records kept as Markdown: front matter of ``key: json`` lines between ``---`` marks, then a body.

    Gives path, fields (a map of JSON texts), body and violations: no front matter, keys that
    aren't exactly the given ones in order, a value that is no JSON.
    """
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), C.line_ends(F.col("value")).alias("value"))
    head = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x != "")
    names = F.transform(lines, lambda x: F.regexp_extract(x, r"^([A-Za-z0-9_]+): ", 1))
    values = F.transform(lines, lambda x: F.regexp_extract(x, r"(?s)^[A-Za-z0-9_]+: (.*)$", 1))
    rows = rows.withColumns({"_names": names, "_values": values, "body": F.regexp_extract("value", r"(?s)^---\n.*?\n---\n\n?(.*)$", 1)})
    wrong = C.violations(
        no_front_matter=head == "", wrong_keys=F.col("_names") != F.array(*map(F.lit, keys)), not_json=F.exists("_values", lambda v: F.try_parse_json(v).isNull()))
    return rows.select("path", F.map_from_arrays(F.array_distinct("_names"), F.slice("_values", 1, F.size(F.array_distinct("_names")))).alias("fields"), "body", wrong.alias("violations"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has, with the count."""
    return rows.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


JUNIT = T.StructType([T.StructField(f"_{n}", T.LongType()) for n in ("tests", "failures", "errors", "skipped")] + [T.StructField("_name", T.StringType())])


def read_junit(spark: SparkSession, path: str) -> DataFrame:
    """Test suites of JUnit XML: name, tests, failures, errors, skipped, passed."""
    rows = spark.read.format("xml").option("rowTag", "testsuite").schema(JUNIT).load(path)
    rows = rows.select(F.col("_name").alias("name"), *(F.coalesce(f"_{n}", F.lit(0)).alias(n) for n in ("tests", "failures", "errors", "skipped")))
    return rows.withColumn("passed", (F.col("failures") + F.col("errors") == 0) & (F.col("tests") > 0))


def read_dialogues(spark: SparkSession, path: str, most_bytes: int = 32 << 10) -> tuple[DataFrame, DataFrame]:
    """A conversation dataset: an array of samples with numbered sessions and questions.

    Gives turns (sample_id, session, turn, line), where sessions count until the first number
    that is missing, and questions (sample_id, ordinal, question, answer, category). A turn's
    caption stands behind its text; lines are cut to most_bytes.
    """
    turn = "array<struct<speaker:string,text:string,blip_caption:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<struct<sample_id:string,conversation:map<string,string>,qa:array<struct<question:string,answer:string,category:int>>>>")).alias("s")).select("s.*")
    numbers = F.array_sort(F.transform(F.filter(F.map_keys("conversation"), lambda k: k.rlike(r"^session_\d+$")), lambda k: F.regexp_extract(k, r"(\d+)$", 1).cast("int")))
    upto = F.filter(numbers, lambda n, i: n == i + 1)
    sessions = rows.select("sample_id", "conversation", F.explode(upto).alias("session"))
    turns = sessions.select("sample_id", "session", F.posexplode(F.from_json(F.try_element_at("conversation", F.concat(F.lit("session_"), F.col("session").cast("string"))), turn)).alias("turn", "t"))
    said = F.concat(F.col("t.speaker"), F.lit(": "), F.coalesce("t.text", F.lit("")), F.coalesce(F.concat(F.lit(" ["), F.col("t.blip_caption"), F.lit("]")), F.lit("")))
    return turns.select("sample_id", "session", "turn", C.byte_cut(said, most_bytes).alias("line")), rows.select("sample_id", F.posexplode("qa").alias("ordinal", "q")).select("sample_id", "ordinal", "q.*")


def message_events(chats: DataFrame) -> DataFrame:
    """Chat messages (chat_id, index, role, content, tool_calls, tool_call_id) as trace events: a message's text first, then its calls.

    content: array of struct<type, text>; tool_calls: array of struct<id, name, arguments>.
    """
    text = F.array_join(F.transform(F.filter("content", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    one = lambda kind, text, call, tool: F.struct(F.lit(kind).alias("kind"), text.alias("text"), call.alias("call_id"), tool.alias("tool_name"))
    none = F.lit(None).cast("string")
    own = F.when(F.col("role") == "tool", F.array(one("tool_result", text, F.col("tool_call_id"), none))).when(text != "", F.array(one("message", text, none, none)))
    calls = F.transform("tool_calls", lambda c: one("tool_call", none, c["id"], c["name"]))
    empty = F.array().cast("array<struct<kind:string,text:string,call_id:string,tool_name:string>>")
    return chats.select("chat_id", "index", "role", F.posexplode(F.concat(F.coalesce(own, empty), F.coalesce(calls, empty))).alias("block", "e")).select("chat_id", "index", "block", "role", "e.*")


def exec_trace(lines: DataFrame) -> DataFrame:
    """A command-line agent's event lines (run_id, position, line): last usage wins, bad lines are skipped.

    Gives run_id, steps, input_tokens, cached_tokens, output_tokens, failed_commands.
    """
    shape = "struct<type:string,usage:struct<input_tokens:long,cached_input_tokens:long,output_tokens:long>,item:struct<type:string,command:string,exit_code:int>>"
    rows = lines.select("run_id", "position", F.from_json("line", shape).alias("e")).where("e.type is not null")
    done = (F.col("e.type") == "item.completed") & (F.col("e.item.type") == "command_execution")
    return rows.groupBy("run_id").agg(
        F.count_if(F.col("e.type") == "item.completed").alias("steps"),
        F.max_by("e.usage", F.when(F.col("e.usage").isNotNull(), F.col("position"))).alias("u"), F.count_if(done & (F.col("e.item.exit_code") != 0)).alias("failed_commands"),
    ).select("run_id", "steps", F.col("u.input_tokens").alias("input_tokens"), F.col("u.cached_input_tokens").alias("cached_tokens"), F.col("u.output_tokens").alias("output_tokens"), "failed_commands")
