"""Session transcripts in JSON Lines: raw records with digests and cursors, and three providers' events in one shape.

Files are read whole as bytes, as a record's digest is over its bytes and its index counts
non-blank lines; a session is limited in size, so a file is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelode.functions import columns as C
from tracelode.functions.arrow import prefixes_at
from tracelode.operators.traces import patch_changes

SESSION_BYTES = 64 << 20
SESSION_EVENTS = 100_000
SESSION_CHANGES = 10_000
#: Tools of provider A that run a command, and of provider B that change files.
EXEC_TOOLS = ("exec_command", "shell", "local_shell", "container.exec")
PATCH_TOOLS = ("apply_patch",)
EDIT_TOOLS = ("Edit", "MultiEdit", "Write")
EXEC_TOOL_B = "Bash"

EVENT = "provider string, session_id string, event_index long, block int, event_id string, kind string, role string, text string, tool_name string, call_id string, command string, exit_code int, tool_status string, is_command_result boolean, observed_outcome string, file_changes array<struct<operation:string,path:string,destination:string>>, source_path string, event_sha256 string"


def read_sessions(spark: SparkSession, path: str, most_bytes: int = SESSION_BYTES) -> DataFrame:
    """(source_path, length, content) of the transcripts under a path; larger files have no content.

    The content of larger files isn't loaded: the condition on the length reaches the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path).select(F.col("path").alias("source_path"), "length", "content")
    large = F.col("length") > most_bytes
    return files.where(~large).unionByName(files.where(large).withColumn("content", F.lit(None).cast("binary")))


def raw_lines(sessions: DataFrame, most_bytes: int = SESSION_BYTES, most_events: int = SESSION_EVENTS) -> DataFrame:
    """One row for each non-blank line: source_path, event_index, line, event_sha256, record (variant), violation.

    Bytes are decoded as Latin-1 to split and to hash exactly what stands there, then each line
    as UTF-8, where bytes that aren't become the replacement character. A trailing carriage return is no part of a line. A file beyond the limits, or without content, gives one
    row with a violation; so does each line that is no JSON object. Sessions are read in one pass, whatever their size.
    """
    latin = F.decode("content", "ISO-8859-1")
    every = F.filter(F.split(latin, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")) != "")
    large = (F.col("length") > most_bytes) | F.col("content").isNull()
    rows = sessions.where("length is not null").select("source_path", large.alias("large"), F.when(large, F.array(F.lit(""))).otherwise(every).alias("lines"))
    rows = rows.select("source_path", "large", (F.size("lines") > most_events).alias("many"), "lines")
    # The outer form, as of the plain one Spark infers a filter that splits the content once more.
    rows = rows.select("source_path", "large", "many", F.posexplode_outer("lines").alias("event_index", "latin")).where("event_index is not null and (not many or event_index = 0)")
    line = F.when(F.endswith("latin", F.lit("\r")), F.expr("left(latin, length(latin) - 1)")).otherwise(F.col("latin"))
    rows = rows.withColumn("raw", F.encode(line, "ISO-8859-1"))
    rows = rows.select("source_path", F.col("event_index").cast("long").alias("event_index"), F.make_valid_utf8(F.col("raw").cast("string")).alias("line"), F.sha2("raw", 256).alias("event_sha256"), "large", "many")
    rows = rows.withColumn("record", F.try_parse_json("line"))
    broken = F.col("record").isNull() | ~F.ltrim("line", F.lit(" \t\r")).startswith("{")
    return rows.withColumn("violation", F.when(F.col("large"), "session_too_large").when(F.col("many"), "too_many_events").when(broken, "not_an_object")).drop("large", "many")


def resume_suffix(lines: DataFrame, cursors: DataFrame) -> DataFrame:
    """For each source with a cursor (source_path, cursor, prefix_sha256): what its committed prefix looks like now.

    Gives source_path, cursor, events, state: truncated, source_rewritten, already_imported or
    incremental; sources without a cursor are new.
    """
    whole = lines.groupBy("source_path").agg(F.count("*").alias("events"))
    at = prefixes_at(
        lines.select(F.col("source_path").alias("key"), F.col("event_index").alias("place"), F.col("event_sha256").alias("digest")),
        cursors.select(F.col("source_path").alias("key"), F.col("cursor").alias("place")))
    known = cursors.select("source_path", F.col("cursor").cast("long").alias("cursor"), F.col("prefix_sha256").alias("_committed"))
    found = at.select(F.col("key").alias("source_path"), F.col("place").alias("cursor"), F.col("prefix_sha256").alias("_found")).distinct()
    joined = whole.join(known.join(found, ["source_path", "cursor"]), "source_path", "left")
    state = (
        F.when(F.col("cursor").isNull(), "new").when(F.col("events") < F.col("cursor"), "truncated").when(~F.col("_found").eqNullSafe(F.col("_committed")), "source_rewritten")
        .when(F.col("events") == F.col("cursor"), "already_imported").otherwise("incremental")
    )
    return joined.select("source_path", "cursor", "events", state.alias("state"))


def text_of(record: Column, path: str, otherwise_json: bool = False) -> Column:
    """Text at a path: a string as it is, or the text members of a list of blocks, joined by line ends; of a list or object without text its JSON (compact, keys in order), if asked for."""
    plain = F.try_variant_get(record, path, "string")
    blocks = F.try_variant_get(record, path, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"])
    found = F.coalesce(F.when(blocks.isNull(), plain), F.when(F.size(texts) > 0, F.array_join(texts, "\n")))
    if not otherwise_json:
        return found
    whole = F.try_variant_get(record, path, "variant")
    structured = F.coalesce(F.schema_of_variant(whole).rlike("^(ARRAY|OBJECT)"), F.lit(False))
    return F.coalesce(found, F.when(structured, F.to_json(whole)))


def _provider() -> Column:
    """The provider that a record tells, or null."""
    r = F.col("record")
    kind = F.try_variant_get(r, "$.type", "string")
    return (
        F.when(F.try_variant_get(r, "$.record_type", "string") == "header", F.lit("C"))
        .when(F.try_variant_get(r, "$.sessionId", "string").isNotNull(), "B")
        .when(kind.isin("session_meta", "event_msg", "response_item"), "A")
    )


def _named() -> Column:
    """The session id that a record names, or null."""
    r = F.col("record")
    return F.coalesce(F.when(F.try_variant_get(r, "$.type", "string") == "session_meta", F.try_variant_get(r, "$.payload.id", "string")), F.try_variant_get(r, "$.sessionId", "string"), F.try_variant_get(r, "$.session_id", "string"))


def _first(column: str) -> Column:
    """The value of the first record that has one."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("event_index")))


def _or_stem(named: Column) -> Column:
    return F.coalesce(named, F.regexp_extract("source_path", r"([^/]+?)(?:\.[^./]*)?$", 1))


def sources(lines: DataFrame) -> DataFrame:
    """(source_path, provider, session_id, records): each source's provider and session id as its first records tell them, and all its lines, in one pass; the stem of the file where no record names a session."""
    valid = F.col("violation").isNull()
    rows = lines.select("source_path", "event_index", valid.alias("valid"), F.when(valid, _provider()).alias("told"), F.when(valid, _named()).alias("named"))
    found = rows.groupBy("source_path").agg(_first("told").alias("provider"), _first("named").alias("n"), F.count("*").alias("records"), F.bool_or("valid").alias("any_valid"))
    return found.where("any_valid").select("source_path", "provider", _or_stem(F.col("n")).alias("session_id"), "records")


def detect_provider(lines: DataFrame) -> DataFrame:
    """(source_path, provider): of each source's first record that tells; null if none does."""
    tells = lines.where("violation is null").withColumn("p", _provider())
    return tells.groupBy("source_path").agg(_first("p").alias("provider"))


def session_ids(lines: DataFrame) -> DataFrame:
    """(source_path, session_id): the first id in the records, else the file's stem."""
    rows = lines.where("violation is null").withColumn("named", _named())
    return rows.groupBy("source_path").agg(_first("named").alias("n")).select("source_path", _or_stem(F.col("n")).alias("session_id"))


def _in_sessions(lines: DataFrame) -> DataFrame:
    """The records that break no rule with their session_id, as ``session_ids`` gives it, without a second pass over the lines.

    A source is one partition, which later windows over its calls keep. Broken lines are left out
    behind the window, as a filter before it would parse each line twice.
    """
    valid = F.col("violation").isNull()
    rows = lines.select("source_path", "event_index", "event_sha256", "record", valid.alias("valid"), F.when(valid, _named()).alias("named"))
    return rows.withColumn("session_id", _or_stem(_first("named").over(Window.partitionBy("source_path")))).where("valid").drop("named", "valid")


def exit_code_text(text: Column) -> Column:
    """The code in a provider A output: the one line before ``Final output:`` that names it; null if several do."""
    found = F.regexp_extract_all(F.substring_index(text, "Final output:", 1), F.lit(r"(?m)^Process exited with code (-?\d+)$"), F.lit(1))
    return F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1)).try_cast("int"))


def command_of(arguments: Column) -> Column:
    """``cmd``, else ``command`` of a JSON argument object; a list of words is joined by blanks."""
    words = F.from_json(F.get_json_object(arguments, "$.command"), "array<string>")
    return F.coalesce(F.get_json_object(arguments, "$.cmd"), F.when(words.isNotNull(), F.array_join(words, " ")), F.get_json_object(arguments, "$.command"))


def _finish(rows: DataFrame, provider: str) -> DataFrame:
    names = [x.split()[0] for x in EVENT.split(", ")]
    kinds = dict(x.split(" ", 1) for x in EVENT.split(", "))
    rows = rows.withColumn("provider", F.lit(provider)).withColumn("event_id", C.stable_id("evt", F.lit(provider), F.col("session_id"), F.col("event_index"), F.col("event_sha256"), F.col("kind"), F.col("block")))
    for n in names:
        if n not in rows.columns:
            rows = rows.withColumn(n, F.lit(None))
    return rows.select(*(F.col(n).cast(kinds[n]).alias(n) for n in names))


def _outputs_know_their_calls(rows: DataFrame, fields: list[str], per: list[str] | None = None, once: bool = False) -> DataFrame:
    """Gives each result the fields of the latest call before it with its call id in the session, as columns call_<field>.

    per: what call and result must share besides. once: a call that was answered has no more results.
    """
    w = Window.partitionBy("source_path", *(per or []), "call_id").orderBy("event_index", "block").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.col("kind").isin(*(("tool_call", "tool_result") if once else ("tool_call",)))
    before = F.last(F.when(seen & F.col("call_id").isNotNull(), F.struct("kind", *fields)), True).over(w)
    rows = rows.withColumn("_before", before)
    answers = F.col("call_id").isNotNull() & (F.col("_before.kind") == "tool_call")
    return rows.withColumns({f"call_{f}": F.when(answers, F.col("_before")[f]) for f in fields}).drop("_before")


def provider_a(lines: DataFrame) -> DataFrame:
    """Flat envelopes: one event for each record. A result answers a call of its own kind, and a call is answered once."""
    r, g = F.col("record"), lambda p: F.try_variant_get(F.col("record"), p, "string")
    kind, inner = F.col("type"), F.col("inner")
    call, output = inner.isin("function_call", "custom_tool_call"), inner.isin("function_call_output", "custom_tool_call_output")
    item = kind == "response_item"
    rows = _in_sessions(lines).withColumns({"type": g("$.type"), "inner": g("$.payload.type")}).select(
        "source_path", "session_id", "event_index", F.lit(0).alias("block"), "event_sha256",
        F.when(item & (inner == "message"), "message").when(item & call, "tool_call").when(item & output, "tool_result").otherwise("metadata").alias("kind"),
        F.when(item & (inner == "message"), g("$.payload.role")).alias("role"),
        F.when(item & (inner == "message"), text_of(r, "$.payload.content")).when(item & output, F.coalesce(g("$.payload.output.output"), text_of(r, "$.payload.output", True))).alias("text"),
        F.when(item & call, g("$.payload.name")).alias("tool_name"),
        F.when(item & (call | output), g("$.payload.call_id")).alias("call_id"),
        F.regexp_replace(inner, "_output$", "").alias("family"),
        F.when(item & call, F.coalesce(g("$.payload.arguments"), g("$.payload.input"))).alias("arguments"),
        F.when(item, g("$.payload.status")).alias("tool_status"),
        F.try_variant_get(r, "$.payload.output.exit_code", "int").alias("code"),
    )
    rows = rows.withColumn("command", F.when(F.col("tool_name").isin(*EXEC_TOOLS), command_of(F.col("arguments"))))
    rows = rows.withColumn("patch", F.when(F.col("tool_name").isin(*PATCH_TOOLS), patch_changes(F.coalesce(F.get_json_object("arguments", "$.input"), F.col("arguments")))))
    rows = _outputs_know_their_calls(rows, ["tool_name", "command", "patch"], ["family"], once=True)
    result = F.col("kind") == "tool_result"
    rows = rows.withColumn("is_command_result", result & F.coalesce(F.col("call_tool_name").isin(*EXEC_TOOLS), F.lit(False)))
    rows = rows.withColumn("exit_code", F.when(F.col("is_command_result"), F.coalesce("code", exit_code_text(F.col("text")))))
    rows = rows.withColumn("command", F.when(result, F.col("call_command")).otherwise(F.col("command")))
    rows = rows.withColumn("file_changes", F.when(result & F.coalesce(F.col("code"), exit_code_text(F.col("text")), F.lit(0)).eqNullSafe(0), F.col("call_patch")))
    return _finish(rows, "A")


def provider_b(lines: DataFrame) -> DataFrame:
    """Nested content blocks: an event for each block; a string content is one text block."""
    r, g = F.col("record"), lambda p: F.try_variant_get(F.col("record"), p, "string")
    block = "struct<type:string,text:string,id:string,name:string,input:variant,tool_use_id:string,content:variant,is_error:boolean>"
    many = F.try_variant_get(r, "$.message.content", f"array<{block}>")
    one = F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), g("$.message.content").alias("text"))), block))
    rows = _in_sessions(lines)
    rows = rows.select("source_path", "session_id", "event_index", "event_sha256", F.col("record").alias("whole"), F.try_variant_get(r, "$.message.role", "string").alias("role"), F.posexplode_outer(F.coalesce(many, one)).alias("block", "b"))
    kind = F.col("b.type")
    rows = rows.select(
        "source_path", "session_id", "event_index", F.coalesce("block", F.lit(0)).alias("block"), "event_sha256", "whole",
        F.when((kind == "text") & F.col("role").isNotNull(), "message").when(kind == "tool_use", "tool_call").when(kind == "tool_result", "tool_result").otherwise("metadata").alias("kind"),
        F.when(kind == "text", F.col("role")).alias("role"),
        F.when(kind == "text", F.col("b.text")).when(kind == "tool_result", text_of(F.col("b.content"), "$", True)).alias("text"),
        F.when(kind == "tool_use", F.col("b.name")).alias("tool_name"),
        F.when(kind == "tool_use", F.col("b.id")).when(kind == "tool_result", F.col("b.tool_use_id")).alias("call_id"),
        F.when((kind == "tool_use") & (F.col("b.name") == EXEC_TOOL_B), F.try_variant_get(F.col("b.input"), "$.command", "string")).alias("command"),
        F.when(kind == "tool_use", F.try_variant_get(F.col("b.input"), "$.file_path", "string")).alias("path"),
        F.coalesce("b.is_error", F.lit(False)).alias("failed"),
    )
    rows = _outputs_know_their_calls(rows, ["tool_name", "command", "path"])
    result = F.col("kind") == "tool_result"
    run = result & F.coalesce(F.col("call_tool_name") == EXEC_TOOL_B, F.lit(False))
    code = F.regexp_extract(F.coalesce("text", F.lit("")), r"(?m)^Exit code (-?\d+)$", 1)
    rows = rows.withColumn("exit_code", F.when(run, F.coalesce(F.nullif(code, F.lit("")).try_cast("int"), F.when(F.col("failed"), 1).otherwise(0)))).withColumn("is_command_result", run)
    made = F.try_variant_get("whole", "$.toolUseResult.type", "string")
    from_nothing = (F.col("call_tool_name") == "Write") & F.try_variant_get("whole", "$.toolUseResult", "variant").isNotNull() & F.try_variant_get("whole", "$.toolUseResult.originalFile", "string").isNull()
    operation = F.when(made == "delete", "delete").when((made == "create") | from_nothing, "add").otherwise("update")
    path = F.coalesce(F.col("call_path"), F.try_variant_get("whole", "$.toolUseResult.filePath", "string"))
    changed = result & ~F.col("failed") & F.coalesce(F.col("call_tool_name").isin(*EDIT_TOOLS), F.lit(False)) & path.isNotNull()
    rows = rows.withColumn("file_changes", F.when(changed, F.array(F.struct(operation.alias("operation"), path.alias("path"), F.lit(None).cast("string").alias("destination")))))
    rows = rows.withColumn("command", F.when(result, F.col("call_command")).otherwise(F.col("command"))).withColumn("tool_status", F.when(result, F.when(F.col("failed"), "error").otherwise("success")))
    return _finish(rows, "B")


def provider_c(lines: DataFrame) -> DataFrame:
    """A header, then batches of events that start with one user message; calls pair inside their batch."""
    event = "struct<kind:string,role:string,text:string,call_id:string,tool_name:string,command:string,status:string,terminal_observation:struct<exit_code:int,file_changes:array<struct<operation:string,path:string,destination_path:string>>>>"
    rows = _in_sessions(lines).where(F.try_variant_get("record", "$.record_type", "string") == "batch")
    rows = rows.select("source_path", "session_id", "event_index", "event_sha256", F.posexplode(F.try_variant_get("record", "$.events", f"array<{event}>")).alias("block", "e"))
    result = F.col("e.kind") == "tool_result"
    status = F.when(F.col("e.status").isin("success", "completed"), "success").when(F.col("e.status").isin("failure", "failed", "error"), "failure")
    code = F.col("e.terminal_observation.exit_code")
    rows = rows.select(
        "source_path", "session_id", "event_index", "block", "event_sha256", F.col("e.kind").alias("kind"), F.when(F.col("e.kind") == "message", F.col("e.role")).alias("role"), F.col("e.text").alias("text"),
        F.col("e.tool_name").alias("tool_name"), F.col("e.call_id").alias("call_id"), F.col("e.command").alias("command"), F.when(result, code).alias("exit_code"),
        F.when(result, F.col("e.status")).alias("tool_status"), (result & code.isNotNull()).alias("is_command_result"),
        F.when(result, F.coalesce(F.when(code == 0, "success").when(code.isNotNull(), "failure"), status, F.lit("unknown"))).alias("observed_outcome"),
        F.when(result, F.transform("e.terminal_observation.file_changes", lambda c: F.struct(c["operation"].alias("operation"), c["path"].alias("path"), c["destination_path"].alias("destination")))).alias("file_changes"),
    )
    rows = _outputs_know_their_calls(rows, ["command"], ["event_index"])
    rows = rows.withColumn("command", F.when(F.col("kind") == "tool_result", F.col("call_command")).otherwise(F.col("command")))
    return _finish(rows, "C")


def result_violations(lines: DataFrame) -> DataFrame:
    """Provider A results that break a rule: source_path, event_index, violations: ambiguous_exit_code where several lines of the envelope name one, exit_code_range where it isn't of 32 bits."""
    g = lambda p: F.try_variant_get(F.col("record"), p, "string")
    rows = lines.where("violation is null").where((g("$.type") == "response_item") & (g("$.payload.type") == "function_call_output"))
    text = F.coalesce(g("$.payload.output.output"), text_of(F.col("record"), "$.payload.output"), F.lit(""))
    named = F.regexp_extract_all(F.substring_index(text, "\nFinal output:", 1), F.lit(r"(?m)^Process exited with code (-?\d+)[ \t]*$"), F.lit(1))
    given = F.try_variant_get("record", "$.payload.output.exit_code", "decimal(38,0)")
    code = F.coalesce(given, F.when(F.size(named) == 1, named[0].try_cast("decimal(38,0)")))
    wide = F.coalesce((code < -(2**31)) | (code >= 2**31), F.size(named) == 1)
    rows = rows.select("source_path", "event_index", C.violations(ambiguous_exit_code=given.isNull() & (F.size(named) > 1), exit_code_range=F.when(code.isNull() & (F.size(named) != 1), F.lit(False)).otherwise(wide)).alias("violations"))
    return rows.where("size(violations) > 0")


def change_violations(events: DataFrame, most: int = SESSION_CHANGES) -> DataFrame:
    """Sources whose events change more files than a session may: source_path, changes, violation."""
    counts = events.groupBy("source_path").agg(F.sum(F.greatest(F.size(F.coalesce("file_changes", F.array().cast(events.schema["file_changes"].dataType))), F.lit(0))).alias("changes"))
    return counts.where(F.col("changes") > most).withColumn("violation", F.lit("too_many_file_changes"))


def batch_violations(lines: DataFrame) -> DataFrame:
    """Provider C batches that break a rule: source_path, event_index, violations."""
    kinds = F.try_variant_get("record", "$.events", "array<struct<kind:string,role:string,terminal_observation:struct<file_changes:array<struct<operation:string,destination_path:string>>>>>")
    rows = lines.where("violation is null").where(F.try_variant_get("record", "$.record_type", "string") == "batch").withColumn("e", kinds)
    users = F.size(F.filter("e", lambda x: (x["kind"] == "message") & (x["role"] == "user")))
    first = F.try_element_at("e", F.lit(1))
    changes = F.flatten(F.transform(F.col("e"), lambda x: F.coalesce(x["terminal_observation"]["file_changes"], F.array().cast("array<struct<operation:string,destination_path:string>>"))))
    moved = lambda c: F.coalesce(c["operation"] == "move", F.lit(False))
    rows = rows.select("source_path", "event_index", C.violations(
        move_without_destination=F.coalesce(F.exists(changes, lambda c: moved(c) & c["destination_path"].isNull()), F.lit(False)),
        destination_without_move=F.coalesce(F.exists(changes, lambda c: ~moved(c) & c["destination_path"].isNotNull()), F.lit(False)),
        unknown_operation=F.coalesce(F.exists(changes, lambda c: ~F.coalesce(c["operation"].isin("add", "update", "delete", "move"), F.lit(False))), F.lit(False)),
        no_events=F.col("e").isNull() | (F.size("e") == 0), too_many_events=F.size("e") > 2048, batch_too_large=F.octet_length("line") > 4 << 20,
        not_one_user=users != 1, not_opened_by_user=~F.coalesce((first["kind"] == "message") & (first["role"] == "user"), F.lit(False))).alias("violations"))
    return rows.where("size(violations) > 0")


NORMALIZERS = {"A": provider_a, "B": provider_b, "C": provider_c}


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All transcripts under a path as trace events; each source is read by the normalizer of its provider."""
    lines = raw_lines(read_sessions(spark, path))
    providers = detect_provider(lines)
    out = None
    for name, normalize in NORMALIZERS.items():
        own = normalize(lines.join(providers.where(F.col("provider") == name), "source_path", "left_semi"))
        out = own if out is None else out.unionByName(own)
    return out


def discover(files: DataFrame, most: int = 256, per_folder: int = 16, folders: int = 1024, preferred: str | None = None) -> DataFrame:
    """Candidates among listed files (path, modified): newest of each folder first, folder after folder in turns.

    A preferred folder goes before the others in each turn. truncated says whether a limit left any out.
    """
    rows = files.withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    turn = Window.partitionBy("folder").orderBy(F.desc("modified"), "path")
    rows = rows.withColumn("turn", F.row_number().over(turn))
    kept = rows.groupBy("folder").agg(F.max("modified").alias("m")).orderBy(F.desc("m"), "folder").limit(folders).select("folder")
    counted = rows.agg(F.count("*").alias("all_files"))
    out = rows.where(F.col("turn") <= per_folder).join(F.broadcast(kept), "folder", "left_semi").orderBy("turn", F.col("folder") != F.lit(preferred or ""), F.desc("modified"), "path").limit(most)
    return out.join(F.broadcast(counted)).select("path", "folder", "turn", "modified", "all_files")


def working_folders(lines: DataFrame) -> DataFrame:
    """(source_path, cwd) of each record that names a working folder, in provider A's or B's form; a name that is no text is empty."""
    kind, own = F.try_variant_get("record", "$.type", "string"), lambda p: F.try_variant_get("record", p, "variant")
    said = F.coalesce(own("$.cwd"), F.when(kind.isin("session_meta", "turn_context"), F.coalesce(own("$.payload.cwd"), F.parse_json(F.lit("false")))))
    rows = lines.where("violation is null").withColumn("said", said).where("said is not null")
    return rows.select("source_path", F.coalesce(F.when(F.schema_of_variant("said") == "STRING", F.try_variant_get("said", "$", "string")), F.lit("")).alias("cwd"))


def one_repository(folders: DataFrame, roots: DataFrame, most: int = 64) -> DataFrame:
    """(source_path, matches): whether all working folders that a session names (source_path, cwd) are absolute, few, and at or below its root (source_path, root)."""
    rows = folders.join(roots.select("source_path", "root"), "source_path")
    inside = F.col("cwd").startswith("/") & ((F.col("cwd") == F.col("root")) | F.col("cwd").startswith(F.concat(F.col("root"), F.lit("/"))))
    return rows.groupBy("source_path").agg((F.every(inside) & (F.count_distinct("cwd") <= most)).alias("matches"))
