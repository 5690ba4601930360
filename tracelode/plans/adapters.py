"""The provided tables as the engine's own: transcripts, tool traces, memories, edges, jobs, preferences and outcomes.

Each adapter has its SQL beside it, a list of common table expressions that queries' SQL starts with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelode.functions import columns as C

CHANGES = "array<struct<operation:string,path:string,destination:string>>"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def none(kind: str):
    return F.lit(None).cast(kind)


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as sessions of messages."""
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("event_index"), F.lit("message").alias("kind"), "role", "text", none("string").alias("tool_name"), none("string").alias("call_id"),
        none("string").alias("command"), none("int").alias("exit_code"), none("string").alias("tool_status"), F.lit(False).alias("is_command_result"), none("string").alias("observed_outcome"),
        none(CHANGES).alias("file_changes"), F.sha2("text", 256).alias("event_sha256"))


def tool_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as tool sessions of users: signups speak, clicks call, purchases and errors answer; even numbers run commands."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    even, keyed, result = k % 2 == 0, kind.isin("click", "purchase", "error"), kind.isin("purchase", "error")
    return table(spark, d, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("event_index"),
        F.when(kind == "signup", "message").when(kind == "click", "tool_call").when(result, "tool_result").otherwise("metadata").alias("kind"),
        F.when(kind == "signup", "user").alias("role"), F.when(kind.isin("signup", "error"), F.col("props")).alias("text"),
        F.when(kind == "click", F.when(even, "shell").otherwise("lookup")).alias("tool_name"), F.when(keyed, F.concat_ws(":", "user_id", k)).alias("call_id"),
        F.when(keyed & even, F.element_at(F.array(*map(F.lit, COMMANDS)), ((k / 2).cast("int") % 3) + 1)).alias("command"),
        F.when(result & even, F.when(kind == "purchase", 0).otherwise(1)).alias("exit_code"), F.when(kind == "purchase", "completed").when(kind == "error", "failed").alias("tool_status"),
        (result & even).alias("is_command_result"), F.when(result & (k % 5 == 0), F.when(kind == "purchase", "success").otherwise("failure")).alias("observed_outcome"),
        F.when((kind == "purchase") & (k % 10 == 0), F.array(F.struct(F.lit("update").alias("operation"), F.concat(F.lit("src/m"), k, F.lit(".py")).alias("path"), none("string").alias("destination")))).alias("file_changes"),
        F.sha2(F.concat_ws("|", "event_id", "props"), 256).alias("event_sha256"))


COMMANDS = ("uv run pytest -q", "make build", "cargo test --all")
EVENTS_SQL = f"""
    ev0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type IN ('click', 'purchase', 'error') AS keyed, event_type IN ('purchase', 'error') AS result FROM events),
    ev AS (
        SELECT user_id AS session_id, event_id AS event_index, CASE WHEN event_type = 'signup' THEN 'message' WHEN event_type = 'click' THEN 'tool_call' WHEN result THEN 'tool_result' ELSE 'metadata' END AS kind,
               CASE WHEN event_type = 'signup' THEN 'user' END AS role, CASE WHEN event_type IN ('signup', 'error') THEN props END AS text,
               CASE WHEN event_type = 'click' THEN CASE WHEN k % 2 = 0 THEN 'shell' ELSE 'lookup' END END AS tool_name, CASE WHEN keyed THEN user_id || ':' || k END AS call_id,
               CASE WHEN keyed AND k % 2 = 0 THEN {list(COMMANDS)}[(k // 2) % 3 + 1] END AS command, CASE WHEN result AND k % 2 = 0 THEN CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END END AS exit_code,
               CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS tool_status, result AND k % 2 = 0 AS is_command_result,
               CASE WHEN result AND k % 5 = 0 THEN CASE WHEN event_type = 'purchase' THEN 'success' ELSE 'failure' END END AS observed_outcome,
               CASE WHEN event_type = 'purchase' AND k % 10 = 0 THEN 'src/m' || k || '.py' END AS path, sha256(event_id || '|' || props) AS event_sha256
        FROM ev0),
    ev_out AS (SELECT *, coalesce(observed_outcome, CASE WHEN exit_code = 0 THEN 'success' WHEN exit_code IS NOT NULL THEN 'failure' END, CASE WHEN tool_status = 'completed' THEN 'success' WHEN tool_status = 'failed' THEN 'failure' END, 'unknown') AS outcome FROM ev),
    ev_ep AS (SELECT *, sum(CASE WHEN kind = 'message' AND role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY event_index) AS episode FROM ev_out)
"""

TYPES = ("repository_knowledge", "user_preference", "work_state", "task_experience")


def memories(spark: SparkSession, d: str) -> DataFrame:
    """Documents as memories of a repository for each language; of equal texts only the last is active."""
    docs = table(spark, d, "documents")
    same = F.sha2("text", 256)
    last = docs.groupBy(same.alias("same")).agg(F.max("doc_id").alias("last"))
    title = F.coalesce(C.first_line(F.col("text")), F.lit("Untitled"))
    return docs.withColumn("same", same).join(last, "same").select(
        F.col("lang").alias("repo_key"), F.concat(F.lit("mem_"), F.sha2(F.col("doc_id").cast("string"), 256)).alias("memory_id"), F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % 4 + 1).cast("int")).alias("memory_type"),
        F.when(F.col("doc_id") == F.col("last"), "active").otherwise("superseded").alias("status"), F.col("doc_id").alias("created_at_ms"), title.alias("title"), F.col("text").alias("content"), F.col("source").alias("category"),
        F.array("lang").alias("tags"), F.array().cast("array<struct<fact_id:string,fact_kind:string,value:string>>").alias("facts"), "doc_id")


MEMORIES_SQL = f"""
    mem AS (
        SELECT lang AS repo_key, 'mem_' || sha256(CAST(doc_id AS VARCHAR)) AS memory_id, {list(TYPES)}[doc_id % 4 + 1] AS memory_type,
               CASE WHEN doc_id = max(doc_id) OVER (PARTITION BY text) THEN 'active' ELSE 'superseded' END AS status, doc_id AS created_at_ms,
               list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS lines,
               coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1], 'Untitled') AS title,
               text AS content, source AS category, lang, doc_id
        FROM documents)
"""


def order_memories(spark: SparkSession, d: str) -> DataFrame:
    """Orders as memories whose subject is the customer."""
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("memory_id"), F.concat(F.lit("repo"), F.col("o_custkey") % 10).alias("repo_key"), F.element_at(F.array(*map(F.lit, (*TYPES, TYPES[3]))), digit).alias("memory_type"),
        F.col("o_custkey").cast("string").alias("subject_key"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_at_ms"), F.col("o_custkey").alias("customer"))


def order_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each order is superseded by its customer's next one, unless its key is a multiple of seven."""
    following = F.lead("memory_id").over(Window.partitionBy("customer").orderBy("memory_id"))
    rows = order_memories(spark, d).select("repo_key", F.col("memory_id").alias("predecessor_id"), following.alias("successor_id"))
    return rows.where("successor_id is not null and predecessor_id % 7 <> 0").withColumn("created_at_ms", F.col("successor_id"))


ORDERS_SQL = f"""
    om AS (
        SELECT o_orderkey AS memory_id, 'repo' || (o_custkey % 10) AS repo_key, {[*TYPES, TYPES[3]]}[CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS memory_type, CAST(o_custkey AS VARCHAR) AS subject_key,
               epoch_ms(o_orderdate) AS created_at_ms, o_custkey AS customer, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS following, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n
        FROM orders),
    oe AS (SELECT repo_key, memory_id AS predecessor_id, following AS successor_id, following AS created_at_ms FROM om WHERE following IS NOT NULL AND memory_id % 7 <> 0),
    ost AS (SELECT *, CASE WHEN following IS NOT NULL AND memory_id % 7 <> 0 THEN 'superseded' ELSE 'active' END AS status FROM om),
    oline AS (
        SELECT *, min(CASE WHEN status = 'active' THEN memory_id END) OVER (PARTITION BY customer ORDER BY memory_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tip,
               min(CASE WHEN status = 'active' THEN n END) OVER (PARTITION BY customer ORDER BY memory_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - n AS depth
        FROM ost)
"""


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a queue of index jobs."""
    status = F.col("o_orderstatus")
    created = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.concat(F.lit("repo"), F.col("o_custkey") % 10).alias("repo_key"), F.when(status == "O", "pending").when(status == "F", "indexed").otherwise("leased").alias("status"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("attempts"), created.alias("created_ms"), (created + F.col("o_orderkey") % 5 * 86_400_000).alias("lease_expires_ms"),
        F.concat(F.lit("p"), F.col("o_custkey") % 3).alias("profile"), F.concat(F.lit("w"), F.col("o_custkey") % 4).alias("owner"), F.col("o_custkey").alias("customer"))


JOBS_SQL = """
    jobs AS (
        SELECT o_orderkey AS job_id, 'repo' || (o_custkey % 10) AS repo_key, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'indexed' ELSE 'leased' END AS status,
               CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS attempts, epoch_ms(o_orderdate) AS created_ms, epoch_ms(o_orderdate) + o_orderkey % 5 * 86400000 AS lease_expires_ms,
               'p' || (o_custkey % 3) AS profile, 'w' || (o_custkey % 4) AS owner, o_custkey AS customer
        FROM orders)
"""
#: A moment inside the orders' dates.
NOW_MS = 883_612_800_000


def promotions(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as promotions of preferences, of which every third replaces the one before."""
    key = F.col("s_suppkey")
    return table(spark, d, "supplier").select(key.alias("promotion_id"), key.alias("memory_id"), F.col("s_nationkey").alias("subject_key"), F.when(key % 3 == 0, key - 1).alias("replaces"), (key % 11).alias("person_id"))


def preferences(spark: SparkSession, d: str) -> DataFrame:
    """Customers as local preferences of a nation's subject."""
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("memory_id"), F.col("c_nationkey").alias("subject_key"), F.when(F.col("c_acctbal") >= 0, "active").otherwise("superseded").alias("status"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "work_state").otherwise("user_preference").alias("memory_type"))


PREFERENCES_SQL = """
    pro AS (SELECT s_suppkey AS promotion_id, s_suppkey AS memory_id, s_nationkey AS subject_key, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey - 1 END AS replaces, s_suppkey % 11 AS person_id FROM supplier),
    pre AS (
        SELECT c_custkey AS memory_id, c_nationkey AS subject_key, CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'superseded' END AS status,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'work_state' ELSE 'user_preference' END AS memory_type FROM customer),
    force AS (SELECT * FROM pro p WHERE NOT EXISTS (SELECT 1 FROM pro q WHERE q.replaces = p.promotion_id))
"""


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Labels as judged questions, by language."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return rows.select(
        F.col("doc_id").alias("question_id"), F.col("lang").alias("category"), F.when(F.col("toxic") == 1, "infrastructure_failure").when(F.col("quality") == 1, "correct").otherwise("wrong").alias("outcome"),
        F.col("n_chars").alias("latency_ms"))


OUTCOMES_SQL = """
    outc AS (
        SELECT doc_id AS question_id, lang AS category, CASE WHEN toxic = 1 THEN 'infrastructure_failure' WHEN quality = 1 THEN 'correct' ELSE 'wrong' END AS outcome, n_chars AS latency_ms
        FROM labels JOIN documents USING (doc_id))
"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Labels as runs of a task in two arms."""
    key = F.col("doc_id")
    return table(spark, d, "labels").select(
        F.floor(key / 2).alias("task_id"), F.when(key % 2 == 0, "off").otherwise("on").alias("arm"), F.when(F.col("toxic") == 1, "infrastructure").when(F.col("quality") == 1, "passed").otherwise("failed").alias("outcome"),
        F.when(key % 9 != 0, key % 1000).alias("input_tokens"), (key % 77).alias("output_tokens"), F.when(key % 4 != 0, key % 13).alias("steps"), key.alias("run_id"))


RUNS_SQL = """
    runs AS (
        SELECT CAST(doc_id // 2 AS BIGINT) AS task_id, CASE WHEN doc_id % 2 = 0 THEN 'off' ELSE 'on' END AS arm, CASE WHEN toxic = 1 THEN 'infrastructure' WHEN quality = 1 THEN 'passed' ELSE 'failed' END AS outcome,
               CASE WHEN doc_id % 9 <> 0 THEN doc_id % 1000 END AS input_tokens, doc_id % 77 AS output_tokens, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 13 END AS steps, doc_id AS run_id FROM labels)
"""


def session_files(lines: DataFrame) -> DataFrame:
    """Lines (source_path, head, n, line) as transcripts (source_path, length, content), as ``read_sessions`` gives them of files; the head is their first line."""
    whole = F.array_join(F.concat(F.array(F.any_value("head")), F.sort_array(F.collect_list(F.struct("n", "line")))["line"]), "\n")
    rows = lines.groupBy("source_path").agg(F.encode(whole, "UTF-8").alias("content"))
    return rows.select("source_path", F.octet_length("content").cast("long").alias("length"), "content")


def _record(**fields) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def transcripts_of(spark: SparkSession, d: str, provider: str) -> DataFrame:
    """Events as transcripts in a provider's format, a session for each user; see ``tool_events`` for what they say.

    Clicks with even numbers run commands; other clicks are lookups (provider B: every fourth edits a file).
    """
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, d, "events").withColumn("k", k).withColumn("call", F.concat(F.lit("c"), k)).withColumn("code", F.when(F.col("event_type") == "purchase", 0).otherwise(1))
    kind, text = F.col("event_type"), F.col("props")
    command = F.element_at(F.array(*map(F.lit, COMMANDS)), ((k / 2).cast("int") % 3) + 1)
    user = F.concat(F.lit(f"s{provider}-"), F.col("user_id"))
    path = F.concat(F.lit("/work/"), user, F.lit(".jsonl"))
    lit = F.lit
    if provider == "A":
        said = _record(type=lit("message"), role=lit("user"), content=F.array(F.struct(lit("input_text").alias("type"), text.alias("text")), F.struct(lit("input_text").alias("type"), lit("end").alias("text"))))
        call = _record(type=lit("function_call"), name=F.when(k % 2 == 0, "exec_command").otherwise("lookup"), call_id=F.col("call"), arguments=_record(cmd=command))
        output = _record(type=lit("function_call_output"), call_id=F.col("call"), output=F.concat(lit("Process exited with code "), "code", lit("\nFinal output:\n"), text))
        payload = F.when(kind == "signup", said).when(kind == "click", call).when(kind.isin("purchase", "error"), output).otherwise(text)
        line = F.concat(lit('{"type":"'), F.when(kind == "view", "event_msg").otherwise("response_item"), lit('","payload":'), payload, lit("}"))
        head = F.concat(lit('{"type":"session_meta","payload":{"id":"'), user, lit('","cwd":"/repo'), F.col("user_id") % 3, lit('/src"}}'))
    elif provider == "B":
        uses = F.when(k % 2 == 0, _record(command=command)).otherwise(_record(file_path=F.concat(lit("src/m"), k, lit(".py"))))
        call = F.concat(lit('[{"type":"text","text":"next"},{"type":"tool_use","id":"'), "call", lit('","name":"'), F.when(k % 2 == 0, "Bash").when(k % 4 == 1, "Edit").otherwise("Lookup"), lit('","input":'), uses, lit("}]"))
        output = F.concat(lit('[{"type":"tool_result","tool_use_id":"'), "call", lit('","content":"done","is_error":'), (kind == "error").cast("string"), lit("}]"))
        content = F.when(kind == "signup", F.to_json(F.array(F.struct(lit("text").alias("type"), text.alias("text"))))).when(kind == "click", call).when(kind.isin("purchase", "error"), output)
        line = F.concat(lit('{"sessionId":"'), user, lit('","type":"x"'), F.when(kind == "view", "").otherwise(F.concat(lit(',"message":{"role":"'), F.when(kind == "click", "assistant").otherwise("user"), lit('","content":'), content, lit("}"))), lit("}"))
        head = F.concat(lit('{"sessionId":"'), user, lit('","type":"summary","cwd":"/repo'), F.col("user_id") % 3, lit('"}'))
    else:
        said = F.concat(lit('{"kind":"message","role":"user","text":"'), kind, lit('"}'))
        call = F.concat(lit(',{"kind":"tool_call","call_id":"'), "call", lit('","tool_name":"shell","command":"'), command, lit('"}'))
        seen = F.when(k % 2 == 0, F.concat(lit(',"terminal_observation":{"exit_code":'), "code", lit(',"file_changes":[{"operation":"update","path":"src/m'), k, lit('.py"}]}'))).otherwise("")
        output = F.concat(lit(',{"kind":"tool_result","call_id":"'), "call", lit('","text":"done","status":"'), F.when(F.col("code") == 0, "completed").otherwise("error"), lit('"'), seen, lit("}"))
        line = F.concat(lit('{"record_type":"batch","events":['), said, F.when(kind.isin("purchase", "error"), F.concat(call, output)).otherwise(""), lit("]}"))
        head = F.concat(lit('{"record_type":"header","session_id":"'), user, lit('"}'))
    return session_files(rows.select(path.alias("source_path"), head.alias("head"), F.col("event_id").alias("n"), line.alias("line")))


TRANSCRIPTS_SQL = f"""
    tr AS (
        SELECT user_id, event_id, event_type, props, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS event_index,
               'c' || CAST(json_extract_string(props, '$.k') AS INTEGER) AS call, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS code, event_type IN ('purchase', 'error') AS result,
               {list(COMMANDS)}[(CAST(json_extract_string(props, '$.k') AS INTEGER) // 2) % 3 + 1] AS command FROM events),
    ky AS (SELECT event_id AS key_id, coalesce(lag(event_type) OVER (PARTITION BY user_id, call ORDER BY event_id) = 'click', FALSE) AS called_now FROM tr WHERE event_type IN ('click', 'purchase', 'error')),
    cb AS (SELECT tr.* , coalesce(called_now, FALSE) AS called FROM tr LEFT JOIN ky ON key_id = event_id),
    ca AS (SELECT *, coalesce(bool_or(event_type = 'click') OVER (PARTITION BY user_id, call ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS called FROM tr)
"""
