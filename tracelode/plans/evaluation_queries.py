"""Queries of evaluation reducers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.operators import evaluation
from tracelode.plans.adapters import OUTCOMES_SQL, RUNS_SQL, outcomes, runs, table
from tracelode.plans.registry import query

COUNTS_SQL = "count(*) AS n, count(*) FILTER (WHERE outcome = 'correct') AS correct, count(*) FILTER (WHERE outcome = 'wrong') AS wrong, count(*) FILTER (WHERE outcome = 'infrastructure_failure') AS infrastructure_failure, round(count(*) FILTER (WHERE outcome = 'correct') / nullif(count(*) FILTER (WHERE outcome IN ('correct', 'wrong')), 0), 6) AS accuracy"


@query(f"WITH {OUTCOMES_SQL} SELECT category, {COUNTS_SQL} FROM outc GROUP BY category UNION ALL SELECT 'all', {COUNTS_SQL} FROM outc")
def agg04_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = outcomes(spark, d)
    return evaluation.accuracy(rows, ["category"]).unionByName(evaluation.accuracy(rows).withColumn("category", F.lit("all")))


@query(f"WITH {OUTCOMES_SQL} SELECT category, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95 FROM outc GROUP BY category")
def agg05_latency(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluation.percentiles(outcomes(spark, d), "latency_ms", (0.5, 0.95), ["category"])
    return rows.select("category", F.col("p50").cast("long").alias("p50"), F.col("p95").cast("long").alias("p95"))


@query(f"""
    WITH {OUTCOMES_SQL}, m AS (SELECT count(*) AS queries, round(avg(CASE WHEN outcome = 'correct' THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, quantile_disc(latency_ms, 0.95) AS p95 FROM outc)
    SELECT queries, recall_at_5, recall_at_5 >= 0.9 AS recall_ok, p95 <= 4000 AS latency_ok, recall_at_5 >= 0.9 AND p95 <= 4000 AS passed FROM m
""")
def agg07_gate(spark: SparkSession, d: str) -> DataFrame:
    from tracelode.functions.columns import nearest_rank

    hit = F.when(F.col("outcome") == "correct", 1.0).otherwise(0.0)
    rows = outcomes(spark, d).agg(F.count("*").alias("queries"), F.round(F.avg(hit), 6).alias("recall_at_5"), nearest_rank("latency_ms", 0.95).alias("p95"))
    return evaluation.retrieval_gate(rows, F.col("p95")).drop("p95")


@query(f"""
    WITH {RUNS_SQL}
    SELECT arm, count(*) AS planned, count(*) FILTER (WHERE outcome IN ('passed', 'failed')) AS completed, count(*) FILTER (WHERE outcome = 'passed') AS passed, count(*) FILTER (WHERE outcome = 'failed') AS failed,
           count(*) FILTER (WHERE outcome = 'infrastructure') AS infrastructure, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, round(avg(steps), 6) AS mean_steps,
           round(count(*) FILTER (WHERE outcome = 'passed') / nullif(count(*) FILTER (WHERE outcome IN ('passed', 'failed')), 0), 6) AS pass_rate FROM runs GROUP BY arm
""")
def agg08_arms(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.arms(runs(spark, d))


@query(f"""
    WITH {RUNS_SQL}, p AS (SELECT a.outcome = 'passed' AS a, b.outcome = 'passed' AS b FROM runs a JOIN runs b ON a.task_id = b.task_id AND a.arm = 'off' AND b.arm = 'on')
    SELECT count(*) AS pairs, count(*) FILTER (WHERE a AND b) AS "both", count(*) FILTER (WHERE a AND NOT b) AS only_off, count(*) FILTER (WHERE NOT a AND b) AS only_on, count(*) FILTER (WHERE NOT a AND NOT b) AS neither FROM p
""")
def jn09_paired_arms(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.paired(runs(spark, d), ["task_id"])


@query("""SELECT l_orderkey, CAST(sum(c - 1) AS BIGINT) AS repeated FROM (SELECT l_orderkey, l_suppkey % 5 AS item, count(*) AS c FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""")
def agg09_repeats(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.repeats(table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("item")), "l_orderkey", "item", "repeated")


@query(f"""
    WITH {OUTCOMES_SQL}, a AS (SELECT category, count(*) FILTER (WHERE outcome = 'correct') / nullif(count(*) FILTER (WHERE outcome <> 'infrastructure_failure'), 0) AS a FROM outc GROUP BY category),
    w AS (SELECT lang AS category, count(*) AS weight FROM documents GROUP BY lang)
    SELECT round(sum(weight * a) / sum(weight), 6) AS weighted_accuracy, count(*) AS categories FROM a JOIN w USING (category) WHERE a IS NOT NULL
""")
def agg10_weighted(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.weighted_accuracy(outcomes(spark, d), table(spark, d, "documents").groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("weight")), "category")


@query("""SELECT l_orderkey AS question_id, count(*) AS votes, count(*) FILTER (WHERE l_quantity > 25) >= 2 AS correct FROM lineitem GROUP BY l_orderkey""")
def agg11_majority(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.majority(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), (F.col("l_quantity") > 25).alias("vote")), "question_id")


@query("""SELECT round(sum(l_tax), 8) AS l_tax, round(sum(l_discount), 8) AS l_discount, round(sum(l_quantity), 8) AS l_quantity FROM lineitem WHERE l_returnflag IN ('A', 'R')""")
def agg12_usage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return evaluation.merge_usage(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'"), ["l_tax", "l_discount", "l_quantity"])


@query("""SELECT md5(text) AS digest, count(*) AS rows FROM documents GROUP BY ALL HAVING count(*) > 1""")
def agg13_duplicates(spark: SparkSession, d: str) -> DataFrame:
    from tracelode.sources.lake import duplicates

    return duplicates(table(spark, d, "documents").select(F.md5(F.encode("text", "UTF-8")).alias("digest")), "digest")


@query("""
    SELECT role AS provider, count(*) AS events, count(DISTINCT conv_id) AS sessions, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) - count(DISTINCT conv_id || ':' || turn) AS duplicates FROM conversations GROUP BY role
""")
def agg14_scale(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy(F.col("role").alias("provider")).agg(
        F.count("*").alias("events"), F.countDistinct("conv_id").alias("sessions"), F.sum(F.octet_length("text")).alias("bytes"), (F.count("*") - F.countDistinct("conv_id", "turn")).alias("duplicates"))


@query(f"WITH {OUTCOMES_SQL} SELECT round(avg(CAST(outcome = 'correct' AS INTEGER)), 6) AS success_rate, min(question_id) AS first_question, count(DISTINCT category) AS providers FROM outc")
def agg15_smoke(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(spark, d).agg(F.round(F.avg((F.col("outcome") == "correct").cast("int")), 6).alias("success_rate"), F.min("question_id").alias("first_question"), F.countDistinct("category").alias("providers"))


@query("""SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'conversations', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'benchmark', count(*) FROM benchmark""")
def agg16_inventory(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("documents", "labels", "benchmark")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(table(spark, d, "conversations").agg(F.lit("conversations").alias("name"), F.countDistinct("conv_id").alias("n")))


@query(f"""
    WITH {RUNS_SQL}, m AS (SELECT count(*) FILTER (WHERE arm = 'on' AND outcome = 'passed') / count(*) FILTER (WHERE arm = 'on') AS a, count(*) FILTER (WHERE arm = 'off' AND outcome = 'passed') / count(*) FILTER (WHERE arm = 'off') AS b FROM runs)
    SELECT 'pass_rate_on' AS claim, 'percent' AS kind, round(100 * a, 4) AS value FROM m UNION ALL SELECT 'pass_rate_delta', 'percentage_points', round(100 * (a - b), 4) FROM m UNION ALL SELECT 'failures', 'relative_reduction', round(((1 - b) - (1 - a)) / (1 - b), 4) FROM m
""")
def agg17_claims(spark: SparkSession, d: str) -> DataFrame:
    share = lambda arm: F.count_if((F.col("arm") == arm) & (F.col("outcome") == "passed")) / F.count_if(F.col("arm") == arm)
    row = runs(spark, d).agg(share("on").alias("a"), share("off").alias("b"))
    return evaluation.claims(row, {"pass_rate_on": ("percent", "100 * a"), "pass_rate_delta": ("percentage_points", "100 * (a - b)"), "failures": ("relative_reduction", "((1 - b) - (1 - a)) / (1 - b)")})


@query("""
    WITH h AS (SELECT lang, sha256(doc_id || ':' || text) AS h FROM documents),
    s AS (SELECT lang, count(*) AS n, [sum(CAST(('0x' || substr(h, 1, 15)) AS BIGINT)), sum(CAST(('0x' || substr(h, 16, 15)) AS BIGINT)), sum(CAST(('0x' || substr(h, 31, 15)) AS BIGINT)), sum(CAST(('0x' || substr(h, 46, 15)) AS BIGINT))] AS parts FROM h GROUP BY lang)
    SELECT lang, n, sha256(n || ':' || array_to_string(list_transform(parts, lambda x: CAST(x AS VARCHAR)), ':')) AS digest FROM s
""")
def agg18_digest(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.collection_digest(table(spark, d, "documents"), ["lang"], F.concat_ws(":", "doc_id", "text"))


@query("""SELECT sum(len(string_split(text, chr(10)))) :: BIGINT AS lines, lang AS class FROM documents GROUP BY lang""")
def agg22_source_budget(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.col("lang").alias("class")).agg(F.sum(F.size(F.split("text", "\n"))).alias("lines"))


@query("""SELECT l_suppkey AS question, count(*) AS answers, count(*) FILTER (WHERE l_quantity > 20) AS passes, bool_and(l_quantity > 20) AS all_passed, count(*) FILTER (WHERE l_quantity > 20) >= count(*) * 0.6 AS met FROM lineitem GROUP BY l_suppkey""")
def agg23_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.thresholds(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("question"), (F.col("l_quantity") > 20).alias("passed")), 0.6)


@query(f"""
    WITH {OUTCOMES_SQL} SELECT question_id, category, CASE WHEN outcome = 'infrastructure_failure' THEN CASE WHEN question_id % 2 = 0 THEN 'correct' ELSE 'wrong' END ELSE outcome END AS outcome, CASE WHEN outcome = 'infrastructure_failure' THEN latency_ms + 1 ELSE latency_ms END AS latency_ms FROM outc
""")
def jn11_repair(spark: SparkSession, d: str) -> DataFrame:
    rows = outcomes(spark, d)
    again = rows.where("outcome = 'infrastructure_failure'").withColumns({"outcome": F.when(F.col("question_id") % 2 == 0, "correct").otherwise("wrong"), "latency_ms": F.col("latency_ms") + 1})
    return evaluation.compose_repair(rows, again, "question_id")


@query(f"WITH {OUTCOMES_SQL} SELECT category, question_id FROM outc WHERE outcome = 'infrastructure_failure'")
def evl05_repair_selection(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(spark, d).where("outcome = 'infrastructure_failure'").select("category", "question_id")


@query("""
    WITH e AS (SELECT user_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS episode FROM events),
    s AS (SELECT user_id, episode, count(*) AS n FROM e WHERE episode > 0 GROUP BY ALL)
    SELECT CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS provider, CAST(sum(n) AS BIGINT) AS events, count(DISTINCT user_id) AS sessions, count(*) AS episodes FROM s GROUP BY 1
""")
def evl03_scale_generator(spark: SparkSession, d: str) -> DataFrame:
    """The given events as sessions of two providers: episodes found by sessionization, counted by provider."""
    from tracelode.operators.traces import episodes
    from tracelode.plans.adapters import tool_events

    found = episodes(tool_events(spark, d)).groupBy(F.when(F.col("session_id") % 2 == 0, "A").otherwise("B").alias("provider"))
    return found.agg(F.sum("n_events").alias("events"), F.countDistinct("session_id").alias("sessions"), F.count("*").alias("episodes"))


@query("""
    WITH f AS (SELECT doc_id, lang || '/' || source || '/' || doc_id AS path, n_chars, lang FROM documents),
    m AS (SELECT lang, CAST(sum(n_chars) AS DOUBLE) AS value FROM f WHERE doc_id % 97 <> 5 GROUP BY lang)
    SELECT path AS subject, CASE WHEN doc_id % 97 = 5 THEN 'missing' WHEN doc_id % 89 = 7 THEN 'unexpected' ELSE 'changed' END AS fault FROM f WHERE doc_id % 97 = 5 AND doc_id % 89 <> 7 OR doc_id % 97 <> 5 AND (doc_id % 89 = 7 OR doc_id % 83 = 11)
    UNION ALL SELECT path, 'listed_twice' FROM f WHERE doc_id % 101 = 3 AND doc_id % 89 <> 7
    UNION ALL SELECT 'chars_' || lang, CASE WHEN lang = 'fr' THEN 'unclaimed' ELSE 'mismatch' END FROM m WHERE lang IN ('de', 'fr')
    UNION ALL SELECT 'chars_none', 'unsupported'
""")
def evl07_verifier(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a release's files, with faults planted in files, inventory and claimed metrics; every fault is found and nothing else."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.concat_ws("/", "lang", "source", "doc_id").alias("path"), F.sha2("text", 256).alias("digest"), F.col("n_chars").cast("double").alias("n_chars"))
    n = F.col("doc_id")
    actual = docs.where(n % 97 != 5)
    files = actual.select("path", F.when(n % 83 == 11, F.sha2("digest", 256)).otherwise(F.col("digest")).alias("digest"))
    inventory = docs.where(n % 89 != 7).select("path", "digest").unionByName(docs.where((n % 89 != 7) & (n % 101 == 3)).select("path", "digest"))
    found = actual.groupBy("lang").agg(F.sum("n_chars").alias("value")).select(F.concat(F.lit("chars_"), "lang").alias("metric"), "value")
    claimed = found.where("metric <> 'chars_fr'").withColumn("value", F.when(F.col("metric") == "chars_de", F.col("value") + 1).otherwise(F.col("value")))
    # One more claim, once.
    claimed = claimed.unionByName(found.limit(1).select(F.lit("chars_none").alias("metric"), F.lit(1.0).alias("value")))
    faults = evaluation.tree_faults(files, inventory).withColumnRenamed("path", "subject")
    return faults.unionByName(evaluation.metric_faults(claimed, found).select(F.col("metric").alias("subject"), "fault"))


@query(f"""
    WITH {OUTCOMES_SQL}
    SELECT question_id, CASE WHEN question_id % 11 = 0 OR question_id % 10 = 4 THEN category WHEN question_id % 7 = 0 THEN 'final' ELSE category END AS category, CASE WHEN question_id % 5 = 0 AND outcome <> 'wrong' THEN 'wrong' ELSE outcome END AS outcome, latency_ms,
           CAST(CASE WHEN question_id % 7 = 0 AND question_id % 11 <> 0 AND question_id % 10 <> 4 THEN 2 ELSE 0 END + CASE WHEN question_id % 5 = 0 AND outcome <> 'wrong' THEN 1 ELSE 0 END AS BIGINT) AS applied,
           CASE WHEN question_id % 7 = 0 AND question_id % 11 = 0 THEN 'not_what_it_was' WHEN question_id % 7 = 0 AND question_id % 10 = 4 THEN 'same_order' WHEN question_id % 13 = 0 THEN 'not_amendable' WHEN question_id % 5 = 0 AND outcome = 'wrong' THEN 'no_change' END AS violation
    FROM outc
""")
def evl08_amendments(spark: SparkSession, d: str) -> DataFrame:
    """Judged questions with amendments: chains of two that hold, that start from what wasn't there, or share a number; corrections of outcomes, and of a measure that may not be changed."""
    base = outcomes(spark, d)
    n, text = F.col("question_id"), lambda x: F.lit(x)
    one = lambda rows, order, field, before, after: rows.select("question_id", F.lit(order).alias("amendment") if isinstance(order, int) else order.alias("amendment"), F.lit(field).alias("field"), before.alias("before"), after.alias("after"))
    sevens = base.where(n % 7 == 0)
    parts = [
        one(sevens, 1, "category", F.when(n % 11 == 0, "other").otherwise(F.col("category")), text("middle")), one(sevens, F.when((n % 10 == 4) & (n % 11 != 0), 1).otherwise(2), "category", text("middle"), text("final")),
        one(base.where(n % 5 == 0), 3, "outcome", F.col("outcome"), text("wrong")), one(base.where(n % 13 == 0), 4, "latency_ms", F.col("latency_ms").cast("string"), text("0")),
    ]
    amendments = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return evaluation.amended(base, "question_id", amendments, ("category", "outcome"))
