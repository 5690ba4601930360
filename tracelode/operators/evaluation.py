"""Evaluation reducers: accuracies, retrieval metrics, paired arms, repeats, usage, claims and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelode.functions import columns as C
from tracelode.functions.tables import top_per_group

DIGITS = 6


def rate(part: Column, whole: Column, digits: int = DIGITS) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def accuracy(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of correct, wrong and infrastructure failures, and correct's share of those judged; null if none was."""
    sums = [F.count("*").alias("n"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("correct", "wrong", "infrastructure_failure"))]
    rows = outcomes.groupBy(*by).agg(*sums) if by else outcomes.agg(*sums)
    return rows.withColumn("accuracy", rate(F.col("correct"), F.col("correct") + F.col("wrong")))


def weighted_accuracy(outcomes: DataFrame, weights: DataFrame, by: str) -> DataFrame:
    """sum(w * a) / sum(w) over the categories that have an accuracy."""
    rows = accuracy(outcomes, [by]).where("accuracy is not null").withColumn("_a", F.col("correct") / (F.col("correct") + F.col("wrong"))).join(weights, by)
    return rows.agg(F.round(F.try_divide(F.sum(F.col("weight") * F.col("_a")), F.sum("weight")), DIGITS).alias("weighted_accuracy"), F.count("*").alias("categories"))


def majority(votes: DataFrame, item: str, vote: str = "vote") -> DataFrame:
    """Whether at least two of an item's votes are yes."""
    return votes.groupBy(item).agg(F.count("*").alias("votes"), (F.count_if(vote) >= 2).alias("correct"))


def retrieval_metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over queries (relevant, ranked: arrays of ids) of recall at 1 and 5, any-hit and precision at 5, and reciprocal rank."""
    at = lambda k: F.size(F.array_intersect(F.slice("ranked", 1, k), F.col("relevant")))
    n = F.size("relevant")
    hits = F.transform("ranked", lambda x: F.array_contains(F.col("relevant"), x))
    first = F.array_position(hits, F.lit(True))
    rows = results.withColumns({
        "_r1": at(1) / n, "_r5": at(5) / n, "_hit": (at(5) > 0).cast("double"), "_p5": F.try_divide(at(5), F.least(F.lit(5), F.size("ranked"))), "_rr": F.when(first > 0, 1 / first).otherwise(0.0)})
    means = [F.round(F.avg(c), DIGITS).alias(name) for name, c in (("recall_at_1", "_r1"), ("recall_at_5", "_r5"), ("hit_at_5", "_hit"), ("precision_at_5", "_p5"), ("mrr", "_rr"))]
    return rows.groupBy(*by).agg(F.count("*").alias("queries"), *means) if by else rows.agg(F.count("*").alias("queries"), *means)


def retrieval_gate(metrics: DataFrame, p95_ms: Column) -> DataFrame:
    """The retrieval gate's rules as booleans, and whether all hold."""
    rows = metrics.withColumns({"recall_ok": F.col("recall_at_5") >= 0.9, "latency_ok": p95_ms <= 4000})
    return rows.withColumn("passed", F.col("recall_ok") & F.col("latency_ok"))


def gate_outcomes(queries: DataFrame, relevant: DataFrame, found: DataFrame, sources: DataFrame) -> DataFrame:
    """What recall gave each query of a gate run, those with no result too.

    queries: query_id, query_kind (positive or hard_negative); relevant: query_id, memory_id; found:
    recall's rows; sources: memory_id, status, source_uri, content_sha256 of what is stored. Gives
    query_id, query_kind, injected (admitted memories), hits, recalled, precision (hits over
    injected, 0 without any), provenance_covered (every injected one has an address and a digest) and
    stale (injected ones that aren't active; one that isn't stored is neither active nor covered).
    """
    given = found.where("admitted").select("query_id", "memory_id")
    right = relevant.select("query_id", "memory_id").distinct().withColumn("_hit", F.lit(True))
    rows = given.join(right, ["query_id", "memory_id"], "left").join(sources.select("memory_id", F.struct("status", "source_uri", "content_sha256").alias("_s")), "memory_id", "left")
    covered = (F.coalesce(F.col("_s.source_uri"), F.lit("")) != "") & (F.coalesce(F.col("_s.content_sha256"), F.lit("")) != "")
    each = rows.groupBy("query_id").agg(
        F.count("*").alias("injected"), F.count_if(F.coalesce("_hit", F.lit(False))).alias("hits"), F.every(covered).alias("provenance_covered"), F.count_if(~F.col("_s.status").eqNullSafe("active")).alias("stale"))
    rows = queries.select("query_id", "query_kind").join(each, "query_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("injected", "hits", "stale")})
    return rows.select(
        "query_id", "query_kind", "injected", "hits", (F.col("hits") > 0).alias("recalled"), F.round(F.coalesce(F.try_divide("hits", "injected"), F.lit(0.0)), DIGITS).alias("precision"),
        F.coalesce("provenance_covered", F.lit(True)).alias("provenance_covered"), "stale")


def gate_report(outcomes: DataFrame) -> DataFrame:
    """One row over a gate run's outcomes: counts, means, and each rule as a boolean; a mean over no query is null and its rule false."""
    positive, negative = F.col("query_kind") == "positive", F.col("query_kind") == "hard_negative"
    mean = lambda kind, value: F.round(F.avg(F.when(kind, value.cast("double"))), DIGITS)
    rows = outcomes.agg(
        F.count("*").alias("queries"), F.count_if(positive).alias("positives"), F.count_if(negative).alias("hard_negatives"), mean(positive, F.col("recalled")).alias("recall_at_limit"), mean(positive, F.col("precision")).alias("precision_at_limit"),
        mean(positive, F.col("provenance_covered")).alias("provenance_coverage"), F.coalesce(F.sum(F.when(positive, F.col("stale"))), F.lit(0)).alias("stale_leakage"),
        mean(negative, F.col("injected") > 0).alias("any_injection_rate"), mean(negative, F.col("injected")).alias("mean_irrelevant"))
    rules = {
        "recall_ok": F.col("recall_at_limit") >= 0.9, "provenance_ok": F.col("provenance_coverage") == 1, "stale_ok": F.col("stale_leakage") == 0, "injection_ok": F.col("any_injection_rate") <= 0.05, "irrelevant_ok": F.col("mean_irrelevant") <= 0.05}
    rows = rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in rules.items()})
    return rows.withColumn("passed", F.forall(F.array(*rules), lambda x: x))


def arms(runs: DataFrame) -> DataFrame:
    """Per arm: planned, passed, failed and infrastructure failures, pass rate, means and sums of tokens where both are known."""
    done = F.col("outcome").isin("passed", "failed")
    tokens = F.when(F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull(), F.col("input_tokens") + F.col("output_tokens"))
    rows = runs.groupBy("arm").agg(
        F.count("*").alias("planned"), F.count_if(done).alias("completed"), F.count_if(F.col("outcome") == "passed").alias("passed"), F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(~done).alias("infrastructure"), F.sum(tokens).alias("tokens"), F.round(F.avg("steps"), DIGITS).alias("mean_steps"))
    return rows.withColumn("pass_rate", rate(F.col("passed"), F.col("completed")))


def paired(runs: DataFrame, keys: list[str], off: str = "off", on: str = "on") -> DataFrame:
    """Runs of both arms on one task and repeat: how many pairs, and who passed."""
    side = lambda arm: runs.where(F.col("arm") == arm).select(*keys, (F.col("outcome") == "passed").alias(f"{arm}_passed"))
    rows = side(off).join(side(on), keys)
    a, b = F.col(f"{off}_passed"), F.col(f"{on}_passed")
    return rows.agg(F.count("*").alias("pairs"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_off"), F.count_if(~a & b).alias("only_on"), F.count_if(~a & ~b).alias("neither"))


def repeats(steps: DataFrame, run: str, item: str, name: str) -> DataFrame:
    """How often a run did again what it had done: the sum over items of count - 1."""
    counts = steps.where(F.col(item).isNotNull()).groupBy(run, item).agg(F.count("*").alias("_c"))
    return counts.groupBy(run).agg(F.sum(F.greatest(F.col("_c") - 1, F.lit(0))).alias(name))


def steps_increase(steps: DataFrame, run: str, step: str, order: str) -> DataFrame:
    """(run, ordered): whether a run's step numbers strictly increase in their order."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(run).orderBy(order)
    rows = steps.withColumn("_before", F.lag(step).over(w))
    return rows.groupBy(run).agg(F.bool_and(F.coalesce(F.col(step) > F.col("_before"), F.lit(True))).alias("ordered"))


def merge_usage(base: DataFrame, repair: DataFrame, fields: list[str]) -> DataFrame:
    """Usage reports as one: each field summed over both, null where neither has it, rounded to 8 digits."""
    rows = base.select(*fields).unionByName(repair.select(*fields))
    return rows.agg(*(F.round(F.sum(f), 8).alias(f) for f in fields))


def compose_repair(base: DataFrame, repair: DataFrame, key: str) -> DataFrame:
    """Failed rows of a run replaced by those of its repair run; a repair that isn't exactly the failed rows is an error."""
    failed = base.where("outcome = 'infrastructure_failure'").select(key)
    wrong = failed.exceptAll(repair.select(key)).unionByName(repair.select(key).exceptAll(failed))
    guard = wrong.agg((F.count("*") == 0).alias("_exact"))
    fixed = repair.select(key, F.struct(*(c for c in base.columns if c != key)).alias("_r"))
    rows = base.join(fixed, key, "left").join(F.broadcast(guard))
    checked = F.when(F.col("_exact"), F.lit(True)).otherwise(F.raise_error(F.lit("repair must hold exactly the failed rows")).cast("boolean"))
    return rows.where(checked).select(key, *(F.when(F.col("_r").isNotNull(), F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c) for c in base.columns if c != key))


def stratified(rows: DataFrame, category: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each category by the order of sha256(seed, NUL, id): the same ones in every run."""
    draw = F.sha2(F.concat(F.lit(seed), F.lit("\0"), F.col(key).cast("string")), 256)
    return top_per_group(rows.withColumn("_draw", draw), [category], [F.col("_draw"), F.col(key)], n).drop("_draw")


def collection_digest(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """An order-free digest of each group's rows: their hashes are summed in four parts, so a group of any size needs no list."""
    h = F.sha2(value, 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *(p.cast("string") for p in parts)), 256).alias("digest"))


def claims(row: DataFrame, measures: dict[str, tuple[str, str]]) -> DataFrame:
    """Claims from one row of measures, as rows (claim, kind, value): name -> (kind, expression), rounded to 4 digits."""
    each = [F.struct(F.lit(name).alias("claim"), F.lit(kind).alias("kind"), F.round(F.expr(e).cast("double"), 4).alias("value")) for name, (kind, e) in measures.items()]
    return row.select(F.inline(F.array(*each)))


def thresholds(answers: DataFrame, share: float) -> DataFrame:
    """Per question: answers, passes, whether the share holds; and per question whether each participant's answers all passed."""
    rows = answers.groupBy("question").agg(F.count("*").alias("answers"), F.count_if("passed").alias("passes"), F.every("passed").alias("all_passed"))
    return rows.withColumn("met", F.col("passes") >= F.col("answers") * share)


def continuity(rows: DataFrame) -> DataFrame:
    """Captured, recalled and injected ids (arrays) of each run: what went all the way, and whether each step only narrows."""
    went = F.array_intersect(F.array_intersect("captured", "recalled"), "injected")
    return rows.withColumns({"continuous": F.array_sort(went), "narrows": (F.size(F.array_except("injected", "recalled")) == 0) & (F.size(F.array_except("recalled", "captured")) == 0)})


def tree_digest(files: DataFrame, root: str) -> DataFrame:
    """One digest over a folder's files (path, content): sorted relative paths with their digests."""
    rows = files.select(F.replace("path", F.lit(root), F.lit("")).alias("p"), F.sha2("content", 256).alias("s"))
    # A line of each file; a release folder has few.
    return rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "s"))), lambda x: F.concat(x["p"], F.lit("\0"), x["s"], F.lit("\n"))), ""), 256).alias("digest"), F.count("*").alias("files"))


def percentiles(rows: DataFrame, column: str, ps: tuple[float, ...], by: list[str]) -> DataFrame:
    """Nearest-rank percentiles p50, p95, ... of a column."""
    return rows.groupBy(*by).agg(*(C.nearest_rank(column, p).alias(f"p{round(100 * p)}") for p in ps))


def folder_digests(files: DataFrame) -> DataFrame:
    """(folder, files, digest) of each folder of (path, digest): over all that lies below it, at any depth, in any order."""
    steps = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    mark = F.xxhash64("path", "digest").cast("decimal(38,0)")
    return files.select(F.explode(folders).alias("folder"), mark.alias("mark")).groupBy("folder").agg(F.count("*").alias("files"), F.sum("mark").alias("digest"))


def tree_faults(actual: DataFrame, inventory: DataFrame) -> DataFrame:
    """(path, fault) where files (path, digest) aren't what an inventory says: missing, unexpected, changed, or listed_twice.

    Folders' digests are compared first, from the whole down: files are compared only where all
    folders above them differ, so what is the same is read no further than its digests.
    """
    one, other = folder_digests(actual), folder_digests(inventory)
    differ = one.withColumnRenamed("digest", "a").withColumnRenamed("files", "m").join(other, "folder", "full").where("not (a <=> digest) or not (m <=> files)").select("folder")
    # A path's own folder differs exactly if all above it do, as each digest is over all below.
    parent = F.regexp_replace("path", "(^|/)[^/]*$", "")
    near = lambda rows: rows.withColumn("folder", parent).join(differ, "folder", "left_semi").drop("folder")
    twice = inventory.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("listed_twice").alias("fault"))
    a = near(actual).select("path", F.col("digest").alias("a"), F.lit(True).alias("is"))
    b = near(inventory).groupBy("path").agg(F.min("digest").alias("b")).withColumn("listed", F.lit(True))
    fault = F.when(F.col("is").isNull(), "missing").when(F.col("listed").isNull(), "unexpected").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, "path", "full").select("path", fault.alias("fault")).where("fault is not null").unionByName(twice)


def metric_faults(claimed: DataFrame, recomputed: DataFrame, digits: int = 6) -> DataFrame:
    """(metric, fault, claimed, recomputed) of metrics (metric, value) that don't hold: mismatch, unclaimed or unsupported."""
    rows = claimed.select("metric", F.col("value").alias("claimed"), F.lit(True).alias("_c")).join(recomputed.select("metric", F.col("value").alias("recomputed"), F.lit(True).alias("_r")), "metric", "full")
    same = F.round("claimed", digits).eqNullSafe(F.round("recomputed", digits))
    fault = F.when(F.col("_c").isNull(), "unclaimed").when(F.col("_r").isNull(), "unsupported").when(~same, "mismatch")
    return rows.select("metric", fault.alias("fault"), "claimed", "recomputed").where("fault is not null")


def amended(base: DataFrame, key: str, amendments: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The base with its amendable fields as later records leave them, how many held, and the rule that the first bad one breaks.

    amendments: amendment (their order), the key, field, before, after (strings). One holds if it
    names an amendable field, changes it, has a number of its own for it, and before is what the field
    held: the base's value, or what the amendment before it left. Of a field whose chain breaks
    anywhere nothing is replaced. Gives the base's columns, applied and violation: not_amendable,
    no_change, same_order or not_what_it_was. Records of amendments that the base lacks: see unknown_records.
    """
    known = F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f).cast("string"))))
    rows = amendments.join(base.select(key, known.alias("_now")), key)
    # Amendments of one field of one record, which are few.
    order = Window.partitionBy(key, "field").orderBy("amendment", "before", "after")
    held = F.coalesce(F.lag("after").over(order), F.element_at("_now", F.col("field")))
    bad = (
        F.when(~F.col("field").isin(*fields), "not_amendable").when(F.col("before").eqNullSafe(F.col("after")), "no_change").when(F.lag("amendment").over(order) == F.col("amendment"), "same_order")
        .when(~held.eqNullSafe(F.col("before")), "not_what_it_was"))
    rows = rows.select(key, "field", "amendment", "after", bad.alias("bad"))
    chains = rows.groupBy(key, "field").agg(F.max_by("after", "amendment").alias("after"), F.count("*").alias("n"), F.min_by("bad", F.when(F.col("bad").isNotNull(), F.col("amendment"))).alias("bad"))
    each = chains.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("bad").isNull(), F.struct("field", "after")))).alias("_new"), F.sum(F.when(F.col("bad").isNull(), F.col("n")).otherwise(0)).alias("applied"),
        F.min(F.struct(F.col("bad").isNull(), "field", "bad"))["bad"].alias("violation"))
    out = base.join(each, key, "left")
    value = lambda f: F.when(F.map_contains_key("_new", f), F.element_at("_new", f).cast(base.schema[f].dataType)).otherwise(F.col(f)).alias(f)
    return out.select(*(value(c) if c in fields else c for c in base.columns), F.coalesce("applied", F.lit(0)).cast("long").alias("applied"), "violation")


def unknown_records(base: DataFrame, key: str, amendments: DataFrame) -> DataFrame:
    """Amendments of records that the base doesn't have."""
    return amendments.join(base.select(key), key, "left_anti")
