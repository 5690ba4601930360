"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each document gets the exponential key -ln(u) / w, u a hash of its id and w its quality weight;
in the order of these keys documents are drawn without replacement with chances in proportion
to w. A source's budget buys complete epochs first, then the documents whose prefix sum of
sizes stays inside the rest. Texts are read once: what is needed of each document is stored as a
narrow row. The prefix sums come from sums over ranges of keys, so only the one range of each
source in which the budget ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelode.llm.common import stored, sums_before

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
ROWS_A_RANGE = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """From 0.25 to 1: how near the mean word length comes to six characters. 1 for texts without words."""
    mean = F.length(text) / F.nullif(size, F.lit(0))
    return F.coalesce(F.greatest(F.lit(0.25), 1 / (1 + F.abs(mean - 7) / 4)), F.lit(1.0))


def uniform(*columns: str | Column, seed: int = 1) -> Column:
    """A number inside (0, 1) that depends on the columns' values alone."""
    digest = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\x00")) for c in columns)))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Each source's target: its weight's part of share times all sizes, held to cap times its own size.

    sizes: one row (source, source_size) for each source. The excess of capped sources is dealt
    to the others by weight, and again until none is above: sources fill up in the order of
    cap / weight, so the level is found in one pass over the sources. Sources are ranked and
    summed by ranges, as there may be one for each host.
    """
    name = F.col("source").asc_nulls_last()
    rows = sums_before(sizes.select("source", "source_size"), [name], place=F.lit(1))
    rows = rows.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.lit(float(cap)) * F.col("source_size")).withColumn("fills", F.col("cap") / F.col("w")).drop("place")
    rows = sums_before(rows, [F.col("fills"), name], full=F.col("cap"), heavy=F.col("w"), place=F.lit(1))
    # One row of totals, and one of the level.
    total, heavy = rows.agg(F.sum("source_size"), F.sum("w")).first()
    left, rest = F.lit(float(share)) * F.lit(total) - F.col("full"), F.lit(heavy) - F.col("heavy")
    # The first source that doesn't fill up sets the level for itself and all after it.
    rows = rows.withColumn("level", left / rest)
    level = rows.where("level < fills").agg(F.min_by("level", "place")).first()[0]
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(level) * F.col("w"))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, key: Column | None = None, weight: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """How many words the mix takes of each document: doc_id, size, source_size, target, taken, epochs, drawn.

    Takes columns doc_id, text and source; others are ignored, whatever their names. weight is a
    positive number for each row (by default quality_weight), key a value in (0, 1).
    taken = epochs * size + the words of the last, fractional epoch, whose last document is cut
    where the budget ends; drawn says whether that epoch takes more than half of the document,
    for callers that want whole ones. A null source is a source of its own, after all others;
    null and empty texts have size 0 and taken 0; a source without words has target 0. Rows
    with one id (repeats) share a key and come next to each other; rows without id are drawn by
    their texts. An empty table gives no rows.
    """
    unnamed = F.concat(F.lit("\x00"), F.xxhash64("text").cast("string"))
    u = uniform(F.coalesce(F.col("doc_id").cast("string"), unnamed)) if key is None else key
    counted = docs.select("doc_id", "source", "text", u.alias("u"), (F.lit(None).cast("double") if weight is None else weight).alias("w"), word_count(F.col("text")).alias("size"))
    w = quality_weight(F.col("text"), F.col("size")) if weight is None else F.col("w")
    # -ln(u) / w grows as 1 - u ** (1 / w), which lies in (0, 1) and so can be cut into ranges.
    rows = stored(counted.select("doc_id", "source", "size", (1 - F.pow("u", 1 / w)).alias("key"), F.xxhash64("text").alias("tie")), "sizes")
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranges = max(int(n), -(-rows.count() // ROWS_A_RANGE))
    rows = rows.withColumn("range", F.floor(F.col("key") * ranges).cast("long"))
    summed = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    sources = targets(summed.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, cap)
    whole = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    sources = sources.withColumn("epochs", whole).withColumn("budget", F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    budget = sources.select(F.col("source").alias("s"), "source_size", "target", "epochs", "budget")
    running = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = summed.withColumn("before", F.coalesce(F.sum("range_size").over(running), F.lit(0)))
    before = before.join(budget, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # One row for each source and range; ranges that lie inside or outside the budget as a whole need no order.
    state = F.when(F.col("before") + F.col("range_size") <= F.col("budget"), 1).when(F.col("before") >= F.col("budget"), 0)
    before = before.select(F.col("source").alias("s"), F.col("range").alias("r"), "source_size", "target", "epochs", (F.col("budget") - F.col("before")).alias("left"), state.alias("state"))
    rows = rows.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    decided = rows.where("state is not null").withColumn("part", F.col("state") * F.col("size"))
    order = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "tie").rowsBetween(Window.unboundedPreceding, -1)
    sorted_rows = rows.where("state is null").withColumn("part", F.least(F.col("size"), F.greatest(F.lit(0), F.col("left") - F.coalesce(F.sum("size").over(order), F.lit(0)))))
    out = decided.unionByName(sorted_rows)
    return out.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), "epochs", (F.col("part") * 2 > F.col("size")).alias("drawn"))
