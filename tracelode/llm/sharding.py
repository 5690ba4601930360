"""Sharding along a Hilbert curve over quantised metadata, cut into runs of equally many rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.llm.common import numbered, stored, sums_before

SHARDS = 40
BITS = 4


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point (a row of cell numbers below 2**bits) on the Hilbert curve of its dimensions.

    The bit-transposition form: from the highest bit down, undo each level's exchange or
    inversion of the axes, then read the Gray code across the axes.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            high = (x[i] & level) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        flip ^= np.where((x[-1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


def boundaries(df: DataFrame, name: str, cells: int) -> list[tuple]:
    """(first value, cell) for each of a column's quantile cells: a value's cell is cells times the share of rows before it.

    Rows are counted by value, and the counts summed in order over ranges of values, so this
    is exact and doesn't depend on how rows are dealt. Nulls come first; one row a cell comes here.
    """
    n = df.count()
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    known = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = sums_before(counts, [F.col("value")], before=F.col("n"))
    place = F.floor((F.col("before") + F.lit(n - known)) * F.lit(cells) / F.lit(n)).cast("int")
    return sorted((x.value, x.cell) for x in counts.groupBy(place.alias("cell")).agg(F.min("value").alias("value")).collect())


def quantise(df: DataFrame, dimensions: tuple[str, ...], bits: int = BITS) -> DataFrame:
    """Adds each dimension's cell by quantiles over all rows, below 2**bits: an array column cells. Nulls are in cell 0."""
    def cell(name: str) -> Column:
        out = F.lit(0)
        for value, place in boundaries(df, name, 1 << bits):
            out = F.when(F.col(name) >= F.lit(value), place).otherwise(out)
        return out

    return df.withColumn("cells", F.array(*(cell(name) for name in dimensions)))


def shard_by_hilbert(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Deals documents into shards of equally many rows (at most one apart) along the curve.

    Takes columns doc_id, text, lang and source; others are ignored, whatever their names. The
    curve runs over source, lang and size, each in 2**bits quantile cells of whole values, so files of
    a run span few values of each. Inside a cell rows are in the order of their texts' hashes, so equal texts
    of one source and lang stand together, then ids in order. Null sources and langs
    come first in their dimension; null texts have size 16 and crc 0. Repeated rows each get a slot. With fewer
    rows than shards the last shards are empty; an empty table gives no rows.
    """
    @F.pandas_udf("long")
    def curve(cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert(np.stack(cells.to_numpy()), bits) if len(cells) else np.zeros(0, np.int64))

    rows = stored(docs.select(
        "doc_id", "source", "lang",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")).alias("text_crc32"),
        F.xxhash64("text").alias("same"),
    ), "metadata")
    rows = quantise(rows, ("source", "lang", "size"), bits)
    rows = rows.select("doc_id", "size", "text_crc32", "same", curve("cells").alias("place"))
    ranked = numbered(rows, "place", "same", "doc_id")
    n = F.lit(ranked.count()).cast("long")
    # Row r of n goes to the shard s with s * n / shards <= r: the first n % shards runs are one longer.
    small, longer = F.floor(n / shards).cast("long"), n % shards
    head = (small + 1) * longer
    rank = F.col("rank")
    shard = F.when(rank < head, F.floor(rank / (small + 1))).otherwise(longer + F.floor((rank - head) / F.greatest(small, F.lit(1)))).cast("int")
    first = F.when(F.col("shard") < longer, F.col("shard") * (small + 1)).otherwise(head + (F.col("shard") - longer) * small)
    return ranked.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (rank - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("place").alias("hilbert"),
    )
