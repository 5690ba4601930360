"""Steps on whole tables that several operators need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 1 << 16
#: Tables counted to at most so many rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see; where none is configured, one of this machine's in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tracelode-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: the plan is cut, and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if its counted rows are at most so many; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df


def running_sum(df: DataFrame, keys: list[str], index: str, value: Column, name: str, chunk: int = CHUNK, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds the sum of value over a key's rows up to this one by index, then ties, without one task for a large key.

    The index is cut into ranges; sums of ranges are prefix-summed by key, and rows only
    within their range.
    """
    rows = df.withColumn("_value", value).withColumn("_chunk", F.floor(F.col(index) / chunk))
    sums = rows.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(index, *ties).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(sums, [*keys, "_chunk"])
    return joined.withColumn(name, (F.col("_before") + F.sum("_value").over(inside)).cast("long")).drop("_value", "_chunk", "_before")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group. Each task keeps k rows of a group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("int")).where(F.col(name) <= k)


def jumps(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Follows edges (node, next), one at most out of each node, to their ends by doubling.

    Gives (node, tip, depth, cyclic): the sink that a node reaches and how many steps it takes;
    sinks are their own tips at depth 0. Nodes that lead into a cycle are cyclic and have no
    tip. The number of joins is the logarithm of the longest chain, cycles or not: places that
    are reached grow fewer by each step until they are those on cycles, and stay so many then.
    """
    edges = edges.select("node", "next")
    nodes = edges.select("node").union(edges.select(F.col("next").alias("node"))).distinct()
    leaves = edges.select(F.col("node").alias("tip")).distinct().withColumn("going", F.lit(True))
    state = nodes.join(edges, "node", "left").select("node", F.coalesce("next", "node").alias("tip"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    state = stored(state.join(leaves, "tip", "left").select("node", "tip", "depth", F.coalesce("going", F.lit(False)).alias("going")), "jumps")
    # Nodes that have arrived are not written again.
    arrived, active, before = state.where("not going"), state.where("going"), None
    for _ in range(rounds):
        tips = active.agg(F.count_distinct("tip")).first()[0]
        if tips in (0, before):
            break
        before = tips
        far = arrived.unionByName(active).select(F.col("node").alias("tip"), F.col("tip").alias("far"), F.col("depth").alias("more"), F.col("going").alias("goes"))
        moved = stored(active.join(far, "tip").select("node", F.col("far").alias("tip"), (F.col("depth") + F.col("more")).alias("depth"), F.col("goes").alias("going")), "jumps")
        arrived, active = arrived.unionByName(moved.where("not going")), moved.where("going")
    return arrived.unionByName(active).select("node", F.when(~F.col("going"), F.col("tip")).alias("tip"), F.when(~F.col("going"), F.col("depth")).alias("depth"), F.col("going").alias("cyclic"))
