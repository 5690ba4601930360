"""What several operators need: the shared folder, checkpoints, prefix sums over a total order."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is configured, one of this machine's in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tracelode-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it differ from all columns of df in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Of each call of an operator that is under way: paths of the tables it stored. Threads have a value each.
_steps: ContextVar[list[str] | None] = ContextVar("steps", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    steps = _steps.get()
    if steps is not None:
        steps.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch that goes to a Python worker. Text columns of both sides of a pair are in it, on the JVM's side in buffers of up to twice the size.
BATCH_BYTES = "8m"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, what runs sends batches of ``BATCH_BYTES`` to Python workers; then the session's limit holds again."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored_result(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Of a function that returns a DataFrame: its result is stored under the name, and what this call stored on the way is deleted, nobody else's."""
    def around(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(make)
        def call(*args, **options) -> DataFrame:
            paths: list[str] = []
            spark, mine = SparkSession.active(), _steps.set(paths)
            try:
                with small_batches(spark):
                    result = make(*args, **options)
                    _steps.reset(mine)
                    result = stored(result, name)
            finally:
                if _steps.get() is paths:
                    _steps.reset(mine)
                for path in paths:
                    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            return result

        return call

    return around


def joined(left: DataFrame, right: DataFrame, on: list[str], rows: str, how: str = "inner", many: int = 50_000) -> DataFrame:
    """left joined with right, which has one row for each key and in ``rows`` how many rows of left have it (dropped from the result).

    Keys of more than ``many`` rows of left are broadcast, so none of them is one task's: there
    are at most the rows of left over ``many`` of them. The others meet by a shuffle.
    how: inner, or left, where rows of left without a key in right stay.
    """
    heavy = right.where(F.col(rows) > many).drop(rows)
    light = right.where(F.col(rows) <= many).drop(rows)
    if heavy.isEmpty():
        return left.join(light, on, how)
    apart = left.join(F.broadcast(heavy), on, "inner")
    return apart.unionByName(left.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on, how))


def spread(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Ordered by range over as many partitions as shuffles use, sorted inside each."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *columns).sortWithinPartitions(*columns)


def sums_before(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Adds to each row, by name, the sums of the given columns over all rows before it in the order, with DataFrame functions only.

    The rows are sorted by range and stored with their partition; a row's sum is that of the
    partitions before it and of the rows before it in its own. Rows that tie come in any order.
    """
    part = fresh(df, "_part")
    rows = stored(spread(df, *order).withColumn(part, F.spark_partition_id()), "sorted")
    firsts = rows.groupBy(part).agg(*(F.sum(c).alias(f"_first_{x}") for x, c in sums.items()))
    # One row for each partition of the sort.
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select(part, *(F.coalesce(F.sum(f"_first_{x}").over(before), F.lit(0)).alias(f"_first_{x}") for x in sums))
    own = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(F.broadcast(firsts), part)
    return joined.select(*df.columns, *((F.col(f"_first_{x}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(x) for x, c in sums.items()))


def numbered(df: DataFrame, *columns: str | Column, rank: str = "rank") -> DataFrame:
    """Adds a gapless rank from 0 in the order of the columns, without a window over all rows.

    The rows are sorted by range and counted by partition; a partition's first rank is the
    sum of the counts before it. The sorted rows are stored, so a lost executor can't change
    the order between the two passes.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_row", T.LongType())])

    def count(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            columns = [*batch.columns, pa.array(np.full(batch.num_rows, part, "int32")), pa.array(np.arange(n, n + batch.num_rows))]
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_part", "_row"])

    rows = stored(spread(df, *columns).mapInArrow(count, schema), "ranked")
    firsts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row for each partition of the sort.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    joined = rows.join(F.broadcast(firsts), "_part")
    return joined.withColumn(rank, F.col("_first") + F.col("_row")).drop("_part", "_row", "_first")
