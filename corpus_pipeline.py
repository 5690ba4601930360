"""The corpus pipeline: quality, near duplicates, mixing, packing. Counted as part of the subpackage llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import gam, mixing, neardup, packing
from tracelode.llm.common import BATCH_BYTES, fresh, stored, stored_result

#: Of the near-duplicate stage: the similarity from which documents are copies, and the keys of each of its two collections.
PERCENT = 80
KEYS = 13


def _small_batches(spark: SparkSession) -> None:
    """From here on this session sends batches of a few MB to Python workers, as a batch of texts is held several times over on its way."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, with all their columns.

    The model learns from the labelled rows of this stage's own input. Null, empty and blank texts
    get the score of a text without words, very long ones are scored whole; rows that repeat, or
    have no id, are scored each by their text. An empty table stays empty; columns beside doc_id
    and text are carried, whatever their names.
    """
    _small_batches(spark)
    model = gam.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(gam.score_column(model)(F.col("text")) >= gam.THRESHOLD)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = PERCENT, keys: int = KEYS) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id. Rows without id stay only where no row of their group has one and none was kept before; repeats of a row don't.

    Decisions are joined on a number of each row: its id, or, after all ids, a hash of all its columns
    where it has no id or where its id has several texts and this isn't the first by hash. So those
    texts are documents of their own. Texts without words stay, all of them; an empty table stays
    empty; columns of any name are carried. At 80 %, 13 keys a collection miss a pair at the
    threshold with a chance of 2 * (1 - 0.8**3)**13, 0.018 %.
    """
    number, mark, digest, first, times = (fresh(docs, x) for x in ("number", "mark", "digest", "first", "times"))
    rows = docs.withColumn(mark, F.xxhash64(*docs.columns)).withColumn(digest, F.xxhash64("text"))
    texts = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias(first), F.max(digest).alias("last")).where(F.col(first) != F.col("last"))
    # Stored, so that its size is known before whole texts would be shuffled to meet it.
    several = stored(texts.select(F.col("doc_id").alias(number), first), "several")
    unnamed = F.col("doc_id").isNull() | F.coalesce(F.col(digest) != F.col(first), F.lit(False))
    # Structs are ordered by their first field, so a row with an id goes before any without.
    own = F.struct(unnamed.alias("made"), F.when(~unnamed, F.col("doc_id")).alias("id"), F.when(unnamed, F.col(mark)).alias("mark"))
    rows = rows.join(several, F.col("doc_id") == F.col(number), "left").withColumn(number, own)
    groups = neardup.near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"), percent=percent, keys=keys)
    kept = groups.where("kept").select(F.col("doc_id").alias(number)).distinct()
    # Rows of one number have one text; of those that differ elsewhere the one of the least hash stays, in each run the same.
    # That is decided without the texts, which are grouped only where the row that stays is repeated.
    marks = rows.select(number, mark).join(kept, number, "left_semi").groupBy(number, mark).agg(F.count("*").alias(times))
    least = marks.groupBy(number).agg(F.min(F.struct(mark, times)).alias(first))
    chosen = stored(least.select(number, f"{first}.{mark}", f"{first}.{times}"), "kept")
    once = rows.join(chosen.where(F.col(times) == 1), [number, mark])
    again = rows.join(chosen.where(F.col(times) > 1), [number, mark]).dropDuplicates([number, mark])
    return once.union(again).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents, a row for each time that it takes one.

    Whole documents only: a source's last one is in if more than half of it fits the budget.
    Rows are told apart by a hash of all their columns; equal ones are taken as often as the mix
    takes all of them. Rows without id are drawn by that hash, others by their id. A null source
    is a source of its own, the last; texts without words have size 0 and are taken as often as
    their place in the order asks. An empty table stays empty; columns of any name are carried.
    """
    mark, own, copies = (fresh(docs, x) for x in ("mark", "own", "copies"))
    rows = docs.withColumn(mark, F.xxhash64(*docs.columns))
    key = F.when(F.col("doc_id").isNull(), mixing.uniform(mark)).otherwise(mixing.uniform("doc_id"))
    known = rows.select(F.col(mark).alias("doc_id"), "text", "source", key.alias("key"))
    plan = stored(mixing.mix(known, key=F.col("key")), "mix")
    plan = plan.groupBy(F.col("doc_id").alias(own)).agg(F.sum(F.col("epochs") + F.col("drawn").cast("int")).cast("int").alias(copies)).where(F.col(copies) > 0)
    taken = rows.dropDuplicates([mark]).join(plan, F.col(mark) == F.col(own))
    return taken.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of at most 2048 tokens, with their ids.

    A null or empty text is one end id; a text longer than a sequence is cut into pieces, none
    lost; repeated rows are packed each. An empty table gives no pieces. Columns beside doc_id
    and text are not read.
    """
    _small_batches(spark)
    return packing.pack_documents(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A trained model, minhash components and token ids aren't expressible in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each result is written to the shared folder and read again, and what a stage stored beside it is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored_result(name)(stage)(spark, docs, sf_dir)
    return STAGES[-1][1](spark, docs, sf_dir)
