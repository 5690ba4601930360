"""Exact top-k inner products by tiled matrix products and a tree of merges.

Rows are packed into shards, and queries into blocks, of whole matrices in the smallest integer
type that holds them. Each shard meets each block once; a task multiplies tile by tile and keeps
k rows of a query for each shard, and a tree of merges, as deep as the shards ask for, keeps k.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracelode.llm.common import stored

TILE = 2048
#: Queries of a matrix product: TILE * QUERY_TILE scores of 8 bytes are in memory at a time.
QUERY_TILE = 512
#: A block of queries takes so many bytes at most, as 64-bit integers.
BLOCK_BYTES = 64 << 20
#: A task takes so many shards at most.
TASK_SHARDS = 32
FAN_IN = 16
SCALE = 1024
LONG = (1 << 63) - 1


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """Each component x as floor(scale * x), x a double; null where a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))))


def packed(vectors) -> tuple[bytes, int, int]:
    """Vectors, shorter ones padded with zeros, as one matrix: its bytes, the bytes of a component, and its width."""
    matrix = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for i, v in enumerate(vectors):
        matrix[i, : len(v)] = v
    most = max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)) - 1)
    size = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return matrix.astype(f"<i{size}").tobytes(), size, matrix.shape[1]


def unpacked(data: bytes, size: int, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{size}").reshape(rows, width)


PACKED = "ids binary, vectors binary, size int, width int"


def _packed_row(ids, vectors) -> dict:
    data, size, width = packed(list(vectors))
    return {"ids": [np.asarray(ids, "<i8").tobytes()], "vectors": [data], "size": [size], "width": [width]}


def _tiles(rows: DataFrame, size: int) -> DataFrame:
    """Packs rows (id, vector) into shards of size; a task's rest is a shard too."""
    def pack(batches):
        from pyspark import TaskContext

        shard, held = TaskContext.get().partitionId() << 32, None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held) >= size:
                part, held = held.iloc[:size], held.iloc[size:]
                yield pd.DataFrame({"shard": [shard], **_packed_row(part["id"], part["vector"])})
                shard += 1
        if held is not None and len(held):
            yield pd.DataFrame({"shard": [shard], **_packed_row(held["id"], held["vector"])})

    return rows.mapInPandas(pack, f"shard long, {PACKED}")


def scores(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where no sum can reach 2**53, else in Python's integers, held to 64 bits."""
    most = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(shard.astype(float)).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(float) @ shard.astype(float).T).astype(np.int64)
    exact = queries.astype(object) @ shard.astype(object).T
    return np.clip(exact, -LONG - 1, LONG).astype(np.int64)


def best_of(query: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list of (query, id, score) each query's k best, ties to the smaller id."""
    # ~ turns the order of integers without overflow.
    order = np.lexsort((ids, ~values, query))
    query, ids, values = query[order], ids[order], values[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(query)) + 1)) if len(query) else np.zeros(0, np.int64)
    keep = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) < k
    return query[keep], ids[keep], values[keep]


def tile_best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, shard: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of one shard: (query, id, score). Ties to the smaller id; a query's own id takes no part."""
    width = max(queries.shape[1], shard.shape[1])
    queries, shard = (np.pad(x.astype(np.int64), ((0, 0), (0, width - x.shape[1]))) for x in (queries, shard))
    product, own = scores(queries, shard), query_ids[:, None] == ids
    product[own] = -LONG - 1
    few = len(ids) - k
    # What reaches a row's k-th greatest value; all, where there are fewer.
    least = np.partition(product, few, axis=1)[:, few] if few > 0 else np.full(len(product), -LONG - 1)
    row, column = np.nonzero((product >= least[:, None]) & ~own)
    return best_of(query_ids[row], ids[column], product[row, column], k)


def _merged(lists: DataFrame, k: int, *group: str) -> DataFrame:
    """The k best of each query and group."""
    order = Window.partitionBy("query_id", *group).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, tile: int = TILE, query_block: int | None = None, fan_in: int = FAN_IN, task_shards: int = TASK_SHARDS) -> DataFrame:
    """For each query row its k greatest inner products among all other rows, ties to smaller ids.

    Takes columns vec_id and embedding; is_query is a condition on vec_id. Other columns are
    ignored, whatever their names. Rows with a null id, a null vector or a null or non-finite
    component take no part; shorter vectors count as padded with zeros; scores beyond 64 bits
    are held to the limits. A query's own id is no candidate, also where rows repeat; other
    rows that repeat an id each count, and a query that repeats takes its smallest vector. A query with fewer than k
    candidates returns all; an empty table none.

    A block holds as many queries as fit into BLOCK_BYTES (or query_block), so shards are copied
    once for each so many queries; blocks are copied once for each task of at most TASK_SHARDS
    shards, which merges their lists. Lists of FAN_IN tasks merge at a time, on as many levels as there are
    tasks for, so none gets more than about FAN_IN * k rows of a query.
    """
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = "id is not null and vector is not null"
    rows = vectors.select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("vector")).where(known)
    queries = vectors.where(is_query).select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("vector")).where(known)
    queries = stored(queries.groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    counted = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    block = query_block or max(QUERY_TILE, BLOCK_BYTES // (8 * max(1, counted["width"])))
    blocks = max(1, -(-counted["n"] // block))
    shards = stored(_tiles(rows, tile), "shards")
    n_shards = shards.count()
    salts = max(1, min(n_shards, n), -(-n_shards // task_shards))
    salt = lambda: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))

    def pack(key, pdf):
        return pd.DataFrame({"block": [key[0]], **_packed_row(pdf["id"], pdf["vector"])})

    asked = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("block").applyInPandas(pack, f"block long, {PACKED}")
    asked = stored(asked, "blocks").withColumn("salt", salt())
    dealt = shards.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(salts))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("query_id", "g", "vec_id", "score")])

    def matrix(r) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(r.ids, "<i8")
        return ids, unpacked(r.vectors, r.size, r.width, len(ids))

    def products(key, own: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        none = (np.zeros(0, np.int64),) * 3
        out = [none]
        for q in own.itertuples():
            q_ids, q_vectors = matrix(q)
            for at in range(0, len(q_ids), QUERY_TILE):
                # Lists of this task's shards merge here: k rows of a query go on, whatever the number of shards.
                best = none
                for r in tiles.itertuples():
                    ids, shard = matrix(r)
                    found = tile_best(q_ids[at : at + QUERY_TILE], q_vectors[at : at + QUERY_TILE], ids, shard, k)
                    best = best_of(*map(np.concatenate, zip(best, found, strict=True)), k)
                out.append(best)
        query, vec, score = map(np.concatenate, zip(*out, strict=True))
        return pd.DataFrame({"query_id": query, "g": np.full(len(query), key[1]), "vec_id": vec, "score": score})

    lists = asked.groupBy("block", "salt").cogroup(dealt.groupBy("block", "salt")).applyInPandas(products, schema)
    # Each task's number, its digits to the base fan_in being its way through the tree.
    levels = max(1, math.ceil(math.log(max(2, salts), fan_in)))
    for level in range(levels - 1, 0, -1):
        lists = _merged(lists.withColumn("g", F.pmod("g", F.lit(fan_in**level))), k, "g").drop("rank")
    return _merged(lists.drop("g"), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
