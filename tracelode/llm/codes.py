"""Vector code compression: product codes of integer vectors, their nearest entries found through segment-mean lower bounds.

A vector is cut into parts, each of which gets the index of its codebook's nearest entry. A
part is described by the sums of its blocks and the norm of what is left once the blocks'
means are taken out. For x and an entry c the squared distance is at least
sum of (Sx - Sc)^2 / m over blocks of m components, plus (Rx - Rc)^2 of the residual norms.
One block rules out most entries, finer blocks most of the others; what is left gets exact
integer distances, so the filter never changes a result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.common import joined, stored, stored_result

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Blocks of a part at each level of the filter.
LEVELS = (1, 4, 8)
ROWS = 1024
#: Bounds are lowered by so much of both squared norms, far more than rounding can raise them.
SLACK = 1e-9


def _described(x: np.ndarray, blocks: int) -> np.ndarray:
    """Of each row of integers: its blocks' sums over the square root of their size, and the norm of the residual."""
    edges = np.array([0, *np.cumsum([len(p) for p in np.array_split(np.arange(x.shape[1]), blocks)])])
    sizes, sums = np.diff(edges), np.add.reduceat(x, edges[:-1], axis=1)
    # Each block's residual is an integer over its size, so nothing cancels in floating point.
    rest = (sizes * np.add.reduceat(x * x, edges[:-1], axis=1) - sums * sums) / sizes
    return np.column_stack([sums / np.sqrt(sizes), np.sqrt(rest.sum(axis=1))])


class Codebook:
    """The entries of one part, with their descriptions."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.levels = [min(b, max(1, entries.shape[1])) for b in LEVELS]
        self.described = [_described(entries, b) for b in self.levels] if entries.shape[1] else []
        self.norms = (entries * entries).sum(axis=1).astype(np.float64)
        self.exact = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row: the index of the nearest entry, the lowest of equals, and the squared distance."""
        if not x.shape[1]:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for i in range(0, len(x), ROWS):
            index[i : i + ROWS], distance[i : i + ROWS] = self._nearest(x[i : i + ROWS])
        return index, distance

    def _distance(self, x: np.ndarray, rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
        self.exact += len(rows)
        step = x[rows] - self.entries[entries]
        return np.einsum("ij,ij->i", step, step)

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = np.arange(len(x))
        slack = SLACK * ((x * x).sum(axis=1).astype(np.float64)[:, None] + self.norms)
        own = _described(x, self.levels[0])
        least = sum((own[:, j, None] - self.described[0][:, j]) ** 2 for j in range(own.shape[1])) - slack
        # The entry of the least bound is near enough to rule out most others.
        best = self._distance(x, every, least.argmin(axis=1))
        rows, entries = np.nonzero(least <= best[:, None])
        for blocks, described in zip(self.levels[1:], self.described[1:], strict=True):
            step = _described(x, blocks)[rows] - described[entries]
            bound = np.einsum("ij,ij->i", step, step) - slack[rows, entries]
            # Rows are in order and each has a candidate; that of its least bound tightens what the others have to meet.
            first = np.searchsorted(rows, every)
            low = np.minimum.reduceat(bound, first)
            lowest = np.flatnonzero(bound == low[rows])
            lowest = lowest[np.unique(rows[lowest], return_index=True)[1]]
            best = np.minimum(best, self._distance(x, every, entries[lowest]))
            keep = bound <= best[rows]
            rows, entries = rows[keep], entries[keep]
        exact = self._distance(x, rows, entries)
        first = np.searchsorted(rows, every)
        least = np.minimum.reduceat(exact, first)
        # Entries ascend inside a row, so the first of equals is the lowest.
        hit = np.flatnonzero(exact == least[rows])
        return entries[hit[np.unique(rows[hit], return_index=True)[1]]], least


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """The rows that take part: vec_id, label, vector of floor(scale * x), computed in doubles."""
    usable = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.where(usable).select("vec_id", "label", whole.alias("vector"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A batch's vectors as one matrix; all must have the table's dimension."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != width).any():
        raise ValueError(f"vectors of one table must have one dimension, here {width}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _largest(width: int) -> int:
    """Components up to this keep all sums of squares of a part's differences in 64 bits."""
    return int((2**62 / max(1, width // PARTS)) ** 0.5 / 4)


def _books(spark, books: list[np.ndarray]):
    return spark.sparkContext.broadcast(books)


def improved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry the floor of the mean of the parts that are nearest to it; unused entries stay.

    A task sends sums and counts of each entry, not parts; what comes to the driver is a codebook.
    """
    width = sum(b.shape[1] for b in books)
    part = width // PARTS
    shared = _books(rows.sparkSession, books)

    def sums(batches):
        codebooks = [Codebook(b) for b in shared.value]
        count = np.zeros((PARTS, len(codebooks[0].entries)), np.int64)
        total = np.zeros((PARTS, len(codebooks[0].entries), part), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for p, book in enumerate(codebooks):
                own = x[:, p * part : (p + 1) * part]
                index, _ = book.nearest(own)
                count[p] += np.bincount(index, minlength=len(book.entries))
                order = np.argsort(index, kind="stable")
                used, first = np.unique(index[order], return_index=True)
                if len(used) and part:
                    total[p, used] += np.add.reduceat(own[order], first, axis=0)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({"part": p, "entry": e, "n": count[p, e], "sums": list(total[p, e])}, schema=pa.schema([("part", pa.int64()), ("entry", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    partial = rows.select("vector").mapInArrow(sums, "part long, entry long, n long, sums array<long>")
    merged = partial.groupBy("part", "entry").agg(F.sum("n"), *(F.sum(F.col("sums")[i]) for i in range(part)))
    out = [b.copy() for b in books]
    # PARTS * ENTRIES rows at most.
    for p, e, n, *total in merged.collect():
        out[p][e] = [t // n for t in total]
    return out


def coded(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of each row."""
    width = sum(b.shape[1] for b in books)
    part = width // PARTS
    shared = _books(rows.sparkSession, books)

    def assign(batches):
        codebooks = [Codebook(b) for b in shared.value]
        for batch in batches:
            x = _matrix(batch.column(2), width)
            found = [book.nearest(x[:, p * part : (p + 1) * part]) for p, book in enumerate(codebooks)]
            code = np.column_stack([index for index, _ in found]).astype(np.uint8)
            error = sum(distance for _, distance in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(assign, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    """The SHA-256 of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


@stored_result("codes")
def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """For each vector: vec_id, code (an entry of each part, two hex digits each), error, label_error (of all vectors of its label, nulls together), codebooks_sha256.

    Takes columns vec_id, embedding and label; others are ignored, whatever their names. Vectors
    null or holding null or non-finite components take no part; neither does a null id or label
    keep a row out. Codebooks start from the rows of the least vec_ids, null ids last, equal ids by
    their vectors; fewer rows than entries give a codebook of that many. Repeated rows count each.
    An empty table gives no rows. All vectors must have one dimension, a multiple of PARTS, and
    components below ``_largest``: anything else is an error, as sums would leave 64 bits.
    """
    rows = integers(vectors)
    start = [x.vector for x in rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()]
    width = len(start[0]) if start else 0
    if width % PARTS or any(len(x) != width for x in start):
        raise ValueError(f"vectors of one table must have one dimension, a multiple of {PARTS}")
    high = rows.agg(F.max(F.greatest(F.array_max("vector"), -F.array_min("vector")))).first()[0] or 0
    if high > _largest(width):
        raise ValueError(f"components must be below {_largest(width) // SCALE}, this table has one of {high / SCALE}")
    matrix = np.array(start, np.int64).reshape(len(start), width)
    books = [matrix[:, p * (width // PARTS) : (p + 1) * (width // PARTS)].copy() for p in range(PARTS)]
    for _ in range(rounds if start else 0):
        books = improved(rows, books)
    found = stored(coded(rows, books), "coded")
    labels = found.groupBy(F.coalesce(F.col("label").cast("string"), F.lit("")).alias("of"), F.col("label").isNull().alias("none")).agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    keyed = found.withColumn("of", F.coalesce(F.col("label").cast("string"), F.lit(""))).withColumn("none", F.col("label").isNull())
    out = joined(keyed, stored(labels, "labels"), ["of", "none"], "rows")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
