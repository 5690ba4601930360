"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level k holds the k-th chunk of every id
that has one, a bitmap that tells which of them go on in the next level, and the number of set
bits before each 512 bits of it. So the id at any place is read with one rank for each level,
without decoding others. A file row is a segment: whole documents in ascending order of id,
their starts, and the levels.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelode.llm.common import spread
from tracelode.llm.encode import encoder, tokenizer_path
from tracelode.llm.texthash import raw

MAGIC = b"DAC1"
RANK_BITS = 512
SEGMENT_IDS = 1 << 18
END = 2
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack_levels(ids: np.ndarray) -> bytes:
    """Levels of chunks, bitmaps and rank directories of an array of unsigned 32-bit ids."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        counts = _POPCOUNT[bits].astype(np.uint32)
        blocks = np.add.reduceat(counts, np.arange(0, len(counts), RANK_BITS // 8)) if len(counts) else counts
        ranks = np.concatenate(([0], np.cumsum(blocks)[:-1])).astype("<u4") if len(blocks) else blocks.astype("<u4")
        out.append((len(rest), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        rest = rest[more] >> 8
        if not len(rest):
            break
    return struct.pack("<I", len(out)) + b"".join(struct.pack("<Q", n) + a + b + c for n, a, b, c in out)


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    lengths = np.array([len(x) for x in ids], "<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    return MAGIC + struct.pack("<I", len(ids)) + known.tobytes() + names.tobytes() + lengths.tobytes() + pack_levels(np.concatenate(ids) if ids else np.zeros(0, np.uint32))


class Segment:
    """A segment's bytes as views: doc_ids, starts (one more than documents), ids() and at(i)."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        (n,), at = struct.unpack_from("<I", data, 4), 8
        known = np.frombuffer(data, np.uint8, n, at)
        names = np.frombuffer(data, "<i8", n, at + n)
        lengths = np.frombuffer(data, "<u8", n, at + 9 * n)
        self.doc_ids = [int(x) if k else None for x, k in zip(names, known, strict=True)]
        self.starts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        at += 17 * n
        (levels,), at = struct.unpack_from("<I", data, at), at + 4
        self.levels = []
        for _ in range(levels):
            (m,), at = struct.unpack_from("<Q", data, at), at + 8
            chunks = np.frombuffer(data, np.uint8, m, at)
            bits = np.frombuffer(data, np.uint8, -(-m // 8), at + m)
            at += m + len(bits)
            ranks = np.frombuffer(data, "<u4", -(-m // RANK_BITS), at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def at(self, i: int) -> int:
        """The id at place i: a chunk of each level, found by the rank of its bit in the level before."""
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i // 8] >> (i % 8) & 1:
                break
            block = i // RANK_BITS
            inside = bits[block * RANK_BITS // 8 : i // 8]
            i = int(ranks[block]) + int(_POPCOUNT[inside].sum()) + int(_POPCOUNT[bits[i // 8] & ((1 << (i % 8)) - 1)])
        return value

    def ids(self) -> np.ndarray:
        """All ids."""
        value = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            own = chunks.astype(np.uint32)
            own[more] |= value << np.uint32(8)
            value = own
        return value


FILE = "part int, seq int, first long, n_ids long, segment binary"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END, segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes every text and writes Parquet files of segments: parts in ascending order of doc_id, null first.

    first counts the ids of the part before the segment. A document lies in one segment,
    however long. Rows that repeat an id follow each other. An empty table gives no segment.
    """
    path = tokenizer_path("byte_bpe_50k.json", tokenizer)

    def write(batches):
        from pyspark import TaskContext

        part, seq, first = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0
        encode = encoder(path, words=False)
        last = np.array([end], np.uint32)

        def flush():
            nonlocal seq, first, names, held, size
            rows = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first]), pa.array([size]), pa.array([pack_segment(names, held)], pa.binary())], names=[x.split()[0] for x in FILE.split(", ")])
            seq, first, names, held, size = seq + 1, first + size, [], [], 0
            return rows

        for batch in batches:
            data, at = raw(batch.column(1))
            for i in range(0, batch.num_rows, 64):
                until = min(i + 64, batch.num_rows)
                texts = [data[at[j] : at[j + 1]].tobytes() for j in range(i, until)]
                for name, ids in zip(batch.column(0)[i:until].to_pylist(), encode.ids(texts), strict=True):
                    names.append(name)
                    held.append(np.concatenate((np.frombuffer(ids, "<u4"), last)))
                    size += len(held[-1])
                    if size >= segment_ids:
                        yield flush()
        if names:
            yield flush()

    # Rows of one id, or without one, spread by their texts, so they are no single task's.
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", F.xxhash64("text"))
    rows.mapInArrow(write, FILE).write.parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files."""
    files = spark.read.schema(FILE).parquet(folder)
    # One row for each task that wrote.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = files.join(F.broadcast(parts), "part").select((F.col("before") + F.col("first")).alias("at"), "segment")

    def read(batches):
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                segment = Segment(data.as_py())
                ids = segment.ids().astype("<u4")
                n = np.diff(segment.starts)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(segment.starts[:-1], segment.starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(segment.doc_ids, pa.int64()), pa.array(segment.starts[:-1] + at), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
