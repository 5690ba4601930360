"""SimHash near duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most four are cut into three segments: one of these
differs in at most one bit. So each fingerprint is filed under every variant of every segment
that leaves one bit out (64 keys), and two that link meet under an equal key. Pairs are
verified on whole fingerprints. Groups of more than ``MOST`` members aren't compared as they
are: they are filed again under variants of the bits that their key leaves free.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.common import joined, stored, stored_result
from tracelode.llm.neardup import components
from tracelode.llm.texthash import constants, mixed

WORDS = 4
SEED = 42
BITS = 64
DISTANCE = 4
#: Of so many members all pairs are compared in place; larger groups are split by further variants.
MOST = 1 << 15
#: Shingles whose bits are counted at once.
STEP = 1 << 14


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The bits that more than half of the text's shingles have set; 0 without words."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return 0
    joined_words, count = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum([len(x) + 1 for x in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(words, len(parts)) - 1 :]
    hashed, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, count, STEP):
        some = zip(starts[i : min(i + STEP, count)].tolist(), last[i : i + STEP].tolist(), strict=True)
        h = np.fromiter((hashed(joined_words[a:b], SEED) for a, b in some), np.uint64)
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, print) of each row of (doc_id, text); the fingerprint as a signed long."""
    def each(batches):
        for batch in batches:
            found = np.array([fingerprint((x.as_py() or "").encode(), words) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, print long")


def _segments(free: np.ndarray) -> list[np.ndarray]:
    """Free bits, ascending, cut into as few runs as make one differ by one bit at most."""
    return np.array_split(free, min(DISTANCE // 2 + 1, len(free)))


def _taken(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The values with all but the given bits set to zero."""
    mask = 0
    for b in bits.tolist():
        mask |= 1 << b
    return values & np.uint64(mask)


def _linked(values: np.ndarray) -> np.ndarray:
    """Links that join each component of values as a star: rows (first member, other). All pairs are compared, a row at a time."""
    label = np.arange(len(values))
    for i in range(1, len(values)):
        near = np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= DISTANCE)
        if len(near):
            roots = np.unique(label[near])
            label[i] = roots[0]
            if len(roots) > 1:
                label[:i][np.isin(label[:i], roots)] = roots[0]
    other = np.flatnonzero(label != np.arange(len(values)))
    return np.stack([values[label[other]], values[other]], axis=1)


def links(prints: DataFrame, most: int = MOST) -> DataFrame:
    """Links (a, b) of fingerprints that join all those which chains of at most four differing bits join.

    prints: distinct values ``print``. Each level files its rows under their variants, sorts by
    key in each task and reads a group at a time: up to ``most`` members are compared there and
    give the links of a star; of more, each is filed again under variants of the bits that are
    still free, so after a few levels hardly any bit is free and a group is small by its nature.
    """
    # fixed: the bits that keys so far compare or leave out; trail: the last key.
    level = stored(prints.select("print", F.lit(0).cast("long").alias("fixed"), F.lit(0).cast("long").alias("trail")), "level")
    found = None
    while True:
        filed = level.mapInArrow(_file, "key long, print long, fixed long")
        met = stored(filed.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(most), "a long, b long, fixed long, trail long"), "met")
        pairs = met.where("b is not null").select("a", "b")
        found = pairs if found is None else found.union(pairs)
        level = met.where("b is null").select(F.col("a").alias("print"), "fixed", "trail")
        if level.isEmpty():
            return found


def _file(batches):
    """Each row under each of its variants: the key, and the bits that are fixed under it."""
    marks = constants(BITS, 11)
    for batch in batches:
        prints, fixed, trail = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
        for bits in np.unique(fixed):
            at = np.flatnonzero(fixed == bits)
            free = np.array([b for b in range(BITS) if not int(bits) >> b & 1])
            for segment in _segments(free):
                after = np.full(len(at), int(bits) | sum(1 << b for b in segment.tolist()), np.uint64)
                for b in segment:
                    part = _taken(prints[at], segment[segment != b])
                    key = mixed(mixed(part ^ marks[b]) ^ trail[at])
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (key, prints[at], after)], names=["key", "print", "fixed"])


def _meet(most: int):
    """Reads rows sorted by key: (a, b) of the links inside each group, or of a group that is too large its members as (print, null, fixed, key)."""
    def links_of(groups):
        pairs = np.concatenate([_linked(values.view(np.uint64)) for values in groups]).view(np.int64)
        nothing = pa.nulls(len(pairs), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), nothing, nothing], names=["a", "b", "fixed", "trail"])

    def members(key, prints, fixed):
        return pa.RecordBatch.from_arrays([pa.array(prints), pa.nulls(len(prints), pa.int64()), pa.array(fixed), pa.array(key)], names=["a", "b", "fixed", "trail"])

    def each(batches):
        # The rows of the last group so far, unless it is being split.
        held, splitting = [np.zeros(0, np.int64)] * 3, None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if splitting is not None:
                same = int(np.searchsorted(new[0], splitting, side="right"))
                if same:
                    yield members(*(c[:same] for c in new))
                if same == len(new[0]):
                    continue
                new, splitting = [c[same:] for c in new], None
            rows = [np.concatenate(pair) for pair in zip(held, new, strict=True)]
            key, prints, fixed = rows
            if not len(key):
                continue
            edges = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
            sizes = np.diff(edges)
            groups = []
            for i, n in zip(edges[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                if n > most and fixed[i] != -1:
                    yield members(*(c[i : i + n] for c in rows))
                else:
                    groups.append(prints[i : i + n])
            if groups:
                yield links_of(groups)
            held = [c[edges[-1] :] for c in rows]
            # All bits are fixed in -1: such a group can't be split, nor can it be large.
            if len(held[0]) > most and held[2][0] != -1:
                yield members(*held)
                held, splitting = [np.zeros(0, np.int64)] * 3, int(held[0][0])
        if len(held[0]) > 1:
            yield links_of([held[1]])

    return each


@stored_result("simhash")
def simhash_duplicates(docs: DataFrame, words: int = WORDS, most: int = MOST) -> DataFrame:
    """For each document: doc_id, fingerprint (16 hex digits) and component_id, the smallest id reachable over fingerprints that differ in at most four bits.

    Takes columns doc_id and text, others are ignored, whatever their names. Words are runs of
    other than ASCII white space with A-Z lower-cased; a text of fewer than ``words`` words is one
    shingle; null, empty and blank texts have the fingerprint zero and link like any other. Each
    row is a document: rows that repeat an id are one each. A null id is linked like others and
    never the smallest; a component without any id has a null one. An empty table gives no rows.
    """
    printed = stored(fingerprints(docs, words), "prints")
    classes = stored(printed.groupBy("print").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least")), "classes")
    component = stored(components(links(classes.select("print"), most)), "components")
    linked = classes.join(component, classes["print"] == component["node"]).select("print", "least", "component")
    smallest = linked.groupBy("component").agg(F.min("least").alias("smallest"), F.count("*").alias("rows"))
    moved = joined(linked.select("print", "component"), smallest, ["component"], "rows").select("print", "smallest")
    named = classes.join(moved, "print", "left").select("print", "rows", F.coalesce("smallest", "least").alias("component_id"))
    rows = joined(printed, stored(named, "named"), ["print"], "rows")
    return rows.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
