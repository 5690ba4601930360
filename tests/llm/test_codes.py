import hashlib
import math
import random

import numpy as np
import pytest

from tests.oracle import same
from tracelode.llm import codes
from tracelode.llm.queries import ORACLE_SQL, op13_vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, entries, rounds=4):
    """Product codes by comparing every part with every entry, in Python's integers."""
    kept = [(i, [math.floor(1024 * x) for x in e], label) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return []
    part = len(kept[0][1]) // 4
    cut = lambda v: [v[p * part : (p + 1) * part] for p in range(4)]
    first = sorted(kept, key=lambda x: (x[0] is None, x[0] or 0, x[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(4)]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for _, v, _ in kept:
                x = cut(v)[p]
                members.setdefault(nearest(x, book)[0], []).append(x)
            for e, xs in members.items():
                book[e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, labels = [], {}
    for i, v, label in kept:
        found = [nearest(x, book) for x, book in zip(cut(v), books, strict=True)]
        error = sum(d for _, d in found)
        labels[label] = labels.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for e, _ in found), error, label))
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted([(i, c, e, labels[label], digest) for i, c, e, label in out], key=repr)


@pytest.mark.parametrize("width", [8, 20])
def test_against_plain_version(spark, width):
    r = random.Random(width)
    centres = [[r.uniform(-1, 1) for _ in range(width)] for _ in range(7)]
    rows = [(r.choice([n, n, 3]), [float(np.float32(x + r.gauss(0, 0.1))) for x in r.choice(centres)], r.choice([None, 1, 2])) for n in range(150)]
    rows += [(-1, [0.0] * width, 0), (-1, [0.0] * width, 0), (None, [1e3] * width, 0), (200, None, 1), (201, [None] + [0.5] * (width - 1), 1), (202, [math.inf] * width, 1), (203, [math.nan] * width, 1)]
    extra = spark.createDataFrame([(*x, "w", 1, "e") for x in rows], SCHEMA + ", vector string, error int, `of` string").repartition(3)
    found = codes.compress(extra, entries=16)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, 16)


def test_edges(spark):
    assert codes.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    assert codes.compress(spark.createDataFrame([(1, None, None)], SCHEMA)).collect() == []
    few = [(5, [0.25] * 4, None), (2, [-0.75] * 4, None), (2, [-0.75] * 4, None)]
    assert sorted(map(tuple, codes.compress(spark.createDataFrame(few, SCHEMA)).collect()), key=repr) == plain(few, 256)
    with pytest.raises(ValueError, match="dimension"):
        codes.compress(spark.createDataFrame([(1, [0.0] * 6, None)], SCHEMA))
    with pytest.raises(ValueError, match="below"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 8, None)], SCHEMA))


@pytest.mark.parametrize("scale", [3, 600, 2**24])
def test_filter_is_exact_and_rules_most_entries_out(scale):
    r = np.random.default_rng(scale)
    book = codes.Codebook(r.integers(-scale, scale + 1, (256, 16)))
    x = np.concatenate([book.entries[r.integers(0, 256, 3000)] + r.integers(-scale // 8, scale // 8 + 1, (3000, 16)), r.integers(-scale, scale + 1, (500, 16)), book.entries])
    every = ((x[:, None, :] - book.entries) ** 2).sum(axis=2)
    index, distance = book.nearest(x)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    # Tiny integers leave hardly anything to rule out.
    assert scale == 3 or book.exact < 0.25 * every.size


def test_whole_table(spark, sf):
    same(op13_vector_codes(spark, sf), ORACLE_SQL["op13_vector_codes"], sf)
