import random

import corpus_pipeline
from tracelode.llm import gam, mixing, neardup

from .helpers import edge_documents, empty_documents
from .test_neardup import shingles


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixing", "packing"]


def test_each_stage_against_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    quality, near, mixing, pack = (f for _, f in corpus_pipeline.STAGES)

    good = quality(spark, docs, sf)
    scored = gam.classify_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert good.columns == columns
    kept = {x.doc_id for x in good.collect()}
    assert kept == {x.doc_id for x in scored.where("predicted = 1").collect()}

    one = near(spark, good, sf)
    groups = {x.doc_id: x.component_id for x in neardup.near_duplicates(good, percent=80, keys=13).collect()}
    assert one.columns == columns
    assert sorted(x.doc_id for x in one.collect()) == sorted(set(groups.values()))

    mixed = mixing(spark, one, sf)
    assert mixed.columns == columns
    n = {}
    for x in mixed.collect():
        n[x.doc_id] = n.get(x.doc_id, 0) + 1
    assert set(n) <= set(groups.values()) and max(n.values()) <= 2

    pieces = pack(spark, mixed, sf).collect()
    once = {}
    for p in pieces:
        once[p.doc_id] = once.get(p.doc_id, 0) + p.length
    assert {i: once[i] for i in n} == {p.doc_id: p.doc_tokens * n[p.doc_id] for p in pieces}


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_edges(spark, sf):
    docs = edge_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        assert rows, name
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_documents(spark), sf).collect() == [], name


def test_near_stage_against_brute_force_at_80(spark, sf):
    """Pairs of texts from 0.70 to 1; a good part lies from 0.80 to below 0.85."""
    r = random.Random(8)
    rows, n, between = [], 0, 0
    for _ in range(60):
        base = [f"w{r.randrange(10**6)}" for _ in range(104)]
        other = list(base)
        # Words at the text's ends are in few shingles, so similarities come close to each other.
        k = r.randrange(0, 20)
        other[:k] = [f"x{r.randrange(10**6)}" for _ in range(k)]
        rows += [(n, " ".join(base)), (n + 1, " ".join(other))]
        n += 2
    keep = set()
    for (i, a), (j, b) in zip(rows[::2], rows[1::2], strict=True):
        x, y = shingles(a), shingles(b)
        near = 100 * len(x & y) >= 80 * len(x | y)
        between += near and 100 * len(x & y) < 85 * len(x | y)
        keep |= {i} if near else {i, j}
    assert between > 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id for x in corpus_pipeline.keep_one_of_each(spark, docs, sf).collect()} == keep


def test_rows_with_null_or_repeated_ids(spark, sf):
    """No row is multiplied or lost for lack of an id of its own."""
    r = random.Random(9)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(30))
    same, other = text(), text()
    rows = [(None, same, "a")] * 5 + [(None, same, "b"), (3, other, "b"), (None, other, "b"), (9, text(), "a"), (9, text(), "a"), (9, text(), "b")]
    rows += [(None, text(), "a") for _ in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    one = corpus_pipeline.keep_one_of_each(spark, docs, sf).collect()
    assert sorted(x.text for x in one) == sorted({x[1] for x in rows})
    assert [x.doc_id for x in one if x.text == other] == [3] and sum(x.doc_id == 9 for x in one) == 3

    # Each text has 30 words; the targets are exact, and a last document is in by more than half or out.
    mixed = corpus_pipeline.mix_sources(spark, docs, sf).collect()
    n, times = {}, {}
    for x in rows:
        n[x[2]], times[x] = n.get(x[2], 0) + 1, times.get(x, 0) + 1
    targets = {x.source_size: x.target for x in mixing.mix(docs).collect()}
    taken = {}
    for x in mixed:
        taken[tuple(x)] = taken.get(tuple(x), 0) + 1
    assert all(c <= 2 * times[x] for x, c in taken.items())
    assert len(mixed) <= 2 * len(rows)
    for source in n:
        assert abs(30 * sum(c for x, c in taken.items() if x[2] == source) - targets[30 * n[source]]) <= 30
