import random

from tracelode.llm import neardup

from .helpers import ascii_words, edge_documents

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = ascii_words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """Components over all pairs of rows by their full sets."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def test_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(60):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 5, 40, 150]))]
        for _ in range(r.choice([1, 1, 2, 5])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            sep = r.choice([" ", "\n", "\t "])
            rows.append((n, sep.join(w.upper() if r.random() < 0.2 else w for w in own)))
            n += 1
    expected = brute(rows)
    found = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    for x in found:
        assert (x.n_shingles, x.component_id) == expected[x.doc_id]
        assert x.kept == (x.doc_id == x.component_id)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    expected = brute(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(docs).collect()} == expected


def test_edges(spark):
    docs = edge_documents(spark)
    found = neardup.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    by = {}
    for x in found:
        by.setdefault(x.doc_id, []).append(x)
    assert by[2][0].n_shingles == 0 and by[2][0].component_id == 2 and by[2][0].kept  # null text
    assert by[3][0].n_shingles == 0 and by[3][0].kept  # empty
    assert by[5][0].component_id == 1 and not by[5][0].kept  # equals 1
    assert {(x.n_shingles, x.component_id) for x in by[6]} == {(1, 6)} and len(by[6]) == 2  # a repeated row
    assert all(x.component_id in (None, 1) for x in by[None])


def test_chain_of_links_and_hot_group(spark):
    """A chain whose ends aren't similar is one component; so is a large group of copies."""
    words = [f"t{i}" for i in range(60)]
    rows = []
    for step in range(12):
        own = list(words)
        for k in range(step):
            own[k * 5] = f"changed{k}"
        rows.append((step + 10, " ".join(own)))
    rows += [(100 + i, "the very same five words here again") for i in range(500)]
    found = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {found[i] for i in range(100, 600)} == {100}
    assert found == {i: c for i, (_, c) in brute(rows).items()}


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_chains_in_no_order(spark):
    """Paths of some hundred nodes with shuffled ids, beside a star and a ring."""
    r = random.Random(11)
    ids = r.sample(range(10_000), 1_000)
    paths = [ids[:400], ids[400:700], [*ids[700:800], ids[700]]]
    links = [(x, y) for path in paths for x, y in zip(path, path[1:])] + [(ids[800], x) for x in ids[801:]] + [(5_000_000, 5_000_000)]
    r.shuffle(links)
    expected = {x: min(group) for group in (*paths, ids[800:]) for x in group}
    found = neardup.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == len(ids) and {x.node: x.component for x in found} == expected


def test_shuffled_chain_of_texts(spark):
    """Versions that drift by a word each, their ids in no order, are one component."""
    r = random.Random(12)
    words = [f"t{i}" for i in range(300)]
    rows = []
    for i in r.sample(range(300), 300):
        rows.append((i, " ".join(words)))
        for k in range(2):
            words[r.randrange(300)] = f"c{i}_{k}"
    expected = brute(rows)
    assert len({c for _, c in expected.values()}) == 1
    found = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == expected


def test_ids_of_any_size_and_kind(spark):
    """Hashed ids over the whole range of longs, negative ones, and strings."""
    r = random.Random(13)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(30))
    one, other = text(), text()
    ids = [(1 << 62) + 5, (1 << 62) + 9, (1 << 63) - 1, -(1 << 63), -7, 0]
    rows = [(ids[0], one), (ids[1], one), (ids[2], other), (ids[3], other + " more"), (ids[4], text()), (ids[5], "")]
    found = {x.doc_id: (x.component_id, x.kept) for x in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {ids[0]: (ids[0], True), ids[1]: (ids[0], False), ids[2]: (ids[3], False), ids[3]: (ids[3], True), ids[4]: (ids[4], True), ids[5]: (ids[5], True)}
    named = [(f"id{i:03}", t) for i, (_, t) in enumerate(rows)]
    found = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(named, "doc_id string, text string")).collect()}
    assert [found[f"id{i:03}"] for i in range(6)] == ["id000", "id000", "id002", "id002", "id004", "id005"]


def test_texts_of_one_id_join_their_groups(spark):
    r = random.Random(14)
    a, b = (" ".join(f"w{r.randrange(10**6)}" for _ in range(30)) for _ in range(2))
    rows = [(5, a), (5, b), (9, a), (3, b + " more"), (None, a), (7, None), (7, "")]
    found = sorted((x.doc_id is None, x.doc_id or 0, x.component_id, x.kept) for x in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [(False, 3, 3, True), (False, 5, 3, False), (False, 5, 3, False), (False, 7, 7, True), (False, 7, 7, True), (False, 9, 3, False), (True, 0, 3, False)]


def test_stored_results_of_two_threads(spark, tmp_path):
    """What a call stored on the way goes with its end; another thread's tables stay."""
    import threading
    from concurrent.futures import ThreadPoolExecutor

    from tracelode.llm.common import stored, stored_result

    inner, outer = threading.Event(), threading.Event()
    left = []

    @stored_result("long")
    def long():
        step = stored(spark.range(5).toDF("x"), "step")
        left.extend(step.inputFiles())
        inner.set()
        assert outer.wait(60)
        return step.where("x > 1")

    @stored_result("short")
    def short():
        assert inner.wait(60)
        return stored(spark.range(3).toDF("x"), "other")

    with ThreadPoolExecutor(2) as pool:
        a, b = pool.submit(long), pool.submit(short)
        assert b.result().count() == 3
        outer.set()
        assert a.result().count() == 3
    import os

    assert left and not any(os.path.exists(f.removeprefix("file://")) for f in left)
