import random

import pytest
import xxhash

from tracelode.llm import simhash
from tracelode.llm.queries import op11_simhash_neardup

from .helpers import ascii_words, edge_documents, empty_documents


def plain_print(text):
    w = ascii_words(text)
    runs = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows):
    """(fingerprint, component) of each row, from all pairs."""
    prints = [plain_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, f"{prints[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(rows)]


def key(row):
    return tuple((x is not None, x or 0) if not isinstance(x, str) else x for x in row)


def test_whole_table(spark, sf):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = op11_simhash_neardup(spark, sf)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, found.collect())) == sorted(plain(rows))


def test_edges(spark):
    docs = edge_documents(spark)
    rows = [tuple(x) for x in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.simhash_duplicates(docs).collect()), key=key) == sorted(plain(rows), key=key)
    assert simhash.simhash_duplicates(empty_documents(spark)).collect() == []


@pytest.mark.parametrize("most", [1 << 15, 25])
def test_links_against_all_pairs(spark, most):
    """Groups around some centres at up to six bits; groups of more than most are split and lose no link."""
    r = random.Random(most)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(5):
        centre = r.getrandbits(64)
        for _ in range(60):
            value = centre
            for b in r.sample(range(64), r.choice([1, 2, 3, 5, 6])):
                value ^= 1 << b
            prints.add(value)
    prints |= {r.getrandbits(64) for _ in range(100)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "print long"), most).collect()
    assert all(((x.a ^ x.b) & ((1 << 64) - 1)) for x in found)

    def components(pairs):
        root = {x: x for x in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for x in signed:
            groups.setdefault(find(x), set()).add(x)
        return {frozenset(g) for g in groups.values()}

    every = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4]
    assert len(every) > 1000
    assert components((x.a, x.b) for x in found) == components(every)
