"""Searches of many queries, in blocks and with bounds that are known beforehand, against scores of all pairs."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tracelode.functions import embedding, scoring
from tracelode.operators import recall


def texts(n, seed):
    """Common words and rare ones, empty texts, copies."""
    r = random.Random(seed)
    word = lambda: r.choice("the of and to in".split()) if r.random() < 0.5 else f"w{int(r.random() ** 3 * 400)}"
    made = [" ".join(word() for _ in range(r.randrange(0, 30))) for _ in range(n)]
    return [made[i // 2] if i % 7 == 0 else t for i, t in enumerate(made)]


def first(scores, k):
    """{(query, document): (score, rank)} of a dictionary of all pairs' scores."""
    out = {}
    for q in {q for q, _ in scores}:
        own = sorted(((-s, d) for (p, d), s in scores.items() if p == q and s > 0))[:k]
        out |= {(q, d): (-s, n + 1) for n, (s, d) in enumerate(own)}
    return out


@pytest.fixture(params=[(1024, 512, 2048, 2.5), (5, 16, 64, 0.05), (5, 16, 64, 1e9)])
def sizes(request, monkeypatch):
    """As they are; and small, with each term a column, and with none."""
    many, block, rows, use = request.param
    for module, name, value in ((recall, "MANY", many), (scoring, "BLOCK", block), (recall, "ROWS", rows), (scoring, "DENSE_USE", use), (recall, "KEPT_ROWS", 300), (recall, "BOUND_SHARE", 4)):
        monkeypatch.setattr(module, name, value)
    return many


DOCUMENTS, ASKED, K = texts(700, 1), texts(60, 2) + ["zq1", "zq2 zq3", "the", "the the", "W1 w2", "w2, w1"], 4


def tables(spark):
    return spark.createDataFrame(list(enumerate(DOCUMENTS)), "document_id long, content string").repartition(3), spark.createDataFrame(list(enumerate(ASKED)), "query_id long, query string")


def test_terms_of_many_queries(spark, sizes):
    words = [re.findall(r"\w+", t.lower()) for t in DOCUMENTS]
    mean, n = sum(map(len, words)) / len(words), len(words)
    df = {}
    for own in words:
        for t in set(own):
            df[t] = df.get(t, 0) + 1
    scores = {}
    for q, text in enumerate(ASKED):
        for d, own in enumerate(words):
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * own.count(t) * 2.2 / (own.count(t) + 1.2 * (0.25 + 0.75 * len(own) / mean)) for t in sorted(set(re.findall(r"\w+", text.lower()))) if t in own)
            scores[q, d] = math.floor(s * 1e6 + 0.5) / 1e6
    documents, queries = tables(spark)
    found = {(x.query_id, x.document_id): (x.score, x.rank) for x in recall.lexical(documents, queries, K).collect()}
    assert found == first(scores, K)


def test_hashed_terms_of_many_queries(spark, sizes):
    vector = lambda t: embedding.hashed_counts(pa.array([t.lower()]), 32)[0]
    d, q = np.array([vector(t) for t in DOCUMENTS]), np.array([vector(t) for t in ASKED])
    norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((d * d).sum(1))[None, :]
    own = np.floor(np.divide(q @ d.T, norm, out=np.zeros_like(norm), where=norm > 0) * 1e6 + 0.5) / 1e6
    scores = {(i, j): own[i, j] for i in range(len(q)) for j in range(len(d))}
    documents, queries = tables(spark)
    found = {(x.query_id, x.document_id): (x.score, x.rank) for x in recall.hashed_near(documents, queries, K, dimension=32).collect()}
    assert found == first(scores, K)


def test_few_pairs_are_scored_exactly_and_equal_queries_once(spark, monkeypatch):
    """Each of 300 queries asks twice, in another order of words; of pairs that the first ones exceed no exact score is computed."""
    seen, pairs = [], []
    whole = recall.by_blocks
    monkeypatch.setattr(recall, "by_blocks", lambda part, scores, k, least: (seen.append(sum(map(len, scores.blocks))), whole(part, scores, k, least))[1])
    asked = [t for t in dict.fromkeys(" ".join(sorted(set(t.split()))) for t in texts(400, 3)) if t][:300]
    twice = asked + [" ".join(reversed(t.split())) for t in asked]
    documents, _ = tables(spark)
    queries = spark.createDataFrame(list(enumerate(twice)), "query_id long, query string")
    rows = {}
    for search in (recall.lexical, recall.hashed_near):
        for x in search(documents, queries, K).collect():
            rows.setdefault((search.__name__, x.query_id), set()).add((x.document_id, x.score, x.rank))
    assert all(n <= len(asked) for n in seen) and len(seen) == 2
    assert all(rows.get((s, i)) == rows.get((s, i + len(asked))) for s in ("lexical", "hashed_near") for i in range(len(asked)))

    counts = embedding.hashed_counts(pa.array(asked), 256).astype(np.int32)
    scores = scoring.HashedBlocks(scoring.blocks_in_order(np.arange(len(asked))), counts)
    exact = scoring.HashedBatch.exact
    monkeypatch.setattr(scoring.HashedBatch, "exact", lambda self, n, rows, columns: (pairs.append(len(rows)), exact(self, n, rows, columns))[1])
    batch, tops = pa.RecordBatch.from_pydict({"t": DOCUMENTS}), scoring.Tops(K)
    for _ in scoring.candidates(scores.blocks, scores.task()(batch), [((), np.arange(len(DOCUMENTS)))], tops):
        pass
    assert 0 < sum(pairs) < len(asked) * len(DOCUMENTS) / 20
