import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelode.functions import columns as C
from tracelode.functions import embedding
from tracelode.operators import index_store, recall, scoped


def tokens(text):
    return (len(text.encode()) + 1) // 2


def plain_context(query, memories, limit):
    """The greedy context by a plain loop. memories: rank -> (id, title, footer, [(document_id, text, score)])."""
    header = f"# Recall Context\n\nTask: {query}\n"

    def render(chosen):
        out = header
        for rank in sorted(chosen):
            if chosen[rank]:
                _, title, footer, _ = memories[rank]
                out += f"\n## {title}\n\n" + "".join(f"- {t}\n" for t in chosen[rank]) + footer
        return out

    tried = sorted((-score, rank, doc, text) for rank, m in memories.items() for doc, text, score in m[3])[:192]
    chosen, left = {}, 0
    for _, rank, _, text in tried:
        chosen.setdefault(rank, []).append(text)
        if tokens(render(chosen)) > limit:
            chosen[rank].pop()
            left += 1
    text = render(chosen)
    empty = "\nNo relevant memory was admitted.\n" if not tried else "\nNo attributed memory matched within the context budget.\n"
    if not any(chosen.values()) and tokens(text + empty) <= limit:
        text += empty
    return text, [memories[r][0] for r in sorted(chosen) if chosen[r]], left


def test_context_against_a_loop(spark):
    r = random.Random(4)
    found, queries, expected = [], [], {}
    for q in range(25):
        query = "task é " * r.randrange(1, 12)
        queries.append((q, query))
        memories = {}
        for rank in range(1, r.randrange(1, 7)):
            lines = [(f"m{rank}:snippet:{i:04d}", "line ü " * r.randrange(1, 40), round(r.random(), 2)) for i in range(r.randrange(1, 12))]
            memories[rank] = (f"m{rank}", f"Title {rank}", f"Memory: m{rank}\nType: t\n", lines)
            found += [(q, rank, f"m{rank}", f"Title {rank}", f"Memory: m{rank}\nType: t\n", *x) for x in lines]
        expected[q] = plain_context(query, memories, 300)
    rows = recall.context(
        spark.createDataFrame(found, "query_id long, rank int, memory_id string, title string, footer string, document_id string, text string, snippet_score double"),
        spark.createDataFrame(queries, "query_id long, query string"), 300).collect()
    assert len(rows) == 25
    for x in rows:
        text, ids, left = expected[x.query_id]
        assert (x.markdown, x.rendered_ids, x.omitted_snippets, x.token_count) == (text, ids, left, tokens(text))


def test_context_cuts_a_long_task(spark):
    rows = recall.context(
        spark.createDataFrame([], "query_id long, rank int, memory_id string, title string, footer string, document_id string, text string, snippet_score double"),
        spark.createDataFrame([(1, "é" * 2000), (2, "short")], "query_id long, query string"), 256).orderBy("query_id").collect()
    assert rows[0].token_count <= 256 and rows[0].markdown.endswith("é\n")
    assert rows[1].markdown == "# Recall Context\n\nTask: short\n\nNo relevant memory was admitted.\n"


def plain_admit(rows, limit, threshold):
    order = sorted(rows, key=lambda r: (not r["pin"], -r["score"], recall.TYPE_ORDER.index(r["type"]), -r["at"], r["id"]))
    counts, admitted, out = {}, 0, {}
    for r in order:
        if not (r["lex"] or r["vec"] >= threshold or r["pin"]):
            out[r["id"]] = (None, "relevance")
        elif counts.get(r["type"], 0) >= recall.TYPE_CAPS[r["type"]]:
            out[r["id"]] = (None, "type_cap")
        elif admitted >= limit:
            out[r["id"]] = (None, "limit")
        else:
            admitted += 1
            counts[r["type"]] = counts.get(r["type"], 0) + 1
            out[r["id"]] = (admitted, None)
    return out


def test_admission_against_a_loop(spark):
    r = random.Random(6)
    rows, expected = [], {}
    for q in range(20):
        own = [{"id": f"m{i}", "type": r.choice(recall.TYPE_ORDER), "at": r.randrange(5), "score": r.randrange(4), "vec": r.random(), "lex": r.random() < 0.3, "pin": i == 3 and q % 2 == 0} for i in range(r.randrange(4, 40))]
        expected[q] = plain_admit(own, 9, 0.5)
        rows += [(q, x["id"], x["type"], x["at"], float(x["score"]), x["vec"], x["lex"], x["pin"]) for x in own]
    found = recall.admit(spark.createDataFrame(rows, "query_id long, memory_id string, memory_type string, created_at_ms long, score double, vector_score double, has_lexical boolean, is_pinned boolean"), 9, 0.5)
    for x in found.collect():
        assert (x.rank, x.omission) == expected[x.query_id][x.memory_id]


def test_searched_snippets_come_first(spark):
    rows = spark.createDataFrame([(1, "alpha beta", "m", "alpha beta\n\n gamma \nalpha", [("m:fact:9", "found", -5.0)])], "query_id long, query string, memory_id string, content string, found array<struct<document_id:string,text:string,score:double>>")
    found = [(x.text, x.snippet_score) for x in recall.snippets(rows, 3).orderBy(F.desc("snippet_score"), "document_id").collect()]
    assert [t for t, _ in found] == ["found", "alpha beta", "alpha"] and found[0][1] > 1 and found[1][1] == 1.0


def test_query_sees_itself_in_hashed_space(spark):
    rows = spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, "")], "query_id long, query string")
    documents = rows.selectExpr("query_id as document_id", "query as content")
    found = {(x.query_id, x.document_id): x.score for x in recall.hashed_near(documents, rows, 5).collect()}
    assert found[1, 1] == found[2, 2] == 1.0 and not any(3 in pair for pair in found)


def test_nearest_vectors_of_more_queries_than_a_block(spark, monkeypatch):
    """Against a product of whole matrices, by a part column, with vectors that have no direction; a task's rows are cut on the way."""
    r = np.random.default_rng(3)
    documents, queries = np.round(r.normal(size=(900, 6)), 2), np.round(r.normal(size=(recall.QUERY_BLOCK + 40, 6)), 2)
    rows = [(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(documents)] + [(1000, "a", None), (1001, "a", [0.0] * 6), (1002, "b", [])]
    monkeypatch.setattr(recall, "KEPT_ROWS", 500)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, vector array<double>")
    found = recall.vector_near(spark.createDataFrame(rows, "document_id long, part string, vector array<double>").repartition(2), asked, 4, ["part"]).collect()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.floor(unit(queries) @ unit(documents).T * 1e6 + 0.5) / 1e6
    expected = set()
    for q in range(len(queries)):
        for part in (0, 1):
            best = sorted(range(part, 900, 2), key=lambda i: (-scores[q, i], i))[:4]
            expected |= {(q, "ab"[part], i, n + 1) for n, i in enumerate(best)}
    assert {(x.query_id, x.part, x.document_id, x.rank) for x in found} == expected


class Wrong(embedding.HashingProvider):
    def embed(self, texts):
        return super().embed(texts)[:, :5]


@pytest.mark.parametrize("embedder, error", [
    (embedding.Embedder(embedding.HashingProvider, "another", 256), "embedding_profile_mismatch"), (embedding.Embedder(lambda: embedding.HashingProvider(8), "hashing-8", 9), "embedding_profile_mismatch"),
    (embedding.Embedder(lambda: Wrong(16), "hashing-16", 16), "embedding_invalid"),
])
def test_providers_must_be_what_was_agreed(spark, embedder, error):
    with pytest.raises(Exception, match=error):
        embedder.add(spark.createDataFrame([("a",), (None,)], "t string"), "t").collect()


def test_provider_gives_each_text_its_vector(spark):
    rows = spark.createDataFrame([("b a",), (None,), ("A b",), ("",)], "t string")
    found = [x.vector for x in embedding.HASHING.add(rows, "t").collect()]
    assert found[1] is None and found[0] == found[2] and sum(found[0]) == 2 and sum(found[3]) == 0


MEMORY = "repo_key string, memory_id string, memory_type string, status string, title string, content string, category string, tags array<string>, facts array<struct<fact_id:string,fact_kind:string,value:string>>, created_at_ms long, subject_key long"


def memory(repo, i, content, subject=0, kind="user_preference", status="active"):
    return (repo, f"m{i}", kind, status, f"title {i}", content, "c", ["t"], [], i, subject)


def test_scoped_recall_shadows_and_validates(spark):
    rows = [memory("a", 1, "tabs please", 1), memory("b", 2, "spaces please", 1), memory("b", 3, "short lines please", 2), memory("c", 4, "please not mine", 3), memory("b", 5, "please local", 9, "work_state")]
    memories = spark.createDataFrame(rows, MEMORY)
    promote = lambda *ids: spark.createDataFrame([(i, f"m{i}", repo, subject, None) for i, repo, subject in ids], "promotion_id long, memory_id string, repo_key string, subject_key long, replaces long")
    queries = spark.createDataFrame([(1, "please", "a"), (2, "please", "b")], "query_id long, query string, repo_key string")
    found = scoped.scoped_recall(memories, promote((2, "b", 1), (3, "b", 2)), queries, 5, 0.0)
    # In a, its own preference of subject 1 shadows the global one; c's memory is nobody's.
    assert sorted((x.query_id, x.memory_id, x.scope) for x in found.collect()) == [(1, "m1", "repository"), (1, "m3", "global"), (2, "m2", "global"), (2, "m3", "global"), (2, "m5", "repository")]
    with pytest.raises(ValueError, match="global_preference_invalid"):
        scoped.scoped_recall(memories, promote((5, "b", 9)), queries, 5, 0.0)


def test_memory_of_two_repositories_is_refused(spark):
    memories = spark.createDataFrame([memory("a", 1, "one"), memory("b", 1, "one two")], MEMORY)
    queries = spark.createDataFrame([(1, "one two", ["a", "b"])], "query_id long, query string, repo_keys array<string>")
    with pytest.raises(ValueError, match="memory_in_several_repositories"):
        recall.hybrid(memories, queries, 5, 0.0, by_repository=True)


def test_recall_stops_over_a_stale_index_and_a_write_voids_it(spark, tmp_path):
    store = index_store.IndexStore(spark, f"file://{tmp_path}/index")
    queries = spark.createDataFrame([(1, "one")], "query_id long, query string")
    memories = lambda *texts: spark.createDataFrame([memory("a", i, t) for i, t in enumerate(texts)], MEMORY)
    with pytest.raises(index_store.IndexNotReady):
        recall.hybrid(memories("one"), queries, 5, 0.0, index=store)
    assert store.rebuild(memories("one", "two")).first().current
    assert [x.memory_id for x in recall.hybrid(memories("one", "two"), queries, 5, 0.0, index=store).where("admitted").collect()] == ["m0"]
    with pytest.raises(index_store.IndexNotReady, match="a"):
        recall.hybrid(memories("one", "three"), queries, 5, 0.0, index=store)
    assert store.rebuild(memories("one", "three")).first().version == 2 and store.current()["version"] == 2
    with pytest.raises(RuntimeError, match="version_taken"):
        store._commit(2, "elsewhere")

    path = f"file://{tmp_path}/table"
    spark.range(3).write.parquet(path)
    opened = lambda: (spark.read.parquet(path),)
    assert index_store.read_unchanged(opened, lambda t: t.where("id > 0")).count() == 2

    def written_between(t):
        spark.range(9, 10).write.mode("append").parquet(path)
        return t

    with pytest.raises(RuntimeError, match="snapshot_changed"):
        index_store.read_unchanged(opened, written_between)


def test_candidate_cap():
    assert [recall.candidate_cap(n) for n in (1, 5, 20, 100)] == [20, 20, 80, 100]


def test_byte_cut_and_order(spark):
    rows = spark.createDataFrame([("aé",), ("abc   d",), (None,), ("",)], "t string")
    assert [x.c for x in rows.select(C.byte_cut(F.col("t"), 2).alias("c")).collect()] == ["a", "ab", None, ""]
    assert [x.c for x in rows.select(C.byte_cut(F.col("t"), 5).alias("c")).collect()] == ["aé", "abc", None, ""]
    shape = "struct<provider:string,session_id:string,generation:int,event_index:long,timestamp_ms:long>"
    pairs = [(("A", "s", 1, 1, None), ("A", "s", 1, 2, None), -1), (("A", "s", 1, 2, None), ("A", "s", 1, 2, 5), 0), (("A", "s", 1, 1, 5), ("A", "t", 1, 1, None), None), (("A", "s", 1, 1, 5), ("A", "t", 1, 1, 4), 1), (None, ("A", "t", 1, 1, 4), None), (("A", "a", 1, 9, 4), ("A", "b", 1, 1, 4), -1)]
    found = spark.createDataFrame(pairs, f"l {shape}, r {shape}, e int").select(C.compare_order(F.col("l"), F.col("r")).alias("c"), "e").collect()
    assert all(x.c == x.e for x in found)


def test_hmac(spark):
    import hashlib
    import hmac

    for secret in (b"k", b"x" * 100):
        found = spark.createDataFrame([("päth",)], "m string").select(C.hmac_id(secret, F.col("m")).alias("h")).first().h
        assert found == hmac.new(secret, "päth".encode(), hashlib.sha256).hexdigest()


def test_pins_are_admitted_first(spark):
    """A pinned memory goes first, also where no source found it; what search found of the others stays."""
    schema = "repo_key string, memory_id string, memory_type string, status string, created_at_ms long, title string, content string, category string, tags array<string>, facts array<struct<fact_id:string,fact_kind:string,value:string>>"
    rows = [("r", f"m{i}", "repository_knowledge", "active", i, f"Title {i}", text, "c", [], []) for i, text in enumerate(("alpha beta\ngamma", "alpha", "zeta eta"))]
    memories, queries = spark.createDataFrame(rows, schema), spark.createDataFrame([(1, "alpha beta"), (2, "alpha")], "query_id long, query string")
    pins = spark.createDataFrame([(1, "m2")], "query_id long, memory_id string")
    found = {(x.query_id, x.memory_id): x for x in recall.hybrid(memories, queries, 5, 0.9, pins=pins).collect()}
    assert found[1, "m2"].rank == 1 and found[1, "m2"].is_pinned and (2, "m2") not in found
    assert found[1, "m0"].rank == 2 and found[1, "m1"].rank == 3 and found[2, "m1"].rank is not None
    assert [f.document_id for f in found[1, "m0"].found] == ["m0:snippet:0000"]


def test_first_rows_against_a_sort():
    import pyarrow as pa

    r = np.random.default_rng(5)
    for _ in range(30):
        n, k = int(r.integers(0, 60)), int(r.integers(1, 6))
        scores = r.integers(0, 5, (n, 3)).astype(float)
        ids, part = [f"d{i}" for i in r.permutation(n)], [f"p{i}" for i in r.integers(0, 3, n)]
        rows, columns = np.nonzero(scores > 0)
        first = recall.first_rows(scores[rows, columns], columns, pa.array(ids, pa.string()).take(pa.array(rows)), [pa.array(part, pa.string()).take(pa.array(rows))], k)
        rows, columns = rows[first], columns[first]
        expected = {(q, x[1]) for q in range(3) for p in set(part) for x in sorted((-scores[i, q], ids[i]) for i in range(n) if part[i] == p and scores[i, q] > 0)[:k]}
        assert {(int(q), ids[i]) for i, q in zip(rows, columns, strict=True)} == expected and len(rows) == len(expected)


def test_sidecar_lists_what_the_budget_left_out(spark):
    memories = spark.createDataFrame([memory("a", i, f"alpha word{i} " + "long " * 30) for i in range(4)], MEMORY)
    queries = spark.createDataFrame([(1, "alpha"), (2, "nothing like it")], "query_id long, query string")
    found = recall.hybrid(memories, queries, 4, 2.0)
    lines = recall.snippets(found.where("admitted").select("query_id", "memory_id", "found").join(memories.select("memory_id", "content"), "memory_id").join(queries, "query_id"))
    heads = found.where("admitted").select("query_id", "memory_id", "rank").join(memories.select("memory_id", "title"), "memory_id").withColumn("footer", F.lit("x\n"))
    contexts = recall.context(lines.join(heads, ["query_id", "memory_id"]), queries, 220)
    rows = {x.query_id: x for x in recall.sidecar(queries, found, "p", 4, contexts, 220).collect()}
    one = rows[1]
    assert len(one.ranked) == one.n_admitted == 4 and 0 < len(one.context.rendered_ids) < 4 and one.context.token_count <= 220
    left = {x.memory_id for x in one.ranked} - set(one.context.rendered_ids)
    assert {(x.memory_id, x.reason) for x in one.omissions} == {(m, "token_budget") for m in left} and one.freshness is None
    assert rows[2].outcome == "abstained" and rows[2].ranked == [] and rows[2].context.rendered_ids == []


def test_scores_that_k_others_exceed_are_no_candidates():
    bounds = recall.Bounds(3, 0.0)
    high, low = np.linspace(1, 2, 100).reshape(50, 2), np.full((50, 2), 0.5)
    high[7] = -np.inf
    everything = [((), np.arange(50))]
    row, column = bounds.candidates(0, everything, high)
    assert sorted(zip(row.tolist(), column.tolist())) == [(r, c) for r in (47, 48, 49) for c in (0, 1)]
    assert not len(bounds.candidates(0, everything, low)[0])
    # Ties with the third stay, another block and another value of the parts have bounds of their own.
    low[4] = high[47]
    assert bounds.candidates(0, everything, low)[0].tolist() == [4, 4]
    assert len(bounds.candidates(1, everything, low)[0]) == 100
    halves = [(("a",), np.arange(25)), (("b",), np.arange(25, 50))]
    assert sorted(set(bounds.candidates(0, halves, high)[0].tolist())) == [22, 23, 24, 47, 48, 49]
    groups = recall.groups_of([pa.array(["b", "a", None, "b"]), pa.array([1, 1, 1, 1])], 4)
    assert {key: rows.tolist() for key, rows in groups} == {("b", 1): [0, 3], ("a", 1): [1], (None, 1): [2]}


def test_tokens_of_columns_are_those_of_texts(spark):
    from tracelode.functions import columns, tokens

    texts = ["", "One two-2", "ends here", "starts", None, "É Straße ÇA²", "日本 語x", "𝒜b 🎉 İstanbul", "\n\n", "naïve K", "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i")
    rows = df.select(tokens.lowered(F.col("t")).alias("low"), columns.words(F.col("t")).alias("w"), columns.terms(F.col("t")).alias("a")).collect()
    column = pa.array(["left out", *(x.low for x in rows)]).slice(1)
    for kept, name in ((tokens.letters(), "w"), (tokens.ASCII, "a")):
        found, row = tokens.tokens(column, kept)
        got = [[] for _ in rows]
        for token, at in zip(found.to_pylist(), row, strict=True):
            got[at].append(token)
        assert got == [x[name] for x in rows]
    batch = pa.RecordBatch.from_pydict({"i": range(5), "t": ["x", "y" * tokens.SLICE_BYTES, "z", "w", "v"]})
    assert [x.num_rows for x in tokens.slices(batch, 2)] == [1, 1, 2, 1]


def test_lines_are_cut_as_by_regular_expressions(spark):
    """Every kind of white space and line end, in random texts, against the rule's plain form."""
    import re

    chance = random.Random(5)
    ends = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
    signs = "ab" + C.WHITE + ends + "\x1f᠎​﻿\xe9\U0001d11e"
    texts = ["".join(chance.choice(signs) for _ in range(chance.randrange(14))) for _ in range(2000)] + ["", None]

    def plain(text):
        return [x for x in (y.strip(C.WHITE) for y in re.split(f"[{ends}]", text or "")) if x]

    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", C.lines(F.col("text")).alias("every"), C.first_line(F.col("text")).alias("first")).collect()
    assert {len(r.every) for r in rows} > {0, 1, 2, 3}
    assert [(r.every, r.first) for r in rows] == [(plain(r.text), (plain(r.text) or [None])[0]) for r in rows]


def test_versions_are_checked_against_memories_projected_once(spark, tmp_path, monkeypatch):
    """Two rebuilds and two gates over one state: a projection for each version and one for the truth, in which a text is cut once."""
    rows = spark.createDataFrame([memory("a", 1, "one\n two \n\nthree"), memory("b", 2, "one")], MEMORY)
    store, project, times = index_store.IndexStore(spark, f"file://{tmp_path}/once"), recall.project, []
    monkeypatch.setattr(recall, "project", lambda m: (times.append(1), project(m))[1])
    truth = store.truth(rows)
    for _ in range(2):
        report = store.rebuild(rows, truth).first()
        assert report.parity and report.truth_count == report.index_count and report.truth_document_count == report.index_document_count == project(rows).count()
        store.require(rows, truth=truth)
    assert len(times) == 3
    assert str(recall.marks(project(rows), ["repo_key"])._jdf.queryExecution().optimizedPlan()).count("split(") == 1
