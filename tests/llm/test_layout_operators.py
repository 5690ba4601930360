"""Operators that lay rows out: top-k (3), mixing (4), sharding (5), token files (9), packing (10)."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.llm import encode, mixing, packing, sharding, token_files, topk
from tracelode.llm.common import numbered

from ..oracle import same
from .helpers import ascii_words, edge_documents, empty_documents


def brute_top(rows, queries, k=10):
    out = []
    for q, v in queries:
        best = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in rows if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_brute_force(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, 1.0 + r.random()]) for _ in range(8)]) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(20)]  # ties
    exact = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = topk.exact_top_k(table, F.col("vec_id") % 100 == 0, tile=64, query_block=3, fan_in=2)
    assert sorted(map(tuple, found.collect())) == brute_top(exact, [x for x in exact if x[0] % 100 == 0])


def test_top_k_of_many_shards(spark):
    """Deep trees of merges, several shards a task, and components of each width of integer."""
    r = random.Random(7)
    rows = [(i, [r.choice([1.0, 0.5, 40.0, 3e6]) * r.random() for _ in range(3 + i % 2)]) for i in range(900)]
    exact = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    found = topk.exact_top_k(table, F.col("vec_id") % 100 == 0, k=4, tile=8, query_block=2, fan_in=3, task_shards=5)
    assert sorted(map(tuple, found.collect())) == brute_top(exact, [x for x in exact if x[0] % 100 == 0], 4)


@pytest.mark.parametrize("most", [1 << 14, 1 << 15, 1 << 31, 1 << 62])
def test_packed_matrices(most):
    vectors = [[most, -most], [1], []]
    data, size, width = topk.packed(vectors)
    assert topk.unpacked(data, size, width, 3).tolist() == [[most, -most], [1, 0], [0, 0]]


def test_top_k_edges(spark):
    rows = [(0, [1.0, 2.0], 1), (100, [1.0, None], 1), (200, None, 1), (None, [1.0, 1.0], 1), (1, [float("nan"), 1.0], 1), (2, [float("inf"), 1.0], 1), (3, [1.0, 1.0], 1), (3, [2.0, 0.0], 1), (4, [], 1), (5, [1e30, 1.0], 1)]
    found = sorted(map(tuple, topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long"), F.col("vec_id") % 100 == 0).collect()))
    assert [x[2] for x in found] == [5, 3, 3, 4] and {x[0] for x in found} == {0}
    assert topk.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect() == []


def test_targets(spark):
    """Excess is dealt again by weight until no source is above twice its size."""
    rows = [("a", 10), ("b", 1000), ("c", 500), (None, 90), ("d", 0)]
    found = {x.source: x.target for x in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    order = sorted((s for s, _ in rows if s is not None)) + [None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    size, free, capped = dict(rows), set(order), {}
    while True:
        left = 1.5 * sum(size.values()) - sum(capped.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            break
        capped |= {s: 2.0 * size[s] for s in over}
        free -= over
    for s in order:
        assert found[s] == pytest.approx(capped.get(s, share.get(s)))


def check_mix(docs):
    found = mixing.mix(docs).collect()
    words = sorted(len(ascii_words(x.text)) for x in docs.select("text").collect())
    assert sorted(x.size for x in found) == words
    taken = {}
    for x in found:
        assert 0 <= x.taken <= 2 * x.size
        taken[(x.source_size, x.target)] = taken.get((x.source_size, x.target), 0) + x.taken
    return found, taken


def test_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found, taken = check_mix(docs)
    assert all(t == pytest.approx(target, abs=1) for (_, target), t in taken.items())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(x.size for x in found), abs=5)
    again = {x.doc_id: x.taken for x in mixing.mix(docs.repartition(7)).collect()}
    assert again == {x.doc_id: x.taken for x in found}


def test_mix_draws_in_key_order(spark):
    """In a source the fractional epoch takes a prefix of the order of -ln(u) / w; heavier rows come sooner."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("source"))
    u = mixing.uniform("doc_id")
    rows = docs.join(mixing.mix(docs, key=u, weight=F.lit(2.0)), "doc_id").withColumn("k", -F.log(u) / 2.0).collect()
    for source in "xy":
        own = sorted((x.k, x.taken) for x in rows if x.source == source)
        takes = [t for _, t in own]
        assert takes == sorted(takes, reverse=True) and len(set(takes)) <= 3
    heavy = mixing.mix(docs.where("source = 'y'").unionByName(docs.where("source = 'x'")), weight=F.when(F.col("doc_id") % 4 == 1, 8.0).otherwise(1.0))
    part = heavy.withColumn("heavy", F.col("doc_id") % 4 == 1).where("doc_id % 2 = 1 and target % source_size <> 0").groupBy("heavy").agg(F.avg("taken").alias("t")).collect()
    if len(part) == 2:
        assert dict(map(tuple, part))[True] > dict(map(tuple, part))[False]


def test_mix_spreads_rows_without_id(spark):
    """Rows without id are drawn by their texts, not all at one place of the order."""
    docs = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    found, taken = check_mix(docs)
    assert all(t == pytest.approx(target, abs=1) for (_, target), t in taken.items())
    keys = docs.select(mixing.uniform(F.concat(F.lit("\x00"), F.xxhash64("text").cast("string"))).alias("u")).distinct().count()
    assert keys == 400


def test_targets_of_many_sources(spark):
    """A source for each host: ranks and sums over ranges agree with a plain pass."""
    r = random.Random(6)
    rows = [(f"h{i:04}", r.choice([0, 1, 5, 90, 2000])) for i in range(900)] + [(None, 40)]
    found = {x.source: x.target for x in mixing.targets(spark.createDataFrame(rows, "source string, source_size long").repartition(7)).collect()}
    order = sorted(rows[:-1]) + rows[-1:]
    w = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(order)}
    left, rest, level = 1.5 * sum(n for _, n in rows), sum(w.values()), None
    for s, n in sorted(rows, key=lambda x: 2 * x[1] / w[x[0]]):
        if left / rest < 2 * n / w[s]:
            level = left / rest
            break
        left, rest = left - 2 * n, rest - w[s]
    for s, n in rows:
        assert found[s] == pytest.approx(2 * n if level is None else min(2 * n, level * w[s]))


def test_mix_is_native(spark, sf):
    plan = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_mix_edges(spark):
    found, _ = check_mix(edge_documents(spark))
    assert len(found) == 11 and {x.taken for x in found if x.size == 0} == {0}
    assert mixing.mix(empty_documents(spark)).collect() == []
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert {(x.size, x.target, x.taken) for x in mixing.mix(blank).collect()} == {(0, 0.0, 0)}


def hilbert_distance_one(points):
    return (np.abs(np.diff(points, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("dimensions, bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_visits_neighbours(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    place = sharding.hilbert(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    assert hilbert_distance_one(cells[np.argsort(place)])


def check_shards(docs):
    rows = docs.select("doc_id", "text").collect()
    found = sharding.shard_by_hilbert(docs).collect()
    assert sorted((len((x.text or "").encode()) + 16, zlib.crc32((x.text or "").encode())) for x in rows) == sorted((x["size"], x.text_crc32) for x in found)
    counts = [0] * 40
    slots = {}
    for x in found:
        assert x.law == "rows" and x.grown_shard is None
        counts[x.shard] += 1
        slots.setdefault(x.shard, []).append(x.slot)
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return found


def test_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = check_shards(docs)
    again = sharding.shard_by_hilbert(docs.repartition(5)).collect()
    assert {x.doc_id: (x.shard, x.slot) for x in found} == {x.doc_id: (x.shard, x.slot) for x in again}
    by = {}
    source = {x.doc_id: x.source for x in docs.collect()}
    for x in found:
        by.setdefault(x.shard, set()).add(source[x.doc_id])
    assert sum(map(len, by.values())) / 40 < len(set(source.values())) / 2  # runs span few sources


def plain_cells(values, bits=sharding.BITS):
    """Each value's cell: how many rows are before it, in so many parts of all rows; nulls first."""
    order = sorted(values, key=lambda x: (x is not None, x if x is not None else 0))
    first = {}
    for i, x in enumerate(order):
        first.setdefault(x, i)
    return [0 if x is None else first[x] * (1 << bits) // len(values) for x in values]


def check_order(docs):
    """Shards and slots against a plain sort of all rows along the curve."""
    rows = docs.select("doc_id", "text", "source", "lang", F.xxhash64("text").alias("same")).collect()
    sizes = [len((x.text or "").encode()) + 16 for x in rows]
    cells = np.array([plain_cells([x.source for x in rows]), plain_cells([x.lang for x in rows]), plain_cells(sizes)]).T
    place = sharding.hilbert(cells, sharding.BITS)
    order = sorted(range(len(rows)), key=lambda i: (place[i], rows[i].same, rows[i].doc_id is not None, rows[i].doc_id or 0))
    found = sorted((x.shard, x.slot, x.hilbert, x.doc_id) for x in sharding.shard_by_hilbert(docs).collect())
    assert [(x[2], x[3]) for x in found] == [(place[i], rows[i].doc_id) for i in order]
    return rows, cells, found


def test_shards_brute_force(spark, sf):
    check_order(spark.read.parquet(f"{sf}/documents.parquet"))


def test_shards_of_sources_with_a_common_start(spark):
    """Sources that differ after many equal bytes are told apart, and files can be pruned by source and by lang."""
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randrange(1, 60)), r.choice("defr"), f"https://common.example/crawl-{r.randrange(8)}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    check_order(docs)
    of = {x[0]: x for x in rows}
    for column, most in ((2, 0.7), (3, 0.5)):
        files = {}
        for x in sharding.shard_by_hilbert(docs).collect():
            files.setdefault(x.shard, set()).add(of[x.doc_id][column])
        kinds = {x[column] for x in rows}
        assert sum(map(len, files.values())) < most * 40 * len(kinds)  # files that one value needs, of all


def test_equal_texts_share_a_shard(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of the group "), (F.col("id") % 1000 + 1000).cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    shards = {}
    for x in sharding.shard_by_hilbert(docs).collect():
        shards.setdefault(x.doc_id % 1000, set()).add(x.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 39  # a cut of a shard splits one group at most


def test_shards_edges(spark):
    assert len(check_shards(edge_documents(spark))) == 11
    check_order(edge_documents(spark))
    assert sharding.shard_by_hilbert(empty_documents(spark)).collect() == []


def test_numbered(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    found = sorted((x.rank, x.k, x.id) for x in numbered(rows, "k", "id").collect())
    assert [x[0] for x in found] == list(range(1000)) and [x[1:] for x in found] == sorted(x[1:] for x in found)


TEXTS = [
    None, "", " ", "\n\n", "a", "Hello, world!! it's", " lead", "trail  ", "two  blanks\n\n x\ty\r\nz", "don't DON'T we'll", "1234 12,5 3.14", "ünïcodé Straße ǅ İ ﬁ ẞ",
    "emoji \U0001f600\U0001f468‍\U0001f469 x", "<|endoftext|> <|startoftext|> </w>", "é combining", "中文字符 テスト", "x y z　w", "\x00\x01 null", "a.b,c;d!? e?!", "word" * 500,
    "many " * 3000, "tab\tsep\x0bvt\x0cff", "İstanbul ẞ", "ΣΣ ΟΔΟΣ end", "   mixed  ", "a\u0085b   c",
]


@pytest.mark.parametrize("name, words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_encoder_equals_one_call(name, words, sf, spark):
    from tokenizers import Tokenizer

    path = encode.tokenizer_path(name)
    plain = Tokenizer.from_file(path)
    texts = TEXTS + [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    r = random.Random(5)
    pool = "abcÀéß .,!?'\n\t 12 ̀İΣσ中\U0001f600"
    texts += ["".join(r.choice(pool) for _ in range(r.randrange(60))) for _ in range(1500)]
    own = encode.Encoder(path, words)
    for _ in range(2):  # the second time from what it keeps
        for t, ids in zip(texts, own.ids([(t or "").encode() for t in texts]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_encoder_slices_long_texts():
    from tokenizers import Tokenizer

    text = ("Some words, é and 12 more;  two blanks\n" * 70_000)[: 5 * encode.SLICE // 2]
    for name, words in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        path = encode.tokenizer_path(name)
        assert np.frombuffer(encode.Encoder(path, words).ids([text.encode()])[0], "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def reference_ids(rows, name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.tokenizer_path(name))
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, end]) for i, x in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_codes_are_directly_addressable():
    r = np.random.default_rng(2)
    for ids in (np.zeros(0, np.uint32), np.array([0], np.uint32), r.integers(0, 50_000, 5000, dtype=np.uint32), r.integers(0, 1 << 32, 3000, dtype=np.uint32), np.array([255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], np.uint32)):
        segment = token_files.Segment(token_files.pack_segment([1, None], [ids[:10], ids[10:]]))
        assert segment.ids().tolist() == ids.tolist()
        assert [segment.at(i) for i in range(0, len(ids), 7)] == ids[::7].tolist()
        assert segment.doc_ids == [1, None] and segment.starts.tolist() == [0, min(10, len(ids)), len(ids)]
    with pytest.raises(ValueError, match="segment"):
        token_files.Segment(b"nothing!")


def test_token_files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    token_files.write_token_files(docs, f"file://{tmp_path}/t", segment_ids=5000)
    found = {x.doc_id: x for x in token_files.read_token_files(spark, f"file://{tmp_path}/t").collect()}
    start = 0
    for i, ids in reference_ids(sorted((x.doc_id, x.text) for x in docs.collect()), "byte_bpe_50k.json", 2):
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_token_files_edges(spark, tmp_path):
    token_files.write_token_files(edge_documents(spark), f"file://{tmp_path}/t")
    found = token_files.read_token_files(spark, f"file://{tmp_path}/t").collect()
    assert len(found) == 11
    at = 0
    for x in sorted(found, key=lambda x: x.start):
        assert x.start == at
        at += x.n_tokens
    assert [x.doc_id for x in sorted(found, key=lambda x: x.start)] == [None, None, 1, 2, 3, 4, 5, 6, 6, 7, 8]
    assert {x.n_tokens for x in found if x.doc_id in (2, 3)} == {1}
    token_files.write_token_files(empty_documents(spark), f"file://{tmp_path}/e")
    assert token_files.read_token_files(spark, f"file://{tmp_path}/e").collect() == []


def check_packing(docs):
    rows = sorted(((x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()), key=repr)
    pieces = packing.pack_documents(docs, with_ids=True).collect()
    sequences = {}
    for p in pieces:
        assert p.length == len(p.ids) and crc(p.ids) == p.ids_crc32
        sequences.setdefault(p.sequence_id, []).append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert len(own) <= packing.SEGMENTS and sum(p.loss_tokens for p in own) <= packing.LOSS
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at <= 2048
    return rows, pieces, sequences


def test_packing(spark, sf):
    rows, pieces, sequences = check_packing(spark.read.parquet(f"{sf}/documents.parquet"))
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    total = 0
    for i, ids in reference_ids(rows, "word_bpe_49k.json", 1):
        own = sorted(by[i], key=lambda p: p.start)
        assert [x for p in own for x in p.ids] == ids and {p.doc_tokens for p in own} == {len(ids)}
        assert all(a.start + a.length == b.start for a, b in zip(own, own[1:], strict=False))
        total += len(ids)
    assert len(sequences) * 2048 < 1.03 * total + 2048 * 8


def test_packing_edges(spark):
    rows, pieces, _ = check_packing(edge_documents(spark))
    assert sum(p.length for p in pieces) == sum(len(ids) for _, ids in reference_ids(rows, "word_bpe_49k.json", 1))
    assert packing.pack_documents(empty_documents(spark)).collect() == []


def test_fill_keeps_all_limits():
    r = random.Random(8)
    for _ in range(30):
        lengths = [r.choice([1, 2, 7, 60, 500, 3000]) for _ in range(r.randrange(60))]
        seen = {i: [] for i in range(len(lengths))}
        for placed in packing.fill(lengths, (100, 5, 90), 8):
            assert sum(n for _, _, n in placed) <= 100 and len(placed) <= 5 and sum(n - 1 for _, _, n in placed) <= 90
            for i, start, n in placed:
                seen[i].append((start, n))
        for i, parts in seen.items():
            parts.sort()
            assert sum(n for _, n in parts) == lengths[i] and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))


def plain_fill(lengths, prompts, limits, cut):
    """The dot-product heuristic over all pieces one by one; or the longest that fits, where by_length."""
    def loss(length, lead):
        return max(0, length - max(lead, 1))

    open_pieces = []
    for i, (length, lead) in enumerate(zip(lengths, prompts, strict=True)):
        start = 0
        while length - start > min(limits[0], max(lead - start, 1) + limits[2]):
            part = min(limits[0], max(lead - start, 1) + limits[2])
            open_pieces.append((i, start, part, lead - start))
            start += part
        open_pieces.append((i, start, length - start, lead - start))
    needs = [(n, 1, loss(n, lead)) for _, _, n, lead in open_pieces]
    weight = [sum(x[r] for x in needs) / len(needs) / limits[r] ** 2 for r in range(3)]
    out = []
    while open_pieces:
        room, placed = list(limits), []
        while open_pieces:
            fit = [p for p in open_pieces if p[2] <= room[0] and 1 <= room[1] and loss(p[2], p[3]) <= room[2]]
            if fit:
                p = max(fit, key=lambda p: sum(x * w * a / b for x, w, a, b in zip((p[2], 1, loss(p[2], p[3])), weight, room, limits, strict=True)))
                part = p[2]
                open_pieces.remove(p)
            else:
                starts = lambda p: min(room[0], max(p[3], 1) + room[2], p[2])
                p = max(open_pieces, key=lambda p: (starts(p), p[2], loss(p[2], p[3])))
                part = starts(p)
                if room[1] < 1 or part < cut or part >= p[2]:
                    break
                open_pieces.remove(p)
                open_pieces.append((p[0], p[1] + part, p[2] - part, p[3] - part))
            placed.append((part, loss(part, p[3])))
            room = [room[0] - part, room[1] - 1, room[2] - loss(part, p[3])]
        out.append(placed)
    return out


def test_fill_against_a_plain_version():
    """The same demands in each sequence as the heuristic over single pieces; pieces of equal demand are interchangeable."""
    r = random.Random(15)
    for _ in range(40):
        lengths = [r.choice([1, 2, 9, 30, 47, 61, 250]) for _ in range(r.randrange(1, 40))]
        prompts = [r.randrange(n + 1) for n in lengths]
        limits = (100, 6, 60)
        found = [[(n, max(0, n - max(prompts[i] - start, 1))) for i, start, n in placed] for placed in packing.fill(lengths, limits, 8, prompts)]
        assert found == plain_fill(lengths, prompts, limits, 8)
        assert all(sum(n for n, _ in s) <= 100 and len(s) <= 6 and sum(x for _, x in s) <= 60 for s in found)


def test_loss_limit_binds():
    """Prompts go with responses: where loss is scarce, the longest piece that fits isn't taken first."""
    lengths, prompts = [60] * 10 + [40] * 10, [0] * 10 + [40] * 10
    sequences = packing.fill(lengths, (100, 8, 62), 8, prompts)
    assert [sorted(i // 10 for i, _, _ in s) for s in sequences] == [[0, 1]] * 10
    r = random.Random(3)
    differs = 0
    for _ in range(40):
        lengths = [r.randrange(5, 60) for _ in range(30)]
        prompts = [r.choice([0, n // 2, n]) for n in lengths]
        longest = packing.fill(lengths, (100, 8, 99), 100, None)
        bound = packing.fill(lengths, (100, 8, 62), 100, prompts)
        assert all(sum(max(0, n - max(prompts[i], 1)) for i, _, n in s) <= 62 for s in bound)
        differs += sorted(sorted(i for i, _, _ in s) for s in bound) != sorted(sorted(i for i, _, _ in s) for s in longest)
    assert differs > 30


def test_prompts():
    assert packing.prompt(b"Do it.\nNow\n\nDone. Yes") == b"Do it.\nNow\n\n"
    assert packing.prompt(b"Question: why?\nAnswer: so. Yes") == b"Question: why?\nAnswer:"
    assert packing.prompt(b"One. Two. Three") == b"One. " and packing.prompt(b"no end") == b""


def test_empty_documents_share_a_sequence(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")).coalesce(1)
    assert packing.pack_documents(docs).select("sequence_id").distinct().count() == 1


def test_sql(spark, sf):
    from tracelode.llm.queries import ORACLE_SQL, QUERIES

    for name, sql in ORACLE_SQL.items():
        assert same(QUERIES[name](spark, sf), sql, sf)
