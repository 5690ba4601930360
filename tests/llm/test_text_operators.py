"""Operators that read each text: media (1), licences (2), quality (7), pages (8)."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.llm import gam, html_text, licenses, media

from .helpers import LONG, edge_documents, empty_documents


def padded(text):
    data = (text or "").encode()
    return data, data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))


def test_media_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {x.doc_id: x.text for x in docs.collect()}
    found = media.media_features(docs).collect()
    assert len(found) == len(texts)
    by_text = {}
    for x in found:
        data, payload = padded(texts[x.doc_id])
        assert (x.n_bytes, x.payload_bytes) == (len(data), len(payload))
        assert x.payload_sha256 == hashlib.sha256(payload).hexdigest() and x.tail_crc32 == zlib.crc32(payload[-32:])
        file = media.wav(data)
        assert media.samples(file) == payload
        assert (x.media_bytes, x.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        assert by_text.setdefault(texts[x.doc_id], x.feature) == x.feature
        assert len(x.pair_time) == len(x.pair_code) and x.pair_time == sorted(x.pair_time)


def test_media_finds_a_tone():
    """A sine of bin 40 peaks there in every frame, and its pairs name that bin."""
    t = np.arange(576 * 8)
    payload = (128 + 100 * np.sin(2 * np.pi * 40 * t / 576)).astype(np.uint8).tobytes()
    at = media.peaks(payload)
    assert (at == 40).any(axis=1).all()
    _, codes = media.pairs(at)
    assert (codes >> 13 == 40).any()
    time, code = media.pairs(media.peaks(b"\xff" * 576))
    assert len(time) == len(code) == 0


def test_media_edges(spark):
    found = media.media_features(edge_documents(spark)).collect()
    assert len(found) == 11
    assert {x.payload_bytes for x in found if x.n_bytes == 0} == {576}
    assert {x.n_bytes for x in found if x.doc_id == 7} == {len(LONG.encode())}
    assert media.media_features(empty_documents(spark)).collect() == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_licenses(texts, df, n):
    """Every template at every place, without an index."""
    idf = {w: np.log((n + 1) / (k + 1)) + 1 for w, k in df.items()}
    out = {}
    for i, text in texts:
        words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        base, labels, score = [], set(), 0.0
        for t in licenses.TEMPLATES:
            seq = t.words.split()
            for at in range(len(words)):
                if not t.keys:
                    if words[at : at + len(seq)] != seq:
                        continue
                    s = 1.0
                else:
                    there = [words[at + k] if at + k < len(words) else None for k in range(len(seq))]
                    places = [next(k for k in range(len(seq)) if seq[k : k + len(p.split())] == p.split()) for p in t.keys]
                    if any(there[k : k + len(p.split())] != p.split() for k, p in zip(places, t.keys, strict=True)):
                        continue
                    s = sum(idf[w] for w, x in zip(seq, there, strict=True) if w == x) / sum(idf[w] for w in seq)
                    if s < t.share:
                        continue
                labels.add((t.label, t.base))
                score = max(score, s)
                if t.base:
                    base.append(at)
        out[i] = (len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted({x for x, b in labels if b})), ",".join(sorted({x for x, _ in labels})), round(float(score), 6))
    return out


def check_licenses(docs):
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    df, n = licenses.document_frequencies(docs)
    expected = brute_licenses(rows, df, n)
    for x in licenses.scan_licenses(docs).collect():
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels, round(x.score, 6)) == expected[x.doc_id]
    return expected


def test_licenses_brute_force(spark, sf):
    expected = check_licenses(spark.read.parquet(f"{sf}/documents.parquet"))
    assert any(x[1] for x in expected.values())


def test_licenses_planted(spark):
    mit = licenses.TEMPLATES[9].words
    near = mit.replace("associated", "related").replace("deal", "trade")
    far = " ".join(w if i % 2 else "other" for i, w in enumerate(mit.split()))
    texts = [
        "x Under the MIT-license under the mit license", "CC-BY-NC, cc by nc cc by nc", "apache license, version 2.0", f"before {mit.upper()} after", f"a {near}", far,
        "cut off: permission is hereby granted free of", "éunder the mit license", "under the mit licenseé", "gnu general public license version 3", "",
    ]
    expected = check_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert expected[0][1:5] == (2, 1, 5, "mit")
    assert expected[1][1] == 3
    assert expected[3][5] == expected[4][5] == "mit" and expected[5][5] == "" and expected[7][1] == expected[8][1] == 0


def test_anchors_lose_no_match():
    """Any words of a template may be lacking outside its key phrases as long as the share stands: enough anchors and the leading one do then."""
    r = random.Random(2)
    for _ in range(300):
        t = r.choice(licenses.TEMPLATES)
        sequence = t.words.split()
        idf = {w: r.choice([0.5, 1.0, 3.0, 9.0]) for w in sequence}
        places, needed = licenses.anchored(t, idf, r.choice([2, 3, 6]))
        assert 1 <= needed <= len(places)
        must, total = licenses.mandatory_places(t), sum(idf[w] for w in sequence)
        for _ in range(20):
            lacking, spare = set(), (1 - t.share) * total
            for i in r.sample(range(len(sequence)), len(sequence)):
                if i not in must and t.keys and idf[sequence[i]] <= spare:
                    lacking.add(i)
                    spare -= idf[sequence[i]]
            stand = [i for i in places if i not in lacking]
            assert len(stand) >= needed and places[0] in stand


def test_anchors_rule_out_starts():
    """A single rare word doesn't make a start worth verifying: several anchors have to agree."""
    idf = {w: 5.0 for t in licenses.TEMPLATES for w in t.words.split()}
    for t in licenses.TEMPLATES:
        assert licenses.anchored(t, idf)[1] >= 2, t


def test_licenses_of_very_long_texts(spark):
    """Linear in the hits: a text that repeats a notice many times."""
    text = f"{licenses.TEMPLATES[9].words} and {licenses.TEMPLATES[0].words}. " * 2_000
    x = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert x.n_base == 2_000 and x.labels == "mit" and x.score == 1


def test_licenses_edges(spark):
    found = licenses.scan_licenses(edge_documents(spark)).collect()
    assert len(found) == 11
    assert {(x.n_words, x.labels, x.score) for x in found if x.doc_id in (2, 3, 4)} == {(0, "", 0.0)}
    assert {x.base_labels for x in found if x.doc_id in (1, 5)} == {"mit"}
    assert licenses.scan_licenses(empty_documents(spark)).collect() == []


def test_licenses_plan_is_native(spark, sf):
    plan = licenses.scan_licenses(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    pos = label == 1
    return (rank[pos].mean() - (pos.sum() - 1) / 2) / (~pos).sum()


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = gam.classify_quality(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(rows) > 50
    assert auc(rows.score.to_numpy(), rows.quality.to_numpy()) > 0.9
    good = rows[rows.quality == 1]
    assert (good.predicted == 1).mean() > 0.9
    assert ((rows.predicted == 1) == (rows.quality == 1)).mean() > 0.85


def test_quality_never_learns_from_held_out(spark, sf):
    """Other labels of held-out rows change nothing."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(gam.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({x.doc_id: x.score for x in gam.classify_quality(docs, y).collect()} for y in (labels, turned))
    assert a == b


def test_quality_held_out_law(spark):
    found = gam.classify_quality(spark.createDataFrame([(i, "a b") for i in range(50)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int"))
    for x in found.collect():
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3)


def test_quality_takes_the_same_text_of_repeated_ids(spark):
    """Several texts of one id: the one of the smallest hash is learnt from, however rows are dealt."""
    rows = [(i, text) for i in range(60) for text in ("Plain words stand here, one after another. " * (i % 7 + 1), "a ## !! " * (i % 5 + 1))]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    models = [gam.learn(docs.repartition(n, *by), labels) for n, by in ((1, ()), (6, ()), (4, (F.col("text"),)))]
    one = [x.text for x in docs.withColumn("h", F.xxhash64("text")).groupBy("doc_id").agg(F.min_by("text", "h").alias("text")).orderBy("doc_id").collect()]
    models.append(gam.learn(spark.createDataFrame(list(enumerate(one)), "doc_id long, text string"), labels))
    for m in models[1:]:
        assert m.bias == models[0].bias and all((a == b).all() for a, b in zip(m.tables, models[0].tables, strict=True))


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (7, 1), (8, 0)], "doc_id long, quality int")
    found = gam.classify_quality(edge_documents(spark), labels).collect()
    assert len(found) == 11 and len({x.score for x in found if x.doc_id in (2, 3, 4)}) == 1
    assert gam.classify_quality(empty_documents(spark), labels).collect() == []


def test_gam_pairs_learn_an_interaction():
    """The exclusive or of two features, which no sum of single tables expresses."""
    r = np.random.default_rng(1)
    x = r.random((3000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x[:2000], y[:2000])
    assert any({i, j} == {0, 1} for i, j, _ in model.pairs)
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


PAGE = """<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>var a = "</p><p>no";</script></head><body>
<header class="top"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div id="cookie-notice">We use cookies</div>
<div class="wrap"><div class="content"><h2>Title &amp; more {n}</h2><p>First   <b>bold</b> part{n}.<br>Next
line</p><ul><li>one</li><li>two</li></ul><blockquote>said &lt;b&gt; &#233;</blockquote></div></div>
<aside>Related things</aside><section class="comments"><p>Nice post {n}</p></section><form><input value="x">Name</form><footer>Copyright</footer></body></html>"""


def expected_text(n):
    return f"Title & more {n} First bold part{n}. Next line one two said <b> é"


def test_pages_of_a_host(spark):
    rows = [(i, f"https://Site.example/{i}?a=1", PAGE.format(n=i)) for i in range(8)] + [(100, "https://alone.example/", PAGE.format(n="x")), (101, None, PAGE.format(n="y"))]
    found = {x.page_id: x for x in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert found[i].text == expected_text(i) and found[i].n_chars == len(found[i].text)
    assert found[100].text == expected_text("x") and found[101].text == expected_text("y")


def test_pages_template_finds_the_slot(spark):
    rows = [(i, "http://h.example/", PAGE.format(n=i)) for i in range(4)]
    marked = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("'h.example' as host", "page_id as mark", "html")
    slot = html_text.templates(marked).collect()[0].slot
    assert slot.endswith("/div.content")


def of_host(spark, pages, url="http://h.example/"):
    rows = [(i, url, page) for i, page in enumerate(pages)]
    found = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    return [x.text for x in sorted(found.collect(), key=lambda x: x.page_id)]


def test_template_text_in_the_slot_is_taken_out(spark):
    """A notice and a list of links of neutral names, inside the slot: the same on the host's pages, or links that change."""
    page = '<body><div class="q1"><div class="x7">We use cookies</div><div class="k9"><a href="/">go {n}</a> <a href="/">on {n}</a></div><h2>Head {n}</h2><p>Body text {n} here, of some more words than what is around it</p><p class="end">Read us daily</p></div></body>'
    assert of_host(spark, [page.format(n=i) for i in range(6)]) == [f"Head {i} Body text {i} here, of some more words than what is around it" for i in range(6)]


def test_all_slots_are_returned(spark):
    """A lead beside the body, neither inside an article element, and a part that some pages lack."""
    page = '<body><div class="intro">Lead {n} of the page.</div><div class="c"><p>Body {n} text.</p></div>{more}</body>'
    pages = [page.format(n=i, more=f"<div class='last'><p>Coda {i}</p><p>The end</p></div>" if i % 3 else "") for i in range(9)]
    assert of_host(spark, pages) == [f"Lead {i} of the page. Body {i} text." + (f" Coda {i}" if i % 3 else "") for i in range(9)]


def test_classes_out_of_order_are_no_template(spark):
    """Two runs that every page has, but not in one order, are text of the pages."""
    parts = ["<p class='a'>First say</p>", "<p class='b'>Then say</p>"]
    pages = [f"<body><div>{''.join(parts if i % 2 else parts[::-1])}<p class='c'>Own text of page {i} which is longer</p></div></body>" for i in range(6)]
    own = [f"Own text of page {i} which is longer" for i in range(6)]
    assert of_host(spark, pages) == [("First say Then say " if i % 2 else "Then say First say ") + own[i] for i in range(6)]
    # In one order they are the template's.
    assert of_host(spark, [x.replace("".join(parts[::-1]), "".join(parts)) for x in pages]) == own


def test_copies_of_one_article_keep_their_text(spark):
    pages = ["<body><div><p>The very same article</p><p>in every page</p></div></body>"] * 5
    assert of_host(spark, pages) == ["The very same article in every page"] * 5


def brute_classes(pages):
    """Occurrence vectors as they are: classes of two tokens or more that stand once in each of at least half of the pages."""
    counts = [{html_text.number(t): x[2] for t, x in html_text.page_tokens(p).items()} for p in pages]
    vectors = {}
    for token in set().union(*counts):
        vector = tuple(c.get(token, 0) for c in counts)
        if max(vector) == 1 and 2 * sum(vector) >= len(pages):
            vectors.setdefault(vector, set()).add(token)
    return {frozenset(x) for x in vectors.values() if len(x) > 1}


def test_classes_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(html_text.host_of(F.col("url")).alias("host"), "page_id", "html").collect()
    hosts = {}
    for x in pages:
        hosts.setdefault(x.host, []).append(x)
    name, own = max(hosts.items(), key=lambda x: len(x[1]))
    assert len(own) >= 4
    marked = spark.createDataFrame([(name, x.page_id, x.html) for x in own], "host string, mark long, html string")
    found = {}
    for x in html_text.classes(marked).collect():
        found.setdefault(x["class"], set()).add(x.token)
    assert {frozenset(x) for x in found.values()} == brute_classes([x.html for x in own])


def test_deep_pages_take_little_memory():
    import tracemalloc

    page = "<div>" * 30_000 + "deep" + "</span>" * 30_000
    tracemalloc.start()
    assert html_text.main_text(page, None) == "deep"
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_pages_edges(spark):
    schema = "page_id long, url string, html string, host string, slot string, text string, mark long"
    rows = [(1, None, None), (2, "nonsense", ""), (None, "http://a.example/", "<p>open <i>never closed"), (3, "http://a.example/", "plain text &amp; no tags"), (4, "http://a.example/", "<<>><p attr='x>y</p>"), (4, "http://a.example/", "<p>same</p>"), (5, "http://b.example/", "<div>" * 3000 + "deep")]
    found = html_text.extract_main_text(spark.createDataFrame([(*r, "h", "s", "t", 0) for r in rows], schema)).collect()
    by = {x.page_id: x.text for x in found}
    assert len(found) == 7 and by[1] == by[2] == "" and by[3] == "plain text & no tags" and by[5] == "deep" and by[None] == "open never closed"
    assert html_text.extract_main_text(spark.createDataFrame([], schema)).collect() == []


def test_pages_table_has_no_boilerplate(spark, sf):
    found = html_text.extract_main_text(spark.read.parquet(f"{sf}/pages.parquet")).toPandas()
    assert (found.n_chars > 0).mean() > 0.95
    assert not found.text.str.contains(r"<(?:p|div|script|li)\b|track\(", regex=True).any()
    assert json.dumps(found.n_chars.tolist()) == json.dumps([len(t) for t in found.text])


@pytest.mark.parametrize("html, text", [("<p>a</p>b<p>c", "a b c"), ("a<script>x</script>b", "ab"), ("<!-- <p>no</p> -->yes", "yes"), ("<p>a&nbsp;b</p>", "a b"), ("<p hidden>no</p><p>yes</p>", "yes")])
def test_main_text(html, text):
    assert html_text.main_text(html, None) == text


@pytest.mark.parametrize("html, text", [
    ('<div class="content has-sidebar"><p>Text here</p><div class="sidebar">no</div></div>', "Text here"),
    ('<div id="page-with-comments"><article><p>Text</p></article><div class="comments">' + "much said " * 20 + "</div></div>", "Text"),
    ('<article><h2 class="section-header">Head</h2><p>Price <span class="share-price">12</span> now</p><section class="discussion"><p>We saw it</p></section><div class="share"><a href="/">Share</a></div></article>', "Head Price 12 now We saw it"),
    ('<p>a<svg class="icon"/> b</p><p>c</p>', "a b c"),
    ('<p>a<svg class="icon"> b</p><p>c</p>', "a b c"),
    ("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <math/> then</p>", "if x=1 and then"),
    ('<p>a</p><svg><text>no</text></svg><script>var b', "a"),
])
def test_noise_by_names_and_raw_elements(html, text):
    assert html_text.main_text(html, None) == text


@pytest.mark.parametrize("n", [3, 6])
def test_shared_headings_of_articles_stay(spark, n):
    """What stands among an article's own texts stays, on hosts of few pages and of many; a notice goes."""
    page = '<html><body><div class="x7">We use cookies</div><article><h1>Soup {0}</h1><h2>Ingredients</h2><p>Carrot {0} and salt.</p><p>Serves two.</p><h2>Method</h2><p>Boil for {0} minutes.</p><p>All rights reserved.</p></article></body></html>'
    body = '<html><body><div class="x7">We use cookies</div><div class="body"><h1>Soup {0}</h1><div class="y"><b>Try</b><p>our app.</p></div><p class="notice">Important {0}: hot.</p><h2>Method</h2><p class="share-price">It costs {0}.</p></div></body></html>'
    rows = [(i, f"http://{host}.example/{i}", form.format(i)) for host, form in (("a", page), ("b", body)) for i in range(n)]
    found = {(x.url[7], x.page_id): x.text for x in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(n):
        assert found["a", i] == f"Soup {i} Ingredients Carrot {i} and salt. Serves two. Method Boil for {i} minutes."
        assert found["b", i] == f"Soup {i} Important {i}: hot. Method It costs {i}."


def plain_left_out(texts):
    """Of (words, whether the template's, heading, chain of elements around): the places that go, by looking at all texts for each."""
    mine = [i for i, t in enumerate(texts) if not t[1]]
    gone = set()
    for i, (_, template, _, around) in enumerate(texts):
        if not template:
            continue
        free = lambda e: any(not t[1] for t in texts if e in t[3])
        bare = next((e for e in around if not free(e)), None)
        only_headings = bare is not None and all(t[2] for t in texts if bare in t[3])
        if not mine or i < mine[0] or i > mine[-1] or (bare is not None and not only_headings):
            gone.add(i)
    return gone


def test_template_texts_against_a_plain_version():
    import random

    for seed in range(200):
        r = random.Random(seed)
        html, texts, chain = ["<body>"], [], []
        for n in range(r.randrange(1, 25)):
            act = r.random()
            if act < 0.3:
                html.append("<div>")
                chain.append(n)
            elif act < 0.5 and chain:
                html.append("</div>")
                chain.pop()
            else:
                name, template = r.choice(["p", "h2", "p"]), r.random() < 0.5
                html.append(f"<{name}>text {n}</{name}>")
                texts.append((f"text {n}", template, name == "h2", ("body", *chain)))
        parsed = list(html_text.events("".join(html)))
        at = [i for i, e in enumerate(parsed) if e[0] == "text"]
        runs = frozenset(html_text.number(html_text.run_token(parsed[i][1], parsed[i][4])) for i, t in zip(at, texts, strict=True) if t[1])
        assert {at.index(i) for i in html_text.template_texts(parsed, None, runs, frozenset())} == plain_left_out(texts)
