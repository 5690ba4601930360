"""The registered queries of this subpackage, and their SQL where SQL can express them.

Queries without SQL (1, 5, 7, 8, 9, 10, 11) are tested against brute force, an exact round
trip or held-out labels in tests/llm.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import codes, gam, html_text, licenses, media, mixing, neardup, packing, prefix_trie, sharding, simhash, token_files, topk
from tracelode.llm.common import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_table(spark, sf_dir, "documents")).drop("pair_time", "pair_code")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_hilbert(_table(spark, sf_dir, "documents")).drop("hilbert")


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(_table(spark, sf_dir, "pages"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(_table(spark, sf_dir, "documents"), folder)
    return token_files.read_token_files(spark, folder)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op11_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_duplicates(_table(spark, sf_dir, "documents"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations")).drop("position", "end")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_media_columns, op2_license_scans, op3_exact_top_k, op4_mixing, op5_sharding,
        op6_minhash_neardup, op7_quality_classifier, op8_html_extraction, op9_token_output, op10_packing,
        op11_simhash_neardup, op12_conversation_prefix_trie, op13_vector_codes,
    )
}



def _license_sql() -> str:
    """Every template at every place where its first key phrase may stand, word by word, from the table of templates."""
    templates, words = [], []
    for k, t in enumerate(licenses.TEMPLATES):
        sequence, keys = t.words.split(), [x.split() for x in t.keys or (t.words,)]
        places = [next(i for i in range(len(sequence)) if sequence[i : i + len(key)] == key) for key in keys]
        must = {i + j for i, key in zip(places, keys, strict=True) for j in range(len(key))}
        templates.append(f"({k}, '{t.label}', {t.base}, {t.share if t.keys else 0.0}, '{keys[0][0]}', {places[0]})")
        words += [f"({k}, {i}, '{w}', {i in must})" for i, w in enumerate(sequence)]
    return f"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
        token AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM d),
        template(k, label, base, share, head, place) AS (VALUES {", ".join(templates)}),
        part(k, i, word, must) AS (VALUES {", ".join(words)}),
        idf AS (
            SELECT p.word, ln(((SELECT count(*) FROM d) + 1) / (count(DISTINCT t.doc_id) + 1)) + 1 AS idf
            FROM (SELECT DISTINCT word FROM part) p LEFT JOIN token t USING (word) GROUP BY p.word),
        start AS (
            SELECT DISTINCT t.doc_id, m.k, t.i - m.place AS start FROM token t JOIN template m ON t.word = m.head WHERE t.i >= m.place),
        weighed AS (
            SELECT s.doc_id, s.k, s.start, count(*) FILTER (WHERE p.must AND t.word IS DISTINCT FROM p.word) AS missing,
                   coalesce(sum(f.idf) FILTER (WHERE t.word = p.word), 0) / sum(f.idf) AS score
            FROM start s JOIN part p USING (k) JOIN idf f ON f.word = p.word
            LEFT JOIN token t ON t.doc_id = s.doc_id AND t.i = s.start + p.i GROUP BY ALL),
        match AS (SELECT w.doc_id, w.start, w.score, m.label, m.base FROM weighed w JOIN template m USING (k) WHERE missing = 0 AND w.score >= m.share),
        found AS (
            SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
            FROM match GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
        FROM d LEFT JOIN found USING (doc_id)
    """


def _codes_sql() -> str:
    """The rounds one after another, each part compared with each entry."""
    near = "SELECT p.vec_id, p.part, p.x, p.label, p.n, min((list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i]))), b.entry)) AS best FROM p JOIN {book} b USING (part) GROUP BY ALL"
    rounds = ""
    for i in range(codes.ROUNDS):
        rounds += f"""
        near{i} AS MATERIALIZED ({near.format(book=f"book{i}")}),
        spot{i} AS (SELECT part, best[2] AS entry, unnest(x) AS x, unnest(range(len(x))) AS place FROM near{i}),
        mean{i} AS (SELECT part, entry, place, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM spot{i} GROUP BY ALL),
        fresh{i} AS (SELECT part, entry, list(x ORDER BY place) AS x FROM mean{i} GROUP BY ALL),
        book{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(f.x, b.x) AS x FROM book{i} b LEFT JOIN fresh{i} f USING (part, entry)),"""
    last = codes.ROUNDS
    return f"""
        WITH v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        k AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, e) AS n FROM v),
        p AS MATERIALIZED (SELECT vec_id, label, n, part, e[part * len(e) // {codes.PARTS} + 1:(part + 1) * len(e) // {codes.PARTS}] AS x FROM k, (SELECT unnest(range({codes.PARTS})) AS part)),
        book0 AS MATERIALIZED (SELECT part, n - 1 AS entry, x FROM p WHERE n <= {codes.ENTRIES}),{rounds}
        final AS MATERIALIZED ({near.format(book=f"book{last}")}),
        digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{last}),
        coded AS (SELECT vec_id, label, n, string_agg(format('{{:02x}}', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM final GROUP BY ALL)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest
    """


ORACLE_SQL: dict[str, str] = {
    "op13_vector_codes": _codes_sql(),
    "op12_conversation_prefix_trie": """
        WITH raw AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        keyed AS (SELECT c, turn, md5(length(role) || ':' || role || text) AS item, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM raw),
        placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, item) - 1 AS place FROM keyed),
        sizes AS (
            SELECT c, count(*) AS own, c - c % 20 AS base,
                   xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
                       lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) % 4 AS h
            FROM placed GROUP BY c),
        plan AS (SELECT s.c, s.base, s.h, least(s.h, coalesce(b.own, 0)) AS lent, least(s.h, coalesce(b.own, 0)) + greatest(s.own - s.h, 0) AS length FROM sizes s LEFT JOIN sizes b ON b.c = s.base),
        built AS (
            SELECT c, place - h + lent + 1 AS depth, item, words, length FROM placed JOIN plan USING (c) WHERE place >= h
            UNION ALL SELECT plan.c, place + 1, item, words, length FROM plan JOIN placed ON placed.c = plan.base WHERE place < lent),
        paths AS (
            SELECT c, list(item) OVER (PARTITION BY c ORDER BY depth) AS path, words, depth = length AS last FROM built
            UNION ALL SELECT c, [], 0, length = 0 FROM plan),
        nodes AS (
            SELECT path, len(path) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
                   sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256
            FROM paths GROUP BY path),
        children AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
        whole AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
        above AS (SELECT *, unnest(range(depth + 1)) AS d FROM whole),
        spans AS (SELECT path[1:d] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM above GROUP BY ALL)
        SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
        FROM whole w JOIN spans USING (path) LEFT JOIN nodes p ON w.depth > 0 AND p.path = w.path[1:w.depth - 1]
    """,
    "op2_license_scans": _license_sql(),
    "op4_mixing": """
        WITH d AS (SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
        k AS (
            SELECT doc_id, source, size,
                   (CAST(CAST('0x' || substr(md5('1' || chr(31) || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(281474976710656 AS DOUBLE) AS u,
                   coalesce(greatest(CAST(0.25 AS DOUBLE), 1 / (1 + abs(length(text) / nullif(size, 0) - 7) / 4)), CAST(1 AS DOUBLE)) AS q
            FROM d),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
        o AS (SELECT *, cap / w AS fills, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place FROM w),
        l AS (
            SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
            FROM o WINDOW before AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        v AS (SELECT min_by(level, place) FILTER (WHERE level < fills) AS level FROM l),
        t AS (SELECT source, source_size, coalesce(least(cap, v.level * w), cap) AS target FROM l, v),
        b AS (SELECT *, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS epochs FROM t),
        r AS (
            SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY 1 - pow(u, 1 / q), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM k)
        SELECT doc_id, size, source_size, target,
               CAST(epochs * size + least(size, greatest(0, CAST(round(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
        FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source
    """,
    "op6_minhash_neardup": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                   ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingles
            FROM w),
        c AS (SELECT min(doc_id) AS rep, any_value(n) AS n, any_value(shingles) AS shingles FROM (SELECT doc_id, len(shingles) AS n, list_sort(shingles) AS shingles FROM s WHERE len(shingles) > 0) GROUP BY md5(array_to_string(shingles, chr(10)))),
        t AS (SELECT rep, n, unnest(shingles) AS shingle FROM c),
        p AS (SELECT a.rep AS a, b.rep AS b, a.n AS a_n, b.n AS b_n, count(*) AS common FROM t a JOIN t b ON a.shingle = b.shingle AND a.rep < b.rep GROUP BY ALL),
        link AS (SELECT a, b FROM p WHERE 100 * common >= 85 * (a_n + b_n - common)),
        edge AS (SELECT a AS x, b AS y FROM link UNION ALL SELECT b, a FROM link),
        reach(x, y) AS (SELECT x, y FROM edge UNION SELECT reach.x, edge.y FROM reach JOIN edge ON edge.x = reach.y),
        least AS (SELECT x AS rep, least(x, min(y)) AS component FROM reach GROUP BY x),
        class AS (SELECT rep, md5(array_to_string(shingles, chr(10))) AS digest FROM c)
        SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(least.component, class.rep, s.doc_id) AS component_id, s.doc_id = coalesce(least.component, class.rep, s.doc_id) AS kept
        FROM s LEFT JOIN class ON len(s.shingles) > 0 AND class.digest = md5(array_to_string(list_sort(s.shingles), chr(10))) LEFT JOIN least USING (rep)
    """,
    "op3_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
    """,
}
