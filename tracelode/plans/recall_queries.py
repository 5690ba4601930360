"""Queries of hybrid recall."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import columns as C
from tracelode.functions.embedding import HASHING
from tracelode.functions.tables import shared_folder, stored
from tracelode.operators import recall, scoped
from tracelode.operators.index_store import IndexNotReady, IndexStore, read_unchanged
from tracelode.plans.adapters import MEMORIES_SQL, memories, table
from tracelode.plans.registry import query

LIMIT, THRESHOLD = 5, 0.45


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("content"))


@query(f"""
    WITH {MEMORIES_SQL},
    doc AS (
        SELECT memory_id, memory_id || ':memory' AS document_id, 'memory' AS kind, title, status, title || chr(10) || content || chr(10) || category || chr(10) || lang AS content FROM mem
        UNION ALL
        SELECT memory_id, memory_id || ':snippet:' || lpad(CAST(i AS VARCHAR), 4, '0'), 'snippet', title, status, line
        FROM (SELECT *, unnest(lines[1:128]) AS line, unnest(range(least(len(lines), 128))) AS i FROM mem WHERE len(lines) > 1))
    SELECT document_id, kind, title, status, sha256(CAST(to_json({{'content': content, 'document_id': document_id, 'schema_version': 1, 'status': status}}) AS VARCHAR)) AS content_sha256 FROM doc
""")
def rec01_documents(spark: SparkSession, d: str) -> DataFrame:
    return recall.project(memories(spark, d)).select("document_id", "kind", "title", "status", "content_sha256")


BM25_SQL = """
    tok AS (SELECT {id} AS document_id, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {table}),
    len AS (SELECT document_id, count(*) AS length FROM tok GROUP BY document_id),
    tot AS (SELECT (SELECT count(*) FROM {table}) AS n, (SELECT sum(length) FROM len) / (SELECT count(*) FROM {table}) AS mean),
    tf AS (SELECT document_id, term, count(*) AS tf FROM tok GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark),
    bm AS (
        SELECT query_id, document_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (1.2 + 1) / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score
        FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (document_id), tot GROUP BY ALL),
    lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM bm)
"""


@query(f"""WITH {BM25_SQL.format(id="CAST(doc_id AS VARCHAR)", text="text", table="documents")} SELECT query_id, document_id, score, CAST(rank AS INTEGER) AS rank FROM lex WHERE rank <= 20""")
def rec02_bm25(spark: SparkSession, d: str) -> DataFrame:
    return recall.lexical(documents(spark, d), asked(spark, d), recall.candidate_cap(LIMIT))


def neighbours(spark: SparkSession, d: str, k: int) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return recall.vector_near(rows.select(F.col("vec_id").alias("document_id"), F.col("embedding").alias("vector")), queries, k + 1)


NEAR_SQL = """
    pair AS (
        SELECT q.vec_id AS query_id, c.vec_id AS document_id, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
        FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0),
    near AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS INTEGER) AS rank FROM pair)
"""


@query(f"WITH {NEAR_SQL} SELECT query_id, document_id, score, rank FROM near WHERE rank <= 11")
def rec03_knn(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(spark, d, 10)


EMBED_SQL = """
    term_{name} AS (SELECT DISTINCT {id} AS id, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS term FROM {table}),
    bucket_{name} AS (SELECT id, CAST(CAST('0x' || substr(sha256(term), 1, 4) AS BIGINT) % 256 AS INTEGER) AS bucket, CAST(count(*) AS DOUBLE) AS n FROM term_{name} GROUP BY ALL),
    norm_{name} AS (SELECT id, sqrt(sum(n * n)) AS norm FROM bucket_{name} GROUP BY id)
"""


@query(f"""
    WITH {EMBED_SQL.format(name="d", id="doc_id", text="text", table="documents")}
    SELECT doc_id, CAST(coalesce(count(b.bucket), 0) AS BIGINT) AS buckets, CAST(coalesce(sum(b.bucket * b.n), 0) AS DOUBLE) AS weighted, coalesce(round(any_value(norm), 6), 0.0) AS norm
    FROM documents LEFT JOIN bucket_d b ON b.id = doc_id LEFT JOIN norm_d m ON m.id = doc_id GROUP BY doc_id
""")
def rec04_hash_embed(spark: SparkSession, d: str) -> DataFrame:
    rows = recall.hashed(table(spark, d, "documents"), F.col("text"), "c")
    total = lambda f: F.aggregate("c", F.lit(0.0), lambda s, e: s + f(e))
    return rows.select("doc_id", F.size("c").cast("long").alias("buckets"), total(lambda e: e["bucket"] * e["n"]).alias("weighted"), F.round(recall.norm(F.col("c")), 6).alias("norm"))


#: Documents of active memories, both sources' candidates among them, and their fusion; {part} is a repository's ranks of its own.
HYBRID_SQL = f"""
    {MEMORIES_SQL},
    act AS (SELECT * FROM mem WHERE status = 'active'),
    doc AS (
        SELECT memory_id, memory_id || ':memory' AS document_id, 'memory' AS kind, repo_key, title, title || chr(10) || content || chr(10) || category || chr(10) || lang AS text FROM act
        UNION ALL
        SELECT memory_id, memory_id || ':snippet:' || lpad(CAST(i AS VARCHAR), 4, '0'), 'snippet', repo_key, title, line
        FROM (SELECT *, unnest(lines[1:128]) AS line, unnest(range(least(len(lines), 128))) AS i FROM act WHERE len(lines) > 1)),
    emb AS (SELECT *, title || chr(10) || text AS body FROM doc),
    {BM25_SQL.format(id="document_id", text="text", table="doc")},
    {EMBED_SQL.format(name="d", id="document_id", text="body", table="emb")},
    {EMBED_SQL.format(name="q", id="item_id", text="text", table="benchmark")},
    cos AS (
        SELECT q.id AS query_id, d.id AS document_id, sum(d.n * q.n) / (any_value(nd.norm) * any_value(nq.norm)) AS score
        FROM bucket_q q JOIN bucket_d d USING (bucket) JOIN norm_d nd ON nd.id = d.id JOIN norm_q nq ON nq.id = q.id GROUP BY q.id, d.id),
    every AS (SELECT query_id, document_id, 'lexical' AS source, score FROM bm UNION ALL SELECT query_id, document_id, 'vector', round(score, 6) FROM cos),
    ranks AS (SELECT e.*, d.memory_id, d.kind, d.text, row_number() OVER (PARTITION BY query_id, source{{part}} ORDER BY score DESC, document_id) AS rank FROM every e JOIN doc d USING (document_id){{where}}),
    hit AS (SELECT * FROM ranks WHERE rank <= 20),
    cand AS (SELECT query_id, memory_id, source, min(rank) AS rank, max(score) AS score FROM hit GROUP BY ALL),
    snip AS (SELECT query_id, memory_id, document_id, text, round(sum(1 / (60 + rank)), 9) AS score FROM hit WHERE kind <> 'memory' GROUP BY ALL),
    fused AS (
        SELECT query_id, memory_id, round(sum(1 / (60 + rank)), 9) AS score, array_to_string(list_sort(list(source)), '+') AS sources, max(CASE WHEN source = 'vector' THEN score END) AS vector_score, bool_or(source = 'lexical') AS has_lexical
        FROM cand GROUP BY ALL),
    ranked AS (SELECT f.*, m.memory_type, m.created_at_ms, (has_lexical OR coalesce(vector_score >= {THRESHOLD}, false)) AS relevant FROM fused f JOIN act m USING (memory_id)),
    prio AS (SELECT *, list_position({list(recall.TYPE_ORDER)}, memory_type) AS priority, CASE memory_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in recall.TYPE_CAPS.items())} END AS cap FROM ranked),
    capped AS (SELECT *, relevant AND row_number() OVER (PARTITION BY query_id, relevant, memory_type ORDER BY -score, priority, -created_at_ms, memory_id) <= cap AS pass FROM prio),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id, pass ORDER BY -score, priority, -created_at_ms, memory_id) AS rn FROM capped),
    admitted AS (SELECT *, pass AND rn <= {LIMIT} AS admitted FROM numbered),
    final AS (
        SELECT *, CAST(CASE WHEN admitted THEN rn END AS INTEGER) AS rank,
               CASE WHEN NOT relevant THEN 'relevance' WHEN admitted THEN NULL WHEN count(*) FILTER (WHERE admitted) OVER (PARTITION BY query_id, memory_type) >= cap THEN 'type_cap' ELSE 'limit' END AS omission
        FROM admitted)
"""


ALL_SQL = HYBRID_SQL.replace("{part}", "").replace("{where}", "")
#: A query asks the repositories of two of the four languages.
SCOPE = (("en", "de"), ("en", "fr"), ("de", "es"), ("fr", "es"))
SCOPED_SQL = HYBRID_SQL.replace("{part}", ", d.repo_key").replace("{where}", f" WHERE list_contains([{', '.join(str(list(x)) for x in SCOPE)}][query_id % 4 + 1], d.repo_key)")


def recalled(spark: SparkSession, d: str) -> DataFrame:
    return recall.hybrid(memories(spark, d), asked(spark, d), LIMIT, THRESHOLD)


@query(f"WITH {ALL_SQL} SELECT query_id, memory_id, score, sources, vector_score, rank, omission FROM final")
def rec06_hybrid_recall(spark: SparkSession, d: str) -> DataFrame:
    return recalled(spark, d).select("query_id", "memory_id", "score", F.array_join("sources", "+").alias("sources"), "vector_score", "rank", "omission")


@query(f"WITH {SCOPED_SQL} SELECT query_id, memory_id, score, sources, vector_score, rank, omission FROM final")
def rec16_repositories(spark: SparkSession, d: str) -> DataFrame:
    """Each query asks two repositories, whose documents are ranked for themselves."""
    scopes = F.array(*(F.array(*map(F.lit, x)) for x in SCOPE))
    queries = asked(spark, d).withColumn("repo_keys", F.element_at(scopes, (F.col("query_id") % 4 + 1).cast("int")))
    return recall.hybrid(memories(spark, d), queries, LIMIT, THRESHOLD, by_repository=True).select("query_id", "memory_id", "score", F.array_join("sources", "+").alias("sources"), "vector_score", "rank", "omission")


@query(f"""
    WITH {MEMORIES_SQL},
    doc AS (
        SELECT repo_key, memory_id || ':memory' AS document_id, memory_id, doc_id FROM mem
        UNION ALL SELECT repo_key, memory_id || ':snippet:' || lpad(CAST(i AS VARCHAR), 4, '0'), memory_id, doc_id FROM (SELECT *, unnest(range(least(len(lines), 128))) AS i FROM mem WHERE len(lines) > 1))
    SELECT repo_key, bool_and(repo_key <> 'de' OR doc_id % 11 <> 0) AS ready FROM doc GROUP BY repo_key
""")
def rec21_preflight(spark: SparkSession, d: str) -> DataFrame:
    """An index that lacks some German memories' documents isn't ready there."""
    rows = stored(memories(spark, d), "memories")
    parts = lambda some: recall.project(some).select("repo_key", "document_id", "content_sha256")
    return recall.preflight(parts(rows), parts(rows.where("not coalesce(repo_key = 'de' and doc_id % 11 = 0, false)")), ["repo_key"])


@query(f"""
    WITH {ALL_SQL}
    SELECT item_id AS query_id, count(*) FILTER (WHERE admitted) AS n_admitted, CASE WHEN count(*) FILTER (WHERE admitted) > 0 THEN 'admitted' ELSE 'abstained' END AS outcome,
           CASE WHEN count(*) FILTER (WHERE admitted) > 0 THEN 'relevant_candidate' WHEN count(memory_id) > 0 THEN 'below_threshold' ELSE 'no_candidates' END AS reason, max(vector_score) AS max_vector_score
    FROM benchmark LEFT JOIN final ON query_id = item_id GROUP BY item_id
""")
def rec08_admission(spark: SparkSession, d: str) -> DataFrame:
    return recall.admission_trace(recalled(spark, d), asked(spark, d))


@query(f"""
    WITH {MEMORIES_SQL},
    r AS (SELECT source || ':' || (doc_id // 1000) AS query_id, memory_type, doc_id, n_chars % 50 AS score, doc_id % 3 = 0 AS has_lexical, CAST(doc_id % 10 AS DOUBLE) / 10 AS vector_score, memory_id, created_at_ms FROM mem JOIN documents USING (doc_id)),
    p AS (SELECT *, has_lexical OR vector_score >= 0.5 AS relevant, list_position({list(recall.TYPE_ORDER)}, memory_type) AS priority, CASE memory_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in recall.TYPE_CAPS.items())} END AS cap FROM r),
    c AS (SELECT *, relevant AND row_number() OVER (PARTITION BY query_id, relevant, memory_type ORDER BY -score, priority, -created_at_ms, memory_id) <= cap AS pass FROM p),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id, pass ORDER BY -score, priority, -created_at_ms, memory_id) AS rn FROM c),
    a AS (SELECT *, pass AND rn <= 12 AS admitted FROM n)
    SELECT query_id, memory_id, CAST(CASE WHEN admitted THEN rn END AS INTEGER) AS rank,
           CASE WHEN NOT relevant THEN 'relevance' WHEN admitted THEN NULL WHEN count(*) FILTER (WHERE admitted) OVER (PARTITION BY query_id, memory_type) >= cap THEN 'type_cap' ELSE 'limit' END AS omission FROM a
""")
def rec09_caps(spark: SparkSession, d: str) -> DataFrame:
    """A source's documents, a thousand ids at a time, as candidates of a request, as a recall's candidates are bounded."""
    rows = memories(spark, d).join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    rows = rows.select(F.concat_ws(":", "source", F.floor(F.col("doc_id") / 1000)).alias("query_id"), "memory_id", "memory_type", "created_at_ms", (F.col("n_chars") % 50).alias("score"), ((F.col("doc_id") % 10).cast("double") / 10).alias("vector_score"), (F.col("doc_id") % 3 == 0).alias("has_lexical"), F.lit(False).alias("is_pinned"))
    return recall.admit(rows, 12, 0.5).select("query_id", "memory_id", "rank", "omission")


@query("""
    WITH w AS (SELECT o_orderkey AS memory_id, 'repo' || (o_custkey % 10) AS repo_key, CAST(o_custkey AS VARCHAR) AS workstream_key, o_orderkey % 7 <> 0 AND lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IS NOT NULL AS superseded, o_orderstatus, o_orderpriority FROM orders),
    h AS (SELECT repo_key, workstream_key, min(memory_id) AS head_id, count(*) AS heads FROM w WHERE NOT superseded AND o_orderpriority LIKE '3%' AND o_orderstatus <> 'F' GROUP BY ALL)
    SELECT c_custkey AS query_id, head_id AS memory_id FROM customer JOIN h ON h.workstream_key = CAST(c_custkey AS VARCHAR) AND h.repo_key = 'repo' || (c_custkey % 10) WHERE heads = 1
""")
def rec10_pinned(spark: SparkSession, d: str) -> DataFrame:
    from tracelode.operators.evolution import open_heads
    from tracelode.plans.adapters import order_edges, order_memories

    state = table(spark, d, "orders").select(F.col("o_orderkey").alias("memory_id"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"))
    rows = order_memories(spark, d).join(state, "memory_id").withColumn("workstream_key", F.col("subject_key"))
    queries = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("repo"), F.col("c_custkey") % 10).alias("repo_key"), F.col("c_custkey").cast("string").alias("workstream_key"))
    return recall.pinned(open_heads(rows, order_edges(spark, d)), queries)


#: Recall over all lines of a memory; their numbers have four digits, or as many as they need.
LINE_ID = "lpad(CAST(i AS VARCHAR), CAST(greatest(4, len(CAST(i AS VARCHAR))) AS INTEGER), '0')"
WHOLE_SQL = ALL_SQL.replace("unnest(lines[1:128]) AS line, unnest(range(least(len(lines), 128))) AS i", "unnest(lines) AS line, unnest(range(len(lines))) AS i").replace("lpad(CAST(i AS VARCHAR), 4, '0')", LINE_ID)


@query(f"""
    WITH {WHOLE_SQL},
    ad AS (SELECT f.query_id, b.text AS query, f.memory_id, m.lines, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS terms FROM final f JOIN act m USING (memory_id) JOIN benchmark b ON b.item_id = f.query_id WHERE f.admitted),
    li AS (SELECT query_id, memory_id, unnest(lines) AS text, unnest(range(len(lines))) AS i, terms FROM ad),
    own AS (SELECT query_id, memory_id, memory_id || ':snippet:' || {LINE_ID} AS document_id, text, terms FROM li),
    sc AS (
        SELECT o.query_id, o.memory_id, o.document_id, o.text, coalesce(round(1.5 + atan(s.score) / 3.141592653589793, 9), round(len(list_intersect(terms, list_distinct(regexp_extract_all(lower(o.text), '[a-z0-9]+')))) / greatest(1, len(terms)), 9)) AS snippet_score
        FROM own o LEFT JOIN snip s ON s.query_id = o.query_id AND s.document_id = o.document_id)
    SELECT query_id, memory_id, document_id, text, snippet_score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id, memory_id ORDER BY snippet_score DESC, document_id) <= 12
""")
def rec12_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Every line of a memory is searched and can be a snippet."""
    return _snippets(spark, d, recall.hybrid(memories(spark, d), asked(spark, d), LIMIT, THRESHOLD, lines=None), None)


def _snippets(spark: SparkSession, d: str, found: DataFrame, lines: int | None = C.LINES) -> DataFrame:
    admitted = found.where("admitted").select("query_id", "memory_id", "found").join(memories(spark, d).select("memory_id", "content"), "memory_id").join(asked(spark, d), "query_id")
    return recall.snippets(admitted, lines=lines)


@query()
def rec13_context(spark: SparkSession, d: str) -> DataFrame:
    """A greedy fold over snippets; tests compare it with a plain loop."""
    from tracelode.functions.tables import stored

    found = stored(recalled(spark, d), "recalled")
    lines = _snippets(spark, d, found)
    heads = found.where("admitted").select("query_id", "memory_id", "rank").join(memories(spark, d), "memory_id").select(
        "query_id", "memory_id", "rank", "title", F.concat(F.lit("Memory: "), "memory_id", F.lit("\nType: "), "memory_type", F.lit("\nStatus: "), "status", F.lit("\n")).alias("footer"))
    return recall.context(lines.join(heads, ["query_id", "memory_id"]), asked(spark, d), 512)


@query(f"""
    WITH {NEAR_SQL},
    r AS (SELECT query_id, list(document_id ORDER BY rank) AS ranked FROM near WHERE rank <= 10 GROUP BY query_id),
    m AS (SELECT *, [ranked[2], ranked[7], -1] AS relevant FROM r),
    x AS (SELECT *, len(list_intersect(ranked[1:1], relevant)) AS a1, len(list_intersect(ranked[1:5], relevant)) AS a5, list_position(list_transform(ranked, lambda x: list_contains(relevant, x)), true) AS p FROM m)
    SELECT count(*) AS queries, round(avg(a1 / 3), 6) AS recall_at_1, round(avg(a5 / 3), 6) AS recall_at_5, round(avg(CAST(a5 > 0 AS INTEGER)), 6) AS hit_at_5, round(avg(a5 / least(5, len(ranked))), 6) AS precision_at_5,
           round(avg(CASE WHEN p > 0 THEN 1 / p ELSE 0 END), 6) AS mrr FROM x
""")
def agg06_retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    from tracelode.operators.evaluation import retrieval_metrics

    rows = neighbours(spark, d, 9).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_id"))), lambda x: x["document_id"]).alias("ranked"))
    return retrieval_metrics(rows.withColumn("relevant", F.array(F.col("ranked")[1], F.col("ranked")[6], F.lit(-1).cast("long"))))


def _reranked_sql() -> str:
    """Recall's SQL with the reranker between fusion and admission."""
    plain = "ranked AS (SELECT f.*, m.memory_type"
    assert plain in ALL_SQL
    words = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"
    score = f"round(f.score + 2 * len(list_intersect({words('b.text')}, {words('m.content')})) / greatest(1, len({words('b.text')})), 9)"
    sql = ALL_SQL.replace(plain, f"ranked AS (SELECT f.* REPLACE ({score} AS score), m.memory_type")
    return sql.replace("FROM fused f JOIN act m USING (memory_id)),", "FROM fused f JOIN act m USING (memory_id) JOIN benchmark b ON b.item_id = f.query_id),")


@query(f"WITH {_reranked_sql()} SELECT query_id, memory_id, score, rank, omission FROM final")
def rec07_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Recall's fused candidates, reranked by their memories' content before admission."""
    return recall.hybrid(memories(spark, d), asked(spark, d), LIMIT, THRESHOLD, rerank=recall.rerank_overlap).select("query_id", "memory_id", "score", "rank", "omission")


@query(f"WITH {ALL_SQL} SELECT query_id, memory_id, score, sources, vector_score, rank, omission FROM final")
def udf01_embedder(spark: SparkSession, d: str) -> DataFrame:
    """Recall with a provider of embeddings plugged in: that which computes the hashed ones, so the result is rec06's."""
    return recall.hybrid(memories(spark, d), asked(spark, d), LIMIT, THRESHOLD, embedder=HASHING).select("query_id", "memory_id", "score", F.array_join("sources", "+").alias("sources"), "vector_score", "rank", "omission")


#: Asking repositories by the query's number, and preferences of a subject; the first active one of every second subject is promoted.
ASKING = ("en", "de", "fr", "es")
SCOPED_RECALL_SQL = SCOPED_SQL[SCOPED_SQL.index("act AS"):].replace("act AS (SELECT * FROM mem WHERE status = 'active'),", """
    act0 AS (SELECT *, doc_id % 400 AS subject_key FROM mem WHERE status = 'active'),
    prm AS (SELECT subject_key, min(doc_id) AS doc_id FROM act0 WHERE memory_type = 'user_preference' AND subject_key % 8 = 1 GROUP BY ALL),
    src AS (SELECT act0.* FROM act0 JOIN prm USING (doc_id)),
    ask AS (SELECT DISTINCT {asking}[item_id % 4 + 1] AS view FROM benchmark),
    vis AS (
        SELECT view, src.* FROM src, ask
        WHERE NOT EXISTS (SELECT 1 FROM act0 l WHERE l.memory_type = 'user_preference' AND l.subject_key = src.subject_key AND l.repo_key = view AND l.memory_id <> src.memory_id)),
    act AS (
        SELECT * REPLACE (view || chr(31) || memory_id AS memory_id, view || chr(31) || repo_key AS repo_key) FROM (
            SELECT repo_key AS view, * FROM act0 WHERE repo_key IN (SELECT view FROM ask) UNION ALL SELECT * FROM vis WHERE view <> repo_key)),
""".replace("{asking}", str(list(ASKING))))
SCOPED_RECALL_SQL = SCOPED_RECALL_SQL.replace(SCOPED_SQL[SCOPED_SQL.index(" WHERE list_contains("):SCOPED_SQL.index("),\n    hit AS")], f" WHERE split_part(d.repo_key, chr(31), 1) = {list(ASKING)}[query_id % 4 + 1]")


def scoped_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memories with subjects, promotions, and queries with the repository that asks."""
    rows = memories(spark, d).withColumn("subject_key", F.col("doc_id") % 400)
    first = rows.where("status = 'active' and memory_type = 'user_preference' and subject_key % 8 = 1").groupBy("subject_key").agg(F.min(F.struct("doc_id", "memory_id", "repo_key")).alias("m"))
    promoted = first.select(F.col("m.doc_id").alias("promotion_id"), "m.memory_id", "m.repo_key", "subject_key", F.lit(None).cast("long").alias("replaces"))
    queries = asked(spark, d).withColumn("repo_key", F.element_at(F.array(*map(F.lit, ASKING)), (F.col("query_id") % 4 + 1).cast("int")))
    return rows, promoted, queries


@query(f"""
    WITH {MEMORIES_SQL}, {SCOPED_RECALL_SQL}
    SELECT query_id, split_part(f.memory_id, chr(31), 1) AS repo_key, split_part(f.memory_id, chr(31), 2) AS memory_id, f.score, sources, vector_score, rank, omission, CASE WHEN v.doc_id IS NULL THEN 'repository' ELSE 'global' END AS scope, v.doc_id AS promotion_id
    FROM final f LEFT JOIN vis v ON v.view || chr(31) || v.memory_id = f.memory_id
""")
def rec19_scoped_recall(spark: SparkSession, d: str) -> DataFrame:
    """A repository's memories and promoted preferences of others, unless a local one of the subject shadows them; void if a table changes meanwhile."""
    found = read_unchanged(lambda: scoped_tables(spark, d), lambda rows, promoted, queries: scoped.scoped_recall(rows, promoted, queries, LIMIT, THRESHOLD))
    return found.select("query_id", "repo_key", "memory_id", "score", F.array_join("sources", "+").alias("sources"), "vector_score", "rank", "omission", "scope", "promotion_id")


@query(f"""
    WITH {MEMORIES_SQL},
    doc AS (SELECT memory_id, repo_key, doc_id, status, 1 + CASE WHEN len(lines) > 1 THEN least(len(lines), 128) ELSE 0 END AS n FROM mem),
    a AS (SELECT count(*) AS m, CAST(sum(n) AS BIGINT) AS k FROM doc), b AS (SELECT count(*) AS m, CAST(sum(n) AS BIGINT) AS k FROM doc WHERE repo_key <> 'de' OR doc_id % 11 <> 0)
    SELECT CAST(1 AS BIGINT) AS version, b.m AS truth_count, b.m AS index_count, b.k AS truth_document_count, b.k AS index_document_count, TRUE AS parity, 'index_not_ready: de' AS recall_of_all FROM b
    UNION ALL SELECT 2, a.m, a.m, a.k, a.k, TRUE, 'ready' FROM a
""")
def job05_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """An index built without some German memories stops recall over all of them; rebuilt beside it and swapped in, it doesn't."""
    rows = stored(memories(spark, d), "memories")
    store = IndexStore(spark, f"{shared_folder(spark)}/search-{uuid.uuid4().hex}")
    truth = store.truth(rows)

    def gate() -> str:
        try:
            store.require(rows, truth=truth)
        except IndexNotReady as stop:
            return str(stop)
        return "ready"

    first = store.rebuild(rows.where("repo_key <> 'de' or doc_id % 11 <> 0")).withColumn("recall_of_all", F.lit(gate()))
    second = store.rebuild(rows, truth).withColumn("recall_of_all", F.lit(gate()))
    return first.unionByName(second).drop("current")


@query(f"""
    WITH {ALL_SQL}
    SELECT item_id AS query_id, coalesce(string_agg(memory_id || ':' || memory_type, ',' ORDER BY rank) FILTER (WHERE admitted), '') AS ranked, coalesce(string_agg(memory_id || ':' || omission, ',' ORDER BY memory_id) FILTER (WHERE memory_id IS NOT NULL AND NOT admitted), '') AS omissions,
           count(*) FILTER (WHERE contains(sources, 'lexical')) AS lexical_candidates, count(*) FILTER (WHERE contains(sources, 'vector')) AS vector_candidates,
           CASE WHEN count(*) FILTER (WHERE admitted) > 0 THEN 'admitted' ELSE 'abstained' END AS outcome, CASE item_id % 3 WHEN 0 THEN 'fresh' ELSE 'semantic_pending' END AS freshness
    FROM benchmark LEFT JOIN final ON query_id = item_id GROUP BY item_id
""")
def rec17_sidecar(spark: SparkSession, d: str) -> DataFrame:
    """The record beside each recall, of repositories of which one in three is up to date."""
    queries = asked(spark, d).withColumn("repo_key", (F.col("query_id") % 3).cast("string"))
    cursors = spark.createDataFrame([("0", 7, 7, "complete"), ("1", 7, 5, "pending")], "repo_key string, source_cursor long, index_cursor long, semantic_state string")
    rows = recall.sidecar(queries, recalled(spark, d), "hashing-256", LIMIT, cursors=cursors)
    text = lambda name, a, b: F.array_join(F.transform(name, lambda x: F.concat_ws(":", x[a], x[b])), ",").alias(name)
    return rows.select("query_id", text("ranked", "memory_id", "memory_type"), text("omissions", "memory_id", "reason"), "lexical_candidates", "vector_candidates", "outcome", "freshness")


#: Titles of every 25th memory ask for the memories of that title; the next one's title as digits and letters that no memory has asks for nothing.
GATE_SQL = ALL_SQL.replace("FROM benchmark", "FROM gate_q").replace("act AS (SELECT * FROM mem", """gate_q AS (
        SELECT doc_id AS item_id, CASE WHEN doc_id % 25 = 0 THEN title ELSE 'zq' || md5(title) END AS text, CASE WHEN doc_id % 25 = 0 THEN 'positive' ELSE 'hard_negative' END AS query_kind, title FROM mem WHERE status = 'active' AND doc_id % 25 IN (0, 1)),
    act AS (SELECT * FROM mem""") + """,
    inj AS (SELECT f.query_id, m.title, m.doc_id % 37 <> 5 AS covered FROM final f JOIN act m USING (memory_id) WHERE admitted),
    gate AS (
        SELECT q.item_id AS query_id, any_value(query_kind) AS query_kind, count(i.query_id) AS injected, count(*) FILTER (WHERE query_kind = 'positive' AND i.title = q.title) AS hits, coalesce(bool_and(covered), TRUE) AS provenance_covered
        FROM gate_q q LEFT JOIN inj i ON i.query_id = q.item_id GROUP BY q.item_id),
    gates AS (SELECT *, hits > 0 AS recalled, round(CASE WHEN injected > 0 THEN hits / injected ELSE 0 END, 6) AS "precision" FROM gate)
"""


def gate_run(spark: SparkSession, d: str) -> DataFrame:
    from tracelode.operators.evaluation import gate_outcomes
    from tracelode.sources import truth

    rows = memories(spark, d)
    at = truth.MEMORY.path(F.col("repo_key"), F.col("memory_id"), F.col("memory_type"))
    heads = stored(rows.select("doc_id", "memory_id", "status", "title", F.when(F.col("doc_id") % 37 != 5, at).alias("source_uri"), F.sha2("content", 256).alias("content_sha256")), "heads")
    active = heads.where("status = 'active'")
    n = F.col("doc_id") % 25
    asks = active.where(n <= 1).select(F.col("doc_id").alias("query_id"), F.when(n == 0, F.col("title")).otherwise(F.concat(F.lit("zq"), F.md5(F.encode("title", "UTF-8")))).alias("query"), F.when(n == 0, "positive").otherwise("hard_negative").alias("query_kind"), "title")
    found = stored(recall.hybrid(rows, asks.select("query_id", "query"), LIMIT, THRESHOLD).where("admitted").select("query_id", "memory_id", "admitted"), "admitted")
    # Of a title's memories those that were found, as a common title's queries times its memories are too many.
    relevant = found.join(asks.where("query_kind = 'positive'").select("query_id", "title"), "query_id").join(active.select("memory_id", "title"), ["memory_id", "title"])
    return gate_outcomes(asks, relevant, found, heads)


@query(f"""WITH {GATE_SQL} SELECT query_id, query_kind, injected, hits, recalled, "precision", provenance_covered, CAST(0 AS BIGINT) AS stale FROM gates""")
def evl01_gate_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Each query of a retrieval gate run: titles that memories have, and hard negatives that should inject nothing; some memories' files are missing."""
    return gate_run(spark, d).withColumn("stale", F.col("stale").cast("long"))


@query(f"""
    WITH {GATE_SQL},
    a AS (
        SELECT count(*) AS queries, count(*) FILTER (WHERE query_kind = 'positive') AS positives, count(*) FILTER (WHERE query_kind <> 'positive') AS hard_negatives, round(avg(CAST(recalled AS INTEGER)) FILTER (WHERE query_kind = 'positive'), 6) AS recall_at_limit,
               round(avg("precision") FILTER (WHERE query_kind = 'positive'), 6) AS precision_at_limit, round(avg(CAST(provenance_covered AS INTEGER)) FILTER (WHERE query_kind = 'positive'), 6) AS provenance_coverage, CAST(0 AS BIGINT) AS stale_leakage,
               round(avg(CAST(injected > 0 AS INTEGER)) FILTER (WHERE query_kind <> 'positive'), 6) AS any_injection_rate, round(avg(injected) FILTER (WHERE query_kind <> 'positive'), 6) AS mean_irrelevant FROM gates),
    r AS (
        SELECT *, coalesce(recall_at_limit >= 0.9, FALSE) AS recall_ok, coalesce(provenance_coverage = 1, FALSE) AS provenance_ok, stale_leakage = 0 AS stale_ok, coalesce(any_injection_rate <= 0.05, FALSE) AS injection_ok, coalesce(mean_irrelevant <= 0.05, FALSE) AS irrelevant_ok FROM a)
    SELECT *, recall_ok AND provenance_ok AND stale_ok AND injection_ok AND irrelevant_ok AS passed FROM r
""")
def evl01_gate_report(spark: SparkSession, d: str) -> DataFrame:
    """The gate run's rules over all its queries."""
    from tracelode.operators.evaluation import gate_report

    return gate_report(gate_run(spark, d))
