"""Hybrid recall: documents of memories, lexical and vector candidates, fusion, admission, caps, snippets and context."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracelode.functions import columns as C
from tracelode.functions.embedding import Embedder, hashed_counts
from tracelode.functions.scoring import HashedBlocks, TermBlocks, Tops, blocks_in_order, candidates, rounded
from tracelode.functions.tables import small, stored, top_per_group
from tracelode.functions.tokens import letters, lowered, slices, tokens

RRF_K = 60
DIMENSION = 256
SNIPPETS = 12
CONTEXT_SNIPPETS = 192
#: How many memories of a type one recall admits, and their order where scores tie.
TYPE_CAPS = {"repository_knowledge": 40, "user_preference": 4, "work_state": 4, "task_experience": 8}
TYPE_ORDER = ("work_state", "user_preference", "repository_knowledge", "task_experience")
QUERY_BLOCK = 256
#: Queries of one pass over the documents, and bytes of their texts.
QUERY_PASS, PASS_BYTES = 65_536, 12 << 20
#: Queries of one pass that are vectors.
VECTOR_PASS = 16_384
#: Of more different queries than so many, bounds of scores are found first among one in BOUND_SHARE of the documents.
MANY, BOUND_SHARE = 1024, 16
#: Rows of a task whose scores for a block of queries are in memory at a time.
ROWS = 2048
#: Rows that a task holds before it keeps k of a query.
KEPT_ROWS = 1 << 17
#: Bounds of scores, one for each query and value of the parts, that a task keeps at most.
BOUNDS = 1 << 22


def candidate_cap(limit: int) -> int:
    """Candidates that each source gives for a limit of results."""
    return min(100, max(20, 4 * limit))


def project(memories: DataFrame, lines: int | None = C.LINES) -> DataFrame:
    """Each memory's search documents: the memory itself, and each of its facts, else its first lines (None: all of them) if there are several.

    memories: repo_key, memory_id, memory_type, status, title, content, category, tags, facts
    (array of struct<fact_id, fact_kind, value>). content_sha256 is over the status too, so a
    document of a memory that was superseded is indexed anew.
    """
    # A title that is the memory's own is not in the lists, where it would be copied for each line.
    part = lambda id_, kind, title, content: F.struct(id_.alias("document_id"), F.lit(kind).alias("kind"), title.alias("own_title"), content.alias("content"))
    none = F.lit(None).cast("string")
    values = F.transform("facts", lambda f: f["value"])
    own = part(F.concat("memory_id", F.lit(":memory")), "memory", none, F.array_join(F.concat(F.array("title", "content", "category", F.array_join("tags", " ")), values), "\n"))
    facts = F.transform("facts", lambda f: part(F.concat(F.col("memory_id"), F.lit(":fact:"), f["fact_id"]), "fact", F.initcap(F.replace(f["fact_kind"], F.lit("_"), F.lit(" "))), f["value"]))
    # A column of its own, so that a text is cut into lines once.
    memories, every = memories.withColumn("_lines", C.lines(F.col("content"), lines)), F.col("_lines")
    snippets = F.transform(every, lambda x, i: part(C.line_id(F.col("memory_id"), i), "snippet", none, x))
    rest = F.when(F.size("facts") > 0, facts).when(F.size(every) > 1, snippets).otherwise(F.slice(snippets, 1, 0))
    rows = memories.select("repo_key", "memory_id", "memory_type", "status", "title", F.explode(F.concat(F.array(own), rest)).alias("d"))
    title = F.when(F.col("d.kind") == "fact", F.col("d.own_title")).otherwise(F.col("title")).alias("title")
    rows = rows.select("repo_key", "memory_id", "memory_type", "status", "d.document_id", "d.kind", title, "d.content")
    return rows.withColumn("content_sha256", F.sha2(C.canonical_json(content=F.col("content"), document_id=F.col("document_id"), schema_version=F.lit(1), status=F.col("status")), 256))


def first_rows(scores: np.ndarray, columns: np.ndarray, ids: pa.Array, parts: list[pa.Array], k: int) -> np.ndarray:
    """Places of each column's k greatest scores (and of each value of the parts), ties to smaller ids."""
    group = np.zeros(len(scores), np.int64)
    for part in parts:
        codes = part.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        group = group * (codes.max(initial=0) + 1) + codes
    place = np.empty(len(scores), np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(scores))
    order = np.lexsort((place, -scores, group, columns))
    key = (columns * (group.max(initial=0) + 1) + group)[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1)) if len(key) else np.zeros(0, np.int64)
    nth = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    return order[nth < k]


class Bounds:
    """For each query and each value of the parts the least score that can still be among the first k, as far as a task has seen."""

    def __init__(self, k: int, least: float):
        self.k, self.least, self.known = k, least, {}

    def candidates(self, block: int, groups: list[tuple[tuple, np.ndarray]], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, columns) of scores above least that k others of their group don't exceed. groups: of each its value and rows; scores without NaN."""
        found = [self._of((block, value), rows, scores if len(rows) == len(scores) else scores[rows]) for value, rows in groups]
        return np.concatenate([row for row, _ in found]), np.concatenate([column for _, column in found])

    def _of(self, key: tuple, rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bound = self.known.get(key)
        chosen = own > self.least if bound is None else (own > self.least) & (own >= bound)
        # Ties with the bound stay, as ids decide among them.
        if len(own) > self.k and chosen.sum() > 2 * self.k * own.shape[1]:
            kth = np.partition(own, len(own) - self.k, axis=0)[len(own) - self.k]
            bound = kth if bound is None else np.maximum(bound, kth)
            if key in self.known or (len(self.known) + 1) * QUERY_BLOCK <= BOUNDS:
                self.known[key] = bound
            chosen &= own >= bound
        row, column = np.nonzero(chosen)
        return rows[row], column


def groups_of(parts: list[pa.Array], n: int) -> list[tuple[tuple, np.ndarray]]:
    """Each value of the parts and the rows that have it."""
    code = np.zeros(n, np.int64)
    for part in parts:
        own = part.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        code = code * (own.max(initial=0) + 1) + own
    order = np.argsort(code, kind="stable")
    rows = np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if n else []
    return [(tuple(part[int(own[0])].as_py() for part in parts), own) for own in rows]


def scored_in_place(rows: DataFrame, part: list[str], numbers: DataFrame | None, task: Callable[[], Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]], k: int) -> DataFrame:
    """Each query's first k rows (and in each value of the part columns): query_id, document_id, the parts, score, rank.

    rows: document_id, the parts, then what scores need; numbers: query, query_id, of which several can
    have one number; without it the numbers are given as query. task is called in each task and gives a
    function of a batch of at most ROWS rows, of which all queries' candidates come as places of
    rows, numbers of queries and scores. All queries meet a batch while it is in memory, so rows are
    read once. A task hands on k rows of a query, so only those are shuffled.
    """
    schema = rows.select("document_id", *part).schema.add("score", T.DoubleType()).add("query", T.IntegerType())

    def pruned(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        at = first_rows(whole.column("score").to_numpy(), whole.column("query").to_numpy().astype(np.int64), whole.column(0), [whole.column(1 + i) for i in range(len(part))], k)
        return whole.take(pa.array(at))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kept, found = [], 0, 0, task()
        for whole in batches:
            for batch in slices(whole, ROWS):
                for row, query, score in found(batch):
                    own = batch.select(["document_id", *part]).take(pa.array(row))
                    first = first_rows(score, query, own.column(0), own.columns[1:], k)
                    own, query, score = own.take(pa.array(first)), query[first], score[first]
                    held.append(pa.RecordBatch.from_arrays([*own.columns, pa.array(score), pa.array(query.astype(np.int32))], names=schema.names))
                    size += len(query)
                # What is held is at most twice what it was cut to, or a few batches.
                if size > 2 * kept + KEPT_ROWS:
                    held = [pruned(held)]
                    size = kept = held[0].num_rows
        if held:
            yield pruned(held)

    found = top_per_group(rows.mapInArrow(best, schema), ["query", *part], [F.desc("score"), F.col("document_id")], k)
    return found if numbers is None else found.join(F.broadcast(numbers), "query").select("document_id", *part, "score", "query_id", "rank")


def by_matrices(part: list[str], scores: list, k: int, least: float = 0.0) -> Callable:
    """Candidates, as scored_in_place takes them, of scores above least: each of scores gives a matrix of a batch's rows times the next QUERY_BLOCK queries.

    Scores that are not numbers are no candidates, nor is a row that k others of the task are above (see Bounds).
    """
    def task():
        bounds = Bounds(k, least)

        def found(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            groups = groups_of([batch.column(1 + i) for i in range(len(part))], batch.num_rows)
            for n, score in enumerate(scores):
                own = rounded(score(batch))
                own[np.isnan(own)] = -np.inf
                row, column = bounds.candidates(n, groups, own)
                if len(row):
                    yield row, column + n * QUERY_BLOCK, own[row, column]

        return found

    return task


def by_blocks(part: list[str], scores: TermBlocks | HashedBlocks, k: int, least: np.ndarray | None) -> Callable:
    """Candidates, as scored_in_place takes them, of scores above 0 in blocks of queries; least: of each query, the least score that can be among its first k."""
    def task():
        tops, opened = Tops(k, None if least is None else [least[block] for block in scores.blocks]), scores.task()

        def found(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            groups = groups_of([batch.column(1 + i) for i in range(len(part))], batch.num_rows)
            yield from candidates(scores.blocks, opened(batch), groups, tops)

        return found

    return task


def least_scores(rows: DataFrame, scores: TermBlocks | HashedBlocks, n: int, k: int) -> np.ndarray:
    """Of each of n queries its k-th score among one in BOUND_SHARE of the documents, which its k-th among all can't be below; -inf where those are fewer.

    All documents are scored afterwards; knowing this beforehand, most of them need no exact scores.
    """
    some = rows.where(F.pmod(F.xxhash64("document_id"), F.lit(BOUND_SHARE)) == 0)
    # Scores alone are shuffled.
    some = some.select(F.lit(0).alias("document_id"), *(c for c in some.columns if c != "document_id"))
    found = scored_in_place(some, [], None, by_blocks([], scores, k, None), k).where(F.col("rank") == k).select("query", "score").collect()
    least = np.full(n, -np.inf)
    least[[x.query for x in found]] = [x.score for x in found]
    return least


def numbered(spark, ids: list, numbers: np.ndarray, like: DataFrame) -> DataFrame:
    """(query, query_id): the number under which a query is scored."""
    schema = like.select(F.lit(0).alias("query"), "query_id").schema
    return spark.createDataFrame([(int(n), i) for n, i in zip(numbers, ids, strict=True) if n >= 0], schema)


def query_terms(queries: DataFrame, terms) -> tuple[list, list[list[str]]]:
    """Ids and distinct terms of a block of queries: a request's texts, which don't grow with the documents."""
    rows = queries.select("query_id", F.array_distinct(terms(F.col("query"))).alias("t")).orderBy("query_id").collect()
    return [x.query_id for x in rows], [x.t for x in rows]


def in_passes(queries: DataFrame, size: int | None = None, text: str | None = None) -> list[DataFrame]:
    """Queries dealt into passes over the documents, of about so many each and of PASS_BYTES of text."""
    weight = F.sum(F.octet_length(text)) if text else F.lit(0)
    count, total = queries.agg(F.count("*"), F.coalesce(weight, F.lit(0))).first()
    n = max(1, -(-count // (size or QUERY_PASS)), -(-total // PASS_BYTES))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)] if n > 1 else [queries]


def blocks_of(n: int) -> list[slice]:
    return [slice(i, min(i + QUERY_BLOCK, n)) for i in range(0, n, QUERY_BLOCK)]


def postings(documents: DataFrame, part: list[str], vocabulary: list[str]) -> DataFrame:
    """(document_id, the parts, length, terms, counts): the places in the vocabulary of the document's terms, stored, so that texts are split once."""
    words = documents.select("document_id", *part, lowered(F.col("content")).alias("w"))
    schema = words.select("document_id", *part).schema.add("length", T.IntegerType()).add("terms", T.ArrayType(T.IntegerType())).add("counts", T.ArrayType(T.IntegerType()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = pa.array(vocabulary, pa.string()), max(1, len(vocabulary))
        for batch in (part for whole in batches for part in slices(whole, ROWS)):
            found, row = tokens(batch.column(batch.num_columns - 1), letters())
            term = pc.index_in(found, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            length = pa.array(np.bincount(row, minlength=batch.num_rows).astype(np.int32))
            pair, times = np.unique((row * n + term)[term >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(pair, np.arange(batch.num_rows + 1) * n).astype(np.int32))
            arrays = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pair % n, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], length, *arrays], names=schema.names)

    return stored(words.mapInArrow(count, schema), "postings")


def lexical(documents: DataFrame, queries: DataFrame, k: int, partition: list[str] | None = None) -> DataFrame:
    """BM25's first k documents for each query (and each value of the partition columns): query_id, document_id, score, rank.

    documents: document_id, content; queries: query_id, query. A query's distinct terms count
    once; queries of the same terms are scored once, and terms that no document has are left out. A document keeps its
    postings of the queries' terms and is scored where it lies. Scores are rounded, so ties go to the smaller id everywhere.
    """
    part = partition or []
    out = None
    for some in in_passes(queries, text="query"):
        ids, asked = query_terms(some, C.words)
        vocabulary = sorted(set().union(*asked)) if asked else []
        held = postings(documents, part, vocabulary)
        total = held.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
        # As many rows as the queries have terms.
        df = np.zeros(len(vocabulary))
        for t, n in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[t] = n
        place = {t: i for i, t in enumerate(vocabulary) if df[i]}
        idf = np.log(1 + (total.n - df + 0.5) / (df + 0.5))
        known, numbers = {}, []
        for own in asked:
            terms = tuple(sorted(place[t] for t in own if t in place))
            numbers.append(known.setdefault(terms, len(known)) if terms else -1)
        distinct = [np.array(terms, np.int32) for terms in known]
        # Queries that have their most frequent term in common mostly share others.
        most = np.array([terms[df[terms].argmax()] for terms in distinct], np.int64)
        blocks = lambda key: TermBlocks(blocks_in_order(most, key), distinct, idf, total.mean or 1.0, df / max(1, total.n))
        scores, least = blocks(np.array([len(x) for x in distinct])), None
        if len(distinct) > MANY and not part:
            least = least_scores(held, scores, len(distinct), k)
            scores = blocks(least)
        found = scored_in_place(held, part, numbered(some.sparkSession, ids, numbers, some), by_blocks(part, scores, k, least), k)
        out = found if out is None else out.unionByName(found)
    return out


def hashed_near(documents: DataFrame, queries: DataFrame, k: int, partition: list[str] | None = None, dimension: int = DIMENSION) -> DataFrame:
    """The first k documents of each query by the cosine of their hashing embeddings (see hashed): query_id, document_id, score, rank.

    documents: document_id, content; queries: query_id, query. A distinct term is hashed once
    in each batch; a batch's counts are one matrix, whose product with the queries' is the
    scores. Queries of one embedding are scored once. A pair without a common bucket is no candidate.
    """
    part = partition or []
    rows = documents.select("document_id", *part, lowered(F.col("content")).alias("t"))
    out = None

    for some in in_passes(queries, text="query"):
        ids, asked = query_terms(some, C.terms)
        known, numbers = {}, []
        for at in range(0, len(asked), ROWS):
            for own in hashed_counts(pa.array([" ".join(own) for own in asked[at : at + ROWS]], pa.string()), dimension).astype(np.int32):
                numbers.append(known.setdefault(own.tobytes(), len(known)) if own.any() else -1)
        counts = np.frombuffer(b"".join(known), np.int32).reshape(len(known), dimension)
        scores, least = HashedBlocks(blocks_in_order(np.arange(len(counts))), counts), None
        if len(counts) > MANY and not part:
            least = least_scores(rows, scores, len(counts), k)
        found = scored_in_place(rows, part, numbered(some.sparkSession, ids, numbers, some), by_blocks(part, scores, k, least), k)
        out = found if out is None else out.unionByName(found)
    return out


def vector_near(documents: DataFrame, queries: DataFrame, k: int, partition: list[str] | None = None, least: float = -np.inf) -> DataFrame:
    """The first k documents of each query by the cosine of their vectors: query_id, document_id, score, rank.

    documents: document_id, vector; queries: query_id, vector, all of one dimension. A batch of
    documents is one matrix, multiplied with the queries'. Vectors that are null or zero, or hold
    a null or no number, are no candidates, nor are pairs of a cosine up to least.
    """
    part = partition or []
    rows = documents.select("document_id", *part, F.col("vector").cast("array<double>").alias("vector"))
    out = None

    def matrix(vectors: list, width: int) -> np.ndarray:
        """Unit rows, of NaN where there is no direction."""
        m = np.array([x if x is not None and len(x) else [np.nan] * width for x in vectors], float).reshape(len(vectors), width)
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)

    for some in in_passes(queries, VECTOR_PASS):
        asked = some.select("query_id", F.col("vector").cast("array<double>").alias("v")).orderBy("query_id").collect()
        width = max((len(x.v) for x in asked if x.v), default=0)
        q = matrix([x.v for x in asked], width)

        def score(batch: pa.RecordBatch, q, width=width) -> np.ndarray:
            lists = batch.column(batch.num_columns - 1)
            sizes = pc.fill_null(pc.list_value_length(lists), width)
            if pc.any(pc.and_(pc.not_equal(sizes, width), pc.not_equal(sizes, 0))).as_py():
                raise ValueError(f"dimension_mismatch: queries have {width} components")
            if lists.null_count or pc.any(pc.equal(sizes, 0)).as_py():
                d = matrix(lists.to_pylist(), width)
            else:
                d = matrix(lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width), width)
            return d @ q.T

        scores = [partial(score, q=q[block]) for block in blocks_of(len(asked))]
        numbers = numbered(some.sparkSession, [x.query_id for x in asked], range(len(asked)), some)
        found = scored_in_place(rows, part, numbers, by_matrices(part, scores, k, least), k)
        out = found if out is None else out.unionByName(found)
    return out


def hashed(df: DataFrame, text: Column, name: str = "vector", dimension: int = DIMENSION) -> DataFrame:
    """Adds a hashing embedding as a sorted array of (bucket, count) over the text's distinct terms.

    Buckets are sorted in their row and counted by the ends of their runs, each step a column of
    its own so that nothing is computed for every element anew.
    """
    rows = df.withColumn("_b", F.array_sort(F.transform(F.array_distinct(C.terms(text)), lambda t: C.bucket(t, dimension))))
    ends = F.transform("_b", lambda b, i: F.when(F.coalesce(F.get("_b", i + 1) != b, F.lit(True)), i + 1))
    rows = rows.withColumn("_e", F.filter(ends, lambda e: e.isNotNull()))
    runs = F.transform("_e", lambda e, j: F.struct(F.get("_b", e - 1).alias("bucket"), (e - F.coalesce(F.get("_e", j - 1), F.lit(0))).cast("double").alias("n")))
    return rows.withColumn(name, runs).drop("_b", "_e")


def norm(counts: Column) -> Column:
    return F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, e: s + e["n"] * e["n"]))


def fuse(candidates: DataFrame) -> DataFrame:
    """Reciprocal rank fusion: query_id, memory_id, score, sources, best vector score.

    candidates: query_id, memory_id, source (lexical or vector), rank, score. A memory counts
    once in each source, at its best rank.
    """
    best = candidates.groupBy("query_id", "memory_id", "source").agg(F.min("rank").alias("rank"), F.max("score").alias("top"))
    return best.groupBy("query_id", "memory_id").agg(
        F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.max(F.when(F.col("source") == "vector", F.col("top"))).alias("vector_score"), F.bool_or(F.col("source") == "lexical").alias("has_lexical"),
    )


def rerank_overlap(rows: DataFrame, query: str = "query", content: str = "content") -> DataFrame:
    """Replaces score by itself plus twice the share of the query's terms that the content has."""
    return rows.withColumn("score", F.round(F.col("score") + 2 * C.overlap(C.terms(F.col(query)), C.terms(F.col(content))), 9))


def pinned(heads: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, memory_id): the one open head of the workstream that a query names; none if there are several."""
    return asked.join(heads.where("heads = 1"), ["repo_key", "workstream_key"]).select("query_id", F.col("head_id").alias("memory_id"))


def admit(ranked: DataFrame, limit: int, threshold: float, caps: dict[str, int] | None = None) -> DataFrame:
    """Order, relevance, type caps and limit: each candidate with its rank if admitted, or the reason why not.

    ranked: query_id, memory_id, memory_type, created_at_ms, score, vector_score, has_lexical,
    is_pinned. Relevant is what lexical search found, or reaches the threshold, or is pinned.
    Counters stop at the limit, so an omitted memory of a type that has reached its cap among
    the admitted is omitted by the cap, else by the limit.
    """
    caps = caps or TYPE_CAPS
    cap = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in caps.items() for x in p)), F.col("memory_type")), F.lit(0))
    priority = F.array_position(F.array(*map(F.lit, TYPE_ORDER)), F.col("memory_type"))
    relevant = F.coalesce(F.col("has_lexical"), F.lit(False)) | F.coalesce(F.col("vector_score") >= threshold, F.lit(False)) | F.coalesce(F.col("is_pinned"), F.lit(False))
    rows = ranked.withColumn("relevant", relevant).withColumn("_order", F.struct(~F.coalesce("is_pinned", F.lit(False)), -F.col("score"), priority, -F.col("created_at_ms"), F.col("memory_id")))
    # Windows hold a query's candidates, which the candidate caps bound.
    typed = Window.partitionBy("query_id", "relevant", "memory_type").orderBy("_order")
    rows = rows.withColumn("_pass", F.col("relevant") & (F.row_number().over(typed) <= cap))
    passing = Window.partitionBy("query_id", "_pass").orderBy("_order")
    rows = rows.withColumn("_rn", F.row_number().over(passing)).withColumn("admitted", F.col("_pass") & (F.col("_rn") <= limit))
    full = F.count_if(F.col("admitted")).over(Window.partitionBy("query_id", "memory_type")) >= cap
    reason = F.when(~F.col("relevant"), "relevance").when(F.col("admitted"), None).when(full, "type_cap").otherwise("limit")
    return rows.withColumn("rank", F.when(F.col("admitted"), F.col("_rn")).cast("int")).withColumn("omission", reason).drop("_order", "_pass", "_rn")


def admission_trace(admitted: DataFrame, queries: DataFrame) -> DataFrame:
    """For each query: how many were admitted, and why: relevant_candidate, pinned_work_state, below_threshold or no_candidates."""
    sums = admitted.groupBy("query_id").agg(
        F.count("*").alias("candidates"), F.count_if("admitted").alias("n_admitted"), F.count_if(F.col("admitted") & ~F.coalesce("is_pinned", F.lit(False))).alias("regular"), F.max("vector_score").alias("max_vector_score"))
    rows = queries.select("query_id").join(sums, "query_id", "left")
    reason = F.when(F.col("regular") > 0, "relevant_candidate").when(F.col("n_admitted") > 0, "pinned_work_state").when(F.col("candidates") > 0, "below_threshold").otherwise("no_candidates")
    return rows.select("query_id", F.coalesce("n_admitted", F.lit(0)).alias("n_admitted"), F.when(F.coalesce("n_admitted", F.lit(0)) > 0, "admitted").otherwise("abstained").alias("outcome"), reason.alias("reason"), "max_vector_score")


def sidecar(queries: DataFrame, found: DataFrame, profile: str, limit: int, contexts: DataFrame | None = None, token_limit: int | None = None, cursors: DataFrame | None = None) -> DataFrame:
    """One record of each recall beside its context: query_id, query, profile, limit, ranked, omissions, lexical_candidates, vector_candidates, n_admitted, outcome, reason, max_vector_score, context, freshness.

    queries: query_id, query, and repo_key where cursors are given; found: what hybrid gives; contexts:
    what context gives; cursors: repo_key, source_cursor, index_cursor, semantic_state. ranked holds the
    admitted in order; omissions the others with their reason, and those that the token budget
    left out of the context. All lists are bounded by the candidate cap. freshness is
    semantic_pending while extraction of the repository isn't complete, null without cursors.
    """
    entry = F.struct(F.col("rank"), "memory_id", "memory_type", "score", "sources", F.when(F.size("sources") > 0, "relevant_candidate").otherwise("pinned_work_state").alias("admission"))
    lists = found.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("admitted"), entry))).alias("ranked"), F.array_sort(F.collect_list(F.when(~F.col("admitted"), F.struct("memory_id", F.col("omission").alias("reason"))))).alias("omitted"),
        F.count_if(F.array_contains("sources", "lexical")).alias("lexical_candidates"), F.count_if(F.array_contains("sources", "vector")).alias("vector_candidates"))
    rows = queries.join(lists, "query_id", "left").join(admission_trace(found, queries), "query_id")
    empty = lambda c: F.coalesce(c, F.array().cast(lists.schema[c].dataType))
    rows = rows.withColumns({c: empty(c) for c in ("ranked", "omitted")})
    own = F.struct(F.lit(None).cast("array<string>").alias("rendered_ids"), F.lit(None).cast("long").alias("omitted_snippets"), F.lit(None).cast("long").alias("token_count"), F.lit(None).cast("int").alias("token_limit"))
    omissions = F.col("omitted")
    if contexts is not None:
        rows = rows.join(contexts, "query_id", "left")
        own = F.struct("rendered_ids", "omitted_snippets", F.col("token_count").cast("long").alias("token_count"), F.lit(token_limit).cast("int").alias("token_limit"))
        omissions = F.concat("omitted", F.transform(F.coalesce("omitted_ids", F.array().cast("array<string>")), lambda x: F.struct(x.alias("memory_id"), F.lit("token_budget").alias("reason"))))
    fresh = F.lit(None).cast("string")
    if cursors is not None:
        rows = rows.join(cursors.select("repo_key", "source_cursor", "index_cursor", "semantic_state"), "repo_key", "left")
        fresh = F.when(F.col("semantic_state") == "complete", "fresh").otherwise("semantic_pending")
    return rows.select(
        "query_id", "query", F.lit(profile).alias("profile"), F.lit(limit).alias("limit"), "ranked", omissions.alias("omissions"), F.coalesce("lexical_candidates", F.lit(0)).alias("lexical_candidates"),
        F.coalesce("vector_candidates", F.lit(0)).alias("vector_candidates"), "n_admitted", "outcome", "reason", "max_vector_score", own.alias("context"), *(["source_cursor", "index_cursor"] if cursors is not None else []), fresh.alias("freshness"))


def snippets(admitted: DataFrame, most: int = SNIPPETS, lines: int | None = C.LINES) -> DataFrame:
    """The best of each admitted memory's first lines (None: of all): query_id, memory_id, document_id, text, snippet_score.

    admitted: query_id, query, memory_id, content, and found: an array of struct<document_id,
    text, score> that search returned. What search returned scores 1.5 + atan(score) / pi,
    above every other line's share of the query's terms.
    """
    every = C.lines(F.col("content"), lines)
    own = F.transform(every, lambda x, i: F.struct(C.line_id(F.col("memory_id"), i).alias("document_id"), x.alias("text")))
    asked = F.array_distinct(C.terms(F.col("query")))
    rows = admitted.withColumn("_asked", asked).withColumn("_found", F.coalesce("found", F.array().cast("array<struct<document_id:string,text:string,score:double>>")))
    known = F.transform("_found", lambda f: f["document_id"])
    scored = F.transform(F.filter(own, lambda s: ~F.array_contains(known, s["document_id"])), lambda s: F.struct(s["document_id"].alias("document_id"), s["text"].alias("text"), F.round(F.size(F.array_intersect(F.col("_asked"), C.terms(s["text"]))) / F.greatest(F.lit(1), F.size("_asked")), 9).alias("score")))
    searched = F.transform("_found", lambda f: F.struct(f["document_id"].alias("document_id"), f["text"].alias("text"), F.round(1.5 + F.atan(f["score"]) / F.lit(3.141592653589793), 9).alias("score")))
    ordered = F.array_sort(F.concat(searched, scored), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["document_id"] < b["document_id"], -1).when(a["document_id"] > b["document_id"], 1).otherwise(0))
    top = F.slice(ordered, 1, most)
    return rows.select("query_id", "memory_id", F.inline(top)).withColumnRenamed("score", "snippet_score")


def context(found: DataFrame, queries: DataFrame, token_limit: int, most: int = CONTEXT_SNIPPETS) -> DataFrame:
    """One context for each query: the snippets that fit a budget of tokens, under their memories in order of rank.

    found: query_id, rank, memory_id, title, footer (the memory's closing lines), document_id,
    text, snippet_score. The most best snippets are tried in order; one that doesn't fit is
    left out and the next is tried. A memory's heading and footer count with its first snippet.
    Gives query_id, markdown, token_count, rendered_ids, omitted_snippets, and omitted_ids: memories of which no snippet fits.
    """
    header = F.concat(F.lit("# Recall Context\n\nTask: "), F.col("query"))
    asked = queries.select("query_id", F.when(C.tokens_estimate(header) + 1 > token_limit, C.byte_cut(header, 2 * token_limit - 2)).otherwise(header).alias("header")).withColumn("header", F.concat("header", F.lit("\n")))
    order = Window.partitionBy("query_id").orderBy(F.desc("snippet_score"), "rank", "document_id")
    tried = found.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most)
    head, line = F.concat(F.lit("\n## "), F.col("title"), F.lit("\n\n")), F.concat(F.lit("- "), F.col("text"), F.lit("\n"))
    tried = tried.select("query_id", F.struct("_at", F.col("rank").alias("rank"), "memory_id", (F.octet_length(head) + F.octet_length("footer")).alias("frame"), F.octet_length(line).alias("bytes"), line.alias("line"), head.alias("head"), "footer").alias("s"))
    packed = asked.join(tried.groupBy("query_id").agg(F.array_sort(F.collect_list("s")).alias("s")), "query_id", "left")
    start = F.struct(F.octet_length("header").cast("int").alias("bytes"), F.array().cast("array<int>").alias("ranks"), F.array().cast("array<int>").alias("taken"))

    def take(state: Column, s: Column) -> Column:
        total = state["bytes"] + s["bytes"] + F.when(F.array_contains(state["ranks"], s["rank"]), 0).otherwise(s["frame"])
        return F.when(F.ceil(total / 2) <= token_limit, F.struct(total.cast("int").alias("bytes"), F.array_union(state["ranks"], F.array(s["rank"])).alias("ranks"), F.array_append(state["taken"], s["_at"]).alias("taken"))).otherwise(state)

    packed = packed.withColumn("f", F.aggregate(F.coalesce("s", F.array().cast(packed.schema["s"].dataType)), start, take))
    chosen = F.filter("s", lambda s: F.array_contains(F.col("f.taken"), s["_at"]))
    ranks = F.array_sort("f.ranks")
    first = lambda own: F.element_at(own, 1)
    block = lambda own: F.concat(first(own)["head"], F.array_join(F.transform(own, lambda s: s["line"]), ""), first(own)["footer"])
    body = F.transform(ranks, lambda r: block(F.filter(F.col("c"), lambda s: s["rank"] == r)))
    packed = packed.withColumn("c", chosen)
    empty = F.when(F.size(F.coalesce("s", F.array())) == 0, "\nNo relevant memory was admitted.\n").otherwise("\nNo attributed memory matched within the context budget.\n")
    text = F.concat("header", F.coalesce(F.array_join(body, ""), F.lit("")))
    packed = packed.withColumn("markdown", F.when((F.size("f.ranks") == 0) & (C.tokens_estimate(F.concat(text, empty)) <= token_limit), F.concat(text, empty)).otherwise(text))
    ids = F.transform(ranks, lambda r: first(F.filter(F.col("c"), lambda s: s["rank"] == r))["memory_id"])
    return packed.select("query_id", "markdown", C.tokens_estimate(F.col("markdown")).alias("token_count"), F.coalesce(ids, F.array()).alias("rendered_ids"), (F.size(F.coalesce("s", F.array())) - F.size("f.taken")).cast("long").alias("omitted_snippets"),
        F.coalesce(F.array_sort(F.array_except(F.transform("s", lambda s: s["memory_id"]), F.coalesce(ids, F.array()))), F.array()).alias("omitted_ids"))


def hybrid(memories: DataFrame, queries: DataFrame, limit: int, threshold: float, dimension: int = DIMENSION, pins: DataFrame | None = None, rerank=None, by_repository: bool = False, embedder: Embedder | None = None, index=None, lines: int | None = C.LINES) -> DataFrame:
    """Recall from end to end: for each query its admitted and omitted memories, with the search's snippets of each.

    memories: as project takes them, with created_at_ms; queries: query_id, query, and by_repository
    repo_keys, the repositories that a query asks. Both sources search the documents of active
    memories: the memory, and each of its facts or lines. A memory counts once in each source, at
    the best rank of its documents; by_repository each repository's documents are ranked
    for themselves. found holds the facts and lines that search returned, scored by the sum of
    1 / (60 + rank). pins: (query_id, memory_id), see pinned. rerank takes and returns rows
    with query, content and score. embedder: a provider's embeddings instead of the hashed ones.
    index: an IndexStore, whose documents are searched if they are what the memories project to;
    else it raises IndexNotReady. lines: how many of a memory's lines are documents, see project. By repository, a memory id in several of a query's repositories
    is an error.
    """
    k = candidate_cap(limit)
    active = memories.where("status = 'active'")
    if index is not None:
        index.require(memories, queries.select(F.explode("repo_keys").alias("repo_key")) if by_repository else None)
    projected = index.documents().where("status = 'active'") if index is not None else project(active, lines)
    documents = stored(projected.select("repo_key", "memory_id", "document_id", "kind", "title", F.col("content").alias("text")), "projected")
    part = ["repo_key"] if by_repository else []
    words = lexical(documents.select("document_id", *part, F.col("text").alias("content")), queries, k, part).withColumn("source", F.lit("lexical"))
    bodies = documents.select("document_id", *part, F.concat_ws("\n", "title", "text").alias("content"))
    if embedder is None:
        near = hashed_near(bodies, queries, k, part, dimension)
    else:
        near = vector_near(embedder.add(bodies, "content"), embedder.add(queries, "query"), k, part, least=0.0)
    near = near.withColumn("source", F.lit("vector"))
    both = words.unionByName(near)
    if by_repository:
        both = both.join(queries.select("query_id", F.explode(F.array_distinct("repo_keys")).alias("repo_key")), ["query_id", "repo_key"], "left_semi")
    both = both.drop("repo_key")
    # At most k rows of each source, query and repository.
    both = stored(both, "candidates")
    known = documents.join(small(both.select("document_id").distinct()), "document_id", "left_semi").select("document_id", "memory_id", "kind", "text", "repo_key")
    both = stored(both.join(known, "document_id"), "found")
    if by_repository and not both.groupBy("query_id", "memory_id").agg(F.min("repo_key").alias("a"), F.max("repo_key").alias("b")).where("a <> b").isEmpty():
        raise ValueError("memory_in_several_repositories")
    found = both.where("kind <> 'memory'").groupBy("query_id", "memory_id", "document_id", "text").agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9).alias("score"))
    found = found.groupBy("query_id", "memory_id").agg(F.array_sort(F.collect_list(F.struct("document_id", "text", "score"))).alias("found"))
    # A memory's rank in a source is that of its first document there; with several repositories each has its own ranks.
    fused = fuse(both).join(found, ["query_id", "memory_id"], "left").withColumn("is_pinned", F.lit(False))
    if pins is not None:
        fused = fused.drop("is_pinned").join(pins.select("query_id", "memory_id", F.lit(True).alias("is_pinned")), ["query_id", "memory_id"], "full")
        fused = fused.withColumn("is_pinned", F.coalesce("is_pinned", F.lit(False))).withColumn("score", F.coalesce("score", F.lit(0.0)))
    fused = stored(fused, "fused")
    of = small(fused.select("memory_id").distinct())
    rows = fused.join(active.join(of, "memory_id", "left_semi").select("memory_id", "memory_type", "created_at_ms", *(["content"] if rerank else [])), "memory_id")
    if rerank:
        rows = rerank(rows.join(queries.select("query_id", "query"), "query_id")).drop("query", "content")
    return admit(rows, limit, threshold)


def marks(documents: DataFrame, keys: list[str]) -> DataFrame:
    """(the keys, n, h): number and sum of hashes of each key's documents, by id and content hash, so nothing is collected."""
    return documents.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.xxhash64("document_id", "content_sha256").cast("decimal(38,0)")).alias("h"))


def same_marks(expected: DataFrame, indexed: DataFrame, keys: list[str]) -> DataFrame:
    """(the keys, ready) of two tables of marks; a key that one of them lacks isn't ready."""
    side = lambda df, name: df.select(*keys, F.col("n").alias(f"{name}_n"), F.col("h").alias(f"{name}_h"))
    both = side(expected, "e").join(side(indexed, "i"), keys, "full")
    return both.select(*keys, F.coalesce((F.col("e_n") == F.col("i_n")) & (F.col("e_h") == F.col("i_h")), F.lit(False)).alias("ready"))


def preflight(expected: DataFrame, indexed: DataFrame, keys: list[str]) -> DataFrame:
    """(the keys, ready): whether each key's index has exactly the documents, by id and content hash, that its memories project to.

    A key without documents on both sides isn't listed.
    """
    return same_marks(marks(expected, keys), marks(indexed, keys), keys)
