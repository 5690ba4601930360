from tracelode.operators import evaluation

FOUND = "query_id long, memory_id string, admitted boolean"


def test_gate_outcomes_and_report(spark):
    queries = spark.createDataFrame([(1, "positive"), (2, "positive"), (3, "hard_negative"), (4, "hard_negative")], "query_id long, query_kind string")
    relevant = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "z")], "query_id long, memory_id string")
    found = spark.createDataFrame([(1, "a", True), (1, "c", True), (1, "b", False), (2, "gone", True), (3, "a", True)], FOUND)
    sources = spark.createDataFrame([("a", "active", "u", "h"), ("b", "active", "u", "h"), ("c", "superseded", None, "h")], "memory_id string, status string, source_uri string, content_sha256 string")
    outcomes = evaluation.gate_outcomes(queries, relevant, found, sources)
    got = {x.query_id: (x.injected, x.hits, x.recalled, x.precision, x.provenance_covered, x.stale) for x in outcomes.collect()}
    assert got == {1: (2, 1, True, 0.5, False, 1), 2: (1, 0, False, 0.0, False, 1), 3: (1, 0, False, 0.0, True, 0), 4: (0, 0, False, 0.0, True, 0)}
    x = evaluation.gate_report(outcomes).first()
    assert (x.queries, x.positives, x.hard_negatives, x.recall_at_limit, x.precision_at_limit, x.stale_leakage, x.any_injection_rate, x.mean_irrelevant) == (4, 2, 2, 0.5, 0.25, 2, 0.5, 0.5)
    assert not (x.recall_ok or x.provenance_ok or x.stale_ok or x.injection_ok or x.irrelevant_ok or x.passed)


def test_gate_without_queries(spark):
    empty = spark.createDataFrame([], "query_id long, query_kind string")
    relevant, found = spark.createDataFrame([], "query_id long, memory_id string"), spark.createDataFrame([], FOUND)
    sources = spark.createDataFrame([], "memory_id string, status string, source_uri string, content_sha256 string")
    x = evaluation.gate_report(evaluation.gate_outcomes(empty, relevant, found, sources)).first()
    assert x.queries == 0 and x.recall_at_limit is None and x.stale_ok and not x.passed


def test_a_common_title_is_not_met_by_all_its_memories(spark, sf, tmp_path, monkeypatch):
    """Of 300 memories of one title each query of that title meets those that it was given; the outcomes are the SQL's."""
    import duckdb

    from tracelode.plans.flagship import ORACLE_SQL, QUERIES

    from .oracle import TABLES, same

    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT i AS doc_id, 'One common title\nline ' || (i % 90) || ' of ' || i AS text, CASE WHEN i % 2 = 0 THEN 'en' ELSE 'de' END AS lang, 'src' AS source, CAST(30 AS BIGINT) AS n_chars FROM range(300) t(i)")
    for t in TABLES:
        con.execute(f"COPY (SELECT * FROM {t if t == 'documents' else repr(f'{sf}/{t}.parquet')}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    met, whole = [], evaluation.gate_outcomes
    monkeypatch.setattr(evaluation, "gate_outcomes", lambda queries, relevant, found, sources: (met.append(relevant.count()), whole(queries, relevant, found, sources))[1])
    for name in ("evl01_gate_outcomes", "evl01_gate_report"):
        assert same(QUERIES[name](spark, str(tmp_path)), ORACLE_SQL[name], str(tmp_path)) in (24, 1)
    assert met == [60, 60]
