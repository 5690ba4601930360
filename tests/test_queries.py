"""Every query of the engine against its SQL in DuckDB, on all rows of the smallest tables."""

import pytest

from tracelode.plans.flagship import ORACLE_SQL, QUERIES

from .oracle import TABLES, same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


def test_snippets_of_whole_texts(spark, sf, tmp_path):
    """Lines behind the first 128, and behind the first 10,000, are searched and chosen, each under an id of its own."""
    import duckdb

    plain = lambda n, first="": "\n".join([f"head{n}{first}", *(f"plain{n} line{i % 50} of it" for i in range(n))])
    texts = [f"{plain(150)}\nneedle thread late", plain(127), f"needle\n{plain(3)}", f"{plain(10_100)}\ncompass rose needle"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{t}', 'en', 'src', CAST({len(t)} AS BIGINT))" for i, t in enumerate(texts)) + ") v(doc_id, text, lang, source, n_chars)")
    con.execute("CREATE TABLE benchmark AS SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'needle thread late'), (2, 'compass rose'), (3, 'line7 of it')) v(item_id, text)")
    for t in TABLES:
        con.execute(f"COPY (SELECT * FROM {t if t in ('documents', 'benchmark') else repr(f'{sf}/{t}.parquet')}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    name = "rec12_snippets"
    assert "128" not in ORACLE_SQL[name]
    assert same(QUERIES[name](spark, str(tmp_path)), ORACLE_SQL[name], str(tmp_path)) > 0
    best = {x.query_id: x for x in QUERIES[name](spark, str(tmp_path)).orderBy("snippet_score").collect()}
    assert best[1].text == "needle thread late" and best[1].document_id.endswith(":snippet:0151")
    assert best[2].text == "compass rose needle" and best[2].document_id.endswith(":snippet:10101")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
