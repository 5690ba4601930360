import hashlib

from pyspark.sql import functions as F

from tracelode.sources import truth

ROWS = "repo_key string, evolution_id string, relation_kind string, reason string, supporting_fact_ids array<string>, created_at_ms long"


def test_round_trip_through_files(spark, tmp_path):
    rows = spark.createDataFrame([("r", "e1", "refines", "why\n---\nstill why\n", ["a", "b"], 5), ("s", "e2", None, None, None, None)], ROWS)
    for x in truth.render(rows, truth.EVOLUTION).collect():
        at = tmp_path / x.path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(x.value, newline="")
    (tmp_path / "evolution" / "stray.md").write_text("not listed\n")
    found = {x.path: x for x in truth.scan(truth.read_files(spark, f"file://{tmp_path}"), truth.EVOLUTION).collect()}
    slug = lambda r: hashlib.sha256(r.encode()).hexdigest()[:16]
    assert set(found) == {f"evolution/{slug('r')}/e1.md", f"evolution/{slug('s')}/e2.md"} and all(x.state == "record" for x in found.values())
    one = found[f"evolution/{slug('r')}/e1.md"]
    assert one.body == "why\n---\nstill why\n" and one.fields["supporting_fact_ids"] == '["a","b"]' and one.fields["created_at_ms"] == "5" and set(one.fields) == set(truth.EVOLUTION.keys)
    other = found[f"evolution/{slug('s')}/e2.md"]
    assert other.body == "" and other.fields["relation_kind"] == "null"


def test_edges(spark):
    good = truth.render(spark.createDataFrame([("p1", "x", 1)], "promotion_id string, description string, created_at_ms long").withColumn("promotion_id", F.lit("promotion_1")), truth.PROMOTION).first()
    files = [
        good, ("global-preferences/promotion_2.md", None), ("global-preferences/promotion_3.md", ""), ("global-preferences/promotion_4.md", "---\n---\nx\n"), ("global-preferences/promotion_5.md", "---\n\n---\nx\n"),
        ("global-preferences/promotion_6.md", good.value.replace('"promotion_1"', '""')), ("global-preferences/promotion_7.md", good.value), ("global-preferences/readme.txt", good.value), ("global-preferences/.promotion_1.md.x", "half"),
        ("person.md", "long " * 1_000_000), (".person.md.x", ""), (None, good.value)]
    rows = spark.createDataFrame([(*x, 1) for x in files], "path string, value string, state int")
    found = {x.path.rsplit("/", 1)[-1]: x.issue or x.state for x in truth.scan(rows, truth.PROMOTION).collect()}
    assert found == {
        "promotion_1.md": "record", "promotion_2.md": "empty_or_too_large", "promotion_3.md": "empty_or_too_large", "promotion_4.md": "unterminated", "promotion_5.md": "bad_line", "promotion_6.md": "wrong_identity",
        "promotion_7.md": "not_at_its_path", "readme.txt": "unexpected_entry", ".promotion_1.md.x": "stage"}
    assert sorted((x.path, x.state, x.issue) for x in truth.scan(rows, truth.PERSON).collect()) == [(".person.md.x", "stage", None), ("person.md", "issue", "no_front_matter")]
    assert truth.scan(rows.limit(0), truth.PROMOTION).count() == 0


def test_one_identity_twice(spark):
    rows = spark.createDataFrame([("r", "m", t) for t in ("a", "b")] + [("r", "n", "a"), ("s", "m", "a")], "repo_key string, memory_id string, memory_type string").withColumn("content", F.lit("x"))
    files = truth.render(rows, truth.MEMORY)
    found = [x.issue for x in truth.scan(files.unionByName(files.where(F.col("path").endswith("/n.md"))), truth.MEMORY).orderBy("path").collect()]
    assert sorted(found, key=str) == [None, "duplicate_identity", "duplicate_identity", "duplicate_identity", "duplicate_identity"]


def test_library_state(spark):
    side = lambda *states: spark.createDataFrame([(s,) for s in states], "state string")
    state = lambda a, b: truth.library_state(side(*a), side(*b)).first().state
    assert [state([], []), state(["record"], ["record", "stage"]), state([], ["record"]), state(["record"], ["issue"])] == ["absent", "ready", "person_missing", "invalid"]
