import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracelode.functions.arrow import check_name, nfc
from tracelode.functions.tables import jumps
from tracelode.operators import evaluation, evolution
from tracelode.sources import lake

MEMORY = "memory_id string, repo_key string, memory_type string, content_sha256 string"


def test_immutable_writes(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    rows = spark.createDataFrame([("a", "r", "t", "1"), ("b", "r", "u", "2"), ("b", "r", "u", "2")], MEMORY)
    for _ in range(2):
        lake.write_immutable(rows, path)
        assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError, match="another"):
        lake.write_immutable(spark.createDataFrame([("a", "r", "t", "other"), ("c", "r", "t", "3")], MEMORY), path)
    with pytest.raises(ValueError, match="conflicting"):
        lake.write_immutable(spark.createDataFrame([("d", "r", "t", "1"), ("d", "r", "t", "2")], MEMORY), path)
    assert spark.read.parquet(path).count() == 2


def test_export_and_exclusive(spark, tmp_path):
    rows = spark.createDataFrame([("a", "r", "t", "1"), ("b", "s", "u", "2")], MEMORY)
    found = lake.export_namespace(rows, "r", f"file://{tmp_path}/e").collect()
    for x in found:
        data = (tmp_path / "e" / x.file).read_bytes()
        assert (x.bytes, x.sha256) == (len(data), hashlib.sha256(data).hexdigest())
    assert spark.read.parquet(f"file://{tmp_path}/e").count() == 1
    lake.write_exclusive(rows, f"file://{tmp_path}/j")
    with pytest.raises(Exception, match="(?i)exist"):
        lake.write_exclusive(rows, f"file://{tmp_path}/j")


def test_markdown(spark, tmp_path):
    (tmp_path / "good.md").write_text('---\nid: "m1"\ntags: ["a", "b"]\n---\n\nBody line\n\nmore\n')
    (tmp_path / "order.md").write_text('---\ntags: []\nid: "m2"\n---\n\nx\n')
    (tmp_path / "json.md").write_text("---\nid: m3\ntags: []\n---\n\nx\n")
    (tmp_path / "bare.md").write_text("no front matter\n")
    found = {x.path.rsplit("/", 1)[1]: x for x in lake.read_markdown(spark, f"file://{tmp_path}", ["id", "tags"]).collect()}
    assert found["good.md"].violations == [] and json.loads(found["good.md"].fields["id"]) == "m1" and found["good.md"].body == "Body line\n\nmore\n"
    assert found["order.md"].violations == ["wrong_keys"] and found["json.md"].violations == ["not_json"] and "no_front_matter" in found["bare.md"].violations


def test_outcomes_and_junit(spark, tmp_path):
    for i, q in enumerate(["q1", "q2"]):
        (tmp_path / f"{i}.json").write_text(json.dumps({"question_id": q, "outcome": "correct"}, indent=2))
    schema = "question_id string, outcome string"
    assert lake.read_outcomes(spark, f"file://{tmp_path}", schema, "question_id").count() == 2
    (tmp_path / "3.json").write_text(json.dumps({"question_id": "q1", "outcome": "wrong"}))
    with pytest.raises(Exception, match="duplicate outcome q1"):
        lake.read_outcomes(spark, f"file://{tmp_path}", schema, "question_id").collect()
    folder = tmp_path / "x"
    folder.mkdir()
    (folder / "r.xml").write_text('<testsuites><testsuite name="s" tests="8" failures="0" errors="0" skipped="1"/><testsuite name="t" tests="2" failures="1"/></testsuites>')
    assert {x.name: x.passed for x in lake.read_junit(spark, f"file://{folder}").collect()} == {"s": True, "t": False}


def test_dialogues(spark, tmp_path):
    say = lambda *t: [{"speaker": "A", "text": x} for x in t]
    sample = {"sample_id": "s", "conversation": {"speaker_a": "A", "session_1": say("hi", "there"), "session_1_date_time": "May", "session_2": [{"speaker": "B", "text": "look", "blip_caption": "a cat"}], "session_4": say("lost")}, "qa": [{"question": "q", "answer": "a", "category": 2}]}
    (tmp_path / "d.json").write_text(json.dumps([sample]))
    turns, questions = lake.read_dialogues(spark, f"file://{tmp_path}/d.json")
    assert sorted((x.session, x.turn, x.line) for x in turns.collect()) == [(1, 0, "A: hi"), (1, 1, "A: there"), (2, 0, "B: look [a cat]")]
    assert [(x.question, x.category) for x in questions.collect()] == [("q", 2)]


def test_exec_trace_and_messages(spark):
    lines = [{"type": "item.completed", "item": {"type": "command_execution", "command": "a", "exit_code": 1}}, {"type": "turn.completed", "usage": {"input_tokens": 5, "output_tokens": 1}}, {"type": "turn.completed", "usage": {"input_tokens": 9, "output_tokens": 2}}]
    rows = [("r", i, json.dumps(x)) for i, x in enumerate(lines)] + [("r", 9, "not json")]
    x = lake.exec_trace(spark.createDataFrame(rows, "run_id string, position int, line string")).first()
    assert (x.steps, x.input_tokens, x.output_tokens, x.failed_commands) == (1, 9, 2, 1)
    chats = [("c", 0, "assistant", [("text", "hello"), ("image", None)], [("k", "shell", "{}")], None), ("c", 1, "tool", [("text", "done")], None, "k")]
    found = lake.message_events(spark.createDataFrame(chats, "chat_id string, index int, role string, content array<struct<type:string,text:string>>, tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string"))
    assert [(x.kind, x.text, x.call_id) for x in found.orderBy("index", "block").collect()] == [("message", "hello", None), ("tool_call", None, "k"), ("tool_result", "done", "k")]


def test_jumps_and_cycles(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1001), (2000, 2000)]
    found = {x.node: (x.tip, x.depth, x.cyclic) for x in jumps(spark.createDataFrame(chain, "node long, next long")).collect()}
    assert all(found[i] == (300, 300 - i, False) for i in range(301)) and all(found[i][2] for i in (1000, 1001, 1002, 2000))


def test_reach_where_chains_meet(spark):
    """Two memories superseded by one: equal depths on both sides, but only their own ways."""
    edges = spark.createDataFrame([("r", 1, 2), ("r", 2, 5), ("r", 3, 4), ("r", 4, 5), ("r", 5, 6)], "repo_key string, predecessor_id long, successor_id long")
    pairs = [(1, 2, True), (1, 4, False), (1, 6, True), (3, 5, True), (3, 2, False), (6, 1, False), (4, 6, True), (2, 2, False)]
    rows = spark.createDataFrame([p[:2] for p in pairs], "predecessor_id long, successor_id long")
    found = {(x.predecessor_id, x.successor_id): x.reached for x in evolution.reachable(edges, rows).collect()}
    assert found == {p[:2]: p[2] for p in pairs}


def test_repair_must_be_exact(spark):
    schema = "question_id long, outcome string"
    base = spark.createDataFrame([(1, "correct"), (2, "infrastructure_failure")], schema)
    assert sorted(map(tuple, evaluation.compose_repair(base, spark.createDataFrame([(2, "wrong")], schema), "question_id").collect())) == [(1, "correct"), (2, "wrong")]
    with pytest.raises(Exception, match="exactly the failed"):
        evaluation.compose_repair(base, spark.createDataFrame([(1, "wrong")], schema), "question_id").collect()


def test_tree_digest(spark, tmp_path):
    for name, data in (("b/x", b"1"), ("a", b"2")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([("/r/b/x", bytearray(b"1")), ("/r/a", bytearray(b"2"))], "path string, content binary")
    lines = "".join(f"{n}\0{hashlib.sha256(d).hexdigest()}\n" for n, d in (("a", b"2"), ("b/x", b"1")))
    assert evaluation.tree_digest(files, "/r/").first().digest == hashlib.sha256(lines.encode()).hexdigest()


@pytest.mark.parametrize("command, name", [("pytest -q", "pytest"), ("uv run mypy .", "mypy"), ("/usr/bin/ruff check", "ruff"), ("ruff", None), ("make all lint", "make"), ("npm run build", "npm"), ("npm run", None), ("yarn test", "yarn"), ("go vet ./...", "go"), ("echo 'open", None), ("", None), (None, None)])
def test_check_names(command, name):
    assert check_name(command) == name


def test_nfc(spark):
    assert [x.t for x in spark.createDataFrame([("é",), ("plain",), (None,)], "t string").select(nfc(F.col("t")).alias("t")).collect()] == ["é", "plain", None]


def test_requests_of_one_selection_meet_its_sources_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tracelode.operators import state

    met = []
    whole = state._choices
    monkeypatch.setattr(state, "_choices", lambda distinct, sources: (met.append(distinct.count()), whole(distinct, sources))[1])
    sources = spark.createDataFrame([("r", i, f"f{i}", "already_imported" if i == 2 else "new") for i in range(4)], "repo_key string, source_id long, fingerprint string, import_state string")
    chosen = {0: None, 1: [0, 2], 2: [2], 3: [0, 0], 4: [9], 5: []}
    asks = spark.createDataFrame([(i, "r" if i % 7 else None, chosen[i % 6], i) for i in range(60)], "request_id long, repo_key string, selected array<long>, at_ms long")
    previews = state.onboarding_preview(asks, sources, 500)
    rows = {x.request_id: x for x in previews.collect()}
    assert met == [12] and len(rows) == 60
    kept = {0: ([0, 1, 3], "ready"), 1: ([0, 2], "ready"), 2: ([2], "ready"), 3: ([0], "invalid_selection"), 4: ([], "invalid_selection"), 5: ([], "nothing_selected")}
    assert all((x.chosen, x.state) == kept[i % 6] for i, x in rows.items() if x.repo_key)
    assert {x.state for i, x in rows.items() if not x.repo_key and i % 6 in (0, 5)} == {"nothing_selected"}
    ready = [x.snapshot_id for x in rows.values() if x.state == "ready"]
    assert len(set(ready)) == len(ready) == sum(i % 7 > 0 and i % 6 < 3 for i in rows)
    consents = previews.select("request_id", F.coalesce("snapshot_id", F.lit("none")).alias("snapshot_id"), F.col("expires_ms").alias("at_ms"))
    later = sources.withColumn("fingerprint", F.when(F.col("source_id") == 3, "other").otherwise(F.col("fingerprint")))
    found = {x.request_id: (x.outcome, x.to_import) for x in state.onboarding_apply(consents, previews, later).collect()}
    assert len(found) == 60 and met == [12, 3]
    wanted = {0: ("snapshot_stale", []), 1: ("applied", [0]), 2: ("noop", []), 3: ("unknown_consent", []), 4: ("unknown_consent", []), 5: ("unknown_consent", [])}
    assert all(found[i] == wanted[i % 6] for i, x in rows.items() if x.repo_key)


def test_cycles_do_not_cost_a_step_for_each_doubling_of_all_nodes(spark, monkeypatch):
    from tracelode.functions import tables

    written = []
    whole = tables.stored
    monkeypatch.setattr(tables, "stored", lambda df, name: (written.append(name), whole(df, name))[1])
    # Cycles of three with tails of two, and chains of three, of 4000 nodes.
    edges = [(5 * i + j, 5 * i + (2 if j == 4 else j + 1)) for i in range(500) for j in range(5)]
    edges += [(10_000 + 3 * i + j, 10_000 + 3 * i + j + 1) for i in range(500) for j in range(2)]
    found = {x.node: (x.tip, x.depth, x.cyclic) for x in jumps(spark.createDataFrame(edges, "node long, next long")).collect()}
    assert len(found) == 4000
    assert all(found[n] == (None, None, True) for n in range(2500))
    assert all(found[10_000 + 3 * i + j] == (10_000 + 3 * i + 2, 2 - j, False) for i in range(500) for j in range(3))
    assert len(written) <= 4
