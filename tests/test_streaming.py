import hashlib

from pyspark.sql import functions as F

from tracelode.operators import recall, traces
from tracelode.streaming import episodes as streaming

SCHEMA = "session_id string, event_index long, kind string, role string, text string, event_sha256 string"


def event(session, i, kind="message", role="assistant", text="said"):
    return (session, i, kind, role, text, hashlib.sha256(f"{session}{i}".encode()).hexdigest())


def run(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = streaming.close_episodes(spark.readStream.schema(streaming.EVENT_SCHEMA).parquet(f"{folder}/in"))
        streaming.start_table(stream, f"{folder}/out", f"{folder}/c").awaitTermination()
    return sorted((r.session_id, r.start_index, r.end_index, r.boundary_kind, r.continues_from, r.n_events) for r in spark.read.parquet(f"{folder}/out").collect())


def test_stream_closes_as_the_batch_does(spark, tmp_path):
    one = [event("s", 0, role="user"), event("s", 1), event("s", 2, role="user"), event("t", 0, role="system"), event("t", 1, role="user")]
    two = [event("s", 2, role="user"), event("s", 3), event("t", 2)]  # one is delivered again
    end = [("s", 4, streaming.CONTROL, "turn_end", "", ""), ("t", 3, streaming.CONTROL, "turn_end", "", "")]
    found = run(spark, f"file://{tmp_path}", [one, two, end])
    assert found == [("s", 0, 2, "next_user", None, 2), ("s", 2, 4, "turn_end", None, 2), ("t", 1, 3, "turn_end", None, 2)]
    events = spark.createDataFrame([*one, two[1], two[2]], SCHEMA).withColumns({"exit_code": F.lit(None).cast("int"), "observed_outcome": F.lit(None).cast("string"), "is_command_result": F.lit(False)})
    batch = sorted((r.session_id, r.start_index, r.end_index, r.n_events) for r in traces.episodes(events).collect())
    assert batch == [(r[0], r[1], r[2], r[5]) for r in found]
    prefix = traces.prefix_at_ends(events, traces.episodes(events)).collect()
    out = {(r.session_id, r.end_index): r.prefix_sha256 for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert {(r.session_id, r.end_index): r.prefix_sha256 for r in prefix} == out


def test_late_events_continue_and_never_rewrite(spark, tmp_path):
    first = [event("s", 0, role="user"), ("s", 1, streaming.CONTROL, "turn_end", "", "")]
    late = [event("s", 1, kind="tool_result", role=None), event("s", 2), ("s", 3, streaming.CONTROL, "session_end", "", "")]
    found = run(spark, f"file://{tmp_path}", [first, late, late])
    assert found == [("s", 0, 1, "turn_end", None, 1), ("s", 1, 3, "session_end", 0, 2)]


def test_index_follows_batches(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    write = streaming.index_batches(path, lambda rows: recall.project(rows).select("memory_id", "document_id", "content_sha256", "repo_key"))

    def memory(i, content, status="active"):
        return (f"r{i % 2}", f"m{i}", "work_state", status, f"title {i}", content, "c", ["t"], [])

    schema = "repo_key string, memory_id string, memory_type string, status string, title string, content string, category string, tags array<string>, facts array<struct<fact_id:string,fact_kind:string,value:string>>"
    write(spark.createDataFrame([memory(0, "a\nb"), memory(1, "x"), memory(2, "y")], schema), 0)
    for _ in range(2):  # a batch may come again
        write(spark.createDataFrame([memory(0, "only one line now")], schema), 1)
    ids = sorted(r.document_id for r in spark.read.parquet(path).collect())
    assert ids == ["m0:memory", "m1:memory", "m2:memory"]


def test_changed_prefix(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "session_id string, prefix_sha256 string")
    before = spark.createDataFrame([("a", "1"), ("b", "3")], "session_id string, prefix_sha256 string")
    assert [tuple(r) for r in streaming.changed_prefix(now, before).collect()] == [("b", "3", "2")]


def test_gaps_wait_and_repeats_change_nothing(spark, tmp_path):
    """Files in any order, each twice, give what one file in order gives; a boundary stands before its index's event."""
    rows = [event("s", 0, role="user"), event("s", 1), event("s", 2), event("s", 3, role="user"), event("s", 4), event("s", 5), event("s", 6, role="user")]
    rows.insert(2, ("s", 2, streaming.CONTROL, "turn_end", "", ""))
    whole = [("s", 0, 2, "turn_end", None, 2), ("s", 2, 3, "next_user", 0, 1), ("s", 3, 6, "next_user", None, 3)]
    assert run(spark, f"file://{tmp_path}/a", [rows]) == whole
    assert run(spark, f"file://{tmp_path}/b", [rows[5:], rows[2:5], rows[:2], rows[1:6]]) == whole
    found = {p: [r.prefix_sha256 for r in spark.read.parquet(f"file://{tmp_path}/{p}/out").orderBy("start_index").collect()] for p in "ab"}
    assert found["a"] == found["b"] and len(set(found["a"])) == 3


def test_pending_calls_and_what_opens_a_continuation(spark, tmp_path):
    schema = SCHEMA + ", block int, tool_name string, call_id string"
    call = lambda i, k, block=0: (*event("s", i, "tool_call", None, None), block, "shell", k)
    answer = lambda i, k: (*event("s", i, "tool_result", None, "ok"), 0, None, k)
    plain = lambda *a, **k: (*event(*a, **k), 0, None, None)
    end = lambda i: ("s", i, streaming.CONTROL, "turn_end", "", "", None, None, None)
    one = [plain("s", 0, role="user"), call(1, "a"), call(1, "b", 1), answer(2, "a"), end(3)]
    two = [plain("s", 3, kind="metadata", role=None), call(4, "c"), answer(5, "b"), end(6)]
    folder = f"file://{tmp_path}"
    for rows in (one, two):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = streaming.close_episodes(spark.readStream.schema(streaming.EVENT_SCHEMA).parquet(f"{folder}/in"))
        streaming.start_table(stream, f"{folder}/out", f"{folder}/c").awaitTermination()
    found = sorted((r.start_index, r.end_index, r.continues_from, r.n_events, r.pending_calls) for r in spark.read.parquet(f"{folder}/out").collect())
    assert found == [(0, 3, None, 4, ["b"]), (4, 6, 0, 2, ["c"])]


def test_copies_of_one_batch_are_thinned_out():
    import pyarrow as pa

    from tracelode.streaming.episodes import distinct_in_batches

    batch = pa.RecordBatch.from_pydict({"session_id": ["a", "a", "b", "a"] * 100, "event_index": [0, 0, 0, 1] * 100, "what": ["user", "user", None, "other"] * 100})
    out = list(distinct_in_batches([batch, batch.slice(0, 0), batch.slice(0, 2)]))
    assert [x.num_rows for x in out if x.num_rows] == [3, 1] and all(x.schema == batch.schema for x in out)
    assert sorted(out[0].to_pylist(), key=str) == sorted([{"session_id": "a", "event_index": 0, "what": "user"}, {"session_id": "b", "event_index": 0, "what": None}, {"session_id": "a", "event_index": 1, "what": "other"}], key=str)


class CountedMap:
    """A map state that counts the requests made to it."""

    def __init__(self):
        self.entries, self.requests = {}, 0

    def __getattr__(self, name):
        self.requests += 1
        e = self.entries
        return {"containsKey": e.__contains__, "getValue": e.get, "updateValue": e.__setitem__, "removeKey": lambda k: e.pop(k, None), "iterator": lambda: iter(sorted(e.items())), "exists": lambda: bool(e)}[name]


class CountedValue:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_requests_to_the_state_grow_with_its_entries_not_with_rows():
    """A later half that waits, then the first one: rows of 64 indexes are one entry, calls that are answered in their batch none."""
    from types import SimpleNamespace

    maps, value = {}, CountedValue()
    folded = streaming.EpisodeProcessor()
    folded.init(SimpleNamespace(getValueState=lambda *a: value, getMapState=lambda name, *a: maps.setdefault(name, CountedMap())))
    fields = ("session_id", "event_index", "is_event", "block", "what", "boundary", "sha", "called", "answered")
    row = lambda i, what="other", called="", answered="": streaming.Row(*fields)("s", i, 1, 0, what, "", f"{i:064x}", called, answered)
    rows = [row(0, "user")] + [row(i, called=f"c{i}") if i % 2 else row(i, answered=f"c{i - 1}") for i in range(1, 640)]
    rows += [streaming.Row(*fields)("s", 640, 0, 0, "other", "session_end", "", "", "")]
    assert list(folded.handleInputRows(("s",), iter(rows[320:]), None)) == []
    out = list(folded.handleInputRows(("s",), iter(rows[:320]), None))
    again = list(folded.handleInputRows(("s",), iter(rows[:3]), None))
    assert [(r.start_index, r.end_index, r.boundary_kind, r.n_events, r.pending_calls) for r in out] == [(0, 640, "session_end", 640, ["c639"])] and again == []
    assert not maps["waiting"].entries and list(maps["pending"].entries) == [("c639",)]
    assert sum(m.requests for m in maps.values()) < 40


def test_entries_many_and_few_are_what_a_plain_map_holds():
    import random

    from tracelode.streaming.episodes import Entries

    chance = random.Random(3)
    for at_once in (0, 256):
        state, plain, size = CountedMap(), {}, 0
        for _ in range(50):
            held = Entries(state, size, at_once)
            for _ in range(20):
                key, what = chance.randrange(12), chance.random()
                if what < 0.4:
                    held.put(key, plain.setdefault(key, chance.randrange(3)) if key in plain else plain.setdefault(key, 0))
                elif what < 0.8:
                    assert held.take(key) == plain.pop(key, None)
                elif what < 0.9:
                    assert held.get(key) == plain.get(key)
                else:
                    assert dict(held.all()) == plain
            held.write()
            size = held.size
            assert size == len(plain) and {k: v for (k,), (v,) in state.entries.items()} == plain
