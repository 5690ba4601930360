import hashlib
import os
import random

import pytest

from tracelode.functions.arrow import next_prefix
from tracelode.sources import line_source as source
from tracelode.sources import transcripts


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


def content(seed, n=40):
    r = random.Random(seed)
    return b"".join(r.choice([b'{"a": "\xc3\xa9"}', b"", b"  \t", b'{"k": ' + str(r.random()).encode() + b"}", b"x" * r.randrange(300), b"\xff\xfe"]) + r.choice([b"\n", b"\r\n"]) for _ in range(n))


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_ranges_give_each_line_once(spark, tmp_path, size):
    for i in range(3):
        write(tmp_path / f"a{i}/s.jsonl", content(i) + (b"" if i else b"no end"))
    write(tmp_path / "other.txt", b"not this\n")
    write(tmp_path / "empty.jsonl", b"")
    found = source.scan(spark, f"file://{tmp_path}", size).collect()
    plain = transcripts.raw_lines(transcripts.read_sessions(spark, str(tmp_path))).collect()
    name = lambda p: p.split(str(tmp_path))[1]
    assert sorted((name(x.source_path), x.event_index, x.line, x.event_sha256) for x in found) == sorted((name(x.source_path), x.event_index, x.line, x.event_sha256) for x in plain)
    assert len(found) > 60


def test_chunks_of_any_size(tmp_path):
    data = content(9)
    write(tmp_path / "s.jsonl", data)
    whole = list(source.lines_between(str(tmp_path / "s.jsonl"), 0, len(data), True))
    for chunk in (1, 3, 50):
        assert list(source.lines_between(str(tmp_path / "s.jsonl"), 0, len(data), True, chunk)) == whole
    assert all(data[a:b].rstrip(b"\r\n") == line for a, b, line in whole)


def cursor_rows(spark, rows):
    return spark.createDataFrame(rows, "source_path string, byte long, event_index long, prefix_sha256 string")


def test_resume_reads_no_byte_before_the_cursor(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    first = b'{"n": 0}\n\n{"n": 1}\n'
    write(path, first)
    start = cursor_rows(spark, [(f"file://{path}", 0, 0, None)])
    cursor = source.next_cursors(source.read_suffixes(start)).collect()
    assert [(x.byte, x.event_index) for x in cursor] == [(len(first), 2)]
    # The prefix is overwritten by as many bytes: nothing of it can be seen again.
    write(path, b"#" * len(first) + b'{"n": 2}\n{"n": 3}\n{"half')
    rows = source.read_suffixes(cursor_rows(spark, [tuple(x) for x in cursor])).collect()
    assert [(x.event_index, x.line) for x in rows] == [(2, '{"n": 2}'), (3, '{"n": 3}')]
    chain = bytes.fromhex(source.SEED)
    for n in range(4):
        chain = next_prefix(chain, hashlib.sha256(b'{"n": %d}' % n).hexdigest())
    assert rows[-1].prefix_sha256 == chain.hex()
    again = source.next_cursors(source.read_suffixes(cursor_rows(spark, [(x.source_path, x.stop, x.event_index + 1, x.prefix_sha256) for x in rows[-1:]])))
    assert again.collect() == []


def test_truncation_and_limits(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    write(path, b"{}\n" * 10)
    at = lambda byte, index: cursor_rows(spark, [(f"file://{path}", byte, index, source.SEED), (f"file://{tmp_path}/gone.jsonl", 0, 0, None)])
    kinds = lambda df: sorted((os.path.basename(x.source_path), x.violation) for x in df.collect())
    assert kinds(source.read_suffixes(at(31, 10))) == [("gone.jsonl", "truncated"), ("s.jsonl", "truncated")]
    assert kinds(source.read_suffixes(at(30, 10))) == [("gone.jsonl", "truncated")]
    assert kinds(source.read_suffixes(at(27, 9), most_events=9))[1] == ("s.jsonl", "too_many_events")
    assert kinds(source.read_suffixes(at(27, 9), most_bytes=29))[1] == ("s.jsonl", "session_too_large")
    assert len(kinds(source.read_suffixes(at(27, 9)))) == 2


def test_stream_reads_what_was_appended(spark, tmp_path):
    folder = f"file://{tmp_path}"

    def run():
        stream = source.appended(spark, f"{folder}/in")
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
        return [(x.line, x.start) for x in spark.read.parquet(f"{folder}/out").orderBy("source_path", "start").collect()]

    write(tmp_path / "in/a.jsonl", b"one\ntw")
    write(tmp_path / "in/b.jsonl", b"other\n")
    assert run() == [("one", 0), ("other", 0)]
    with open(tmp_path / "in/a.jsonl", "ab") as f:
        f.write(b"o\nthree\n")
    assert run() == [("one", 0), ("two", 4), ("three", 8), ("other", 0)]
    write(tmp_path / "in/a.jsonl", b"short\n")
    with pytest.raises(Exception, match="source_truncated"):
        run()


def test_tasks_grow_with_bytes_and_not_with_files(spark, tmp_path):
    for i in range(300):
        write(tmp_path / f"f{i}.jsonl", b'{"n": 1}\n{"n": 2}\n')
    folder = f"file://{tmp_path}"
    tasks = source.LineReader(folder, ".jsonl", source.RANGE_BYTES).partitions()
    assert len(tasks) == 1 and sum(len(t.ranges) for t in tasks) == 300
    stream = source.AppendReader(folder, ".jsonl", source.RANGE_BYTES)
    assert len(stream.partitions({}, stream.latestOffset())) == 1
    # A file of one range is read once.
    assert [t.ranges for t in source.LineReader(folder, ".jsonl", source.RANGE_BYTES, True).partitions()] == [[]]
    rows = source.scan(spark, folder)
    assert rows.rdd.getNumPartitions() == 1 and rows.count() == 600 and rows.groupBy("source_path").count().where("count = 2").count() == 300
    large = [source.LineRange("a", n, n + source.TASK_BYTES, True) for n in range(3)]
    assert [len(t.ranges) for t in source._tasks(large)] == [1, 1, 1]


def test_sources_are_dealt_out_however_small_their_cursors(spark, tmp_path):
    for i in range(40):
        write(tmp_path / f"f{i}.jsonl", b"{}\n" * 3)
    one = cursor_rows(spark, [(f"file://{tmp_path}/f{i}.jsonl", 0, 0, None) for i in range(40)]).coalesce(1)
    found = source.read_suffixes(one)
    assert found.rdd.getNumPartitions() > 1
    assert found.count() == 120
