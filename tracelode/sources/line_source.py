"""Transcript lines as a Python data source, and reads that start at a cursor.

In a batch, files are cut into byte ranges, and a line belongs to the range that holds its
first byte. In a stream, an offset holds for each file the end of its last whole line, so a
batch reads what was appended since and nothing before. A task reads many small ranges, so
tasks grow with bytes and not with files. ``read_suffixes`` does the same for a
table of cursors, which Spark deals out, and goes on with each source's index and prefix hash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

from tracelode.functions.arrow import next_prefix
from tracelode.functions.columns import PREFIX_SEED
from tracelode.sources.transcripts import SESSION_BYTES, SESSION_EVENTS

FORMAT = "transcript_lines"
SCHEMA = "source_path string, range_start long, place long, start long, stop long, line string, event_sha256 string"
RANGE_BYTES = 128 << 20
#: Bytes of the ranges of one task, where a file's opening counts as so many too.
TASK_BYTES, OPEN_BYTES = 32 << 20, 64 << 10
#: What a batch of rows holds at most before it is handed on.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 10_000
#: Files whose last line end the driver looks for at a time.
OPEN_FILES = 32
CHUNK = 1 << 20
BLANK = b" \t\r\x0b\x0c"
SEED = hashlib.sha256(PREFIX_SEED.encode()).hexdigest()
SUFFIX = "source_path string, event_index long, start long, stop long, line string, event_sha256 string, prefix_sha256 string, violation string"


@cache
def _root(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address)


def filesystem(path: str):
    """(file system, its path) of a path or an address that pyarrow can open."""
    from pyarrow import fs

    local = re.match(r"^file:/+", path)
    if local and "%" not in path:
        return _root("file:///")[0], "/" + path[local.end():]
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def size_of(path: str) -> int | None:
    """Bytes of a file, None where there is none."""
    system, name = filesystem(path)
    info = system.get_file_info(name)
    return info.size if info.is_file else None


def lines_between(path: str, start: int, stop: int, aligned: bool, chunk: int = CHUNK) -> Iterator[tuple[int, int, bytes]]:
    """(first byte, byte after its end, line) of the lines whose first byte lies in the range.

    Line ends, and a carriage return before them, are no part of a line; blank lines are left
    out. Where the range starts inside a file at a place that needs be no line's first byte
    (``aligned`` is false), the byte before it is read too. The last line may lack its end.
    """
    system, name = filesystem(path)
    with system.open_input_file(name) as f:
        at = start if aligned or start == 0 else start - 1
        f.seek(at)
        skip, rest = at < start, b""
        while at < stop or rest:
            more = f.read(chunk)
            pieces = (rest + more).split(b"\n")
            rest = pieces.pop()
            for piece in pieces:
                after = at + len(piece) + 1
                if at >= stop:
                    return
                if not skip and piece.strip(BLANK):
                    yield at, after, piece.removesuffix(b"\r")
                skip, at = False, after
            if not more:
                if rest.strip(BLANK) and not skip and at < stop:
                    yield at, at + len(rest), rest.removesuffix(b"\r")
                return


def _text(line: bytes) -> str:
    return line.decode("utf-8", "replace")


@dataclass
class LineRange(InputPartition):
    path: str
    start: int
    stop: int
    aligned: bool


@dataclass
class LineRanges(InputPartition):
    ranges: list[LineRange]


def _batches(rows: Iterator[tuple], line: int, kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows as batches, each of at most so many rows or so many bytes of lines and one line more."""
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    for row in rows:
        held.append(row)
        size += len(row[line] or "")
        if size > BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _read(task: LineRanges) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.string()]
    rows = (
        (part.path, part.start, place, start, stop, _text(line), hashlib.sha256(line).hexdigest())
        for part in task.ranges for place, (start, stop, line) in enumerate(lines_between(part.path, part.start, part.stop, part.aligned)))
    return _batches(rows, names.index("line"), kinds, names)


def _files(folder: str, suffix: str) -> dict[str, int]:
    """Address and size of each file under a folder whose name ends so."""
    from pyarrow import fs

    system, name = filesystem(folder)
    scheme = re.match(r"^([a-z0-9]+):/+(?:(?<=://)[^/]*)?", folder)
    prefix = "file://" if scheme is None or scheme[1] == "file" else folder[: folder.index(name)]
    found = system.get_file_info(fs.FileSelector(name, recursive=True, allow_not_found=True))
    return {prefix + i.path: i.size for i in found if i.is_file and i.path.endswith(suffix)}


def _cut(path: str, start: int, stop: int, size: int, aligned: bool) -> list[LineRange]:
    return [LineRange(path, a, min(a + size, stop), aligned and a == start) for a in range(start, stop, size)]


def _tasks(ranges: list[LineRange]) -> list[LineRanges]:
    """Ranges dealt out to tasks in their order, each of at most TASK_BYTES or one range."""
    out, held = [LineRanges([])], 0
    for r in ranges:
        weight = r.stop - r.start + OPEN_BYTES
        if out[-1].ranges and held + weight > TASK_BYTES:
            out.append(LineRanges([]))
            held = 0
        out[-1].ranges.append(r)
        held += weight
    return out


class LineReader(DataSourceReader):
    """All lines under a folder, by byte ranges; with ``cut`` only those of files of several ranges."""

    def __init__(self, folder: str, suffix: str, size: int, cut: bool = False):
        self.folder, self.suffix, self.size, self.cut = folder, suffix, size, cut

    def partitions(self):
        files = _files(self.folder, self.suffix)
        return _tasks([r for path, n in sorted(files.items()) if n > self.size or not self.cut for r in _cut(path, 0, n, self.size, True)])

    def read(self, partition):
        return _read(partition)


class AppendReader(DataSourceStreamReader):
    """What was appended to files under a folder since the last batch, whole lines only.

    An offset has an entry for each file. A file that is shorter than it was, or gone, fails the stream.
    """

    def __init__(self, folder: str, suffix: str, size: int):
        self.folder, self.suffix, self.size = folder, suffix, size
        self.seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files = _files(self.folder, self.suffix)
        changed = [(path, self.seen.get(path, (0, 0))[1], n) for path, n in files.items() if n != self.seen.get(path, (0, 0))[0]]
        with ThreadPoolExecutor(OPEN_FILES) as pool:
            ends = pool.map(lambda x: self._last_end(*x) if x[2] > x[1] else x[2], changed)
            self.seen.update({path: (n, end) for (path, _, n), end in zip(changed, ends, strict=True)})
        return {path: self.seen.get(path, (0, 0))[1] for path in files}

    def _last_end(self, path: str, low: int, high: int) -> int:
        """The byte after the last line end in a range, read backwards; low where there is none."""
        system, name = filesystem(path)
        with system.open_input_file(name) as f:
            while high > low:
                at = max(low, high - (1 << 16))
                f.seek(at)
                found = f.read(high - at).rfind(b"\n")
                if found >= 0:
                    return at + found + 1
                high = at
        return low

    def partitions(self, start: dict, end: dict):
        out = []
        for path in sorted({*start, *end}):
            a, b = start.get(path, 0), end.get(path, 0)
            if b < a:
                raise ValueError(f"source_truncated: {path} has {b} bytes of lines, {a} were read")
            out += _cut(path, a, b, self.size, True)
        return _tasks(out)

    def read(self, partition):
        return _read(partition)


class TranscriptLines(DataSource):
    """Options: path (a folder), suffix (of file names, .jsonl), rangeBytes, cut (in a batch: only files of several ranges)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _arguments(self):
        return self.options["path"], self.options.get("suffix", ".jsonl"), int(self.options.get("rangeBytes", RANGE_BYTES))

    def reader(self, schema):
        return LineReader(*self._arguments(), self.options.get("cut", "false") == "true")

    def streamReader(self, schema):
        return AppendReader(*self._arguments())


def scan(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of all transcripts under a folder: source_path, event_index, start, stop, line, event_sha256.

    A line's index is its place in its range and the lines of the file's ranges before. Only
    files of several ranges are read twice, to count these.
    """
    spark.dataSource.register(TranscriptLines)
    source = spark.read.format(FORMAT).option("rangeBytes", range_bytes)
    rows, cut = source.load(folder), source.option("cut", "true").load(folder)
    counts = cut.groupBy("source_path", "range_start").agg(F.count("*").alias("n"))
    # A file has a range for each so many bytes.
    before = Window.partitionBy("source_path").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("source_path", "range_start", F.sum("n").over(before).alias("first")).where("first is not null")
    return rows.join(firsts, ["source_path", "range_start"], "left").select("source_path", (F.coalesce("first", F.lit(0)) + F.col("place")).alias("event_index"), "start", "stop", "line", "event_sha256")


def appended(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of lines as they are appended under a folder: source_path, start, stop, line, event_sha256."""
    spark.dataSource.register(TranscriptLines)
    return spark.readStream.format(FORMAT).load(folder).select("source_path", "start", "stop", "line", "event_sha256")


def read_suffixes(cursors: DataFrame, most_bytes: int = SESSION_BYTES, most_events: int = SESSION_EVENTS) -> DataFrame:
    """The lines after each source's cursor, with no byte before it read.

    cursors: source_path, byte, event_index (lines before), prefix_sha256; zero, zero and null for
    a new source. prefix_sha256 of a row is the chain with its line, so the last row is the next
    cursor. A source that is gone or shorter than its cursor gives one row with the violation
    ``truncated``; one beyond the limits, counted from its start, one of ``session_too_large``
    or ``too_many_events``. A last line without its end is left for the next read.
    """
    names = [x.split()[0] for x in SUFFIX.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 3, *[pa.string()] * 4]

    def rows_of(path, byte, index, prefix):
        size = size_of(path)
        fault = "truncated" if size is None or size < byte else "session_too_large" if size > most_bytes else None
        found, chain = [], bytes.fromhex(prefix or SEED)
        if fault is None:
            for start, stop, line in lines_between(path, byte, size, True):
                if stop - start == len(line):
                    break
                if index + len(found) >= most_events:
                    fault, found = "too_many_events", []
                    break
                digest = hashlib.sha256(line).hexdigest()
                chain = next_prefix(chain, digest)
                found.append((path, index + len(found), start, stop, _text(line), digest, chain.hex(), None))
        return [(path, index, byte, byte, None, None, prefix, fault)] if fault else found

    def read(batches):
        # One source at a time, which the limits bound.
        rows = (found for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for found in rows_of(*row))
        return _batches(rows, names.index("line"), kinds, names)

    known = cursors.select("source_path", F.col("byte").cast("long"), F.col("event_index").cast("long"), "prefix_sha256")
    # A cursor is few bytes, what is read for it many: cursors are dealt out by their number.
    return known.repartition(4 * cursors.sparkSession.sparkContext.defaultParallelism).mapInArrow(read, SUFFIX)


def next_cursors(suffixes: DataFrame) -> DataFrame:
    """The cursor after each source's last line read: source_path, byte, event_index, prefix_sha256."""
    last = suffixes.where("violation is null").groupBy("source_path").agg(F.max(F.struct(F.col("stop").alias("byte"), (F.col("event_index") + 1).alias("event_index"), "prefix_sha256")).alias("c"))
    return last.select("source_path", "c.*")


def write_files(sessions: DataFrame) -> int:
    """Writes (source_path, content) as files of those addresses, each by the task that has it, over what is there; gives their number."""
    def write(batches):
        for batch in batches:
            done, made = 0, set()
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = filesystem(path)
                folder = name.rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(name) as f:
                    f.write(content)
                done += 1
            yield pa.RecordBatch.from_pydict({"n": [done]})

    return sessions.select("source_path", "content").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
