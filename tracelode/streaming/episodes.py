"""Incremental import with Structured Streaming: open episodes, pending calls and waiting rows as state of a session."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tracelode.functions.arrow import next_prefix
from tracelode.functions.columns import PREFIX_SEED
from tracelode.functions.tables import stored
from tracelode.operators.traces import is_signal
from tracelode.sources.lake import exists

#: Control rows have this kind; their role is the boundary that closes the open episode.
CONTROL = "control"
CLOSED = "session_id string, start_index long, end_index long, boundary_kind string, continues_from long, n_events long, prefix_sha256 string, pending_calls array<string>"
#: Value state: start of the open episode (-1: none), start of the last closed one (-1: none), events since the start, next index, prefix, link of the open episode, calls so far, entries of the two maps.
STATE = "open long, closed long, n long, next long, prefix string, link long, calls long, pending long, waiting long"
#: The waiting rows of so many indexes are one entry of the state, as JSON: (event_index, is_event, block, what, boundary, sha, called, answered) of each, in order.
AHEAD = 64
#: Pending calls are read in one request while they are at most so many.
AT_ONCE = 256
#: Fields that only some sources have; what is missing counts as null.
OPTIONAL = {"block": "int", "tool_name": "string", "call_id": "string", "tool_status": "string", "exit_code": "int"}
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Entries:
    """A map of a session's state as a batch meets it: an entry is read once, when it is asked for, and written once, at the end, if it changed.

    size is the number of entries, from the last batch on, so an empty map is never read.
    """

    def __init__(self, state, size: int, at_once: int = 0):
        self._state, self.size, self._at_once = state, size, at_once
        self._stored: dict = {}
        self._now: dict = {}
        self._known: set = set()
        self._whole = size == 0

    def get(self, key):
        if not self._whole and key not in self._known:
            if len(self._known) == 0 and self.size <= self._at_once:
                self.all()
            else:
                self._known.add(key)
                found = self._state.getValue((key,))
                if found is not None:
                    self._stored[key] = self._now[key] = found[0]
        return self._now.get(key)

    def put(self, key, value) -> None:
        self.size += self.get(key) is None
        self._now[key] = value

    def take(self, key):
        """The entry, which is there no more."""
        found = self.get(key)
        if found is not None:
            del self._now[key]
            self.size -= 1
        return found

    def all(self) -> dict:
        """All entries; for reading only."""
        if not self._whole:
            for (key,), (value,) in self._state.iterator():
                if key not in self._known:
                    self._stored[key] = self._now[key] = value
            self._whole = True
        return self._now

    def write(self) -> None:
        for key, value in self._now.items():
            if self._stored.get(key) != value:
                self._state.updateValue((key,), (value,))
        for key in self._stored.keys() - self._now.keys():
            self._state.removeKey((key,))


class EpisodeProcessor(StatefulProcessor):
    """Folds a session's rows in the order of their indexes.

    One value holds the open episode. Calls without a result are a map by call id, rows that are
    ahead of the next index a map by ranges of indexes, so a batch reads and writes only the entries
    that it meets, however many wait, and each in one request.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._session = handle.getValueState("session", STATE)
        self._pending = handle.getMapState("pending", "call_id string", "place long")
        self._waiting = handle.getMapState("waiting", "range long", "rows string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        state = self._session.get() or (-1, -1, 0, 0, hashlib.sha256(PREFIX_SEED.encode()).hexdigest(), -1, 0, 0, 0)
        start, closed, n, following, prefix, link, calls, n_pending, n_waiting = state
        pending, waiting = Entries(self._pending, n_pending, AT_ONCE), Entries(self._waiting, n_waiting)
        digest, first, reached, out = bytes.fromhex(prefix), following, -1, []
        # By index, each row once, however often it was delivered.
        came: dict[int, set[tuple]] = {}
        for _, index, *row in rows:
            if not row[0] or index >= following:
                came.setdefault(index, set()).add(tuple(row))

        def close(end, boundary):
            left = [c for _, c in sorted((place, call) for call, place in pending.all().items())]
            out.append(Row(session_id=key[0], start_index=start, end_index=end, boundary_kind=boundary, continues_from=None if link < 0 else link, n_events=n, prefix_sha256=digest.hex(), pending_calls=left))

        late = iter(sorted(i for i in came if i < first))
        while True:
            # Controls of indexes that were folded before come first, then one index after another.
            index = next(late, following)
            if index >= first and index // AHEAD != reached:
                reached = index // AHEAD
                for i, *row in json.loads(waiting.take(reached) or "[]"):
                    came.setdefault(i, set()).add(tuple(row))
            group = came.pop(index, set())
            folded = False
            for is_event, _, what, boundary, sha, called, answered in sorted(group):
                if not is_event:
                    if 0 <= start < index:
                        close(following, boundary)
                        closed, start, n, link = start, -1, 0, -1
                    continue
                if what == "user":
                    if start >= 0:
                        close(index, "next_user")
                        closed = start
                    start, n, link = index, 0, -1
                elif what == "signal" and start < 0 <= closed:
                    start, n, link = index, 0, closed
                n += start >= 0
                if called and pending.get(called) is None:
                    pending.put(called, calls)
                    calls += 1
                if answered:
                    pending.take(answered)
                folded, last = True, sha
            if folded:
                digest, following = next_prefix(digest, last), index + 1
            elif index == following:
                break
        ahead: dict[int, set[tuple]] = {}
        for index, group in came.items():
            ahead.setdefault(index // AHEAD, set()).update((index, *row) for row in group)
        for at, some in ahead.items():
            waiting.put(at, json.dumps(sorted(some.union(map(tuple, json.loads(waiting.get(at) or "[]"))))))
        pending.write()
        waiting.write()
        self._session.update((start, closed, n, following, digest.hex(), link, calls, pending.size, waiting.size))
        yield from out


def distinct_in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a batch once: what is delivered often is mostly delivered together, and is thinned out before it is shuffled."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        yield from table.group_by(table.column_names).aggregate([]).select(table.column_names).combine_chunks().to_batches()


def close_episodes(events: DataFrame) -> DataFrame:
    """Closed episodes of a stream of events (session_id, event_index, kind, role, text, event_sha256; see OPTIONAL for more).

    A user message closes the open episode; a control row closes it by its boundary, before the
    event of its index. What comes after a close without a user message opens a continuation of
    the closed one at the first signal (see ``is_signal``), so late events never rewrite what was emitted.

    Indexes of a session are dense from 0, over all its records; those that are no events come as
    metadata. A row whose index is ahead of the next one waits in the state until the gap is
    filled, in whatever batch, so a file that comes late loses nothing. An event whose index was
    folded already is dropped, and a control row that lies at or before the open episode's start closes
    nothing, so delivery may repeat. A control row that comes first when later events are folded
    closes the episode at the session's present end. Blocks of one record come in one batch. pending_calls are the calls
    that had no result when the episode closed; a result after that still settles them.

    Map states need RocksDB as the state store, which is set on the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    for name, kind in OPTIONAL.items():
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    user = (F.col("kind") == "message") & (F.col("role") == "user")
    known = F.coalesce("call_id", F.lit(""))
    rows = events.where("session_id is not null and event_index is not null").select(
        "session_id", F.col("event_index").cast("long").alias("event_index"), F.when(F.col("kind") == CONTROL, 0).otherwise(1).alias("is_event"), F.coalesce("block", F.lit(0)).alias("block"),
        F.when(F.coalesce(user, F.lit(False)), "user").when(is_signal(), "signal").otherwise("other").alias("what"), F.coalesce("role", F.lit("")).alias("boundary"), F.coalesce("event_sha256", F.lit("")).alias("sha"),
        F.when(F.col("kind") == "tool_call", known).otherwise("").alias("called"), F.when(F.col("kind") == "tool_result", known).otherwise("").alias("answered"))
    rows = rows.mapInArrow(distinct_in_batches, rows.schema)
    return rows.groupBy("session_id").transformWithState(EpisodeProcessor(), CLOSED, "append", "None")


def start_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream into a Parquet table until its input is read. A batch's files enter the table's log once, by the batch's number, so a batch that is delivered again changes nothing and reads nothing of the table."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_prefix(current: DataFrame, committed: DataFrame) -> DataFrame:
    """Sessions whose committed prefix isn't what the source holds now, to set aside: session_id, expected, found."""
    rows = committed.select("session_id", F.col("prefix_sha256").alias("expected")).join(current.select("session_id", F.col("prefix_sha256").alias("found")), "session_id")
    return rows.where("expected <> found")


def index_batches(path: str, project):
    """A foreachBatch sink that keeps an index of projected documents: a batch's memories replace theirs in the touched partitions."""
    from tracelode.sources.lake import replace_partitions, upserted

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        documents = project(batch)
        if exists(spark, path):
            touched = documents.select("repo_key").distinct()
            current = spark.read.parquet(path).join(touched, "repo_key", "left_semi").select(*documents.columns)
            # What is read must not be what is overwritten.
            documents = stored(upserted(current, documents), "index")
        replace_partitions(documents, path)

    return write


_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType()}
_NEEDED = {"session_id": "string", "event_index": "long", "kind": "string", "role": "string", "text": "string", "event_sha256": "string"}
EVENT_SCHEMA = T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in {**_NEEDED, **OPTIONAL}.items()])
