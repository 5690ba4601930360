"""Runs of letters and digits of whole Arrow columns, cut by masks of bytes: what ``columns.words`` and ``columns.terms`` give of lower-cased texts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are cut at a time.
SLICE_BYTES = 2 << 20
#: Which bytes belong to a term.
ASCII = np.array([chr(b).isascii() and (chr(b).isdigit() or chr(b).islower()) for b in range(256)])


@cache
def letters() -> np.ndarray:
    """Which code points belong to a word: letters and numbers of any script."""
    return np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)])


def lowered(text: Column) -> Column:
    """Texts as tokens takes them."""
    return F.make_valid_utf8(F.lower(F.coalesce(text, F.lit(""))))


def tokens(texts: pa.Array, kept: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts in order, and of each the place of its text. kept: ASCII or letters()."""
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if len(kept) == 256 or not len(data) or data.max() < 128:
        inside = kept[data]
    else:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        inside = np.repeat(kept[points], 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = ends[:-1][ends[:-1] < ends[1:]]
    first[starts] = inside[starts]
    at = np.flatnonzero(first)
    before = np.cumsum(inside, dtype=np.int32)
    places = np.append(before[at] - 1, before[-1:]).astype(np.int32) if len(at) else np.zeros(1, np.int32)
    found = pa.StringArray.from_buffers(len(at), pa.py_buffer(places), pa.py_buffer(data[inside]))
    return found, np.searchsorted(ends[1:], at, side="right")


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many rows and, if its last column is text, SLICE_BYTES or one row."""
    text = batch.column(batch.num_columns - 1)
    if not pa.types.is_string(text.type):
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))
        return
    total = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        most = int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_BYTES, side="right"))
        end = min(max(most, at + 1), at + rows)
        yield batch.slice(at, end - at)
        at = end
