"""Packing documents into training sequences by vector bin packing.

A document is an example: its prompt, up to the first blank line or role mark (or its first
sentence), and the response after it, whose tokens bear loss. A piece takes up three resources
of a sequence: tokens, one segment, and loss-bearing tokens. A sequence is filled with the piece
whose demand has the greatest dot product with what the sequence has left (each resource weighed
by its mean demand), until none fits.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.encode import encoder, tokenizer_path, trim
from tracelode.llm.texthash import raw

TOKENS = 2048
SEGMENTS = 1024
#: A sequence full of responses alone would exceed this; it leaves less room than is worth a cut.
LOSS = 2016
END = 1
#: Room of at least so many tokens that no piece fits into is filled by cutting one.
CUT = 32
GROUP_TOKENS = 1 << 21

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


#: The prompt ends after the first blank line or role mark, else after the first sentence or line.
_RESPONSE = re.compile(rb"\n(?:[ \t\r]*\n|[ \t#*]*(?:assistant|response|answer|output)[ \t*]*:(?=\s|\Z))", re.I)
_SENTENCE = re.compile(rb"[.!?]\s|\n")


def prompt(text: bytes) -> bytes:
    """The start of a text that bears no loss; it ends at white space, so its ids are the text's first ids."""
    m = _RESPONSE.search(text) or _SENTENCE.search(text)
    return text[: m.end()] if m else b""


def fill(lengths: list[int], limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS), cut: int = CUT, prompts: list[int] | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length): every item's tokens, each once, inside the limits.

    prompts: how many first tokens of each item bear no loss; a piece's first token never does.
    Items beyond a limit are cut into the longest pieces inside it and a rest. Pieces of one
    length and loss are alike, so only distinct pairs are weighed.
    """
    # Kinds in the order of length, then loss, so the pieces that fit by length are the first ones.
    pieces: dict[tuple[int, int], list[tuple[int, int, int]]] = {}  # item, start, tokens without loss
    for item, length in enumerate(lengths):
        start, lead = 0, max(prompts[item] if prompts else 0, 1)
        while length - start > (part := min(limits[0], lead + limits[2])):
            pieces.setdefault((part, max(0, part - lead)), []).append((item, start, lead))
            start, lead = start + part, max(lead - part, 1)
        pieces.setdefault((length - start, max(0, length - start - lead)), []).append((item, start, lead))
    kinds = sorted(pieces)
    long, loss = (np.array([x[i] for x in kinds], float) for i in range(2))
    have = np.array([len(pieces[x]) for x in kinds], float)
    left = int(have.sum())
    # Weights of a token, a segment and a loss-bearing token.
    per = [float(x @ have) / max(left, 1) / limits[r] ** 2 for r, x in enumerate((long, np.ones_like(long), loss))]
    gone = np.zeros(len(kinds))
    spent = 0
    out = []

    def take(k: int) -> tuple[int, int, int]:
        nonlocal spent
        own = pieces[kinds[k]]
        if len(own) == 1:
            gone[k] = -np.inf
            spent += 1
        return own.pop()

    while left:
        if 2 * spent > len(kinds):
            stay = np.flatnonzero(gone == 0)
            kinds, long, loss, gone, spent = [kinds[k] for k in stay], long[stay], loss[stay], np.zeros(len(stay)), 0
        room, segments, bear, placed = limits[0], limits[1], limits[2], []
        while left and segments:
            n = int(np.searchsorted(long, room, "right"))
            if n:
                value = long[:n] * (per[0] * room / limits[0]) + loss[:n] * (per[2] * bear / limits[2] if limits[2] else 0.0) + gone[:n]
                value[loss[:n] > bear] = -np.inf
                k = int(value.argmax())
            if n and value[k] >= 0:
                part, lost = kinds[k]
                item, start, _ = take(k)
                left -= 1
            else:
                # Nothing fits as a whole: the piece with the longest start that fits is cut; of several the longest, then that of most loss.
                starts = np.minimum(room, np.where(loss > 0, long - loss, long) + bear) + gone
                k = int(np.flatnonzero(starts == starts.max())[-1])
                part = int(starts[k]) if np.isfinite(starts[k]) else 0
                if part < cut or part >= long[k]:
                    break
                length = kinds[k][0]
                item, start, lead = take(k)
                lost = max(0, part - lead)
                lead = max(lead - part, 1)
                rest = (length - part, max(0, length - part - lead))
                own = pieces.setdefault(rest, [])
                own.append((item, start + part, lead))
                at = bisect.bisect_left(kinds, rest)
                if at == len(kinds) or kinds[at] != rest:
                    kinds.insert(at, rest)
                    long, loss, gone = np.insert(long, at, rest[0]), np.insert(loss, at, rest[1]), np.insert(gone, at, 0.0)
                elif len(own) == 1:
                    gone[at] = 0.0
                    spent -= 1
            placed.append((item, start, part))
            room, segments, bear = room - part, segments - 1, bear - lost
        out.append(placed)
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end: int = END, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS), with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, and its ids on demand.

    Takes columns doc_id and text; others are ignored, whatever their names. Null and empty texts
    are the end id alone. loss_tokens counts a piece's ids after its document's prompt and after
    the piece's own first. A text without blank line, role mark, line end or sentence end is all response. Repeated rows and null ids are documents each. Each task packs the
    documents that it reads, some GROUP_TOKENS at a time, and hands the last sequence's
    pieces on to the next group, so no row is shuffled and memory is bounded; a task leaves
    one sequence that may be short. Ids of sequences are unique over tasks. An empty table gives no rows.
    """
    path = tokenizer_path("word_bpe_49k.json", tokenizer)
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trim()
        sequence = TaskContext.get().partitionId() << 32
        encode = encoder(path, words=True)
        tail = np.array([end], "<u4").tobytes()
        held: list[tuple[int | None, int, int, bytes, int]] = []  # id, ids before, ids of the document, ids, those of them in the prompt
        size = 0

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal held, size, sequence
            sequences = fill([len(x[3]) // 4 for x in held], limits, prompts=[x[4] for x in held])
            keep = [] if last or not sequences else sequences.pop()
            rows = []
            for placed in sequences:
                offset = 0
                for item, start, length in placed:
                    doc, before, total, ids, lead = held[item]
                    piece = ids[4 * start : 4 * (start + length)]
                    row = (doc, before + start, length, zlib.crc32(piece), total, sequence, offset, max(0, start + length - max(lead, start + 1)))
                    rows.append((*row, np.frombuffer(piece, "<u4").astype(np.int32)) if with_ids else row)
                    offset += length
                sequence += 1
            held = [(held[i][0], held[i][1] + start, held[i][2], held[i][3][4 * start : 4 * (start + length)], max(held[i][4] - start, 0)) for i, start, length in keep]
            size = sum(len(x[3]) // 4 for x in held)
            if not rows:
                return None
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[:8]] + [pa.array(c, pa.list_(pa.int32())) for c in columns[8:]]
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            data, at = raw(batch.column(1))
            for i in range(0, batch.num_rows, 64):
                until = min(i + 64, batch.num_rows)
                texts = [data[at[j] : at[j + 1]].tobytes() for j in range(i, until)]
                leads = encode.ids([prompt(t) for t in texts])
                for doc, ids, lead in zip(batch.column(0)[i:until].to_pylist(), encode.ids(texts), leads, strict=True):
                    ids += tail
                    held.append((doc, 0, len(ids) // 4, ids, len(lead) // 4))
                    size += len(ids) // 4
                if size >= GROUP_TOKENS and (out := flush(False)):
                    yield out
        if held and (out := flush(True)):
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, schema)
