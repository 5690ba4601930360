"""Token ids of whole texts by the tokenizers library, one call for each distinct chunk.

Both vocabularies split a text into pieces before they merge, and no piece goes across certain
blanks, so a text's ids are those of its chunks in order. Each worker keeps the ids of chunks
that it has met; the whole text's ids are the same as from one call.
"""

from __future__ import annotations

import re
from array import array

KEPT = 600_000
SLICE = 1 << 20
MARKS = b".,;:!?"
#: Byte-level vocabularies write each byte as a character: printable Latin-1 as itself, the others from U+0100 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_SAFE = re.compile(rb"[0-9A-Za-z](?= [0-9A-Za-z])")
_LONE_BLANK = re.compile(r"(?<=\S)(?= \S)")


def slices(data: bytes):
    """Parts of a text of about SLICE bytes, cut before a blank between letters or digits."""
    at = 0
    while len(data) - at > SLICE:
        m = _SAFE.search(data, at + SLICE)
        if m is None:
            break
        yield data[at : m.end()]
        at = m.end()
    yield data[at:] if at else data


class Known(dict):
    """Chunks met of late and their ids. When full, it keeps one generation: what was met since it was last full."""

    def __init__(self):
        super().__init__()
        self.old: dict[bytes, bytes | None] = {}

    def missing(self, chunks: set[bytes]) -> list[bytes]:
        new = [c for c in chunks if c not in self]
        if len(self) + len(new) > KEPT and self:
            self.old = dict(self)
            self.clear()
            new = chunks
        out = []
        for c in new:
            if c in self.old:
                self[c] = self.old[c]
            else:
                out.append(c)
        return out


class Encoder:
    """ids(texts): each text's ids as little-endian unsigned 32-bit integers.

    words=True: white space is no part of any piece, so texts are cut at all ASCII white
    space. Otherwise texts are cut at line ends, and before blanks that stand alone between
    other characters, which belong to the piece after them. A chunk's marks after a letter are pieces of
    their own in either vocabulary.
    """

    def __init__(self, path: str, words: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), words
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.inner, self.first = Known(), Known()
        self.line_end = b"" if words else self._encode(["\n"])[0]

    def _encode(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _piece(self, chunk: bytes) -> str | None:
        """The chunk in the model's byte characters if it is letters alone, which are one piece; else None.

        Where the vocabulary is of lower case and composed characters, only letters below
        U+0250 are taken, whose composed form is themselves and whose case doesn't depend on others.
        """
        if chunk.isalpha():
            return chunk.lower().decode("ascii") if self.words else chunk.decode("ascii")
        text = chunk.decode("utf-8")
        if not text.isalpha():
            return None
        if self.words:
            if max(text) >= "\u0250" or "\u0130" in text:
                return None
            chunk = text.lower().encode("utf-8")
        return chunk.decode("latin-1").translate(BYTE_CHARACTERS)

    def _learn(self, chunks: set[bytes], lead: str, into: Known) -> None:
        """Adds the chunks' ids after lead; None for a chunk that can't be cut off where it was."""
        start = lead.translate(BYTE_CHARACTERS)
        merge = self.tokenizer.model.tokenize
        others, marked = [], []
        for c in into.missing(chunks):
            core = c.rstrip(MARKS)
            if len(core) != len(c) and core[-1:].isalnum():
                marked.append((c, core))
                if core in into:
                    continue
            else:
                core = c
            piece = self._piece(core)
            if piece is None:
                others.append(core)
            else:
                into[core] = array("I", [t.id for t in merge(start + piece)]).tobytes()
        text = [c.decode("utf-8") for c in others]
        if not self.words:
            plain = [bool(t) and not t[0].isspace() and not t[-1].isspace() for t in text]
            into.update((c, None) for c, p in zip(others, plain, strict=True) if not p)
            others, text = [c for c, p in zip(others, plain, strict=True) if p], [t for t, p in zip(text, plain, strict=True) if p]
        into.update(zip(others, self._encode([lead + t for t in text] if lead else text), strict=True))
        for c, core in marked:
            into[c] = None if into[core] is None else into[core] + self._marks(c[len(core) :])

    def _marks(self, marks: bytes) -> bytes:
        if marks not in self.first:
            self.first[marks] = self._encode([marks.decode("utf-8")])[0]
        return self.first[marks]

    def _careful(self, data: bytes) -> bytes:
        return b"".join(self._encode(_LONE_BLANK.split(data.decode("utf-8"))))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        if any(len(t) > 2 * SLICE for t in texts):
            return [b"".join(x for part in slices(t) for x in self._short([part])) for t in texts]
        out, some, size = [], [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size > SLICE:
                out += self._short(some)
                some, size = [], 0
        return out + self._short(some)

    def _short(self, texts: list[bytes]) -> list[bytes]:
        if self.words:
            parts = [t.split() for t in texts]
            self._learn(set().union(*parts), "", self.first)
            known = self.first
            return [b"".join([known[p] for p in row]) for row in parts]
        # Of each text its lines, of each line its chunks. A slice of a longer text starts with a blank.
        texts_lines = [[line.split(b" ") for line in t.split(b"\n")] for t in texts]
        leads = [[line.pop(0) for line in lines] for lines in texts_lines]
        self._learn(set().union(*(line for lines in texts_lines for line in lines)), " ", self.inner)
        self._learn(set().union(*leads), "", self.first)
        inner, first, out = self.inner, self.first, []
        for text, lines, lead in zip(texts, texts_lines, leads, strict=True):
            try:
                start = [b"" if not lead[0] else first[lead[0]], *[first[x] for x in lead[1:]]]
                out.append(self.line_end.join([begin + b"".join([inner[p] for p in line]) for begin, line in zip(start, lines, strict=True)]))
            except TypeError:  # a chunk whose place matters
                out.append(self._careful(text))
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, words: bool) -> Encoder:
    """This worker's encoder, which stays between tasks."""
    if (path, words) not in _encoders:
        _encoders[path, words] = Encoder(path, words)
    return _encoders[path, words]


def trim() -> None:
    """Returns memory that earlier steps of this worker freed to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def release() -> None:
    """Gives up what this worker's encoders keep: for steps that need the memory and no ids."""
    for e in _encoders.values():
        for known in (e.inner, e.first):
            known.clear()
            known.old = {}
    trim()


def tokenizer_path(name: str, path: str | None = None) -> str:
    """Where a vocabulary file is: as given, or that of the installed public tokenizers."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)
