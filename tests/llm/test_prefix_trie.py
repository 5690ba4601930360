import hashlib
import random
import zlib

import pytest

from tests.oracle import same
from tracelode.llm import prefix_trie
from tracelode.llm.queries import ORACLE_SQL, op12_conversation_prefix_trie

from .helpers import LONG, ascii_words

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The trie by dictionaries of tuples."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for path, of in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(o) == len(p) + 1 and o[: len(p)] == p for o in members)]
        saved = sum((len(members[p]) - 1) * len(ascii_words(p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in of if built[c] == path))
        out.append((min(of), len(path), min(members[path[:-1]]) if path else None, len(of), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    found = df.select(*COLUMNS, "position", "end").collect()
    # Intervals are nested, and a node's own counts the nodes below it.
    assert sorted(x.position for x in found) == list(range(len(found)))
    at = {x.position: x for x in found}
    for x in found:
        assert x.position < x.end
        assert all(at[i].depth > x.depth for i in range(x.position + 1, x.end))
        assert x.end not in at or at[x.end].depth <= x.depth
    return sorted((tuple(x)[:8] for x in found), key=repr)


def some(seed, convs, deepest):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-45, 300), convs):
        for t in range(r.randrange(1, deepest)):
            text = r.choice(["yes", "yes", "no", "so it is", f"{c % 3} of many words"])
            rows.append((c, t if r.random() < 0.9 else None, r.choice(["user", "user", None]), text))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [64, 2])
def test_against_plain_version(spark, width):
    rows = some(width, 60, 12)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(prefix_trie.prefix_trie(docs, width)) == plain(rows)


def test_edges(spark):
    rows = [
        (None, 1, "user", "lost"), (None, None, None, None), (5, None, None, None), (5, None, None, None), (5, 2, "user", LONG), (7, 1, "user", ""), (0, 1, "user", "a"), (0, 1, "assistant", "b"),
        (-3, 1, "user", "a"), (40, None, "user", "one"), (41, 1, "user", "one"), (100, 1, None, "x"), (100, 1, None, "x"), (9_000_000_000_000_000_123, 0, "user", "far"),
    ]
    extra = [(*r, "w", 1, 2, 3, "k", 4) for r in rows]
    docs = spark.createDataFrame(extra, SCHEMA + ", words string, depth long, x long, y long, key string, conv long")
    assert rows_of(prefix_trie.prefix_trie(docs)) == plain(rows)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table(spark, sf):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = op12_conversation_prefix_trie(spark, sf)
    assert sorted(map(tuple, found.select(*COLUMNS).collect()), key=repr) == plain(rows)
    same(found, ORACLE_SQL["op12_conversation_prefix_trie"], sf)
