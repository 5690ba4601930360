"""The prefix trie of conversations in preorder intervals.

A node is a distinct sequence of first turns. Nodes are ranked so that each stands before its
continuations and these stand together; a second entry, right after them, is the end of its
subtree. Leaves and savings below a node are then differences of prefix sums at its two
entries, which are taken over sorted ranges of all entries.

Sort keys are bounded however long a conversation is: turns are cut into blocks of ``WIDTH``,
and where there are several, a block's turns stand in the key as the rank of their sequence.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelode.llm.common import joined, numbered, spread, stored, stored_result, sums_before
from tracelode.llm.mixing import word_count

GROUP = 20
HEADS = 4
WIDTH = 64
#: Decimal ids that are joined before they meet those of other ranges.
IDS_A_CHUNK = 20_000
NOTHING = hashlib.sha256().hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, place, digest, words) of each turn: its place in its conversation from 0, a digest of role and text, its words.

    Order: turn, nulls first, then the digest of role and text where turns tie. Places are
    global ranks less the conversation's first, so no conversation is one task's.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), word_count(text).alias("words"))
    rows = stored(numbered(rows, "conv", F.col("turn").asc_nulls_first(), "digest", rank="g"), "turns")
    first = rows.groupBy("conv").agg(F.min("g").alias("first"), F.count("*").alias("n"))
    return joined(rows, first, ["conv"], "n").select("conv", (F.col("g") - F.col("first")).alias("place"), "digest", "words")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, length) and their turns (conv, depth from 1, digest, words, last), each begun with the first h turns of its group's first conversation.

    h: the crc32 of the decimal id, modulo 4. A base has at most 39 conversations and three turns to lend.
    """
    conv, head = F.col("conv"), F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    sizes = rows.groupBy("conv").agg(F.count("*").alias("own"))
    sizes = stored(sizes.select("conv", "own", head.alias("h"), (conv - conv % GROUP).alias("base")), "sizes")
    bases = sizes.select(F.col("conv").alias("base"), F.least("own", F.lit(HEADS - 1)).alias("has"))
    plan = sizes.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("has", F.lit(0))))
    plan = stored(plan.select("conv", "base", "own", "h", "lent", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "plan")
    kept = joined(rows, plan.select("conv", "own", "h", "lent", "length"), ["conv"], "own").where("place >= h")
    kept = kept.withColumn("depth", F.col("place") - F.col("h") + F.col("lent") + 1)
    heads = rows.where(F.col("place") < HEADS - 1).withColumnRenamed("conv", "base").join(plan.select("conv", "base", "lent", "length"), "base").where("place < lent")
    heads = heads.withColumn("depth", F.col("place") + 1)
    return plan.select("conv", "length"), kept.drop("own").unionByName(heads, allowMissingColumns=True).select("conv", "depth", "digest", "words", (F.col("depth") == F.col("length")).alias("last"))


def _item(rank: Column) -> Column:
    """A rank as an item of keys: nine bytes, in order, the first one zero."""
    return F.unhex(F.lpad(F.hex(rank.cast("long")), 18, "0"))


def _running(block: list[Column], item: Column) -> Column:
    """The items of a block's rows up to each one, at most as many as a block has, as one binary."""
    window = Window.partitionBy(*block).orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.unhex(F.array_join(F.transform(F.collect_list(item).over(window), F.hex), ""))


def ordered(rows: DataFrame, deepest: int, width: int = WIDTH) -> DataFrame:
    """Adds key and close, binaries by which nodes come in preorder: the keys of all continuations of a node, and of no other, lie between its own two.

    The first level's key is the block's turns so far. At each further level a block of width
    blocks is described by the ranks of its whole blocks and the rank inside the current one;
    so levels are the logarithm of the longest conversation, to the base width. A key's items
    have one length and start with a zero byte, so a one comes after all continuations; where
    these may stand under other ranks, the last such rank is in close.
    """
    rows = rows.withColumn("item", F.unhex(F.concat(F.lit("00"), "digest")))
    size, after = 1, F.lit(b"\x01")
    while True:
        span = size * width
        block = F.floor((F.col("depth") - 1) / span).cast("long")
        if size == 1:
            rows = rows.withColumn("key", _running([F.col("conv"), block], F.col("item"))).withColumn("close", F.concat("key", after))
        else:
            ends = rows.where(F.col("depth") % size == 0).select("conv", F.col("depth").alias("end"), _running([F.col("conv"), block], F.col("item")).alias("before"))
            inner = F.floor((F.col("depth") - 1) / size).cast("long")
            rows = rows.withColumn("end", F.when(inner % width != 0, inner * size)).join(ends, ["conv", "end"], "left")
            before = F.coalesce("before", F.lit(b""))
            rows = rows.withColumn("key", F.concat(before, "item")).withColumn("close", F.concat(before, "last_item", after)).drop("end", "before", "last_item")
        if span >= deepest:
            return rows.drop("item")
        rows = stored(rows, "level")
        distinct = rows.groupBy("key", "close").agg(F.count("*").alias("times"))
        entries = distinct.select("key", "times", F.col("key").alias("at"), F.lit(1).alias("opens")).unionByName(distinct.select("key", "times", F.col("close").alias("at"), F.lit(0).alias("opens")))
        ranks = sums_before(entries, [F.col("at")], before=F.col("opens")).groupBy("key", "times").agg(_item(F.min("before")).alias("item"), _item(F.max("before") - 1).alias("last_item"))
        rows = joined(rows.drop("item", "close"), stored(ranks, "ranks"), ["key"], "times").drop("key")
        size = span


def identified(rows: DataFrame) -> DataFrame:
    """Adds the node's identity (x, y) and its parent's (p, q): 128 bits of all turns so far, as running exclusive ors of a hash of turn and depth.

    They are taken over blocks and then over a conversation's blocks, so no conversation is one task's.
    """
    block = F.floor((F.col("depth") - 1) / 4096).cast("long")
    rows = rows.withColumn("block", block).withColumn("t", F.xxhash64("digest", "depth")).withColumn("u", F.xxhash64("depth", "digest", F.lit(1)))
    whole = rows.groupBy("conv", "block").agg(F.bit_xor("t").alias("bt"), F.bit_xor("u").alias("bu"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begin = whole.select("conv", "block", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("bt", "bu"))).where("block > 0")
    so_far = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("x", F.bit_xor("t").over(so_far)).withColumn("y", F.bit_xor("u").over(so_far)).join(begin, ["conv", "block"], "left")
    rows = rows.withColumn("x", F.col("x").bitwiseXOR(F.coalesce("bt", F.lit(0)))).withColumn("y", F.col("y").bitwiseXOR(F.coalesce("bu", F.lit(0))))
    return rows.withColumn("p", F.col("x").bitwiseXOR(F.col("t"))).withColumn("q", F.col("y").bitwiseXOR(F.col("u"))).drop("block", "t", "u", "bt", "bu")


def ends_digest(ends: DataFrame) -> DataFrame:
    """(x, y, ends_sha256) from (x, y, conv): the SHA-256 of a node's conversations, ascending, decimal and joined by commas.

    Ids are sorted by ranges and joined to chunks there; a digest is a chain, so one task reads a
    node's chunks in order, one at a time.
    """
    def chunks(batches):
        node, first, ids = None, 0, []
        for batch in batches:
            for x, y, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (x, y) != node or len(ids) >= IDS_A_CHUNK:
                    if ids:
                        yield chunk(node, first, ids)
                    node, first, ids = (x, y), conv, []
                ids.append(str(conv))
        if ids:
            yield chunk(node, first, ids)

    def chunk(node, first, ids):
        return pa.RecordBatch.from_pydict({"x": [node[0]], "y": [node[1]], "first": [first], "ids": [",".join(ids)]})

    def digests(batches):
        node, digest = None, None
        for batch in batches:
            done = []
            for x, y, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (x, y) != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (x, y), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if done:
                yield result(done)
        if node is not None:
            yield result([(*node, digest.hexdigest())])

    def result(done):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["x", "y", "ends_sha256"])

    cut = spread(ends.select("x", "y", "conv"), "x", "y", "conv").mapInArrow(chunks, "x long, y long, first long, ids string")
    return cut.repartition("x", "y").sortWithinPartitions("x", "y", "first").mapInArrow(digests, "x long, y long, ends_sha256 string")


@stored_result("trie")
def prefix_trie(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and its interval: position and end, counted in nodes in preorder.

    Takes columns conv_id, turn, role and text; others are ignored, whatever their names.
    Conversations are ordered and rebuilt as in ``turns`` and ``rebuilt``. Null roles and texts
    are empty; rows without conv_id take no part; repeated rows are turns each; turns that tie
    stand in the order of a digest of role and text. A conversation without turns left is a
    member of the root. An empty table has no nodes.
    """
    convs, rows = rebuilt(stored(turns(conversations), "placed"))
    convs, rows = stored(convs, "convs"), stored(rows, "rebuilt")
    members, deepest, smallest = convs.agg(F.count("*"), F.max("length"), F.min("conv")).first()
    rows = stored(identified(ordered(rows, deepest or 0, width)), "paths")
    # Turns, depth, key and parent follow from the identity.
    same = ["x", "y", "p", "q", "depth", "key", "close", "words"]
    nodes = rows.groupBy(*same).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
    zero = F.lit(0).cast("long")
    root = convs.limit(1).select(
        zero.alias("x"), zero.alias("y"), F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("q"), zero.alias("depth"), F.lit(b"").alias("key"), F.lit(b"\x01").alias("close"),
        zero.alias("words"), F.lit(smallest).cast("long").alias("conv_id"), F.lit(members).cast("long").alias("n_convs"))
    nodes = stored(nodes.withColumn("depth", F.col("depth").cast("long")).unionByName(root), "nodes")

    children = nodes.where("p is not null").groupBy(F.col("p").alias("x"), F.col("q").alias("y")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, ["x", "y"], "left").withColumn("n_children", F.coalesce("n_children", zero)), "family")
    parents = nodes.where("n_children > 0").select(F.col("x").alias("p"), F.col("y").alias("q"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    named = joined(nodes.select("x", "y", "p", "q"), parents, ["p", "q"], "n_children").select("x", "y", "parent_conv_id")

    leaf, saved = F.when(F.col("n_children") == 0, 1).otherwise(0), (F.col("n_convs") - 1) * F.col("words")
    opening = nodes.select("x", "y", F.col("key").alias("at"), F.lit(1).alias("opens"), leaf.alias("leaf"), saved.alias("saved"))
    closing = nodes.select("x", "y", F.col("close").alias("at"), F.lit(0).alias("opens"), F.lit(0).alias("leaf"), zero.alias("saved"))
    brackets = sums_before(opening.unionByName(closing), [F.col("at")], position=F.col("opens"), leaves=F.col("leaf"), spared=F.col("saved"))
    spans = brackets.groupBy("x", "y").agg(
        F.min("position").alias("position"), F.max("position").alias("end"),
        (F.max("leaves") - F.min("leaves")).alias("n_leaves"), (F.max("spared") - F.min("spared")).alias("saved_tokens"))

    last = rows.where("last").select("x", "y", "conv").unionByName(convs.where("length = 0").select(zero.alias("x"), zero.alias("y"), "conv"))
    out = nodes.join(spans, ["x", "y"]).join(named, ["x", "y"], "left").join(ends_digest(last), ["x", "y"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), F.col("position").cast("long").alias("position"), F.col("end").cast("long").alias("end"))
