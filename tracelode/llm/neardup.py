"""MinHash near-duplicate groups with tensored banding and exact verification.

Two small collections of keys, each of a few minhashes, are computed for each document; a
table is a pair of one key from either, so ``keys`` squared tables cost only 2 * ``keys`` *
``rows`` minhashes. Documents that share a table's key are candidates. Links are confirmed
on the full shingle sets, and connected components are taken over the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.llm import encode, texthash
from tracelode.llm.common import stored, stored_result

WORDS = 5
KEYS = 10
ROWS = 3
PERCENT = 85
#: Bits by which members of one bucket are told apart before their texts meet.
BITS = 2048
#: Classes up to this many are broadcast to fetch their texts (about 40 MB); beyond, they are fetched by a shuffled join.
BROADCAST_ROWS = 500_000


def shingle_set(data: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of one text's bytes, ascending."""
    return np.unique(texthash.shingles(texthash.words(data)[0], words))


def signatures(docs: DataFrame, keys: int = KEYS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """For each row (doc_id, digest, text): set size, two digests of the set, and the keys of both collections."""
    multipliers = texthash.constants(2 * keys * rows, 2024)
    join = texthash.constants(rows, 5)

    def sign(batches):
        encode.release()
        for batch in batches:
            data, at = texthash.raw(batch.column(2))
            sets = [shingle_set(data[at[i] : at[i + 1]], words) for i in range(batch.num_rows)]
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            signed = np.zeros((batch.num_rows, 2 * keys), np.uint64)
            digests = np.zeros((2, batch.num_rows), np.uint64)
            # Some sets at a time, so memory follows the largest text rather than the batch.
            step = 0
            while step < len(full):
                end = step + max(1, int(np.searchsorted(np.cumsum(sizes[full[step:]]), 1 << 18)))
                some = full[step:end]
                flat = np.concatenate([sets[i] for i in some])
                first = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
                for j in range(2):
                    digests[j, some] = np.add.reduceat(texthash.mixed(flat * texthash._ORDER[40 + j]), first)
                for j in range(2 * keys):
                    key = np.zeros(len(some), np.uint64)
                    for r in range(rows):
                        h = flat * multipliers[j * rows + r]
                        key += np.minimum.reduceat(h ^ (h >> np.uint64(31)), first) * join[r]
                    signed[some, j] = texthash.mixed(key)
                step = end
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (batch.num_rows + 1) * 2 * keys, 2 * keys, dtype=np.int32)), pa.array(signed.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)), lists], names=["doc_id", "digest", "n", "d1", "d2", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "digest", "text").mapInArrow(sign, f"doc_id {kind}, digest long, n long, d1 long, d2 long, keys array<long>")


def tables(classes: DataFrame, keys: int) -> DataFrame:
    """One row (key, rep, n) for each pair of a key of the first and one of the second collection that may collide.

    A pair collides only where both of its keys do, so keys that one class alone has are left
    out first: 2 * ``keys`` rows of a class are shuffled, and few of ``keys`` squared are made.
    """
    single = classes.select("rep", "n", F.posexplode("keys").alias("place", "part"))
    shared = single.groupBy("place", "part").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("place", "part")
    parts = single.join(shared, ["place", "part"], "left_semi").groupBy("rep", "n").agg(F.collect_list(F.struct("place", "part")).alias("parts"))
    # A class has 2 * keys parts at most.
    parts = stored(parts, "parts")
    first, second = F.filter("parts", lambda p: p["place"] < keys), F.filter("parts", lambda p: p["place"] >= keys)
    every = F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.xxhash64(a["place"], b["place"], a["part"], b["part"]))))
    return parts.select("rep", "n", F.explode(every).alias("key"))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Of pairs (a, b), those whose sets' intersection is at least percent of their union.

    texts: (uid, text) of every id in the pairs. Sets are computed where they are compared.
    """
    left = texts.select(F.col("uid").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("uid").alias("b"), F.col("text").alias("b_text"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text")

    def compare(batches):
        encode.release()
        last, last_set = None, None
        for batch in batches:
            (a, a_at), (b, b_at) = texthash.raw(batch.column(2)), texthash.raw(batch.column(3))
            ids = batch.column(1).to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                if last is None or ids[i] != last:
                    last, last_set = ids[i], shingle_set(b[b_at[i] : b_at[i + 1]], words)
                own = shingle_set(a[a_at[i] : a_at[i + 1]], words)
                shared = len(np.intersect1d(own, last_set, assume_unique=True))
                keep[i] = shared > 0 and 100 * shared >= percent * (len(own) + len(last_set) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep)], names=["a", "b", "linked"])

    return rows.mapInArrow(compare, "a long, b long, linked boolean")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of the links: the smallest node that it reaches.

    Each round a node takes the least label among neighbours, the node that was its label (its
    root) takes it too, and then each takes the label of its label, until none changes. As roots
    are hooked, rounds grow with about the logarithm of the longest chain. Labels only get
    smaller, so this ends; they are stored every round, so the plan stays short.
    """
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = stored(edges.union(edges.select("y", "x")).where("x != y").distinct(), "edges")
    labels = stored(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        # Each node has a neighbour, and each label is a node; a root's offers are combined before the shuffle.
        least = F.least("label", "near").alias("next")
        offers = F.array(F.struct("node", "label", least), F.struct(F.col("label").alias("node"), F.lit(None).cast("long").alias("label"), least))
        offered = labels.join(near, "node").select(F.inline(offers))
        hooked = stored(offered.groupBy("node").agg(F.max("label").alias("label"), F.min("next").alias("next")), "labels")
        # Where no label changed, neighbours have equal ones.
        if hooked.where("label != next").isEmpty():
            return hooked.select("node", F.col("next").alias("component"))
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("far"))
        labels = hooked.join(jump, "next").select("node", F.least("next", "far").alias("label"))


def _texts_of(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """(uid, text) of classes from where they are found, (uid, spot: id and digest of a text): broadcast while they are few, else joined by a shuffle."""
    spots = spots.select("uid", F.col("spot.doc_id").alias("of_id"), F.col("spot.digest").alias("of_digest"))
    few = spots.count() <= BROADCAST_ROWS
    found = docs.join(F.broadcast(spots) if few else spots, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest")))
    return stored(found.select("uid", "text").dropDuplicates(["uid"]), "texts")


def _same_ids(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of each id that has several texts; mostly there are none."""
    seen = signed.where("n > 0 and doc_id is not null").select("doc_id", "d1", "d2")
    sides = seen.groupBy("doc_id").agg(F.min("d1").alias("l1"), F.max("d1").alias("h1"), F.min("d2").alias("l2"), F.max("d2").alias("h2"))
    several = stored(sides.where("l1 <> h1 or l2 <> h2").select("doc_id"), "several")
    rows = seen.join(several, "doc_id", "left_semi").distinct().join(classes.select("d1", "d2", "rep"), ["d1", "d2"])
    first = rows.groupBy("doc_id").agg(F.min("rep").alias("first"))
    return rows.join(first, "doc_id").where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()


def private_counts(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(uid, own): how many of a text's shingles no other of the texts has."""
    def each(batches):
        encode.release()
        for batch in batches:
            data, at = texthash.raw(batch.column(1))
            ids = batch.column(0).to_numpy()
            step = 0
            while step < batch.num_rows:
                end = step + max(1, int(np.searchsorted(at[step:], at[step] + (1 << 22))) - 1)
                sets = [shingle_set(data[at[i] : at[i + 1]], words) for i in range(step, end)]
                hashes = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[step:end], [len(x) for x in sets])), pa.array(hashes)], names=["uid", "shingle"])
                step = end

    seen = texts.select("uid", "text").mapInArrow(each, "uid long, shingle long")
    alone = seen.groupBy("shingle").agg(F.count("*").alias("times"), F.min("uid").alias("uid")).where("times = 1")
    own = alone.groupBy("uid").agg(F.count("*").alias("own"))
    return texts.select("uid").join(own, "uid", "left").select("uid", F.coalesce("own", F.lit(0)).alias("own"))


def set_bits(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(uid, bits): BITS bits of a text, of which its shingles' hashes set one each."""
    def each(batches):
        for batch in batches:
            data, at = texthash.raw(batch.column(1))
            found = np.zeros((batch.num_rows, BITS), bool)
            for i in range(batch.num_rows):
                found[i, (shingle_set(data[at[i] : at[i + 1]], words) % np.uint64(BITS)).astype(np.int64)] = True
            longs = np.packbits(found, axis=1).view(np.int64)
            ends = pa.array(np.arange(0, longs.size + 1, longs.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(longs.reshape(-1)))], names=["uid", "bits"])

    return texts.select("uid", "text").mapInArrow(each, "uid long, bits array<long>")


def bits_may_link(a: str, b: str, percent: int) -> Column:
    """Whether sets of sizes n with bits can reach the threshold: a bit that only one of them has is an element that the other lacks."""
    lost = lambda x, y: F.aggregate(F.zip_with(f"{x}_bits", f"{y}_bits", lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, n: s + n)
    most = F.least(F.col(f"{a}_n") - lost(a, b), F.col(f"{b}_n") - lost(b, a))
    return 100 * most >= percent * (F.col(f"{a}_n") + F.col(f"{b}_n") - most)


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether sets of sizes n with own elements that no other set has can reach the threshold.

    The intersection holds no own element of either, which bounds it from above, and with it the similarity.
    """
    most = F.least(F.col(f"{a}_n") - F.col(f"{a}_own"), F.col(f"{b}_n") - F.col(f"{b}_own"))
    return 100 * most >= percent * (F.col(f"{a}_n") + F.col(f"{b}_n") - most)


@stored_result("groups")
def near_duplicates(docs: DataFrame, percent: int = PERCENT, keys: int = KEYS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """For each document: doc_id, n_shingles, component_id (smallest id reachable by links), kept.

    Takes columns doc_id and text; others are ignored, whatever their names. Ids may be of any
    type that has an order. Words are runs of
    other than ASCII white space with A-Z lower-cased; a text of fewer than ``words`` words is
    one shingle. Null, empty and blank texts have no shingle and link with nothing. Rows that
    repeat an id are one document if the text is the same, and else a document each, whose groups join. A null
    id stands for the row: it links like others and gets the smallest id of its group, or null
    where the group has no id; it is kept only then. An empty table gives no rows.

    1. Equal sets form classes. One row for each class goes on.
    2. Each class is compared with one leader: of the leaders of its tables' buckets that with
       fewest shingles of its own. Copies of one text that were changed each for itself are
       nearest to the least changed one, so what links at all mostly links here.
    3. Each class is compared with its other buckets' leaders, where the components differ.
    4. In buckets that still hold several components, members that aren't in the leader's are
       compared with those of other components. So each pair of each table is compared, or
       known to be in one component, or known not to link as their own shingles are too many.
    A pair at the threshold shares no table with a chance of 2 * (1 - 0.85**rows)**keys, 0.015 %.
    """
    known = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    signed = stored(signatures(known, keys, rows, words), "signatures")
    # Of a class: the least id, and where one of its texts is found.
    spot = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    classes = signed.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.min(spot).alias("spot"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    # Numbers of classes are stored with them, so they don't change.
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    banded = tables(classes, keys)
    shared = banded.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key")
    buckets = stored(banded.join(shared, "key", "left_semi"), "buckets")
    texts = _texts_of(known, classes.select(F.col("rep").alias("uid"), "spot").join(buckets.select(F.col("rep").alias("uid")).distinct(), "uid", "left_semi"))
    own = stored(private_counts(texts, words), "own")
    buckets = buckets.join(own.withColumnRenamed("uid", "rep"), "rep")
    leaders = buckets.groupBy("key").agg(F.min(F.struct("own", F.col("rep").alias("id"), "n")).alias("lead"))
    buckets = stored(buckets.join(leaders, "key"), "led")
    first = buckets.groupBy("rep", "n", "own").agg(F.min("lead").alias("lead"))
    same = stored(_same_ids(signed, classes), "same")
    checked = _compare(_to_leader(first, percent), texts, percent, words)
    component = components(checked.where("linked").select("a", "b").union(same))
    second = _between(_to_leader(buckets, percent), component)
    more = _compare(second.join(checked.select("a", "b"), ["a", "b"], "left_anti"), texts, percent, words)
    checked = checked.union(more)
    component = components(checked.where("linked").select("a", "b").union(same))
    late = stored(_late(buckets, component, texts, percent, words).join(checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "late")
    if not late.isEmpty():
        checked = checked.union(_compare(late, texts, percent, words))
        component = components(checked.where("linked").select("a", "b").union(same))
    # The least id of each component of several classes; a class alone has its own.
    linked = component.select(F.col("node").alias("rep"), "component").join(classes.select("rep", "least"), "rep")
    smallest = linked.groupBy("component").agg(F.min("least").alias("smallest"))
    linked = linked.join(smallest, "component").select("rep", "smallest")
    reps = classes.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "rep", "least").join(linked, "rep", "left").select("e1", "e2", F.coalesce("smallest", "least").alias("smallest"))
    found = signed.select("doc_id", "n", "d1", "d2").join(reps, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") > 0), "left")
    found = found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"))
    found = found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    return found


def _compare(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    return stored(confirmed(stored(pairs.select("a", "b").distinct(), "pairs"), texts, percent, words), "checked")


def _to_leader(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a row's rep and its leader that may link."""
    pairs = rows.select(
        F.col("rep").alias("a"), F.col("n").alias("a_n"), F.col("own").alias("a_own"), F.col("lead.id").alias("b"), F.col("lead.n").alias("b_n"), F.col("lead.own").alias("b_own"))
    return pairs.where((F.col("a") != F.col("b")) & may_link("a", "b", percent)).select("a", "b").distinct()


def _between(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """Those of the pairs whose sides are in different components."""
    of = lambda side: component.select(F.col("node").alias(side), F.col("component").alias(f"{side}_component"))
    rows = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return rows.where(F.coalesce("a_component", "a") != F.coalesce("b_component", "b")).select("a", "b")


def _late(buckets: DataFrame, component: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Pairs (a, b), a smaller, of bucket members in different components that may link, one of them outside the leader's component.

    Members of a large group of texts that differ too much to link share buckets by their common
    part. They are told apart by bits of their sets, so that of such a group hardly a pair is made.
    """
    of = lambda name, column: component.select(F.col("node").alias(name), F.col("component").alias(column))
    rows = buckets.select("key", "rep", "n", "own", F.col("lead.id").alias("lead")).join(of("rep", "in"), "rep", "left").join(of("lead", "lead_in"), "lead", "left")
    rows = stored(rows.select("key", "rep", "n", "own", F.coalesce("in", "rep").alias("component"), F.coalesce("lead_in", "lead").alias("lead")), "members")
    outside = rows.where("component <> lead")
    # The size that a partner may have at most, given a's own shingles, is checked against the bucket's smallest first.
    least = rows.groupBy("key").agg(F.min("n").alias("least"))
    free = F.col("n") - F.col("own")
    outside = stored(outside.join(least, "key").where(100 * free >= percent * (F.col("n") + F.col("least") - free)), "outside")
    met = stored(rows.join(outside.select("key").distinct(), "key", "left_semi"), "met")
    bits = stored(set_bits(texts.join(met.select(F.col("rep").alias("uid")).distinct(), "uid", "left_semi"), words), "bits")
    # A pair that shares several tables is made in the first of them alone; a class has keys squared tables at most.
    every = rows.groupBy("rep").agg(F.collect_set("key").alias("tables")).join(bits.withColumnRenamed("uid", "rep"), "rep")
    side = lambda df, x, *more: df.join(every, "rep").select("key", F.col("rep").alias(x), F.col("n").alias(f"{x}_n"), F.col("own").alias(f"{x}_own"), F.col("component").alias(f"{x}_component"), F.col("tables").alias(f"{x}_tables"), F.col("bits").alias(f"{x}_bits"), *more)
    once = F.array_min(F.array_intersect("a_tables", "b_tables")) == F.col("key")
    # Two that are both outside meet once: the one that can't link with any was left out of a's side already.
    ordered = (F.col("a") < F.col("b")) | ~F.col("b_outside")
    pairs = side(outside, "a").join(side(met, "b", (F.col("component") != F.col("lead")).alias("b_outside")), "key")
    pairs = pairs.where((F.col("a_component") != F.col("b_component")) & ordered & may_link("a", "b", percent) & bits_may_link("a", "b", percent) & once)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
