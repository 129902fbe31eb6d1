"""Near-duplicates by MinHash with tensored banding, verified on full shingle sets.

A document gets two small collections of partial keys, each made of ``HALF`` minhashes.
Every pair of one partial key from either collection is the key of a hash table, so
``tables`` tables cost only ``2 * sqrt(tables) * HALF`` minhashes. Partial keys that no
other document has are dropped before the pairs are formed, so unlike documents never
reach the tables.

Documents with equal sets are one class. Classes leave that cannot be similar enough to any
other, by the shingles that they share with no one. The rest are compared in rounds, and after
each round only the buckets whose members belong to several components stay open:

1. Every class is compared with one other: the hub of its most crowded partial key, the class
   there with the fewest shingles of its own. This settles most groups of copies.
2. While many pairs are open, every class is compared with up to ``HUBS`` members, drawn anew
   each time, of its most crowded open partial key, so a round's comparisons grow with the classes.
3. All pairs that are left, those of different components that meet in a table (share a partial
   key of either collection), are compared, inside groups of a bucket and up to ``HELD`` of its classes: no rows of pairs, or of tables, are made.

So no link between documents that collide in a table is lost, and no bucket is capped. A
class's shingle set travels once a round with its group; the hubs' sets once for every
``MEMBERS`` members.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storytrack.llm.common import Scratch, broadcast_if_small, cut, ship, small_batches, table, trim_memory

WIDTH = 5
THRESHOLD = 85  # of 100
HALF = 4
RECALL = 0.9995  # chance that a pair exactly at the threshold meets in a table
# Ids that may be broadcast at once (LongHashedRelation: about 32 bytes an id).
MAX_BROADCAST_IDS = 1_000_000
# Open pairs (counted once for each partial key they share) that are compared all at once; with
# more, hubs are drawn first, as long as a round of them closes a fifth of the open pairs.
PAIRS_PER_ROUND = 500_000
HUBS = 32
ROWS = 200_000  # rows of a table of the rounds in a partition
MEMBERS = 1024  # members of a group that meet its hubs in one place
HELD = 512  # classes of a bucket that all others are compared with at a time, in the last step
PIECE = 1 << 22  # bytes of a text that are cut into words at a time
TEXTS_AT_ONCE = 1000  # texts in a batch that goes to Python
BLOCK = 4096  # shingles that are hashed by all functions at a time

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def collection_size(threshold: int) -> int:
    """Partial keys in a collection that give pairs at the threshold the chance ``RECALL`` to meet."""
    one = (threshold / 100) ** HALF
    return math.ceil(math.log(1 - math.sqrt(RECALL)) / math.log(1 - one))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def _word_hashes(text: str) -> np.ndarray:
    data = text.encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only, and ASCII white space only
    found, at = [], 0
    while at < len(data):
        end = at + PIECE
        part = data[at:end]
        if end < len(data):
            white = max(part.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if white < 0:  # a word longer than a piece
                nearest = [p for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := data.find(c, end)) >= 0]
                part = data[at:min(nearest, default=len(data))]
            else:
                part = part[:white + 1]
        words = part.split()
        found.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at += len(part)
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; of a shorter text, of the whole sequence."""
    words = _word_hashes(text or "")
    if not len(words):
        return words
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out * _MIX[0] + words[i:len(words) - n + 1 + i])
    return np.unique(out)


def _functions(size: int) -> np.ndarray:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(sets: list[np.ndarray], size: int) -> np.ndarray:
    """[set, function] minima; the sets are not empty."""
    factors = _functions(size)
    out = np.full((len(sets), size), np.iinfo(np.uint64).max, np.uint64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for at in range(0, len(every), BLOCK):
        own = owner[at:at + BLOCK]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        low = np.minimum.reduceat(every[at:at + BLOCK, None] * factors, first, axis=0)
        np.minimum.at(out, own[first], low)
    return out


def partial_keys(minima: np.ndarray) -> np.ndarray:
    """[set, 2 * collection size] keys: each mixes ``HALF`` minhashes and its own place."""
    groups = minima.reshape(len(minima), -1, HALF)
    key = np.broadcast_to(np.arange(groups.shape[1], dtype=np.uint64), groups.shape[:2]).copy()
    for i in range(HALF):
        key = _mix(key * _MIX[0] + groups[:, :, i])
    return key.view(np.int64)


def signatures(docs: DataFrame, size: int, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, digest, keys_a, keys_b) of (doc_id, text) rows; digest names the set."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at:at + 256]
                sets = [shingles(t, width) for t in part["text"]]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [[] for _ in sets]
                if full:
                    for i, k in zip(full, partial_keys(minhashes([sets[i] for i in full], 2 * size * HALF)), strict=True):
                        keys[i] = k
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].values, "n_shingles": [len(s) for s in sets],
                    "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    "keys_a": [k[:size] for k in keys], "keys_b": [k[size:] for k in keys]})
        trim_memory()

    return docs.mapInPandas(run, f"doc_id {kind}, n_shingles long, digest binary, keys_a array<long>, keys_b array<long>")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The (v, key) rows whose key more than one v has."""
    often = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key)
    return rows.join(often, key)


def _texts(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(v, digest, text) of the documents that stand for materialised classes (v, doc_id, digest).

    An id with several texts comes with all of them: only those with the digest are the class's.
    """
    ids = broadcast_if_small(classes.select("doc_id", "v", "digest"), MAX_BROADCAST_IDS)
    return docs.join(ids, "doc_id").select("v", "digest", "text")


def _sets(part: pd.DataFrame, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """v and shingles of those rows (v, digest, text) whose text has the digest."""
    sets = [shingles(t, width) for t in part["text"]]
    own = [xxhash.xxh3_128_digest(s.tobytes()) == bytes(d) for s, d in zip(sets, part["digest"], strict=True)]
    return part["v"].values[own], [s for s, o in zip(sets, own, strict=True) if o]


def shingle_sets(classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(v, _set) of materialised classes (v, doc_id, digest): the sorted hashes as bytes."""
    def cut_sets(frames):
        for pdf in frames:
            for at in range(0, len(pdf), 256):
                v, sets = _sets(pdf.iloc[at:at + 256], width)
                yield pd.DataFrame({"v": v, "_set": [s.tobytes() for s in sets]})
        trim_memory()

    return _texts(classes, docs).mapInPandas(cut_sets, "v long, _set binary")


def similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not len(a) or 100 * len(a) < threshold * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= threshold * (len(a) + len(b) - both)


def linked(hubs: DataFrame, members: DataFrame, facts: DataFrame, label: DataFrame, sets: DataFrame,
           threshold: int, keys: DataFrame | None = None) -> DataFrame:
    """The (x, y) links between the hubs (g, v) and the members (g, v) of groups g.

    Only classes of different components are compared, and only if their sizes and the
    shingles that they have in common with others (``facts``: v, n, c) allow a link. With
    ``keys`` (v, keys_a, keys_b) groups belong to a bucket ``a``, and a pair is compared only
    if it meets in a table and in the first bucket that it shares.
    """
    carried = [] if keys is None else ["a"]
    parts = members.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(MEMBERS)).cast("int").alias("_parts"))
    at = F.pmod(F.xxhash64("v", "g"), F.col("_parts")).cast("int")
    rows = (hubs.join(parts, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("salt"),
                                         F.lit(0).alias("kind"), "v", *carried)
            .unionByName(members.join(parts, "g").select("g", at.alias("salt"), F.lit(1).alias("kind"), "v", *carried)))
    known = (facts.join(label, "v", "left").join(sets, "v")
             .select("v", "n", "c", F.coalesce("label", "v").alias("label"), "_set"))
    if keys is not None:
        known = known.join(keys.select("v", F.concat("keys_a", "keys_b").alias("_keys")), "v")
    whole = (rows.join(known, "v").repartition("g", "salt").sortWithinPartitions("g", "salt", "kind"))
    columns = ["g", "salt", "kind", "v", "n", "c", "label", "_set", *(["a", "_keys"] if carried else [])]

    def compare(frames):
        place, held, packed = None, [], None
        for pdf in frames:
            found = []
            for g, salt, kind, v, n, c, own, raw, *more in zip(*(pdf[k] for k in columns), strict=True):
                if (g, salt) != place:
                    place, held, packed = (g, salt), [], None
                here = np.frombuffer(raw, np.uint64)
                if not kind:
                    held.append((v, n, c, own, here, *more))
                    packed = None
                    continue
                if not held:
                    continue
                if packed is None:
                    packed = [np.array([h[i] for h in held]) for i in range(4)]
                    if more:
                        packed.append(np.stack([h[6] for h in held]))
                able = (packed[3] != own) & ((packed[1] + n) * threshold <= np.minimum(packed[2], c) * (100 + threshold))
                if more:
                    same = packed[4] == more[1]
                    half = same.shape[1] // 2
                    able &= same[:, half:].any(axis=1) & same[:, :half].any(axis=1)
                    able &= np.asarray(more[1])[same[:, :half].argmax(axis=1)] == more[0]
                for i in np.flatnonzero(able):
                    if similar(here, held[i][4], threshold):
                        found.append((min(v, held[i][0]), max(v, held[i][0])))
            yield pd.DataFrame(found, columns=["x", "y"]).astype("int64")
        trim_memory()

    return whole.mapInPandas(compare, "x long, y long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, label) of the vertices of (x, y) links: label is the smallest vertex reachable.

    Every round takes the smallest label among the neighbours and then the label's own
    label, so the rounds grow with the logarithm of the longest chain. Each round's labels are
    written and read again: plans and their size estimates do not grow from round to round.
    """
    scratch = Scratch(links.sparkSession, "components")
    ends = scratch.write(links.select("x", "y").union(links.select("y", "x")).toDF("v", "w").distinct(), "ends", ROWS)
    label = scratch.write(ends.groupBy("v").agg(F.min("w").alias("_m"))
                          .select("v", F.least("v", "_m").alias("label")), "label", ROWS)
    while True:
        near = (ends.join(label.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("label").alias("_m")))
        low = label.join(near, "v").select("v", "label", F.least("label", "_m").alias("_low"))
        far = label.select(F.col("v").alias("_low"), F.col("label").alias("_far"))
        new = scratch.renew(low.join(far, "_low").select("v", F.col("label").alias("_old"),
                                                         F.least("_low", "_far").alias("label")), "label", ROWS)
        label = new.select("v", "label")
        if new.filter("label <> _old").isEmpty():
            scratch.drop("ends")
            return label


def relabelled(label: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``label`` (v, label) after more (x, y) links: the components of the labels, carried over."""
    def top(c: str) -> DataFrame:
        return label.select(F.col("v").alias(c), F.col("label").alias(f"_{c}"))

    between = (links.join(top("x"), "x", "left").join(top("y"), "y", "left")
               .select(F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y")).filter("x <> y"))
    moved = components(between)
    before = label.join(moved.select(F.col("v").alias("label"), F.col("label").alias("_to")), "label", "left").select(
        "v", F.coalesce("_to", "label").alias("label"))
    return scratch.renew(before.unionByName(moved.join(label, "v", "left_anti")), "label", ROWS)


def _sizes(classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(v, n, c) of classes (v, doc_id, digest, n): c tells how many of their n shingles another class has too.

    Two sets x, y with similarity t share at least t / (1 + t) * (|x| + |y|) shingles, and
    neither can share more than its c. So c tells, without any pair, most documents apart
    that only look alike, such as copies with many own changes of one text. Repeated rows of
    a document do not count: n is the size of the set, and a shingle is a class's own or not.
    """
    def explode(frames):
        for pdf in frames:
            for at in range(0, len(pdf), 64):
                v, sets = _sets(pdf.iloc[at:at + 64], width)
                if sets:
                    yield pd.DataFrame({"v": np.repeat(v, [len(s) for s in sets]),
                                        "s": np.concatenate(sets).view(np.int64)})
        trim_memory()

    held = _texts(classes, docs).mapInPandas(explode, "v long, s long")
    owners = held.groupBy("s").agg(F.min("v").alias("_a"), F.max("v").alias("_b"))
    alone = owners.filter("_a = _b").groupBy(F.col("_a").alias("v")).agg(F.count(F.lit(1)).alias("_alone"))
    return (classes.join(alone, "v", "left")
            .select("v", "n", (F.col("n") - F.coalesce("_alone", F.lit(0))).alias("c")))


def first_hubs(a: DataFrame, b: DataFrame, able: DataFrame) -> DataFrame:
    """(g, v): each class with the hub g of its most crowded partial key."""
    held = (a.select("v", F.col("a").alias("k")).unionByName(b.select("v", F.col("b").alias("k")))
            .join(able.select("v", (F.col("n") - F.col("c")).alias("_own")), "v"))
    hubs = held.groupBy("k").agg(F.count(F.lit(1)).alias("_n"), F.min_by("v", F.struct("_own", "v")).alias("g"))
    return (held.join(hubs, "k").groupBy("v").agg(F.max_by("g", F.struct("_n", "k")).alias("g"))
            .filter("v <> g").select("g", "v"))


def mixed(rows: DataFrame, key: list[str]) -> DataFrame:
    """The (…, v, label) rows of the buckets that several components share."""
    several = (rows.groupBy(*key).agg(F.min("label").alias("_l"), F.max("label").alias("_h"))
               .filter("_l <> _h").select(*key))
    return rows.join(several, key)


def drawn_hubs(a: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Hubs and members (g, v): each class in its most crowded open bucket, with ``HUBS`` drawn members of it."""
    size = a.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    own = a.join(size, "a").groupBy("v").agg(F.max_by("a", F.struct("_n", "a")).alias("g")).select("g", "v")
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("v", F.lit(turn)), "v"))
    hubs = (a.join(own.select(F.col("g").alias("a")).distinct(), "a", "left_semi")
            .select(F.col("a").alias("g"), "v").withColumn("_p", place))
    return hubs.filter(F.col("_p") <= HUBS).select("g", "v"), own


def open_groups(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hubs and members (g, a, v) of the groups in which all open pairs of the buckets meet.

    ``a`` has the (a, v, label) rows of open buckets. The members of a bucket's largest
    component need no comparison with one another: only the others are hubs, up to about
    ``HELD`` of them in a group.
    """
    count = a.groupBy("a", "label").agg(F.count(F.lit(1)).alias("_n"))
    most = count.groupBy("a").agg(
        F.max_by("label", F.struct("_n", "label")).alias("_most"),
        F.ceil((F.sum("_n") - F.max("_n")) / F.lit(HELD)).cast("int").alias("_groups"))
    rows = a.join(most, "a")
    part = F.pmod(F.xxhash64("v"), F.col("_groups")).cast("int")
    hubs = rows.filter("label <> _most").select(F.xxhash64("a", part).alias("g"), "a", "v")
    each = rows.select("a", "v", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("_part"))
    return hubs, each.select(F.xxhash64("a", "_part").alias("g"), "a", "v")


def class_links(classes: DataFrame, keys: DataFrame, docs: DataFrame, threshold: int, width: int) -> DataFrame:
    """(v, label): components of the classes that are linked at all.

    ``classes`` has (v, doc_id, digest, n) and ``keys`` (v, keys_a, keys_b), a row for each class.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    a = scratch.write(_shared(keys.select("v", F.explode("keys_a").alias("a")), "a"), "a")
    b = scratch.write(_shared(keys.select("v", F.explode("keys_b").alias("b")), "b"), "b")
    met = scratch.write(a.select("v").distinct().join(b.select("v").distinct(), "v").join(classes, "v"), "met")
    # Classes that have enough shingles in common with the others to be similar to one.
    with small_batches(spark, TEXTS_AT_ONCE):
        able = scratch.write(_sizes(met, docs, width).filter(F.col("c") * 100 >= F.col("n") * threshold), "able", ROWS)
        sets = scratch.write(shingle_sets(met.join(able.select("v"), "v", "left_semi"), docs, width), "sets")
    a = scratch.renew(_shared(a.join(able.select("v"), "v", "left_semi"), "a"), "a", ROWS)
    b = scratch.renew(_shared(b.join(able.select("v"), "v", "left_semi"), "b"), "b", ROWS)
    # Not createDataFrame: its rows come through workers of another kind, which live on beside the others.
    label = scratch.write(spark.range(0).select(F.col("id").alias("v"), F.col("id").alias("label")), "label", ROWS)

    def compare(hubs: DataFrame, members: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        with small_batches(spark):  # a row holds a whole set
            links = scratch.renew(linked(hubs, members, able, label, sets, threshold, keys), "links", ROWS)
        return relabelled(label, links, scratch)

    members = scratch.renew(first_hubs(a, b, able), "members", ROWS)
    label = compare(members.select("g", F.col("g").alias("v")).distinct(), members)
    top = F.coalesce("label", "v").alias("label")

    def labelled(rows: DataFrame) -> DataFrame:
        keys = [c for c in rows.columns if c != "label"]
        return rows.select(*keys).join(label, "v", "left").select(*keys, top)

    turn, before = 0, None
    while True:
        # Partial keys whose classes have come to belong to one component are settled for good, and
        # with them all tables that they are part of: a table is open only if both its keys are.
        b = scratch.renew(mixed(labelled(b), ["b"]), "b", ROWS)
        a = mixed(labelled(a), ["a"]).join(b.select("v").distinct(), "v", "left_semi")
        a = scratch.renew(a, "a", ROWS)
        count = a.groupBy("a", "label").agg(F.count(F.lit(1)).alias("_n"))
        left = (count.groupBy("a").agg(((F.pow(F.sum("_n"), 2) - F.sum(F.pow("_n", F.lit(2)))) / 2).alias("_p"))
                .agg(F.sum("_p")).first()[0]) or 0
        if not left:
            break
        if left <= PAIRS_PER_ROUND or (before is not None and left > 0.8 * before):
            hubs, members = open_groups(a)
            label = compare(scratch.renew(hubs, "hubs", ROWS), scratch.renew(members, "members", ROWS), keys)
            break
        hubs, members = drawn_hubs(a, turn)
        label = compare(scratch.renew(hubs, "hubs", ROWS), scratch.renew(members, "members", ROWS))
        turn, before = turn + 1, left
    scratch.drop("a", "b", "met", "able", "sets", "links", "members", "hubs")  # the labels stay
    return label


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD,
               width: int = WIDTH) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Words are runs of anything but ASCII white space, A-Z lower-cased; documents are linked
    if ``100 * intersection >= threshold * union`` of their sets of ``width``-word shingles,
    and a component's id is its smallest document id, which is kept. Null, empty and blank
    texts have no shingles and no links. Rows that share an id are one document, with the
    links of all its texts. A row without an id has no component (null) and is kept. Other
    columns are ignored; an empty table gives no rows.
    """
    size = collection_size(threshold)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession, TEXTS_AT_ONCE):
        signed = cut(signatures(texts, size, width))
    known = signed.filter("n_shingles > 0 and doc_id is not null")
    # Classes go by a number of their own: a document with several texts stands for several of them.
    classes = cut(known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"))
                  .withColumn("v", F.monotonically_increasing_id()))
    keys = known.join(classes.select("doc_id", "digest", "v"), ["doc_id", "digest"]).select("v", "keys_a", "keys_b")
    again = cut(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.min("digest").alias("_a"),
                                            F.max("digest").alias("_b")).filter("_n > 1"))
    if not again.isEmpty():  # equal rows of a document count once
        ids = broadcast_if_small(again.select("doc_id"), MAX_BROADCAST_IDS)
        texts = texts.join(ids, "doc_id", "left_anti").union(
            cut(texts.join(ids, "doc_id", "left_semi").dropDuplicates()))
        keys = keys.dropDuplicates(["v"])
    label = class_links(classes, keys, texts, threshold, width)
    several = again.filter("_a <> _b")
    if not several.isEmpty():
        texts_of = known.join(several.select("doc_id"), "doc_id").join(classes.select("digest", "v"), "digest")
        bound = texts_of.join(texts_of.groupBy("doc_id").agg(F.min("v").alias("y")), "doc_id").select(
            F.col("v").alias("x"), "y")
        label = components(label.select(F.col("v").alias("x"), F.col("label").alias("y")).union(bound))
    linked = classes.join(label, "v")
    least = cut(linked.groupBy("label").agg(F.min("doc_id").alias("_least")))
    linked = linked.join(broadcast_if_small(least, MAX_BROADCAST_IDS), "label").select("v", "_least")
    of_class = classes.join(linked, "v", "left").select("digest", F.coalesce("_least", "doc_id").alias("component_id"))
    marked = (signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
              .join(of_class, "digest", "left"))
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return marked.select(F.col("doc_id").alias(id_col), "n_shingles", found.alias("component_id"),
                         F.col("doc_id").eqNullSafe(found).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that are near-duplicates of one with a smaller id."""
    gone = cut(near_dedup(docs, id_col, text_col, threshold).filter(~F.col("kept")).select(id_col).distinct())
    return docs.join(broadcast_if_small(gone, MAX_BROADCAST_IDS), id_col, "left_anti").select(docs.columns)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
