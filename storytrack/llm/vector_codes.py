"""Product codes of vectors by dual-tree Lloyd rounds in whole numbers.

A vector is cut into equal parts and every part position has a codebook. Blocks of vectors
are rows of a table; a block holds, per part position, a balanced tree over its parts whose
nodes keep their bounding box and the sum of their parts. A round walks that tree and a tree
over the codebook's entries together: of the entry nodes that face a node, those whose least
distance is more than another's greatest are dropped, and a node that only one entry is left
for goes to it whole, by its kept sum. Only leaves that several entries are left for compare
part by part. All bounds and distances are integers, so pruning never changes a result.

The blocks are written once; a round sends the codebooks (parts x entries x part length
numbers) to the tasks and gets one row for each task, part, entry and place to add up.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storytrack.llm.common import Scratch, ship, small_batches, table

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
BLOCK = 4096  # vectors of a block
LEAF = 8  # a leaf holds this many parts, or up to twice as many
BLOCKS_AT_ONCE = 8  # blocks in a batch that goes to Python
PAIRS_AT_ONCE = 1 << 15  # (leaf, entry) pairs that are compared part by part at a time


def largest_component(dim: int) -> int:
    """Bound of a whole-number component: a vector's summed squared distances stay below 2**62."""
    return 1 << ((60 - (dim - 1).bit_length()) // 2)


@dataclass
class Forest:
    """A balanced tree over the n items of each part position; ``depth`` halvings.

    ``items`` [part, n, width] are in tree order and ``order`` [part, n] tells which item each
    one is. Level l has 2**l nodes a part; node i spans items ``i*n >> l`` to ``(i+1)*n >> l``.
    ``low``, ``high`` and ``sums`` are lists by level of [part * 2**l, width] arrays.
    """

    items: np.ndarray
    order: np.ndarray
    low: list
    high: list
    sums: list

    @property
    def depth(self) -> int:
        return len(self.low) - 1

    def spans(self, level: int) -> np.ndarray:
        return np.arange((1 << level) + 1) * self.items.shape[1] >> level


def depth_of(n: int, leaf: int) -> int:
    return max(0, (n // leaf).bit_length() - 1)


def grow(points: np.ndarray, leaf: int) -> Forest:
    """A tree for each [n, width] slice of ``points``: nodes are halved along their widest side."""
    parts, n, width = points.shape
    tree = Forest(points, np.tile(np.arange(n), (parts, 1)), [], [], [])
    for level in range(depth_of(n, leaf) + 1):
        spans = tree.spans(level)
        low, high = (f.reduceat(tree.items, spans[:-1], axis=1) for f in (np.minimum, np.maximum))
        tree.low.append(low.reshape(-1, width))
        tree.high.append(high.reshape(-1, width))
        tree.sums.append(np.add.reduceat(tree.items, spans[:-1], axis=1, dtype=np.int64).reshape(-1, width))
        if level < depth_of(n, leaf):
            node = np.repeat(np.arange(1 << level), np.diff(spans))
            widest = (high - low).argmax(axis=2)[:, node]
            key = np.take_along_axis(tree.items, widest[:, :, None], axis=2)[:, :, 0]
            at = np.lexsort((key, np.broadcast_to(node, key.shape)), axis=-1)
            tree.items = np.take_along_axis(tree.items, at[:, :, None], axis=1)
            tree.order = np.take_along_axis(tree.order, at, axis=1)
    return tree


def _firsts(groups: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])


def assign(tree: Forest, centres: np.ndarray) -> tuple[list, list]:
    """Nearest entries of all items, ties to the lower index.

    ``whole`` lists (level, nodes, entries): all items of the node have that entry.
    ``single`` lists (items, entries) of the rest. Items and nodes are numbered through all parts.
    """
    parts, entries, width = centres.shape
    n = tree.items.shape[1]
    book = grow(centres, 1)
    flat = book.items.reshape(-1, width)
    index = book.order.reshape(-1)
    later = np.array([[(centres[p, :e] == centres[p, e]).all(axis=1).any() for e in range(entries)]
                      for p in range(parts)])  # an equal entry with a lower index is there
    drop = later[np.repeat(np.arange(parts), entries), index]
    whole, single = [], []
    d = e = np.arange(parts)
    at, le = 0, 0  # levels; le = book.depth + 1: single entries
    while len(d):
        low, high = tree.low[at][d].astype(np.int64), tree.high[at][d].astype(np.int64)
        elow, ehigh = (flat[e], flat[e]) if le > book.depth else (book.low[le][e], book.high[le][e])
        near = (np.maximum(0, np.maximum(elow - high, low - ehigh)) ** 2).sum(axis=1)
        far = (np.maximum(np.abs(ehigh - low), np.abs(high - elow)) ** 2).sum(axis=1)
        first = _firsts(d)
        keep = near <= np.repeat(np.minimum.reduceat(far, first), np.diff(np.r_[first, len(d)]))
        if le > book.depth:
            keep &= ~drop[e]
        d, e = d[keep], e[keep]
        if le > book.depth:
            first = _firsts(d)
            size = np.diff(np.r_[first, len(d)])
            alone = first[size == 1]
            whole.append((at, d[alone], index[e[alone]]))
            rest = np.repeat(size > 1, size)
            d, e = d[rest], e[rest]
            if at == tree.depth:
                break
        if le < book.depth:
            d, e = np.repeat(d, 2), (2 * e[:, None] + [0, 1]).ravel()
        elif le == book.depth:
            spans = book.spans(le)
            part, node = e >> le, e & ((1 << le) - 1)
            size = spans[node + 1] - spans[node]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            d, e = np.repeat(d, size), np.repeat(part * entries + spans[node], size) + step
        le = min(le + 1, book.depth + 1)
        if at < tree.depth:
            d, e = (2 * d[:, None] + [0, 1]).ravel(), np.repeat(e, 2)
            at += 1
        back = np.lexsort((e, d))
        d, e = d[back], e[back]
    spans = tree.spans(tree.depth)
    part, node = d >> tree.depth, d & ((1 << tree.depth) - 1)
    slots = np.arange(np.diff(spans).max(initial=0))
    points = tree.items.reshape(-1, width)
    first = _firsts(d) if len(d) else np.empty(0, int)
    begins = 0
    while begins < len(first):  # whole leaves at a time
        ends = max(begins + 1, int(np.searchsorted(first, first[begins] + PAIRS_AT_ONCE)))
        own = slice(first[begins], first[ends] if ends < len(first) else len(d))
        heads = first[begins:ends] - first[begins]
        size = np.diff(np.r_[heads, own.stop - own.start])
        place = spans[node[own]][:, None] + slots
        there = place < spans[node[own] + 1][:, None]
        item = part[own][:, None] * n + np.minimum(place, n - 1)
        apart = ((points[item].astype(np.int64) - flat[e[own]][:, None, :]) ** 2).sum(axis=2)
        least = np.repeat(np.minimum.reduceat(apart, heads, axis=0), size, axis=0)
        which = np.minimum.reduceat(np.where(apart == least, index[e[own]][:, None], entries), heads, axis=0)
        single.append((item[heads][there[heads]], which[there[heads]]))
        begins = ends
    return whole, single


def gathered(tree: Forest, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums [part * entries, width] and counts of the items by their nearest entry."""
    parts, entries, width = centres.shape
    n = tree.items.shape[1]
    sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
    whole, single = assign(tree, centres)
    for level, node, entry in whole:
        to = (node >> level) * entries + entry
        np.add.at(sums, to, tree.sums[level][node])
        np.add.at(counts, to, np.diff(tree.spans(level))[node & ((1 << level) - 1)])
    for item, entry in single:
        to = (item // n) * entries + entry
        np.add.at(sums, to, tree.items.reshape(-1, width)[item])
        np.add.at(counts, to, 1)
    return sums, counts


def codes(tree: Forest, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries [vector, part] and summed squared distances [vector], in the vectors' own order."""
    parts, _, width = centres.shape
    n = tree.items.shape[1]
    found = np.empty(parts * n, np.int64)
    whole, single = assign(tree, centres)
    for level, node, entry in whole:
        spans = tree.spans(level)
        at = node & ((1 << level) - 1)
        begin, size = (node >> level) * n + spans[at], spans[at + 1] - spans[at]
        found[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(entry, size)
    for item, entry in single:
        found[item] = entry
    found = found.reshape(parts, n)
    apart = ((tree.items.astype(np.int64) - centres[np.arange(parts)[:, None], found]) ** 2).sum(axis=2)
    code, error = np.empty((n, parts), np.int64), np.zeros(n, np.int64)
    for p in range(parts):
        code[tree.order[p], p] = found[p]
        error[tree.order[p]] += apart[p]
    return code, error


def _packed(tree: Forest) -> dict:
    return {"items": tree.items.astype(np.int32).tobytes(), "order": tree.order.astype(np.int32).tobytes(),
            "low": np.concatenate(tree.low).astype(np.int32).tobytes(),
            "high": np.concatenate(tree.high).astype(np.int32).tobytes(),
            "sums": np.concatenate(tree.sums).tobytes()}


def _unpacked(row: dict, parts: int, width: int) -> Forest:
    items = np.frombuffer(row["items"], np.int32).reshape(parts, -1, width)
    ends = np.cumsum([parts << level for level in range(depth_of(items.shape[1], LEAF) + 1)])[:-1]
    levels = [np.split(np.frombuffer(row[k], t).reshape(-1, width), ends)
              for k, t in (("low", np.int32), ("high", np.int32), ("sums", np.int64))]
    return Forest(items, np.frombuffer(row["order"], np.int32).reshape(parts, -1), *levels)


PACKED = ("items", "order", "low", "high", "sums")


def blocks(vectors: DataFrame, parts: int) -> DataFrame:
    """(ids, labels, trees) rows of (id, label, ints) rows: a row for each batch of vectors."""
    def build(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            points = batch["ints"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, parts, -1)
            tree = _packed(grow(points.transpose(1, 0, 2), LEAF))
            whole = pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(whole, batch["id"]), pa.ListArray.from_arrays(whole, batch["label"]),
                 *[pa.array([tree[k]], pa.binary()) for k in PACKED]], names=["ids", "labels", *PACKED])

    kind = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "label")}
    return vectors.mapInArrow(build, f"ids array<{kind['id']}>, labels array<{kind['label']}>, "
                              + ", ".join(f"{k} binary" for k in PACKED))


def next_centres(made: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The codebooks after one round over the blocks; entries that nothing is nearest to stay."""
    parts, entries, width = centres.shape

    def run(batches):
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                more = gathered(_unpacked(row, parts, width), centres)
                sums += more[0]
                counts += more[1]
        cell = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts[cell]),
                                          *[pa.array(sums[cell, i]) for i in range(width)]],
                                         names=["cell", "n", *[f"s{i}" for i in range(width)]])

    names = ["n", *[f"s{i}" for i in range(width)]]
    rows = (made.select(*PACKED).mapInArrow(run, "cell long, " + ", ".join(f"{c} long" for c in names))
            .groupBy("cell").agg(*[F.sum(c).alias(c) for c in names]))
    out = centres.reshape(-1, width).copy()
    for row in rows.collect():  # parts * entries rows at most
        out[row["cell"]] = [row[c] // row["n"] for c in names[1:]]
    return out.reshape(centres.shape)


def fingerprint(centres: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centres.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES,
                 rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): id, label, codes array<int>, error long of each vector that can be coded.

    A component x counts as floor(256 * x), held within ``largest_component`` of the length.
    Vectors that are null, hold a null, NaN or infinite component, or have another length than
    the first one (by id) whose length is a positive multiple of ``parts`` are dropped. The
    codebooks [part, entry, place] start as the first ``entries`` rows by id, equal ids by
    their components, null ids last; with fewer rows there are fewer entries. Repeated rows
    all count. Null labels stay null; other columns are ignored; an empty table gives no rows
    and codebooks without entries. ``entries`` is at most 256.
    """
    spark = vectors.sparkSession
    ship(spark)
    raw = F.col("raw")
    sound = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("raw")).filter(
        raw.isNotNull() & (F.size(raw) > 0) & (F.size(raw) % parts == 0)
        & ~F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    kinds = ", ".join(f"{c}: {sound.schema[k].dataType.simpleString()}" for c, k in (("id", "id"), ("label", "label")))
    by_id = F.col("id").asc_nulls_last()
    lead = sound.orderBy(by_id, "raw").select(F.size("raw")).first()
    if lead is None:
        empty = spark.createDataFrame([], f"struct<{kinds}, codes: array<int>, error: bigint>")
        return empty.toDF(id_col, label_col, "codes", "error"), np.zeros((parts, 0, 0), np.int64)
    dim = lead[0]
    most = float(largest_component(dim))
    whole = F.transform(raw, lambda x: F.floor(
        F.least(F.greatest(x.cast("double") * SCALE, F.lit(-most)), F.lit(most))).cast("int"))
    ints = sound.filter(F.size(raw) == dim).select("id", "label", whole.alias("ints"))
    seeds = [r["ints"] for r in ints.orderBy(by_id, "ints").limit(entries).collect()]
    centres = np.array(seeds, np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    scratch = Scratch(spark, "vector-codes")
    with small_batches(spark, BLOCK):
        made = scratch.write(blocks(ints, parts), "blocks")

    def code(batches):
        width = centres.shape[2]
        for batch in batches:
            for at, row in enumerate(batch.select(PACKED).to_pylist()):
                found, error = codes(_unpacked(row, parts, width), centres)
                ends = pa.array(np.arange(len(found) + 1) * parts, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch["ids"].slice(at, 1).flatten(), batch["labels"].slice(at, 1).flatten(),
                     pa.ListArray.from_arrays(ends, pa.array(found.ravel(), pa.int32())), pa.array(error)],
                    names=["id", "label", "codes", "error"])

    with small_batches(spark, BLOCKS_AT_ONCE):
        for _ in range(rounds):
            centres = next_centres(made, centres)
        schema = ", ".join([kinds.replace(":", ""), "codes array<int>, error long"])
        out = scratch.write(made.mapInArrow(code, schema), "codes")
    scratch.drop("blocks")
    return out.toDF(id_col, label_col, "codes", "error"), centres


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of ``embeddings`` as hex text, with the summed error of each label."""
    rows, centres = vector_codes(table(spark, sf_dir, "embeddings"))
    by_label = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    text = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return (rows.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
            .select("vec_id", text.alias("code"), "error", "label_error",
                    F.lit(fingerprint(centres)).alias("codebooks_sha256")))


def _round(n: int) -> str:
    return f"""
near{n} AS (
  SELECT q.vec_id, q.p, any_value(q.v) AS v, min({{'d': list_sum([(q.v[i] - e.c[i]) * (q.v[i] - e.c[i])
         FOR i IN range(1, len(q.v) + 1)]), 'e': e.e}}) AS m
  FROM points q JOIN book{n} e ON q.p = e.p GROUP BY q.vec_id, q.p)"""


def _book(n: int) -> str:
    return f"""
book{n} AS (
  SELECT b.p, b.e, coalesce(g.c, b.c) AS c FROM book{n - 1} b LEFT JOIN (
    SELECT p, e, list(c ORDER BY i) AS c FROM (
      SELECT p, m.e AS e, i, CAST(floor(sum(v[i])::DOUBLE / count(*)) AS BIGINT) AS c
      FROM near{n - 1}, range(1, 1 + (SELECT max(len(v)) FROM points)) t(i) GROUP BY p, m.e, i)
    GROUP BY p, e) g ON b.p = g.p AND b.e = g.e)"""


OP11_SQL = """
WITH kept AS (
  SELECT vec_id, label, [CAST(floor(x::DOUBLE * 256) AS BIGINT) FOR x IN embedding] AS v,
         row_number() OVER (ORDER BY vec_id) - 1 AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND list_bool_and([coalesce(isfinite(x), false) FOR x IN embedding])),
points AS (
  SELECT vec_id, label, p, e, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS v FROM kept, range(16) t(p)),
book0 AS (SELECT p, e, v AS c FROM points WHERE e < 64),""" + ",".join(
    [_round(0), _book(1), _round(1), _book(2), _round(2)]) + """,
final AS (
  SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error
  FROM near2 GROUP BY vec_id)
SELECT f.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(c[i]::VARCHAR, ',' ORDER BY p, e, i))
   FROM book2, range(1, 1 + (SELECT max(len(c)) FROM book2)) t(i)) AS codebooks_sha256
FROM final f JOIN kept k USING (vec_id)
"""
