"""Source divergence audit: how far each source's use of terms is from the others' in its language.

In-mapper stripes: a task folds whole documents into hash tables of stripes, term to
(documents, occurrences by source), and writes them out whenever they have grown to ``CELLS``
entries and at its end, so only one stripe per term and table leaves a task, never one row per
word. A table is a dictionary from terms to numbers and arrays of (term, source) cells, so
words cost a look-up each and everything else is done by arrays. Stripes are merged by key. Rare terms go first, by their document frequency alone; the
kept terms' stripes are merged per source and cut into tiles of ``TILE`` sources, so a stripe
is bounded however many sources a language has.

The merged stripes give the divergences directly: terms are dealt into buckets by their hash,
and a group (language, two tiles, bucket) adds up the differences of its pairs of sources
over its own terms only. A term that neither of two sources has differs by a constant, so
such terms are counted, not visited. Every share is a whole number of billionths.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storytrack.llm.common import Scratch, broadcast_if_bytes, ship, small_batches, table, trim_memory

LEAST_DOCUMENTS = 30
TOP_TERMS = 50
ADDED = 5  # to every count
CELLS = 500_000  # terms, or (term, source) cells beyond them, that a task holds (some 150 MB)
TILE = 256  # sources of a tile
BUCKET = 2048  # terms that a group is meant to hold
PIECE = 1 << 22  # bytes of a text that are cut into terms at a time
TEXTS_AT_ONCE = 500
ROWS_OUT = 20_000  # stripes in a batch that leaves Python
MAX_BROADCAST_BYTES = 64 << 20  # of kept terms
STEPS = (1000, 1000, 1000)  # a billion, in factors that keep every product below 2**63

# Letters and bytes of other scripts stay, A-Z lower-cased; everything else ends a term.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a whole text, however long, a piece of it at a time."""
    data = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE) if at + PIECE < len(data) else len(data)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
    return keys[first], *[np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


class Stripes:
    """The stripes of one language in a task: term numbers, and cells (term << 20 | source, docs, n)."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.sources: dict[str, int] = defaultdict(count().__next__)
        self.cells = [np.empty(0, np.int64)] * 3
        self.new: list = []
        self.size = 0

    def add(self, rows: list[tuple[str, str]]) -> None:
        """Fold whole documents (source, text) in."""
        held = []
        for doc, (_, text) in enumerate(rows):
            for words in terms(text):
                codes = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
                ones = np.ones(len(codes), np.int64)
                if len(codes) > PIECE >> 4:  # a piece of a long text
                    codes, ones = _summed(codes, ones)
                held.append((codes | doc << 40, ones))
        if not held:
            return
        keys, n = _summed(*map(np.concatenate, zip(*held, strict=True)))
        source = np.array([self.sources[s] for s, _ in rows], np.int64)
        keys = (keys & (1 << 40) - 1) << 20 | source[keys >> 40]
        self.new.append(_summed(keys, np.ones(len(keys), np.int64), n))
        self.size += len(self.new[-1][0])
        if self.size > len(self.cells[0]):  # as many new cells as old ones: merge them
            self.merge()

    def merge(self) -> None:
        self.cells = list(_summed(*[np.concatenate(x) for x in zip(self.cells, *self.new, strict=True)]))
        self.new, self.size = [], 0

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        self.merge()
        keys, docs, n = self.cells
        if not len(keys):
            return
        first = np.flatnonzero(np.r_[True, (keys[1:] >> 20) != (keys[:-1] >> 20)])
        names = pa.array(list(self.sources), pa.string()).take(pa.array(keys & (1 << 20) - 1))
        ends = pa.array(np.r_[first, len(keys)].astype(np.int32))
        batch = pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(lang, pa.string()), len(first)), pa.array(list(self.number), pa.binary()).cast(pa.string()),
             pa.array(np.add.reduceat(docs, first)), pa.array(np.add.reduceat(n, first)),
             pa.ListArray.from_arrays(ends, names), pa.ListArray.from_arrays(ends, pa.array(n))],
            names=["lang", "term", "docs", "n", "sources", "counts"])
        for at in range(0, batch.num_rows, ROWS_OUT):
            yield batch.slice(at, ROWS_OUT)


def stripes(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """(lang, term, docs, n, sources, counts) stripes of (lang, source, text) rows without nulls."""
    def run(batches):
        held: dict[str, Stripes] = defaultdict(Stripes)
        for batch in batches:
            by_lang, size = defaultdict(list), defaultdict(int)
            for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
                by_lang[lang].append((source, text))
                size[lang] += len(text)
                if size[lang] > PIECE:
                    held[lang].add(by_lang.pop(lang))
                    size[lang] = 0
            for lang, rows in by_lang.items():
                held[lang].add(rows)
            if sum(len(x.number) + len(x.sources) + max(0, len(x.cells[0]) - cells) for x in held.values()) >= cells:
                for lang, x in held.items():
                    yield from x.rows(lang)
                held.clear()
        for lang, x in held.items():
            yield from x.rows(lang)
        held.clear()
        trim_memory()

    return docs.mapInArrow(run, "lang string, term string, docs long, n long, sources array<string>, counts array<long>")


def share(count, total, terms):
    """1 + floor(10**9 * (count + 5) / (total + 5 * terms)), exactly for totals up to 9e15."""
    rest, whole = count + ADDED, total + ADDED * terms
    out = rest * 0
    for step in STEPS:
        rest = rest * step
        out = out * step + rest // whole
        rest = rest % whole
    return 1 + out


def compared(pairs: DataFrame, tiles: DataFrame, top: int) -> DataFrame:
    """(source, other, term, value, floor): a row for each two sources or for a source and a term.

    ``pairs`` holds merged stripes (lang, i, j, bucket, tile, term, n, places, counts) of the
    tiles i <= j, and ``tiles`` for every such group the sources and totals of both tiles.
    """
    def run(key, left, right):
        fact = right.iloc[0]
        names, totals = {}, {}
        for t, side in ((key[1], "i"), (key[2], "j")):
            names[t], totals[t] = list(fact[f"names_{side}"]), np.array(fact[f"totals_{side}"], np.int64)
        terms, all_n = int(fact["terms"]), int(fact["all_n"])
        out = []
        row, label = np.unique(left["term"].to_numpy(dtype=object), return_inverse=True) if len(left) else ([], [])
        seen = {t: np.zeros((len(row), len(totals[t])), np.int64) for t in totals}
        every = np.zeros(len(row), np.int64)
        for at, t, n, places, counts in zip(label, left["tile"], left["n"], left["places"], left["counts"], strict=True):
            seen[t][at, places] = counts
            every[at] = n
        if terms:
            p = {t: share(seen[t], totals[t][None, :], terms) for t in totals}
            none = {t: share(np.zeros_like(totals[t]), totals[t], terms) for t in totals}
        a, b = key[1], key[2]
        for s, name in enumerate(names[a]):
            if terms:
                apart = np.abs(none[b] - none[a][s])
                # Terms of the bucket exactly; all others, once, in the first bucket.
                value = np.abs(p[b] - p[a][:, s:s + 1]).sum(axis=0) - len(row) * apart
                value += terms * apart if key[3] == 0 else 0
            else:
                value = np.zeros(len(names[b]), np.int64)
            ones, others, values = [], [], []
            for o, other in enumerate(names[b]):
                if a != b or s != o:
                    ones.append(name)
                    others.append(other)
                    values.append(value[o])
            out.append(pd.DataFrame({"source": ones, "other": others, "value": values}))
            if a != b:
                out.append(pd.DataFrame({"source": others, "other": ones, "value": values}))
            if a == b and len(row):
                more = p[a][:, s] - share(every, all_n, terms)
                at = np.flatnonzero((seen[a][:, s] > 0) & (more > 0))
                # np.unique sorts by code point, as UTF-8 does: the first of equals stay.
                at = at[np.argsort(-more[at], kind="stable")][:top]
                out.append(pd.DataFrame({"source": name, "term": row[at], "value": more[at]}))
        made = pd.concat(out) if out else pd.DataFrame()
        made = made.reindex(columns=["source", "other", "term", "value"])
        made.insert(0, "lang", key[0])
        return made.astype(object).where(made.notna(), None)

    by = ["lang", "i", "j", "bucket"]
    return pairs.groupBy(*by).cogroup(tiles.groupBy(*by)).applyInPandas(
        run, "lang string, source string, other string, term string, value long")


def divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, tile: int = TILE, bucket: int = BUCKET,
                cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group of ``docs``.

    Null text, language and source count as ''. Terms are runs of letters A-Z, a-z and
    non-ASCII characters, A-Z lower-cased; a language keeps those in at least ``least`` of its
    documents, whole texts and repeated rows all counting. A share is
    ``1 + floor(10**9 * (count + 5) / (N + 5 * V))``. Part ``pair``: the summed differences to
    each other source of the language over all kept terms, 0 without kept terms. Part ``term``:
    the ``top`` terms whose share in the source is above the language's. Equal values are
    ranked by item in UTF-8 order. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "divergence")

    def plain(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))

    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).alias("text"))
    with small_batches(spark, TEXTS_AT_ONCE):
        folded = scratch.write(stripes(rows, cells), "stripes")
    kept = scratch.write(folded.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
                         .filter(F.col("docs") >= least), "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("all_n"))
    cell = F.explode(F.arrays_zip("sources", "counts")).alias("cell")
    merged = scratch.write(
        folded.join(broadcast_if_bytes(kept.select("lang", "term"), MAX_BROADCAST_BYTES), ["lang", "term"], "left_semi")
        .select("lang", "term", cell)
        .groupBy("lang", "term", F.col("cell.sources").alias("source")).agg(F.sum("cell.counts").alias("c")), "merged")
    # Every group of the documents, with its number in the language and its total.
    totals = merged.groupBy("lang", "source").agg(F.sum("c").alias("total"))
    groups = rows.groupBy("lang", "source").agg(F.lit(0).alias("_"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    facts = scratch.write(
        groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"),
                F.coalesce("all_n", F.lit(0)).alias("all_n"), number.alias("_number"))
        .select("*", F.floor(F.col("_number") / tile).cast("int").alias("tile"), (F.col("_number") % tile).alias("place")),
        "facts")
    many = F.ceil((F.max("terms") + 1) / F.lit(bucket)).cast("int").alias("buckets")
    spread = facts.groupBy("lang").agg((F.max("tile") + 1).alias("tiles"), many)
    places = F.sort_array(F.collect_list(F.struct("place", "c")))
    by_tile = (merged.join(facts.select("lang", "source", "tile", "place"), ["lang", "source"])
               .groupBy("lang", "term", "tile").agg(places.alias("cells"))
               .join(kept.select("lang", "term", "n"), ["lang", "term"]).join(spread, "lang"))
    partner = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("_other")
    pairs = (by_tile.select("*", partner)
             .select("lang", F.least("tile", "_other").alias("i"), F.greatest("tile", "_other").alias("j"),
                     F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), "tile", "term", "n",
                     F.transform("cells", lambda x: x.place).alias("places"), F.transform("cells", lambda x: x.c).alias("counts")))
    members = F.sort_array(F.collect_list(F.struct("place", "source", "total")))
    side = facts.groupBy("lang", "tile").agg(members.alias("m"), F.max("terms").alias("terms"), F.max("all_n").alias("all_n"))

    def sides(k: str) -> list:
        return [F.col("tile").alias(k), F.transform("m", lambda x: x.source).alias(f"names_{k}"),
                F.transform("m", lambda x: x.total).alias(f"totals_{k}")]

    tiles = (side.select("lang", "terms", "all_n", *sides("i")).join(side.select("lang", *sides("j")), "lang")
             .filter(F.col("i") <= F.col("j")).join(spread.select("lang", "buckets"), "lang")
             .withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).drop("buckets"))
    found = scratch.write(compared(pairs, tiles, top), "found")
    scratch.drop("stripes")
    pair = (found.filter(F.col("other").isNotNull()).groupBy("lang", "source", F.col("other").alias("item"))
            .agg(F.sum("value").alias("value")))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranked.alias("rank"))
    term = (found.filter(F.col("term").isNotNull())
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
            .withColumn("rank", ranked)
            .filter(F.col("rank") <= top))
    return pair.unionByName(term)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
w AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 30),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
g AS (
  SELECT g.lang, g.source, coalesce(l.v, 0)::HUGEINT AS v, coalesce(l.total, 0)::HUGEINT AS all_n,
    coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN langs l USING (lang)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS p,
    1 + (1000000000 * (k.n + 5)) // (g.all_n + 5 * g.v) AS q
  FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
              WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""
