"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive tokens; positions marked 0 are ignored, so a
substituted word there does not hide an overlap. Hashes of the masked windows of the
benchmark are joined with those of the documents, and every hit is verified: a span of
aligned tokens at the hit must agree in at least ``min_match`` of its positions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storytrack.llm.common import cut, table

# Fixed masks of weight 6 for items of VERIFY_TOKENS words or more, and of weight 4 for shorter
# ones; all start and end with a selected position. Of the ways to substitute as many words as
# MIN_MATCH allows, the first miss at most 0.7 % (20 words; none from 23 on), the second none.
MASKS = ["111011001", "1101001011", "10110100101"]
SHORT_MASKS = ["1111", "10111", "11011", "11101"]
SPAN = max(map(len, MASKS))
# Items of fewer words are sought as whole texts: as a passage they are in texts of any kind.
MIN_TOKENS = 5
VERIFY_TOKENS = 20
MIN_MATCH = 0.8
# Hash rows of the benchmark per broadcast (under 500 bytes a row); more go in further blocks.
BLOCK_ROWS = 100_000
# Texts are hashed in parts of so many words, with a margin that covers any verification.
PART, MARGIN = 2048, VERIFY_TOKENS


def _parts(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """Texts as overlapping parts of word hashes: _id, _n (words in all), _first, _base, _words.

    Words are the lower-case runs of letters and digits. ``_words`` starts at the text's word
    ``_base``; the part's own places are the ``PART`` words from ``_first`` on.
    """
    found = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    words = rows.select(F.col(ident).alias("_id"), found.alias("_w"))
    firsts = words.select("_id", "_w", F.explode(F.sequence(
        F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0)), F.lit(PART))).alias("_first"))
    base = F.greatest(F.col("_first") - MARGIN, F.lit(0))
    cut_out = firsts.select("_id", F.size("_w").alias("_n"), "_first", base.alias("_base"),
                            F.slice("_w", base + 1, F.lit(PART + 2 * MARGIN)).alias("_part"))
    return cut_out.select("_id", "_n", "_first", "_base",
                          F.transform("_part", lambda w: F.xxhash64(w)).alias("_words"))


def _places(parts: DataFrame, masks: dict[int, str]) -> DataFrame:
    """One row per place of a part and mask that fits there: adds _at (place in _words) and _seed."""
    shortest = min(map(len, masks.values()))
    start = F.col("_first") - F.col("_base")
    stop = F.least(F.col("_first") + PART - 1, F.col("_n") - shortest) - F.col("_base")
    at = parts.select("*", F.explode(F.when(stop >= start, F.sequence(start, stop))).alias("_at"))
    seeds = []
    for name, mask in masks.items():
        picked = [F.get(F.col("_words"), F.col("_at") + i) for i, bit in enumerate(mask) if bit == "1"]
        seed = F.xxhash64(F.lit(name), *picked)
        seeds.append(F.when(F.col("_base") + F.col("_at") + len(mask) <= F.col("_n"), seed))
    return at.select("*", F.explode(F.array(*seeds)).alias("_seed")).filter(F.col("_seed").isNotNull())


def _near(places: DataFrame, *others: str) -> DataFrame:
    """The words around each place instead of its part: _near, and _p, the place in it."""
    start = F.greatest(F.col("_at") - MARGIN, F.lit(0))
    return places.select(*others, F.slice("_words", start + 1, F.lit(2 * MARGIN)).alias("_near"),
                         (F.col("_at") - start).alias("_p"))


def _agrees(first: Column, n: Column) -> Column:
    """Whether enough of the n item tokens from ``first`` on equal the document's aligned ones."""
    shift = first - F.col("_from")
    same = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.get("_near", F.col("_p") + shift + k)
                    == F.get("_item_near", F.col("_item_p") + shift + k))
    return F.size(same) >= n * MIN_MATCH


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, item) pairs of the documents that hold a passage of a benchmark item, each once.

    Two windows are verified for a hit: the ``VERIFY_TOKENS`` (the whole item if shorter)
    item tokens that start with the hit and those that end with it, moved inside the item;
    one must agree in ``MIN_MATCH`` of its positions. Items of under ``MIN_TOKENS`` words match
    the documents that consist of just these words. The benchmark's hashes are broadcast
    in blocks of about ``block_rows`` rows, so a benchmark of any size is handled with
    bounded memory. Null ids form a document of their own; null texts and texts without words
    match nothing; repeated rows count once; empty tables give no rows.
    """
    items = cut(_parts(benchmark, item_col, item_text_col).filter(F.col("_n") > 0))
    long, short = dict(enumerate(MASKS)), {10 + k: m for k, m in enumerate(SHORT_MASKS)}
    few, tiny = (F.col("_n") >= MIN_TOKENS) & (F.col("_n") < VERIFY_TOKENS), F.col("_n") < MIN_TOKENS
    has = items.agg(F.coalesce(F.bool_or(few), F.lit(False)), F.coalesce(F.bool_or(tiny), F.lit(False))).first()
    masks = long | (short if has[0] else {})
    own = ("_id", "_n", (F.col("_base") + F.col("_at")).alias("_from"), "_seed")
    seeds = _near(_places(items.filter(F.col("_n") >= VERIFY_TOKENS), long), *own)
    if has[0]:
        seeds = seeds.unionByName(_near(_places(items.filter(few), short), *own))
    seeds = cut(seeds.select(F.col("_id").alias("_item"), F.col("_n").alias("_m"), "_from", "_seed",
                             F.col("_near").alias("_item_near"), F.col("_p").alias("_item_p")).distinct())
    blocks = max(1, math.ceil(seeds.count() / block_rows))
    places = _places(_parts(docs, id_col, text_col), masks)
    n = F.least(F.col("_m"), F.lit(VERIFY_TOKENS))
    head = F.least(F.col("_from"), F.col("_m") - n)
    tail = F.greatest(F.least(F.col("_from") + SPAN, F.col("_m")) - n, F.lit(0))
    found = []
    for b in range(blocks):
        block = seeds if blocks == 1 else seeds.filter(F.pmod(F.xxhash64("_item", "_from"), F.lit(blocks)) == b)
        hits = _near(places.join(F.broadcast(block), "_seed"), "_id", "_item", "_m", "_from", "_item_near", "_item_p")
        found.append(hits.groupBy("_id", "_item").agg(F.max(_agrees(head, n) | _agrees(tail, n)).alias("_ok"))
                     .filter("_ok").select(F.col("_id").alias(id_col), F.col("_item").alias(item_col)))
    if has[1]:
        whole = items.filter(tiny).select(F.col("_id").alias(item_col), "_words").distinct()
        texts = _parts(docs, id_col, text_col).filter((F.col("_n") > 0) & tiny).select(F.col("_id").alias(id_col), "_words")
        found.append(texts.join(whole, "_words").select(id_col, item_col).distinct())
    return found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found).distinct()


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document id: id, contaminated, n_items, items (sorted). See :func:`contaminated`."""
    pairs = contaminated(docs, benchmark, id_col, text_col, item_col, item_text_col)
    every = docs.select(F.col(id_col), F.lit(None).cast(pairs.schema[item_col].dataType).alias(item_col))
    return (every.unionByName(pairs).groupBy(id_col)
            .agg(F.array_sort(F.collect_set(item_col)).alias("items"))
            .select(id_col, (F.size("items") > 0).alias("contaminated"), F.size("items").alias("n_items"), "items"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents: one row for each, with the benchmark items that it holds."""
    marked = mark_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.filter("contaminated").select(
        "doc_id", "contaminated", "n_items",
        F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


def _sql() -> str:
    def key(mask: str, at: str) -> str:
        return " || ' ' || ".join(f"w[{at} + {i}]" for i, bit in enumerate(mask) if bit == "1")

    def windows(source: str, ident: str, masks: list[str], name: str, where: str = "true") -> str:
        return " UNION ALL ".join(
            f"SELECT {ident}, w, a, '{name}{n} ' || {key(m, 'a')} AS k FROM (SELECT {ident}, w, "
            f"unnest(range(1, len(w) - {len(m)} + 2)) AS a FROM {source} WHERE len(w) >= {len(m)} AND {where})"
            for n, m in enumerate(masks))
    words = (r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')")
    agree = ("len(list_filter(range(0, n), lambda k: (base + f + k) >= 1 AND (base + f + k) <= len(dw)"
             " AND dw[base + f + k] = iw[f + k]))")
    return rf"""
WITH items AS (SELECT DISTINCT * FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
docs AS (SELECT doc_id, {words} AS w FROM documents),
iw AS ({windows('items', 'item_id', MASKS, 'l', f'len(w) >= {VERIFY_TOKENS}')} UNION ALL
  {windows('items', 'item_id', SHORT_MASKS, 's', f'len(w) >= {MIN_TOKENS} AND len(w) < {VERIFY_TOKENS}')}),
dw AS ({windows('docs', 'doc_id', MASKS, 'l')} UNION ALL {windows('docs', 'doc_id', SHORT_MASKS, 's')}),
hits AS (
  SELECT doc_id, item_id, dw.w AS dw, iw.w AS iw, dw.a - iw.a AS base, iw.a AS at_item,
    least(len(iw.w), {VERIFY_TOKENS}) AS n
  FROM dw JOIN iw USING (k)),
tries AS (
  SELECT doc_id, item_id, dw, iw, base, n, least(at_item, len(iw) - n + 1) AS f FROM hits
  UNION ALL
  SELECT doc_id, item_id, dw, iw, base, n, greatest(least(at_item + {SPAN}, len(iw) + 1) - n, 1) FROM hits),
pairs AS (
  SELECT doc_id, item_id FROM tries WHERE {agree} >= n * {MIN_MATCH}
  UNION SELECT doc_id, item_id FROM docs JOIN items ON docs.w = items.w WHERE len(items.w) < {MIN_TOKENS})
SELECT doc_id, true AS contaminated, count(*) AS n_items, string_agg(item_id::varchar, ',' ORDER BY item_id) AS items
FROM pairs GROUP BY doc_id
"""


OP9_SQL = _sql()
