"""Boilerplate lines by site-relative frequency.

For every host, the pages that contain a line are divided by the host's pages; a line above
``max_ratio`` (and on at least ``min_pages`` pages) is boilerplate there and leaves every
page of the host. Each page contributes a line once, so both counts are plain partial
aggregates: a host or a line that holds a third of all rows reaches the shuffle as one row
per task. Per host at most (mean distinct lines of a page) / max_ratio lines can qualify.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storytrack.llm.common import broadcast_if_bytes, cut, fresh, replace_columns, table

MAX_RATIO = 0.1
MIN_PAGES = 3
MAX_BROADCAST_BYTES = 64 << 20  # of boilerplate lists, or of copied texts' hosts and digests


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """Digest of a line without outer blanks; blank lines have none and are never boilerplate."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.md5(bare.cast("binary")))


def _line_keys(rows: DataFrame, *columns: str) -> DataFrame:
    """(columns, _key) of (columns, _text) rows: the digests of a text's lines, each once."""
    keys = F.array_distinct(F.transform(split_lines(F.col("_text")), line_key))
    return rows.select(*columns, F.explode(keys).alias("_key")).filter(F.col("_key").isNotNull())


def boilerplate_lines(pages: DataFrame, host_col: str, text_col: str, max_ratio: float = MAX_RATIO,
                      min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """(host, line digest, pages, host_pages) of the lines above the ratio. Null is a host of its own.

    With ``copies_once`` the equal texts of a host (null and empty ones too) are one page of it.
    """
    own = pages.select(F.col(host_col).alias("_host"), F.col(text_col).alias("_text"))
    if copies_once:
        own = own.withColumn("_copy", F.md5(F.coalesce(F.col("_text"), F.lit("")).cast("binary")))
        texts = own.groupBy("_host", "_copy").agg(F.count(F.lit(1)).alias("_n"))
        totals = texts.groupBy("_host").agg(F.count(F.lit(1)).alias("_total"))
        # Only lines of texts that have copies are made distinct by text: the others are there once.
        copied = cut(texts.filter("_n > 1").select(F.col("_host").alias("_h"), F.col("_copy").alias("_c")))
        copied = broadcast_if_bytes(copied, MAX_BROADCAST_BYTES)
        same = F.col("_host").eqNullSafe(F.col("_h")) & (F.col("_copy") == F.col("_c"))
        lines = _line_keys(own.join(copied, same, "left_anti"), "_host").union(
            _line_keys(own.join(copied, same, "left_semi"), "_host", "_copy").distinct().select("_host", "_key"))
    else:
        totals = own.groupBy("_host").agg(F.count(F.lit(1)).alias("_total"))
        lines = _line_keys(own, "_host")
    counts = (lines.groupBy("_host", "_key").agg(F.count(F.lit(1)).alias("_pages"))
              .filter(F.col("_pages") >= min_pages))
    joined = counts.alias("c").join(totals.alias("t"), F.col("c._host").eqNullSafe(F.col("t._host")))
    return (joined.filter(F.col("_pages") > F.col("_total") * max_ratio)
            .select("c._host", "_key", "_pages", "_total"))


def drop_boilerplate(pages: DataFrame, host_col: str, text_col: str, max_ratio: float = MAX_RATIO,
                     min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """``pages`` with boilerplate lines removed from ``text_col``, plus ``lines_dropped`` (a column of that name is replaced).

    Every row stays, with all its columns, even if no line is left (text ''). Null text stays
    null and counts as a page without lines; pages without a host form one group; repeated
    rows are separate pages, but with ``copies_once`` equal texts of a host count as one page.
    Lines compare without outer blanks; blank lines stay.
    """
    lists = cut(boilerplate_lines(pages, host_col, text_col, max_ratio, min_pages, copies_once)
                .groupBy("_host").agg(F.collect_list("_key").alias("_drop")))
    host, drop = fresh(pages, "_host"), fresh(pages, "_drop")
    lists = lists.withColumnsRenamed({"_host": host, "_drop": drop})
    joined = pages.join(broadcast_if_bytes(lists, MAX_BROADCAST_BYTES),
                        F.col(host_col).eqNullSafe(F.col(host)), "left")
    lines = split_lines(F.col(text_col))
    left = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(drop), line_key(x)), F.lit(False)))
    same = F.col(text_col).isNull() | F.col(drop).isNull()
    dropped = F.when(same, 0).otherwise(F.size(lines) - F.size(left)).cast("long")
    text = F.when(same, F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return replace_columns(joined, **{text_col: text, "lines_dropped": dropped}).select(
        *[F.col(f"`{c}`") for c in pages.columns if c.lower() != "lines_dropped"], "lines_dropped")


def html_lines(html: Column) -> Column:
    """Visible text of a page, one block element per line."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")),
                         r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "\n")
    t = F.regexp_replace(t, r"(?i)</?(p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|nav|article|section|header|footer|"
                            r"title|head|body|html)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(t, r"[ \t\r]*\n[ \t\r\n]*", "\n"), F.lit(" \t\r\n"))


def url_host(url: Column) -> Column:
    """Lower-case host of a URL; '' where there is none, null for a null URL."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def op8_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text without its site's boilerplate lines."""
    pages = cut(table(spark, sf_dir, "pages").select("page_id", url_host(F.col("url")).alias("host"),
                                                     html_lines(F.col("html")).alias("text")))  # read twice below
    kept = drop_boilerplate(pages, "host", "text")
    return kept.select("page_id", "host", "lines_dropped", "text")


OP8_SQL = r"""
WITH raw AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', chr(10), 'g'),
      '(?i)</?(p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|nav|article|section|header|footer|title|head|body|html)\b[^>]*>',
      chr(10), 'g'), '<[^>]*>', '', 'g') AS t
  FROM pages),
plain AS (
  SELECT page_id, host, trim(regexp_replace(
    replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
      '&nbsp;', ' '), '&amp;', '&'),
    '[ \t\r]*\n[ \t\r\n]*', chr(10), 'g'), chr(32) || chr(9) || chr(13) || chr(10)) AS text
  FROM raw),
lines AS (
  SELECT page_id, host, i, parts[i] AS line, trim(parts[i], chr(32) || chr(9) || chr(13)) AS bare
  FROM (SELECT page_id, host, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
        FROM plain)),
totals AS (SELECT host, count(*) AS total FROM plain GROUP BY 1),
bad AS (
  SELECT host, bare FROM (SELECT host, bare, count(DISTINCT page_id) AS n FROM lines WHERE bare <> '' GROUP BY 1, 2)
  JOIN totals USING (host) WHERE n >= 3 AND n > total * 0.1)
SELECT l.page_id, l.host, count(b.bare) AS lines_dropped,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (b.bare IS NULL), '') AS text
FROM lines l LEFT JOIN bad b ON l.host = b.host AND l.bare = b.bare
GROUP BY 1, 2
"""
