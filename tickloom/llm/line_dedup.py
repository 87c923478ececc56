"""Line deduplication by site-relative frequency. DataFrame functions only.

Within a host, a line's share is the number of the host's pages that contain it over the host's
page total. Lines whose share exceeds `ratio` (and that stand on at least `min_pages` pages) are
boilerplate of that site and are dropped from its pages. A host's pages hold at most
(lines per page / ratio) such lines, so a host's list is bounded however large the host is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import common

RATIO, MIN_PAGES = 0.1, 5


def boilerplate(docs: DataFrame, host: Column, ratio: float, min_pages: int, text_col: str = "text") -> DataFrame:
    """(host key, hashes of its boilerplate lines). Counts are combined before the shuffle by host
    and line, so neither a hot host nor a hot line gathers rows in one task."""
    pages = docs.select(_key(host).alias("k"), F.col(text_col).alias("t"))
    lines = pages.select("k", F.explode(F.array_distinct(F.split("t", "\n", -1))).alias("line")).where(F.trim("line") != "")
    counts = lines.select("k", F.xxhash64("line").alias("h")).groupBy("k", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy("k").agg(F.count("*").alias("total"))
    over = common.stage(counts, "line-counts").join(common.stage(totals, "host-totals"), "k").where(F.col("n") > F.col("total") * F.lit(ratio))
    return over.groupBy("k").agg(F.collect_set("h").alias("drop"))


def _key(host: Column) -> Column:
    """A host, or the group of pages without one."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


def line_dedup(docs: DataFrame, host: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, text_col: str = "text") -> DataFrame:
    """docs with text_col cleaned, plus `ld_lines` (lines before) and `ld_removed` (lines dropped).

    Lines end at "\\n" and are compared whole (by 64-bit hash); blank lines are kept. Defined
    results: an empty table gives no rows; a null text stays null with 0 lines; an empty text is
    one blank line; pages without a host form one group; repeated rows count as pages each; columns
    of other names are untouched, those named like the two are replaced."""
    key, k, drop, rest = common.unused(docs, "ld_key", "ld_k", "ld_drop", "ld_kept")
    found = common.stage(boilerplate(docs, host, ratio, min_pages, text_col).select(F.col("k").alias(k), F.col("drop").alias(drop)), "boilerplate")
    joined = docs.withColumn(key, _key(host)).join(found, F.col(key) == F.col(k), "left")
    lines = F.split(text_col, "\n", -1)
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(drop), F.xxhash64(x)))
    out = joined.withColumn(rest, F.when(F.col(drop).isNull(), lines).otherwise(kept))
    out = out.withColumn("ld_lines", F.coalesce(F.size(lines), F.lit(0))).withColumn("ld_lines", F.greatest("ld_lines", F.lit(0)))
    out = out.withColumn("ld_removed", F.col("ld_lines") - F.greatest(F.coalesce(F.size(rest), F.lit(0)), F.lit(0)))
    return out.withColumn(text_col, F.array_join(rest, "\n")).drop(key, k, drop, rest)


def page_host(url: Column) -> Column:
    """Lower-case host of a URL, without a user or port; null when there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def page_lines(html: Column) -> Column:
    """Visible text of a raw page, one block element a line."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    broken = F.regexp_replace(bare, r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|nav|article|section|header|footer|title|head|body|html|main|aside)\b[^>]*>", "\n")
    text = F.regexp_replace(broken, r"<[^>]*>", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t\r]+", " "), r" ?(?:\n ?)+", "\n"), r"^\s+|\s+$", "")


ORACLE_SQL = """
WITH lines AS (
  SELECT DISTINCT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents
), counts AS (
  SELECT source, line, count(*) AS n FROM lines WHERE trim(line, ' ') <> '' GROUP BY source, line
), totals AS (
  SELECT source, count(*) AS total FROM documents GROUP BY source
), gone AS (
  SELECT c.source, list(c.line) AS lines FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= 5 AND c.n > t.total * CAST(0.1 AS DOUBLE) GROUP BY c.source
), split AS (
  SELECT d.doc_id, string_split(d.text, chr(10)) AS all_lines, coalesce(g.lines, []) AS drop_lines
  FROM documents d LEFT JOIN gone g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, CAST(coalesce(len(all_lines), 0) AS INT) AS n_lines,
       CAST(coalesce(len(all_lines) - len(list_filter(all_lines, lambda x: NOT list_contains(drop_lines, x))), 0) AS INT) AS n_removed,
       array_to_string(list_filter(all_lines, lambda x: NOT list_contains(drop_lines, x)), chr(10)) AS text
FROM split
"""
