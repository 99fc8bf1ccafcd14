"""Site-relative line frequency: drop lines that too large a share of a host's pages contain.

For each host: the texts that contain a line (trimmed) divided by all texts of the host; equal texts of a host count
once, so many copies of a page don't turn its lines into boilerplate. Lines over ``ratio`` that at least ``min_pages`` texts
contain are boilerplate and go. Counting shuffles two hashes of a line instead of the line and is summed before the
shuffle, so neither a hot host nor a hot line gathers in a task; copies are told apart for the lines that are frequent with
them. A host has at most (lines per page / ratio) boilerplate lines; while all hosts together have
at most ``BROADCAST_LINES`` the lists are broadcast, beyond that rows are joined by line, each line being dealt to ``WAYS`` tasks.

Defined results: a null host counts as the host ''; null texts stay null and count for nothing; blank
lines are never dropped; repeated rows get a row each; an empty table gives an empty result; further columns
are kept as they are, whatever their names, except that ``n_lines`` and ``n_dropped`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

RATIO = 0.05
MIN_PAGES = 3
BROADCAST_LINES = 100_000
WAYS = 16


def _hash(line: Column) -> Column:
    """Two hashes of 64 bits."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _name(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``_host, _line, pages_with, host_pages`` of the lines over the ratio."""
    t = F.col(text)
    texts = pages.filter(t.isNotNull()).select(F.coalesce(F.col(host), F.lit("")).alias("_host"), _name(t).alias("_text"), t.alias("_t"))
    totals = texts.select("_host", "_text").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("host_pages"))
    kept = F.filter(F.transform(_lines(F.col("_t")), lambda x: F.trim(x)), lambda x: x != "")
    each = texts.select("_host", "_text", F.explode(F.array_distinct(F.transform(kept, _hash))).alias("_line"))
    over = (F.col("pages_with") >= min_pages) & (F.col("pages_with") > F.lit(ratio) * F.col("host_pages"))
    count = F.count(F.lit(1)).alias("pages_with")
    likely = cut(each.groupBy("_host", "_line").agg(count).join(totals, "_host").filter(over).select("_host", "_line", "host_pages"))
    once = _dealt(each, "_text", likely, ["_host", "_line"]).select("_host", "_line", "host_pages", "_text").distinct()
    return once.groupBy("_host", "_line", "host_pages").agg(count).filter(over).select("_host", "_line", "pages_with", "host_pages")


def _dealt(rows: DataFrame, by: str, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys``, of which many rows may have the same: they are dealt to copies of the line."""
    copies = lines.withColumn("_way", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(WAYS)])))
    return rows.withColumn("_way", F.pmod(F.xxhash64(by), F.lit(WAYS))).join(copies, [*keys, "_way"])


def _flags(pages: DataFrame, bad: DataFrame, host: str, text: str) -> DataFrame:
    """``_page`` (all columns), ``_bad``: the boilerplate hashes that may occur in each row."""
    h = F.coalesce(F.col(host), F.lit(""))
    # equal rows have equal results: they share one key
    packed = pages.select(h.alias("_host"), F.col(text).alias("_text"), F.struct(h.alias("h"), _name(F.col(text)).alias("t")).alias("_row"), F.struct("*").alias("_page"))
    if bad.count() <= BROADCAST_LINES:
        lists = bad.groupBy("_host").agg(F.collect_list("_line").alias("_bad"))
        return packed.join(F.broadcast(lists), "_host", "left").select("_page", "_text", "_bad")
    each = packed.select("_row", "_host", F.explode(F.array_distinct(F.transform(_lines(F.col("_text")), lambda x: _hash(F.trim(x))))).alias("_line"))
    found = _dealt(each.distinct(), "_row", bad.select("_host", "_line"), ["_host", "_line"]).groupBy("_row").agg(F.collect_list("_line").alias("_bad"))
    return packed.join(found, "_row", "left").select("_page", "_text", "_bad")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns of ``pages`` with ``text`` cleaned, plus ``n_lines`` and ``n_dropped``."""
    bad = cut(boilerplate(pages, host, text, ratio, min_pages).select("_host", "_line"))
    marked = _flags(pages, bad, host, text)
    t, none = F.col("_text"), F.col("_bad").isNull()
    lines = _lines(t)
    keep = F.filter(lines, lambda x: ~F.array_contains(F.col("_bad"), _hash(F.trim(x))) | (F.trim(x) == ""))
    n = F.coalesce(F.when(t.isNotNull(), F.size(lines)), F.lit(0)).cast("bigint")
    clean = F.when(none, t).otherwise(F.array_join(keep, "\n"))
    left = F.when(none | t.isNull(), n).otherwise(F.size(keep).cast("bigint"))
    done = marked.select("_page", F.struct(clean.alias("text"), n.alias("n"), (n - left).alias("dropped")).alias("_done"))
    kept = [F.col("_done.text" if c == text else f"_page.`{c}`").alias(c) for c in pages.columns if c not in ("n_lines", "n_dropped")]
    return done.select(*kept, F.col("_done.n").alias("n_lines"), F.col("_done.dropped").alias("n_dropped"))


ORACLE = f"""
WITH pages AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS ls FROM documents),
totals AS (SELECT host, count(DISTINCT text) AS host_pages FROM pages GROUP BY host),
each AS (SELECT host, text, unnest(list_distinct(list_filter(list_transform(ls, lambda x: trim(x)), lambda x: x <> ''))) AS line FROM pages),
counts AS (SELECT host, line, count(DISTINCT text) AS pages_with FROM each GROUP BY host, line),
bad AS (SELECT c.host, list(c.line) AS bad FROM counts c JOIN totals t ON c.host = t.host
        WHERE c.pages_with >= {MIN_PAGES} AND c.pages_with > {RATIO} * t.host_pages GROUP BY c.host),
kept AS (SELECT p.doc_id, p.text, p.ls, CASE WHEN b.bad IS NULL THEN p.ls
         ELSE list_filter(p.ls, lambda x: NOT list_contains(b.bad, trim(x)) OR trim(x) = '') END AS ks
         FROM pages p LEFT JOIN bad b ON p.host = b.host)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(ks), 0) AS BIGINT) AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE array_to_string(ks, chr(10)) END AS text
FROM kept
"""
