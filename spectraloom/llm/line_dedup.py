"""Line dedup by site-relative frequency, with DataFrame functions only.

Method. Pages are grouped by host. A line's frequency is the number of the host's pages that contain it, divided by
the host's pages. Lines above ``ratio`` (and on ``least`` pages, so that a handful of pages makes no boilerplate) are
dropped from all pages of that host. With ``distinct``, as in the query and its SQL, every different text of a host is a
page, so that the lines of a text with many exact copies are no boilerplate; without, every row is one. Near copies
are different texts and count each.

Scale. Each page names a line once, as a 64-bit hash, and (host, line) pairs are counted with a combine before the
shuffle, so neither a hot host nor a hot line gathers. With ``distinct`` a page's hashes meet its copies' by the hash
of the text first, again with a combine. A host cannot have more than (mean lines per page / ratio)
boilerplate lines; the lists per host are broadcast if all of them together are few, else joined by host. The text
itself is not shuffled in the first case.

Defined cases: null text stays null; blank lines are kept and not counted; pages without a host are kept whole (no
site to compare with); a line repeated within a page counts once and is dropped everywhere; all other columns,
whatever their names, are kept as they are, but for ``n_lines`` and ``n_dropped``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spectraloom.llm.common import BROADCAST_ROWS, Scratch

RATIO = 0.02
LEAST = 10


def line_key(line: Column) -> Column:
    return F.xxhash64(line)


def filled(line: Column) -> Column:
    return F.trim(line) != ""


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, least: int = LEAST,
                distinct: bool = False) -> DataFrame:
    """(host, key): hashes of the lines on more than ``ratio`` of the host's pages and on ``least`` pages."""
    lines = F.filter(F.split(text, "\n"), filled)
    held = pages.select(host.alias("host"), F.xxhash64(text).alias("page"),
                        F.array_distinct(F.transform(lines, line_key)).alias("keys")).where("host is not null")
    if distinct:
        held = held.groupBy("host", "page").agg(F.first("keys").alias("keys"))
    totals = held.groupBy("host").agg(F.count("*").alias("pages"))
    counts = (held.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
              .where(F.col("n") >= least))
    return counts.join(totals, "host").where(F.col("n") > F.col("pages") * ratio).select("host", "key")


def drop_lines(pages: DataFrame, host: Column | str = "source", text_col: str = "text", ratio: float = RATIO,
               least: int = LEAST, scratch: Scratch | None = None, limit: int = BROADCAST_ROWS,
               distinct: bool = False) -> DataFrame:
    """The pages with cleaned text, and ``n_lines`` (filled lines before) and ``n_dropped``."""
    row = marked_pages(pages, host, text_col, ratio, least, scratch, limit, distinct)
    kept = [F.col("cleaned").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in pages.columns]
    return row.select(*[c for c, name in zip(kept, pages.columns) if name not in ("n_lines", "n_dropped")],
                      "n_lines", "n_dropped")


def marked_pages(pages: DataFrame, host: Column | str = "source", text_col: str = "text", ratio: float = RATIO,
                 least: int = LEAST, scratch: Scratch | None = None, limit: int = BROADCAST_ROWS,
                 distinct: bool = False) -> DataFrame:
    """(row, cleaned, n_lines, n_dropped): the page's own columns are in ``row``, so no names clash."""
    scratch = scratch or Scratch(pages.sparkSession, "lines")
    host = F.col(f"`{host}`") if isinstance(host, str) else host
    held = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host.alias("site"),
                        F.col(f"`{text_col}`").alias("text"))
    found = scratch.keep(boilerplate(held, F.col("site"), F.col("text"), ratio, least, distinct), "boilerplate")
    few = found.limit(limit + 1).count() <= limit
    lists = found.groupBy("host").agg(F.collect_list("key").alias("keys"))
    joined = held.join(F.broadcast(lists) if few else lists, F.col("site") == F.col("host"), "left")
    lines = F.split("text", "\n")
    # the page's own boilerplate first: short, so that every line is compared with few keys
    own = F.array_intersect(F.transform(lines, line_key), F.coalesce("keys", F.array().cast("array<bigint>")))
    joined = joined.withColumn("own", own)
    dropped = F.filter(lines, lambda x: filled(x) & F.array_contains("own", line_key(x)))
    cleaned = F.array_join(F.filter(lines, lambda x: ~(filled(x) & F.array_contains("own", line_key(x)))), "\n")
    some = F.size("own") > 0
    return joined.select(
        "row", F.when(some, cleaned).otherwise(F.col("text")).alias("cleaned"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(lines, filled))).cast("long").alias("n_lines"),
        F.when(some, F.size(dropped)).otherwise(0).cast("long").alias("n_dropped"))


SQL = f"""
WITH lines AS (SELECT doc_id, source AS host, text, string_split(text, chr(10)) AS lines FROM documents),
pages AS (SELECT DISTINCT host, text, lines FROM lines WHERE host IS NOT NULL),
totals AS (SELECT host, count(*) AS pages FROM pages GROUP BY host),
each AS (SELECT host, line FROM (SELECT host, text, unnest(list_distinct(lines)) AS line FROM pages) WHERE trim(line) <> ''),
bad AS (SELECT host, list(line) AS drops FROM (SELECT host, line, count(*) AS n FROM each GROUP BY host, line)
        JOIN totals USING (host) WHERE n >= {LEAST} AND n > pages * CAST({RATIO} AS DOUBLE) GROUP BY host),
marked AS (SELECT l.*, coalesce(drops, []) AS drops FROM lines l LEFT JOIN bad b ON l.host = b.host)
SELECT doc_id, host AS source,
       array_to_string(list_filter(lines, lambda x: NOT (trim(x) <> '' AND list_contains(drops, x))), chr(10)) AS text,
       CAST(coalesce(len(list_filter(lines, lambda x: trim(x) <> '')), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(list_filter(lines, lambda x: trim(x) <> '' AND list_contains(drops, x))), 0) AS BIGINT)
           AS n_dropped
FROM marked"""
