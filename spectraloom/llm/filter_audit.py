"""How text filters interact: what each removes in every order, with DataFrame functions only.

Method. Every document gets a mask of the filters that it fails. Masks are counted per part (language) with the labels
that matter, so a part has at most 2**filters cells. All orders of the filters are one literal array that goes to
every task with the plan. Each cell folds across that array: ``transform`` walks the orders, ``aggregate`` walks the
filters of an order and carries whether the cell's documents are still there. That gives one struct per order and
step, weighted with the cell's counts; a part's cells are merged by elementwise sums (``zip_with``). The sums of a
filter over all orders are folded from the merged structs.

Filters (letter and failure): A under 200 words; B fewer distinct words than half of the words; C more than 3 % of the
code points are A-Z; D one of ``#$%&*|`` occurs; E the text is that of a smaller id, removed or not. A word is a run of
characters other than space and \\x09-\\x0D; case counts.

Scale. One scan judges the texts; what travels is an id, a text's SHA-256, the part and four bits. Copies are found on
counts: rows are summed per (hash, part, mask, labels) before they meet, so a text that holds a third of all rows
arrives as a few rows per task. No document is joined with its copies. The folds work on cells, 32 a part at most.

Defined cases: a null text is empty; a null part is the empty string; a row without an id has no smaller id and is no
one's; rows repeated with one id count each, and fail E only if a smaller id has their text; a document without a
label, or with a null one, is neither good nor toxic, and of several labels of one id the largest counts; an empty
table gives an empty result; other columns are dropped, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
LEAST_WORDS = 200
SIGNS = "[#$%&*|]"
#: What is counted for every order and step.
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def words_of(text: Column) -> Column:
    """The words: white space becomes a space, and nothing between two spaces is no word."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def text_mask(text: Column, words: Column) -> Column:
    """Bits of the filters that a text fails by itself (A to D)."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < LEAST_WORDS, 100 * distinct.cast("long") < 50 * n.cast("long"),
             100 * capitals.cast("long") > 3 * F.length(text).cast("long"), F.rlike(text, F.lit(SIGNS))]
    return reduce(Column.__add__, [F.when(bad, 1 << bit).otherwise(0) for bit, bad in enumerate(fails)])


def judged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(ident, part, mask, hash, copies): equal rows of one id are one row with a number."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("ident"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"),
                       text.alias("text"), words_of(text).alias("words"))
    rows = rows.select("ident", "part", text_mask(F.col("text"), F.col("words")).alias("mask"),
                       F.unhex(F.sha2("text", 256)).alias("hash"))
    return rows.groupBy("ident", "part", "mask", "hash").agg(F.count("*").alias("copies"))


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and set of failed filters."""
    known = labels.groupBy(F.col(id_col).alias("ident")).agg(
        (F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    rows = judged(docs, id_col, text_col, part_col).join(known, "ident", "left")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    alike = rows.groupBy("hash", "part", "mask", flag("good").alias("good"), flag("toxic").alias("toxic")).agg(
        F.sum("copies").alias("n"), F.sum(F.when(F.col("ident").isNull(), F.col("copies")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("ident").isNotNull(), F.struct("ident", "copies"))).alias("first"))
    smallest = F.min("first.ident").over(Window.partitionBy("hash"))
    own = F.when(F.col("first.ident") == F.col("smallest"), F.col("first.copies")).otherwise(0) + F.col("unnamed")
    split = alike.withColumn("smallest", smallest).select(
        "part", "good", "toxic", F.inline(F.array(
            F.struct(F.col("mask").alias("mask"), own.alias("n")),
            F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - own).alias("n")))))
    counted = lambda which: F.sum(F.when(F.col(which), F.col("n")).otherwise(0)).alias(which)
    return (split.where("n > 0").groupBy("part", "mask")
            .agg(F.sum("n").alias("n"), counted("good"), counted("toxic")))


def orders() -> Column:
    """All orders as one literal array of arrays of filter numbers."""
    return F.from_json(F.lit(str([list(p) for p in permutations(range(len(FILTERS)))])), "array<array<int>>")


def folded(cell: Column, every_order: Column) -> Column:
    """For one cell: a struct per order and step, weighted with its counts."""
    mask = cell["mask"]
    bits = F.array(*[F.lit(1 << k) for k in range(len(FILTERS))])
    many = lambda amount, condition: F.when(condition, amount).otherwise(F.lit(0).cast("long"))

    def step(state: Column, number: Column) -> Column:
        fails = F.getbit(mask, number) == 1
        here = state["alive"] & fails
        stays = state["alive"] & ~fails
        row = F.struct(
            many(cell["n"], stays).alias("kept"), many(cell["n"], here).alias("removed"),
            many(cell["n"], fails & ~state["alive"]).alias("redundant"),
            many(cell["n"], mask == F.get(bits, number)).alias("unique_fails"),
            many(cell["good"], here).alias("good_lost"), many(cell["toxic"], here).alias("toxic_lost"))
        return F.struct(stays.alias("alive"), F.concat(state["rows"], F.array(row)).alias("rows"))

    nothing = F.array().cast("array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>")
    start = F.struct(F.lit(True).alias("alive"), nothing.alias("rows"))
    return F.flatten(F.transform(every_order, lambda order: F.aggregate(order, start, step, lambda s: s["rows"])))


def sums_by_filter(places: Column, merged: Column) -> Column:
    """Removed documents of each filter over all orders, at any step."""
    pairs = F.arrays_zip(places.alias("filter"), merged["removed"].alias("removed"))
    return F.transform(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1)), lambda f: F.aggregate(
        pairs, F.lit(0).cast("long"), lambda total, x: total + F.when(x["filter"] == f, x["removed"]).otherwise(0)))


def audit(cells: DataFrame) -> DataFrame:
    """(part, filter_order, step, counts, shapley) from (part, mask, n, good, toxic)."""
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    zero = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS]),
                          len(FILTERS) * len(list(permutations(FILTERS))))
    add = lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS])
    parts = parts.withColumn("orders", orders()).withColumn("merged", F.aggregate(
        "cells", zero, lambda total, cell: F.zip_with(total, folded(cell, F.col("orders")), add)))
    places = F.flatten("orders")
    parts = parts.select("part", "orders", "merged", places.alias("places"),
                         sums_by_filter(places, F.col("merged")).alias("shapley"))
    rows = parts.select("part", "orders", "places", "shapley", F.posexplode("merged").alias("at", "counts"))
    n = len(FILTERS)
    letters = F.transform(F.get("orders", F.floor(F.col("at") / n).cast("int")),
                          lambda f: F.substr(F.lit(FILTERS), f + 1, F.lit(1)))
    return rows.select("part", F.array_join(letters, "").alias("filter_order"), (F.col("at") % n + 1).alias("step"),
                       *[F.col(f"counts.{c}").alias(c) for c in COUNTS],
                       F.get("shapley", F.get("places", F.col("at"))).alias("shapley"))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(mask_cells(docs, labels))


WORD = "[^\\x20\\x09-\\x0D]+"
SQL = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM docs GROUP BY text),
marks AS (SELECT doc_id, coalesce(max(quality) = 1, false) AS good, coalesce(max(toxic) = 1, false) AS toxic
  FROM labels GROUP BY doc_id),
split AS (SELECT doc_id, part, text, regexp_extract_all(text, '{WORD}') AS words FROM docs),
fails AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(words) < {LEAST_WORDS}, 100 * len(list_distinct(words)) < 50 * len(words),
     100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
     regexp_matches(text, '{SIGNS}'), coalesce(doc_id > first_id, false)] AS f
  FROM split JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM fails GROUP BY part, f),
letters AS (SELECT unnest(range(1, 6)) AS k),
orders AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT o, array_to_string(list_transform(o, lambda k: chr(CAST(64 + k AS INTEGER))), '') AS filter_order,
    unnest(range(1, 6)) AS step FROM orders),
counted AS (SELECT part, filter_order, step, o[step] AS k,
    NOT list_bool_or(list_transform(o[1:step - 1], lambda i: f[i])) AS reached, f[o[step]] AS failed,
    len(list_filter(f, lambda x: x)) = 1 AS alone, n, good, toxic
  FROM (SELECT * FROM cells, steps)),
summed AS (SELECT part, filter_order, step, k,
    CAST(sum(CASE WHEN coalesce(reached, true) AND NOT failed THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN coalesce(reached, true) AND failed THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN NOT coalesce(reached, true) AND failed THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN failed AND alone THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN coalesce(reached, true) AND failed THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN coalesce(reached, true) AND failed THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM counted GROUP BY part, filter_order, step, k)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM summed"""
