"""The filter audit against a direct count."""

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from spectraloom.llm import filter_audit
from tests.llm.conftest import CLASH, ODD
from tests.test_plans import plan


def brute(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good, toxic, first = set(), set(), {}
    for ident, q, t in labels:
        good |= {ident} if q == 1 else set()
        toxic |= {ident} if t == 1 else set()
    for ident, text, _ in docs:
        if ident is not None:
            first[text or ""] = min(ident, first.get(text or "", ident))
    rows = []
    for ident, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)),
                 "E": ident is not None and ident > first[text]}
        rows.append((lang or "", "".join(k for k in fails if fails[k]), ident in good, ident in toxic))
    cells, found = Counter(rows), {}
    for part in {r[0] for r in rows}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order):
                line = Counter()
                for (lang, fails, is_good, is_toxic), n in cells.items():
                    if lang != part:
                        continue
                    before, here = any(x in fails for x in order[:step]), letter in fails
                    line["unique"] += n * (fails == letter)
                    line["redundant"] += n * (before and here)
                    line["kept"] += n * (not before and not here)
                    line["removed"] += n * (here and not before)
                    line["good"] += n * (here and not before and is_good)
                    line["toxic"] += n * (here and not before and is_toxic)
                shapley[letter] += line["removed"]
                found[part, "".join(order), step + 1] = [line[k] for k in ("kept", "removed", "redundant", "unique",
                                                                           "good", "toxic")]
        for (lang, order, step), values in found.items():
            if lang == part:
                values.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in found.items()}


def audited(docs, labels):
    rows = filter_audit.audit_documents(docs, labels).collect()
    assert len(rows) == len({(r.part, r.filter_order, r.step) for r in rows})
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost,
                                               r.shapley) for r in rows}


def test_audit_equals_a_direct_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    plain = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    expected = brute(plain, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert audited(docs, labels) == expected
    assert len(expected) == 600 * len({r[2] for r in plain})


def test_audit_of_odd_rows(spark, odd, none):
    pairs = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, None, 1), (None, 1, 1), (9, 0, 0), (77, 1, 1)]
    labels = spark.createDataFrame([(*r, "x") for r in pairs], "doc_id long, quality int, toxic int, mask string")
    labelled = [p for p in pairs if p[0] is not None]
    assert audited(odd, labels) == brute([r[:3] for r in ODD], labelled)
    assert audited(odd, labels.where("false")) == brute([r[:3] for r in ODD], [])
    more = odd.withColumns({c: F.lit("x") for c in ("ident", "mask", "hash", "words", "copies", *CLASH)})
    assert audited(more, labels) == brute([r[:3] for r in ODD], labelled)
    assert audited(none, labels) == {}


def test_a_text_of_a_third_of_all_rows(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Same TEXT").otherwise(
        F.concat(F.lit("w "), (F.col("id") % 700).cast("string"))).alias("text"),
        F.when(F.col("id") % 2 == 0, "en").alias("lang"))
    labels = spark.range(0, 3000, 7).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality",
                                                "CAST(id % 3 = 0 AS INT) AS toxic")
    plain = [tuple(r) for r in docs.collect()]
    assert audited(docs, labels) == brute(plain, [tuple(r) for r in labels.collect()])


def test_thresholds_are_where_they_are_stated(spark):
    texts = {1: "w " * 199, 2: "w " * 200, 3: " ".join(f"w{i}" for i in range(100)) + " x" * 99,
             4: " ".join(f"w{i}" for i in range(100)) + " w0" * 101, 5: "A" * 3 + "b" * 97, 6: "A" * 4 + "b" * 96,
             7: "a|b", 8: "ÉÉÉ \x1c   "}
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(docs, labels) == brute([(i, t, "en") for i, t in texts.items()], [])


def test_audit_stays_in_the_jvm_and_joins_no_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    text = plan(filter_audit.audit_documents(docs, labels))
    assert "Arrow" not in text and "Python" not in text and "NestedLoop" not in text and "Cartesian" not in text
