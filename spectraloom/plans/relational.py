"""Registered queries on labels, joins, counts, curves, metrics and splits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.operators import joins, labels, metrics, names, scaling, splits, stats
from spectraloom.operators.signal import explode_points
from spectraloom.plans import views
from spectraloom.plans.views import SQL_LOG, SQL_META, SQL_POINTS, SQL_PREDS, SQL_PROBS, table
from spectraloom.schema import SPECIES_9, SPECIES_10
from spectraloom.sources import sidecar
from spectraloom.sources.paths import path_fields as path_columns
from spectraloom.sources.tables import to_long as long_form, union_groups

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL that gives the same rows."""
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function
    return register


def rounded(*names: str) -> dict:
    return {name: F.round(F.col(name), 6) for name in names}


# ---------------------------------------------------------------- sources

@query("""
WITH p AS (SELECT page_id, url || '_p' || lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') || '_000001.txt' AS path FROM pages),
n AS (SELECT page_id, string_split(path, '/') AS parts FROM p),
f AS (SELECT page_id, parts[-1] AS filename, parts[-2] AS folder FROM n)
SELECT page_id, filename, regexp_extract(filename, '^(.+)\\.[^.]*$', 1) AS spectrum_id,
       left(regexp_extract(filename, '^(.+)\\.[^.]*$', 1),
            greatest(length(regexp_extract(filename, '^(.+)\\.[^.]*$', 1)) - 7, 0)) AS measurement,
       TRY_CAST(right(string_split(filename, '_')[-2], 2) AS INTEGER) AS idx, folder,
       CASE WHEN len(string_split(folder, '_')) = 2 THEN string_split(folder, '_')[2]
            ELSE string_split(folder, '_')[1] END AS sample
FROM f""")
def path_fields(spark, sf_dir):
    path = F.concat("url", F.lit("_p"), F.lpad((F.col("page_id") % 100).cast("string"), 2, "0"),
                    F.lit("_000001.txt"))
    return table(spark, sf_dir, "pages").select(
        "page_id", *[c.alias(name) for name, c in path_columns(path).items()])


def _labelled_documents(spark, sf_dir):
    """Documents as files in folders named by source; labels as the sidecars of single files."""
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("folder"), F.concat(F.lit("m"), "lang").alias("measurement"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("spectrum_id"))
    text = F.concat(
        F.lit('{"source": "lab", "growth_time": "t'), F.col("toxic").cast("string"),
        F.lit('", "species": '), F.when(F.col("quality") == 1, '"casei"').otherwise("null"),
        F.when(F.col("toxic") == 1, ', "measurement": null').otherwise(""),
        F.lit(', "pcr": "casei , q'), F.col("quality").cast("string"), F.lit('", "device": "x'),
        F.col("quality").cast("string"), F.lit('"}'))
    sidecars = table(spark, sf_dir, "labels").select(
        "doc_id", sidecar.parse_sidecar(text).alias("sidecar"))
    return documents, sidecars


@query("""
SELECT d.doc_id, d.source AS folder,
       CASE WHEN l.doc_id IS NOT NULL THEN 'lab' ELSE 'unlisted' END AS source,
       CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.quality = 1 THEN 'casei' END
            WHEN contains(d.source, 'src7') THEN 'src7' WHEN contains(d.source, 'src1') THEN 'src1' END AS species,
       CASE WHEN l.doc_id IS NOT NULL THEN 'casei+q' || CAST(l.quality AS VARCHAR) END AS pcr
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.doc_id IS NOT NULL OR contains(d.source, 'src7') OR contains(d.source, 'src1')""")
def sidecar_join(spark, sf_dir):
    documents, sidecars = _labelled_documents(spark, sf_dir)
    joined = sidecar.attach_sidecar(documents, sidecars, ["src7", "src1"], "unlisted", key="doc_id", text="folder")
    return sidecar.metadata_columns(joined).select("doc_id", "folder", "source", "species", "pcr")


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 't' || CAST(l.toxic AS VARCHAR) END AS growth_time,
       CAST(NULL AS VARCHAR) AS substrate,
       CASE WHEN l.toxic = 1 THEN NULL ELSE 'm' || d.lang END AS measurement,
       'd' || CAST(d.doc_id AS VARCHAR) || '.txt' AS filename,
       CASE WHEN l.doc_id IS NOT NULL THEN 'x' || CAST(l.quality AS VARCHAR) END AS device
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def meta_precedence(spark, sf_dir):
    documents, sidecars = _labelled_documents(spark, sf_dir)
    joined = sidecar.attach_sidecar(documents, sidecars, ["src"], "unlisted", key="doc_id", text="folder")
    return sidecar.metadata_columns(joined).select(
        "doc_id", "growth_time", "substrate", "measurement", "filename",
        F.try_element_at("extra", F.lit("device")).alias("device"))


COLOURS = ["red", "old", "blue", "hot", "green", "large"]


@query("""
SELECT p_partkey, p_name,
       CASE WHEN contains(lower(p_name), 'red') THEN 'red' WHEN contains(lower(p_name), 'old') THEN 'old'
            WHEN contains(lower(p_name), 'blue') THEN 'blue' WHEN contains(lower(p_name), 'hot') THEN 'hot'
            WHEN contains(lower(p_name), 'green') THEN 'green' WHEN contains(lower(p_name), 'large') THEN 'large'
       END AS match
FROM part""")
def first_match_label(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", labels.first_match(F.col("p_name"), COLOURS).alias("match"))


WORDS = [*COLOURS, *SPECIES_10, "th", "der", "tion", "é", "le"]


@query(f"""
SELECT p_partkey, list_extract(list_filter({WORDS}, lambda w: contains(lower(p_name), w)), 1) AS match FROM part""")
def first_name_match(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return names.first_name(rows, "p_name", WORDS, "match").drop("p_name")


@query(f"""
SELECT doc_id, array_to_string(list_filter({WORDS}, lambda w: contains(lower(text), w)), ',') AS names FROM documents""")
def names_in_documents(spark, sf_dir):
    """Whole texts, all names at once."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return names.names_found(rows, "text", WORDS).select("doc_id", F.array_join("names", ",").alias("names"))


@query("""
SELECT s_suppkey AS id_in_file, s_name AS name, s_acctbal AS balance, 'suppliers' AS "group",
       'notarget' AS target, 'supplier.tsv' AS filename, 'no target' AS is_target FROM supplier
UNION ALL
SELECT c_custkey, c_name, c_acctbal, 'customers', 'buyer', 'customer.tsv', 'target' FROM customer""")
def group_union(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("row_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    rows = union_groups([(suppliers, "suppliers", "notarget", "supplier.tsv"),
                         (customers, "customers", "buyer", "customer.tsv")], "row_id")
    return labels.is_target(rows)


@query("""
SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS idx, unnest(embedding) AS value FROM embeddings""")
def to_long(spark, sf_dir):
    return long_form(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


# ---------------------------------------------------------------- label columns and filters

@query(f"WITH {SQL_META} SELECT spectrum_id, species, pcr, coalesce(species, pcr) AS species_or_pcr FROM meta")
def fill_label(spark, sf_dir):
    return labels.fill_label(views.meta(spark, sf_dir)).select("spectrum_id", "species", "pcr", "species_or_pcr")


TARGETS = ["brevis", "plantarum", "grayi"]
SQL_TARGETS = f"""{SQL_META}, filled AS (SELECT spectrum_id, coalesce(species, pcr) AS s FROM meta),
targets AS (SELECT spectrum_id, CAST(contains(s, 'brevis') AS INTEGER) AS brevis,
            CAST(contains(s, 'plantarum') AS INTEGER) AS plantarum, CAST(contains(s, 'grayi') AS INTEGER) AS grayi
            FROM filled)"""


def _targets(spark, sf_dir):
    filled = labels.fill_label(views.meta(spark, sf_dir))
    return labels.multilabel_targets(filled, TARGETS)


def _target_columns(df):
    return df.select("spectrum_id", *[F.get("targets", F.lit(i)).alias(name) for i, name in enumerate(TARGETS)])


@query(f"WITH {SQL_TARGETS} SELECT * FROM targets")
def multilabel_targets(spark, sf_dir):
    return _target_columns(_targets(spark, sf_dir))


@query(f"WITH {SQL_TARGETS} SELECT * FROM targets WHERE brevis + plantarum + grayi > 0")
def has_target(spark, sf_dir):
    return _target_columns(labels.has_target(_targets(spark, sf_dir)))


@query("""
SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R')""")
def isin_filter(spark, sf_dir):
    kept = labels.keep_values(table(spark, sf_dir, "lineitem"), "l_returnflag", ["A", "R"])
    return kept.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")


@query("""
SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority = '5-LOW' AND o_totalprice > 100000 AND o_custkey <> 0""")
def dict_and_query_filter(spark, sf_dir):
    kept = labels.filter_rows(table(spark, sf_dir, "orders"),
                              {"o_orderstatus": ["F", "O"], "o_orderpriority": "5-LOW"},
                              "o_totalprice > 100000 AND o_custkey <> 0")
    return kept.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


@query("""
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'O') AND NOT (o_orderpriority = '5-LOW')
  AND (0 < o_custkey AND o_custkey <= 900 OR o_orderkey NOT IN (1, 2, 3) AND o_totalprice / 2 < 90000)""")
def query_string_filter(spark, sf_dir):
    kept = labels.filter_rows(
        table(spark, sf_dir, "orders"), grammar="frame",
        query="o_totalprice > 100000 & o_orderstatus in ['F', 'O'] and not `o_orderpriority` == '5-LOW' and "
              "(0 < o_custkey <= 900 | o_orderkey not in [1, 2, 3] & o_totalprice / 2 < 90000)")
    return kept.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(f"WITH {SQL_META} SELECT spectrum_id, name, CASE WHEN name = 'casei' THEN 1 ELSE -1 END AS target FROM meta")
def detector_target(spark, sf_dir):
    return labels.detector_target(views.meta(spark, sf_dir), "casei", "name").select("spectrum_id", "name", "target")


@query(f"""
WITH {SQL_META} SELECT spectrum_id, coalesce(species, pcr) AS species_or_pcr, class_id AS target FROM meta""")
def classification_target(spark, sf_dir):
    filled = labels.fill_label(views.meta(spark, sf_dir))
    return labels.classification_target(filled, SPECIES_10).select("spectrum_id", "species_or_pcr", "target")


@query(f"""
WITH {SQL_META}, ids AS (SELECT * FROM (VALUES ('casei', 0), ('rossiae', 1), ('plantarum', 2), ('lindneri', 3),
  ('brevis', 4), ('ecoli', 5), ('grayi', 6), ('innocua', 7), ('pectinatus', 8)) t(name, y))
SELECT m.spectrum_id, m.name, ids.y, ids.name AS decoded FROM meta m JOIN ids ON m.name = ids.name""")
def label_encode(spark, sf_dir):
    encoded = labels.encode_labels(views.meta(spark, sf_dir), SPECIES_9, "name")
    return labels.decode_labels(encoded, SPECIES_9, "y", "decoded").select("spectrum_id", "name", "y", "decoded")


@query("""
SELECT doc_id, lang AS label FROM documents UNION ALL SELECT doc_id, source FROM documents""")
def label_list_table(spark, sf_dir):
    cell = F.concat(F.lit("['"), "lang", F.lit(" ', '"), "source", F.lit("']"))
    documents = table(spark, sf_dir, "documents").select("doc_id", cell.alias("cell"))
    return labels.label_table(documents, "cell", "doc_id")


@query(f"""
WITH {SQL_META} SELECT spectrum_id, CASE WHEN species IS NULL THEN 'notarget' ELSE species END AS target,
  CASE WHEN species IS NULL THEN 'no target' ELSE 'target' END AS is_target FROM meta""")
def is_target(spark, sf_dir):
    meta = views.meta(spark, sf_dir).withColumn("target", F.coalesce("species", F.lit("notarget")))
    return labels.is_target(meta).select("spectrum_id", "target", "is_target")


@query(f"""
WITH {SQL_PREDS} SELECT spectrum_id, y, y_pred, y = y_pred AS correct,
  CASE WHEN y = y_pred THEN 'green' ELSE 'red' END AS correct_color FROM preds""")
def prediction_flags(spark, sf_dir):
    return labels.prediction_flags(views.preds(spark, sf_dir)).drop("fold")


@query(f"""
WITH {SQL_PROBS} SELECT spectrum_id, CAST(k AS INTEGER) AS k, CAST(p > 0.5 AS INTEGER) AS predicted FROM probs""")
def threshold_labels(spark, sf_dir):
    return long_form(labels.threshold_labels(views.probs(spark, sf_dir)), "spectrum_id", "predicted", "predicted", "k")


# ---------------------------------------------------------------- joins

@query(f"""
WITH {SQL_META} SELECT e.vec_id AS spectrum_id, m.name, m.culture, m.source,
  CAST(len(e.embedding) AS INTEGER) AS points, CAST(e.embedding[1] AS DOUBLE) * CAST(1000000 AS DOUBLE) AS first_point
FROM embeddings e JOIN meta m ON e.vec_id = m.spectrum_id""")
def spectra_meta_join(spark, sf_dir):
    joined = joins.join_metadata(views.spectra(spark, sf_dir), views.meta(spark, sf_dir))
    return joined.select("spectrum_id", "name", "culture", "source", F.size("intensities").alias("points"),
                         F.get("intensities", F.lit(0)).alias("first_point"))


@query(f"""
WITH {SQL_META}, names AS (SELECT DISTINCT class_id, name FROM meta), {SQL_PREDS}
SELECT m.spectrum_id AS id, CAST(e.embedding[1] AS DOUBLE) AS x, CAST(e.embedding[2] AS DOUBLE) AS y, m.filename,
       m.name AS label, n.name AS pred_labelname, m.name = n.name AS correct
FROM meta m JOIN embeddings e ON e.vec_id = m.spectrum_id JOIN preds p ON p.spectrum_id = m.spectrum_id
JOIN names n ON n.class_id = p.y_pred""")
def predictions_table(spark, sf_dir):
    projection = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("spectrum_id"), F.get("embedding", F.lit(0)).cast("double").alias("x"),
        F.get("embedding", F.lit(1)).cast("double").alias("y"))
    named = labels.decode_labels(views.preds(spark, sf_dir), SPECIES_10, "y_pred", "pred_labelname")
    return joins.predictions_table(projection, named, views.meta(spark, sf_dir), "name")


# ---------------------------------------------------------------- counts and curves

@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def class_counts(spark, sf_dir):
    return stats.class_counts(table(spark, sf_dir, "lineitem"), "l_returnflag")


@query("""
SELECT c.c_mktsegment, count(DISTINCT o.o_custkey) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY c.c_mktsegment""")
def cultures_per_species(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = table(spark, sf_dir, "orders").select("o_custkey").join(
        customers, F.col("o_custkey") == F.col("c_custkey"))
    return stats.distinct_per_group(joined, "c_mktsegment", "o_custkey")


@query("""
SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem
GROUP BY l_returnflag, l_linestatus, l_linenumber""")
def group_sizes(spark, sf_dir):
    return stats.group_sizes(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(f"WITH {SQL_META} SELECT species, min(spectrum_id) AS first_id FROM meta GROUP BY species")
def distinct_labels(spark, sf_dir):
    return stats.distinct_labels(views.meta(spark, sf_dir), "species")


@query("SELECT count(*) AS n FROM lineitem")
def total_count(spark, sf_dir):
    return stats.total_count(table(spark, sf_dir, "lineitem"))


BAND = ("mean", "std", "lower", "upper")

@query("""
WITH p AS (SELECT unnest(range(len(embedding))) AS idx, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
b AS (SELECT CAST(idx AS INTEGER) AS idx, avg(x) AS mean, stddev_samp(x) AS std FROM p GROUP BY idx)
SELECT idx, round(mean, 6) AS mean, round(std, 6) AS std, round(mean - std, 6) AS lower, round(mean + std, 6) AS upper
FROM b""")
def mean_band(spark, sf_dir):
    points = F.transform("embedding", lambda v: v.cast("double"))
    band = stats.mean_band(table(spark, sf_dir, "embeddings").select(points.alias("intensities")))
    return band.withColumns(rounded(*BAND))


@query(f"""
WITH {SQL_META}, n AS (SELECT e.vec_id, e.embedding, m.name,
  sqrt(list_sum([CAST(v AS DOUBLE) * CAST(v AS DOUBLE) FOR v IN e.embedding])) AS norm
  FROM embeddings e JOIN meta m ON e.vec_id = m.spectrum_id),
p AS (SELECT name, unnest(range(len(embedding))) AS idx,
  CAST(unnest(embedding) AS DOUBLE) / CASE WHEN norm * 1000000 < 0.001 THEN 1 ELSE norm END * 100 AS x FROM n),
o AS (SELECT name, (row_number() OVER (ORDER BY min(spectrum_id)) - 1) * 3.0 AS shift FROM meta GROUP BY name),
b AS (SELECT name, CAST(idx AS INTEGER) AS idx, avg(x) AS mean, stddev_samp(x) AS std FROM p GROUP BY name, idx)
SELECT b.name, idx, round(mean + shift, 6) AS mean, round(std, 6) AS std, round(mean + shift - std, 6) AS lower,
       round(mean + shift + std, 6) AS upper
FROM b JOIN o ON b.name = o.name""")
def class_mean_band(spark, sf_dir):
    """Flagship: normalise every spectrum, then mean curve and band per class."""
    from spectraloom.operators.signal import normalize
    cleaned = normalize(views.labelled_spectra(spark, sf_dir))
    return stats.class_mean_band(cleaned, "name").withColumns(rounded(*BAND))


@query(f"""
WITH {SQL_META}, {SQL_POINTS},
f AS (SELECT culture, min(spectrum_id) AS first_id FROM meta GROUP BY culture),
c AS (SELECT f.culture, m.species FROM f JOIN meta m ON m.spectrum_id = f.first_id),
o AS (SELECT species, (row_number() OVER (ORDER BY min(spectrum_id)) - 1) * 3.0 AS shift FROM meta GROUP BY species),
b AS (SELECT m.culture, CAST(p.idx AS INTEGER) AS idx, avg(x / 1000000) AS mean, stddev_samp(x / 1000000) AS std
  FROM points p JOIN meta m ON p.spectrum_id = m.spectrum_id GROUP BY m.culture, p.idx)
SELECT b.culture, b.idx, round(mean, 6) AS mean, round(std, 6) AS std, round(mean - std, 6) AS lower,
       round(mean + std, 6) AS upper, c.species, round(mean + shift, 6) AS shifted_mean
FROM b JOIN c ON b.culture = c.culture JOIN o ON c.species IS NOT DISTINCT FROM o.species""")
def culture_mean_band(spark, sf_dir):
    table_ = views.labelled_spectra(spark, sf_dir)
    table_ = table_.withColumn("intensities", F.transform("intensities", lambda v: v / views.COUNTS))
    return stats.culture_mean_band(table_).withColumns(rounded(*BAND, "shifted_mean"))


# ---------------------------------------------------------------- scores

TEN = list(range(10))

@query(f"""
WITH {SQL_PREDS}, c AS (SELECT y, y_pred, count(*) AS n FROM preds GROUP BY y, y_pred),
k AS (SELECT CAST(unnest(range(10)) AS INTEGER) AS k)
SELECT a.k AS y, b.k AS y_pred, coalesce(n, 0) AS n FROM k a CROSS JOIN k b
LEFT JOIN c ON c.y = a.k AND c.y_pred = b.k""")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(views.preds(spark, sf_dir), TEN)


@query(f"""
WITH {SQL_PREDS}, c AS (SELECT y, y_pred, count(*) AS n FROM preds GROUP BY y, y_pred),
t AS (SELECT y, count(*) AS total FROM preds GROUP BY y), k AS (SELECT CAST(unnest(range(10)) AS INTEGER) AS k)
SELECT a.k AS y, b.k AS y_pred, round(coalesce(CAST(n AS DOUBLE) / total * 100, 0), 6) AS share
FROM k a CROSS JOIN k b LEFT JOIN c ON c.y = a.k AND c.y_pred = b.k LEFT JOIN t ON t.y = a.k""")
def confusion_matrix_norm(spark, sf_dir):
    return metrics.confusion_matrix_norm(views.preds(spark, sf_dir), TEN).withColumns(rounded("share"))


@query(f"""
WITH {SQL_PREDS}, k AS (SELECT CAST(unnest(range(10)) AS INTEGER) AS k),
c AS (SELECT k, sum(CASE WHEN y = k AND y_pred = k THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN y = k AND y_pred <> k THEN 1 ELSE 0 END) AS fn,
  sum(CASE WHEN y <> k AND y_pred = k THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y <> k AND y_pred <> k THEN 1 ELSE 0 END) AS tn FROM preds CROSS JOIN k GROUP BY k),
r AS (SELECT CAST(k AS VARCHAR) AS class, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) * 100 AS sensitivity,
  CAST(tn AS DOUBLE) / nullif(tn + fp, 0) * 100 AS specificity FROM c)
SELECT class, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity FROM r
UNION ALL SELECT 'Mean', round(avg(sensitivity), 6), round(avg(specificity), 6) FROM r""")
def sens_spec(spark, sf_dir):
    return metrics.sens_spec(views.preds(spark, sf_dir), TEN).withColumns(rounded("sensitivity", "specificity"))


@query(f"WITH {SQL_PREDS} SELECT round(avg(CASE WHEN y = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM preds")
def accuracy(spark, sf_dir):
    return metrics.accuracy(views.preds(spark, sf_dir)).withColumns(rounded("accuracy"))


@query(f"""
WITH {SQL_PREDS}, f AS (SELECT fold, avg(CASE WHEN y = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM preds GROUP BY fold)
SELECT fold, round(accuracy, 6) AS accuracy, round(avg(accuracy) OVER (), 6) AS mean_accuracy,
       round(stddev_pop(accuracy) OVER (), 6) AS std_accuracy FROM f""")
def cv_scores(spark, sf_dir):
    scores = metrics.cv_scores(views.preds(spark, sf_dir))
    return scores.withColumns(rounded("accuracy", "mean_accuracy", "std_accuracy"))


SQL_LABEL_COUNTS = f"""{SQL_PROBS}, c AS (SELECT k, sum(CASE WHEN y = 1 AND p > 0.5 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN y = 1 AND p <= 0.5 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN y = 0 AND p > 0.5 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y = 0 AND p <= 0.5 THEN 1 ELSE 0 END) AS tn FROM probs GROUP BY k)"""


@query(f"""
WITH {SQL_LABEL_COUNTS}
SELECT round(avg(CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn)), 6) AS accuracy,
       round(avg(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0)), 6) AS precision,
       round(avg(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0)), 6) AS recall FROM c""")
def multilabel_metrics(spark, sf_dir):
    scores = metrics.multilabel_metrics(views.probs(spark, sf_dir))
    return scores.withColumns(rounded("accuracy", "precision", "recall"))


@query(f"""
WITH {SQL_LABEL_COUNTS}
SELECT CAST(k AS INTEGER) AS label, y, y_pred, CAST(n AS BIGINT) AS n FROM (
  SELECT k, 0 AS y, 0 AS y_pred, tn AS n FROM c UNION ALL SELECT k, 0, 1, fp FROM c
  UNION ALL SELECT k, 1, 0, fn FROM c UNION ALL SELECT k, 1, 1, tp FROM c) t""")
def multilabel_confusion(spark, sf_dir):
    return metrics.multilabel_confusion(views.probs(spark, sf_dir))


@query(f"""
WITH {SQL_PROBS}
SELECT round(avg(-(y * CASE WHEN p <= 0 THEN -100 ELSE greatest(ln(p), -100) END
  + (1 - y) * CASE WHEN p >= 1 THEN -100 ELSE greatest(ln(1 - p), -100) END)), 6) AS loss FROM probs""")
def bce_loss(spark, sf_dir):
    return metrics.bce_loss(views.probs(spark, sf_dir)).withColumns(rounded("loss"))


@query(f"""
WITH {SQL_LOG} SELECT epoch, round(avg(loss), 6) AS loss, count(*) AS iterations, max(ts_us) - min(ts_us) AS duration
FROM train_log GROUP BY epoch""")
def epoch_summary(spark, sf_dir):
    return stats.epoch_summary(views.train_log(spark, sf_dir), ["loss"]).withColumns(rounded("loss"))


@query(f"""
WITH {SQL_LOG}, w AS (SELECT epoch, iter, avg(loss) OVER (PARTITION BY epoch ORDER BY iter
  ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS loss FROM train_log)
SELECT epoch, iter, round(loss, 6) AS loss FROM w WHERE (iter + 1) % 10 = 0""")
def last_n_mean(spark, sf_dir):
    return stats.last_n_mean(views.train_log(spark, sf_dir), ["loss"], 10).withColumns(rounded("loss"))


@query("""
WITH p AS (SELECT o_orderpriority, o_totalprice AS y, 150000 + o_custkey % 100 * CAST(2000 AS DOUBLE) AS p FROM orders),
m AS (SELECT o_orderpriority, avg(y) AS mean FROM p GROUP BY o_orderpriority)
SELECT p.o_orderpriority, round(1 - sum((y - p) * (y - p)) / sum((y - mean) * (y - mean)), 6) AS r2
FROM p JOIN m ON p.o_orderpriority = m.o_orderpriority GROUP BY p.o_orderpriority""")
def r2_score(spark, sf_dir):
    predicted = 150000 + F.col("o_custkey") % 100 * 2000.0
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", predicted.alias("p"))
    return metrics.r2_score(orders, "o_totalprice", "p", ["o_orderpriority"]).withColumns(rounded("r2"))


# ---------------------------------------------------------------- scaling

@query("""
WITH b AS (SELECT min(p_retailprice) AS low, max(p_retailprice) AS high FROM part)
SELECT p_partkey, round((p_retailprice - low) / (high - low), 6) AS scaled,
       round((p_retailprice * 2 - low) / (high - low), 6) AS unseen_scaled FROM part CROSS JOIN b""")
def minmax_scale(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    scale = scaling.fit_min_max(part, "p_retailprice")
    return part.select("p_partkey", scale.transform(F.col("p_retailprice")).alias("scaled"),
                       scale.transform(F.col("p_retailprice") * 2).alias("unseen_scaled")
                       ).withColumns(rounded("scaled", "unseen_scaled"))


@query("SELECT p_partkey, round(p_retailprice, 6) AS restored FROM part")
def minmax_inverse(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    scale = scaling.fit_min_max(part, "p_retailprice")
    scaled = part.select("p_partkey", scale.transform(F.col("p_retailprice")).alias("scaled"))
    return scaled.select("p_partkey", scale.inverse(F.col("scaled")).alias("restored")).withColumns(rounded("restored"))


# ---------------------------------------------------------------- splits

@query("""
WITH g AS (SELECT c.o_custkey, s.split FROM (SELECT DISTINCT o_custkey FROM orders) c
  CROSS JOIN (VALUES (1), (2), (3)) s(split)),
r AS (SELECT o_custkey, split, count(*) OVER (PARTITION BY split) AS n, row_number() OVER (PARTITION BY split
  ORDER BY md5('0|' || CAST(split AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR))) AS rk FROM g)
SELECT o.o_orderkey, o.o_custkey, r.split, CASE WHEN rk <= floor(0.8 * n) THEN 'train' ELSE 'val' END AS role
FROM orders o JOIN r ON o.o_custkey = r.o_custkey""")
def group_shuffle_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return splits.group_shuffle_split(orders, "o_custkey")


@query("""
WITH r AS (SELECT user_id, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('0|1|' || CAST(user_id AS VARCHAR))) AS rk
  FROM (SELECT DISTINCT user_id FROM events))
SELECT e.event_id, e.user_id, CASE WHEN rk <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS role
FROM events e JOIN r ON e.user_id = r.user_id""")
def split_by_case(spark, sf_dir):
    return splits.split_by_case(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id")


@query("""
SELECT doc_id, source, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'train' ELSE 'test' END AS role
FROM documents WHERE source IS NOT NULL""")
def split_by_source(spark, sf_dir):
    return splits.split_by_source(table(spark, sf_dir, "documents").select("doc_id", "source"),
                                  ["src0", "src1", "src2"])


@query("""
WITH r AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label
  ORDER BY md5('0|' || CAST(vec_id AS VARCHAR))) - 1 AS rk FROM embeddings)
SELECT vec_id, label, CASE WHEN rk >= n * 1 // 5 THEN 1 ELSE 0 END + CASE WHEN rk >= n * 2 // 5 THEN 1 ELSE 0 END
  + CASE WHEN rk >= n * 3 // 5 THEN 1 ELSE 0 END + CASE WHEN rk >= n * 4 // 5 THEN 1 ELSE 0 END AS fold FROM r""")
def stratified_folds(spark, sf_dir):
    spectra = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return splits.stratified_folds(spectra, "label", 5, "vec_id")


@query("""
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang
  ORDER BY md5('0|' || CAST(doc_id AS VARCHAR))) AS rk FROM documents) WHERE rk <= 100""")
def cap_per_class(spark, sf_dir):
    return splits.cap_per_class(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 100, "doc_id")


@query("""
SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (
  ORDER BY md5('0|' || CAST(o_orderkey AS VARCHAR))) AS rk FROM orders) WHERE rk <= 500""")
def sample_n(spark, sf_dir):
    return splits.sample_n(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 500, "o_orderkey")


@query(f"""
WITH {SQL_META}, {SQL_POINTS}
SELECT p.spectrum_id, m.source, CAST(p.idx AS INTEGER) AS idx, p.x AS intensities,
       CASE WHEN m.source = 'src0' THEN 'train' ELSE 'test' END AS role
FROM points p JOIN meta m ON p.spectrum_id = m.spectrum_id""")
def stack_splits(spark, sf_dir):
    spectra = views.labelled_spectra(spark, sf_dir).select("spectrum_id", "source", "intensities")
    train = labels.keep_values(spectra, "source", ["src0"])
    test = spectra.where(F.col("source") != "src0")
    return explode_points(splits.stack(train, test), keys=["spectrum_id", "source", "role"])
