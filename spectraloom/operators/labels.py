"""Label columns, filters and targets. Everything here is a projection or a filter: no shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spectraloom.operators.predicates import condition


def _literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def fill_label(df: DataFrame, label: str = "species", fallback: str = "pcr",
               output: str = "species_or_pcr") -> DataFrame:
    """Annotated label, else the one found by PCR."""
    return df.withColumn(output, F.coalesce(F.col(label), F.col(fallback)))


def multilabel_targets(df: DataFrame, classes: Sequence[str], label: str = "species_or_pcr",
                       output: str = "targets", match: str = "substring") -> DataFrame:
    """0/1 array in the order of ``classes``.

    ``match='substring'``: the class name occurs anywhere in the label. ``match='token'``: it equals
    one part of an ``a+b`` label. A missing label has no class.
    """
    value = F.col(label)
    if match == "substring":
        hit = lambda name: F.contains(value, name)
    elif match == "token":
        hit = lambda name: F.array_contains(F.split(value, r"\+"), name)
    else:
        raise ValueError(f"match must be 'substring' or 'token', got {match!r}")
    return df.withColumn(output, F.transform(
        _literals(classes), lambda name: F.coalesce(hit(name), F.lit(False)).cast("int")))


def has_target(df: DataFrame, targets: str = "targets") -> DataFrame:
    """Drop rows without any target class."""
    return df.where(F.array_max(targets) > 0)


def keep_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def filter_rows(df: DataFrame, keep: Mapping[str, object] | None = None, query: str | None = None,
                grammar: str = "sql") -> DataFrame:
    """Rows that match every ``column: value(s)`` entry and the free predicate.

    ``grammar``: ``sql`` (an SQL expression) or ``frame`` (a data-frame query string, see ``predicates``).
    """
    if grammar not in ("sql", "frame"):
        raise ValueError(f"grammar must be 'sql' or 'frame', got {grammar!r}")
    if keep:
        tests = [F.col(name).isin([values] if isinstance(values, str) or not isinstance(values, Sequence)
                                  else list(values))
                 for name, values in keep.items()]
        df = df.where(reduce(lambda a, b: a & b, tests))
    if query is not None:
        if not isinstance(query, str):
            raise ValueError(f"query must be a string: {query!r}")
        df = df.where(F.expr(query) if grammar == "sql" else condition(query))
    return df


def detector_target(df: DataFrame, positive: str, label: str = "class", output: str = "target") -> DataFrame:
    """One class against the rest: +1 / -1."""
    return df.withColumn(output, F.when(F.col(label) == positive, 1).otherwise(-1))


def first_species(label: Column) -> Column:
    return F.split(label, r"\+")[0]


def label_id(name: Column, classes: Sequence[str]) -> Column:
    """Position of ``name`` in ``classes``; NULL for other names."""
    ids = F.create_map(*[part for i, c in enumerate(classes) for part in (F.lit(c), F.lit(i))])
    return F.try_element_at(ids, name)


def label_name(class_id: Column, classes: Sequence[str]) -> Column:
    return F.get(_literals(classes), class_id.cast("int"))


def classification_target(df: DataFrame, classes: Sequence[str], label: str = "species_or_pcr",
                          output: str = "target", unknown: str = "error") -> DataFrame:
    """Class id of the first species of ``a+b``.

    A name outside ``classes`` fails the job (``unknown='error'``) or gives NULL (``unknown='null'``).
    """
    name = first_species(F.col(label))
    found = label_id(name, classes)
    if unknown == "error":
        found = F.coalesce(found, F.raise_error(F.concat(
            F.lit("label is not a known class: "), F.coalesce(name, F.lit("NULL")))).cast("int"))
    elif unknown != "null":
        raise ValueError(f"unknown must be 'error' or 'null', got {unknown!r}")
    return df.withColumn(output, found)


def encode_labels(df: DataFrame, classes: Sequence[str], label: str, output: str = "y") -> DataFrame:
    """Keep the selected classes and number them in the order given."""
    return keep_values(df, label, classes).withColumn(output, label_id(F.col(label), classes))


def decode_labels(df: DataFrame, classes: Sequence[str], class_id: str, output: str) -> DataFrame:
    return df.withColumn(output, label_name(F.col(class_id), classes))


def parse_label_list(cell: Column) -> Column:
    """Trimmed names of a printed list (``['a ', 'b']``) or of plain comma separated text (``a, b``)."""
    inner = F.regexp_replace(cell, r"^\s*\[|\]\s*$", "")
    unquoted = F.transform(F.split(inner, ","), lambda part: F.trim(
        F.regexp_replace(F.trim(part), r"^['\"]|['\"]$", "")))
    return F.filter(unquoted, lambda part: part != "")


def join_label_list(cell: Column) -> Column:
    """``a, b`` to ``a+b``."""
    return F.array_join(F.transform(F.split(cell, ","), lambda part: F.trim(part)), "+")


def label_table(df: DataFrame, cell: str, key: str = "spectrum_id", output: str = "label") -> DataFrame:
    """One row per spectrum and label of a list cell."""
    return df.select(key, F.explode(parse_label_list(F.col(cell))).alias(output))


def is_target(df: DataFrame, target: str = "target", output: str = "is_target") -> DataFrame:
    return df.withColumn(output, F.when(F.col(target) == "notarget", "no target").otherwise("target"))


def prediction_flags(df: DataFrame, truth: str = "y", predicted: str = "y_pred") -> DataFrame:
    """``correct`` and the colour word used to mark it."""
    correct = F.col(truth) == F.col(predicted)
    return df.withColumns({"correct": correct,
                           "correct_color": F.when(correct, "green").otherwise("red")})


def threshold_labels(df: DataFrame, probabilities: str = "probabilities", threshold: float = 0.5,
                     output: str = "predicted") -> DataFrame:
    """0/1 array: probability strictly above the threshold."""
    return df.withColumn(output, F.transform(probabilities, lambda p: (p > threshold).cast("int")))


def first_match(text: Column, choices: Sequence[str]) -> Column:
    """First of ``choices``, in their order, that occurs in the lower-cased text."""
    lowered = F.lower(text)
    return F.get(F.filter(_literals(choices), lambda name: F.contains(lowered, name)), F.lit(0))
