"""Splits and folds that do not depend on partitioning and do not shuffle the spectra.

Rows are ordered by ``md5(seed|split|key)``. Where a split needs the row with a given rank, only that
row's hash is looked up: count hashes per prefix, find the prefix that holds the rank, rank inside it.
The result is a table of cut hashes, a few per split or class, against which every row is compared
in place. A class or group that holds a third of all rows spreads evenly over the prefixes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spectraloom.operators.joins import join_small

PREFIX = 3  # hex digits: 4,096 groups per stratum


def order_hash(key: Column, *salt) -> Column:
    return F.md5(F.concat_ws("|", *[s if isinstance(s, Column) else F.lit(str(s)) for s in salt],
                             key.cast("string")))


def cut_hashes(hashed: DataFrame, strata: Sequence[str], ranks: Callable[[Column], Column],
               prefix: int = PREFIX) -> DataFrame:
    """``(strata..., cuts)``: the hashes at the 0-based ``ranks(n)`` of each stratum of ``n`` rows.

    ``hashed`` holds the strata columns and ``h``. Ranks that do not exist give no cut.
    """
    bucketed = hashed.select(*strata, "h", F.substring("h", 1, prefix).alias("bucket"))
    counts = bucketed.groupBy(*strata, "bucket").agg(F.count("*").alias("n"))
    within = Window.partitionBy(*strata)
    upto = within.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    located = (counts
               .withColumns({"before": F.sum("n").over(upto) - F.col("n"), "total": F.sum("n").over(within)})
               .select(*strata, "bucket", "before", F.explode(F.filter(
                   ranks(F.col("total")),
                   lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))).alias("rank")))
    wanted = (located.groupBy(*strata, "bucket")
              .agg(F.collect_set(F.col("rank") - F.col("before")).alias("positions")))
    candidates = join_small(bucketed, wanted, [*strata, "bucket"], "inner")
    position = F.row_number().over(Window.partitionBy(*strata, "bucket").orderBy("h")) - 1
    hits = (candidates.withColumn("position", position.cast("long"))
            .where(F.array_contains("positions", F.col("position"))))
    return hits.groupBy(*strata).agg(F.sort_array(F.collect_list("h")).alias("cuts"))


def group_shuffle_split(df: DataFrame, group: str, n_splits: int = 3, train_size: float = 0.8,
                        seed: int = 0, roles: tuple[str, str] = ("train", "val")) -> DataFrame:
    """Every row once per split (1, 2, ...), whole groups on one side; ``floor(train_size * G)`` groups train."""
    splits = F.explode(F.sequence(F.lit(1), F.lit(n_splits))).alias("split")
    groups = (df.select(group).distinct().select(group, splits)
              .select("split", order_hash(F.col(group), seed, F.col("split")).alias("h")))
    cuts = cut_hashes(groups, ["split"], lambda n: F.array(F.floor(n * F.lit(float(train_size)))))
    # at most n_splits rows
    cuts = F.broadcast(cuts.select("split", F.get("cuts", F.lit(0)).alias("_cut")))
    train, val = roles
    rows = df.select("*", splits).join(cuts, "split", "left")
    h = order_hash(F.col(group), seed, F.col("split"))
    in_train = F.col("_cut").isNull() | (h < F.col("_cut"))
    return rows.withColumn("role", F.when(in_train, train).otherwise(val)).drop("_cut")


def split_by_case(df: DataFrame, case: str = "case", train_size: float = 0.8, seed: int = 0) -> DataFrame:
    """The first grouped split only."""
    return (group_shuffle_split(df, case, 1, train_size, seed, ("train", "test")).drop("split"))


def split_by_source(df: DataFrame, train_sources: Sequence[str], test_sources: Sequence[str] | None = None,
                    source: str = "source") -> DataFrame:
    """Rows of the train sources and of the test sources (default: all other, non-NULL sources)."""
    train = F.col(source).isin(list(train_sources))
    test = F.col(source).isNotNull() if test_sources is None else F.col(source).isin(list(test_sources))
    role = F.when(train, F.lit("train")).when(test, F.lit("test"))
    if test_sources is not None and set(train_sources) & set(test_sources):
        raise ValueError("a source cannot be on both sides")
    return df.withColumn("role", role).where(F.col("role").isNotNull())


def stratified_folds(df: DataFrame, label: str, k: int = 5, key: str = "spectrum_id", seed: int = 0,
                     output: str = "fold") -> DataFrame:
    """Fold 0..k-1 per row; the sizes of a class differ by at most one between folds."""
    h = order_hash(F.col(key), seed)
    hashed = df.select(label, h.alias("h"))
    starts = cut_hashes(hashed, [label], lambda n: F.transform(
        F.sequence(F.lit(1), F.lit(k - 1)), lambda j: F.floor(n * j / k)) if k > 1 else F.array().cast("array<long>"))
    folded = join_small(df, starts, [label])
    fold = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<string>")), lambda start: h >= start))
    return folded.withColumn(output, fold).drop("cuts")


def cap_per_class(df: DataFrame, label: str, most: int, key: str = "spectrum_id", seed: int = 0) -> DataFrame:
    """At most ``most`` rows of every class, those with the smallest hashes of their key; NULL is a class too."""
    h = order_hash(F.col(key), seed)
    cuts = cut_hashes(df.select(label, h.alias("h")), [label], lambda n: F.array(F.lit(most).cast("long")))
    capped = join_small(df, cuts, [label])
    cut = F.get("cuts", F.lit(0))
    return capped.where(cut.isNull() | (h < cut)).drop("cuts")


def sample_n(df: DataFrame, n: int, key: str = "spectrum_id", seed: int = 0) -> DataFrame:
    """The ``n`` rows with the smallest hashes of their key; all rows if there are no more."""
    h = order_hash(F.col(key), seed)
    hashed = df.select(F.lit(0).alias("all"), h.alias("h"))
    found = cut_hashes(hashed, ["all"], lambda total: F.array(F.lit(n).cast("long"))).first()  # one hash
    return df.where(h < F.lit(found["cuts"][0])) if found else df


def stack(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test rows in one table with their role, e.g. for a joint projection."""
    return (train.withColumn("role", F.lit("train"))
            .unionByName(test.withColumn("role", F.lit("test"))))
