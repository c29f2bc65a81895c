"""Consecutive numbers and offsets without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.plans.lineage import cut


def numbered(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """Adds ``name``, the row's rank from 0 in ``order``: range partitions are sorted apart, and their counts (a row each) give the offsets. Ties are numbered as they are read."""
    cols = df.columns
    keyed = df.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(order)], F.monotonically_increasing_id().alias("_tie"))
    by = [f"_k{i}" for i in range(len(order))] + ["_tie"]
    # written once, as the bounds of the ranges are sampled
    t = cut(keyed.repartitionByRange(*by).sortWithinPartitions(*by).select(*cols, F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", 33)
    counts = t.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # one row for each partition
    return t.join(F.broadcast(offsets), part == F.col("_part")).select(*cols, (F.col("_off") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def offsets(sizes: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, <c>_offset): for each of ``columns`` the sum over all smaller keys. ``sizes`` has one row for each tile."""
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(key, *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("bigint").alias(f"{c}_offset") for c in columns])


def percentile_scale(df: DataFrame, column: str, share: float) -> DataFrame:
    """One row (scale): the value at position floor(n * share) of the sorted column, the last at most; null without rows. Nulls and NaN don't count."""
    fine = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(F.col(column).cast("double").alias("v"))
    ranked = numbered(fine, [F.col("v")])
    n = fine.agg(F.count("*").alias("n"))
    # one row
    at = F.least(F.floor(F.col("n") * share), F.col("n") - 1)
    return ranked.crossJoin(F.broadcast(n)).agg(F.max(F.when(F.col("rn") == at, F.col("v"))).alias("scale"))


def shuffled(df: DataFrame, seed: int, name: str = "turn") -> DataFrame:
    """Adds ``name``, the row's place from 0 in a reproducible random order of its columns' hash."""
    return numbered(df, [F.xxhash64(F.lit(seed), *df.columns), *[F.col(c) for c in df.columns if dict(df.dtypes)[c] not in ("map",)]], name)
