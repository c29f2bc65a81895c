"""Balanced tiling of a cloud: a regular grid whose cells are merged upwards while they stay small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions import ndtree

AXES = ("x", "y", "z")


def bbox(points: DataFrame, *by: str) -> DataFrame:
    """Least and largest coordinate of each axis and the number of points, for all or for each of ``by``."""
    ends = [f(a).alias(f"{a}{s}") for a in AXES for f, s in ((F.min, "min"), (F.max, "max"))]
    return points.groupBy(*by).agg(*ends, F.count("*").alias("n"))


def grid_cells(points: DataFrame, depth: int) -> DataFrame:
    """Adds ``cell``: the id in a grid of 2**depth bins an axis over the bounding box. Points with a NaN or null coordinate are left out.

    The box is one row, so it is broadcast whatever the cloud's size.
    """
    fine = reduce(lambda a, b: a & b, [F.col(a).isNotNull() & ~F.isnan(a) for a in AXES])
    kept = points.where(fine)
    n = 1 << depth
    box = bbox(kept).drop("n")
    bins = [ndtree.axis_bin(F.col(a), F.col(f"{a}min"), F.col(f"{a}max"), n) for a in AXES]
    return kept.crossJoin(F.broadcast(box)).withColumn("cell", ndtree.cell_id(bins, n)).select(*points.columns, "cell")


def balance(counts: DataFrame, depth: int, limit: int) -> DataFrame:
    """(cell, n, up, leaf): for each cell of ``counts`` (cell, n) the highest ancestor with at most ``limit`` points, else the cell itself.

    ``up`` is the number of levels above the cell, ``leaf`` the ancestor's id on its level. One sum for each level, over cells and not points.
    """
    n = 1 << depth
    at = counts
    for u in range(depth + 1):
        w = Window.partitionBy(ndtree.ancestor(F.col("cell"), n, 3, u))
        at = at.withColumn(f"_t{u}", F.sum("n").over(w))
    up = F.coalesce(*[F.when(F.col(f"_t{u}") <= limit, F.lit(u)) for u in range(depth, -1, -1)], F.lit(0))
    at = at.withColumn("up", up)
    leaf = reduce(lambda c, u: c.when(F.col("up") == u, ndtree.ancestor(F.col("cell"), n, 3, u)), range(depth + 1), F.when(F.lit(False), F.lit(0).cast("bigint")))
    return at.select("cell", "n", "up", leaf.alias("leaf"))


def leaves(balanced: DataFrame) -> DataFrame:
    """(up, leaf, n, leaf_id): the leaves numbered from 0 by falling count. There are as many rows as tiles."""
    sums = balanced.groupBy("up", "leaf").agg(F.sum("n").alias("n"))
    return sums.withColumn("leaf_id", (F.row_number().over(Window.orderBy(F.desc("n"), "up", "leaf")) - 1).cast("bigint"))


def balanced_points(points: DataFrame, depth: int, limit: int) -> DataFrame:
    """Adds ``leaf_id``, the balanced tile of each point. The map from cells to tiles has at most 8**depth rows."""
    celled = grid_cells(points, depth)
    counts = celled.groupBy("cell").agg(F.count("*").alias("n"))
    tree = balance(counts, depth, limit)
    ids = tree.join(leaves(tree).drop("n"), ["up", "leaf"]).select("cell", "leaf_id")
    return celled.join(ids, "cell").select(*points.columns, "leaf_id")


def tile_sizes(points: DataFrame, tile: str) -> DataFrame:
    """(tile_id, n)."""
    return points.groupBy(F.col(tile).alias("tile_id")).agg(F.count("*").alias("n"))


def overflowing(sizes: DataFrame, least: int, most: int) -> DataFrame:
    """(tile_id, n, overflows): tiles of ``least`` points or more; 1 for those of more than ``most``."""
    return sizes.where(F.col("n") >= least).select("tile_id", "n", (F.col("n") > most).cast("int").alias("overflows"))


def totals(sizes: DataFrame) -> DataFrame:
    """One row: all points, the largest and the smallest tile, the number of tiles."""
    return sizes.agg(F.sum("n").alias("total"), F.max("n").alias("largest"), F.min("n").alias("smallest"), F.count("*").alias("tiles"))


def auto_depth(n: Column, most: float) -> Column:
    """The depth of a grid whose cells hold about ``most`` of ``n`` points: ln(n / most) / ln 3, rounded, 0 at least."""
    return F.greatest(F.floor(F.log(n / float(most)) / F.log(F.lit(3.0)) + 0.5), F.lit(0)).cast("bigint")


def extremes(points: DataFrame, tile: str, key: list[str]) -> DataFrame:
    """(tile, key, x, y, z): the least and the greatest point of each tile on each axis, by ``key`` where several are, each once. One pass of minima, no sort."""
    ways = [F.min(F.struct((F.col(a) * s).alias("v"), *key, *[F.col(c).alias(f"_{c}") for c in AXES])).alias(f"{a}{i}") for a in AXES for i, s in enumerate((1, -1))]
    t = points.groupBy(tile).agg(*ways)
    found = F.array(*[F.struct(*[F.col(f"{a}{i}.{k}").alias(k) for k in key], *[F.col(f"{a}{i}._{c}").alias(c) for c in AXES]) for a in AXES for i in range(2)])
    return t.select(tile, F.explode(F.array_distinct(found)).alias("e")).select(tile, "e.*")


def level_boxes(points: DataFrame, levels: int) -> DataFrame:
    """(lvl, ix, iy, iz, n and extents): the boxes of an octree's nodes over a cube whose edge is the cloud's widest extent, from the root (0) down.

    Points are summed up at the finest level alone; the levels above are made of its rows.
    """
    # one row
    box = bbox(points).select(*[F.col(f"{a}min").alias(f"_{a}") for a in AXES], F.greatest(*[F.col(f"{a}max") - F.col(f"{a}min") for a in AXES]).alias("_side"))
    side = F.when(F.col("_side") > 0, F.col("_side")).otherwise(F.lit(1.0))
    w = 1 << (levels - 1)
    bins = [F.least(F.floor((F.col(a) - F.col(f"_{a}")) * w / side), F.lit(w - 1)).cast("bigint").alias(f"i{a}") for a in AXES]
    fine = bbox(points.crossJoin(F.broadcast(box)).select(*AXES, *bins), "ix", "iy", "iz")
    t = fine.withColumn("lvl", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    up = [F.floor(F.col(f"i{a}") / F.pow(F.lit(2.0), F.lit(levels - 1) - F.col("lvl"))).cast("bigint").alias(f"i{a}") for a in AXES]
    ends = [f(f"{a}{e}").alias(f"{a}{e}") for a in AXES for f, e in ((F.min, "min"), (F.max, "max"))]
    return t.groupBy("lvl", *up).agg(F.sum("n").alias("n"), *ends)
