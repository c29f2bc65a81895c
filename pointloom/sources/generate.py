"""Random clouds, the same in every run and however many tasks make them: each coordinate is a hash of the seed and the point's number."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Box = tuple[float, float, float, float, float, float]


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1)."""
    return F.xxhash64(F.lit(seed), *parts).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(float(1 << 53))


def gaussian(seed: int, *parts: Column) -> Column:
    """A standard normal number."""
    u, v = uniform(seed, F.lit(0), *parts), uniform(seed, F.lit(1), *parts)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def uniform_cloud(spark: SparkSession, n: int, box: Box, side: int = 1, seed: int = 0, tile: int | None = None) -> DataFrame:
    """(tile_id, id, x, y, z): floor(n / side**3) uniform points in each cell of a grid of ``side`` bins an axis over ``box`` (xmin, xmax, ymin ..), or in one ``tile``."""
    each = n // side**3
    rows = spark.range(each * side**3) if tile is None else spark.range(each * tile, each * (tile + 1))
    t = rows.select(F.call_function("div", F.col("id"), F.lit(max(each, 1)).cast("bigint")).alias("tile_id"), "id")
    cell = [F.call_function("div", F.col("tile_id"), F.lit(side**k).cast("bigint")) % side for k in (2, 1, 0)]
    at = [F.lit(box[2 * k]) + (cell[k] + uniform(seed, F.lit(k), F.col("id"))) * ((box[2 * k + 1] - box[2 * k]) / side) for k in range(3)]
    return t.select("tile_id", "id", *[v.alias(a) for v, a in zip(at, "xyz", strict=True)])


def clustered_cloud(spark: SparkSession, n: int, box: Box, kernels: int, seed: int = 0) -> DataFrame:
    """(kernel, id, x, y, z): ``n`` points dealt to ``kernels`` normal clusters with uniform centres; a cluster's deviation is from L / 10,000 to L / 50 more, L being the box's width in x. Points outside the box are left out."""
    length = box[1] - box[0]
    t = spark.range(n).select((F.col("id") % kernels).alias("kernel"), "id")
    deviation = length / 10_000 + uniform(seed, F.lit("s"), F.col("kernel")) * (length / 50)
    at = {a: F.lit(box[2 * k]) + uniform(seed, F.lit(k), F.col("kernel")) * (box[2 * k + 1] - box[2 * k]) + gaussian(seed, F.lit(k), F.col("id")) * deviation for k, a in enumerate("xyz")}
    inside = " and ".join(f"{a} between {box[2 * k]} and {box[2 * k + 1]}" for k, a in enumerate("xyz"))
    return t.select("kernel", "id", *[v.alias(a) for a, v in at.items()]).where(inside)


def generated(spark: SparkSession, params: dict[str, str], box: Box, kind: str = "random_normal", seed: int = 0) -> DataFrame:
    """A cloud by parameters: ``nbp`` points and ``max_ppt`` a tile, or both and a depth as ``nbp_and_depth`` ("N:D"); clusters are 3 * nbp / max_ppt, 1 at least."""
    n, depth = int(params.get("nbp", 10_000)), int(params.get("ndtree_depth", 0))
    if both := params.get("nbp_and_depth"):
        n, depth = (int(v) for v in both.split(":"))
    if kind == "random_uniform":
        return uniform_cloud(spark, n, box, 1 << max(depth, 0), seed)
    return clustered_cloud(spark, n, box, max(1, 3 * n // int(params.get("max_ppt", 10_000))), seed)
