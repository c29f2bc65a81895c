"""Attributes, buffers and neighbour files of tiled clouds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cropped(points: DataFrame, **bounds: tuple[float, float]) -> DataFrame:
    """The points within the given bounds of each axis, both ends included."""
    out = points
    for a, (low, high) in bounds.items():
        out = out.where(F.col(a).between(low, high))
    return out


def with_buffer(points: DataFrame, width: float, buffer: float, x: str = "x", y: str = "y") -> DataFrame:
    """(tile_i, tile_j, the columns of ``points``, in_original): every square tile of ``width`` with the points of its own and those of its neighbours within ``buffer`` (at most ``width``) of it.

    A point goes to its own tile and to those whose widened square has it, nine at most: one explode, no join. Points on a lower side belong to the tile above it.
    """
    if buffer > width:
        raise ValueError("a buffer is no wider than a tile")
    own = [F.floor(F.col(c) / width).cast("bigint") for c in (x, y)]
    near = F.array(*[F.struct((own[0] + a).alias("i"), (own[1] + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    t = points.select("*", own[0].alias("_i"), own[1].alias("_j"), F.explode(near).alias("_t"))
    inside = [(F.col(c) >= F.col(f"_t.{k}") * width - buffer) & (F.col(c) <= (F.col(f"_t.{k}") + 1) * width + buffer) for c, k in ((x, "i"), (y, "j"))]
    mine = (F.col("_i") == F.col("_t.i")) & (F.col("_j") == F.col("_t.j"))
    return t.where(inside[0] & inside[1]).select(F.col("_t.i").alias("tile_i"), F.col("_t.j").alias("tile_j"), *points.columns, mine.alias("in_original"))


def without_buffer(buffered: DataFrame) -> DataFrame:
    """The points of a tile's own, without the tag."""
    return buffered.where("in_original").drop("in_original")


def on_buffered(points: DataFrame, width: float, buffer: float, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``run`` makes of the tiles with their buffers, for the points of each tile's own. ``run`` keeps in_original."""
    return without_buffer(run(with_buffer(points, width, buffer)))


def tagged(points: DataFrame, **bounds: tuple[float, float]) -> DataFrame:
    """Adds in_original, 1 for points within the bounds, else 0."""
    inside = F.lit(True)
    for a, (low, high) in bounds.items():
        inside &= F.col(a).between(low, high)
    return points.withColumn("in_original", F.coalesce(inside, F.lit(False)).cast("int"))


def neighbour_files(files: DataFrame, width: float) -> DataFrame:
    """(path, near): for each of ``files`` (path, xmin, ymax: the upper left corner of a square) the up to nine files of its 3 x 3 neighbourhood, itself included."""
    i, j = F.round(F.col("xmin") / width).cast("bigint"), F.round(F.col("ymax") / width).cast("bigint")
    around = F.array(*[F.struct((i + a).alias("i"), (j + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    asked = files.select("path", F.explode(around).alias("k")).select("path", "k.i", "k.j")
    return asked.join(files.select(F.col("path").alias("near"), i.alias("i"), j.alias("j")), ["i", "j"]).select("path", "near")


def value_counts(points: DataFrame, attribute: str) -> DataFrame:
    """(attr, n): how often each value occurs, nulls included."""
    return points.groupBy(F.col(attribute).alias("attr")).agg(F.count("*").alias("n"))


def merged_counts(*counts: DataFrame) -> DataFrame:
    """Counts (attr, n) of several files as one."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("attr").agg(F.sum("n").cast("bigint").alias("n"))


def replaced(points: DataFrame, attribute: str, values: list[tuple]) -> DataFrame:
    """``attribute`` with its values replaced by pairs (old, new); others stay. A value that is to become two others is an error."""
    old = [a for a, _ in values]
    if len(set(old)) < len(old):
        raise ValueError("a value is to be replaced twice")
    if not values:
        return points
    out = F.col(attribute)
    made = F.when(F.lit(False), out)
    for a, b in values:
        made = made.when(F.col(attribute) == a, F.lit(b))
    return points.withColumn(attribute, made.otherwise(out).cast(points.schema[attribute].dataType))


def copied(points: DataFrame, source: str, target: str) -> DataFrame:
    """``target`` as a copy of ``source``."""
    return points.withColumn(target, F.col(source))


def taken_from(points: DataFrame, other: DataFrame, key: str, attribute: str) -> DataFrame:
    """``attribute`` by ``key`` from ``other`` (one row a key) where it is there, else the points' own (null, if they haven't it)."""
    got = other.select(key, F.col(attribute).alias("_a"))
    t = points.join(got, key, "left")
    own = F.col(attribute) if attribute in points.columns else F.lit(None)
    return t.withColumn(attribute, F.coalesce("_a", own)).drop("_a")


def inserted(points: DataFrame, more: DataFrame) -> DataFrame:
    """All points of both; attributes that one of them hasn't are null."""
    return points.unionByName(more, allowMissingColumns=True)


def without_dimensions(points: DataFrame, *names: str) -> DataFrame:
    return points.drop(*names)


def standardised(points: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The columns of ``schema`` (name: type) in its order, cast; missing ones are null and others go."""
    have = set(points.columns)
    return points.select(*[(F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in schema.items()])


def info(points: DataFrame, *by: str) -> DataFrame:
    """Count, extent and the number of different point sources of each group."""
    ends = [f(a).alias(f"{a}{e}") for a in "xyz" for e, f in (("min", F.min), ("max", F.max))]
    more = [F.countDistinct("point_source_id").alias("sources")] if "point_source_id" in points.columns else []
    return points.groupBy(*by).agg(F.count("*").alias("n"), *ends, *more)


def bytes_of_colour(colour: Column) -> Column:
    """The upper byte of a 16-bit colour."""
    return F.call_function("div", colour.cast("bigint"), F.lit(256).cast("bigint"))


def local_origin(points: DataFrame, low: dict[str, float]) -> DataFrame:
    """Coordinates less the whole part of the box's lower corner."""
    return points.withColumns({a: F.col(a) - int(v) for a, v in low.items()})


def sampled_raster(points: DataFrame, raster: DataFrame, west: float, north: float, pixel: float, *bands: str) -> DataFrame:
    """``points`` with the ``bands`` of the pixel they lie in: ``raster`` (row, col, bands) counts rows from the north and columns from the west. Points beyond it have nulls. An equi-join by pixel."""
    at = {"col": F.floor((F.col("x") - west) / pixel).cast("bigint"), "row": F.floor((north - F.col("y")) / pixel).cast("bigint")}
    r = raster.select(F.col("row").alias("_row"), F.col("col").alias("_col"), *[F.col(b).alias(f"_{b}") for b in bands])
    t = points.withColumns({f"_p{k}": v for k, v in at.items()}).join(r, (F.col("_prow") == F.col("_row")) & (F.col("_pcol") == F.col("_col")), "left")
    return t.select(*[c for c in points.columns if c not in bands], *[F.col(f"_{b}").alias(b) for b in bands])
