"""Attributes of a cloud handed to vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_colour(vertices: DataFrame, cloud: DataFrame, reach: float = 5.0, none: float = -1.0) -> DataFrame:
    """(x, y, colour): z of the nearest point of ``cloud`` (k1, x, y, z) within ``reach`` of each different vertex (x, y) on both axes, or ``none``.

    Of equally near points the least k1, then the least z counts. A grid join: a vertex meets the points of its own cell of width ``reach`` and of those around it.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    # of points at one place only the first can win
    c = cloud.groupBy("x", "y").agg(F.min(F.struct("k1", "z")).alias("w")).select(F.col("x").alias("cx"), F.col("y").alias("cy"), "w", cell("x").alias("i"), cell("y").alias("j"))
    v = vertices.select("x", "y").distinct()
    around = lambda c: F.explode(F.array(*[cell(c) + k for k in (-1, 0, 1)]))
    met = v.select("x", "y", around("x").alias("i")).select("x", "y", "i", around("y").alias("j"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    near = met.join(c, ["i", "j"]).where((F.abs(dx) <= reach) & (F.abs(dy) <= reach))
    best = near.groupBy("x", "y").agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "w")).alias("b"))
    return v.join(best, ["x", "y"], "left").select("x", "y", F.coalesce("b.w.z", F.lit(none)).alias("colour"))
