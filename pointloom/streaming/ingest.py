"""Counts and extents of tiles that follow a stream of points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions import ndtree
from pointloom.operators.tiling import bbox


def tile_extents(stream: DataFrame, box: dict[str, tuple[float, float]], depth: int) -> DataFrame:
    """A running extent and count of each cell of a grid of 2**depth bins an axis over the fixed ``box``; points outside or without coordinates are left out.

    Works on batches and streams alike; the state is a row for each cell, 8**depth at most.
    """
    inside = reduce(lambda a, b: a & b, [F.col(a).between(low, high) for a, (low, high) in box.items()])
    bins = [ndtree.axis_bin(F.col(a), F.lit(low), F.lit(high), 1 << depth) for a, (low, high) in box.items()]
    return bbox(stream.where(inside).withColumn("cell", ndtree.cell_id(bins, 1 << depth)), "cell")


def scanline_counts(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, line, n): points of each scanline (line, ts) by window of time; rows later than ``late`` behind the newest are dropped by the watermark in streams."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "line").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "line", "n")
