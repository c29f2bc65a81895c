"""Clouds, cells and graphs read from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import evidence as ev
from pointloom.functions import simplex as sx
from pointloom.operators.numbering import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cloud of whole-number coordinates: src, x, y, z and the key k1..k4 of each point."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 16).cast("bigint").alias("src"),
        F.col("l_quantity").cast("double").alias("x"),
        F.floor(F.col("l_extendedprice") / 100).cast("double").alias("y"),
        F.floor(F.col("l_discount") * 1000 + 0.5).cast("double").alias("z"),
        F.col("l_orderkey").cast("bigint").alias("k1"), F.col("l_linenumber").cast("bigint").alias("k2"), F.col("l_partkey").cast("bigint").alias("k3"), F.col("l_suppkey").cast("bigint").alias("k4"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, p, q, r, s, owners): every four points that follow each other in the order of their keys and places; an owner is a corner's source. Up to three last points are over."""
    order = [F.col(c) for c in ("k1", "k2", "k3", "k4", "x", "y", "z")]
    t = numbered(points(spark, sf_dir), order).withColumn("cell_id", F.call_function("div", F.col("rn"), F.lit(4).cast("bigint")))
    x = F.sort_array(F.collect_list(F.struct("rn", "x", "y", "z", "src")))
    four = t.groupBy("cell_id").agg(x.alias("t")).where("size(t) = 4")
    return four.select("cell_id", *[F.struct(*[F.col("t")[i][a].alias(a) for a in "xyz"]).alias(c) for i, c in enumerate("pqrs")], F.col("t.src").alias("owners"))


#: Scales of the evidence that a corner gives, by its place; the axes are those of the space.
def corner_scales(p: sx.Vec) -> list:
    return [10 + p[2] / 10, 200 + p[1] / 10, 1 + p[0] / 10]


def massed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cells`` with ``mass``: what the four corners, as points of a surface seen from above, say of the barycentre, fused in their order."""
    t = cells(spark, sf_dir)
    corners = [sx.vec(c) for c in "pqrs"]
    centre = sx.barycentre(*corners)
    said = [ev.surface_mass(sx.minus(centre, p), corner_scales(p), ev.smoothing(corner_scales(p)), F.lit(1.0)) for p in corners]
    return t.withColumn("mass", ev.fused(F.array(*said)))


def nation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, name, region) and the edges (src, dst), the lesser first, between nations of a region."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("region"))
    a, b = n.select(F.col("id").alias("src"), "region"), n.select(F.col("id").alias("dst"), "region")
    return n, a.join(b, "region").where("src < dst").select("src", "dst")


#: The same cloud in SQL.
POINTS_SQL = (
    "select cast(l_suppkey % 16 as bigint) src, cast(l_quantity as double) x, cast(floor(l_extendedprice / 100) as double) y, "
    "cast(floor(l_discount * 1000 + 5e-1) as double) z, cast(l_orderkey as bigint) k1, cast(l_linenumber as bigint) k2, cast(l_partkey as bigint) k3, cast(l_suppkey as bigint) k4 from lineitem"
)
