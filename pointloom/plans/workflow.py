"""The whole way from raw points to a surface: tiling, Delaunay cells, evidence, labels that the tiles agree on, triangles and files."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import simplex as sx
from pointloom.operators import cuts, delaunay, neighbours, reconstruction, scanlines, surface, tiling
from pointloom.plans.lineage import cut
from pointloom.sources import las, sinks


@dataclass(frozen=True)
class Parameters:
    """Defaults of the main script, where it has them."""

    max_ppt: int = 10_000
    ndtree_depth: int = 4
    nb_samples: int = 3
    dst_scale: float = -1.0
    lam: float = 4.0
    coef_mult: float = 1.0
    max_opt_it: int = 30
    closed: bool = True
    longest: float = 500.0


def shaped(points: DataFrame, size: float) -> DataFrame:
    """``points`` (id, x, y, z, x_origin ..) with axes a1, a2, a3 and scales s1 to s3 of their neighbourhoods, the last axis towards the sensor; points without neighbours have unit axes and scales."""
    shape = neighbours.local_shape(points, size)
    t = points.drop("nx", "ny", "nz", "s1", "s2", "s3").join(shape.select("id", "s1", "s2", "s3", "nx", "ny", "nz"), "id", "left")
    t = t.withColumns({f"n{a}": F.coalesce(f"n{a}", F.lit(1.0 if a == "z" else 0.0)) for a in "xyz"} | {f"s{d}": F.coalesce(f"s{d}", F.lit(1.0)) for d in (1, 2, 3)})
    t = neighbours.flipped(t)
    n = sx.columns("n")
    # two axes at right angles to the normal: the space's axis that is farthest from it gives the first
    flat = (F.abs(n[2]) < 0.9).cast("double")
    up = (1 - flat, F.lit(0.0), flat)
    a1 = sx.cross(n, up)
    a1 = sx.times(a1, 1 / F.sqrt(sx.dot(a1, a1)))
    t = t.withColumn("a1", sx.struct(a1)).withColumn("a3", sx.struct(n))
    return t.withColumn("a2", sx.struct(sx.cross(sx.vec("a3"), sx.vec("a1"))))


def tiled_cells(points: DataFrame, p: Parameters) -> tuple[DataFrame, DataFrame]:
    """The points with their tile_id, and the Delaunay cells (cell_id, a..d, p..s, o_a..o_d, owners, tile_id)."""
    tiled = cut(tiling.balanced_points(points, p.ndtree_depth, p.max_ppt).withColumnRenamed("leaf_id", "tile_id"))
    cells = delaunay.delaunay_cells(tiled)
    at = tiled.select("id", F.struct("x", "y", "z").alias("at"), F.col("tile_id").alias("own"))
    for c, place in zip("abcd", "pqrs", strict=True):
        cells = cells.join(at.select(F.col("id").alias(c), F.col("at").alias(place), F.col("own").alias(f"o_{c}")), c)
    cells = cells.withColumn("cell_id", F.xxhash64(*"abcd")).withColumn("owners", F.array(*[f"o_{c}" for c in "abcd"]))
    return tiled, cut(cells)


def labelled_cells(cells: DataFrame, points: DataFrame, size: float, p: Parameters) -> tuple[DataFrame, int]:
    """``cells`` with ``label`` (1 empty, 0 occupied), and how many shared cells are still in dispute."""
    masses = reconstruction.cell_masses(cells, points, size, p.nb_samples, dst_scale=p.dst_scale)
    costs = reconstruction.unary_costs(masses).select("cell_id", "cost0", "cost1")
    held = cells.select("cell_id", F.explode(F.array_distinct("owners")).alias("tile_id")).join(costs, "cell_id").select("tile_id", "cell_id", "cost0", "cost1")
    walls = cut(reconstruction.facet_weights(reconstruction.facets(cells), p.lam))
    sides = walls.select(F.explode("owners").alias("tile_id"), "a", "b", "weight")
    labels, open_ = cuts.agreed_labels(cut(held), sides, step=p.lam * p.coef_mult, rounds=p.max_opt_it)
    return cells.join(labels, "cell_id"), open_


def reconstructed(points: DataFrame, size: float, p: Parameters = Parameters()) -> tuple[DataFrame, DataFrame, int]:
    """(triangles (tile_id, u, v, w), points with tile_id, cells in dispute) for ``points`` (id, x, y, z, x_origin, y_origin, z_origin). ``size``: the width of the cubes that neighbours are looked for in.

    A triangle belongs to the least tile of its corners.
    """
    spots = shaped(points, size).withColumn("flag", F.lit(0))
    tiled, cells = tiled_cells(points.select("id", "x", "y", "z"), p)
    labels, open_ = labelled_cells(cells, cut(spots), size, p)
    triangles = surface.surface(labels, tiled, p.closed, p.longest)
    own = tiled.select("id", "tile_id")
    t = triangles
    for c in "uvw":
        t = t.join(own.select(F.col("id").alias(c), F.col("tile_id").alias(f"t{c}")), c)
    return t.select(F.least("tu", "tv", "tw").alias("tile_id"), "u", "v", "w"), tiled, open_


def run(spark: SparkSession, source: str, target: str, p: Parameters = Parameters(), size: float = 2.0, binary: bool = True) -> int:
    """Scans (LAS) below ``source`` to meshes <tile>_mesh.ply in ``target``; returns the number of shared cells in dispute."""
    raw = las.read_las(spark, source, columns=("x", "y", "z", "scan_angle", "point_source_id"))
    raw = cut(raw.select("path", "row", "x", "y", "z", F.col("scan_angle").alias("angle"), F.col("point_source_id").alias("line")))
    box = tiling.bbox(raw).first().asDict()
    points = scanlines.preprocessed(raw, box, ["row"], "path").withColumn("id", F.xxhash64("path", "row"))
    triangles, tiled, open_ = reconstructed(cut(points), size, p)
    vertices, faces = surface.reindexed(triangles, tiled)
    sinks.write_meshes(vertices, faces, target, ["x", "y", "z"], binary=binary)
    sinks.named_files(spark, target, "mesh")
    return open_


def main() -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("--input_dir", required=True)
    a.add_argument("--output_dir", required=True)
    a.add_argument("--max_ppt", type=int, default=Parameters.max_ppt)
    a.add_argument("--depth", type=int, default=Parameters.ndtree_depth)
    a.add_argument("--lambda", dest="lam", type=float, default=Parameters.lam)
    a.add_argument("--iterations", type=int, default=Parameters.max_opt_it)
    a.add_argument("--size", type=float, default=2.0)
    o = a.parse_args()
    spark = SparkSession.builder.getOrCreate()
    open_ = run(spark, o.input_dir, o.output_dir, Parameters(max_ppt=o.max_ppt, ndtree_depth=o.depth, lam=o.lam, max_opt_it=o.iterations), o.size)
    print(f"cells in dispute: {open_}")


if __name__ == "__main__":
    main()
