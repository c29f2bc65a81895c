"""Rays from points to their sensors: the cells that they pass, and the evidence that those are empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions import evidence as ev
from pointloom.functions import simplex as sx


def passed_cells(cells: DataFrame, rays: DataFrame, edge: float) -> DataFrame:
    """(ray_id, cell_id, enter, leave): the cells (cell_id, p, q, r, s) that each of ``rays`` (ray_id, x, y, z and the end x1, y1, z1) passes, and the parts of the ray's length, 0 to 1, where.

    Cells and rays meet in a grid of width ``edge``: a ray goes to the cubes around places half an edge apart on it, so none that it touches is left out. A ray is clipped exactly by the four planes of a cell.
    """
    corner = [sx.vec(c) for c in "pqrs"]
    at = lambda v: F.floor(v / edge).cast("bigint")
    t = cells.select("cell_id", *"pqrs")
    for i, a in enumerate("xyz"):
        t = t.withColumn(f"c{a}", F.explode(F.sequence(at(F.least(*[c[i] for c in corner])), at(F.greatest(*[c[i] for c in corner])))))
    a, b = sx.columns(), sx.columns(suffix="1")
    steps = F.ceil(F.sqrt(sx.squared_distance(a, b)) / (edge / 2)).cast("int")
    r = rays.select("ray_id", *[F.col(f"{c}{k}") for k in ("", "1") for c in "xyz"], F.greatest(steps, F.lit(1)).alias("_n"))
    r = r.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    for c in "xyz":
        here = at(F.col(c) + (F.col(f"{c}1") - F.col(c)) * F.col("_k") / F.col("_n"))
        r = r.withColumn(f"c{c}", F.explode(F.array(here - 1, here, here + 1)))
    r = r.drop("_n", "_k").distinct()
    met = t.join(r, ["cx", "cy", "cz"]).drop("cx", "cy", "cz").distinct()
    d = sx.minus(b, a)
    low, high = F.lit(0.0), F.lit(1.0)
    for i in range(4):
        u, v, w = (corner[j] for j in range(4) if j != i)
        n = sx.cross(sx.minus(v, u), sx.minus(w, u))
        # the side of the opposite corner is inside
        way = F.when(sx.dot(n, sx.minus(corner[i], u)) > 0, 1.0).otherwise(-1.0)
        off, slope = sx.dot(n, sx.minus(a, u)) * way, sx.dot(n, d) * way
        cut = -off / F.when(slope != 0, slope)
        low = F.greatest(low, F.when(slope > 0, cut).when((slope == 0) & (off < 0), F.lit(2.0)).otherwise(F.lit(0.0)))
        high = F.least(high, F.when(slope < 0, cut).otherwise(F.lit(1.0)))
    flat = sx.orientation(*corner) == 0
    return met.where(~flat).select("ray_id", "cell_id", low.alias("enter"), high.alias("leave")).where("enter < leave")


def beam_masses(cells: DataFrame, rays: DataFrame, edge: float, scale: str = "scale") -> DataFrame:
    """(cell_id, mass, n): the evidence of all rays that pass a cell, fused in the order of their ids: empty, the surer the farther the middle of the passage is from the ray's point, by the ray's ``scale``."""
    length = F.sqrt(sx.squared_distance(sx.columns(), sx.columns(suffix="1")))
    own = rays.select("ray_id", length.alias("_l"), F.col(scale).alias("_s"))
    t = passed_cells(cells, rays, edge).join(own, "ray_id")
    m = ev.beam_mass((F.col("enter") + F.col("leave")) / 2 * F.col("_l"), F.col("_s"))
    all_ = t.select("cell_id", F.struct("ray_id", m.alias("m")).alias("x")).groupBy("cell_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return all_.select("cell_id", ev.fused(F.transform("x", lambda x: x["m"])).alias("mass"), F.size("x").cast("bigint").alias("n"))


def with_beams(masses: DataFrame, beams: DataFrame) -> DataFrame:
    """``masses`` (cell_id, mass) combined with those of ``beam_masses``."""
    t = masses.join(beams.select("cell_id", F.col("mass").alias("_b")), "cell_id", "left")
    return t.select("cell_id", F.when(F.col("_b").isNull(), F.col("mass")).otherwise(ev.regularised(ev.combined(F.col("mass"), F.col("_b")))).alias("mass"))
