"""Fewer points that keep a cloud's shape: nearest-centre relaxation, adaptive thinning by local scale, subsamples and flags."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.neighbours import nearest_of, within
from pointloom.plans.lineage import cut

#: Rounds of relaxation; share of centres that get a point behind the surface in the last round. Fixed values.
ROUNDS, INNER_SHARE = 10, 0.2


def assigned(points: DataFrame, centres: DataFrame, size: float) -> DataFrame:
    """(id, centre): the nearest of ``centres`` (id, x, y, z) for each of ``points`` (id, x, y, z), the least id of equally near ones."""
    return nearest_of(points, centres, 1, size).select(F.col("query_id").alias("id"), F.col("id").alias("centre"))


def assigned_to_few(points: DataFrame, centres: list[tuple], axes: str = "xyz") -> DataFrame:
    """Adds ``centre``, the number of the nearest of a few ``centres`` (tuples over ``axes``), the first of equals; one expression, no join."""
    d2 = [F.struct(sum((F.col(a) - float(v)) * (F.col(a) - float(v)) for a, v in zip(axes, c, strict=True)).alias("d2"), F.lit(i).cast("bigint").alias("i")) for i, c in enumerate(centres)]
    return points.withColumn("centre", F.array_min(F.array(*d2))["i"])


def centroids(points: DataFrame, *means: str) -> DataFrame:
    """(centre, n, the mean of each of ``means``) over ``points`` (centre and the columns)."""
    return points.groupBy("centre").agg(F.count("*").alias("n"), *[(F.sum(c) / F.count("*")).alias(c) for c in means])


def relaxed(points: DataFrame, centres: DataFrame, size: float, rounds: int = ROUNDS, seed: int = 0, extra: bool = True) -> DataFrame:
    """(id, x, y, z): ``centres`` (id, x, y, z) moved ``rounds`` times to the mean of the ``points`` that are nearest to them; means outside the points' box, and centres without points, stay.

    ``points``: id, x, y, z, normal nx, ny, nz, scale (the largest of a point's scales) and line of sight lx, ly, lz. With ``extra``, the last round adds, for a hashed fifth of the centres whose
    mean line of sight and normal agree (cosine over 0.7), a point a third of the scale behind the surface, with ids from the greatest on.
    """
    pts = cut(points)
    box = {a: (F.min(a), F.max(a)) for a in "xyz"}
    ends = pts.agg(*[f.alias(f"{a}{k}") for a, (lo, hi) in box.items() for k, f in (("l", lo), ("h", hi))]).first()
    if ends["xl"] is None:
        return centres.select("id", "x", "y", "z")
    inside = lambda c: F.lit(True) if not c else sum((F.when(v.between(ends[f"{a}l"], ends[f"{a}h"]), 0).otherwise(1) for a, v in c.items()), F.lit(0)) == 0
    at = cut(centres.select("id", *[F.col(a).cast("double").alias(a) for a in "xyz"]))
    more = None
    for turn in range(rounds):
        own = assigned(pts, at, size).join(pts, "id")
        mean = cut(centroids(own, *"xyz", "nx", "ny", "nz", "lx", "ly", "lz", "scale").withColumnsRenamed({"centre": "id"} | {a: f"m{a}" for a in "xyz"}))
        t = at.join(mean, "id", "left")
        good = F.col("mx").isNotNull() & inside({a: F.col(f"m{a}") for a in "xyz"})
        moved = t.select("id", *[F.when(good, F.col(f"m{a}")).otherwise(F.col(a)).alias(a) for a in "xyz"])
        if extra and turn == rounds - 1:
            length = lambda p: F.sqrt(sum(F.col(f"{p}{a}") * F.col(f"{p}{a}") for a in "xyz"))
            cosine = sum(F.col(f"n{a}") * F.col(f"l{a}") for a in "xyz") / F.nullif(length("n") * length("l"), F.lit(0.0))
            drawn = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1000)) < int(1000 * INNER_SHARE)
            behind = {a: F.col(f"m{a}") - F.col(f"l{a}") * F.col("scale") / 3 for a in "xyz"}
            more = mean.where(drawn & (cosine > 0.7) & inside(behind)).select("id", *[v.alias(a) for a, v in behind.items()])
        at = cut(moved)
    if more is None:
        return at
    last = at.agg(F.max("id").alias("_last"))
    # one row
    return at.unionByName(more.crossJoin(F.broadcast(last)).select((F.col("id") + F.col("_last") + 1).alias("id"), "x", "y", "z"))


def thinned(points: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """``points`` (tile_id, id, x, y, z, axes a1..a3 as structs, scales s1..s3) without those that are near a kept one: along some axis of its own within ``share`` of the point's scale on that axis
    and nearer than its largest scale.

    Points of a tile are looked at in a hashed order, one after the other, in one task; the tiling bounds a tile. Tiles are thinned apart.
    """

    def one(t: pa.Table) -> pa.Table:
        x = np.stack([t.column(a).to_numpy() for a in "xyz"], 1)
        scale = np.stack([t.column(f"s{d}").to_numpy() for d in (1, 2, 3)], 1)
        axes = np.stack([np.stack([t.column(f"a{d}").combine_chunks().field(a).to_numpy() for a in "xyz"], 1) for d in (1, 2, 3)], 1)
        mixed = (t.column("id").to_numpy().astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(mixed ^ (mixed >> np.uint64(29)), kind="stable")
        width = max(float(np.median(scale.max(1))), 1e-9)
        grid: dict[tuple[int, int, int], list[int]] = {}
        kept = np.zeros(len(x), bool)
        for i in order.tolist():
            reach = float(scale[i].max())
            lo, hi = np.floor((x[i] - reach) / width).astype(int), np.floor((x[i] + reach) / width).astype(int)
            if np.prod(hi - lo + 1) > len(grid):
                near = [j for g in grid.values() for j in g]
            else:
                near = [j for a in range(lo[0], hi[0] + 1) for b in range(lo[1], hi[1] + 1) for c in range(lo[2], hi[2] + 1) for j in grid.get((a, b, c), ())]
            if near:
                d = x[near] - x[i]
                d = d[(d**2).sum(1) <= reach**2]
                n2 = (axes[i] ** 2).sum(1)
                if len(d) and (np.abs(d @ axes[i].T / np.where(n2 > 0, n2, 1)) < share * scale[i]).any():
                    continue
            kept[i] = True
            grid.setdefault(tuple(np.floor(x[i] / width).astype(int).tolist()), []).append(i)
        return t.select(["tile_id", "id"]).filter(pa.array(kept))

    kinds = dict(points.dtypes)
    slim = points.select("tile_id", "id", "x", "y", "z", "a1", "a2", "a3", "s1", "s2", "s3")
    return points.join(slim.groupBy("tile_id").applyInArrow(one, f"tile_id {kinds['tile_id']}, id {kinds['id']}"), ["tile_id", "id"], "left_semi").select(*points.columns)


def spaced(points: DataFrame, radius: float, seed: int = 0) -> DataFrame:
    """``points`` (id, x, y, z) without those that have a point of lesser hash within ``radius``: what stays is spread out and doesn't depend on the partitioning. A join of cubes, no loop."""
    turn = F.xxhash64(F.lit(seed), "id")
    rank = points.select("id", turn.alias("t"))
    pairs = within(points, points, radius).where("query_id <> id").join(rank.withColumnsRenamed({"id": "query_id", "t": "tq"}), "query_id").join(rank, "id")
    out = pairs.where("t < tq or (t = tq and id < query_id)").select(F.col("query_id").alias("id")).distinct()
    return points.join(out, "id", "left_anti")


def subsample(df: DataFrame, share: float, *key: str, seed: int = 0) -> DataFrame:
    """The rows whose hash of ``key`` is in the first ``share``: the same rows in every run."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *(key or df.columns)), F.lit(1 << 30)) < int(share * (1 << 30)))


def masked(df: DataFrame, mask: Column) -> DataFrame:
    """The rows where ``mask`` holds; nulls don't."""
    return df.where(F.coalesce(mask, F.lit(False)))


def flag(column: Column, bit: int) -> Column:
    """Whether a bit is set."""
    return F.shiftright(column, bit).bitwiseAND(F.lit(1)) == 1


def with_flag(column: Column, bit: int, value: Column | bool) -> Column:
    """``column`` with a bit set to ``value``."""
    one = F.lit(1 << bit)
    on = value if isinstance(value, Column) else F.lit(value)
    return F.when(on, column.bitwiseOR(one)).otherwise(column.bitwiseAND(F.lit(~(1 << bit))))


def all_flags(column: Column, mask: int) -> Column:
    return column.bitwiseAND(F.lit(mask)) == mask


def any_flag(column: Column, mask: int) -> Column:
    return column.bitwiseAND(F.lit(mask)) != 0
