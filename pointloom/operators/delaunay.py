"""Delaunay cells of a tiled cloud: every tile triangulates what it knows and is sent the points that break its own stars, until none is left."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions import predicates
from pointloom.plans.lineage import cut

LEVELS = 12
#: Points sent for one broken cell and tile in a round.
SENT = 4
_V = "abcd"
_CORNERS = [f"{a}{v}" for v in _V for a in "xyz"]
_CELL = "tile_id bigint, a bigint, b bigint, c bigint, d bigint, main bigint, " + ", ".join(f"{c} double" for c in _CORNERS) + ", cx double, cy double, cz double, r2 double"


def _triangulate(t: pa.Table) -> pa.Table:
    """The cells with at least one corner of the tile's own. Outside the hull a corner is -1, (cx, cy, cz) is the normal and r2 is -1."""
    tile = t.column("tile_id")[0].as_py()
    ids, first = np.unique(t.column("id").to_numpy(), return_index=True)
    xyz = np.stack([t.column(a).to_numpy()[first] for a in "xyz"], 1)
    owner = t.column("owner").to_numpy()[first]
    cells = predicates.delaunay(xyz)
    if not len(cells):
        raise ValueError(f"tile {tile}: the points it knows lie in one plane, so the cloud is flat or its extreme points don't span it")
    cells = cells[((owner[cells] == tile) & (cells >= 0)).any(1)]
    ghost = cells < 0
    x = np.where(ghost[..., None], 0.0, xyz[cells])
    centre, r2 = np.zeros((len(cells), 3)), np.full(len(cells), -1.0)
    f = ~ghost.any(1)
    centre[f], r2[f] = predicates.circumspheres(x[f])
    for k in np.flatnonzero(~f):
        # the direction in which the orientation of (corners, point) grows
        g = int(np.flatnonzero(ghost[k])[0])
        o = [c for i, c in enumerate(x[k]) if i != g]
        n = np.cross(o[1] - o[0], o[2] - o[0])
        probe = x[k].copy()
        probe[g] = o[0] + n
        centre[k] = n * (1 if predicates.orientation(probe[None])[0] > 0 else -1)
    out = {"tile_id": np.full(len(cells), tile, np.int64)}
    out |= {v: np.where(ghost[:, i], -1, ids[cells[:, i]]).astype(np.int64) for i, v in enumerate(_V)}
    out["main"] = np.where(ghost, np.iinfo(np.int64).max, owner[cells]).min(1)
    out |= {c: x[:, i // 3, i % 3] for i, c in enumerate(_CORNERS)}
    return pa.table(out | {"cx": centre[:, 0], "cy": centre[:, 1], "cz": centre[:, 2], "r2": r2})


def _breaking(cells: pa.Table, points: pa.Table) -> pa.Table:
    """(tile_id, id, x, y, z, owner): points of one tile that break cells of others, up to SENT for each cell, the deepest first."""
    out: dict[tuple[int, int], int] = {}
    if cells.num_rows and points.num_rows:
        pid = points.column("pid").to_numpy()
        xyz = np.stack([points.column(f"p{a}").to_numpy() for a in "xyz"], 1)
        corner = np.stack([cells.column(c).to_numpy() for c in _CORNERS], 1).reshape(-1, 4, 3)
        verts = np.stack([cells.column(v).to_numpy() for v in _V], 1)
        centre = np.stack([cells.column(f"c{a}").to_numpy() for a in "xyz"], 1)
        r2, tile = cells.column("r2").to_numpy(), cells.column("tile_id").to_numpy()
        # a sphere meets the points between its ends on the axis that tells most points apart
        axis = int(np.argmax(xyz.std(0)))
        by = np.argsort(xyz[:, axis], kind="stable")
        pid, xyz = pid[by], xyz[by]
        reach = np.sqrt(np.maximum(r2, 0)) * (1 + 1e-6)
        lows, highs = np.searchsorted(xyz[:, axis], centre[:, axis] - reach), np.searchsorted(xyz[:, axis], centre[:, axis] + reach, "right")
        for k in range(len(tile)):
            t = corner[k]
            if r2[k] < 0:
                g = int(np.flatnonzero(verts[k] < 0)[0])
                depth = (xyz - t[(g + 1) % 4]) @ centre[k]
                near = np.flatnonzero(depth >= -1e-9 * (np.abs(xyz - t[(g + 1) % 4]).max(1) * np.linalg.norm(centre[k])))
            else:
                inner = r2[k] - ((xyz[lows[k] : highs[k]] - centre[k]) ** 2).sum(1)
                at = np.flatnonzero(inner >= -1e-6 * r2[k])
                near, depth = at + lows[k], dict(zip((at + lows[k]).tolist(), inner[at].tolist(), strict=True))
                near = np.array(sorted(depth, key=lambda q: -depth[q]), np.int64)
            if r2[k] < 0:
                near = near[np.argsort(-depth[near], kind="stable")]
            got = 0
            for p in near.tolist():
                if pid[p] in verts[k]:
                    continue
                if r2[k] < 0:
                    u = t.copy()
                    u[g] = xyz[p]
                    bad = predicates.orientation(u[None])[0] > 0
                else:
                    bad = predicates.in_sphere(t[None], xyz[p])[0]
                if bad:
                    out[int(tile[k]), int(pid[p])] = int(p)
                    got += 1
                    if got == SENT:
                        break
    where = np.fromiter(out.values(), np.int64, len(out))
    own = points.column("ptile")[0].as_py() if points.num_rows else 0
    cols = {"tile_id": np.array([t for t, _ in out], np.int64), "id": np.array([p for _, p in out], np.int64)}
    cols |= {a: xyz[where, i] if len(out) else np.zeros(0) for i, a in enumerate("xyz")}
    return pa.table(cols | {"owner": np.full(len(out), own, np.int64)})


def delaunay_cells(points: DataFrame) -> DataFrame:
    """(tile_id, a, b, c, d): the Delaunay cells of ``points`` (tile_id, id, x, y, z), corners by rising id, each once, in the least of its corners' tiles.

    Of points at one place that of least id stays; null or NaN coordinates take no part. A star (the cells around a point) is right once no point lies in
    any of its spheres, so a tile whose own stars are right is done; only tiles that were sent points work again. Spheres meet tiles by an equi-join of the cubes of a
    grid whose width fits the sphere, so no pair of far apart tiles is looked at. A tile is worked in by one task; twenty thousand points take it some seconds. Flat clouds raise an error.
    """
    fine = " and ".join(f"{a} is not null and not isnan({a})" for a in "xyz")
    pts = points.select(F.col("tile_id").cast("bigint").alias("tile_id"), F.col("id").cast("bigint").alias("id"), *[(F.col(a).cast("double") + 0.0).alias(a) for a in "xyz"]).where(fine)
    own = cut(pts.groupBy("x", "y", "z").agg(F.min(F.struct("id", "tile_id")).alias("k")).select("k.tile_id", "k.id", "x", "y", "z"))
    box = own.agg(*[f(a).alias(f"{s}{a}") for a in "xyz" for s, f in (("l", F.min), ("h", F.max))]).first()
    nothing = own.sparkSession.createDataFrame([], "tile_id bigint, a bigint, b bigint, c bigint, d bigint")
    if box["lx"] is None:
        return nothing
    low, edge = {a: box[f"l{a}"] for a in "xyz"}, max(box[f"h{a}"] - box[f"l{a}"] for a in "xyz") or 1.0
    # a dozen extreme points, so that every tile has cells
    ways = [F.col(a) * s for a in "xyz" for s in (1, -1)] + [F.col("x") * i + F.col("y") * j + F.col("z") * k for i, j, k in ((1, 1, 1), (1, -1, 1), (-1, 1, 1), (1, 1, -1), (-1, -1, -1), (1, -2, 3))]
    far = own.agg(*[F.max_by(F.struct("id", "x", "y", "z", F.col("tile_id").alias("owner")), F.struct(w, "id")).alias(f"e{i}") for i, w in enumerate(ways)])
    seeds = far.select(F.explode(F.array_distinct(F.array(*[f"e{i}" for i in range(len(ways))]))).alias("e")).select("e.*")
    tiles = own.select("tile_id").distinct()
    # a dozen rows
    mail = cut(tiles.crossJoin(F.broadcast(seeds)).where("owner <> tile_id").select("tile_id", "id", "x", "y", "z", "owner"))
    mine = own.withColumn("owner", F.col("tile_id")).select("tile_id", "id", "x", "y", "z", "owner")
    at = lambda v, a, level: F.least(F.greatest(F.floor((v - low[a]) / edge * F.pow(F.lit(2.0), level)), F.lit(0)), F.pow(F.lit(2.0), level) - 1).cast("bigint")
    grid = own.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    ends = [f(a).alias(f"{s}{a}") for a in "xyz" for s, f in (("l", F.min), ("h", F.max))]
    cubes = cut(grid.groupBy("level", *[at(F.col(a), a, F.col("level")).alias(f"i{a}") for a in "xyz"], F.col("tile_id").alias("target")).agg(*ends))
    level = F.when(F.col("r2") < 0, 0).otherwise(F.least(F.greatest(F.floor(F.log2(F.lit(edge) / F.greatest(2 * F.sqrt("r2"), F.lit(edge) * 2.0**-LEVELS))), F.lit(0)), F.lit(LEVELS))).cast("int")
    reach = F.sqrt("r2") * (1 + 1e-6)
    spans = {f"i{a}": F.when(F.col("r2") < 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(at(F.col(f"c{a}") - reach, a, F.col("level")), at(F.col(f"c{a}") + reach, a, F.col("level")))) for a in "xyz"}
    gap = sum((F.pow(F.greatest(F.col(f"l{a}") - F.col(f"c{a}"), F.col(f"c{a}") - F.col(f"h{a}"), F.lit(0.0)), F.lit(2.0)) for a in "xyz"), F.lit(0.0))
    corner = {a: F.when(F.col("a") < 0, F.col(f"{a}b")).otherwise(F.col(f"{a}a")) for a in "xyz"}
    beyond = sum((F.greatest((F.col(f"l{a}") - corner[a]) * F.col(f"c{a}"), (F.col(f"h{a}") - corner[a]) * F.col(f"c{a}")) for a in "xyz"), F.lit(0.0))
    size = sum((F.abs(F.col(f"c{a}")) for a in "xyz"), F.lit(0.0)) * edge
    meets = F.when(F.col("r2") < 0, beyond >= size * -1e-9).otherwise(gap <= F.col("r2") * (1 + 1e-6))
    there = own.select(F.col("tile_id").alias("ptile"), F.col("id").alias("pid"), *[F.col(a).alias(f"p{a}") for a in "xyz"])
    active, known, done = tiles, mail, None
    while True:
        all_known = mine.unionByName(known).join(active, "tile_id", "left_semi")
        cells = cut(all_known.groupBy("tile_id").applyInArrow(_triangulate, _CELL))
        done = cells if done is None else cut(done.join(active, "tile_id", "left_anti").unionByName(cells))
        asked = cells.withColumn("level", level)
        for c, s in spans.items():
            asked = asked.withColumn(c, F.explode(s))
        met = asked.join(cubes, ["level", "ix", "iy", "iz"]).where((F.col("target") != F.col("tile_id")) & meets)
        met = met.select(*cells.columns, "target").dropDuplicates(["tile_id", *_V, "target"])
        new = cut(met.groupBy("target").cogroup(there.groupBy("ptile")).applyInArrow(_breaking, "tile_id bigint, id bigint, x double, y double, z double, owner bigint"))
        if new.isEmpty():
            break
        known = cut(known.unionByName(new))
        active = new.select("tile_id").distinct()
    ids = F.sort_array(F.array(*_V))
    return done.where("r2 >= 0 and main = tile_id").select("tile_id", *[ids[i].alias(v) for i, v in enumerate(_V)])


def dual_edges(cells: DataFrame) -> DataFrame:
    """(u, v, w, first, second): the facets (corners by rising id) of ``cells`` (a, b, c, d), each with the least and the greatest opposite corner of its one or two cells; they are equal on the hull.

    A facet and its two opposite corners name both cells, so these rows are the edges of the Voronoi diagram. One shuffle; a facet has two rows at most.
    """
    corners = F.array(*_V)
    parts = [F.struct(*[corners[j].alias(n) for n, j in zip("uvw", [j for j in range(4) if j != i], strict=True)], corners[i].alias("o")) for i in range(4)]
    rows = cells.select(F.explode(F.array(*parts)).alias("f")).select("f.*")
    return rows.groupBy("u", "v", "w").agg(F.min("o").alias("first"), F.max("o").alias("second"))
