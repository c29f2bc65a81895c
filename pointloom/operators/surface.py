"""Surfaces between cells of different labels, and the tree of detail levels that delivers them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Geometric error of a node by its level; fixed values.
ERRORS = (20.0, 10.0, 5.0, 2.0, 1.0, 0.0)


def surface(cells: DataFrame, points: DataFrame, closed: bool = True, longest: float = 500.0) -> DataFrame:
    """(u, v, w): triangles between full (label 0) and empty (label 1) ``cells`` (a, b, c, d, label), their normals towards the empty side.

    With ``closed``, facets of the hull count as empty outside; facets with an edge over ``longest`` are left out. ``points`` (id, x, y, z) has the corners. One shuffle by facet,
    and a join of the few facets that stay with their four corners.
    """
    corners = F.array("a", "b", "c", "d")
    parts = [F.struct(*[corners[j].alias(n) for n, j in zip("uvw", [j for j in range(4) if j != i], strict=True)], corners[i].alias("o")) for i in range(4)]
    rows = cells.select("label", F.explode(F.array(*parts)).alias("f")).select("label", "f.*")
    full = F.col("label") == 0
    at = rows.groupBy("u", "v", "w").agg(F.count_if(full).alias("full"), F.count("*").alias("n"), F.max(F.when(full, F.col("o"))).alias("o"))
    rim = at.where((F.col("full") == 1) & ((F.col("n") == 2) | F.lit(closed)))
    for c in "uvwo":
        rim = rim.join(points.select(F.col("id").alias(c), *[F.col(a).alias(f"{c}{a}") for a in "xyz"]), c)
    d = lambda p, q: [F.col(f"{p}{a}") - F.col(f"{q}{a}") for a in "xyz"]
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    e, f, g = d("v", "u"), d("w", "u"), d("w", "v")
    normal = [e[1] * f[2] - e[2] * f[1], e[2] * f[0] - e[0] * f[2], e[0] * f[1] - e[1] * f[0]]
    inward = dot(normal, d("o", "u")) > 0
    short = F.greatest(dot(e, e), dot(f, f), dot(g, g)) <= longest * longest
    return rim.where(short).select("u", F.when(inward, F.col("w")).otherwise(F.col("v")).alias("v"), F.when(inward, F.col("v")).otherwise(F.col("w")).alias("w"))


def reindexed(triangles: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (tile_id, row, id, x, y, z) and faces (tile_id, u, v, w by row) of ``triangles`` (tile_id, u, v, w): each tile's corners numbered from 0 by id."""
    from pyspark.sql import Window

    used = triangles.select("tile_id", F.explode(F.array("u", "v", "w")).alias("id")).distinct()
    numbered = used.withColumn("row", F.row_number().over(Window.partitionBy("tile_id").orderBy("id")).cast("bigint") - 1)
    faces = triangles
    for c in "uvw":
        faces = faces.join(numbered.select("tile_id", F.col("id").alias(c), F.col("row").alias(f"_{c}")), ["tile_id", c])
    return numbered.join(points.select("id", "x", "y", "z"), "id").select("tile_id", "row", "id", "x", "y", "z"), faces.select("tile_id", *[F.col(f"_{c}").alias(c) for c in "uvw"])


def tile_tree(boxes: DataFrame, depth: int) -> DataFrame:
    """(level, i, j, k, extent of each axis, tiles, error): the nodes of an octree over the centres of ``boxes`` (tile_id and extents), each with the union of its tiles' boxes."""
    ends = {a: ((F.col(f"{a}min") + F.col(f"{a}max")) / 2) for a in "xyz"}
    low = boxes.agg(*[F.min(f"{a}min").alias(f"_l{a}") for a in "xyz"], F.greatest(*[F.max(f"{a}max") - F.min(f"{a}min") for a in "xyz"]).alias("_side"))
    # one row
    t = boxes.crossJoin(F.broadcast(low)).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    wide = F.pow(F.lit(2.0), F.col("level"))
    side = F.when(F.col("_side") > 0, F.col("_side")).otherwise(1.0)
    key = [F.least(F.floor((ends[a] - F.col(f"_l{a}")) / side * wide), wide - 1).cast("bigint").alias(n) for a, n in zip("xyz", "ijk", strict=True)]
    box = [f(f"{a}{s}").alias(f"{a}{s}") for a in "xyz" for f, s in ((F.min, "min"), (F.max, "max"))]
    error = F.get(F.array(*map(F.lit, ERRORS)), F.least("level", F.lit(len(ERRORS) - 1)))
    return t.groupBy("level", *key).agg(*box, F.count("*").alias("tiles")).withColumn("error", error)


def tileset(tree: DataFrame, depth: int) -> str:
    """The tree as JSON of nested nodes; a node's content is named by level and place. The tree's depth (5 in practice) bounds the nodes."""
    if depth > 6:
        raise ValueError("a tree of more than six levels is too large for one document")
    nodes: dict = {}
    for r in tree.orderBy(F.desc("level"), "i", "j", "k").collect():
        half = [(r[f"{a}max"] - r[f"{a}min"]) / 2 for a in "xyz"]
        centre = [(r[f"{a}max"] + r[f"{a}min"]) / 2 for a in "xyz"]
        box = [*centre, half[0], 0, 0, 0, half[1], 0, 0, 0, half[2]]
        children = [nodes.pop((r.level + 1, 2 * r.i + a, 2 * r.j + b, 2 * r.k + c), None) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
        node = {"boundingVolume": {"box": [round(v, 5) for v in box]}, "geometricError": r.error, "refine": "REPLACE", "content": {"uri": f"{r.level}_{r.i}_{r.j}_{r.k}.b3dm"}}
        nodes[r.level, r.i, r.j, r.k] = node | ({"children": kept} if (kept := [c for c in children if c]) else {})
    root = next(iter(nodes.values()), None)
    return json.dumps({"asset": {"version": "1.0"}, "geometricError": ERRORS[0], "root": root})


def decimated(vertices: DataFrame, faces: DataFrame, width: float) -> tuple[DataFrame, DataFrame]:
    """A coarser mesh for each group of ``vertices`` (tile_id, row, x, y, z) and ``faces`` (tile_id, u, v, w by row): vertices of one cube of edge ``width`` become their mean, faces with fewer
    than three different ones go, and of equal ones one stays. Rows are numbered from 0 anew by cube. Vertices without a face go. A sum and three joins by tile and row; no loop.
    """
    from pyspark.sql import Window

    cube = [F.floor(F.col(a) / width).cast("bigint").alias(f"c{a}") for a in "xyz"]
    placed = vertices.select("tile_id", "row", "x", "y", "z", F.struct(*cube).alias("cube"))
    t = faces
    for c in "uvw":
        t = t.join(placed.select("tile_id", F.col("row").alias(c), F.col("cube").alias(f"k{c}")), ["tile_id", c])
    t = t.where("ku <> kv and kv <> kw and ku <> kw")
    # the least corner first, the way round kept
    first = F.least("ku", "kv", "kw")
    turned = F.when(F.col("ku") == first, F.struct("ku", "kv", "kw")).when(F.col("kv") == first, F.struct(F.col("kv").alias("ku"), F.col("kw").alias("kv"), F.col("ku").alias("kw"))).otherwise(F.struct(F.col("kw").alias("ku"), F.col("ku").alias("kv"), F.col("kv").alias("kw")))
    t = t.select("tile_id", turned.alias("f")).distinct()
    means = placed.groupBy("tile_id", "cube").agg(*[F.avg(a).alias(a) for a in "xyz"])
    used = t.select("tile_id", F.explode(F.array("f.ku", "f.kv", "f.kw")).alias("cube")).distinct()
    kept = means.join(used, ["tile_id", "cube"]).withColumn("row", (F.row_number().over(Window.partitionBy("tile_id").orderBy("cube")) - 1).cast("bigint"))
    out = t.select("tile_id", "f.*")
    for c in "uvw":
        out = out.join(kept.select("tile_id", F.col("cube").alias(f"k{c}"), F.col("row").alias(c)), ["tile_id", f"k{c}"])
    return kept.select("tile_id", "row", "x", "y", "z"), out.select("tile_id", "u", "v", "w")


def parents(vertices: DataFrame, faces: DataFrame, tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The meshes of a tree's upper nodes: those of the tiles of each node put together. ``tiles``: (tile_id, node); rows are numbered from 0 in each node, tile by tile.

    Results have the node as tile_id, so they can be decimated and put together again for the level above.
    """
    from pyspark.sql import Window

    sizes = vertices.groupBy("tile_id").agg((F.max("row") + 1).alias("n")).join(tiles, "tile_id")
    before = Window.partitionBy("node").orderBy("tile_id").rowsBetween(Window.unboundedPreceding, -1)
    off = sizes.select("tile_id", "node", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    v = vertices.join(off, "tile_id").select(F.col("node").alias("tile_id"), (F.col("row") + F.col("off")).alias("row"), "x", "y", "z")
    f = faces.join(off, "tile_id").select(F.col("node").alias("tile_id"), *[(F.col(c) + F.col("off")).alias(c) for c in "uvw"])
    return v, f


def finalised(tileset_json: str, transforms: dict[str, list[float]]) -> str:
    """A tileset whose nodes' absolute places (a 4 x 4 matrix by columns for each content uri, moves only) are written relative to their parents', with ERRORS by half of the depth."""
    tree = json.loads(tileset_json)

    def walk(node: dict, above: list[float], depth: int) -> None:
        here = transforms.get(node.get("content", {}).get("uri"), above)
        node["transform"] = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, *(round(a - b, 5) for a, b in zip(here[12:15], above[12:15], strict=True)), 1]
        node["geometricError"] = ERRORS[min(depth // 2, len(ERRORS) - 1)]
        for child in node.get("children", []):
            walk(child, here, depth + 1)

    if tree.get("root"):
        walk(tree["root"], [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], 0)
    return json.dumps(tree)
