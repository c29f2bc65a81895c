"""Tables of Delaunay cells: what tiles send each other, what they keep, how they are linked and whether they agree.

``cells``: cell_id, corners a, b, c, d (-1 outside the hull), their places p, q, r, s and tiles o_a, o_b, o_c, o_d.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions import simplex as sx

_V = "abcd"


def corners(cells: DataFrame) -> DataFrame:
    """(cell_id, id, owner, at): a row for each corner of each cell that is a point."""
    parts = F.array(*[F.struct(F.col(c).alias("id"), F.col(f"o_{c}").alias("owner"), F.col(p).alias("at")) for c, p in zip(_V, "pqrs", strict=True)])
    return cells.select("cell_id", F.explode(parts).alias("v")).select("cell_id", "v.*").where("id >= 0")


def neighbour_mail(cells: DataFrame) -> DataFrame:
    """(src, dst, id, at): for every cell and corner, the corners of other tiles that the corner's tile should know, sent by the tile they belong to; each once. Made from each row alone."""
    v = F.array(*[F.struct(F.col(c).alias("id"), F.col(f"o_{c}").alias("owner"), F.col(p).alias("at")) for c, p in zip(_V, "pqrs", strict=True)])
    t = cells.select(F.filter(v, lambda x: x["id"] >= 0).alias("v"))
    t = t.select("v", F.explode(F.array_distinct(F.transform("v", lambda x: x["owner"]))).alias("dst"))
    return t.select("dst", F.explode(F.filter("v", lambda x: x["owner"] != F.col("dst"))).alias("x")).select(F.col("x.owner").alias("src"), "dst", "x.id", "x.at").distinct()


def tile_edges(cells: DataFrame) -> DataFrame:
    """(src, dst, n): the tiles that share cells, the lesser first, and how many."""
    o = F.array_sort(F.array_distinct(F.array(*[F.col(f"o_{c}") for c in _V])))
    t = cells.select(o.alias("o"), F.explode(o).alias("src"))
    return t.select("src", F.explode(F.filter("o", lambda x: x > F.col("src"))).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def tile_boxes(cells: DataFrame) -> DataFrame:
    """(tile_id, n and extents): the box of each tile's own corners."""
    t = corners(cells).select("owner", "id", "at").distinct()
    ends = [f(f"at.{a}").alias(f"{a}{e}") for a in "xyz" for e, f in (("min", F.min), ("max", F.max))]
    return t.groupBy(F.col("owner").alias("tile_id")).agg(F.count("*").alias("n"), *ends)


def crown(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """(tile_id, id): the points of each tile that other tiles may need: corners of cells outside the hull, and of cells whose sphere sticks out of the tile's box.

    ``cells`` also has tile_id, the tile that made it; ``boxes``: tile_id and extents.
    """
    p = [sx.vec(c) for c in "pqrs"]
    t = cells.join(boxes, "tile_id").withColumn("_c", sx.struct(sx.circumcentre(*p)))
    low, high = sx.columns(suffix="min"), sx.columns(suffix="max")
    inside = F.coalesce(sx.sphere_inside(sx.vec("_c"), sx.squared_distance(sx.vec("_c"), p[0]), low, high), F.lit(False))
    ghost = F.least(*[F.col(c) for c in _V]) < 0
    out = t.where(ghost | ~inside).select("tile_id", F.explode(F.array(*[F.struct(F.col(c).alias("id"), F.col(f"o_{c}").alias("owner")) for c in _V])).alias("v"))
    return out.where("v.id >= 0 and v.owner = tile_id").select("tile_id", "v.id").distinct()


def kept_points(cells: DataFrame) -> DataFrame:
    """(tile_id, id): the points that a tile (``tile_id`` of the cells it made) must keep: those in a cell with a corner of its own. The others' cells are all foreign."""
    own = F.exists(F.array(*[F.col(f"o_{c}") for c in _V]), lambda o: o == F.col("tile_id"))
    return cells.where(own).select("tile_id", F.explode(F.array(*_V)).alias("id")).where("id >= 0").distinct()


def facet_links(cells: DataFrame) -> DataFrame:
    """(a, b): pairs of cells that share a facet, the lesser id first."""
    parts = [F.struct(*[F.col(c).alias(n) for n, c in zip("uvw", [x for x in _V if x != o], strict=True)]) for o in _V]
    rows = cells.select("cell_id", F.explode(F.array(*parts)).alias("f"))
    return rows.groupBy("f").agg(F.min("cell_id").alias("a"), F.max("cell_id").alias("b"), F.count("*").alias("n")).where("n = 2").select("a", "b")


def ring(cells: DataFrame, points: DataFrame) -> DataFrame:
    """(id, other): the corners that share a cell with each of ``points`` (id)."""
    t = cells.select(F.array(*_V).alias("v"), F.explode(F.array(*_V)).alias("id")).where("id >= 0").join(points.select("id"), "id", "left_semi")
    return t.select("id", F.explode(F.array_remove("v", F.col("id"))).alias("other")).where("other >= 0").distinct()


def merge_graph(cells: DataFrame) -> DataFrame:
    """(a, b, tiles): the links between cells of different main tiles, along which tiles are put together."""
    main = cells.select("cell_id", F.array_min(F.array(*[F.col(f"o_{c}") for c in _V])).alias("m"))
    t = facet_links(cells).join(main.withColumnsRenamed({"cell_id": "a", "m": "ma"}), "a").join(main.withColumnsRenamed({"cell_id": "b", "m": "mb"}), "b")
    return t.where("ma <> mb").select("a", "b", F.concat_ws("-", F.least("ma", "mb"), F.greatest("ma", "mb")).alias("tiles"))


def faults(cells: DataFrame) -> DataFrame:
    """(kind, n): how often each rule is broken, 0 if never: a facet in more than two cells, corners that aren't different, flat cells, two cells of the same corners, and, where tile_id is there,
    cells that are kept by another than their main tile."""
    v = F.array(*_V)
    rows = cells.select(F.explode(F.array(*[F.array_sort(F.array(*[F.col(c) for c in _V if c != o])) for o in _V])).alias("f"))
    many = rows.groupBy("f").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 2).alias("n")).select(F.lit("facet").alias("kind"), "n")
    twice = cells.groupBy(F.array_sort(v)).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n")).select(F.lit("repeated").alias("kind"), "n")
    p = [sx.vec(c) for c in "pqrs"]
    one = [F.count_if(F.size(F.array_distinct(v)) < 4).alias("corners"), F.count_if(sx.orientation(*p) == 0).alias("flat")]
    if "tile_id" in cells.columns:
        one.append(F.count_if(F.col("tile_id") != F.array_min(F.array(*[F.col(f"o_{c}") for c in _V]))).alias("owner"))
    rest = cells.where(F.array_min(v) >= 0).agg(*one)
    names = rest.columns
    rest = rest.select(F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")
    return many.unionByName(twice).unionByName(rest)


def disagreements(cells: DataFrame) -> DataFrame:
    """(tile_k, tile_l, n): over the cells that every tile made (tile_id), those that one of two tiles has and the other, though it has a corner in them, hasn't."""
    o = F.array_distinct(F.array(*[F.col(f"o_{c}") for c in _V]))
    key = F.array_sort(F.array(*_V))
    t = cells.select(key.alias("key"), "tile_id", o.alias("o")).where(F.array_contains("o", F.col("tile_id")))
    asked = t.select("key", F.col("tile_id").alias("tile_k"), F.explode("o").alias("tile_l")).where("tile_k <> tile_l").distinct()
    return asked.join(t.select("key", F.col("tile_id").alias("tile_l")), ["key", "tile_l"], "left_anti").groupBy("tile_k", "tile_l").agg(F.count("*").alias("n"))


def voronoi_lines(cells: DataFrame) -> DataFrame:
    """(a, b, p, q): the edges of the Voronoi diagram inside the cloud: the circumcentres of every two cells that share a facet."""
    at = cells.select("cell_id", sx.struct(sx.circumcentre(*[sx.vec(c) for c in "pqrs"])).alias("m"))
    t = facet_links(cells)
    return t.join(at.withColumnsRenamed({"cell_id": "a", "m": "p"}), "a").join(at.withColumnsRenamed({"cell_id": "b", "m": "q"}), "b").select("a", "b", "p", "q")


def soup(cells: DataFrame, main_only: bool = False) -> DataFrame:
    """(tile_id, cell_id, p, q, r, s): the cells' corners by tile; of all tiles that have a corner in them, or of the main tile alone."""
    o = F.array(*[F.col(f"o_{c}") for c in _V])
    return cells.select((F.array_min(o) if main_only else F.explode(F.array_distinct(o))).alias("tile_id"), "cell_id", *"pqrs")


def exported(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (tile_id, row, id, x, y, z, owner) and simplices (tile_id, cell_id, v: four rows) of each main tile, the form that files have."""
    from pyspark.sql import Window

    main = cells.withColumn("tile_id", F.array_min(F.array(*[F.col(f"o_{c}") for c in _V])))
    used = main.select("tile_id", F.explode(F.array(*[F.struct(F.col(c).alias("id"), F.col(p).alias("at"), F.col(f"o_{c}").alias("owner")) for c, p in zip(_V, "pqrs", strict=True)])).alias("v")).select("tile_id", "v.*").distinct()
    vertices = used.withColumn("row", (F.row_number().over(Window.partitionBy("tile_id").orderBy("id")) - 1).cast("bigint"))
    t = main.select("tile_id", "cell_id", F.posexplode(F.array(*_V)).alias("k", "id")).join(vertices.select("tile_id", "id", "row"), ["tile_id", "id"])
    simplices = t.groupBy("tile_id", "cell_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "row"))), lambda x: x["row"]).alias("v"))
    return vertices.select("tile_id", "row", "id", "at.x", "at.y", "at.z", "owner"), simplices


def imported(vertices: DataFrame, simplices: DataFrame) -> DataFrame:
    """``cells`` from the tables that ``exported`` gives."""
    t = simplices.select("tile_id", "cell_id", F.posexplode("v").alias("k", "row")).join(vertices, ["tile_id", "row"])
    x = F.sort_array(F.collect_list(F.struct("k", "id", "x", "y", "z", "owner")))
    t = t.groupBy("cell_id").agg(x.alias("x"))
    return t.select("cell_id", *[F.col("x")[i]["id"].alias(c) for i, c in enumerate(_V)], *[F.struct(*[F.col("x")[i][a].alias(a) for a in "xyz"]).alias(c) for i, c in enumerate("pqrs")], *[F.col("x")[i]["owner"].alias(f"o_{c}") for i, c in enumerate(_V)])


def shown(cells: DataFrame, how: str = "all") -> DataFrame:
    """The cells that a dump has: ``all``, ``finite`` (no corner outside), ``local`` (one tile's), ``mixed`` (several tiles')."""
    o = F.size(F.array_distinct(F.array(*[F.col(f"o_{c}") for c in _V])))
    ghost = F.least(*[F.col(c) for c in _V]) < 0
    return cells.where({"all": F.lit(True), "finite": ~ghost, "local": ~ghost & (o == 1), "mixed": ~ghost & (o > 1)}[how])
