"""From evidence at points to labels of cells: masses of Delaunay cells, costs, weights, one round of dual decomposition, energies and graphs.

``cells``: cell_id, p, q, r, s (structs x, y, z), ``owners`` (the tile of each corner) as needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions import evidence as ev
from pointloom.functions import simplex as sx
from pointloom.operators.neighbours import nearest_of
from pointloom.plans.lineage import cut

#: Points that a sample of a cell is judged by; share of the shape prior in a facet's weight; weight where none can be computed; cost that rules a label out. Fixed values.
NEAREST, SHAPE_SHARE, NO_WEIGHT, RULED_OUT = 30, 0.05, 100.0, 1e8


def _uniform(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(float(1 << 53))


def samples(cells: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(cell_id, sample, x, y, z): the barycentre (0) and n - 1 points of each cell, uniform by a hash of the cell's id."""
    p, q, r, s = (sx.vec(c) for c in "pqrs")
    k = F.col("sample")
    u = [_uniform(F.lit(seed + i), "cell_id", k) for i in range(3)]
    drawn, first = sx.in_tetrahedron(p, q, r, s, *u), sx.barycentre(p, q, r, s)
    t = cells.select("cell_id", *"pqrs", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample"))
    return t.select("cell_id", "sample", *[F.when(k == 0, a).otherwise(b).alias(c) for c, a, b in zip("xyz", first, drawn, strict=True)])


def point_masses(pairs: DataFrame, dst_scale: float = -1.0) -> DataFrame:
    """Adds ``mass`` to ``pairs`` of a place (sx, sy, sz) and a point (x, y, z, axes a1, a2, a3 as structs, scales s1 to s3, sensor x_origin .., flag): what the point says of the place.

    The last axis is turned to the sensor. With ``dst_scale`` of 0 or more, points of a coarser scale count less; with one over 0, flagged points (flag > 0) a fifth. Points with a flag below 0 say nothing.
    """
    p, s = sx.columns(), sx.columns("s")
    axes = [sx.vec(f"a{d}") for d in (1, 2, 3)]
    scales = [F.col(f"s{d}") for d in (1, 2, 3)]
    c = [sx.projection(p, s, a) for a in axes]
    towards = sx.dot(sx.minus((F.col("x_origin"), F.col("y_origin"), F.col("z_origin")), p), axes[2])
    c[2] = F.when(towards < 0, -c[2]).otherwise(c[2])
    trust = ev.confidence(scales, dst_scale)
    if dst_scale > 0:
        trust = trust * F.when(F.col("flag") > 0, F.lit(0.2)).otherwise(F.lit(1.0))
    return pairs.where("flag is null or flag >= 0").withColumn("mass", ev.surface_mass(c, scales, ev.smoothing(scales), trust))


def cell_masses(cells: DataFrame, points: DataFrame, size: float, n_samples: int = 3, k: int = NEAREST, dst_scale: float = -1.0, seed: int = 0) -> DataFrame:
    """(cell_id, mass): for each cell the mean over its samples of the masses that the ``k`` nearest ``points`` give to the sample, fused from the nearest on.

    ``points``: id and the columns that ``point_masses`` wants. ``size``: the width of the cubes that neighbours are looked for in. A cell without points near (an empty cloud) is unknown.
    """
    at = cut(samples(cells, n_samples, seed).withColumn("id", F.xxhash64("cell_id", "sample")))
    near = nearest_of(at, points, k, size).select(F.col("query_id"), "rank", F.col("id").alias("pid"))
    where = at.select(F.col("id").alias("query_id"), "cell_id", "sample", *[F.col(a).alias(f"s{a}") for a in "xyz"])
    pairs = near.join(where, "query_id").join(points.withColumnRenamed("id", "pid"), "pid")
    said = point_masses(pairs, dst_scale).groupBy("cell_id", "sample").agg(F.sort_array(F.collect_list(F.struct("rank", "pid", "mass"))).alias("x"))
    fused = said.select("cell_id", ev.fused(F.transform("x", lambda x: x["mass"])).alias("m"))
    mean = fused.groupBy("cell_id").agg(*[F.avg(f"m.{c}").alias(c) for c in "eou"])
    every = cells.select("cell_id").distinct().join(mean, "cell_id", "left")
    return every.select("cell_id", F.coalesce(F.when(F.col("e").isNotNull(), ev.mass(F.col("e"), F.col("o"), F.col("u"))), ev.unknown()).alias("mass"))


def located(cells: DataFrame, places: DataFrame, edge: float) -> DataFrame:
    """(place_id, cell_id): the cell that each of ``places`` (place_id, x, y, z) lies in, sides included; the least of several.

    Cells and places meet in a grid of width ``edge``. A cell is in the cubes that it has more than a side in common with; a place on a side between cubes is in those of both sides.
    """
    corners = [sx.vec(c) for c in "pqrs"]
    at = lambda v: F.floor(v / edge).cast("bigint")
    t = cells.select("cell_id", *"pqrs")
    here = places.select("place_id", "x", "y", "z")
    for i, a in enumerate("xyz"):
        low, high = at(F.least(*[c[i] for c in corners])), F.ceil(F.greatest(*[c[i] for c in corners]) / edge).cast("bigint") - 1
        t = t.withColumn(f"c{a}", F.explode(F.sequence(low, F.greatest(low, high))))
        cube = at(F.col(a))
        here = here.withColumn(f"c{a}", F.explode(F.when(F.col(a) / edge == cube, F.array(cube - 1, cube)).otherwise(F.array(cube))))
    met = t.join(here, ["cx", "cy", "cz"])
    v = sx.columns()
    p, q, r, s = corners
    whole = sx.orientation(p, q, r, s)
    parts = [sx.orientation(v, q, r, s), sx.orientation(p, v, r, s), sx.orientation(p, q, v, s), sx.orientation(p, q, r, v)]
    inside = whole != 0
    for o in parts:
        inside &= o * whole >= 0
    return met.where(inside).groupBy("place_id").agg(F.min("cell_id").alias("cell_id"))


def with_sensors(masses: DataFrame, cells: DataFrame, sensors: DataFrame, edge: float) -> DataFrame:
    """``masses`` (cell_id, mass), those of cells with sensors (place_id, x, y, z) fused once for each with an almost empty mass; the number of sensors counts, not their order."""
    held = located(cells, sensors, edge).groupBy("cell_id").agg(F.count("*").cast("int").alias("n"))
    one = ev.mass(*[F.lit(v) for v in ev.SENSOR])
    more = lambda m: F.aggregate(F.sequence(F.lit(1), F.col("n")), m, lambda a, _: ev.regularised(ev.combined(a, one)))
    t = masses.join(held, "cell_id", "left")
    return t.select("cell_id", F.when(F.col("n").isNull(), F.col("mass")).otherwise(more(F.col("mass"))).alias("mass"))


def without_conflict(mass: Column) -> Column:
    """A mass whose empty and occupied parts are lessened by what they have in common, and held at 0.95."""
    both = F.least(mass["e"], mass["o"])
    e, o = F.least(mass["e"] - both, F.lit(0.95)), F.least(mass["o"] - both, F.lit(0.95))
    return ev.mass(e, o, 1 - e - o)


def unary_costs(masses: DataFrame) -> DataFrame:
    """(the columns of ``masses``, cost0, cost1): the costs of the labels occupied and empty."""
    m = F.col("mass")
    return masses.withColumns({"cost0": ev.label_cost(m, 0), "cost1": ev.label_cost(m, 1)})


def facets(cells: DataFrame) -> DataFrame:
    """(u, v, w, a, b, pu, pv, pw, ca, cb, owners): the facets that two of ``cells`` (cell_id, corners a..d by rising id, p..s their places, tiles o_a..o_d) share, with both circumcentres and the tiles of the corners."""
    ids, places = F.array("a", "b", "c", "d"), F.array(*"pqrs")
    tiles = F.array(*[f"o_{c}" for c in "abcd"])
    centre = sx.struct(sx.circumcentre(*[sx.vec(c) for c in "pqrs"]))
    parts = []
    for i in range(4):
        j = [k for k in range(4) if k != i]
        parts.append(F.struct(*[ids[k].alias(n) for n, k in zip("uvw", j, strict=True)], *[places[k].alias(f"p{n}") for n, k in zip("uvw", j, strict=True)], F.array_distinct(F.array(*[tiles[k] for k in j])).alias("owners")))
    rows = cells.withColumn("centre", centre).select("cell_id", "centre", F.explode(F.array(*parts)).alias("f")).select("cell_id", "centre", "f.*")
    both = rows.groupBy("u", "v", "w").agg(F.min(F.struct("cell_id", "centre")).alias("x"), F.max(F.struct("cell_id", "centre")).alias("y"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("pu", "pv", "pw", "owners")])
    return both.where("n = 2").select("u", "v", "w", F.col("x.cell_id").alias("a"), F.col("y.cell_id").alias("b"), "pu", "pv", "pw", F.col("x.centre").alias("ca"), F.col("y.centre").alias("cb"), "owners")


def facet_weights(shared: DataFrame, lam: float) -> DataFrame:
    """Adds ``weight`` to ``facets``: lam * area * cosine + a share of the shape prior; NO_WEIGHT where it can't be computed."""
    p, q, r = (sx.vec(f"p{c}") for c in "uvw")
    w = lam * sx.facet_weight(p, q, r, sx.vec("ca"), sx.vec("cb")) + SHAPE_SHARE * sx.shape_prior(p, q, r)
    return shared.withColumn("weight", F.when(w.isNull() | F.isnan(w), F.lit(NO_WEIGHT)).otherwise(w))


def energy(costs: DataFrame, walls: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (unary, pairwise, total): the costs (cell_id, cost0, cost1) of ``labels`` (cell_id, label) and the weights of ``walls`` (a, b, weight) between different labels."""
    one = costs.join(labels, "cell_id").agg(F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("cost1")).otherwise(F.col("cost0"))), F.lit(0.0)).alias("unary"))
    side = lambda c: labels.select(F.col("cell_id").alias(c), F.col("label").alias(f"l{c}"))
    two = walls.join(side("a"), "a").join(side("b"), "b").agg(F.coalesce(F.sum(F.col("weight") * F.abs(F.col("la") - F.col("lb"))), F.lit(0.0)).alias("pairwise"))
    # one row each
    return one.crossJoin(two).select("unary", "pairwise", (F.col("unary") + F.col("pairwise")).alias("total"))


def first_step(volume: Column, lam: float, coefficient: float = 1.0) -> Column:
    """The first step of a cell's multipliers: larger cells move more."""
    return F.log1p(volume) * lam * coefficient


def lagrange_step(shared: DataFrame) -> DataFrame:
    """One update of ``shared`` (cell_id, tile_k, tile_l, label_k, label_l, lagrange, tau, diff): multipliers move by tau times the difference of the labels (the lesser tile's minus
    the greater's, as either sees it), and tau is halved where that isn't the last one."""
    d = F.when(F.col("tile_k") < F.col("tile_l"), F.col("label_k") - F.col("label_l")).otherwise(F.col("label_l") - F.col("label_k"))
    t = shared.withColumn("_d", d)
    moved = {"lagrange": F.col("lagrange") + F.col("tau") * F.col("_d"), "tau": F.when(F.col("_d") != F.col("diff"), F.col("tau") / 2).otherwise(F.col("tau")), "diff": F.col("_d")}
    return t.withColumns(moved).drop("_d")


def shared_costs(costs: DataFrame, shared: DataFrame) -> DataFrame:
    """(tile_id, cell_id, cost0, cost1): the costs (tile_id, cell_id, holders, cost0, cost1) of a tile's cells divided by the tiles that hold them, plus the multipliers of ``shared``:
    their sum (minus for the lesser tile) is added to label 0 where it is positive, else taken off label 1."""
    sign = F.when(F.col("tile_k") < F.col("tile_l"), -F.col("lagrange")).otherwise(F.col("lagrange"))
    push = shared.groupBy(F.col("tile_k").alias("tile_id"), "cell_id").agg(F.sum(sign).alias("push"))
    t = costs.join(push, ["tile_id", "cell_id"], "left").withColumn("push", F.coalesce("push", F.lit(0.0)))
    return t.select("tile_id", "cell_id", (F.col("cost0") / F.col("holders") + F.greatest("push", F.lit(0.0))).alias("cost0"), (F.col("cost1") / F.col("holders") + F.greatest(-F.col("push"), F.lit(0.0))).alias("cost1"))


def hull_costs(cells: DataFrame) -> DataFrame:
    """(cell_id, cost0, cost1) for the outside of hull facets (p, q, r, and s, a point within): above the cloud only empty, below it only occupied is allowed."""
    p, q, r, s = (sx.vec(c) for c in "pqrs")
    n = sx.cross(sx.minus(p, r), sx.minus(q, r))
    # the side that the facet's outward normal points to
    out = F.when(sx.dot(sx.minus(s, r), n) > 0, -n[2]).otherwise(n[2])
    return cells.select("cell_id", F.when(out > 0, F.lit(RULED_OUT)).otherwise(F.lit(0.0)).alias("cost0"), F.when(out > 0, F.lit(0.0)).otherwise(F.lit(RULED_OUT)).alias("cost1"))


def flooded(labels: DataFrame, walls: DataFrame, start: DataFrame) -> DataFrame:
    """(cell_id): the cells that are reached from ``start`` (cell_id) through ``walls`` (a, b) between cells of equal ``labels`` (cell_id, label). A round a step, over the cells just reached."""
    side = lambda c: labels.select(F.col("cell_id").alias(c), F.col("label").alias(f"l{c}"))
    open_ = walls.join(side("a"), "a").join(side("b"), "b").where("la = lb")
    steps = cut(open_.select("a", "b").unionByName(open_.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    new = cut(start.select("cell_id").distinct())
    seen = new
    while not new.isEmpty():
        new = cut(steps.join(new, F.col("a") == F.col("cell_id"), "left_semi").select(F.col("b").alias("cell_id")).distinct().join(seen, "cell_id", "left_anti"))
        seen = cut(seen.unionByName(new))
    return seen


def graph_lines(costs: DataFrame, walls: DataFrame, form: str = "flow") -> DataFrame:
    """(value): a graph as lines of text. ``flow``: ``1 id cost0 cost1`` and ``2 a b weight weight``; ``belief``: vertices ``id -cost0 -cost1`` and edges ``a b`` with the negated table by columns."""
    words = lambda *c: F.concat_ws(" ", *[x.cast("string") for x in c])
    one, two = F.lit("1"), F.lit("2")
    c = lambda n: F.col(n)
    if form == "flow":
        return costs.select(words(one, c("cell_id"), c("cost0"), c("cost1")).alias("value")).unionByName(walls.select(words(two, c("a"), c("b"), c("weight"), c("weight")).alias("value")))
    zero, w = F.lit(0.0), -c("weight")
    return costs.select(words(c("cell_id"), -c("cost0"), -c("cost1")).alias("value")).unionByName(walls.select(words(c("a"), c("b"), zero, w, w, zero).alias("value")))
