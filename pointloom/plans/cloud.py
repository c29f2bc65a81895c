"""Queries over clouds, cells, tiles and graphs of the test tables, each by an operator of the library. Their SQL is written apart, in ``plans.oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import evidence as ev
from pointloom.functions import ndtree, strings
from pointloom.functions import simplex as sx
from pointloom.operators import attributes, belief, mail, neighbours, numbering, ownership, reconstruction, scanlines, surface, thinning, tiling, transfer, triangulation
from pointloom.sources import generate, sinks, streams, texts
from pointloom.sources.tables import cells, corner_scales, massed_cells, nation_graph, points, table

KEYS = ["k1", "k2", "k3", "k4"]
_div = lambda c, k: F.call_function("div", c, F.lit(k).cast("bigint"))
_big = lambda c: F.col(c).cast("bigint")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(_big("o_orderkey").alias("tile_id"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(_big("l_orderkey").alias("tile_id"), _big("l_linenumber").alias("line"), _big("l_partkey").alias("part"))


# tiles and counts


def tile_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.overflowing(tiling.tile_sizes(points(spark, sf_dir), "k4"), least=50, most=620)


def tile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.totals(tiling.tile_sizes(points(spark, sf_dir), "k4"))


def ndtree_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 4096).cast("bigint").alias("id")).distinct()
    bins = ndtree.cell_bins(F.col("id"), 16, 3)
    return ids.select("id", *[b.cast("bigint").alias(c) for b, c in zip(bins, "ijk", strict=True)], ndtree.cell_id(bins, 16).alias("back"), ndtree.ancestor(F.col("id"), 16, 3, 1).alias("parent"))


def id_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = points(spark, sf_dir).groupBy((F.col("k1") % 97).alias("tile_id")).agg(F.count("*").alias("nv"), F.sum("k2").alias("nf"), F.sum(F.col("k3") % 5).alias("nc"))
    return numbering.offsets(stats, "tile_id", "nv", "nf", "nc")


def auto_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tile_sizes(points(spark, sf_dir), "src").select(F.col("tile_id").alias("src"), "n", tiling.auto_depth(F.col("n"), 10).alias("depth"))


def percentile_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = points(spark, sf_dir)
    both = [numbering.percentile_scale(pts, "y", s).select(F.lit(s).alias("share"), "scale") for s in (0.1, 0.75)]
    return both[0].unionByName(both[1])


def extreme_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.extremes(points(spark, sf_dir), "src", KEYS)


def octree_lod_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.level_boxes(points(spark, sf_dir), 4)


# mail and graphs


def mail_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mail.with_mail(_orders(spark, sf_dir), _lines(spark, sf_dir), F.count("*").alias("n_mail"), F.min("line").alias("first_line"), F.max("part").alias("last_part"))
    return got.select("tile_id", F.coalesce("n_mail", F.lit(0)).cast("bigint").alias("n_mail"), "first_line", "last_part")


def mail_split_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.having_mail(_orders(spark, sf_dir), _lines(spark, sf_dir))


def mail_split_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.without_mail(_orders(spark, sf_dir), _lines(spark, sf_dir))


def deliver_or_retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = nation_graph(spark, sf_dir)[1]
    count = lambda df, how: df.groupBy("tile_id").agg(F.count("*").alias("n")).select(F.lit(how).alias("how"), "tile_id", "n")
    return count(mail.delivered(edges), "deliver").unionByName(count(mail.retained(edges), "retain"))


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.triplets(*nation_graph(spark, sf_dir)).select("src", "dst", "src_name", "dst_name", F.col("src_region").alias("attr"))


def canonical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return mail.canonical(o.select((F.col("o_custkey") % 50).cast("bigint").alias("src"), (F.col("o_orderkey") % 50).cast("bigint").alias("dst")))


def collect_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.neighbours(nation_graph(spark, sf_dir)[1]).select(F.col("id").alias("v"), F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


def grouped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.grouped_values(_lines(spark, sf_dir), "tile_id", "line").select("tile_id", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("vals"))


def clique_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.clique_edges(nation_graph(spark, sf_dir)[1]).groupBy("v").agg(F.count("*").alias("n_edges"))


def update_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, edges = nation_graph(spark, sf_dir)
    got = mail.aggregated(edges, "dst", F.count("*").alias("n"))
    return mail.joined_vertices(vertices.select("id"), got, {"attr": F.coalesce("n", F.lit(0)).cast("bigint")}).select("id", "attr")


def bbox_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = tiling.bbox(points(spark, sf_dir), "k4").withColumnRenamed("k4", "id")
    return mail.box_pairs(boxes, 500.0)


def sent_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = points(spark, sf_dir).select("src", (F.col("k4") % 5).alias("dst"), "x", "y", "z", "k2")
    new = mail.unsent(m.drop("k2"), m.where("k2 = 1").drop("k2"))
    return new.groupBy("src", "dst").agg(F.count("*").alias("n"))


def union_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return attributes.inserted(p.where("x < 10").select("src", "x"), p.where("y < 100").select("src", "y")).groupBy("src").agg(F.count("*").alias("n"))


def distinct_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("src", "x").distinct().agg(F.count("*").alias("n"))


# cells


def simplex_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q, r, s = (sx.vec(c) for c in "pqrs")
    g = sx.barycentre(p, q, r, s)
    return cells(spark, sf_dir).select("cell_id", sx.volume(p, q, r, s).alias("volume"), *[v.alias(f"g{a}") for v, a in zip(g, "xyz", strict=True)], sx.area(p, q, r).alias("area_pqr"), sx.orientation(p, q, r, s).alias("orientation"))


def squared_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("cell_id", *[sx.squared_distance(sx.vec(a), sx.vec(b)).alias(f"d_{a}{b}") for a, b in ("pq", "pr", "ps", "qr", "qs", "rs")])


def axis_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q, s = (sx.vec(c) for c in "pqs")
    t = cells(spark, sf_dir).select("cell_id", sx.projection(p, s, sx.minus(q, p)).alias("c"))
    return t.where("c is not null").select("cell_id", (F.round("c", 9) + 0.0).alias("coef"))


def circumsphere_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each cell's sphere lies in, or touches, a box, and whether that box lies beyond its first facet."""
    p, q, r, s = (sx.vec(c) for c in "pqrs")
    low, high = tuple(map(F.lit, (0.0, 0.0, 0.0))), tuple(map(F.lit, (50.0, 600.0, 100.0)))
    t = cells(spark, sf_dir).withColumn("o", sx.struct(sx.circumoffset(p, q, r, s))).where("o.x is not null")
    # the radius is the offset's length: a corner taken from the centre again would lose its last digits
    off = sx.vec("o")
    t = t.withColumn("c", sx.struct(sx.plus(p, off))).withColumn("radius", F.sqrt(sx.dot(off, off)))
    r2 = F.col("radius") * F.col("radius")
    # rounded at the digit's place as a double, not by its decimal notation
    log_r2 = F.round(2 * F.log("radius") * 1e7) / 1e7
    return t.select("cell_id", log_r2.alias("log_r2"), sx.sphere_inside(sx.vec("c"), r2, low, high).alias("inside"), sx.sphere_touches(sx.vec("c"), r2, low, high).alias("touches"), sx.box_beyond(p, q, r, low, high).alias("beyond"))


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = cells(spark, sf_dir).select("cell_id", sx.angle(sx.vec("p"), sx.vec("q"), sx.vec("r")).alias("a"))
    return t.where("a is not null").select("cell_id", F.round("a", 8).alias("angle"))


def ownership_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.owned(cells(spark, sf_dir)).select("cell_id", "main_id", "kind")


def simplex_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.counts(cells(spark, sf_dir))


def shared_cell_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.shared(cells(spark, sf_dir)).groupBy("tile_k", "tile_l").agg(F.count("*").alias("n_cells"), F.min("cell_id").alias("first_cell"))


def main_first_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.local_ids(cells(spark, sf_dir))


def global_cell_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.global_ids(cells(spark, sf_dir))


def local_id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.local_id_map(cells(spark, sf_dir)).groupBy("tile_k", "tile_l").agg(F.count("*").alias("n"), F.sum("lid_k").alias("sum_k"), F.sum("lid_l").alias("sum_l"))


def filled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    labels = ownership.global_ids(c).select("gid", (F.col("gid") % 3).cast("bigint").alias("label"))
    return ownership.filled_labels(c, labels).groupBy("tile_id", "label").agg(F.count("*").alias("n"), F.sum("lid").alias("lids"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.held(cells(spark, sf_dir)).select("cell_id", F.col("owner").alias("tile_id"), ((F.col("cell_id") + F.col("owner")) % 2).cast("bigint").alias("label"))


def label_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.disagreement(_labels(spark, sf_dir))


def weighted_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    label = lambda k: c.select("cell_id", (F.col("cell_id") % k % 2).alias("label"))
    volume = c.select("cell_id", sx.volume(*[sx.vec(x) for x in "pqrs"]).alias("volume"))
    return ownership.weighted_disagreement(label(2), label(3), volume).select("differing", "total", F.round("weighted", 4).alias("weighted"))


def lagrange_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two updates of the multipliers of all shared cells from labels that change in between."""
    c = cells(spark, sf_dir)
    tau = c.select("cell_id", reconstruction.first_step(sx.volume(*[sx.vec(x) for x in "pqrs"]), 2.0, 5.0).alias("tau"))
    lab = lambda t, k: ((F.col("cell_id") + F.col(t) * k) % 2).cast("bigint")
    t = ownership.shared(c).join(tau, "cell_id").withColumns({"lagrange": F.lit(0.0), "diff": F.lit(0).cast("bigint")})
    for k in (1, 3):
        label = lambda t, k=k: (_div(F.col("cell_id") + F.col(t) * k, k) % 2)
        t = reconstruction.lagrange_step(t.withColumns({"label_k": label("tile_k"), "label_l": label("tile_l")}))
    return t.select("cell_id", "tile_k", "tile_l", (F.round("lagrange", 6) + 0.0).alias("lagrange"), F.round("tau", 6).alias("tau"), "diff")


def shared_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = reconstruction.unary_costs(massed_cells(spark, sf_dir).withColumn("holders", F.size(F.array_distinct("owners"))))
    own = ownership.held(m.select("cell_id", "owners", "holders", "cost0", "cost1")).withColumnRenamed("owner", "tile_id")
    multipliers = ownership.shared(cells(spark, sf_dir)).withColumn("lagrange", (F.col("cell_id") % 7 - 3).cast("double"))
    return reconstruction.shared_costs(own, multipliers).select("tile_id", "cell_id", F.round("cost0", 7).alias("cost0"), F.round("cost1", 7).alias("cost1"))


# evidence


def _mass(*more) -> list:
    return [F.round(F.col(f"mass.{c}"), 8).alias(c) for c in "eou"]


def cell_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return massed_cells(spark, sf_dir).select("cell_id", *_mass())


def evidence_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masses that each tile holds after the main tiles have sent theirs; tiles start with nothing known of cells they aren't the main tile of."""
    c = massed_cells(spark, sf_dir)
    own = ownership.held(c).select(F.col("owner").alias("tile_id"), "cell_id", F.when(F.col("owner") == F.col("main_id"), F.col("mass")).otherwise(ev.unknown()).alias("mass"))
    return ownership.received_masses(own, ownership.sent_masses(c)).select("tile_id", "cell_id", *_mass())


def mass_regularize(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("mass")
    return massed_cells(spark, sf_dir).select("cell_id", ev.regularised(ev.mass(m["e"] * 3, m["o"] * 3 - 0.1, F.lit(0.0))).alias("mass")).select("cell_id", *_mass())


def mass_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each point, as a point of a surface, says of the place (25, 300, 40)."""
    p = sx.columns()
    place = tuple(map(F.lit, (25.0, 300.0, 40.0)))
    m = ev.surface_mass(sx.minus(place, p), corner_scales(p), ev.smoothing(corner_scales(p)), ev.confidence(corner_scales(p), 205.0))
    return points(spark, sf_dir).select(*KEYS, m.alias("mass")).select(*KEYS, *_mass())


def mass_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select(*KEYS, ev.beam_mass(F.col("x") - 10, 1 + F.col("z") / 10).alias("mass")).select(*KEYS, *_mass())


def ds_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masses of the cells of a main tile's hundred fused in the order of their ids."""
    m = ownership.owned(massed_cells(spark, sf_dir)).groupBy((F.col("cell_id") % 500).alias("grp")).agg(F.sort_array(F.collect_list(F.struct("cell_id", "mass"))).alias("x"))
    return m.select("grp", ev.fused(F.transform(F.slice("x", 1, 5), lambda v: v["mass"])).alias("mass")).select("grp", *_mass())


def robust_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    t = points(spark, sf_dir).select("x").distinct()
    return t.select("x", F.round(ev.score_pdf(x, F.lit(20.0)), 9).alias("score_pdf"), F.round(ev.m_estimator(0.5, x), 9).alias("m_estimator"), F.round(ev.dm_estimator(0.5, x), 9).alias("dm_estimator"), F.round(ev.m_pdf(0.5, x), 9).alias("m_pdf"))


def dimensionality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.reverse(F.array_sort(F.array("x", "y", "z")))
    t = points(spark, sf_dir).select((s[0] + 3).alias("s1"), (s[1] + 2).alias("s2"), (s[2] + 1).alias("s3")).distinct()
    d = neighbours.dimensions("s1", "s2", "s3")
    return t.select("s1", "s2", "s3", *[F.round(v, 9).alias(f"d{i}") for i, v in enumerate(d, 1)], F.round(neighbours.entropy(d), 8).alias("entropy"))


def unary_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconstruction.unary_costs(massed_cells(spark, sf_dir)).select("cell_id", F.round("cost1", 7).alias("cost_empty"), F.round("cost0", 7).alias("cost_full"))


# a grid of voxels, six cells each


def _voxel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, n, label): the cloud's 512 grid cells; empty (1) unless they have more points than the mean."""
    counts = tiling.grid_cells(points(spark, sf_dir), 3).groupBy("cell").agg(F.count("*").alias("n"))
    every = spark.range(512).select(F.col("id").alias("cell")).join(counts, "cell", "left").fillna(0, ["n"])
    mean = every.agg(F.avg("n").alias("mean"))
    # one row
    return every.crossJoin(F.broadcast(mean)).select("cell", "n", "mean", F.when(F.col("n") > F.col("mean"), 0).otherwise(1).alias("label"))


def voxel_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, a, b, c, d, p, q, r, s, o_a .. o_d, label): every voxel as six cells around its main diagonal, corners by rising id (i * 81 + j * 9 + k); a corner's tile is its octant."""
    turns = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
    v = _voxel_labels(spark, sf_dir).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(5))))
    at = ndtree.cell_bins(F.col("cell"), 8, 3)
    corner = [list(at)]
    for k in range(3):
        axis = F.element_at(F.array(*[F.lit(t[k]) for t in turns]), F.col("turn") + 1)
        corner.append([c + F.when(axis == i, 1).otherwise(0) for i, c in enumerate(corner[-1])])
    ids = [(c[0] * 81 + c[1] * 9 + c[2]).cast("bigint") for c in corner]
    octant = lambda c: ((c[0] >= 4).cast("bigint") * 4 + (c[1] >= 4).cast("bigint") * 2 + (c[2] >= 4).cast("bigint"))
    return v.select(
        (F.col("cell") * 6 + F.col("turn")).alias("cell_id"), *[i.alias(n) for i, n in zip(ids, "abcd", strict=True)], *[sx.struct(tuple(x.cast("double") for x in c)).alias(n) for c, n in zip(corner, "pqrs", strict=True)],
        *[octant(c).alias(f"o_{n}") for c, n in zip(corner, "abcd", strict=True)], "label",
    )


def _grid_points(spark: SparkSession) -> DataFrame:
    return spark.range(729).select("id", *[v.cast("double").alias(a) for v, a in zip(ndtree.cell_bins(F.col("id"), 9, 3), "xyz", strict=True)])


def surface_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed surface of the full voxels, each triangle's corners by rising id and the side its normal points to."""
    t = surface.surface(voxel_cells(spark, sf_dir), _grid_points(spark))
    ids = F.sort_array(F.array("u", "v", "w"))
    even = ((F.col("u") == ids[0]) & (F.col("v") == ids[1])) | ((F.col("u") == ids[1]) & (F.col("v") == ids[2])) | ((F.col("u") == ids[2]) & (F.col("v") == ids[0]))
    return t.select(*[ids[i].alias(f"v{i}") for i in range(3)], F.when(even, 1).otherwise(-1).alias("turn"))


def open_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of the surface without those on the hull, counted by tile of the least corner."""
    t = surface.surface(voxel_cells(spark, sf_dir), _grid_points(spark), closed=False)
    first = ndtree.cell_bins(F.least("u", "v", "w"), 9, 3)
    return t.select(sum((F.when(c >= 4, 1 << (2 - k)).otherwise(0) for k, c in enumerate(first)), F.lit(0)).cast("bigint").alias("tile_id")).groupBy("tile_id").agg(F.count("*").alias("n"))


def dual_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.operators import delaunay

    return delaunay.dual_edges(voxel_cells(spark, sf_dir))


def facet_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = reconstruction.facet_weights(reconstruction.facets(voxel_cells(spark, sf_dir)), 2.0)
    return t.select("u", "v", "w", "a", "b", F.size("owners").alias("holders"), F.round("weight", 8).alias("weight"))


def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The energy of the voxels' labels: a cell's cost is its count over the mean for empty and 1 for full, walls cost their weight."""
    v = _voxel_labels(spark, sf_dir).select("cell", "label", (F.col("n") / F.greatest("mean", F.lit(1.0))).alias("cost1"), F.lit(1.0).alias("cost0"))
    six = v.select((F.col("cell") * 6).alias("cell_id"), "label", "cost0", "cost1", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("t")).select((F.col("cell_id") + F.col("t")).alias("cell_id"), "label", "cost0", "cost1")
    walls = reconstruction.facet_weights(reconstruction.facets(voxel_cells(spark, sf_dir)), 2.0)
    e = reconstruction.energy(six.select("cell_id", "cost0", "cost1"), walls, six.select("cell_id", "label"))
    return e.select(*[F.round(c, 6).alias(c) for c in ("unary", "pairwise", "total")])


def flooded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The empty voxels' cells that are reached from the first empty voxel."""
    c = voxel_cells(spark, sf_dir)
    first = c.where("label = 1").agg(F.min("cell_id").alias("cell_id"))
    return reconstruction.flooded(c.select("cell_id", "label"), reconstruction.facets(c).select("a", "b"), first)


def located_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least voxel cell that each point lies in, points moved into the grid. Points at one place are located once and counted each."""
    p = points(spark, sf_dir).select((F.col("x") / 8).alias("x"), (F.col("y") % 64 / 8).alias("y"), (F.col("z") % 64 / 8).alias("z"))
    places = p.groupBy("x", "y", "z").agg(F.count("*").alias("n"))
    places = places.select(F.struct("x", "y", "z", "n").alias("place_id"), "x", "y", "z")
    return reconstruction.located(voxel_cells(spark, sf_dir), places, 1.0).groupBy("cell_id").agg(F.sum("place_id.n").alias("n"))


def neighbour_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triangulation.neighbour_mail(voxel_cells(spark, sf_dir)).groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def tile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triangulation.tile_edges(voxel_cells(spark, sf_dir))


def cell_tile_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triangulation.tile_boxes(voxel_cells(spark, sf_dir))


def cell_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triangulation.ring(voxel_cells(spark, sf_dir), spark.range(729)).groupBy("id").agg(F.count("*").alias("n"), F.sum("other").alias("others"))


def merge_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triangulation.merge_graph(voxel_cells(spark, sf_dir)).groupBy("tiles").agg(F.count("*").alias("n"))


def cell_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triangulation.faults(voxel_cells(spark, sf_dir))


def voronoi_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triangulation.voronoi_lines(voxel_cells(spark, sf_dir))
    return t.groupBy(F.round(F.sqrt(sx.squared_distance(sx.vec("p"), sx.vec("q"))), 6).alias("length")).agg(F.count("*").alias("n"), F.sum("a").alias("firsts"))


def cell_soup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = voxel_cells(spark, sf_dir)
    count = lambda main: triangulation.soup(c, main).groupBy("tile_id").agg(F.count("*").alias("n")).select(F.lit(main).alias("main_only"), "tile_id", "n")
    return count(False).unionByName(count(True))


def mesh_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.numbered(points(spark, sf_dir).select("x", "y").distinct(), [F.col("x"), F.col("y")], "vertex_id")


def cell_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.cell_faces(voxel_cells(spark, sf_dir)).groupBy("cell_id").agg(F.count("*").alias("n"))


# scanlines


def scanline_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points of scanlines: cut by user, by a squared gap (value and hours apart), and where the value swings back by more than 300."""
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9
    e = table(spark, sf_dir, "events").select(F.lit(0).alias("strip"), _big("user_id").alias("line"), "event_id", F.col("ts"), F.floor("value").cast("double").alias("x"), F.floor(hours).cast("double").alias("y"), F.lit(0.0).alias("z"), F.floor("value").cast("double").alias("angle"))
    t = scanlines.segments(e.withColumn("strip", F.col("line") % 16), [F.col("line"), F.col("ts"), F.col("event_id")], 90_000.0, 300.0, "strip")
    return t.groupBy("strip", "segment").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")).select(_big("strip").alias("strip"), _big("segment").alias("segment"), "n", "first_id", "last_id")


def line_of_sight_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scanlines.fallback_sights(points(spark, sf_dir), ["k1"])
    return t.select(*KEYS, *[(F.round(f"l{a}", 6) + 0.0).alias(f"l{a}") for a in "xyz"])


def sensor_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("z_origin", F.when(F.col("k2") == 1, F.col("z") * 2))
    return scanlines.default_sensor(p).select(*KEYS, "x_origin", "y_origin", "z_origin")


def local_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points moved to the corner (1, 2, 3), with sensors 200 m along a line of sight."""
    p = points(spark, sf_dir).withColumns({"lx": F.col("k2") / 8, "ly": F.lit(0.25), "lz": F.lit(0.5)})
    return scanlines.with_sensor(p, {"x": 1.0, "y": 2.0, "z": 3.0}).select(*KEYS, "x", "y", "z", "x_origin", "y_origin", "z_origin")


def flipped_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumns({"nx": F.col("k2") - 3.0, "ny": F.lit(1.0), "nz": F.col("k3") % 5 - 2.0})
    return neighbours.flipped(p, (25.0, 300.0, 1000.0)).select(*KEYS, *[(F.col(f"n{a}") + 0.0).alias(f"n{a}") for a in "xyz"])


# thinning


CENTRES = [(10.0 * i + 5, 190.0 * i + 95) for i in range(5)]


def nearest_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thinning.assigned_to_few(points(spark, sf_dir), CENTRES, "xy").groupBy("centre").agg(F.count("*").alias("n"))


def lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = thinning.centroids(thinning.assigned_to_few(points(spark, sf_dir), CENTRES, "xy"), "x", "y", "z")
    return t.select(F.col("centre").alias("vertex"), "n", *[F.round(a, 8).alias(a) for a in "xyz"])


def pca_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = neighbours.covariance(points(spark, sf_dir), "src")
    return t.select("src", "n", *[F.round(f"c{p}", 4).alias(f"c{p}") for p in ("xx", "xy", "yy", "xz", "yz", "zz")])


def bit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k3")
    t = points(spark, sf_dir).select(thinning.flag(k, 2).alias("two"), thinning.all_flags(k, 5).alias("both"), thinning.any_flag(k, 5).alias("any_of"), thinning.with_flag(k, 2, True).alias("with"), thinning.with_flag(k, 2, False).alias("without"))
    return t.groupBy("two", "both", "any_of").agg(F.count("*").alias("n"), F.sum("with").alias("sum_with"), F.sum("without").alias("sum_without"))


def random_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points each of 64 grid cells of a uniform cloud of 100,000 has; floor(100,000 / 64) each."""
    box = (0.0, 4.0, 0.0, 4.0, 0.0, 4.0)
    c = generate.uniform_cloud(spark, 100_000, box, 4, 7)
    return c.groupBy("tile_id", *[F.floor(a).cast("bigint").alias(f"c{a}") for a in "xyz"]).agg(F.count("*").alias("n"))


# attributes and files


def attr_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two parts of the cloud, merged."""
    p = points(spark, sf_dir)
    return attributes.merged_counts(attributes.value_counts(p.where("src < 8"), "k2"), attributes.value_counts(p.where("src >= 8"), "k2"))


def attr_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = attributes.copied(points(spark, sf_dir), "k2", "old_value")
    return attributes.replaced(p, "k2", [(1, 11), (2, 12)]).groupBy("old_value", F.col("k2").alias("new_value")).agg(F.count("*").alias("n"))


def buffer_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = attributes.cropped(points(spark, sf_dir), x=(5, 45), y=(50, 650))
    return attributes.tagged(p, x=(10, 40), y=(100, 600)).groupBy("in_original").agg(F.count("*").alias("n"), F.sum("k2").alias("lines"))


def buffered_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = attributes.with_buffer(points(spark, sf_dir), 100.0, 20.0)
    return t.groupBy("tile_i", "tile_j").agg(F.count("*").alias("n"), F.count_if("in_original").alias("own"))


def crop_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.cropped(points(spark, sf_dir), x=(10, 20), y=(100, 200), z=(0, 50)).select(*KEYS, "x", "y", "z")


def cloud_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.info(points(spark, sf_dir).withColumnRenamed("k4", "point_source_id"), "src")


def colour_to_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.floor("l_extendedprice").cast("bigint") % 65536).alias("v16")
    return table(spark, sf_dir, "lineitem").select(v).distinct().select("v16", attributes.bytes_of_colour(F.col("v16")).alias("v8"))


def raster_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colours of a made-up raster of 40 x 5 pixels under the points."""
    raster = spark.range(200).select(_div(F.col("id"), 5).alias("row"), (F.col("id") % 5).alias("col"), (F.col("id") * 7 % 256).alias("red"))
    t = attributes.sampled_raster(points(spark, sf_dir), raster, 0.0, 1000.0, 10.0, "red")
    return t.groupBy("red").agg(F.count("*").alias("n"))


def color_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of the cloud as vertices, coloured from all its points."""
    pts = points(spark, sf_dir)
    return transfer.nearest_colour(pts, pts)


def iter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("k2", (F.col("x") > 25).cast("int").alias("above"), F.lit(1).alias("one"))
    return sinks.iteration_stats(p, "k2", "above", "one").select("it", "a", "b", F.round("rate", 9).alias("rate"))


def timing_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat("event_type", (F.col("event_id") % 7).cast("string")).alias("label"), F.floor(F.col("value") * 100).cast("bigint").alias("v"))
    return sinks.timing_sums(e, "label", "v")


def path_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", strings.without_scheme(u).alias("cleaned"), F.length(u).alias("n"), strings.has_digit(u).cast("int").alias("has_digit"), strings.basename(strings.clean_path(u)).alias("base"))


def last_int_in_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", streams.last_number(F.col("url")).alias("number"))


def bbox_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(_big("p_partkey").alias("id"), (F.col("p_partkey") % 90).cast("string").alias("a"), (F.col("p_size") + 100).cast("string").alias("b"))
    text = F.concat("a", F.lit("x"), "b", F.lit(":0x"), "b", F.lit(":"), "a", F.lit("x999.5"))
    return p.select("id", *streams.box_of_text(text))


def param_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = texts.parameters_xml("one", {"lam": ["1", "10"], "mode": ["a", "b", "c"], "depth": ["3"]})
    runs = texts.expanded(texts.parameters(xml)["one"], "lam:gt")
    return spark.createDataFrame([(int(r["lam"]), r["mode"], int(r["depth"]), k) for k, r in enumerate(runs, 1)], "lam long, mode string, depth long, run long")


def tile_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's box as twelve numbers, and whether any, or every, of its corners lies in a box."""
    b = tiling.bbox(points(spark, sf_dir), "src")
    low, high = sx.columns(suffix="min"), sx.columns(suffix="max")
    to = tuple(map(F.lit, (0.0, 0.0, -1.0))), tuple(map(F.lit, (50.5, 900.0, 200.0)))
    numbers = F.array_join(F.transform(sx.tile_box(low, high), lambda v: F.round(v * 2).cast("bigint").cast("string")), " ")
    return b.select("src", numbers.alias("box"), *[sx.keep(sx.corners(low, high), *to, strict).alias(n) for strict, n in ((False, "touches"), (True, "inside"))])


# belief propagation on two states


def _two_state(spark: SparkSession, sf_dir: str, rounds: int) -> DataFrame:
    n, edges = nation_graph(spark, sf_dir)
    p = (1 + F.col("id") % 7) * F.lit(0.1)
    t = belief.two_state(n.select("id", F.array(p, 1 - p).alias("prior")), edges.withColumn("factor", F.array(*map(F.lit, (0.7, 0.3, 0.3, 0.7)))), rounds, 0.0)
    return t.select("id", F.round("p0", 8).alias("p0"), F.round("p1", 8).alias("p1"))


def bp_two_state_iter1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_state(spark, sf_dir, 1)


def bp_two_state_iter3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_state(spark, sf_dir, 3)


QUERIES = {
    f.__name__: f
    for f in (
        tile_overflow, tile_totals, ndtree_ids, id_prefix_sum, auto_depth, percentile_scale, extreme_points, octree_lod_levels, mail_delivery, mail_split_semi, mail_split_anti, deliver_or_retain, triplets,
        canonical_edges, collect_neighbors, grouped_values, clique_two_hop, update_vertices, bbox_intersections, sent_once, union_bag, distinct_leaves, simplex_metrics, squared_distances, axis_projection,
        circumsphere_filter, angles, ownership_main, simplex_counts, shared_cell_owners, main_first_numbers, global_cell_ids, local_id_map, filled_labels, label_disagreement, weighted_disagreement, lagrange_update, shared_costs,
        cell_evidence, evidence_exchange, mass_regularize, mass_surface, mass_beam, ds_fusion, robust_kernels, dimensionality, unary_cost, surface_facets, open_surface, dual_facets, facet_weights, energy,
        flooded_cells, located_points, neighbour_mail, tile_edges, cell_tile_boxes, cell_rings, merge_graph, cell_faults, voronoi_lines, cell_soup, mesh_reindex, cell_triangles, scanline_segments, line_of_sight_fallback, sensor_default, local_origin, flipped_normals, nearest_center, lloyd_step, pca_covariance, bit_flags,
        random_cloud, attr_count, attr_replace, buffer_tag, buffered_tiles, crop_bounds, cloud_info, colour_to_bytes, raster_colours, color_transfer, iter_stats, timing_sums, path_clean, last_int_in_name, bbox_parse,
        param_expand, tile_boxes, bp_two_state_iter1, bp_two_state_iter3,
    )
}
