"""Evidence, labels and surfaces against plain versions and known shapes."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from pointloom.functions import evidence as ev
from pointloom.functions import predicates
from pointloom.functions import simplex as sx
from pointloom.operators import delaunay, mail, neighbours, reconstruction, thinning
from pointloom.plans import workflow


def cloud(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id bigint, x double, y double, z double")


def plain_fold(masses):
    e, o, u = 0.0, 0.0, 1.0
    for b, d, w in masses:
        k = o * b + e * d
        e, o, u = ((e * b + e * w + u * b) / (1 - k), (o * d + o * w + u * d) / (1 - k), u * w / (1 - k))
        e, o = min(max(e, 0), 1), min(max(o, 0), 1)
        u = max(1 - e - o, 0)
        e, o, u = (v / (e + o + u) for v in (e, o, u))
    return e, o, u


def test_fusion_in_order_and_of_contradictions(spark):
    rng = random.Random(1)
    rows = []
    for i in range(40):
        ms = []
        for _ in range(i % 6):
            e, o = rng.random() * 0.5, rng.random() * 0.5
            ms.append((e, o, 1 - e - o))
        rows.append((i, ms))
    df = spark.createDataFrame(rows, "id bigint, m array<struct<e:double,o:double,u:double>>")
    for r in df.select("id", ev.fused(F.col("m")).alias("f")).collect():
        assert np.allclose(tuple(r.f), plain_fold(rows[r.id][1]), atol=1e-12)
    sure = spark.range(1).select(ev.fused(F.array(ev.mass(F.lit(1.0), F.lit(0.0), F.lit(0.0)), ev.mass(F.lit(0.0), F.lit(1.0), F.lit(0.0)))).alias("f")).first().f
    assert tuple(sure) == (0.0, 0.0, 1.0)


def test_samples_lie_in_their_cells_and_are_spread(spark):
    cells = spark.range(3).selectExpr("id cell_id", *[f"named_struct('x', {a}D, 'y', {b}D, 'z', {c}D) {n}" for n, (a, b, c) in zip("pqrs", ((0, 0, 0), (4, 0, 0), (0, 2, 0), (0, 0, 8)))])
    got = reconstruction.samples(cells, 400).collect()
    assert len(got) == 1200 and all(r.x >= -1e-12 and r.y >= -1e-12 and r.z >= -1e-12 and r.x / 4 + r.y / 2 + r.z / 8 <= 1 + 1e-12 for r in got)
    assert all((r.x, r.y, r.z) == (1, 0.5, 2) for r in got if r["sample"] == 0)
    assert abs(np.mean([r.x for r in got]) - 1) < 0.1 and abs(np.mean([r.z for r in got]) - 2) < 0.2


def test_cell_masses_are_the_fold_over_the_nearest_points(spark):
    rng = np.random.default_rng(2)
    xyz, k = rng.random((25, 3)) * 4, 6
    scale = rng.random((25, 3)) + 0.5
    rows = [(i, *map(float, p), 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0 if i % 2 else -1.0, *map(float, s), 0.0, 0.0, 50.0, -1 if i == 3 else 0) for i, (p, s) in enumerate(zip(xyz, scale))]
    cols = "id bigint, x double, y double, z double, " + ", ".join(f"{a}{c} double" for a in ("a1", "a2", "a3") for c in "xyz") + ", s1 double, s2 double, s3 double, x_origin double, y_origin double, z_origin double, flag int"
    points = spark.createDataFrame(rows, cols)
    for a in ("a1", "a2", "a3"):
        points = points.withColumn(a, F.struct(*[F.col(f"{a}{c}").alias(c) for c in "xyz"])).drop(*[f"{a}{c}" for c in "xyz"])
    corners = rng.random((4, 4, 3)) * 4
    cells = spark.createDataFrame([(c, *[tuple(map(float, v)) for v in corners[c]]) for c in range(4)], "cell_id bigint, " + ", ".join(f"{n} struct<x:double,y:double,z:double>" for n in "pqrs"))
    got = {r.cell_id: tuple(r.mass) for r in reconstruction.cell_masses(cells, points, 1.0, 1, k).collect()}
    for c in range(4):
        s = corners[c].mean(0)
        ms = []
        for i in np.argsort(((xyz - s) ** 2).sum(1))[:k]:
            if i == 3:
                continue
            d = s - xyz[i]  # the last axis points up, to the sensor
            half, g = math.exp(-abs(d[2]) / scale[i][2]) / 2, max(scale[i])
            e, o = (1 - half, half) if d[2] > 0 else (half, 1 - half)
            fade = math.exp(-(d[0] / scale[i][0]) ** 2) * math.exp(-(d[1] / scale[i][1]) ** 2) * math.exp(-(d[2] / g) ** 2)
            ms.append((e * fade, o * fade, 1 - fade * (e + o)))
        assert np.allclose(got[c], plain_fold(ms), atol=1e-9)
    assert {tuple(r.mass) for r in reconstruction.cell_masses(cells, points.limit(0), 1.0, 1, k).collect()} == {(0.0, 0.0, 1.0)}


def test_sensors_make_their_cells_emptier(spark):
    cells = spark.range(2).selectExpr("id cell_id", *[f"named_struct('x', {a}D + 10 * id, 'y', {b}D, 'z', {c}D) {n}" for n, (a, b, c) in zip("pqrs", ((0, 0, 0), (4, 0, 0), (0, 4, 0), (0, 0, 4)))])
    masses = cells.select("cell_id", ev.unknown().alias("mass"))
    sensors = spark.createDataFrame([(1, 0.5, 0.5, 0.5), (2, 1.0, 1.0, 1.0), (3, 30.0, 0.0, 0.0)], "place_id bigint, x double, y double, z double")
    got = {r.cell_id: tuple(r.mass) for r in reconstruction.with_sensors(masses, cells, sensors, 3.0).collect()}
    assert got[1] == (0.0, 0.0, 1.0) and np.allclose(got[0], plain_fold([ev.SENSOR] * 2))


def test_one_step_of_multipliers_and_shared_costs(spark):
    s = spark.createDataFrame([(1, 0, 1, 1, 0, 0.0, 2.0, 0), (1, 1, 0, 0, 1, 0.0, 2.0, 0)], "cell_id bigint, tile_k bigint, tile_l bigint, label_k int, label_l int, lagrange double, tau double, diff int")
    got = reconstruction.lagrange_step(s).collect()
    assert all((r.lagrange, r.tau, r["diff"]) == (2.0, 1.0, 1) for r in got)
    costs = spark.createDataFrame([(0, 1, 2, 1.0, 3.0), (1, 1, 2, 1.0, 3.0), (0, 2, 1, 1.0, 3.0)], "tile_id bigint, cell_id bigint, holders int, cost0 double, cost1 double")
    out = {(r.tile_id, r.cell_id): (r.cost0, r.cost1) for r in reconstruction.shared_costs(costs, reconstruction.lagrange_step(s)).collect()}
    # the lesser tile said 1 where the other said 0: 1 becomes dearer to it and 0 to the other
    assert out == {(0, 1): (0.5, 3.5), (1, 1): (2.5, 1.5), (0, 2): (1.0, 3.0)}


def test_hull_costs_rule_out_one_side(spark):
    at = lambda z: [f"named_struct('x', {x}D, 'y', {y}D, 'z', {w}D) {n}" for n, (x, y, w) in zip("pqrs", ((0, 0, z), (1, 0, z), (0, 1, z), (0, 0, 5)))]
    cells = spark.range(1).selectExpr("1L cell_id", *at(9)).unionByName(spark.range(1).selectExpr("2L cell_id", *at(1)))
    assert {r.cell_id: (r.cost0, r.cost1) for r in reconstruction.hull_costs(cells).collect()} == {1: (1e8, 0.0), 2: (0.0, 1e8)}


def test_cosine_of_a_facet(spark):
    rng = np.random.default_rng(3)
    for _ in range(3):
        p, q, r, s = rng.random((4, 3))
        u = np.array([q - p, r - p, s - p])
        centre = p + np.linalg.solve(u, (u**2).sum(1) / 2)
        n = np.cross(q - p, r - p)
        proj = centre - n * (np.dot(centre - p, n) / np.dot(n, n))
        want = np.linalg.norm(proj - p) / np.linalg.norm(centre - p)
        v = [tuple(F.lit(float(c)) for c in x) for x in (p, q, r, s)]
        row = spark.range(1).select(sx.plane_cosine(sx.circumcentre(*v), *v[:3]).alias("c"), sx.struct(sx.circumcentre(*v)).alias("m")).first()
        assert abs(row.c - want) < 1e-9 and np.allclose(tuple(row.m), centre)


def test_graph_lines_are_read_back(spark, tmp_path):
    from pointloom.sources import texts

    costs = spark.createDataFrame([(1, 0.5, 0.25), (2, 1.0, 0.0)], "cell_id bigint, cost0 double, cost1 double")
    walls = spark.createDataFrame([(1, 2, 0.75)], "a bigint, b bigint, weight double")
    reconstruction.graph_lines(costs, walls).write.text(f"{tmp_path}/g")
    cells, arcs = texts.flow_records(spark, f"{tmp_path}/g")
    assert sorted(map(tuple, cells.collect())) == [(1, 0.5, 0.25), (2, 1.0, 0.0)] and [tuple(r) for r in arcs.collect()] == [(1, 2, 0.75, 0.75)]


def test_a_scanned_sphere_becomes_a_closed_surface(spark):
    n = 160
    k = np.arange(n) + 0.5
    polar, turn = np.arccos(1 - 2 * k / n), np.pi * (1 + 5**0.5) * k
    xyz = np.column_stack((np.cos(turn) * np.sin(polar), np.sin(turn) * np.sin(polar), np.cos(polar))) * 10
    xyz += np.random.default_rng(4).normal(size=xyz.shape) * 0.01
    rows = [(i, *map(float, p), *map(float, p * 3)) for i, p in enumerate(xyz)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double, z double, x_origin double, y_origin double, z_origin double")
    triangles, _, open_ = workflow.reconstructed(df, 4.0, workflow.Parameters(ndtree_depth=1, max_ppt=1000, lam=0.05))
    t = [(r.u, r.v, r.w) for r in triangles.collect()]
    edges = [e for a, b, c in t for e in ((a, b), (b, c), (c, a))]
    assert open_ == 0 and len(set(edges)) == len(edges) and {(b, a) for a, b in edges} == set(edges)
    vertices = {v for f in t for v in f}
    assert len(vertices) - len(edges) // 2 + len(t) == 2 and len(vertices) > 0.95 * n
    volume = sum(np.dot(xyz[a], np.cross(xyz[b], xyz[c])) for a, b, c in t) / 6
    assert 0.85 < volume / (4 / 3 * math.pi * 1000) < 1.0


def test_nearest_of_other_points_and_within(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 20)
    rng = np.random.default_rng(5)
    q, p = rng.random((40, 3)) * 10, np.concatenate((rng.random((150, 3)) * 10, rng.random((60, 3)) * 0.5))
    got = {}
    for r in neighbours.nearest_of(cloud(spark, q), cloud(spark, p), 3, 0.7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    for i, x in enumerate(q):
        near = sorted((float(((x - y) ** 2).sum()), j) for j, y in enumerate(p))[:3]
        assert [got[i][k] for k in (1, 2, 3)] == [j for _, j in near]
    some = neighbours.nearest_of(cloud(spark, q), cloud(spark, p), 3, 0.7, reach=1.0).collect()
    assert all(r.d2 <= 1.0 for r in some)
    pairs = {(r.query_id, r.id) for r in neighbours.within(cloud(spark, q), cloud(spark, p), 1.5).collect()}
    assert pairs == {(i, j) for i, x in enumerate(q) for j, y in enumerate(p) if ((x - y) ** 2).sum() <= 2.25}


def test_box_pairs_of_all_sizes(spark):
    rng = np.random.default_rng(6)
    low = rng.random((60, 2)) * 100
    high = low + rng.random((60, 2)) * np.where(rng.random((60, 1)) < 0.2, 80, 8)
    df = spark.createDataFrame([(i, *map(float, (a[0], b[0], a[1], b[1]))) for i, (a, b) in enumerate(zip(low, high))], "id bigint, xmin double, xmax double, ymin double, ymax double")
    got = [(r.a, r.b) for r in mail.box_pairs(df, 10.0).collect()]
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if (low[i] <= high[j]).all() and (low[j] <= high[i]).all()}
    assert len(got) == len(set(got)) and set(got) == want


def test_thinned_clouds(spark):
    rng = np.random.default_rng(7)
    xyz = np.column_stack((rng.random((300, 2)) * 10, np.zeros(300)))
    df = cloud(spark, xyz)
    kept = {r.id for r in thinning.spaced(df, 1.0).collect()}
    d = lambda i, j: ((xyz[i] - xyz[j]) ** 2).sum()
    assert all(d(i, j) > 1 for i, j in itertools.combinations(kept, 2)) and 5 < len(kept) < 150
    axes = {a: F.struct(*[F.lit(1.0 if c == k else 0.0).alias(c) for c in "xyz"]) for a, k in (("a1", "x"), ("a2", "y"), ("a3", "z"))}
    shaped = df.withColumns(axes | {"s1": F.lit(1.0), "s2": F.lit(1.0), "s3": F.lit(1.0), "tile_id": F.lit(0).cast("bigint")})
    some = thinning.thinned(shaped, 0.5)
    # the cloud is flat: along the normal every near point is close enough, so kept ones are a scale apart
    left = [r.id for r in some.collect()]
    assert some.columns == shaped.columns and all(d(i, j) > 1 for i, j in itertools.combinations(left, 2))
    assert all(any(d(i, j) <= 1 for j in left) for i in range(300))


def test_relaxed_centres_move_to_the_means_of_their_points(spark):
    rng = np.random.default_rng(8)
    xyz, c = rng.random((80, 3)) * 10, np.array([[1.0, 1, 1], [9, 9, 9], [5, 5, 5], [200, 200, 200]])
    points = cloud(spark, xyz).withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0), "lx": F.lit(0.0), "ly": F.lit(0.0), "lz": F.lit(1.0), "scale": F.lit(0.3)})
    got = {r.id: (r.x, r.y, r.z) for r in thinning.relaxed(points, cloud(spark, c), 3.0, 3, extra=False).collect()}
    for _ in range(3):
        own = np.argmin(((xyz[:, None] - c[None]) ** 2).sum(2), 1)
        c = np.array([xyz[own == k].mean(0) if (own == k).any() else c[k] for k in range(4)])
    assert np.allclose([got[k] for k in range(4)], c)
    more = thinning.relaxed(points, cloud(spark, rng.random((30, 3)) * 10), 3.0, 1).collect()
    assert 30 < len(more) < 45 and len({r.id for r in more}) == len(more)


def test_delaunay_walks_over_many_points():
    rng = np.random.default_rng(9)
    xyz = np.concatenate((rng.normal(size=(1500, 3)), rng.integers(0, 4, (60, 3)) / 2))
    xyz = np.unique(xyz, axis=0)
    cells = predicates.delaunay(xyz)
    finite = cells[(cells >= 0).all(1)]
    facets = np.concatenate([np.sort(np.delete(cells, i, 1), 1) for i in range(4)])
    assert (np.unique(facets, axis=0, return_counts=True)[1] == 2).all() and (predicates.orientation(xyz[finite]) > 0).all()
    assert set(finite.ravel().tolist()) == set(range(len(xyz)))
    for p in rng.integers(0, len(xyz), 40):
        rest = finite[~(finite == p).any(1)]
        assert not predicates.in_sphere(xyz[rest], xyz[p]).any()


def test_flooded_cells(spark):
    labels = spark.createDataFrame([(i, int(i in (3, 7))) for i in range(9)], "cell_id bigint, label int")
    walls = spark.createDataFrame([(i, i + 1) for i in range(8)], "a bigint, b bigint")
    assert sorted(r.cell_id for r in reconstruction.flooded(labels, walls, spark.createDataFrame([(5,)], "cell_id bigint")).collect()) == [4, 5, 6]
