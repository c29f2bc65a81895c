"""Tables of cells, rays, formats and placement."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import predicates
from pointloom.operators import rays, triangulation
from pointloom.plans import belief_main, placement
from pointloom.sources import formats


@pytest.fixture(scope="module")
def shape():
    rng = np.random.default_rng(1)
    xyz = rng.random((60, 3)) * 10
    cells = predicates.delaunay(xyz)
    return xyz, np.sort(cells[(cells >= 0).all(1)], 1)


@pytest.fixture(scope="module")
def cells(spark, shape):
    xyz, c = shape
    rows = [(i, *map(int, v), *[tuple(map(float, xyz[k])) for k in v], *[int(xyz[k, 0] // 5) for k in v]) for i, v in enumerate(c)]
    return spark.createDataFrame(rows, "cell_id bigint, a bigint, b bigint, c bigint, d bigint, " + ", ".join(f"{n} struct<x:double,y:double,z:double>" for n in "pqrs") + ", " + ", ".join(f"o_{n} bigint" for n in "abcd")).cache()


def test_cells_have_no_faults_and_are_exported_and_imported(cells):
    assert {r.kind: r.n for r in triangulation.faults(cells).collect()} == {"facet": 0, "repeated": 0, "corners": 0, "flat": 0}
    bad = cells.unionByName(cells.where("cell_id < 2").withColumn("cell_id", F.col("cell_id") + 9000))
    got = {r.kind: r.n for r in triangulation.faults(bad).collect()}
    assert got["repeated"] == 2 and got["facet"] > 0
    back = triangulation.imported(*triangulation.exported(cells)).select(*cells.columns)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, cells.collect()))


def test_tiles_that_made_the_same_cells_agree(cells):
    made = triangulation.soup(cells).join(cells.drop(*"pqrs"), "cell_id")
    assert triangulation.disagreements(made).count() == 0
    mixed = triangulation.shown(cells, "mixed").agg(F.min("cell_id")).first()[0]
    short = made.where(f"not (cell_id = {mixed} and tile_id = 1)")
    assert [tuple(r) for r in triangulation.disagreements(short).collect()] == [(0, 1, 1)]
    assert triangulation.shown(cells, "local").count() + triangulation.shown(cells, "mixed").count() == cells.count() == triangulation.shown(cells, "finite").count()


def test_crown_and_kept_points(cells, shape):
    xyz, c = shape
    own = (xyz[:, 0] // 5).astype(int)
    made = triangulation.soup(cells).select("tile_id", "cell_id").join(cells, "cell_id")
    boxes = triangulation.tile_boxes(cells)
    got = {(r.tile_id, r.id) for r in triangulation.crown(made, boxes).collect()}
    want = set()
    for v in c:
        u = xyz[v]
        centre = u[0] + np.linalg.solve(u[1:] - u[0], ((u[1:] - u[0]) ** 2).sum(1) / 2)
        r = np.linalg.norm(centre - u[0])
        for t in {own[k] for k in v}:
            mine = xyz[own == t]
            if not ((centre - r >= mine.min(0)) & (centre + r <= mine.max(0))).all():
                want |= {(t, k) for k in v if own[k] == t}
    assert got == want
    kept = {(r.tile_id, r.id) for r in triangulation.kept_points(made).collect()}
    assert kept == {(t, k) for v in c for t in {own[j] for j in v} for k in v}


def test_rays_pass_the_cells_that_they_cross(spark, cells, shape):
    xyz, c = shape
    rng = np.random.default_rng(2)
    a, b = rng.random((25, 3)) * 10, rng.random((25, 3)) * 20 - 5
    df = spark.createDataFrame([(i, *map(float, x), *map(float, y), 2.0) for i, (x, y) in enumerate(zip(a, b))], "ray_id bigint, x double, y double, z double, x1 double, y1 double, z1 double, scale double")
    got = {}
    for r in rays.passed_cells(cells, df, 2.0).collect():
        got.setdefault(r.ray_id, {})[r.cell_id] = (r.enter, r.leave)
    at = np.linspace(0, 1, 4001)
    for i in range(25):
        p = a[i] + (b[i] - a[i]) * at[:, None]
        for k, v in enumerate(c):
            u = xyz[v]
            w = np.linalg.solve((u[:3] - u[3]).T, (p - u[3]).T).T
            inside = (w >= 0).all(1) & (w.sum(1) <= 1)
            if inside.any():
                enter, leave = got[i].pop(k)
                assert abs(enter - at[inside][0]) < 5e-4 and abs(leave - at[inside][-1]) < 5e-4
        # what is left is passed too shortly to be sampled
        assert all(y - x < 5e-4 for x, y in got.get(i, {}).values())
    m = rays.beam_masses(cells, df, 2.0).collect()
    assert all(0 <= r.mass.e <= 1 and r.mass.o == 0 and r.n >= 1 for r in m)
    from pointloom.functions import evidence as ev

    none = cells.select("cell_id", ev.unknown().alias("mass"))
    assert {r.cell_id: round(r.mass.e, 9) for r in rays.with_beams(none, rays.beam_masses(cells, df, 2.0)).collect() if r.mass.e > 0} == {r.cell_id: round(r.mass.e, 9) for r in m if r.mass.e > 0}


def test_point_formats(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.random((20, 3))
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "x double, y double, z double")
    formats.write_text(df, str(tmp_path / "t"), "xyz")
    back = formats.read_text(spark, str(tmp_path / "t"), "xyz")
    assert sorted(tuple(r)[:3] for r in back.collect()) == sorted(map(tuple, df.collect())) and back.columns[3:] == ["red", "green", "blue"]
    (tmp_path / "h.a3d").write_text("20\n1 2 3 0.5\n4,5,6,0.25\n")
    assert sorted(map(tuple, formats.read_text(spark, str(tmp_path / "h.a3d"), "a3d").collect())) == [(1, 2, 3, 0.5), (4, 5, 6, 0.25)]
    for k, binary in enumerate((False, True)):
        (tmp_path / f"{k}.pcd").write_bytes(formats.pcd_bytes({"x": x[:, 0], "y": x[:, 1], "z": x[:, 2]}, binary))
    got = formats.read_files(spark, str(tmp_path), "pcd").collect()
    assert len(got) == 40 and all(np.allclose((r.x, r.y, r.z), x[r.row]) for r in got)
    (tmp_path / "s.stl").write_text("solid s\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid s\n")
    assert [(r.row, r.corner, r.x, r.y) for r in formats.read_files(spark, str(tmp_path), "stl").orderBy("corner").collect()] == [(0, 0, 0, 0), (0, 1, 1, 0), (0, 2, 0, 1)]


def test_placement(spark):
    df = spark.range(100).withColumn("src", F.col("id") % 7)
    one = placement.edges_by_source(df, 4)
    assert one.rdd.getNumPartitions() == 4 and one.withColumn("part", F.spark_partition_id()).groupBy("src").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0
    kept = placement.kept(df, "MEMORY_AND_DISK")
    assert kept.is_cached and not placement.kept(spark.range(3), "NONE").is_cached
    kept.unpersist()
    with pytest.raises(ValueError):
        placement.kept(df, "SOMEWHERE")
    t = placement.random_tiles(df, 5)
    assert t.select("tile_id").distinct().count() == 5 and sorted(t.collect()) == sorted(placement.random_tiles(df, 5).collect())
    s = placement.Sections()
    for _ in range(2):
        with s.section("a"):
            pass
    assert s.lines()[0] == "label,seconds" and len(s.lines()) == 2


def test_belief_propagation_from_files(spark, tmp_path):
    (tmp_path / "v").write_text("1 0.2 0.8\n2 0.5 0.5\n3 0.5 0.5\n")
    (tmp_path / "e").write_text("1 2 0.9 0.1 0.1 0.9\n2 3 0.9 0.1 0.1 0.9\n")
    got = {r.id: r.belief for r in belief_main.beliefs(spark, "pairwise", str(tmp_path / "v"), str(tmp_path / "e"), 20, 1e-9).collect()}
    # a chain: exact marginals
    assert np.allclose([got[1][0], got[2][0], got[3][0]], [0.2, 0.26, 0.308])
    two = {r.id: r.belief for r in belief_main.beliefs(spark, "two_state", str(tmp_path / "v"), str(tmp_path / "e"), 20, 1e-9).collect()}
    assert np.allclose(two[3], [0.308 / 0.692, 1.0])
    (tmp_path / "f").write_text("###1\n1\n1\n2\n2\n0 0.2\n1 0.8\n###2\n2\n1 2\n2 2\n4\n0 0.9\n1 0.1\n2 0.1\n3 0.9\n")
    got = {r.id: r.belief for r in belief_main.beliefs(spark, "factors", "", str(tmp_path / "f"), 20, 1e-9).collect()}
    assert np.allclose([got[1][0], got[2][0]], [0.2, 0.26])
