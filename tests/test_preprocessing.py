"""Scanlines, lines of sight, sources and sinks."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import projection, strings
from pointloom.operators import attributes, scanlines, surface
from pointloom.plans import workflow
from pointloom.sources import generate, las, ply, sinks, streams


def test_segments_by_line_gap_and_turn(spark):
    x = [float(v) for v in (0, 1, 2, 9, 10, 11, 10, 9, 10)]
    line = [1, 1, 1, 1, 1, 1, 1, 1, 2]
    rows = [(i, l, v, 0.0, 0.0, v) for i, (l, v) in enumerate(zip(line, x))]
    df = spark.createDataFrame(rows, "row bigint, line int, x double, y double, z double, angle double")
    got = lambda **k: [r.segment for r in scanlines.segments(df, [F.col("row")], 25.0, **k).orderBy("row").collect()]
    assert got() == [1, 1, 1, 2, 2, 2, 2, 2, 3]
    assert got(turn=0.5) == [1, 1, 1, 2, 2, 2, 3, 3, 4]
    assert scanlines.gap_limit({"xmin": 0, "xmax": 3, "ymin": 0, "ymax": 4, "zmin": 0, "zmax": 12}) == pytest.approx((0.05 * 13) ** 2)


def test_lines_of_sight_meet_in_the_scanner(spark):
    scanner = np.array([100.0, 200.0, 600.0])
    across = np.array([0.6, 0.8, 0.0])
    angle = np.linspace(-20, 20, 41)
    xyz = scanner + across * (np.tan(np.radians(angle)) * 500)[:, None] - [0, 0, 500]
    # a positive angle looks from the point back towards the scanner against the way it was swung
    rows = [(0, i, *map(float, p), float(-a)) for i, (p, a) in enumerate(zip(xyz, angle))]
    df = spark.createDataFrame(rows, "segment int, row bigint, x double, y double, z double, angle double")
    for r in scanlines.lines_of_sight(df, ["segment"], "row").collect():
        los, p = np.array([r.lx, r.ly, r.lz]), np.array([r.x, r.y, r.z])
        assert np.linalg.norm(los) == pytest.approx(1 / 3) and np.allclose(los * 3, (scanner - p) / np.linalg.norm(scanner - p), atol=1e-6)
    high = scanlines.lines_of_sight(df, ["segment"], "row", with_angle=False).first()
    top = np.array([xyz[:, 0].mean(), xyz[:, 1].mean(), xyz[:, 2].max() + 2 * np.linalg.norm(xyz[-1] - xyz[0])])
    assert np.allclose([high.lx, high.ly, high.lz], top - [high.x, high.y, high.z])
    assert np.allclose(scanlines.scanner_position(xyz, (scanner - xyz) / np.linalg.norm(scanner - xyz, axis=1)[:, None]), scanner)
    assert scanlines.scanner_position(xyz, np.tile([0.0, 0, 1], (41, 1))) is None


def test_preprocessed_points_keep_their_sensors(spark):
    rows = [("f", i, 1 + i // 10, 10.0 + i % 10, 20.0 + i // 10, 5.0, float(i % 10 - 5)) for i in range(30)]
    df = spark.createDataFrame(rows, "path string, row bigint, line int, x double, y double, z double, angle double")
    box = {"xmin": 10.0, "xmax": 19.0, "ymin": 20.0, "ymax": 22.0, "zmin": 5.0, "zmax": 5.0}
    got = scanlines.preprocessed(df, box, ["row"], "path").collect()
    assert len(got) == 30 and min(r.x for r in got) == 0 and all(abs(r.x_origin - r.x - 200 * r.nx) < 1e-9 for r in got)


def test_las_columns_and_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    xyz = rng.integers(0, 100_000, (1000, 3)) / 1000
    for k in range(2):
        (tmp_path / f"a_{k}.las").write_bytes(las.encode(xyz + k, rng.integers(-3000, 3000, 1000) * 0.006, np.arange(1000) % 7, np.zeros((1000, 3))))
    got = las.read_las(spark, str(tmp_path), columns=("x", "point_source_id"), piece=300)
    assert got.columns == ["path", "row", "x", "point_source_id"]
    rows = got.collect()
    assert len(rows) == 2000 and len({(r.path, r.row) for r in rows}) == 2000
    assert all(abs(r.x - xyz[r.row, 0] - int(r.path[-5])) < 1e-9 and r.point_source_id == r.row % 7 for r in rows)
    files = streams.listing(spark, str(tmp_path), "las", "a_1").collect()
    assert [(f.tile_id, f.length) for f in files] == [(1, (tmp_path / "a_1.las").stat().st_size)]


def test_meshes_are_read_back(spark, tmp_path):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(t, i, *map(float, rng.random(3))) for t in (3, 8) for i in range(5)], "tile_id bigint, row bigint, x double, y double, z double")
    f = spark.createDataFrame([(3, 0, 1, 2, 7), (3, 2, 3, 4, 9)], "tile_id bigint, u bigint, v bigint, w bigint, label int")
    for binary in (False, True):
        path = str(tmp_path / f"m{binary}")
        sinks.write_meshes(v, f, path, ["x", "y", "z"], ["label"], binary)
        names = sinks.named_files(spark, path, "mesh")
        assert [n.rsplit("/", 1)[1] for n in names] == ["3_mesh.ply", "8_mesh.ply"]
        back = ply.read_vertices(spark, path, ["x", "y", "z"])
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, v.collect()))
        assert sorted((r.tile_id, r.corners) for r in ply.read_faces(spark, path).collect()) == [(3, [0, 1, 2]), (3, [2, 3, 4])]
    sinks.write_points(v, str(tmp_path / "p"), ["x", "y", "z"], per_file=2)
    sinks.named_files(spark, str(tmp_path / "p"), "part")
    assert sorted(r.tile_id for r in ply.read_vertices(spark, str(tmp_path / "p"), ["x"]).select("tile_id").distinct().collect()) == [3000, 3001, 3002, 8000, 8001, 8002]


def test_features_layers_and_records(spark, tmp_path):
    t = spark.range(1).selectExpr("named_struct('x', 0D, 'y', 0D, 'z', 1D) p", "named_struct('x', 1D, 'y', 0D, 'z', 1D) q", "named_struct('x', 0D, 'y', 1D, 'z', 1D) r", "7 label")
    got = json.loads(sinks.triangle_features(t, "label").first().feature)
    assert got["geometry"] == {"type": "Polygon", "coordinates": [[[0.0, 0.0, 1.0], [1.0, 0.0, 1.0], [0.0, 1.0, 1.0], [0.0, 0.0, 1.0]]]} and got["properties"] == {"label": 7}
    assert json.loads(sinks.line_features(t).first().feature)["geometry"]["coordinates"] == [[0.0, 0.0, 1.0], [1.0, 0.0, 1.0]]
    n = spark.range(1).selectExpr("1D x", "2D y", "3D z", "0D nx", "0D ny", "1D nz")
    assert json.loads(sinks.normal_features(n, 2.0).first().feature)["geometry"]["coordinates"] == [[1.0, 2.0, 3.0], [1.0, 2.0, 5.0]]
    from pointloom.functions import simplex as sx

    layer = t.select(sinks.wkt("TRIANGLE", *[sx.vec(c) for c in "pqr"]).alias("wkt"), "label")
    sinks.write_layer(layer, str(tmp_path / "l"), "tin")
    assert spark.read.option("header", True).csv(str(tmp_path / "l/tin")).first().wkt.startswith("POLYGON Z ((0.0 0.0 1.0, 1.0")
    assert '<Field name="label" type="Integer64"/>' in spark.read.text(str(tmp_path / "l/tin_vrt")).first().value
    (tmp_path / "r.txt").write_text("z 5 a b c\ne 1 2 rest\n\nzz 6\n")
    lines = streams.records(spark, str(tmp_path / "r.txt"))
    assert sorted(map(tuple, streams.keyed(lines, "z").collect())) == [(5, "a b c"), (6, "")]
    assert [tuple(r) for r in streams.edges(lines, "e").collect()] == [(1, 2, "rest")]
    assert sinks.parameters_json({"b": ["1", "2"], "a": ["x"]}) == '{"a": "x", "b": ["1", "2"]}'
    boxes = spark.createDataFrame([(1, 0.0, 2.0, 0.0, 2.0, 0.0, 2.0), (2, 2.0, 4.0, 0.0, 2.0, 0.0, 2.0)], "id bigint, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double")
    link = sinks.tile_links(boxes, spark.createDataFrame([(1, 2)], "src bigint, dst bigint")).first()
    assert tuple(link.p) == (1, 1, 1) and tuple(link.q) == (3, 1, 1)


def test_streams_and_serialised_tiles(spark, tmp_path):
    import base64

    for k in range(2):
        (tmp_path / f"f{k}.ply").write_text(f"ply\nformat ascii 1.0\nelement vertex 2\nproperty double x\nproperty double y\nproperty double z\nend_header\n{k} 1 2\n3 4 5\n")
    folded = streams.ply_stream(spark, str(tmp_path / "*.ply"))
    assert all("\n" not in r.value for r in folded.collect())
    assert sorted((r.tile_id, r.x) for r in streams.folded_vertices(folded, ["x", "y", "z"]).collect()) == [(0, 0.0), (0, 3.0), (1, 1.0), (1, 3.0)]
    (tmp_path / "b.txt").write_text("\n".join(base64.b64encode(v).decode() for v in (b"one", b"two", b"\xff\x00")) + "\n")
    got = streams.base64_lines(spark, str(tmp_path / "b.txt"), 2)
    assert {r.tile_id: bytes(r.content) for r in got.collect()} == {0: b"one", 1: b"two", 2: b"\xff\x00"} and got.rdd.getNumPartitions() == 2
    rows = spark.createDataFrame([(t, i, i / 3, [i, t], None if i else "a") for t in (1, 2) for i in range(4)], "tile_id bigint, row bigint, x double, nbrs array<bigint>, name string")
    packed = streams.serialised(rows)
    back = streams.deserialised(packed, "row bigint, x double, nbrs array<bigint>, name string")
    assert packed.count() == 2 and sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))
    assert tuple(spark.range(1).select(*streams.box_of_text(F.lit("0x10:-5x5.5:1x2"))).first()) == (0.0, 10.0, -5.0, 5.5, 1.0, 2.0)
    assert streams.setting("NO_SUCH_VARIABLE_HERE", "d") == "d"
    seen = []
    fetch = lambda u, p: (seen.append(u), open(p, "w").close())
    for _ in range(2):
        assert streams.download(["http://x/a.las"], str(tmp_path), fetch) == [str(tmp_path / "a.las")]
    assert seen == ["http://x/a.las"]


def test_random_clouds_are_the_same_in_every_run(spark):
    box = (0.0, 100.0, 0.0, 50.0, 0.0, 10.0)
    a = generate.generated(spark, {"nbp": "2000", "max_ppt": "500"}, box, seed=3)
    assert a.agg(F.countDistinct("kernel")).first()[0] == 12 and a.count() <= 2000
    assert sorted(a.collect()) == sorted(a.repartition(5).collect())
    one = a.groupBy("kernel").agg(F.stddev("x").alias("s")).agg(F.max("s")).first()[0]
    assert one < 100 / 50 + 100 / 10_000 + 1
    b = generate.generated(spark, {"nbp_and_depth": "1000:1"}, box, "random_uniform")
    assert b.count() == 1000 and b.where("tile_id = 7").where("x < 50 or y < 25 or z < 5").count() == 0


def test_projection_and_back(spark):
    # Paris and the origin of the projection, published values to the centimetre
    df = spark.createDataFrame([(700_000.0, 6_600_000.0), (652_381.14, 6_861_802.94), (200_000.0, 6_200_000.0)], "x double, y double")
    lon, lat = projection.geographic(F.col("x"), F.col("y"))
    rows = df.select("x", "y", lon.alias("lon"), lat.alias("lat")).select("*", *[c.alias(n) for n, c in zip("XYZ", projection.geocentric(F.col("lon"), F.col("lat"), F.lit(50.0)))], *[c.alias(n) for n, c in zip("ab", projection.lambert(F.col("lon"), F.col("lat")))]).collect()
    assert abs(rows[0].lon - 3) < 1e-12 and abs(rows[0].lat - 46.5) < 1e-9
    assert abs(rows[1].lon - 2.35) < 2e-3 and abs(rows[1].lat - 48.853) < 2e-3
    for r in rows:
        assert abs(r.a - r.x) < 1e-5 and abs(r.b - r.y) < 1e-5
        p = math.radians(r.lat)
        n = projection.SEMI_MAJOR / math.sqrt(1 - projection._E2 * math.sin(p) ** 2)
        assert abs(math.hypot(r.X, r.Y) - (n + 50) * math.cos(p)) < 1e-6 and abs(r.Z - (n * (1 - projection._E2) + 50) * math.sin(p)) < 1e-6


def test_strings(spark):
    row = spark.range(1).select(strings.clean_path(F.lit(" a//b/ c ")).alias("c"), strings.is_number(F.lit("-1.5e3")).alias("n"), strings.is_number(F.lit("1a")).alias("m"), strings.padded(F.lit(7), 4).alias("p"), strings.digit_count(F.lit(-120)).alias("d"), *strings.grid_corner(F.lit("S_HD_0770_6277_PTS.laz"), 1000.0)).first()
    assert tuple(row) == ("a/b/c", True, False, "0007", 3, 770_000.0, 771_000.0, 6_276_000.0, 6_277_000.0)


def test_attributes(spark):
    rng = np.random.default_rng(3)
    p = spark.createDataFrame([(i, *map(float, rng.random(2) * 300)) for i in range(400)], "id bigint, x double, y double")
    wide = attributes.with_buffer(p, 100.0, 25.0)
    assert sorted(map(tuple, attributes.without_buffer(wide).select("id", "x", "y").collect())) == sorted(map(tuple, p.collect()))
    mid = wide.where("tile_i = 1 and tile_j = 1")
    assert {r.id for r in mid.collect()} == {r.id for r in p.where("x between 75 and 225 and y between 75 and 225").collect()}
    means = attributes.on_buffered(p, 100.0, 25.0, lambda b: b.withColumn("one", F.lit(1)))
    assert means.count() == 400 and "in_original" not in means.columns
    with pytest.raises(ValueError):
        attributes.with_buffer(p, 10.0, 11.0)
    with pytest.raises(ValueError):
        attributes.replaced(p, "id", [(1, 2), (1, 3)])
    files = spark.createDataFrame([("a", 0.0, 1000.0), ("b", 1000.0, 1000.0), ("c", 5000.0, 1000.0)], "path string, xmin double, ymax double")
    assert sorted(map(tuple, attributes.neighbour_files(files, 1000.0).collect())) == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "c")]
    std = attributes.standardised(p, {"x": "float", "gps": "double"})
    assert std.dtypes == [("x", "float"), ("gps", "double")] and std.where("gps is null").count() == 400
    got = attributes.taken_from(p, spark.createDataFrame([(1, 9.0)], "id bigint, colour double"), "id", "colour")
    assert got.where("colour is not null").select("id").collect() == [(1,)]


def test_coarser_meshes(spark):
    n = 12
    v = spark.createDataFrame([(0, i * n + j, i + 0.5, j + 0.5, 0.0) for i in range(n) for j in range(n)], "tile_id bigint, row bigint, x double, y double, z double")
    quads = [(i * n + j, (i + 1) * n + j, i * n + j + 1, (i + 1) * n + j + 1) for i in range(n - 1) for j in range(n - 1)]
    f = spark.createDataFrame([t for a, b, c, d in quads for t in ((0, a, b, c), (0, b, d, c))], "tile_id bigint, u bigint, v bigint, w bigint")
    cv, cf = surface.decimated(v, f, 3.0)
    at = {r.row: (r.x, r.y) for r in cv.collect()}
    assert len(at) == 16 and sorted(at) == list(range(16)) and cf.count() == 18
    assert all((at[r.v][0] - at[r.u][0]) * (at[r.w][1] - at[r.u][1]) - (at[r.v][1] - at[r.u][1]) * (at[r.w][0] - at[r.u][0]) > 0 for r in cf.collect())
    two = v.unionByName(v.withColumn("tile_id", F.lit(1).cast("bigint")))
    pv, pf = surface.parents(two, f.unionByName(f.withColumn("tile_id", F.lit(1).cast("bigint"))), spark.createDataFrame([(0, 9), (1, 9)], "tile_id bigint, node bigint"))
    assert sorted(r.row for r in pv.collect()) == list(range(2 * n * n)) and pf.agg(F.max(F.greatest("u", "v", "w"))).first()[0] == 2 * n * n - 1
    tree = json.dumps({"root": {"content": {"uri": "a"}, "children": [{"content": {"uri": "b"}}]}})
    m = lambda x: [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, x, 2.0, 3.0, 1]
    out = json.loads(surface.finalised(tree, {"a": m(5.0), "b": m(7.0)}))["root"]
    assert out["transform"][12:] == [5.0, 2.0, 3.0, 1] and out["children"][0]["transform"][12:] == [2.0, 0.0, 0.0, 1]


def test_from_scans_to_mesh_files(spark, tmp_path):
    # a flat roof ten metres over the ground
    rng = np.random.default_rng(4)
    side = np.linspace(0, 30, 16)
    xyz = np.array([[a, b, (10 if 9 < a < 21 and 9 < b < 21 else 0) + rng.normal() * 0.02] for a in side for b in side])
    (tmp_path / "in").mkdir()
    (tmp_path / "in/scan_1.las").write_bytes(las.encode(xyz, np.tile(np.linspace(-10, 10, 16), 16), np.repeat(np.arange(16), 16), np.zeros((256, 3))))
    open_ = workflow.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), workflow.Parameters(ndtree_depth=1, max_ppt=1000, lam=0.01, closed=False), 4.0)
    v, f = ply.read_vertices(spark, str(tmp_path / "out"), ["x", "y", "z"]), ply.read_faces(spark, str(tmp_path / "out"))
    print(open_, v.count(), f.count())
    assert open_ == 0 and 30 <= v.count() <= 256 and f.count() > 50
    assert v.agg(F.max("z")).first()[0] > 9
