"""Round trips of the file formats and streams."""

import json

import numpy as np

from pointloom.sources import las, ply, texts
from pointloom.streaming import ingest


def test_las(spark, tmp_path):
    rng = np.random.default_rng(8)
    xyz, angle = (rng.random((100, 3)) * 1000).round(3), (rng.random(100) * 40 - 20).round(1)
    source, colour = rng.integers(0, 9, 100), rng.integers(0, 65536, (100, 3))
    (tmp_path / "a.las").write_bytes(las.encode(xyz, angle, source, colour))
    (tmp_path / "b.las").write_bytes(las.encode(xyz[:0], angle[:0], source[:0], colour[:0]))
    rows = las.read_las(spark, str(tmp_path)).orderBy("row").collect()
    assert len(rows) == 100
    assert np.allclose([[r.x, r.y, r.z] for r in rows], xyz, atol=6e-4)
    assert np.allclose([r.scan_angle for r in rows], angle, atol=4e-3)
    assert [(r.point_source_id, r.red, r.green, r.blue) for r in rows] == [(int(s), *map(int, c)) for s, c in zip(source, colour)]


def test_ply(spark, tmp_path):
    df = spark.createDataFrame([(t, i, float(i) / 3, -1.5, 2e-9 * t) for t in (4, 7) for i in range(5)], "tile_id bigint, row bigint, x double, y double, z double")
    ply.write_tiles(df, str(tmp_path / "out"), ["x", "y", "z"])
    (tmp_path / "in").mkdir()
    for t in (4, 7):
        (part,) = (tmp_path / "out" / f"tile_id={t}").glob("part-*.txt")
        part.rename(tmp_path / "in" / f"cloud_{t}.ply")
    got = ply.read_vertices(spark, str(tmp_path / "in"), ["x", "y", "z", "nx"])
    assert sorted(map(tuple, got.drop("nx").collect())) == sorted(map(tuple, df.collect()))
    assert got.where("nx is null").count() == 10
    raw = b"ply\nformat binary_big_endian 1.0\ncomment bbox 0 1\nelement vertex 3\nproperty float x\nproperty uchar f\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    raw += np.array([(1, 2), (3, 4), (5, 6)], [("x", ">f4"), ("f", "u1")]).tobytes() + b"\x03" + np.array([0, 2, 1], ">i4").tobytes()
    vertex, faces, comments = ply.parse(raw)
    assert vertex["x"].tolist() == [1, 3, 5] and vertex["f"].tolist() == [2, 4, 6] and faces == [[0, 2, 1]] and comments == ["bbox 0 1"]
    (tmp_path / "in" / "mesh_9.ply").write_bytes(raw)
    assert [tuple(r) for r in ply.read_faces(spark, str(tmp_path / "in")).collect()] == [(9, 0, [0, 2, 1])]


def test_texts(spark, tmp_path):
    (tmp_path / "v").write_text("1 0.5 0.5\n2 0.1 0.9\n")
    (tmp_path / "e").write_text("1 2 1 2 3 4\n")
    (tmp_path / "f").write_text("### 5\n2\n1 2\n2 2\n3\n0 0.5\n1 0.25\n3 1\n### 6\n1\n2\n2\n2\n0 1\n1 2\n")
    (tmp_path / "g").write_text("1 7 0.5 0\n1 8 0 1\n2 7 8 0.25 0.5\n")
    assert sorted(map(tuple, texts.pairwise_vertices(spark, str(tmp_path / "v")).collect())) == [(1, [0.5, 0.5]), (2, [0.1, 0.9])]
    assert [tuple(r) for r in texts.pairwise_edges(spark, str(tmp_path / "e"), 2).collect()] == [(1, 2, [1, 3, 2, 4])]
    assert sorted(map(tuple, texts.factor_blocks(spark, str(tmp_path / "f")).collect())) == [(5, [1, 2], [2, 2], [0.5, 0.25, 0, 1]), (6, [2], [2], [1, 2])]
    cells, arcs = texts.flow_records(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, cells.collect())) == [(7, 0.5, 0), (8, 0, 1)] and [tuple(r) for r in arcs.collect()] == [(7, 8, 0.25, 0.5)]
    got = texts.parameters("<env><datasets><a><lambda>1,10</lambda><dim>3</dim></a><b><do_process>false</do_process></b></datasets></env>")
    assert got == {"a": {"lambda": ["1", "10"], "dim": ["3"]}} and texts.parameters(texts.parameters_xml("a", got["a"])) == got
    assert [p["lambda"] for p in texts.expanded(got["a"], "lambda:gt")] == ["10", "1"]
    points = spark.createDataFrame([(1.0, 2.0, 3.0, 9)], "x double, y double, z double, id bigint")
    feature = json.loads(texts.collection([r.feature for r in texts.point_features(points, "id").collect()]))["features"][0]
    assert feature == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.0, 2.0, 3.0]}, "properties": {"id": 9}}


def test_stream_agrees_with_batch(spark, tmp_path):
    rng = np.random.default_rng(9)
    schema = "x double, y double, z double"
    df = spark.createDataFrame([tuple(map(float, p)) for p in rng.random((200, 3)) * 1.2], schema)
    df.repartition(3).write.parquet(str(tmp_path / "p"))
    box = {a: (0.0, 1.0) for a in "xyz"}
    q = ingest.tile_extents(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p")), box, 1).writeStream.outputMode("complete").format("memory").queryName("extents").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, ingest.tile_extents(df, box, 1).collect()))
    assert want and sorted(map(tuple, spark.table("extents").collect())) == want
