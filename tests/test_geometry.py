"""Neighbours, local shape and Delaunay cells against brute force."""

import itertools

import numpy as np

from pointloom.functions import predicates
from pointloom.operators import neighbours


def cloud(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id bigint, x double, y double, z double")


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(4)
    xyz = np.concatenate((rng.integers(0, 40, (120, 3)), [[500, 500, 500], [3, 3, 3], [3, 3, 3]]))
    got = sorted((r.query_id, r["rank"], r.id, r.d2) for r in neighbours.nearest(cloud(spark, xyz), 4, 5.0).collect())
    want = []
    for i, p in enumerate(xyz):
        near = sorted((float(((p - q) ** 2).sum()), j) for j, q in enumerate(xyz) if j != i)[:4]
        want += [(i, k + 1, j, d) for k, (d, j) in enumerate(near)]
    assert got == sorted(want)
    assert neighbours.nearest(cloud(spark, xyz[:2]), 4, 5.0).count() == 2
    assert neighbours.nearest(cloud(spark, xyz).limit(0), 4, 5.0).count() == 0


def test_a_plane_has_its_normal(spark):
    rng = np.random.default_rng(5)
    xyz = np.column_stack((rng.random((60, 2)) * 10, np.zeros(60)))
    for r in neighbours.local_shape(cloud(spark, xyz), 3.0, 10, 20).collect():
        assert abs(r.nz - 1) < 1e-6 and r.s3 <= 1e-6 and 10 <= r.k <= 20


def check_delaunay(xyz):
    cells = predicates.delaunay(xyz)
    finite = cells[(cells >= 0).all(1)]
    assert (predicates.orientation(xyz[finite]) > 0).all()
    for t in finite:
        rest = np.setdiff1d(np.arange(len(xyz)), t)
        assert not any(predicates.in_sphere(xyz[t][None], xyz[p])[0] for p in rest)
    # every facet is shared by two cells
    facets = np.concatenate([np.sort(np.delete(cells, i, 1), 1) for i in range(4)])
    assert (np.unique(facets, axis=0, return_counts=True)[1] == 2).all()
    u = xyz[finite]
    volume = np.abs(np.linalg.det(u[:, :3] - u[:, 3:])).sum() / 6
    return cells, volume


def test_delaunay_of_random_and_cospherical_points():
    rng = np.random.default_rng(6)
    check_delaunay(rng.random((60, 3)))
    grid = np.array(list(itertools.product(range(4), repeat=3)), float)
    _, volume = check_delaunay(grid[rng.permutation(64)])
    assert abs(volume - 27) < 1e-9
    assert len(predicates.delaunay(np.column_stack((rng.random((9, 2)), np.zeros(9))))) == 0


def test_tiles_give_the_cells_of_the_whole_cloud(spark):
    from pointloom.operators import delaunay

    rng = np.random.default_rng(7)
    xyz = np.concatenate((rng.integers(0, 100, (70, 3)), [[0, 0, 0], [99, 99, 99], [5, 5, 5], [5, 5, 5]])).astype(float)
    rows = [(int(p[0] // 50), i, *p.tolist()) for i, p in enumerate(xyz)]
    df = spark.createDataFrame(rows + [(1, 999, float("nan"), 0.0, 0.0)], "tile_id bigint, id bigint, x double, y double, z double")
    cells = predicates.delaunay(xyz[:-1])
    want = sorted(tuple(sorted(map(int, c))) for c in cells[(cells >= 0).all(1)])
    got = sorted((r.a, r.b, r.c, r.d) for r in delaunay.delaunay_cells(df).collect())
    assert got == want
    assert delaunay.delaunay_cells(df.limit(0)).count() == 0


def test_surface_of_a_full_cloud_is_closed_and_faces_outwards(spark):
    import json

    from pointloom.operators import delaunay, surface

    rng = np.random.default_rng(10)
    xyz = rng.random((40, 3)) * 10
    cells = predicates.delaunay(xyz)
    cells = np.sort(cells[(cells >= 0).all(1)], 1)
    df = spark.createDataFrame([(*map(int, c), 0) for c in cells], "a bigint, b bigint, c bigint, d bigint, label int")
    faces = surface.surface(df, cloud(spark, xyz)).collect()
    edges = [(r[i], r[j]) for r in faces for i, j in (("u", "v"), ("v", "w"), ("w", "u"))]
    assert faces and len(set(edges)) == len(edges) and {(b, a) for a, b in edges} == set(edges)
    volume = sum(np.dot(xyz[r.u], np.cross(xyz[r.v], xyz[r.w])) for r in faces) / 6
    u = xyz[cells]
    assert abs(volume - np.abs(np.linalg.det(u[:, :3] - u[:, 3:])).sum() / 6) < 1e-9
    assert surface.surface(df, cloud(spark, xyz), closed=False).count() == 0
    # the dual: hull facets have one cell
    dual = delaunay.dual_edges(df).collect()
    assert sum(r.first == r.second for r in dual) == len(faces) and 2 * len(dual) - len(faces) == 4 * len(cells)
    vertices, again = surface.reindexed(surface.surface(df, cloud(spark, xyz)).selectExpr("7L tile_id", "u", "v", "w"), cloud(spark, xyz))
    ids = {r.row: r.id for r in vertices.collect()}
    assert sorted(ids) == list(range(len(ids))) and {(ids[r.u], ids[r.v], ids[r.w]) for r in again.collect()} == {(r.u, r.v, r.w) for r in faces}
    boxes = spark.createDataFrame([(t, float(t), t + 1.0, 0.0, 1.0, 0.0, 1.0) for t in range(4)], "tile_id bigint, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double")
    tree = json.loads(surface.tileset(surface.tile_tree(boxes, 2), 2))["root"]
    assert tree["boundingVolume"]["box"][:4] == [2, 0.5, 0.5, 2] and len(tree["children"]) == 2 and all(len(c["children"]) == 2 for c in tree["children"])


def test_local_shape_has_least_entropy(spark):
    rng = np.random.default_rng(11)
    xyz = rng.random((40, 3)) * [10, 5, 1]
    for r in neighbours.local_shape(cloud(spark, xyz), 2.0, 10, 25).where("id < 5").collect():
        order = np.argsort(((xyz - xyz[r.id]) ** 2).sum(1))
        best = []
        for k in range(10, 26):
            s = np.linalg.svd(xyz[order[:k]] - xyz[order[:k]].mean(0), compute_uv=False)
            d = np.array([s[0] - s[1], s[1] - s[2], s[2]]) / s.sum()
            best.append(-(d * np.log(d)).sum())
        assert r.k == 10 + int(np.argmin(best)) and abs(r.entropy - min(best)) < 1e-9
