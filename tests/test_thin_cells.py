"""A cell may be so thin that its determinant is zero in doubles, though not exactly."""

from fractions import Fraction

import numpy as np
import pyarrow as pa

from pointloom.functions import predicates
from pointloom.operators import delaunay

THIN = np.array([[22.0, 0.0, 0.08799999999999986], [16.0, 10.0, 10.074], [18.0, 10.0, 10.071], [30.0, 0.0, 0.07600000000000007]])


def test_a_thin_cell_is_triangulated():
    t = pa.table({"tile_id": [0] * 4, "id": [0, 1, 2, 3], "owner": [0] * 4} | {a: THIN[:, i] for i, a in enumerate("xyz")})
    got = delaunay._triangulate(t).to_pylist()
    inner = [r for r in got if r["r2"] >= 0]
    assert len(got) == 5 and [sorted(r[v] for v in "abcd") for r in inner] == [[0, 1, 2, 3]]
    assert predicates.orientation(np.array([[[inner[0][a + v] for a in "xyz"] for v in "abcd"]]))[0] == 1


def test_spheres_go_through_their_corners():
    rng = np.random.default_rng(3)
    flat = rng.normal(size=(40, 4, 3)) * [1, 1, 1e-13]
    every = np.concatenate([THIN[None], rng.normal(size=(40, 4, 3)), flat, flat + 1000])
    every = every[predicates.orientation(every) != 0]
    for t, c, r2 in zip(every, *predicates.circumspheres(every), strict=True):
        far = [sum((Fraction(a) - Fraction(b)) ** 2 for a, b in zip(p, c, strict=True)) for p in t.tolist()]
        assert all(abs(float(x / Fraction(float(r2))) - 1) < 1e-6 for x in far)
