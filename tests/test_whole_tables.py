"""The queries over all lines against brute force."""

import random

import pytest

from pointloom.operators.transfer import nearest_colour
from pointloom.plans.queries import QUERIES
from pointloom.sources.tables import points

DATA = "/root/testdata/sf0.001"


def test_nearest_colour(spark):
    rng = random.Random(6)
    vertices = [(float(rng.randint(-30, 30)), rng.randint(-60, 60) / 2) for _ in range(150)] + [(500.0, 0.0), (5.0, 5.0)]
    cloud = [(rng.randint(0, 40), float(rng.randint(-30, 30)), rng.randint(-60, 60) / 2, float(rng.randint(0, 9))) for _ in range(200)]
    got = nearest_colour(spark.createDataFrame(vertices, "x double, y double"), spark.createDataFrame(cloud, "k1 long, x double, y double, z double"))
    want = {}
    for x, y in vertices:
        near = [((x - a) ** 2 + (y - b) ** 2, k, z) for k, a, b, z in cloud if abs(x - a) <= 5 and abs(y - b) <= 5]
        want[x, y] = min(near)[2] if near else -1.0
    assert {(r.x, r.y): r.colour for r in got.collect()} == want and got.count() == len(want) and -1.0 in want.values()


@pytest.fixture(scope="module")
def cloud(spark):
    return [tuple(r) for r in points(spark, DATA).select("x", "y", "z", "k1", "k4").collect()]


def test_every_line_is_read(spark, cloud):
    run = lambda q: QUERIES[q](spark, DATA).collect()
    places = sorted({p[:2] for p in cloud})
    assert sorted((r.x, r.y, r.vertex_id) for r in run("mesh_reindex")) == [(*p, k) for k, p in enumerate(places)]
    assert {(r.s1, r.s2, r.s3) for r in run("dimensionality")} == {(c + 3, b + 2, a + 1) for a, b, c in (sorted(p[:3]) for p in cloud)}
    first = {}
    for x, y, z, k, _ in cloud:
        first[x, y] = min(first.get((x, y), (k, z)), (k, z))
    assert {(r.x, r.y): r.colour for r in run("color_transfer")} == {p: w[1] for p, w in first.items()}
    box = {}
    for x, y, _, _, s in cloud:
        box.setdefault(s, []).append((x, y))
    box = {s: (min(x for x, _ in p), max(x for x, _ in p), min(y for _, y in p), max(y for _, y in p)) for s, p in box.items()}
    want = {(a, b) for a in box for b in box if a < b and box[a][0] <= box[b][1] and box[b][0] <= box[a][1] and box[a][2] <= box[b][3] and box[b][2] <= box[a][3]}
    assert {(r.a, r.b) for r in run("bbox_intersections")} == want
