"""Belief propagation and cuts against brute force."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from pointloom.operators import belief, cuts
from pointloom.plans.lineage import cut


def test_pairwise_is_exact_on_a_tree(spark):
    rng = np.random.default_rng(1)
    prior = {i: rng.random(3) + 0.1 for i in range(5)}
    edges = {(0, 1): rng.random((3, 3)) + 0.1, (1, 2): rng.random((3, 3)) + 0.1, (1, 3): rng.random((3, 3)) + 0.1}
    want = np.zeros((5, 3))
    for s in itertools.product(range(3), repeat=5):
        p = np.prod([prior[i][s[i]] for i in range(5)]) * np.prod([f[s[a], s[b]] for (a, b), f in edges.items()])
        for i in range(5):
            want[i, s[i]] += p
    v = spark.createDataFrame([(i, p.tolist()) for i, p in prior.items()], "id bigint, prior array<double>")
    e = spark.createDataFrame([(a, b, f.ravel().tolist()) for (a, b), f in edges.items()], "src bigint, dst bigint, factor array<double>")
    got = {r.id: r.belief for r in belief.pairwise(v, e, 3, rounds=6, eps=1e-9).collect()}
    assert all(np.allclose(got[i], want[i] / want[i].sum(), atol=1e-9) for i in range(5))
    assert belief.pairwise(v, e.limit(0), 3, rounds=3).count() == 5
    assert belief.pairwise(v.limit(0), e.limit(0), 3, rounds=3).count() == 0


def test_factor_graph_is_exact_on_a_tree(spark):
    rng = np.random.default_rng(2)
    cards = [2, 3, 2, 2]
    prior = [rng.random(c) + 0.1 for c in cards]
    factors = [((0, 1, 2), rng.random(12) + 0.1), ((2, 3), rng.random(4) + 0.1)]
    want = [np.zeros(c) for c in cards]
    for s in itertools.product(*map(range, cards)):
        p = np.prod([prior[i][s[i]] for i in range(4)])
        for vs, table in factors:
            at, step = 0, 1
            for v in vs:
                at, step = at + s[v] * step, step * cards[v]
            p *= table[at]
        for i in range(4):
            want[i][s[i]] += p
    v = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(prior)], "id bigint, prior array<double>")
    f = spark.createDataFrame([(k, list(vs), [cards[x] for x in vs], t.tolist()) for k, (vs, t) in enumerate(factors)], "id bigint, vars array<bigint>, cards array<int>, values array<double>")
    got = {r.id: r.belief for r in belief.factor_graph(v, f, rounds=6, eps=1e-9).collect()}
    assert all(np.allclose(got[i], want[i] / want[i].sum(), atol=1e-9) for i in range(4))


def energy(labels, c0, c1, facets):
    return sum(c1[i] if x else c0[i] for i, x in enumerate(labels)) + sum(w for a, b, w in facets if labels[a] != labels[b])


def test_tile_and_agreed_labels_have_least_energy(spark):
    rng = np.random.default_rng(3)
    n = 9
    c0, c1 = rng.random(n).round(3), rng.random(n).round(3)
    facets = [(a, b, float(rng.random().__round__(3) / 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]
    best = min(energy(s, c0, c1, facets) for s in itertools.product((0, 1), repeat=n))
    cells = spark.createDataFrame([(0, i, float(c0[i]), float(c1[i])) for i in range(n)], "tile_id bigint, cell_id bigint, cost0 double, cost1 double")
    walls = spark.createDataFrame([(0, *f) for f in facets], "tile_id bigint, a bigint, b bigint, weight double")
    got = {r.cell_id: r.label for r in cuts.tile_labels(cells, walls).collect()}
    assert abs(energy([got[i] for i in range(n)], c0, c1, facets) - best) < 1e-9
    assert cuts.tile_labels(cells.limit(0), walls.limit(0)).count() == 0
    # a chain in two tiles that share a cell: what the tiles agree on is the least of all
    chain = [(i, i + 1, 0.3) for i in range(4)]
    two = [(t, i, float(c0[i]), float(c1[i])) for t, ids in ((0, (0, 1, 2)), (1, (2, 3, 4))) for i in ids]
    labels, open_ = cuts.agreed_labels(spark.createDataFrame(two, cells.schema), spark.createDataFrame([(0 if a < 2 else 1, a, b, w) for a, b, w in chain], walls.schema), 0.5, 12)
    got = {r.cell_id: r.label for r in labels.collect()}
    if not open_:
        assert abs(energy([got[i] for i in range(5)], c0, c1, chain) - min(energy(s, c0, c1, chain) for s in itertools.product((0, 1), repeat=5))) < 1e-9
    assert len(got) == 5


def test_the_estimate_of_a_loop_stays_bounded(spark):
    t = cut(spark.range(3).withColumn("v", F.col("id")))
    for _ in range(5):
        t = cut(t.alias("x").join(t.alias("y"), "id").join(t.alias("z"), "id").select("id", (F.col("x.v") + 1).alias("v")))
        assert t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**63
    assert sorted(map(tuple, t.collect())) == [(0, 5), (1, 6), (2, 7)]
