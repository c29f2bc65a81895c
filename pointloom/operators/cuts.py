"""Two-label cuts: an exact minimum cut for each tile, and agreement of tiles on shared cells by dual decomposition."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.plans.lineage import cut


def min_cut(n: int, zero: np.ndarray, one: np.ndarray, a: np.ndarray, b: np.ndarray, forth: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Labels 0 or 1 of n nodes of least sum of costs: zero[i] or one[i] for the node's label, forth[k] where a has 1 and b 0, back[k] where a has 0 and b 1.

    Augmenting by blocking flows over level graphs. Nodes that the sink can't be reached from by leftover capacity have label 1.
    """
    s, t = n, n + 1
    head, to, cap = [[] for _ in range(n + 2)], [], []

    def arc(u: int, v: int, c: float, r: float) -> None:
        head[u].append(len(to))
        head[v].append(len(to) + 1)
        to.extend((v, u))
        cap.extend((c, r))

    for i, (c0, c1) in enumerate(zip(zero.tolist(), one.tolist(), strict=True)):
        # a node with label 1 is on the source's side: label 0 cuts the arc from the source
        d = c0 - c1
        arc(s, i, max(d, 0.0), 0.0)
        arc(i, t, max(-d, 0.0), 0.0)
    for u, v, c, r in zip(a.tolist(), b.tolist(), forth.tolist(), back.tolist(), strict=True):
        arc(u, v, c, r)
    tiny = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[s], todo = 0, deque([s])
        while todo:
            u = todo.popleft()
            for e in head[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    todo.append(to[e])
        if level[t] < 0:
            break
        at = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[u] < len(head[u]):
                e = head[u][at[u]]
                if cap[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(head[u]):
                path.append(head[u][at[u]])
                u = to[path[-1]]
            elif u == s:
                break
            else:
                level[u] = -1
                u = to[path.pop() ^ 1]
    # nodes from which the sink is still within reach
    seen, todo = [False] * (n + 2), deque([t])
    seen[t] = True
    while todo:
        v = todo.popleft()
        for e in head[v]:
            if cap[e ^ 1] > tiny and not seen[to[e]]:
                seen[to[e]] = True
                todo.append(to[e])
    return np.array([0 if x else 1 for x in seen[:n]], np.int32)


def tile_labels(cells: DataFrame, facets: DataFrame) -> DataFrame:
    """(tile_id, cell_id, label): the least-cost labels of each tile's ``cells`` (tile_id, cell_id, cost0, cost1) and ``facets`` (tile_id, a, b, weight).

    A task holds one tile at a time, whose size the tiling bounds. Facets with a cell that the tile hasn't are left out, and so are repeated cells.
    """

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"tile_id": pa.array([], pa.int64()), "cell_id": pa.array([], pa.int64()), "label": pa.array([], pa.int32())})
        ids, first = np.unique(left.column("cell_id").to_numpy(), return_index=True)
        tile = left.column("tile_id")[0].as_py()
        c0, c1 = (left.column(c).to_numpy()[first] for c in ("cost0", "cost1"))
        if right.num_rows:
            a, b, w = (right.column(c).to_numpy() for c in ("a", "b", "weight"))
            known = np.isin(a, ids) & np.isin(b, ids)
            a, b, w = np.searchsorted(ids, a[known]), np.searchsorted(ids, b[known]), w[known]
        else:
            a, b, w = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        labels = min_cut(len(ids), c0, c1, a, b, w, w)
        return pa.table({"tile_id": np.full(len(ids), tile, np.int64), "cell_id": ids.astype(np.int64), "label": labels})

    c = cells.selectExpr("cast(tile_id as bigint) tile_id", "cast(cell_id as bigint) cell_id", "cast(cost0 as double) cost0", "cast(cost1 as double) cost1")
    f = facets.selectExpr("cast(tile_id as bigint) tile_id", "cast(a as bigint) a", "cast(b as bigint) b", "cast(weight as double) weight")
    return c.groupBy("tile_id").cogroup(f.groupBy("tile_id")).applyInArrow(solve, "tile_id bigint, cell_id bigint, label int")


def agreed_labels(cells: DataFrame, facets: DataFrame, step: float = 1.0, rounds: int = 30) -> tuple[DataFrame, int]:
    """(cell_id, label) over all tiles and the number of shared cells still in dispute.

    ``cells`` has each cell once for every tile that holds it; costs and weights are shared out evenly among the holders. Each round cuts the tiles apart,
    then moves each multiplier of two tiles and a cell by its step times their difference; a step halves where the difference changed. The least tile's label wins at the end.
    """
    share = cells.groupBy("cell_id").agg(F.count("*").alias("h"))
    base = cut(cells.join(share, "cell_id").select("tile_id", "cell_id", (F.col("cost0") / F.col("h")).alias("c0"), (F.col("cost1") / F.col("h")).alias("c1")))
    both = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    sides = facets.select("tile_id", *both, "weight")
    holders = sides.groupBy("a", "b").agg(F.count("*").alias("h"))
    walls = cut(sides.join(holders, ["a", "b"]).select("tile_id", "a", "b", (F.col("weight") / F.col("h")).alias("weight")))
    k, l = base.select("cell_id", F.col("tile_id").alias("k")), base.select("cell_id", F.col("tile_id").alias("l"))
    pairs = cut(k.join(l, "cell_id").where("k < l").withColumns({"lam": F.lit(0.0), "tau": F.lit(float(step)), "diff": F.lit(0)}))
    for turn in range(rounds):
        push = pairs.select(F.col("k").alias("tile_id"), "cell_id", (-F.col("lam")).alias("v")).unionByName(pairs.select(F.col("l").alias("tile_id"), "cell_id", F.col("lam").alias("v")))
        push = push.groupBy("tile_id", "cell_id").agg(F.sum("v").alias("v"))
        v = F.coalesce("v", F.lit(0.0))
        costs = base.join(push, ["tile_id", "cell_id"], "left").select("tile_id", "cell_id", (F.col("c0") + F.greatest(v, F.lit(0.0))).alias("cost0"), (F.col("c1") + F.greatest(-v, F.lit(0.0))).alias("cost1"))
        labels = cut(tile_labels(costs, walls))
        lab = lambda name, out: labels.select("cell_id", F.col("tile_id").alias(name), F.col("label").alias(out))
        d = pairs.join(lab("k", "x"), ["cell_id", "k"]).join(lab("l", "y"), ["cell_id", "l"]).withColumn("d", F.col("x") - F.col("y"))
        tau = F.when((F.col("d") != F.col("diff")) & F.lit(turn > 0), F.col("tau") / 2).otherwise(F.col("tau"))
        pairs = cut(d.select("cell_id", "k", "l", (F.col("lam") + F.col("tau") * F.col("d")).alias("lam"), tau.alias("tau"), F.col("d").alias("diff")))
        if not (open_ := pairs.where("diff <> 0").count()):
            break
    return labels.groupBy("cell_id").agg(F.min_by("label", "tile_id").alias("label")), open_
