"""Exact nearest neighbours over a grid, and the local shape that they span."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.plans.lineage import cut

#: Points of a cell (with its neighbours) that one task compares at once; denser cells are dealt over several tasks.
PART = 50_000


def _compare(k: int, size: float, own: bool):
    """Of the queries of a cell and the points around it: the k nearest of each, and a row with how many points it has seen."""
    axes = ("x", "y", "z")

    def compare(q: pa.Table, p: pa.Table) -> pa.Table:
        if not q.num_rows:
            return pa.table({n: pa.array([], pa.float64() if n in ("d2", "out2") else pa.int64()) for n in ("query_id", "id", "d2", "out2", "seen")})
        out = {n: [] for n in ("query_id", "id", "d2", "out2", "seen")}
        qx, px = (np.stack([t.column(f"{c}{a}").to_numpy() for a in axes], 1) for t, c in ((q, ""), (p, "p")))
        qid, pid = q.column("id").to_numpy(), p.column("pid").to_numpy()
        order = np.argsort(pid, kind="stable")
        px, pid = px[order], pid[order]
        cell = np.array([q.column(c)[0].as_py() for c in ("ci", "cj", "ck")]) if len(qid) else np.zeros(3)
        way = np.minimum(qx - (cell - 1) * size, (cell + 2) * size - qx).min(1, initial=np.inf)
        for a in range(0, len(qid), 64):
            d2 = ((qx[a : a + 64, None] - px[None]) ** 2).sum(2)
            for i, row in enumerate(d2):
                if own:
                    row[pid == qid[a + i]] = np.inf
                best = np.argsort(row, kind="stable")[:k] if len(row) <= 4 * k else (s := np.flatnonzero(row <= np.partition(row, k)[k]))[np.argsort(row[s], kind="stable")][:k]
                best = best[np.isfinite(row[best])]
                # a row without neighbour says how many points the query has seen
                out["query_id"].append(np.full(len(best) + 1, qid[a + i]))
                out["id"].append(np.append(pid[best], -1))
                out["d2"].append(np.append(row[best], np.inf))
                out["out2"].append(np.full(len(best) + 1, way[a + i] ** 2))
                out["seen"].append(np.append(np.zeros(len(best), np.int64), len(pid)))
        return pa.table({n: np.concatenate(v).astype(np.float64 if n in ("d2", "out2") else np.int64) if v else np.zeros(0, np.float64 if n in ("d2", "out2") else np.int64) for n, v in out.items()})

    return compare


def nearest(points: DataFrame, k: int, size: float) -> DataFrame:
    """(query_id, rank, id, d2): the k nearest other points (all, if fewer) of each of ``points`` (id, x, y, z), ties by id. See ``nearest_of``."""
    fine = cut(_fine(points))
    return _search(fine, fine, k, size, True)


def nearest_of(queries: DataFrame, points: DataFrame, k: int, size: float, reach: float | None = None) -> DataFrame:
    """(query_id, rank, id, d2): the k nearest ``points`` (id, x, y, z) of each of ``queries`` (id, x, y, z), ties by id; with ``reach``, only those no farther than that.

    Rows with a null or NaN coordinate take no part. Points meet in cubes of edge ``size`` and their 26 neighbours. A query is settled once its k-th distance (or ``reach``) is no longer than the way out of
    that block; the others try again with cubes twice as wide. Where a cube has more than PART points around it, its points and its queries are dealt over several tasks; no other cube is.
    """
    return _search(cut(_fine(queries)), cut(_fine(points)), k, size, False, reach)


def within(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(query_id, id, d2): all ``points`` within ``radius`` of each of ``queries``; an equi-join of cubes of that width, so each point meets 27 cubes."""
    at = lambda a: F.floor(F.col(a) / radius).cast("bigint")
    q = _fine(queries).select(F.col("id").alias("query_id"), *[F.col(a).alias(f"q{a}") for a in "xyz"], *[at(a).alias(f"c{a}") for a in "xyz"])
    p = _fine(points).select("id", "x", "y", "z", *[at(a).alias(f"c{a}") for a in "xyz"])
    for a in "xyz":
        p = p.withColumn(f"c{a}", F.explode(F.array(*[F.col(f"c{a}") + d for d in (-1, 0, 1)])))
    d2 = sum((F.col(f"q{a}") - F.col(a)) * (F.col(f"q{a}") - F.col(a)) for a in "xyz")
    return q.join(p, ["cx", "cy", "cz"]).select("query_id", "id", d2.alias("d2")).where(F.col("d2") <= radius * radius)


def _fine(points: DataFrame) -> DataFrame:
    return points.select(F.col("id").cast("bigint").alias("id"), *[F.col(a).cast("double").alias(a) for a in "xyz"]).where(" and ".join(f"{a} is not null and not isnan({a})" for a in "xyz"))


def _search(queries: DataFrame, fine: DataFrame, k: int, size: float, own: bool, reach: float | None = None) -> DataFrame:
    cell, axes = ["ci", "cj", "ck"], ("x", "y", "z")
    total = fine.count()
    left, done = queries, []
    found = queries.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("d2")).limit(0)
    while total:
        at = [F.floor(F.col(a) / size).cast("bigint") for a in axes]
        spread = fine.select(F.col("id").alias("pid"), *axes)
        for n, c in zip(cell, at, strict=True):
            spread = spread.withColumn(n, F.explode(F.array(*[(c + d) for d in (-1, 0, 1)])))
        asked = left.select("*", *[c.alias(n) for n, c in zip(cell, at, strict=True)])
        spread = cut(spread.join(asked.select(*cell).distinct(), cell))
        dense = cut(spread.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(PART)).cast("bigint").alias("parts")).where("parts > 1"))
        parts = F.coalesce("parts", F.lit(1).cast("bigint"))
        zero = F.lit(0).cast("bigint")
        every = F.explode(F.sequence(zero, parts - 1))
        key = [*cell, "part", "turn"]
        spread = spread.join(dense, cell, "left").withColumn("part", F.pmod(F.xxhash64("pid"), parts)).withColumn("turn", every).select("pid", *[F.col(c).alias(f"p{c}") for c in (*axes, *key)])
        asked = asked.join(dense, cell, "left").withColumn("turn", F.pmod(F.xxhash64("id"), parts)).withColumn("part", every).drop("parts")

        raw = asked.groupBy(*key).cogroup(spread.groupBy(*[f"p{c}" for c in key])).applyInArrow(_compare(k, size, own), "query_id bigint, id bigint, d2 double, out2 double, seen bigint")
        # at most k rows of each part
        lists = raw.groupBy("query_id").agg(F.sum("seen").alias("seen"), F.first("out2").alias("out2"), F.slice(F.sort_array(F.collect_list(F.when(F.col("seen") == 0, F.struct("d2", "id")))), 1, k).alias("best"))
        settled = (F.col("seen") == total) | ((F.size("best") == k) & (F.element_at("best", -1)["d2"] <= F.col("out2")))
        if reach is not None:
            settled |= F.col("out2") >= reach * reach
        lists = cut(lists.withColumn("ok", F.coalesce(settled, F.lit(False))))
        done.append(lists.where("ok").select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).alias("rank"), "b.id", "b.d2"))
        left = cut(left.join(lists.where("not ok").select(F.col("query_id").alias("id")), "id", "left_semi"))
        if left.isEmpty():
            break
        size *= 2
    for d in done:
        found = found.unionByName(d)
    return found if reach is None else found.where(F.col("d2") <= reach * reach)


def local_shape(points: DataFrame, size: float, least: int = 10, most: int = 150, near_d2: float = 0.02, near_k: int = 30) -> DataFrame:
    """(id, k, entropy, s1, s2, s3, nx, ny, nz): for each point the neighbourhood of least eigen-entropy, its singular values and normal.

    Neighbourhoods of ``least`` to ``most`` points, the point itself included, are tried, but none of fewer than ``near_k`` whose last point is within a squared distance of ``near_d2`` (if there are
    others); the first of least entropy wins. Points with fewer neighbours than ``least`` get nulls.
    """
    at = points.select(F.col("id").cast("bigint").alias("id"), "x", "y", "z")
    near = nearest(points, most - 1, size).join(at, "id").groupBy(F.col("query_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "x", "y", "z"))).alias("near"))
    rows = at.join(near, "id")

    def shapes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("k", "entropy", "s1", "s2", "s3", "nx", "ny", "nz")
        for b in it:
            out = {n: [] for n in names}
            own = np.stack([b.column(a).to_numpy() for a in "xyz"], 1)
            for o, l in zip(own, b.column("near"), strict=True):
                d = np.stack([l.values.field(a).to_numpy() for a in "xyz"], 1) - o
                d = np.concatenate((np.zeros((1, 3)), d))
                if len(d) < least:
                    for n in names:
                        out[n].append(None)
                    continue
                count = np.arange(1, len(d) + 1)[:, None, None]
                mean = np.cumsum(d, 0)[:, :, None] / count
                scatter = np.cumsum(d[:, :, None] * d[:, None, :], 0) - count * mean * mean.transpose(0, 2, 1)
                values, vectors = np.linalg.eigh(scatter[least - 1 :])
                s = np.maximum(np.sqrt(np.maximum(values[:, ::-1], 0)), 1e-7)
                dim = np.stack((s[:, 0] - s[:, 1], s[:, 1] - s[:, 2], s[:, 2]), 1) / s.sum(1, keepdims=True)
                entropy = -np.where(dim > 0, dim * np.log(np.maximum(dim, 1e-300)), 0).sum(1)
                size_at = np.arange(least, len(d) + 1)
                close = (size_at < near_k) & ((d[least - 1 :] ** 2).sum(1) < near_d2)
                i = int(np.argmin(np.where(close, np.inf, entropy) if not close.all() else entropy))
                normal = vectors[i][:, 0]
                normal = normal * np.sign(normal[np.flatnonzero(np.abs(normal) > 1e-9)[-1]])
                for n, v in zip(names, (least + i, float(entropy[i]), *s[i].tolist(), *normal.tolist()), strict=True):
                    out[n].append(v)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(out[n], pa.int64() if n == "k" else pa.float64()) for n in names)], ["id", *names])

    return rows.mapInArrow(shapes, "id bigint, k bigint, entropy double, s1 double, s2 double, s3 double, nx double, ny double, nz double")


def flipped(shapes: DataFrame, sensor: tuple = ("x_origin", "y_origin", "z_origin")) -> DataFrame:
    """``shapes`` (x, y, z, nx, ny, nz and the columns or numbers of ``sensor``) with normals that point towards the sensor."""
    towards = sum((F.col(s) if isinstance(s, str) else F.lit(float(s))) * F.col(f"n{a}") - F.col(a) * F.col(f"n{a}") for a, s in zip("xyz", sensor, strict=True))
    return shapes.withColumns({f"n{a}": F.when(towards < 0, -F.col(f"n{a}")).otherwise(F.col(f"n{a}")) for a in "xyz"})


def dimensions(s1: str, s2: str, s3: str) -> list[Column]:
    """How much of a line, a plane and a volume three falling singular values make; they add up to 1."""
    a, b, c = F.col(s1), F.col(s2), F.col(s3)
    n = a + b + c
    return [(a - b) / n, (b - c) / n, c / n]


def entropy(parts: list[Column]) -> Column:
    """-sum p ln p; a part of 0 counts nothing."""
    return -sum((F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0)) for p in parts), F.lit(0.0))


def covariance(points: DataFrame, *by: str) -> DataFrame:
    """(by, n, cxx, cxy, cyy, cxz, cyz, czz): the covariance of each group's coordinates, from sums that are added up before the shuffle."""
    pairs = [(a, b) for j, b in enumerate("xyz") for a in "xyz"[: j + 1]]
    t = points.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(a).alias(f"s{a}") for a in "xyz"], *[F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in pairs])
    return t.select(*by, "n", *[((F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("n")) / F.col("n")).alias(f"c{a}{b}") for a, b in pairs])
