"""Operator 3: exact top-k inner products by ball-tree branch and bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import Scratch, with_row_number

LEAF = 64
#: Vectors of a shard (one tree), shards of a group (searched by one task for a block), queries of a block, shards whose balls are held together.
SHARD, GROUP, BLOCK, PACK = 4096, 8, 512, 256
#: Vectors by which rows are put near their like before they are cut into shards; they decide how much is skipped, not what is found.
PIVOTS = 64
_NONE, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class BallTree:
    """Balls around halves of the vectors, split along the line between two far points, down to leaves; a node's vectors are neighbours in ``order``."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float64)
        self.order = np.arange(len(points))
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int, int, int]] = []  # first, end, left child, right child
        self._build(0, len(points))

    def _build(self, lo: int, hi: int) -> int:
        at = self.order[lo:hi]
        x = self.points[at]
        centre = x.mean(0)
        apart = np.sqrt(((x - centre) ** 2).sum(1))
        me, radius = len(self.span), float(apart.max())
        self.centre.append(centre)
        self.radius.append(radius)
        self.span.append((lo, hi, -1, -1))
        if hi - lo > LEAF and radius > 0:
            one = x[apart.argmax()]
            other = x[((x - one) ** 2).sum(1).argmax()]
            self.order[lo:hi] = at[np.argsort(x @ (other - one), kind="stable")]
            mid = (lo + hi) // 2
            self.span[me] = (lo, hi, self._build(lo, mid), self._build(mid, hi))
        return me


def bounds(points: np.ndarray, norms: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each query and ball, no less than the largest inner product with a vector in the ball: q.c + |q| r, with room for rounding."""
    b = points @ centres.T + norms[:, None] * radii
    return b + 1e-9 * (np.abs(b) + norms[:, None] * (np.sqrt((centres**2).sum(1)) + radii)) + 1e-6


class Search:
    """The best ``k`` of each query of a block so far; every tree that is searched goes on from the kth scores of those before."""

    def __init__(self, rns: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray):
        self.rns, self.queries, self.k = rns, queries, k
        self.points = queries.astype(np.float64)
        self.norms = np.sqrt((self.points**2).sum(1))
        self.scores = np.full((len(queries), k), _NONE)
        self.ids = np.full((len(queries), k), _LAST)
        self.floor = floor

    def kth(self, at: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[at, -1], self.floor[at])

    def run(self, rns: np.ndarray, ids: np.ndarray, vectors: np.ndarray, centre: np.ndarray, radius: np.ndarray, span: np.ndarray) -> None:
        """Searches one tree, whose vectors are in its order."""
        self.tree = (rns, ids, vectors, vectors.astype(np.float64))
        self.centre, self.radius, self.span = centre, radius, span.tolist()
        self._visit(0, np.arange(len(self.queries)))

    def _bound(self, node: int, at: np.ndarray) -> np.ndarray:
        return bounds(self.points[at], self.norms[at], self.centre[node : node + 1], self.radius[node : node + 1])[:, 0]

    def _visit(self, node: int, at: np.ndarray) -> None:
        at = at[self._bound(node, at) >= self.kth(at)]  # equal scores may still win by a smaller id
        if not len(at):
            return
        lo, hi, left, right = self.span[node]
        if left < 0:
            self._take(lo, hi, at)
            return
        left_first = self._bound(left, at) >= self._bound(right, at)
        for some, first, second in ((at[left_first], left, right), (at[~left_first], right, left)):
            if len(some):
                self._visit(first, some)
                self._visit(second, some)

    def _take(self, lo: int, hi: int, at: np.ndarray) -> None:
        rns, all_ids, vectors, points = self.tree
        x, q = vectors[lo:hi], self.queries[at]
        if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] < 1 << 53:
            scores = (self.points[at] @ points[lo:hi].T).astype(np.int64)  # whole numbers below 2**53 are exact
        else:
            scores = q @ x.T
        own = rns[lo:hi][None, :] == self.rns[at][:, None]
        better = ~own & (scores >= self.kth(at)[:, None])
        some = np.flatnonzero(better.any(1))
        if not len(some):
            return
        ids = np.broadcast_to(all_ids[lo:hi], scores.shape)
        scores = np.concatenate((self.scores[at[some]], np.where(better[some], scores[some], _NONE)), 1)
        ids = np.concatenate((self.ids[at[some]], np.where(better[some], ids[some], _LAST)), 1)
        best = np.lexsort((ids, ~scores))[:, : self.k]
        self.scores[at[some]] = np.take_along_axis(scores, best, 1)
        self.ids[at[some]] = np.take_along_axis(ids, best, 1)


def whole_vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v array<bigint>): floor(1024 * x) of each component; rows that are null or hold a null or non-finite component are left out.

    Scores are 64-bit integers. If components are so large that one could overflow (dimension * largest**2 >= 2**63), an error is raised.
    """
    x = F.col(embedding)
    fine = df.where(x.isNotNull() & F.col(vec_id).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf"))))
    most = fine.agg(F.max(F.array_max(F.transform(x, lambda e: F.abs(e.cast("double"))))), F.max(F.size(x))).first()
    if most[1] and (1024 * (most[0] or 0.0) + 1) ** 2 * most[1] >= 2.0**63:
        raise OverflowError(f"components of up to {most[0]} in {most[1]} dimensions have scores beyond 64 bits")
    return fine.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * 1024).cast("bigint")).alias("v"))


def _near_pivots(rows: DataFrame) -> DataFrame:
    """Adds ``pivot``: the nearest of PIVOTS rows, those with the smallest hash."""
    # at most PIVOTS vectors come to the driver
    some = rows.where(F.size("v") > 0).orderBy(F.xxhash64("v", "vec_id"), "vec_id").limit(PIVOTS).select("v").collect()
    pivots: dict[int, np.ndarray] = {}
    for r in some:
        pivots[len(r.v)] = np.concatenate((pivots.get(len(r.v), np.zeros((0, len(r.v)))), [r.v]))

    @F.arrow_udf("int")
    def nearest(vectors: pa.Array) -> pa.Array:
        size = np.diff(vectors.offsets.to_numpy())
        flat, start = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1]
        out = np.zeros(len(vectors), np.int32)
        for dim, p in pivots.items():
            at = np.flatnonzero(size == dim)
            x = flat[start[at][:, None] + np.arange(dim)].astype(np.float64)
            out[at] = ((p**2).sum(1) - 2 * x @ p.T).argmin(1) if len(at) else 0
        return pa.array(out)

    return rows.withColumn("pivot", nearest(F.col("v")))


def _packed(ranked: DataFrame, number: str, size: int) -> DataFrame:
    """(dim, part, rns, ids, vs): blocks of at most ``size`` vectors of one length, in the order of ``number``."""
    part = F.call_function("div", F.col(number), F.lit(size).cast("bigint"))
    packed = ranked.groupBy(F.size("v").alias("dim"), part.alias("part")).agg(F.sort_array(F.collect_list(F.struct(F.col(number).alias("o"), "rn", "vec_id", "v"))).alias("x"))
    return packed.select("dim", "part", F.col("x.rn").alias("rns"), F.col("x.vec_id").alias("ids"), F.flatten("x.v").alias("vs"))


def _piece(b: pa.RecordBatch | pa.Table, c: str, i: int) -> np.ndarray:
    return b.column(c)[i].values.to_numpy(zero_copy_only=False)


def _with_trees(shards: DataFrame) -> DataFrame:
    """(dim, part, rns, ids, vs, centre, radius, span): each shard in the order of its tree, built once, with the tree's nodes."""

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cols: list[list] = [[] for _ in range(8)]
            for i in range(b.num_rows):
                dim, rns = b.column("dim")[i].as_py(), _piece(b, "rns", i)
                x = _piece(b, "vs", i).reshape(len(rns), dim)
                t = BallTree(x)
                own = (dim, b.column("part")[i].as_py(), rns[t.order], _piece(b, "ids", i)[t.order], x[t.order].ravel(), np.concatenate(t.centre), np.array(t.radius), np.array(t.span, np.int64).ravel())
                for c, v in zip(cols, own, strict=True):
                    c.append(v)
            types = [pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, *[pa.list_(pa.float64())] * 2, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["dim", "part", "rns", "ids", "vs", "centre", "radius", "span"])

    return shards.mapInArrow(build, "dim int, part bigint, rns array<bigint>, ids array<bigint>, vs array<bigint>, centre array<double>, radius array<double>, span array<bigint>")


def _surviving(blocks: DataFrame, shards: DataFrame, scratch: Scratch) -> DataFrame:
    """(dim, block, part): the shards whose ball may hold a better score than the kth that some query of the block has already. Only balls are sent, not vectors."""
    pack = F.call_function("div", F.col("part"), F.lit(PACK).cast("bigint"))
    ball = F.struct("part", F.expr("slice(centre, 1, dim)").alias("c"), F.col("radius")[0].alias("r"))
    packs = shards.groupBy("dim", pack.alias("pack")).agg(F.collect_list(ball).alias("x"))
    packs = scratch.table(packs.select("dim", "pack", F.col("x.part").alias("parts"), F.flatten("x.c").alias("centres"), F.col("x.r").alias("radii")))
    cells = blocks.select("dim", "block").join(packs.select("dim", "pack"), "dim")

    def prune(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = []
            for i in range(b.num_rows):
                dim, kth, parts, radii = b.column("dim")[i].as_py(), _piece(b, "kth", i), _piece(b, "parts", i), _piece(b, "radii", i)
                q = _piece(b, "vs", i).reshape(len(kth), dim).astype(np.float64)
                reach = bounds(q, np.sqrt((q**2).sum(1)), _piece(b, "centres", i).reshape(len(parts), dim), radii)
                keep = parts[(reach >= kth[:, None]).any(0)]
                found.append((np.full(len(keep), dim), np.full(len(keep), b.column("block")[i].as_py()), keep))
            cols = [np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int32)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.int64))], ["dim", "block", "part"])

    wide = cells.join(blocks.select("dim", "block", "vs", "kth"), ["dim", "block"]).join(packs, ["dim", "pack"])
    return wide.select("dim", "block", "vs", "kth", "parts", "centres", "radii").mapInArrow(prune, "dim int, block bigint, part bigint")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` largest inner products of each row where ``is_query`` holds with all other rows.

    ``vectors``: (vec_id bigint, v array<bigint>). Ties go to the smaller vec_id. Vectors meet only vectors of their own length; empty ones have score 0 with each other.
    A vec_id on several rows is a candidate for each row, and each of them is a query of its own. An empty table gives no rows.

    Rows are put in the order of their nearest pivot and cut into shards, each with a ball tree that is built once. A block of queries first searches the shard that its middle
    query lies in. Only shards whose ball reaches above the kth score of one of the block's queries are then sent to the block's tasks, which start from those
    scores; within a task each shard's tree starts from the kth scores left by those before it.
    """
    scratch = Scratch(vectors.sparkSession)
    placed = _near_pivots(vectors.withColumn("q", F.coalesce(is_query, F.lit(False))))
    ranked = with_row_number(placed, [F.size("v"), F.col("pivot"), F.col("vec_id"), F.xxhash64("v")], "rn", scratch)
    shards = scratch.table(_with_trees(_packed(ranked, "rn", SHARD)))
    asked = with_row_number(ranked.where("q").select("rn", "vec_id", "v"), [F.col("rn")], "qn", scratch)
    blocks = scratch.table(_packed(asked, "qn", BLOCK).withColumnRenamed("part", "block"))
    middle = F.element_at("rns", F.expr("cast(size(rns) div 2 + 1 as int)"))
    home = blocks.select("dim", "block", F.call_function("div", middle, F.lit(SHARD).cast("bigint")).alias("part"))
    fields = ["rns", "ids", "vs", "centre", "radius", "span"]

    def search(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("is_query", "descending"), ("part", "ascending")])
        dim, rns, ids = rows.column("dim")[0].as_py(), _piece(rows, "rns", 0), _piece(rows, "ids", 0)
        floor = _piece(rows, "kth", 0) if rows.column("kth")[0].is_valid else np.full(len(ids), _NONE)
        s = Search(rns, _piece(rows, "vs", 0).reshape(len(rns), dim), k, floor)
        for i in range(1, rows.num_rows):
            own, radius = _piece(rows, "rns", i), _piece(rows, "radius", i)
            s.run(own, _piece(rows, "ids", i), _piece(rows, "vs", i).reshape(len(own), dim), _piece(rows, "centre", i).reshape(len(radius), dim), radius, _piece(rows, "span", i).reshape(-1, 4))
        found = s.ids < _LAST
        spread = lambda x: np.repeat(x, found.sum(1))
        return pa.table({"rn": spread(rns), "query_id": spread(ids), "vec_id": s.ids[found], "score": s.scores[found]})

    def run(cells: DataFrame, asked: DataFrame) -> DataFrame:
        cells = cells.withColumn("grp", F.call_function("div", F.col("part"), F.lit(GROUP).cast("bigint")))
        null = lambda c, t: F.lit(None).cast(f"array<{t}>").alias(c)
        left = cells.select("dim", "block", "grp").distinct().join(asked, ["dim", "block"])
        left = left.select("dim", "block", "grp", F.lit(1).alias("is_query"), F.lit(-1).cast("bigint").alias("part"), "rns", "ids", "vs", null("centre", "double"), null("radius", "double"), null("span", "bigint"), "kth")
        right = cells.join(shards, ["dim", "part"]).select("dim", "block", "grp", F.lit(0).alias("is_query"), "part", *fields, null("kth", "bigint"))
        return left.unionByName(right).groupBy("dim", "block", "grp").applyInArrow(search, "rn bigint, query_id bigint, vec_id bigint, score bigint")

    at_home = scratch.table(run(home, blocks.withColumn("kth", F.lit(None).cast("array<bigint>"))))
    # a query that has found fewer than k starts from nothing
    floors = at_home.groupBy("rn").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    flat = blocks.select("dim", "block", F.posexplode("rns").alias("i", "rn")).join(floors, "rn", "left")
    kths = flat.groupBy("dim", "block").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("floor", F.lit(-(1 << 63)).cast("bigint")).alias("f")))).alias("x")).select("dim", "block", F.col("x.f").alias("kth"))
    floored = scratch.table(blocks.join(kths, ["dim", "block"]))
    others = scratch.table(_surviving(floored, shards, scratch).join(home, ["dim", "block", "part"], "left_anti"))
    rest = run(others, floored)
    best = Window.partitionBy("rn").orderBy(F.desc("score"), "vec_id")
    every = at_home.unionByName(rest).withColumn("rank", F.row_number().over(best))
    return every.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame, k: int = 10) -> DataFrame:
    """The top ``k`` of every row whose vec_id is divisible by 100, among all other rows."""
    return top_k(whole_vectors(embeddings, "vec_id", "embedding"), F.col("vec_id") % 100 == 0, k)
