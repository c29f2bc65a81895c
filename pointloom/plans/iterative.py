"""Queries that loop or run a kernel inside tiles: neighbours, Delaunay cells, belief propagation and cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import ndtree
from pointloom.operators import belief, cuts, delaunay, neighbours, tiling
from pointloom.plans.oracles import SQL
from pointloom.sources.tables import points, table

DEPTH = 3


def vector_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three components of each vector, as whole numbers, so that distances are exact."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").cast("bigint").alias("id"), *[F.floor(F.get("embedding", i).cast("double") * 1024).cast("double").alias(a) for i, a in enumerate("xyz")])


def knn_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(vector_cloud(spark, sf_dir), 5, 128.0).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "d2")


def eigen_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.local_shape(vector_cloud(spark, sf_dir), 256.0)


def delaunay_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delaunay cells over the balanced tiles of the vector cloud."""
    tiles = tiling.balanced_points(vector_cloud(spark, sf_dir), DEPTH, 400)
    return delaunay.delaunay_cells(tiles.withColumnRenamed("leaf_id", "tile_id"))


def voronoi_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delaunay.dual_edges(delaunay_distributed(spark, sf_dir))


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), "n_regionkey")
    p = (1 + F.col("id") % 7) * F.lit(0.1)
    m = n.select(F.col("id").alias("dst"), "n_regionkey")
    edges = n.withColumnRenamed("id", "src").join(m, "n_regionkey").where("src < dst").select("src", "dst")
    return n.select("id", F.array(p, 1 - p).alias("prior")), edges


_FACTOR = [0.7, 0.3, 0.3, 0.7]


def _beliefs(df: DataFrame) -> DataFrame:
    return df.select("id", F.round(F.col("belief")[0], 5).alias("p0"), F.round(F.col("belief")[1], 5).alias("p1"))


def _pairwise(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    prior, edges = _nations(spark, sf_dir)
    return _beliefs(belief.pairwise(prior, edges.withColumn("factor", F.array(*map(F.lit, _FACTOR))), 2, **how))


def _factor_graph(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    prior, edges = _nations(spark, sf_dir)
    factors = edges.select((F.col("src") * 1000 + F.col("dst")).alias("id"), F.array("src", "dst").alias("vars"), F.array(F.lit(2), F.lit(2)).alias("cards"), F.array(*map(F.lit, _FACTOR)).alias("values"))
    return _beliefs(belief.factor_graph(prior, factors, **how))


def bp_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs once they no longer move."""
    return _pairwise(spark, sf_dir, rounds=60, eps=1e-7)


def bp_factor_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _factor_graph(spark, sf_dir, rounds=60, eps=1e-7)


def bp_pairwise_iter3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairwise(spark, sf_dir, rounds=3, eps=0.0)


def bp_factor_graph_iter3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _factor_graph(spark, sf_dir, rounds=3, eps=0.0)


def _voxels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cells and facets of the cloud's grid for the cuts: a tile is an octant with the cells that touch it; full cells have points above the mean."""
    n = 1 << DEPTH
    cell = F.col("cell")
    counts = tiling.grid_cells(points(spark, sf_dir), DEPTH).groupBy("cell").agg(F.count("*").cast("double").alias("n"))
    every = spark.range(n**3).select(F.col("id").alias("cell")).join(counts, "cell", "left").fillna(0.0, ["n"])
    mean = every.agg(F.avg("n").alias("mean"))
    # one row
    costs = every.crossJoin(F.broadcast(mean)).select("cell", (F.col("n") / F.greatest("mean", F.lit(1.0))).alias("cost1"), F.lit(1.0).alias("cost0"))
    grid, steps = spark.range(n**3).select(F.col("id").alias("cell")), (n * n, n, 1)
    bins = ndtree.cell_bins(cell, n, 3)
    walls = grid.select("cell", F.explode(F.array(*[F.when(bins[i] < n - 1, cell + s) for i, s in enumerate(steps)])).alias("b")).where("b is not null")
    octant = lambda c: ndtree.ancestor(F.col(c), n, 3, DEPTH - 1)
    sides = walls.select(F.explode(F.array_distinct(F.array(octant("cell"), octant("b")))).alias("tile_id"), F.col("cell").alias("a"), "b", F.lit(0.4).alias("weight"))
    held = sides.select("tile_id", F.explode(F.array("a", "b")).alias("cell")).distinct()
    return held.join(costs, "cell").select("tile_id", F.col("cell").alias("cell_id"), "cost0", "cost1"), sides


def maxflow_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts.tile_labels(*_voxels(spark, sf_dir))


def lagrange_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that the tiles agree on after 30 rounds at most, and how many shared cells are still in dispute."""
    labels, open_ = cuts.agreed_labels(*_voxels(spark, sf_dir), step=0.5)
    return labels.withColumn("in_dispute", F.lit(open_).cast("bigint"))


QUERIES = {f.__name__: f for f in (knn_vectors, eigen_entropy, delaunay_distributed, voronoi_edges, bp_pairwise, bp_factor_graph, bp_pairwise_iter3, bp_factor_graph_iter3, maxflow_labels, lagrange_cut)}

_BP = f"select id, round(p0 / (p0 + p1), 5) p0, round(p1 / (p0 + p1), 5) p1 from ({SQL['bp_two_state_iter3']}) t"
#: The fixed point by recursion: each row of a round is made from the last round's rows alone.
_BP_LIMIT = f"""
    with recursive e as (select a.n_nationkey src, b.n_nationkey dst from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey),
    p as (select n_nationkey id, (1 + n_nationkey % 7) * 1e-1 p0, 1 - (1 + n_nationkey % 7) * 1e-1 p1 from nation),
    m as (select 0 turn, src, dst, 5e-1 a from e
      union all
      select turn + 1, src, dst, x / (x + y) from (
        select turn, src, dst, 7e-1 * u + 3e-1 * v x, 3e-1 * u + 7e-1 * v y from (
          select f.turn, f.src, f.dst, p.p0 * exp(sum(case when g.src <> f.dst then ln(g.a) else 0 end)) u, p.p1 * exp(sum(case when g.src <> f.dst then ln(1 - g.a) else 0 end)) v
          from m f join m g on g.dst = f.src join p on p.id = f.src where f.turn < 60 group by f.turn, f.src, f.dst, p.p0, p.p1)))
    select cast(id as bigint) id, round(u / (u + v), 5) p0, round(v / (u + v), 5) p1 from (
      select id, p0 * exp(coalesce(sum(ln(a)), 0)) u, p1 * exp(coalesce(sum(ln(1 - a)), 0)) v from p left join (select * from m where turn = 60) on dst = id group by id, p0, p1)"""
ORACLE_SQL = {
    "knn_vectors": """
        with p as (select vec_id id, floor(1024 * cast(embedding[1] as double)) x, floor(1024 * cast(embedding[2] as double)) y, floor(1024 * cast(embedding[3] as double)) z from embeddings),
        d as (select a.id query_id, b.id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) d2 from p a join p b on a.id <> b.id),
        r as (select *, row_number() over (partition by query_id order by d2, id) "rank" from d)
        select cast(query_id as bigint) query_id, cast("rank" as int) "rank", cast(id as bigint) id, d2 from r where "rank" <= 5""",
    "bp_pairwise_iter3": _BP,
    "bp_factor_graph_iter3": _BP,
    # fifty rounds of the plain form are as good as its limit
    "bp_pairwise": _BP_LIMIT,
    "bp_factor_graph": _BP_LIMIT,
}
