"""Named queries over the test tables and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators import tiling
from pointloom.plans import cloud, iterative, oracles
from pointloom.sources.tables import POINTS_SQL, points

DEPTH, LIMIT = 3, 2000


def bbox_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.bbox(points(spark, sf_dir), "src")


def bbox_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.bbox(points(spark, sf_dir))


def grid_tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.grid_cells(points(spark, sf_dir), DEPTH).groupBy("cell").agg(F.count("*").alias("n"))


def octree_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.balance(grid_tile_counts(spark, sf_dir), DEPTH, LIMIT)


def octree_leaf_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaves(octree_balance(spark, sf_dir))


def balanced_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points each balanced tile has, and their extent."""
    tiled = tiling.balanced_points(points(spark, sf_dir), DEPTH, LIMIT)
    return tiling.bbox(tiled, "leaf_id")


_BOX = "min(x) xmin, max(x) xmax, min(y) ymin, max(y) ymax, min(z) zmin, max(z) zmax, count(*) n"
_CELLS = f"""
pts as ({POINTS_SQL}), box as (select {_BOX} from pts),
celled as (select p.*, {" + ".join(f"cast(least(floor((p.{a} - b.{a}min) * 8 / case when b.{a}max > b.{a}min then b.{a}max - b.{a}min else 1e0 end), 7) as bigint) * {m}" for a, m in (("x", 64), ("y", 8), ("z", 1)))} as cell
  from pts p cross join box b), counts as (select cell, count(*) n from celled group by cell)"""
_ANCESTOR = ["cell", "(cell // 128) * 16 + (cell // 16 % 4) * 4 + cell // 2 % 4", "(cell // 256) * 4 + (cell // 32 % 2) * 2 + cell // 4 % 2", "cast(0 as bigint)"]
_TREE = f"""{_CELLS}, totals as (select cell, n, {", ".join(f"sum(n) over (partition by {a}) t{u}" for u, a in enumerate(_ANCESTOR))} from counts),
tree as (select cell, cast(n as bigint) n, up, case up {" ".join(f"when {u} then {a}" for u, a in enumerate(_ANCESTOR))} end leaf
  from (select *, cast(case when t3 <= {LIMIT} then 3 when t2 <= {LIMIT} then 2 when t1 <= {LIMIT} then 1 else 0 end as int) up from totals))"""
_LEAVES = f"{_TREE}, leaves as (select up, leaf, cast(sum(n) as bigint) n, row_number() over (order by sum(n) desc, up, leaf) - 1 leaf_id from tree group by up, leaf)"

_DATAFRAMES = {
    bbox_per_source: f"with pts as ({POINTS_SQL}) select src, {_BOX} from pts group by src",
    bbox_global: f"with pts as ({POINTS_SQL}) select {_BOX} from pts",
    grid_tile_counts: f"with {_CELLS} select cell, n from counts",
    octree_balance: f"with {_TREE} select cell, n, up, leaf from tree",
    octree_leaf_rank: f"with {_LEAVES} select up, leaf, n, leaf_id from leaves",
    balanced_points: f"with {_LEAVES} select leaf_id, {_BOX.replace('count(*) n', 'count(*) n')} from (select c.x, c.y, c.z, l.leaf_id from celled c join tree t on c.cell = t.cell join leaves l on l.up = t.up and l.leaf = t.leaf) group by leaf_id",
}


QUERIES = {f.__name__: f for f in _DATAFRAMES} | cloud.QUERIES | iterative.QUERIES
ORACLE_SQL = {f.__name__: sql for f, sql in _DATAFRAMES.items()} | oracles.SQL | iterative.ORACLE_SQL
