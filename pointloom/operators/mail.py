"""Messages between tiles and neighbourhoods in a graph of tiles, as joins and sums.

``edges``: (src, dst, attributes); ``vertices``: (id, attributes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delivered(edges: DataFrame) -> DataFrame:
    """Edges as rows of the tile they go to."""
    return edges.withColumnRenamed("dst", "tile_id")


def retained(edges: DataFrame) -> DataFrame:
    """Edges as rows of the tile they come from."""
    return edges.withColumnRenamed("src", "tile_id")


def with_mail(state: DataFrame, mail: DataFrame, *totals: Column) -> DataFrame:
    """``state`` (tile_id, ...) with ``totals`` over its ``mail`` (tile_id, ...); tiles without mail stay. Mail is summed up before it meets the state, so a tile has one row to meet."""
    return state.join(mail.groupBy("tile_id").agg(*totals), "tile_id", "left")


def having_mail(state: DataFrame, mail: DataFrame) -> DataFrame:
    return state.join(mail.select("tile_id"), "tile_id", "left_semi")


def without_mail(state: DataFrame, mail: DataFrame) -> DataFrame:
    return state.join(mail.select("tile_id"), "tile_id", "left_anti")


def triplets(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the attributes of both ends, as src_<c> and dst_<c>."""
    side = lambda end: vertices.select(*[F.col(c).alias(end if c == "id" else f"{end}_{c}") for c in vertices.columns])
    return edges.join(side("src"), "src").join(side("dst"), "dst")


def joined_vertices(vertices: DataFrame, messages: DataFrame, update: dict[str, Column]) -> DataFrame:
    """``vertices`` with ``messages`` (id, ...) joined to them and the columns of ``update`` set; vertices without message have nulls there."""
    return vertices.join(messages, "id", "left").withColumns(update).select(*vertices.columns, *[c for c in update if c not in vertices.columns])


def canonical(edges: DataFrame) -> DataFrame:
    """Different edges with the lesser end first, without loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def ways(edges: DataFrame) -> DataFrame:
    """(v, u): each edge from both ends, in one pass over the edges."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("u")), F.struct(F.col("dst").alias("v"), F.col("src").alias("u")))).alias("w")).select("w.*")


def aggregated(edges: DataFrame, to: str, *totals: Column) -> DataFrame:
    """``totals`` over the edges of each vertex: ``to`` is src, dst or both (then u is the other end)."""
    rows = ways(edges).withColumnRenamed("v", "id") if to == "both" else edges.withColumnRenamed(to, "id")
    return rows.groupBy("id").agg(*totals)


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, neighbours): the sorted list of each vertex's neighbours."""
    return aggregated(edges, "both", F.sort_array(F.collect_set("u")).alias("neighbours"))


def grouped_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): all values of each key, sorted, repeats included."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))


def clique_edges(edges: DataFrame) -> DataFrame:
    """(v, src, dst): the edges not at v that have an end among v's neighbours, each once. Two equi-joins, one for each end."""
    w = ways(edges)
    by = [w.join(edges.withColumn("u", F.col(end)), "u") for end in ("src", "dst")]
    return by[0].unionByName(by[1]).where("src <> v and dst <> v").select("v", "src", "dst").distinct()


def unsent(messages: DataFrame, sent: DataFrame) -> DataFrame:
    """Different messages that aren't among those sent before; nulls are equal to each other."""
    m, s = messages.distinct().alias("m"), sent.select(*messages.columns).distinct().alias("s")
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}")) for c in messages.columns]
    on = same[0]
    for c in same[1:]:
        on &= c
    return m.join(s, on, "left_anti")


def box_pairs(boxes: DataFrame, edge: float, axes: str = "xy") -> DataFrame:
    """(a, b): pairs of ``boxes`` (id, and the least and greatest of each axis as xmin, xmax ...) that have a point in common, a below b.

    Each box is put into the cells of a grid of width ``edge`` that it touches, pairs meet by cell, and a pair that shares several cells counts in the first they share. Boxes
    much wider than ``edge`` touch many cells, so ``edge`` should be about the width of most.
    """
    at = lambda v: F.floor(v / edge).cast("bigint")
    t = boxes.select(F.col("id").alias("id"), *[F.col(f"{a}{e}") for a in axes for e in ("min", "max")])
    for a in axes:
        t = t.withColumn(f"c{a}", F.explode(F.sequence(at(F.col(f"{a}min")), at(F.col(f"{a}max")))))
    p, q = t.alias("p"), t.alias("q")
    on = F.col("p.id") < F.col("q.id")
    for a in axes:
        on &= F.col(f"p.c{a}") == F.col(f"q.c{a}")
        on &= (F.col(f"p.{a}min") <= F.col(f"q.{a}max")) & (F.col(f"q.{a}min") <= F.col(f"p.{a}max"))
        # the first cell that both touch
        on &= F.col(f"p.c{a}") == at(F.greatest(F.col(f"p.{a}min"), F.col(f"q.{a}min")))
    return p.join(q, on).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))
