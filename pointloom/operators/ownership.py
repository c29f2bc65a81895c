"""Cells that several tiles hold: main tile, shares, numbers and exchange.

``cells`` has cell_id and an array ``owners``: the tile of each corner. A cell belongs to all tiles of its corners; the least is its main tile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.numbering import offsets


def owned(cells: DataFrame) -> DataFrame:
    """Adds ``main_id`` and ``kind``: local if all corners are of one tile, else mixed."""
    return cells.withColumn("main_id", F.array_min("owners")).withColumn("kind", F.when(F.size(F.array_distinct("owners")) == 1, "local").otherwise("mixed"))


def held(cells: DataFrame) -> DataFrame:
    """(cell_id, main_id, owner and the other columns): a row for each tile that holds a cell."""
    rest = [c for c in cells.columns if c not in ("cell_id", "owners")]
    return cells.select("cell_id", F.array_min("owners").alias("main_id"), F.explode(F.array_distinct("owners")).alias("owner"), *rest)


def shared(cells: DataFrame) -> DataFrame:
    """(cell_id, tile_k, tile_l): every ordered pair of different tiles that hold a cell; made from each row alone, without a join."""
    tiles = F.array_distinct("owners")
    return cells.select("cell_id", tiles.alias("t"), F.explode(tiles).alias("tile_k")).select("cell_id", "tile_k", F.explode(F.array_remove("t", F.col("tile_k"))).alias("tile_l"))


def counts(cells: DataFrame) -> DataFrame:
    """(tile_id, n_cells, n_main): how many cells each tile holds, and of how many it is the main tile."""
    return held(cells).groupBy(F.col("owner").alias("tile_id")).agg(F.count("*").alias("n_cells"), F.count_if(F.col("owner") == F.col("main_id")).alias("n_main"))


def local_ids(cells: DataFrame) -> DataFrame:
    """(tile_id, cell_id, lid): each tile's cells numbered from 0, those it is the main tile of first, then by id. A tile, which the tiling bounds, is sorted in one task."""
    w = Window.partitionBy("owner").orderBy((F.col("owner") != F.col("main_id")).cast("int"), "cell_id")
    return held(cells).select(F.col("owner").alias("tile_id"), "cell_id", (F.row_number().over(w) - 1).cast("bigint").alias("lid"))


def global_ids(cells: DataFrame) -> DataFrame:
    """(cell_id, tile_id, gid): the number of each cell in its main tile plus that tile's offset, so numbers are gapless from 0."""
    main = cells.select(F.array_min("owners").alias("tile_id"), "cell_id")
    base = offsets(main.groupBy("tile_id").agg(F.count("*").alias("n")), "tile_id", "n")
    lid = F.row_number().over(Window.partitionBy("tile_id").orderBy("cell_id")) - 1
    return main.withColumn("lid", lid).join(base, "tile_id").select("cell_id", "tile_id", (F.col("n_offset") + F.col("lid")).cast("bigint").alias("gid"))


def sent_masses(cells: DataFrame) -> DataFrame:
    """(dst, src, cell_id, mass): the main tile's ``mass`` of each mixed cell for each other tile that holds it."""
    return held(cells).where("owner <> main_id").select(F.col("owner").alias("dst"), F.col("main_id").alias("src"), "cell_id", "mass")


def received_masses(own: DataFrame, sent: DataFrame) -> DataFrame:
    """``own`` (tile_id, cell_id, mass) with the masses that the main tile sent in the place of a tile's own."""
    got = sent.select(F.col("dst").alias("tile_id"), "cell_id", F.col("mass").alias("_sent"))
    return own.join(got, ["tile_id", "cell_id"], "left").withColumn("mass", F.coalesce("_sent", "mass")).drop("_sent")


def local_id_map(cells: DataFrame) -> DataFrame:
    """(cell_id, tile_k, lid_k, tile_l, lid_l): for every ordered pair of tiles that share a cell, its number in both."""
    ids = local_ids(cells)
    side = lambda t, n: ids.select("cell_id", F.col("tile_id").alias(t), F.col("lid").alias(n))
    return shared(cells).join(side("tile_k", "lid_k"), ["cell_id", "tile_k"]).join(side("tile_l", "lid_l"), ["cell_id", "tile_l"]).select("cell_id", "tile_k", "lid_k", "tile_l", "lid_l")


def filled_labels(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(tile_id, lid, label): labels by global number (gid, label) handed to every tile that holds the cell."""
    return local_ids(cells).join(global_ids(cells).select("cell_id", "gid"), "cell_id").join(labels, "gid").select("tile_id", "lid", "label")


def disagreement(labels: DataFrame) -> DataFrame:
    """(tile_id, differing, total): over ``labels`` (cell_id, tile_id, label), how often another tile has a cell of this tile, and another label for it.

    The at most four labels of a cell meet in one row, so pairs need no join.
    """
    all_ = labels.groupBy("cell_id").agg(F.collect_list(F.struct("tile_id", "label")).alias("x"))
    one = all_.select("x", F.explode("x").alias("a"))
    other = one.select(F.col("a.tile_id").alias("tile_id"), F.filter("x", lambda b: b["tile_id"] != F.col("a.tile_id")).alias("o"), F.col("a.label").alias("label"))
    return other.where("size(o) > 0").groupBy("tile_id").agg(F.sum(F.size(F.filter("o", lambda b: b["label"] != F.col("label")))).cast("bigint").alias("differing"), F.sum(F.size("o")).cast("bigint").alias("total"))


def weighted_disagreement(labels: DataFrame, reference: DataFrame, volumes: DataFrame) -> DataFrame:
    """One row (differing, total, weighted): cells (cell_id, label) whose label isn't the one of ``reference``, all cells, and the sum of ln(1 + volume) over the former."""
    both = labels.join(reference.select("cell_id", F.col("label").alias("_r")), "cell_id").join(volumes.select("cell_id", "volume"), "cell_id")
    off = F.col("label") != F.col("_r")
    return both.agg(F.count_if(off).alias("differing"), F.count("*").alias("total"), F.coalesce(F.sum(F.when(off, F.log1p("volume"))), F.lit(0.0)).alias("weighted"))
