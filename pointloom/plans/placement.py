"""Where rows lie and what is kept: partitions by key, storage levels, sections of a run."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of storage levels as parameters have them.
LEVELS = {n: getattr(StorageLevel, n) for n in ("DISK_ONLY", "MEMORY_ONLY", "MEMORY_AND_DISK", "OFF_HEAP", "DISK_ONLY_2", "MEMORY_ONLY_2", "MEMORY_AND_DISK_2", "NONE")}


def by_key(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of a key in one of ``n`` partitions, for joins and groupings by the same key that need no shuffle of their own."""
    return df.repartition(n, key)


def spread(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def fewer(df: DataFrame, n: int) -> DataFrame:
    return df.coalesce(n)


def edges_by_source(edges: DataFrame, n: int) -> DataFrame:
    """All edges of a source in one partition."""
    return edges.repartition(n, "src")


def kept(df: DataFrame, level: str = "DISK_ONLY") -> DataFrame:
    """``df`` kept at a storage level that a parameter names; NONE keeps nothing."""
    if level not in LEVELS:
        raise ValueError(f"unknown storage level {level}")
    return df if level == "NONE" else df.persist(LEVELS[level])


def random_tiles(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Adds tile_id, a hash of the row below ``n``: the same in every run."""
    return df.withColumn("tile_id", F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(n)).cast("bigint"))


def one_tile(df: DataFrame, tile: int = 0) -> DataFrame:
    return df.withColumn("tile_id", F.lit(tile).cast("bigint"))


class Sections:
    """Wall-clock seconds of the named sections of a run, added up by name."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def section(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def lines(self) -> list[str]:
        return ["label,seconds", *(f"{n},{s:.3f}" for n, s in self.seconds.items())]
