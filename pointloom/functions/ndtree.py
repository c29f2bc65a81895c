"""Column functions for regular grids and the nested cells above them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def axis_bin(v: Column, low: Column, high: Column, n: int) -> Column:
    """The bin of ``v`` among ``n`` equal ones from ``low`` to ``high``; the upper end belongs to the last bin, an axis without extent to bin 0."""
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    return F.least(F.floor((v - low) * n / span), F.lit(n - 1)).cast("bigint")


def cell_id(bins: list[Column], n: int) -> Column:
    """Row-major id of a cell, the first axis counting most."""
    out = bins[0]
    for b in bins[1:]:
        out = out * n + b
    return out


def cell_bins(cell: Column, n: int, dim: int) -> list[Column]:
    """The bins of a cell id, the inverse of ``cell_id``."""
    return [F.call_function("div", cell, F.lit(n ** (dim - 1 - k)).cast("bigint")) % n for k in range(dim)]


def ancestor(cell: Column, n: int, dim: int, up: int) -> Column:
    """The id, on its own level, of the cell ``up`` levels above; each level has half the bins per axis."""
    bins = [F.call_function("div", b, F.lit(1 << up).cast("bigint")) for b in cell_bins(cell, n, dim)]
    return cell_id(bins, max(1, n >> up))
