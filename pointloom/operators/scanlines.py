"""Scanlines of a moving scanner: cutting the sequence of points, lines of sight and preprocessed clouds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of the step from a point towards its scanner, in metres; share of the cloud's diagonal that forces a cut; scanner's default height over a point. Fixed values.
SENSOR_STEP, GAP_SHARE, DEFAULT_HEIGHT = 200.0, 0.05, 30.0


def gap_limit(box: dict[str, float]) -> float:
    """The squared gap at which a scanline is cut: 5 % of the diagonal of the cloud's box."""
    return GAP_SHARE**2 * sum((box[f"{a}max"] - box[f"{a}min"]) ** 2 for a in "xyz")


def segments(points: DataFrame, order: list[Column], gap2: float, turn: float | None = None, within: str | None = None) -> DataFrame:
    """Adds ``segment``, counted from 1: ``points`` (line, x, y, z; angle with ``turn``) in ``order`` are cut where the line's id changes, where the squared distance to the point before
    is over ``gap2``, and, with ``turn``, where the scan angle changes its direction by more than so many degrees (a mirror that swings back).

    ``within``: a column that parts the points into independent sequences (a file, a flight strip), whose points one task sorts; numbers start anew in each.
    """
    w = Window.partitionBy(*([within] if within else [])).orderBy(*order)
    before = {c: F.lag(c).over(w) for c in ("line", "x", "y", "z")}
    gap = sum(((F.col(a) - before[a]) * (F.col(a) - before[a]) for a in "xyz"), F.lit(0.0))
    cut = before["line"].isNull() | (F.col("line") != before["line"]) | (gap > gap2)
    if turn is not None:
        step, last = F.col("angle") - F.lag("angle").over(w), F.lag("angle").over(w) - F.lag("angle", 2).over(w)
        cut |= F.coalesce((step * last < 0) & (F.abs(step) > turn), F.lit(False))
    t = points.withColumn("_cut", F.coalesce(cut, F.lit(True)).cast("int"))
    return t.withColumn("segment", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_cut")


def base(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(direction, vertical) of a scanline: the level direction of its least-squares line, and the direction at right angles to it in its least-squares plane, pointing up.

    If the latter leans more than 30 degrees from the vertical (or can't be told), the direction from the first point to the last and (0, 0, 1).
    """
    up = np.array([0.0, 0.0, 1.0])
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=True)
    level = np.array([axes[0][0], axes[0][1], 0.0])
    if (n := np.linalg.norm(level)) > 0:
        level /= n
        vertical = np.cross(level, axes[2])
        if (n := np.linalg.norm(vertical)) > 0:
            vertical = vertical / n * (1 if vertical[2] >= 0 else -1)
            if np.arccos(min(1.0, vertical[2])) < np.pi / 6:
                return level, vertical
    along = np.array([*(x[-1] - x[0])[:2], 0.0])
    return along / max(np.linalg.norm(along), 1e-300), up


def scanner_position(x: np.ndarray, sight: np.ndarray) -> np.ndarray | None:
    """The point nearest to all lines through ``x`` along ``sight`` (unit vectors) by least squares; None if they are parallel."""
    m = np.eye(3)[None] - sight[:, :, None] * sight[:, None, :]
    total = m.sum(0)
    if not np.isfinite(total).all() or np.linalg.cond(total) > 1e12:
        return None
    return np.linalg.solve(total, np.einsum("nij,nj->i", m, x))


def sights(x: np.ndarray, angle: np.ndarray | None) -> np.ndarray:
    """Directions from a scanline's points to its scanner.

    With scan angles (degrees): direction * sin + vertical * cos, a third of unit length; the direction is turned round if the lines meet nowhere or below the mean height.
    Without: towards the place over the mean point, at the greatest height plus twice the line's length.
    """
    if angle is None:
        length = float(np.linalg.norm(x[-1] - x[0]))
        return np.array([x[:, 0].mean(), x[:, 1].mean(), x[:, 2].max() + 2 * length]) - x
    level, vertical = base(x)
    t = np.radians(angle)[:, None]
    out = level * np.sin(t) + vertical * np.cos(t)
    place = scanner_position(x, out)
    if place is None or place[2] < x[:, 2].mean():
        out = -level * np.sin(t) + vertical * np.cos(t)
    return out / 3


def lines_of_sight(points: DataFrame, key: list[str], order: str, with_angle: bool = True) -> DataFrame:
    """Adds lx, ly, lz (see ``sights``) to ``points`` (x, y, z, angle), whose scanlines are the groups of ``key``, in the order of ``order``. A task holds one scanline, which the cuts bound."""
    names = points.columns

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        x = np.stack([t.column(a).to_numpy() for a in "xyz"], 1)
        angle = t.column("angle").to_numpy().astype(float) if with_angle else None
        if angle is not None and np.isnan(angle).any():
            angle = None
        los = sights(x, angle)
        for k, a in enumerate("xyz"):
            t = t.append_column(f"l{a}", pa.array(np.ascontiguousarray(los[:, k])))
        return t

    schema = ", ".join(f"`{c}` {k}" for c, k in points.dtypes) + ", lx double, ly double, lz double"
    return points.groupBy(*key).applyInArrow(one, schema).select(*names, "lx", "ly", "lz")


def fallback_sights(points: DataFrame, key: list[str]) -> DataFrame:
    """Adds lx, ly, lz towards a scanner over each group's mean point, at its greatest height plus twice its extent in x; sums and a join, no sort."""
    s = points.groupBy(*key).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"), (F.max("z") + 2 * (F.max("x") - F.min("x"))).alias("_mz"))
    t = points.join(s, key)
    return t.select(*points.columns, (F.col("_mx") - F.col("x")).alias("lx"), (F.col("_my") - F.col("y")).alias("ly"), (F.col("_mz") - F.col("z")).alias("lz"))


def with_sensor(points: DataFrame, low: dict[str, float], step: float = SENSOR_STEP) -> DataFrame:
    """Points moved to the origin ``low`` (least x, y, z) and x_origin, y_origin, z_origin, the place ``step`` times the line of sight away."""
    moved = {f"{a}_origin": F.col(a) + F.col(f"l{a}") * step - low[a] for a in "xyz"}
    return points.select(*[(F.col(a) - low[a]).alias(a) if a in ("x", "y", "z") else F.col(a) for a in points.columns], *[c.alias(n) for n, c in moved.items()])


def default_sensor(points: DataFrame, height: float = DEFAULT_HEIGHT) -> DataFrame:
    """Sensor places where they are null or absent: ``height`` above the point."""
    here = {"x_origin": F.col("x"), "y_origin": F.col("y"), "z_origin": F.col("z") + height}
    return points.withColumns({n: F.coalesce(F.col(n), c) if n in points.columns else c for n, c in here.items()})


def preprocessed(points: DataFrame, box: dict[str, float], order: list[str], within: str, with_angle: bool = True) -> DataFrame:
    """Raw points (line, x, y, z, angle) of ``within`` (a file): cut into scanlines, given lines of sight as normals nx, ny, nz and sensor places, moved to the box's lower corner."""
    t = segments(points, [F.col(c) for c in order], gap_limit(box), within=within)
    t = lines_of_sight(t, [within, "segment"], order[0], with_angle)
    t = with_sensor(t, {a: box[f"{a}min"] for a in "xyz"})
    return t.withColumnsRenamed({f"l{a}": f"n{a}" for a in "xyz"})
