"""Column functions of belief masses: empty (e), occupied (o) and unknown (u), which add up to 1.

A mass is a struct with the fields e, o, u.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def mass(e: Column, o: Column, u: Column) -> Column:
    return F.struct(e.cast("double").alias("e"), o.cast("double").alias("o"), u.cast("double").alias("u"))


#: Nothing is known.
def unknown() -> Column:
    return mass(F.lit(0.0), F.lit(0.0), F.lit(1.0))


def _once(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def regularised(m: Column) -> Column:
    """e and o within [0, 1], u what is left of 1 (0 at least), all divided by their sum."""
    clamp = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    first = F.struct(clamp(m["e"]).alias("e"), clamp(m["o"]).alias("o"))

    def rest(x: Column) -> Column:
        u = F.greatest(1 - x["e"] - x["o"], F.lit(0.0))
        n = x["e"] + x["o"] + u
        return mass(x["e"] / n, x["o"] / n, u / n)

    return _once(first, rest)


def combined(a: Column, b: Column) -> Column:
    """Two masses by Dempster's rule, conflict shared out; nothing is known if they contradict each other wholly."""
    k = a["o"] * b["e"] + a["e"] * b["o"]
    n = F.when(k < 1, 1 - k)
    e = (a["e"] * b["e"] + a["e"] * b["u"] + a["u"] * b["e"]) / n
    o = (a["o"] * b["o"] + a["o"] * b["u"] + a["u"] * b["o"]) / n
    return F.coalesce(F.when(n.isNotNull(), mass(e, o, a["u"] * b["u"] / n)), unknown())


def fused(masses: Column) -> Column:
    """An array of masses folded in its order, from nothing known, regularised after each step."""
    return F.aggregate(masses, unknown(), lambda a, m: _once(combined(a, m), regularised))


def score_pdf(a: Column, s: Column) -> Column:
    return F.exp(-(a / s) * (a / s))


def m_estimator(a: float, t: Column) -> Column:
    return (F.pow(1 + t, F.lit(a)) - 1) / a


def dm_estimator(a: float, t: Column) -> Column:
    return F.pow(1 + t, F.lit(a - 1))


def m_pdf(a: float, t: Column) -> Column:
    return F.exp(-0.5 * m_estimator(a, t))


def confidence(scales: Sequence[Column], least: float | None) -> Column:
    """1, or with a least scale that scale over the largest of ``scales``, from 1e-6 to 1."""
    if least is None or least < 0:
        return F.lit(1.0)
    return F.greatest(F.least(F.lit(float(least)) / F.greatest(*scales), F.lit(1.0)), F.lit(1e-6))


def smoothing(scales: Sequence[Column], overall: float = -1.0) -> Column:
    """How far from the surface evidence reaches: three times an overall scale if there is one, else the largest scale."""
    return F.lit(3.0 * overall) if overall > 0 else F.greatest(*scales)


def surface_mass(coefficients: Sequence[Column], scales: Sequence[Column], reach: Column, trust: Column) -> Column:
    """The mass that a point of a surface gives to a place: ``coefficients`` of the place along the point's axes (the last is the normal, towards the sensor).

    Before the surface it is empty, behind it occupied, with less than half the other way within the last scale. It fades along the other axes and beyond ``reach``.
    """
    c, s = coefficients[-1], F.when(scales[-1] > 0, scales[-1]).otherwise(F.lit(1e-6))
    half = F.exp(-F.abs(c) / s) / 2
    e = F.when(c > 0, 1 - half).when(c < 0, half).otherwise(F.lit(0.5))
    o = F.when(c > 0, half).when(c < 0, 1 - half).otherwise(F.lit(0.5))
    fade = score_pdf(c, reach) * trust
    for k, t in zip(coefficients[:-1], scales[:-1], strict=True):
        fade = fade * F.when(t > 0, score_pdf(k, t)).otherwise(F.lit(0.0))
    return _once(F.struct(e.alias("e"), o.alias("o"), fade.alias("f")), lambda x: regularised(mass(x["e"] * x["f"], x["o"] * x["f"], 1 - x["e"] * x["f"] - x["o"] * x["f"])))


def beam_mass(c: Column, s: Column) -> Column:
    """The mass that a beam gives in front of the point it hit, at distance ``c``: empty, the farther the surer."""
    e = F.when(c > 0, 1 - F.exp(-c / (2 * s))).otherwise(F.lit(0.0))
    return _once(e, lambda v: mass(v, F.lit(0.0), 1 - v))


#: What the cell of a sensor is fused with: it is empty there, almost nothing sure.
SENSOR = (0.05, 0.0, 0.95)


def label_cost(m: Column, label: int) -> Column:
    """The cost of a label: the differences to the mass that is sure of it. Label 1 is empty, 0 is occupied."""
    sure = {1: (1.0, 0.0), 0: (0.0, 1.0)}[label]
    return F.abs(F.lit(sure[0]) - m["e"]) + F.abs(F.lit(sure[1]) - m["o"]) + F.abs(m["u"])
