"""Graph files, parameter files and GeoJSON as plain text."""

from __future__ import annotations

import itertools
import json
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path).where("trim(value) <> ''")
    return text.select(F.split(F.trim("value"), r"\s+").alias("w"))


def _doubles(at: int) -> Column:
    return F.transform(F.slice("w", at, F.size("w") - at + 1), lambda v: v.cast("double"))


def pairwise_vertices(spark: SparkSession, path: str) -> DataFrame:
    """(id, prior) from lines of an id and a number for each state."""
    return _numbers(spark, path).select(F.col("w")[0].cast("bigint").alias("id"), _doubles(2).alias("prior"))


def pairwise_edges(spark: SparkSession, path: str, states: int) -> DataFrame:
    """(src, dst, factor by rows) from lines of two ids and a table by columns; two-state edges have the same form."""
    rows = F.array(*[F.col("c")[j * states + i] for i in range(states) for j in range(states)])
    return _numbers(spark, path).select(F.col("w")[0].cast("bigint").alias("src"), F.col("w")[1].cast("bigint").alias("dst"), _doubles(3).alias("c")).select("src", "dst", rows.alias("factor"))


def flow_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cells (cell_id, cost0, cost1) from lines ``1 id e0 e1``, arcs (a, b, forth, back) from lines ``2 i j capacity reverse``."""
    w = _numbers(spark, path)
    big, real = lambda k: F.col("w")[k].cast("bigint"), lambda k: F.col("w")[k].cast("double")
    cells = w.where(F.col("w")[0] == "1").select(big(1).alias("cell_id"), real(2).alias("cost0"), real(3).alias("cost1"))
    return cells, w.where(F.col("w")[0] == "2").select(big(1).alias("a"), big(2).alias("b"), real(3).alias("forth"), real(4).alias("back"))


def factor_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(id, vars, cards, values) of blocks that start with ``### id``: number of variables, variables, cardinalities, number of entries, then index and value of each; entries left out are 0."""
    blocks = spark.read.option("lineSep", "###").text(path).where("trim(value) <> ''")
    w = blocks.select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("w")).where("size(w) > 2")
    # null-safe, as filters may be put before the one above
    n = F.get("w", 1).cast("int")
    part = lambda a, k: F.slice("w", a, k)
    t = w.select(F.col("w")[0].cast("bigint").alias("id"), F.transform(part(3, n), lambda v: v.cast("bigint")).alias("vars"), F.transform(part(n + 3, n), lambda v: v.cast("int")).alias("cards"), F.slice("w", 2 * n + 4, F.size("w")).alias("r"))
    given = t.withColumn("m", F.map_from_arrays(F.expr("transform(sequence(0, size(r) div 2 - 1), i -> cast(r[2 * i] as int))"), F.expr("transform(sequence(0, size(r) div 2 - 1), i -> cast(r[2 * i + 1] as double))")))
    size = F.aggregate("cards", F.lit(1), lambda a, c: a * c)
    return given.select("id", "vars", "cards", F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("values"))


def parameters(text: str) -> dict[str, dict[str, list[str]]]:
    """Parameters by data set from ``<env><datasets><name><key>value[,value]``; sets with ``do_process`` false are left out."""
    out = {}
    for sets in ET.fromstring(text).iter("datasets"):
        for one in sets:
            got: dict[str, list[str]] = {}
            for p in one:
                got.setdefault(p.tag, []).extend(v.strip() for v in (p.text or "").split(",") if v.strip())
            if got.get("do_process", ["true"]) != ["false"]:
                out[one.tag] = got
    return out


def expanded(params: dict[str, list[str]], sort_by: str = "") -> list[dict[str, str]]:
    """Every combination of the values, by a criterion ``key:gt`` (falling) or ``key:lt`` (rising) if one is given."""
    keys = sorted(params)
    out = [dict(zip(keys, v, strict=True)) for v in itertools.product(*(params[k] for k in keys))]
    if sort_by:
        key, way = sort_by.split(":")
        out.sort(key=lambda p: float(p[key]), reverse=way == "gt")
    return out


def parameters_xml(name: str, params: dict[str, list[str]]) -> str:
    env = ET.Element("env")
    one = ET.SubElement(ET.SubElement(env, "datasets"), name)
    for k, v in params.items():
        ET.SubElement(one, k).text = ",".join(v)
    return ET.tostring(env, encoding="unicode")


def point_features(points: DataFrame, *properties: str) -> DataFrame:
    """(feature): a GeoJSON feature for each of ``points`` (x, y, z and ``properties``)."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y", "z").alias("coordinates"))
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def box_features(boxes: DataFrame, *properties: str) -> DataFrame:
    """(feature): the outline of each of ``boxes`` (xmin, xmax, ymin, ymax) as a GeoJSON polygon."""
    ring = F.array(*[F.array(a, b) for a, b in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin"))])
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return boxes.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def write_features(features: DataFrame, path: str) -> None:
    """A feature a line (GeoJSON text sequence without separators)."""
    features.select(F.col("feature").alias("value")).write.mode("overwrite").text(path)


def collection(features: list[str]) -> str:
    """A feature collection of a bounded number of features, such as the tiles of a cloud."""
    return json.dumps({"type": "FeatureCollection", "features": [json.loads(f) for f in features]})
