"""Text records of tiles, listings of input files, and the sources that a data type names."""

from __future__ import annotations

import os
import urllib.request
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.numbering import numbered
from pointloom.sources import generate, las, ply


def last_number(path: Column) -> Column:
    """The last whole number in the last part of a path, null if it has none."""
    return F.try_element_at(F.regexp_extract_all(F.element_at(F.split(path, "/"), -1), F.lit("([0-9]+)"), F.lit(1)), F.lit(-1)).cast("bigint")


def listing(spark: SparkSession, path: str, extension: str = "las", matching: str | None = None) -> DataFrame:
    """(path, length, tile_id): the files below ``path`` with an extension, and a regular expression that their paths match; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", "true").load(path).select("path", "length")
    if matching:
        files = files.where(F.col("path").rlike(matching))
    return files.withColumn("tile_id", last_number(F.col("path")))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(label, key, payload) of lines ``label key payload``: one letter or word, the tile (or ``src dst`` of an edge) and the rest."""
    w = F.split(F.trim("value"), r"\s+", 2)
    t = spark.read.text(path).where("trim(value) <> ''").select(w[0].alias("label"), F.trim(F.get(w, 1)).alias("rest"))
    return t.select("label", "rest")


def labelled(lines: DataFrame, label: str) -> DataFrame:
    """The records whose label begins with a letter."""
    return lines.where(F.col("label").startswith(label[:1]))


def keyed(lines: DataFrame, label: str) -> DataFrame:
    """(tile_id, payload) of the records of a label."""
    w = F.split("rest", r"\s+", 2)
    return labelled(lines, label).select(w[0].cast("bigint").alias("tile_id"), F.coalesce(F.get(w, 1), F.lit("")).alias("payload"))


def edges(lines: DataFrame, label: str) -> DataFrame:
    """(src, dst, payload) of the edge records of a label."""
    w = F.split("rest", r"\s+", 3)
    return labelled(lines, label).select(w[0].cast("bigint").alias("src"), F.get(w, 1).cast("bigint").alias("dst"), F.coalesce(F.get(w, 2), F.lit("")).alias("payload"))


def ply_stream(spark: SparkSession, path: str) -> DataFrame:
    """(tile_id, value): whole text files with line ends folded into ``;``, numbered from 0 by path."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.regexp_replace(F.rtrim(F.regexp_replace("value", r"\r?\n", "\n")), "\n", ";").alias("value"))
    return numbered(t, [F.col("p")], "tile_id").select("tile_id", "value")


def folded_vertices(stream: DataFrame, properties: list[str]) -> DataFrame:
    """(tile_id, row, a double for each of ``properties``) of ASCII files whose lines are folded as ``ply_stream`` does."""

    def decode(it):
        import numpy as np

        for b in it:
            for tile, value in zip(b.column("tile_id").to_pylist(), b.column("value").to_pylist(), strict=True):
                got = ply.parse(value.replace(";", "\n").encode() + b"\n")[0]
                n = len(next(iter(got.values()), ()))
                cols = [pa.array([tile] * n, pa.int64()), pa.array(np.arange(n))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(got[p].astype(float)) if p in got else pa.nulls(n, pa.float64()) for p in properties], ["tile_id", "row", *properties])

    return stream.select("tile_id", "value").mapInArrow(decode, "tile_id bigint, row bigint" + "".join(f", `{p}` double" for p in properties))


def base64_lines(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """(tile_id, content): a base64 text a line, decoded, numbered from 0 by file and place; spread over ``files`` partitions if given."""
    t = spark.read.text(path).where("trim(value) <> ''").select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"), F.unbase64(F.trim("value")).alias("content"))
    out = numbered(t, [F.col("p"), F.col("b"), F.col("m")], "tile_id").select("tile_id", "content")
    return out.repartition(files) if files else out


def serialised(df: DataFrame, key: str = "tile_id") -> DataFrame:
    """(key, value): each group's rows as one base64 text of an Arrow stream; a group is what a tile holds."""
    rest = [c for c in df.columns if c != key]

    def pack(t: pa.Table) -> pa.Table:
        import base64

        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.select(rest).schema) as w:
            w.write_table(t.select(rest))
        return pa.table({key: [t.column(key)[0].as_py()], "value": [base64.b64encode(sink.getvalue().to_pybytes()).decode()]})

    return df.groupBy(key).applyInArrow(pack, f"{key} {dict(df.dtypes)[key]}, value string")


def deserialised(df: DataFrame, schema: str, key: str = "tile_id") -> DataFrame:
    """The rows that ``serialised`` packed: ``key`` and the columns of ``schema``."""

    def unpack(it):
        import base64

        for b in it:
            for k, v in zip(b.column(key).to_pylist(), b.column("value").to_pylist(), strict=True):
                for x in pa.ipc.open_stream(base64.b64decode(v)):
                    yield pa.RecordBatch.from_arrays([pa.array([k] * x.num_rows, b.column(key).type), *x.columns], [key, *x.schema.names])

    return df.select(key, "value").mapInArrow(unpack, f"{key} {dict(df.dtypes)[key]}, {schema}")


def box_of_text(text: Column) -> list[Column]:
    """xmin, xmax, ymin, ymax, zmin, zmax of ``x0xX1:y0xY1:z0xZ1`` (``:`` and ``x`` part the numbers)."""
    w = F.split(F.trim(F.regexp_replace(text, "[:x]", " ")), r"\s+")
    return [F.get(w, k).cast("double").alias(f"{a}{e}") for k, (a, e) in enumerate((a, e) for a in "xyz" for e in ("min", "max"))]


def setting(name: str, default: str = "") -> str:
    """An environment variable, or a default where it is unset or empty."""
    return os.environ.get(name) or default


def download(urls: list[str], folder: str, fetch: Callable[[str, str], object] = urllib.request.urlretrieve) -> list[str]:
    """Files of ``urls`` in a local folder; those there already are not fetched again, and a broken transfer leaves no file. For the driver, before a job."""
    out = []
    for u in urls:
        path = os.path.join(folder, u.rstrip("/").rsplit("/", 1)[-1])
        if not os.path.exists(path):
            fetch(u, path + ".part")
            os.replace(path + ".part", path)
        out.append(path)
    return out


def cloud(spark: SparkSession, kind: str, path: str = "", params: dict[str, str] | None = None, box: generate.Box = (0.0, 1.0, 0.0, 1.0, 0.0, 1.0)) -> DataFrame:
    """The cloud that a data type names: ``files`` (PLY), ``las``, ``plystream``, ``random_uniform``, ``random_normal``. Its columns are those of the source."""
    if kind == "files":
        return ply.read_vertices(spark, path, ["x", "y", "z"])
    if kind == "las":
        return las.read_las(spark, path)
    if kind == "plystream":
        return folded_vertices(ply_stream(spark, path), ["x", "y", "z"])
    if kind.startswith("random_"):
        return generate.generated(spark, params or {}, box, kind)
    raise ValueError(f"unknown data type {kind}")
