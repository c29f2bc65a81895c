"""PLY files: reading (ASCII and binary, any scalar properties) and writing one ASCII file for each tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the format's types and their numpy codes.
TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8"}
TYPES |= {"int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def parse(raw: bytes) -> tuple[dict[str, np.ndarray], list[list[int]], list[str]]:
    """(vertex properties, faces, comments) of a file."""
    end = raw.index(b"end_header")
    start = raw.index(b"\n", end) + 1
    lines = raw[:end].decode("ascii", "replace").splitlines()
    if not lines or lines[0].strip() != "ply":
        raise ValueError("not a PLY file")
    form, elements, comments = "ascii", [], []
    for line in lines[1:]:
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["comment"]:
            comments.append(line.split(None, 1)[1] if len(w) > 1 else "")
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append(w[1:])
    vertex: dict[str, np.ndarray] = {}
    faces: list[list[int]] = []
    order = ">" if form == "binary_big_endian" else "<"
    words, at = (raw[start:].split(), 0) if form == "ascii" else ([], start)
    for name, n, props in elements:
        listed = any(p[0] == "list" for p in props)
        if form == "ascii" and not listed:
            block = np.array(words[at : at + n * len(props)], "S").reshape(n, len(props)) if n else np.zeros((0, len(props)), "S1")
            at += n * len(props)
            got = {p[1]: block[:, i].astype(np.float64).astype(TYPES[p[0]]) for i, p in enumerate(props)}
        elif not listed:
            dtype = np.dtype([(p[1], order + TYPES[p[0]]) for p in props])
            block = np.frombuffer(raw, dtype, n, at)
            at += n * dtype.itemsize
            got = {p[1]: block[p[1]] for p in props}
        else:
            got = {}
            for _ in range(n):
                for p in props:
                    if form == "ascii":
                        size = int(words[at]) if p[0] == "list" else 1
                        at += p[0] == "list"
                        values = [int(float(v)) for v in words[at : at + size]]
                        at += size
                    else:
                        size = 1
                        if p[0] == "list":
                            kind = np.dtype(order + TYPES[p[1]])
                            size = int(np.frombuffer(raw, kind, 1, at)[0])
                            at += kind.itemsize
                        kind = np.dtype(order + TYPES[p[2] if p[0] == "list" else p[0]])
                        values = np.frombuffer(raw, kind, size, at).astype(np.int64).tolist()
                        at += size * kind.itemsize
                    if name == "face" and p[0] == "list":
                        faces.append(values)
        if name == "vertex":
            vertex = got
    return vertex, faces, comments


def _files(spark: SparkSession, path: str) -> DataFrame:
    tile = F.expr("try_cast(element_at(regexp_extract_all(element_at(split(path, '/'), -1), '([0-9]+)', 1), -1) as bigint)")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").option("recursiveFileLookup", "true").load(path).select(tile.alias("tile_id"), "content")


def read_vertices(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """(tile_id, row, a double for each of ``properties``) of all files below ``path``; the tile is the last number of the file's name. A property that a file hasn't is null."""

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for tile, content in zip(b.column("tile_id").to_pylist(), b.column("content"), strict=True):
                got = parse(content.as_py())[0]
                n = len(next(iter(got.values()), ()))
                cols = [pa.array([tile] * n, pa.int64()), pa.array(np.arange(n))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(got[p].astype(np.float64)) if p in got else pa.nulls(n, pa.float64()) for p in properties], ["tile_id", "row", *properties])

    return _files(spark, path).mapInArrow(decode, "tile_id bigint, row bigint" + "".join(f", `{p}` double" for p in properties))


def read_faces(spark: SparkSession, path: str) -> DataFrame:
    """(tile_id, row, corners array<bigint>) of all files below ``path``."""

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for tile, content in zip(b.column("tile_id").to_pylist(), b.column("content"), strict=True):
                faces = parse(content.as_py())[1]
                yield pa.RecordBatch.from_arrays([pa.array([tile] * len(faces), pa.int64()), pa.array(np.arange(len(faces))), pa.array(faces, pa.list_(pa.int64()))], ["tile_id", "row", "corners"])

    return _files(spark, path).mapInArrow(decode, "tile_id bigint, row bigint, corners array<bigint>")


def write_tiles(points: DataFrame, path: str, properties: list[str]) -> None:
    """One ASCII file for each ``tile_id`` of ``points``, vertices by ``row``, with the tile's extent as a comment. Written by Spark's text writer, so tasks that run again replace their files; a tile, which the tiling bounds, is one value."""
    line = F.concat_ws(" ", *[F.coalesce(F.col(p).cast("double").cast("string"), F.lit("nan")) for p in properties])
    rows = points.groupBy("tile_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", line.alias("v")))), lambda x: x["v"]), "\n").alias("body"), F.count("*").alias("n"),
        F.concat_ws(" ", *[f(a).cast("double").cast("string") for a in "xyz" for f in (F.min, F.max)]).alias("box"),
    )
    head = F.concat(F.lit("ply\nformat ascii 1.0\ncomment bbox "), F.col("box"), F.lit("\nelement vertex "), F.col("n").cast("string"), F.lit("\n" + "".join(f"property double {p}\n" for p in properties) + "end_header\n"))
    rows.select("tile_id", F.concat(head, F.col("body")).alias("value")).write.partitionBy("tile_id").mode("overwrite").text(path)
