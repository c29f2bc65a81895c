"""LAS 1.2 to 1.4 files as DataFrames, through Spark's own file reader, so that any store works."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, row bigint, x double, y double, z double, scan_angle double, point_source_id int, classification int, red int, green int, blue int"
#: Places of the fields in a record of a point format: classification, scan angle (type and degrees a unit), source, first colour.
_LEGACY = {f: (15, 16, "i1", 1.0, 18, c) for f, c in ((0, None), (1, None), (2, 20), (3, 28), (4, None), (5, 28))}
_MODERN = {f: (16, 18, "<i2", 0.006, 20, c) for f, c in ((6, None), (7, 30), (8, 30), (9, None), (10, 30))}
FORMATS = _LEGACY | _MODERN
#: Records decoded at once.
BATCH = 1 << 16


def header(raw: bytes) -> dict:
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    kind = raw[104]
    if kind & 0xC0:
        raise ValueError("compressed point records (LAZ) can't be read")
    if kind not in FORMATS:
        raise ValueError(f"point format {kind} is unknown")
    count = struct.unpack_from("<I", raw, 107)[0]
    if raw[25] >= 4 and len(raw) >= 255:
        count = struct.unpack_from("<Q", raw, 247)[0] or count
    return {
        "format": kind, "start": struct.unpack_from("<I", raw, 96)[0], "length": struct.unpack_from("<H", raw, 105)[0], "count": count,
        "scale": struct.unpack_from("<3d", raw, 131), "offset": struct.unpack_from("<3d", raw, 155),
    }


def records(raw: bytes, first: int, n: int, h: dict) -> dict[str, np.ndarray]:
    """``n`` points of a file from number ``first`` on. Files without colours have None for them."""
    cls, angle, kind, unit, source, colour = FORMATS[h["format"]]
    fields = {"x": (0, "<i4"), "y": (4, "<i4"), "z": (8, "<i4"), "classification": (cls, "u1"), "scan_angle": (angle, kind), "point_source_id": (source, "<u2")}
    if colour is not None:
        fields |= {c: (colour + 2 * i, "<u2") for i, c in enumerate(("red", "green", "blue"))}
    dtype = np.dtype({"names": list(fields), "formats": [f for _, f in fields.values()], "offsets": [o for o, _ in fields.values()], "itemsize": h["length"]})
    block = np.frombuffer(raw, dtype, n, h["start"] + first * h["length"])
    out = {a: block[a] * h["scale"][i] + h["offset"][i] for i, a in enumerate("xyz")}
    out |= {"scan_angle": block["scan_angle"] * unit, "point_source_id": block["point_source_id"], "classification": block["classification"] & (31 if h["format"] < 6 else 255)}
    return out | {c: block[c] if c in fields else None for c in ("red", "green", "blue")}


#: Points of a piece that one task reads at a time.
PIECE = 4_000_000


def read_las(spark: SparkSession, path: str, pattern: str = "*.las", columns: tuple[str, ...] | None = None, piece: int = PIECE) -> DataFrame:
    """The points of all files below ``path`` that match ``pattern``: SCHEMA, or the ``columns`` of it that are asked for (path and row always), rows numbered in each file.

    Files are listed with their sizes only. Where executors can open the paths themselves (local and mounted file systems), a file is read in ranges of ``piece`` points by several tasks, which decode the asked
    columns alone. Other stores are read through Spark, whole files (2 GB at most) at a time.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    wanted = ["path", "row", *[c for c in names[2:] if columns is None or c in columns]]
    kinds = {"x": pa.float64(), "y": pa.float64(), "z": pa.float64(), "scan_angle": pa.float64()}
    schema = ", ".join(c for c in SCHEMA.split(", ") if c.split()[0] in wanted)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)

    def batches(name: str, raw: bytes, h: dict, first: int, n: int, at: int) -> Iterator[pa.RecordBatch]:
        """Points ``first`` to ``first`` + n of a file; ``raw`` begins with point ``at``."""
        for a in range(first, first + n, BATCH):
            m = min(BATCH, first + n - a)
            got = records(raw, a - at, m, h)
            cols = [pa.array([name] * m), pa.array(np.arange(a, a + m))]
            cols += [pa.nulls(m, pa.int32()) if got[c] is None else pa.array(got[c].astype(np.float64 if c in kinds else np.int32)) for c in wanted[2:]]
            yield pa.RecordBatch.from_arrays(cols, wanted)

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                raw = content.as_py()
                h = header(raw)
                yield from batches(name, raw, h, 0, h["count"], 0)

    def ranges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, k in zip(b.column("path").to_pylist(), b.column("k").to_pylist(), strict=True):
                with open(_local(name), "rb") as f:
                    h = header(f.read(375))
                    first = k * piece
                    n = min(piece, h["count"] - first)
                    if n > 0:
                        f.seek(h["start"] + first * h["length"])
                        yield from batches(name, f.read(n * h["length"]), h | {"start": 0}, first, n, first)

    listed = files.select("path", "length")
    if not listed.where(~F.col("path").startswith("file:")).isEmpty():
        return files.select("path", "content").mapInArrow(whole, schema)
    # a record has 20 bytes at least, so these are all pieces that a file may have
    parts = F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("length") / (20 * piece)).cast("bigint"))
    return listed.select("path", F.explode(parts).alias("k")).repartition(spark.sparkContext.defaultParallelism, "path", "k").mapInArrow(ranges, schema)


def _local(path: str) -> str:
    return unquote(urlparse(path).path)


def encode(xyz: np.ndarray, angle: np.ndarray, source: np.ndarray, colour: np.ndarray, scale: float = 0.001) -> bytes:
    """A LAS 1.4 file of point format 7, coordinates rounded to ``scale``."""
    h = bytearray(375)
    h[:4], h[24], h[25], h[104] = b"LASF", 1, 4, 7
    struct.pack_into("<H", h, 94, 375)
    struct.pack_into("<I", h, 96, 375)
    struct.pack_into("<H", h, 105, 36)
    struct.pack_into("<3d", h, 131, scale, scale, scale)
    low = np.floor(xyz.min(0)) if len(xyz) else np.zeros(3)
    struct.pack_into("<3d", h, 155, *low)
    struct.pack_into("<Q", h, 247, len(xyz))
    rows = np.zeros(len(xyz), np.dtype({"names": ["p", "a", "s", "c"], "formats": ["3<i4", "<i2", "<u2", "3<u2"], "offsets": [0, 18, 20, 30], "itemsize": 36}))
    rows["p"], rows["a"], rows["s"], rows["c"] = np.rint((xyz - low) / scale), np.rint(angle / 0.006), source, colour
    return bytes(h) + rows.tobytes()
