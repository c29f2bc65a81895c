"""Small point formats: xyz, a3d, npts, pcd and stl, read into tables and, but for stl, written."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the text formats: coordinates, then what may follow. Fixed values.
COLUMNS = {"xyz": ("x", "y", "z", "red", "green", "blue"), "a3d": ("x", "y", "z", "reflectivity"), "npts": ("x", "y", "z", "nx", "ny", "nz")}
_NUMPY = {("F", 4): "f4", ("F", 8): "f8", ("U", 1): "u1", ("U", 2): "u2", ("U", 4): "u4", ("I", 1): "i1", ("I", 2): "i2", ("I", 4): "i4"}


def read_text(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Points of an xyz, a3d or npts file, a line each, numbers apart by blanks or commas; missing columns are null, lines without three numbers (headers) are left out."""
    w = F.split(F.trim("value"), r"[\s,;]+")
    t = spark.read.text(path).select(F.transform(w, lambda v: v.try_cast("double")).alias("v"))
    t = t.where(F.forall(F.slice("v", 1, 3), lambda v: v.isNotNull()) & (F.size("v") >= 3))
    return t.select(*[F.get("v", k).alias(c) for k, c in enumerate(COLUMNS[kind])])


def write_text(points: DataFrame, path: str, kind: str) -> None:
    """The columns of a format that ``points`` has, a line for each point."""
    have = [c for c in COLUMNS[kind] if c in points.columns]
    points.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in have]).alias("value")).write.mode("overwrite").text(path)


def parse_pcd(raw: bytes) -> dict[str, np.ndarray]:
    """The fields of a PCD file (ASCII or binary; compressed ones are refused)."""
    end = raw.index(b"DATA ")
    start = raw.index(b"\n", end) + 1
    head = {w[0]: w[1:] for line in raw[:end].decode("ascii", "replace").splitlines() if (w := line.split()) and not line.startswith("#")}
    kind = raw[end + 5 : start].strip().decode()
    names, n = head["FIELDS"], int(head.get("POINTS", head.get("WIDTH"))[0])
    codes = [_NUMPY[t, int(s)] for t, s in zip(head["TYPE"], head["SIZE"], strict=True)]
    if kind == "ascii":
        block = np.array(raw[start:].split()[: n * len(names)], dtype="S").reshape(n, len(names))
        return {c: block[:, k].astype(np.float64).astype(codes[k]) for k, c in enumerate(names)}
    if kind != "binary":
        raise ValueError(f"PCD data of the kind {kind} can't be read")
    rows = np.frombuffer(raw, np.dtype([(c, "<" + t) for c, t in zip(names, codes, strict=True)]), n, start)
    return {c: rows[c] for c in names}


def pcd_bytes(fields: dict[str, np.ndarray], binary: bool = True) -> bytes:
    n = len(next(iter(fields.values()), ()))
    head = ["VERSION .7", "FIELDS " + " ".join(fields), "SIZE " + " ".join("8" for _ in fields), "TYPE " + " ".join("F" for _ in fields), "COUNT " + " ".join("1" for _ in fields), f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", f"DATA {'binary' if binary else 'ascii'}"]
    start = ("\n".join(head) + "\n").encode()
    block = np.stack([np.asarray(v, np.float64) for v in fields.values()], 1) if fields else np.zeros((0, 0))
    return start + (block.astype("<f8").tobytes() if binary else "\n".join(" ".join(repr(float(v)) for v in row) for row in block).encode())


def parse_stl(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(triangles (n, 3, 3), normals (n, 3)) of an STL file, ASCII or binary."""
    if len(raw) >= 84 and 84 + 50 * (n := struct.unpack_from("<I", raw, 80)[0]) == len(raw):
        rows = np.frombuffer(raw, np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]), n, 84)
        return rows["v"].astype(float), rows["n"].astype(float)
    words = [line.split() for line in raw.decode("ascii", "replace").splitlines()]
    v = np.array([w[1:4] for w in words if w[:1] == ["vertex"]], float).reshape(-1, 3, 3)
    return v, np.array([w[2:5] for w in words if w[:2] == ["facet", "normal"]], float).reshape(-1, 3)


def read_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, row, x, y, z) of pcd files, or (path, row, corner, x, y, z) of stl files below ``path``; a file is read by one task."""
    columns = "path string, row bigint, " + ("corner int, " if kind == "stl" else "") + "x double, y double, z double"

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                if kind == "stl":
                    xyz = parse_stl(content.as_py())[0].reshape(-1, 3)
                    more = [pa.array(np.arange(len(xyz)) // 3), pa.array((np.arange(len(xyz)) % 3).astype(np.int32))]
                else:
                    got = parse_pcd(content.as_py())
                    xyz = np.stack([got[a].astype(float) for a in "xyz"], 1)
                    more = [pa.array(np.arange(len(xyz)))]
                names = [c.split()[0] for c in columns.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(xyz), pa.string()), *more, *(pa.array(np.ascontiguousarray(xyz[:, k])) for k in range(3))], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(decode, columns)
