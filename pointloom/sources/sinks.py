"""Files for tiles, meshes and tables: PLY with faces (ASCII or binary), GeoJSON, CSV with a VRT description, statistics.

All files are written by Spark's own writers, one row a file, so a task that runs again replaces its file; ``named_files`` gives them their final names.
"""

from __future__ import annotations

import json
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import simplex as sx


def ply_bytes(vertices: dict[str, np.ndarray], faces: np.ndarray | None = None, face_properties: dict[str, np.ndarray] | None = None, binary: bool = False, comments: tuple[str, ...] = ()) -> bytes:
    """A PLY file: vertex properties, then faces (rows of vertex numbers) with their own properties. Whole numbers are written as int, others as double."""
    kind = lambda v: "int" if np.issubdtype(v.dtype, np.integer) else "double"
    extra = face_properties or {}
    n = len(next(iter(vertices.values()), ()))
    head = ["ply", f"format {'binary_little_endian' if binary else 'ascii'} 1.0", *(f"comment {c}" for c in comments), f"element vertex {n}"]
    head += [f"property {kind(v)} {p}" for p, v in vertices.items()]
    if faces is not None:
        head += [f"element face {len(faces)}", "property list uchar int vertex_indices", *(f"property {kind(v)} {p}" for p, v in extra.items())]
    start = "\n".join([*head, "end_header", ""]).encode()
    code = {"int": "<i4", "double": "<f8"}
    if binary:
        rows = np.zeros(n, np.dtype([(p, code[kind(v)]) for p, v in vertices.items()]))
        for p, v in vertices.items():
            rows[p] = v
        body = rows.tobytes()
        if faces is not None:
            width = faces.shape[1] if len(faces) else 3
            f = np.zeros(len(faces), np.dtype([("n", "u1"), ("v", "<i4", (width,)), *((p, code[kind(v)]) for p, v in extra.items())]))
            f["n"], f["v"] = width, faces
            for p, v in extra.items():
                f[p] = v
            body += f.tobytes()
        return start + body
    text = lambda v: str(int(v)) if isinstance(v, (int, np.integer)) else repr(float(v))
    lines = [" ".join(map(text, row)) for row in zip(*vertices.values(), strict=True)]
    if faces is not None:
        cols = list(extra.values())
        lines += [" ".join([str(len(f)), *map(str, f.tolist()), *(text(c[i]) for c in cols)]) for i, f in enumerate(faces)]
    return start + "\n".join([*lines, ""]).encode()


def _write_rows(rows: DataFrame, path: str) -> None:
    """(tile_id, content binary): one file for each row. A line feed follows the content, which the formats allow."""
    rows.select("tile_id", F.col("content").cast("string").alias("value")).write.partitionBy("tile_id").mode("overwrite").text(path)


def _matrix(t: pa.Table, names: list[str]) -> dict[str, np.ndarray]:
    out = {}
    for n in names:
        v = t.column(n).to_numpy()
        out[n] = v.astype(np.int64) if np.issubdtype(v.dtype, np.integer) else v.astype(np.float64)
    return out


def write_meshes(vertices: DataFrame, faces: DataFrame | None, path: str, properties: list[str], face_properties: list[str] | None = None, binary: bool = False) -> None:
    """A PLY file for each tile of ``vertices`` (tile_id, row from 0, ``properties``) and ``faces`` (tile_id, u, v, w by row, ``face_properties``), with the tile's extent as a comment. A tile is held by one task."""
    extra = face_properties or []

    def encode(v: pa.Table, f: pa.Table | None) -> pa.Table:
        v = v.sort_by("row")
        tile = v.column("tile_id")[0].as_py() if v.num_rows else f.column("tile_id")[0].as_py()
        got = _matrix(v, properties)
        box = " ".join(repr(float(g(got[a], initial=0) if not len(got[a]) else g(got[a]))) for a in "xyz" for g in (np.min, np.max))
        corners = np.stack([f.column(c).to_numpy() for c in "uvw"], 1) if f is not None else None
        raw = ply_bytes(got, corners, _matrix(f, extra) if f is not None and extra else None, binary, (f"bbox {box}",))
        return pa.table({"tile_id": pa.array([tile], pa.int64()), "content": pa.array([raw], pa.binary())})

    v = vertices.select(F.col("tile_id").cast("bigint").alias("tile_id"), "row", *[c for c in properties])
    schema = "tile_id bigint, content binary"
    if faces is None:
        _write_rows(v.groupBy("tile_id").applyInArrow(lambda t: encode(t, None), schema), path)
    else:
        f = faces.select(F.col("tile_id").cast("bigint").alias("tile_id"), *[F.col(c).cast("bigint").alias(c) for c in "uvw"], *extra)
        _write_rows(v.groupBy("tile_id").cogroup(f.groupBy("tile_id")).applyInArrow(encode, schema), path)


def write_points(points: DataFrame, path: str, properties: list[str], per_file: int = 5_000_000, binary: bool = True) -> None:
    """Binary PLY files of at most ``per_file`` points of each tile_id, numbered tile by tile: file k of tile t is tile_id = t * 1000 + k."""
    from pyspark.sql import Window

    row = (F.row_number().over(Window.partitionBy("tile_id").orderBy("row")) - 1).cast("bigint")
    t = points.withColumn("_n", row)
    t = t.withColumn("tile_id", F.col("tile_id") * 1000 + F.call_function("div", F.col("_n"), F.lit(per_file).cast("bigint"))).withColumn("row", F.col("_n") % per_file)
    write_meshes(t, None, path, properties, binary=binary)


def named_files(spark: SparkSession, path: str, label: str, extension: str = "ply") -> list[str]:
    """Moves ``path``/tile_id=<k>/part-* to ``path``/<k>_<label>.<extension>; a tile has one part. For the driver, a rename for each tile."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for folder in fs.listStatus(root):
        name = folder.getPath().getName()
        if not name.startswith("tile_id="):
            continue
        part = next(s.getPath() for s in fs.listStatus(folder.getPath()) if s.getPath().getName().startswith("part-"))
        to = jvm.org.apache.hadoop.fs.Path(root, f"{name.removeprefix('tile_id=')}_{label}.{extension}")
        if not fs.rename(part, to):
            raise OSError(f"{part} can't be moved to {to}")
        fs.delete(folder.getPath(), True)
        out.append(to.toString())
    return sorted(out)


def cell_faces(cells: DataFrame, soup: bool = False) -> DataFrame:
    """(cell_id, u, v, w): the four triangles of each of ``cells`` (cell_id, a, b, c, d); with ``soup`` repeats between neighbours stay, else each triangle is there once, for its least cell."""
    parts = F.array(*[F.struct(*[F.col(c).alias(n) for n, c in zip("uvw", [x for x in "abcd" if x != o], strict=True)]) for o in "abcd"])
    t = cells.select("cell_id", F.explode(parts).alias("f")).select("cell_id", "f.*")
    return t if soup else t.groupBy("u", "v", "w").agg(F.min("cell_id").alias("cell_id")).select("cell_id", "u", "v", "w")


def _feature(kind: str, coordinates: Column, properties: tuple[str, ...]) -> Column:
    own = F.struct(*properties) if properties else F.from_json(F.lit("{}"), "struct<_none:int>")
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"), own.alias("properties"))).alias("feature")


def _place(v: sx.Vec) -> Column:
    return F.array(*v)


def triangle_features(triangles: DataFrame, *properties: str) -> DataFrame:
    """(feature): a GeoJSON polygon for each of ``triangles`` (p, q, r as structs, and ``properties`` such as a label or masses)."""
    p, q, r = (_place(sx.vec(c)) for c in "pqr")
    return triangles.select(_feature("Polygon", F.array(F.array(p, q, r, p)), properties))


def line_features(lines: DataFrame, *properties: str) -> DataFrame:
    """(feature): a line for each of ``lines`` (p, q as structs), such as edges of a Voronoi diagram or between the centres of tiles."""
    return lines.select(_feature("LineString", F.array(_place(sx.vec("p")), _place(sx.vec("q"))), properties))


def normal_features(points: DataFrame, length: float = 1.0, *properties: str) -> DataFrame:
    """(feature): a line from each of ``points`` (x, y, z) along its normal (nx, ny, nz)."""
    p = sx.columns()
    return points.select(_feature("LineString", F.array(_place(p), _place(sx.plus(p, sx.times(sx.columns("n"), length)))), properties))


def tile_links(boxes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, p, q): the centres of the ``boxes`` (id, xmin, xmax ...) that each edge (src, dst) joins."""
    low, high = sx.columns(suffix="min"), sx.columns(suffix="max")
    at = boxes.select("id", sx.struct(sx.box_centre(low, high)).alias("c"))
    return edges.join(at.select(F.col("id").alias("src"), F.col("c").alias("p")), "src").join(at.select(F.col("id").alias("dst"), F.col("c").alias("q")), "dst").select("src", "dst", "p", "q")


def numbered_elements(df: DataFrame, kind: str, *properties: str) -> DataFrame:
    """(value): lines ``<kind> <tile_id> <properties>`` of vertices or faces, so that files of several tiles can be joined."""
    return df.select(F.concat_ws(" ", F.lit(kind), F.col("tile_id").cast("string"), *[F.coalesce(F.col(p).cast("string"), F.lit("nan")) for p in properties]).alias("value"))


def wkt(kind: str, *points: sx.Vec) -> Column:
    """POINT, LINESTRING or TRIANGLE text of some points."""
    text = [F.concat_ws(" ", *[v.cast("string") for v in p]) for p in points]
    if kind == "POINT":
        return F.concat(F.lit("POINT Z ("), text[0], F.lit(")"))
    inner = F.concat_ws(", ", *text, *([text[0]] if kind == "TRIANGLE" else []))
    return F.concat(F.lit("POLYGON Z (("), inner, F.lit("))")) if kind == "TRIANGLE" else F.concat(F.lit("LINESTRING Z ("), inner, F.lit(")"))


def vrt(name: str, csv: str, fields: dict[str, str], srs: str = "EPSG:2154") -> str:
    """The description of a CSV table with a column ``wkt`` as a layer; ``fields``: names and types (Integer64, Real, String)."""
    rows = "".join(f"<Field name={quoteattr(f)} type={quoteattr(k)}/>" for f, k in fields.items())
    return f'<OGRVRTDataSource><OGRVRTLayer name={quoteattr(name)}><SrcDataSource relativeToVRT="1">{csv}</SrcDataSource><LayerSRS>{srs}</LayerSRS><GeometryField encoding="WKT" field="wkt"/>{rows}</OGRVRTLayer></OGRVRTDataSource>'


def write_layer(df: DataFrame, path: str, name: str, by_tile: bool = False, srs: str = "EPSG:2154") -> None:
    """``df`` (wkt and other columns) as CSV files with a header below ``path``/<name> (by tile_id, if asked) and ``path``/<name>_vrt with the layer's description."""
    kinds = {"bigint": "Integer64", "int": "Integer64", "double": "Real", "float": "Real"}
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy("tile_id") if by_tile else w).csv(f"{path}/{name}")
    text = vrt(name, name, {c: kinds.get(k, "String") for c, k in df.dtypes if c != "wkt" and not (by_tile and c == "tile_id")}, srs)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}_vrt")


def iteration_stats(df: DataFrame, iteration: str, part: str, total: str) -> DataFrame:
    """(it, a, b, rate): sums of two counts by iteration and their ratio, null for nothing."""
    t = df.groupBy(F.col(iteration).alias("it")).agg(F.sum(part).cast("bigint").alias("a"), F.sum(total).cast("bigint").alias("b"))
    return t.withColumn("rate", F.col("a") / F.nullif(F.col("b"), F.lit(0)).cast("double"))


def timing_sums(df: DataFrame, label: str, value: str) -> DataFrame:
    """(label, total): sums by label, digits in labels left out."""
    return df.groupBy(F.regexp_replace(label, "[0-9]", "").alias("label")).agg(F.sum(value).cast("bigint").alias("total"))


def parameters_json(params: dict[str, list[str]]) -> str:
    return json.dumps({k: v[0] if len(v) == 1 else v for k, v in sorted(params.items())})
