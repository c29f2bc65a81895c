"""Shared pieces of the corpus operators: shared-folder tables, row numbers, keyed permutations."""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words; every other character belongs to a word.
SPACE = r"\x20\x09-\x0D"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else that of ``setCheckpointDir``, else, in local mode only, one of our own."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if (set_dir := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return set_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="pointloom-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return f"file://{_own_dirs[app]}"


class Scratch:
    """Intermediate tables in the shared folder; they cut the lineage, so a lost executor costs only its running tasks.

    A table that the returned DataFrame reads must outlive the call, so it stays until the
    application's folder is cleared; loops drop the tables they no longer read.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/pointloom-{uuid.uuid4().hex}"
        self._n = 0

    def table(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def close(self) -> None:
        """Deletes all tables of this scratch; for callers that have written what they return."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


def give_back() -> None:
    """Hands a Python worker's free memory back to the system at the end of its task; workers outlive stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def with_row_number(df: DataFrame, keys: list[Column], name: str, scratch: Scratch) -> DataFrame:
    """Adds ``name``: the row's rank from 0 in the order of ``keys``, without a single-task sort.

    Range partitions are sorted apart; the counts of the partitions (one row each) give the offsets.
    Rows equal in all keys get consecutive numbers in the order they are read in, and an extra range key keeps a
    heavily repeated row from filling one partition. The sorted table is written once, as range
    bounds are sampled and could differ if it were computed again.
    """
    cols = df.columns
    keyed = df.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(keys)], F.monotonically_increasing_id().alias("_tie"))
    order = [f"_k{i}" for i in range(len(keys))] + ["_tie"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(*cols, F.monotonically_increasing_id().alias("_mid"))
    t = scratch.table(placed)
    part = F.shiftright("_mid", 33)
    counts = t.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row for each partition of the table, so its size is bounded by the number of tasks
    return t.join(F.broadcast(offsets), part == F.col("_part")).select(*cols, (F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def feistel(x: Column, n: int, key: int, rounds: int = 6) -> Column:
    """A keyed permutation of 0..n-1 as one SQL expression (``x`` bigint in that range).

    A mixed-radix Feistel network permutes 0..a*b-1 with a = ceil(sqrt(n)), b = ceil(n/a); results
    of n or more walk on along their cycle. Fewer than a numbers lie outside, so a walk of a*b-n+1
    steps always ends; rows that need none skip it.
    """
    if n <= 1:
        return x * F.lit(0).cast("bigint")
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def step(v: Column) -> Column:
        big = lambda k: F.lit(k).cast("bigint")
        halves = F.struct(_div(v, b).alias("u"), F.pmod(v, big(b)).alias("w"))

        def mix(acc: Column, r: Column) -> Column:
            # the halves swap each round, and so do their radices
            radix = F.when(r % 2 == 0, big(a)).otherwise(big(b))
            return F.struct(acc["w"].alias("u"), F.pmod(acc["u"] + F.pmod(F.xxhash64(big(key), r, acc["w"]), radix), radix).alias("w"))

        return F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), halves, mix, lambda acc: acc["u"] * big(b) + acc["w"])

    first = step(x)
    if a * b == n:
        return first
    walk = lambda y: F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), y, lambda acc, _: F.when(acc < n, acc).otherwise(step(acc)))
    return F.transform(F.array(first), lambda y: F.when(y < n, y).otherwise(walk(y)))[0]


def _div(x: Column, k: int) -> Column:
    """Integer quotient of non-negative bigints."""
    return F.call_function("div", x, F.lit(k).cast("bigint"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def with_uid(docs: DataFrame, cols: list[Column | str], scratch: Scratch) -> DataFrame:
    """``uid`` (bigint) and ``cols`` of ``docs``; a row has the same uid whenever and however it is read.

    For Parquet files, uid is the file's number, in the order of the paths, times 2**33 and the row's place in its file. Neither follows from how a
    scan is split, which changes with the number of live cores. Other input is written once, with its numbers.
    """
    try:
        scan = docs.select(*cols, F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_r"))
    except AnalysisException:
        named = docs.select(*cols)
        return scratch.table(named.select(F.monotonically_increasing_id().alias("uid"), *named.columns))
    # one row for each file
    paths = docs.select(F.col("_metadata.file_path").alias("_f")).distinct()
    files = scratch.table(paths.select("_f", (F.row_number().over(Window.orderBy("_f")) - 1).cast("bigint").alias("_n")))
    joined = scan.join(F.broadcast(files), "_f")
    return joined.select((F.shiftleft("_n", 33) + F.col("_r")).alias("uid"), *[c for c in scan.columns if c not in ("_f", "_r")])


#: A table of bitmaps is broadcast up to this size; 4 KB stand for 32,768 rows.
BROADCAST_BITMAPS = 64 << 20


def with_marks(rows: DataFrame, marks: DataFrame, scratch: Scratch, name: str = "mark", planes: int = 1) -> DataFrame:
    """The rows of ``rows`` (with a bigint ``uid``) that ``marks`` (uid, mark from 1 to 2**planes - 1) has, and their mark.

    ``uid`` is that of ``with_uid``. Marks become
    bitmaps, a bit for each row and plane, so that the wide rows need no shuffle where the bitmaps fit BROADCAST_BITMAPS; beyond that, both sides are shuffled by the bitmap's number.
    """
    bits = [F.expr(f"bitmap_construct_agg(bitmap_bit_position(uid)) filter (where mark & {1 << p} > 0)").alias(f"_bits{p}") for p in range(planes)]
    maps = scratch.table(marks.groupBy(F.bitmap_bucket_number("uid").alias("_b")).agg(*bits))
    if maps.count() * planes * 4096 <= BROADCAST_BITMAPS:
        maps = F.broadcast(maps)
    byte = "conv(hex(substring(_bits{p}, cast(bitmap_bit_position(uid) div 8 + 1 as int), 1)), 16, 10)"
    mark = " + ".join(f"{1 << p} * (({byte.format(p=p)} div cast(pow(2, bitmap_bit_position(uid) % 8) as int)) % 2)" for p in range(planes))
    joined = rows.join(maps, F.bitmap_bucket_number("uid") == F.col("_b"))
    return joined.select(*rows.columns, F.expr(f"cast({mark} as int)").alias(name)).where(F.col(name) > 0)
