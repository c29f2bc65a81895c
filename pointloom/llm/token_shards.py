"""Operator 4: token ids in training order, as binary shards of fixed stride."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.bpe import VOCABULARY, _utf8, codec
from pointloom.llm.common import Scratch, feistel, give_back

#: A record ends with one more byte, the line feed that Spark's text writer puts between rows.
RECORD_END = 1
#: Tasks that write at most; each has a range of shards.
MOST_TASKS = 20_000
#: Bytes of pre-tokens that a worker remembers, about, from one task to the next.
REMEMBERED = 128 << 20
#: The shards are written in so many ranges, one after the other, so that only one range's sequences lie in shuffle files.
WAVES = 2
#: Lets Spark delete a write's shuffle files when it is done.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Layout(NamedTuple):
    """Where a slot lies: record ``slot mod slots_per_shard`` of shard ``slot div slots_per_shard``, ``stride`` ids of ``width`` bytes and RECORD_END each."""

    stride: int
    slots_per_shard: int
    width: int
    end: int  # id that ends a text
    pad: int  # id that fills up a sequence

    @property
    def record(self) -> int:
        return self.stride * self.width + RECORD_END


def layout(vocabulary: str | None = None, stride: int = 1024, slots_per_shard: int = 16_384) -> Layout:
    """The layout for a rank file: the two ids after its last one end a text and fill up; ids take two bytes where all fit, else four."""
    last = max(codec(vocabulary or public_tokenizers.path(VOCABULARY)).pieces)
    return Layout(stride, slots_per_shard, 2 if last + 2 < 1 << 16 else 4, last + 1, last + 2)


def token_rows(docs: DataFrame, how: Layout, vocabulary: str) -> DataFrame:
    """(doc_id, part, start, n, ids): the ids of each text and its end as little-endian unsigned integers.

    ``part`` is the task that encoded the text and ``start`` its first id's place among the part's ids.
    The rows must be written once; all that follows reads part and start from there, whatever the splits of that read are.
    """
    kind, end = f"<u{how.width}", how.end.to_bytes(how.width, "little")

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part, used = codec(vocabulary), TaskContext.get().partitionId(), 0
        for b in it:
            starts, counts, ids = [], [], []
            for x in c.encode_many(map(_utf8, b.column("text")), REMEMBERED):
                starts.append(used)
                counts.append(len(x) // 4 + 1)
                ids.append((x if how.width == 4 else np.frombuffer(x, "<u4").astype(kind).tobytes()) + end)
                used += counts[-1]
            cols = [b.column("doc_id"), pa.array([part] * len(ids), pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "part", "start", "n", "ids"])
        # the next task of this worker meets the same words
        give_back()

    small = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return small.mapInArrow(encode, "doc_id bigint, part bigint, start bigint, n bigint, ids binary")


def _div(x: Column, k: int) -> Column:
    return F.call_function("div", x, F.lit(k).cast("bigint"))


def place_pieces(tokens: DataFrame, bases: DataFrame, total: int, how: Layout, key: int) -> DataFrame:
    """(doc_id, piece, slot, shard, at, n_tokens, ids): a text has a piece for each sequence that it reaches into, ``at`` being its first token's place there.

    A part's ids, one text after the other, are cut every ``stride`` tokens; sequences are numbered by part and place, and a number's image under a keyed
    Feistel permutation of all of them (cycle walking) is the slot.
    """
    s, start, n = how.stride, F.col("start"), F.col("n")
    # one row for each task that encoded, so the size is bounded by their number
    t = tokens.join(F.broadcast(bases), "part")
    t = t.select("doc_id", "base", "start", "n", "ids", F.posexplode(F.sequence(_div(start, s), _div(start + n - 1, s))).alias("piece", "q"))
    low, high = F.greatest(F.col("q") * s, start), F.least((F.col("q") + 1) * s, start + n)
    part = F.substring(F.col("ids"), ((low - start) * how.width + 1).cast("int"), ((high - low) * how.width).cast("int"))
    t = t.select("doc_id", F.col("piece").cast("bigint").alias("piece"), feistel(F.col("base") + F.col("q"), total, key).alias("slot"), (low - F.col("q") * s).alias("at"), (high - low).alias("n_tokens"), part.alias("ids"))
    return t.select("doc_id", "piece", "slot", _div(F.col("slot"), how.slots_per_shard).alias("shard"), "at", "n_tokens", "ids")


def _assembled(pieces: DataFrame, first: int, end: int, how: Layout) -> DataFrame:
    """(shard, value): the sequences of the shards from ``first`` to ``end`` (not included) in the order of their slots; a range of shards a task."""
    tasks = min(end - first, MOST_TASKS)
    fill = how.pad.to_bytes(how.width, "little")

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, shard, parts = None, None, []
        size = how.stride * how.width
        for b in it:
            out: tuple[list, list] = ([], [])
            for k, s, x in zip(b.column("slot").to_pylist(), b.column("shard").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if k != slot:
                    if parts:
                        out[0].append(shard)
                        out[1].append(b"".join(parts))
                    slot, shard, parts = k, s, []
                parts.append(x)
            yield rows(out, size)
        if parts:
            yield rows(([shard], [b"".join(parts)]), size)

    def rows(out: tuple[list, list], size: int) -> pa.RecordBatch:
        whole = [x if len(x) == size else x + fill * ((size - len(x)) // how.width) for x in out[1]]
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(whole, pa.binary())], ["shard", "value"])

    ranged = pieces.select("shard", "slot", "at", "ids").repartitionById(tasks, _div((F.col("shard") - first) * tasks, end - first).cast("int"))
    return ranged.sortWithinPartitions("shard", "slot", "at").select("shard", "slot", "ids").mapInArrow(join, "shard bigint, value binary")


def write_shards(docs: DataFrame, path: str, stride: int = 1024, slots_per_shard: int = 16_384, key: int = 11, vocabulary: str | None = None) -> DataFrame:
    """Writes ``path``/shard=<k>/ with one file each and returns where every piece of every document went, without the ids:
    doc_id, piece, slot, shard, byte_offset, n_tokens, crc32 (of the piece's bytes).

    Texts are encoded once, by operator 8's codec. A sequence has ``stride`` ids; only the last of each part is filled up. Slots are dealt to the writing tasks by ranges,
    so every shard is written by one task, in order, and all but the last have equal sizes, whatever the documents' keys or lengths are.
    A reader that knows its last slot goes on with one seek (``stream_slots``). The same files and the same splits of the first read give the same shards.

    A null or empty text is its end alone; a null doc_id is kept; columns besides doc_id and text don't matter; an empty table writes nothing.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    how, scratch = layout(vocabulary, stride, slots_per_shard), Scratch(spark)
    tokens = scratch.table(token_rows(docs, how, vocabulary))
    counts = tokens.groupBy("part").agg(F.ceil(F.max(F.col("start") + F.col("n")) / F.lit(stride)).cast("bigint").alias("s"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch.table(counts.select("part", "s", F.coalesce(F.sum("s").over(ahead), F.lit(0)).cast("bigint").alias("base")))
    total = int(bases.agg(F.sum("s")).first()[0] or 0)
    pieces = place_pieces(tokens, bases.select("part", "base"), max(total, 1), how, key)
    if total:
        shards = -(-total // slots_per_shard)
        before = spark.conf.get(_CLEAN, None)
        spark.conf.set(_CLEAN, "true")
        try:
            for w in range(min(WAVES, shards)):
                first, end = shards * w // min(WAVES, shards), shards * (w + 1) // min(WAVES, shards)
                rows = _assembled(pieces.where(F.col("shard").between(first, end - 1)), first, end, how)
                rows.select("shard", F.col("value").cast("string").alias("value")).write.mode("append" if w else "error").partitionBy("shard").option("lineSep", "\n").text(path)
        finally:
            spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
        written = _files(spark, path).agg(F.sum("length")).first()[0]
        if written != total * how.record:
            raise RuntimeError(f"{path} holds {written} bytes, {total * how.record} were to be written")
    offset = F.col("slot") % slots_per_shard * how.record + F.col("at") * how.width
    return pieces.select("doc_id", "piece", "slot", "shard", offset.alias("byte_offset"), "n_tokens", F.crc32("ids").alias("crc32"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)


def read_shards(spark: SparkSession, path: str, how: Layout, first_slot: int = 0) -> DataFrame:
    """(slot, payload) of all slots from ``first_slot`` on; shards before it aren't opened. A shard's size is bounded by the layout."""
    files = _files(spark, path).where(F.col("shard") >= first_slot // how.slots_per_shard).select(F.col("shard").cast("bigint").alias("shard"), "content")
    at = F.sequence(F.lit(0), (F.octet_length("content") / how.record).cast("int") - 1)
    rows = files.select((F.col("shard") * how.slots_per_shard).alias("_b"), "content", F.explode(at).alias("_i"))
    return rows.select((F.col("_b") + F.col("_i")).alias("slot"), F.substring("content", F.col("_i") * how.record + 1, F.lit(how.record - RECORD_END)).alias("payload")).where(F.col("slot") >= first_slot)


def stream_slots(spark: SparkSession, path: str, how: Layout, first_slot: int = 0, records: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) one after the other from ``first_slot`` on: one seek into its shard, then sequential reads of ``records`` records, from any store that Hadoop reads."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    shard, skip = divmod(first_slot, how.slots_per_shard)
    while fs.exists(folder := jvm.org.apache.hadoop.fs.Path(at, f"shard={shard}")):
        file = next(s for s in fs.listStatus(folder) if s.getPath().getName().endswith(".txt"))
        left, slot = file.getLen() // how.record - skip, shard * how.slots_per_shard + skip
        stream = fs.open(file.getPath())
        try:
            stream.seek(skip * how.record)
            while left > 0:
                n = min(left, records)
                raw = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n * how.record))
                for k in range(n):
                    yield slot + k, np.frombuffer(raw, f"<u{how.width}", how.stride, k * how.record)
                slot, left = slot + n, left - n
        finally:
            stream.close()
        shard, skip = shard + 1, 0


def materialise_documents(docs: DataFrame, path: str | None = None, stride: int = 1024, slots_per_shard: int = 16_384, key: int = 11) -> DataFrame:
    """Writes all documents as shards to ``path`` (by default a folder of their own in the shared one); returns where each piece went, with its CRC."""
    return write_shards(docs, path or Scratch(docs.sparkSession).base + "/shards", stride, slots_per_shard, key)
