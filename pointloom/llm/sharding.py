"""Operator 7: sharding by a keyed permutation of global row numbers (SQL functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import Scratch, feistel, with_row_number


def shard_rows(df: DataFrame, order_by: list, shards: int, key: int, scratch: Scratch | None = None) -> DataFrame:
    """Adds ``shard`` and ``slot``: a reproducible shuffle of all rows into ``shards`` shards whose counts differ by one at most.

    Rows are numbered in the order of ``order_by``; the number's image p under a Feistel permutation of
    0..n-1 (cycle walking) gives shard p mod shards and slot p div shards, so both can be computed
    from a row number alone, and slots are gapless from 0.

    Nulls sort first. Rows equal in all of ``order_by`` are interchangeable: which of them gets
    which slot is not defined. An empty table gives an empty result. Columns of ``df`` named shard or slot are replaced.
    """
    scratch = scratch or Scratch(df.sparkSession)
    rest = df.drop("shard", "slot")
    numbered = with_row_number(rest, order_by, "_rn", scratch)
    n = numbered.count()
    at = numbered.withColumn("_p", feistel(F.col("_rn"), n, key))
    return at.select(*rest.columns, F.pmod("_p", F.lit(shards)).cast("int").alias("shard"), F.call_function("div", F.col("_p"), F.lit(shards).cast("bigint")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, key: int = 20240607) -> DataFrame:
    """Documents in shards under the law ``rows``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has no bytes: size 1, CRC 0. A null doc_id is kept. Only ids, sizes and two hashes are shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    small = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_h"))
    # written first: numbering samples its input, which would hash every text twice
    scratch = Scratch(docs.sparkSession)
    out = shard_rows(scratch.table(small), [F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.col("_h")], shards, key, scratch)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
