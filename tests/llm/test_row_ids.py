"""Rows keep their numbers when a scan is split otherwise."""

from pyspark.sql import functions as F

from pointloom.llm.common import Scratch, with_marks, with_uid


def test_uid_does_not_follow_the_splits(spark, tmp_path):
    spark.range(60_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).repartition(6).write.option("parquet.block.size", 200_000).parquet(f"{tmp_path}/d")
    docs, scratch, seen = spark.read.parquet(f"{tmp_path}/d"), Scratch(spark), []
    try:
        for cores in (12, 5, 1):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
            rows = with_uid(docs, ["doc_id"], scratch)
            seen.append({r.doc_id: r.uid for r in rows.collect()})
            if cores == 12:
                marks = scratch.table(rows.where("doc_id % 7 = 3").select("uid", F.lit(1).alias("mark")))
        marked = with_marks(with_uid(docs, ["doc_id"], scratch), marks, scratch)
        assert {r.doc_id for r in marked.collect()} == set(range(3, 60_000, 7))
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert seen[0] == seen[1] == seen[2] and len(set(seen[0].values())) == 60_000


def test_input_without_files_is_numbered_once(spark):
    rows = with_uid(spark.range(100).repartition(3), ["id"], Scratch(spark))
    assert len({r.uid for r in rows.collect()}) == 100 and rows.collect() == rows.collect()


def test_shards_written_in_waves_are_the_same(spark, tmp_path, monkeypatch):
    from pointloom.llm import token_shards

    docs = spark.createDataFrame([(i, f"word{i} and some more {i * 7} " * 20) for i in range(120)], "doc_id bigint, text string").repartition(3, "doc_id").sortWithinPartitions("doc_id")
    assembled, ranges, found = token_shards._assembled, [], []
    monkeypatch.setattr(token_shards, "_assembled", lambda pieces, first, end, how: ranges.append((first, end)) or assembled(pieces, first, end, how))
    for waves in (1, 2):
        monkeypatch.setattr(token_shards, "WAVES", waves)
        rows = token_shards.write_shards(docs, f"{tmp_path}/{waves}", 64, 40)
        files = {f.parent.name: f.read_bytes() for f in sorted(tmp_path.glob(f"{waves}/shard=*/*.txt"))}
        found.append((files, sorted(map(tuple, rows.collect()))))
    assert found[0] == found[1] and len(found[0][0]) > 2
    assert ranges[0] == (0, ranges[2][1]) and ranges[1][1] == ranges[2][0]
