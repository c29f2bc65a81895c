"""Operators against versions written apart: permutations, log ratios, wide vocabularies, repeated ids, overflow; the pipeline's stages on edge tables."""

import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import tiktoken
import xxhash

import corpus_pipeline
from pointloom.llm import bpe, quality_rules, topk
from pointloom.llm.common import Scratch, shared_dir
from pointloom.llm.sharding import shard_documents

DATA = "/root/testdata/sf0.001"


def spark_hash(*values):
    """xxhash64 of strings, ints and longs as Spark chains it."""
    seed = 42
    for kind, v in values:
        raw = v.encode() if kind == "s" else struct.pack("<i" if kind == "i" else "<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_shards_follow_the_permutation(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    n, key = len(rows), 20240607
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def image(x):
        while True:
            u, w = divmod(x, b)
            for r in range(6):
                radix = a if r % 2 == 0 else b
                u, w = w, (u + spark_hash(("l", key), ("i", r), ("l", w)) % radix) % radix
            x = u * b + w
            if x < n:
                return x

    want = {i: (image(k) % 8, image(k) // 8, zlib.crc32(t.encode())) for k, (i, t) in enumerate(rows)}
    assert {r.doc_id: (r.shard, r.slot, r.text_crc32) for r in shard_documents(docs).collect()} == want


def test_log_ratios_and_verdicts(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0}
    token = regex.compile(r"[^\p{L}\p{N}\x20\x09-\x0D]|[\p{L}\p{N}]+")
    grams, raw, good = {}, Counter(), Counter()
    for r in docs.select("doc_id", "text").collect():
        h = [spark_hash(("s", t)) for t in token.findall(r.text or "")]
        g = [x & 65535 for x in h] + [spark_hash(("l", x), ("l", y)) & 65535 for x, y in zip(h, h[1:])]
        grams[r.doc_id] = g
        raw.update(g)
        if r.doc_id in trusted:
            good.update(g)
    share = sum(good.values()) / sum(raw.values())
    w = {k: math.log((good[k] + 4) / (raw[k] * share + 4)) for k in raw}
    for r in quality_rules.judge_documents(docs, labels).collect():
        g = grams[r.doc_id]
        llr = sum(w[k] for k in g) / len(g) if g else 0.0
        assert abs(r.llr - llr) < 1e-6 and (abs(llr + 0.2) < 1e-6 or r.kept == (not r.base_failed and llr >= -0.2))


def test_a_vocabulary_of_more_than_16_bits(tmp_path):
    """Ids above 65,535 take part in merges; the library gives the same ids."""
    letters = "abcdefgh"
    words = [bytes([c]) for c in range(256)]
    two = [(x + y).encode() for x in letters for y in letters]
    four = [x + y for x in two for y in two]
    filler = [b"\xff" + struct.pack(">I", k) for k in range(70_000)]
    some = random.Random(1).sample(four, 3000)
    eight = [x + y for x, y in zip(some, reversed(some))]
    ranks = {w: k for k, w in enumerate(dict.fromkeys([*words, *two, *filler[:65_400], *some, *eight, *filler[65_400:]]))}
    import base64

    path = tmp_path / "wide.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(w) + b" %d\n" % k for w, k in ranks.items()))
    pattern = r"\S+|\s+"
    ours = bpe.Codec(str(path), pattern)
    theirs = tiktoken.Encoding("wide", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(rng.choices(letters, k=rng.randrange(1, 40))) for _ in range(300)] + [x.decode() * 9 for x in eight[:50]]
    got = [np.frombuffer(x, "<u4").tolist() for x in ours.encode_many(texts)]
    assert got == [theirs.encode_ordinary(t) for t in texts] and max(map(max, got)) > 65_535


def test_stores_that_overflow_within_a_text(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path(bpe.VOCABULARY)
    rng = random.Random(4)
    texts = ["", " ".join("".join(rng.choices("abcdé", k=9)) for _ in range(3000)), "x " * 50, "", "y" * 300_000]
    want = list(bpe.Codec(path).encode_many(texts))
    monkeypatch.setattr(bpe, "REMEMBERED", 20_000)
    monkeypatch.setattr(bpe, "MERGED_TOGETHER", 500)
    monkeypatch.setattr(bpe, "TOGETHER", 2_000)
    c = bpe.Codec(path)
    monkeypatch.setattr(type(c), "_pieces", lambda self, t: (tuple(x) for x in bpe.batched((m[0] for m in self.split.finditer(t)), 20)))
    assert list(c.encode_many(texts)) == want


def search(spark, rows):
    got = {}
    for r in topk.search_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in got.items()}


def test_top_k_large_components_are_exact_or_refused(spark):
    rows = [(100, [3e5, 1.0]), (1, [2e5, 0.0]), (2, [3e5, 0.0]), (3, [4e5, 0.5])]
    v = {i: [math.floor(1024 * x) for x in e] for i, e in rows}
    want = sorted((-sum(a * b for a, b in zip(v[100], v[i])), i) for i in (1, 2, 3))
    assert search(spark, rows) == {100: [(k + 1, i, -s) for k, (s, i) in enumerate(want)]}
    with pytest.raises(OverflowError):
        search(spark, [*rows, (4, [4e9, 0.0])])


def test_top_k_leaves_out_the_query_row_alone(spark):
    got = search(spark, [(100, [1.0, 2.0]), (100, [3.0, 1.0]), (7, [1.0, 1.0])])
    # each row of the repeated id is the other's candidate: 5 * 2**20 both ways
    assert [(r, i) for r, i, _ in got[100]] == [(1, 100), (1, 100), (2, 7), (2, 7)] and {s for _, i, s in got[100] if i == 100} == {5 << 20}


def test_top_k_over_several_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "GROUP", 2)
    monkeypatch.setattr(topk, "PACK", 4)
    monkeypatch.setattr(topk, "PIVOTS", 5)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(5, 6)) * 20
    x = (centre[rng.integers(0, 5, 900)] + rng.normal(size=(900, 6))).round(3)
    rows = [(i * 4, x[i].tolist()) for i in range(900)]
    v = np.floor(1024 * x).astype(np.int64)
    got = search(spark, rows)
    for i in range(0, 900, 25):
        s = v @ v[i]
        best = sorted((-int(s[j]), j * 4) for j in range(900) if j != i)[:10]
        assert got[i * 4] == [(k + 1, j, -t) for k, (t, j) in enumerate(best)]
    assert len(got) == 36
    assert topk.search_embeddings(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


EDGE = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_date int, _d string, uid long, copies string"


def test_stages_on_edge_tables(spark, tmp_path):
    prose = " ".join(r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 3").select("text").collect())[:4000]
    rows = [(1, None, "en", "a", None, "k", 1, "d", 1, "c"), (2, "", None, None, 0, None, None, None, None, None), (None, prose, "en", "b", 5, "", 2, "", 2, ""), (3, prose, "en", "b", 5, "k", 2, "x", 2, "y"),
            (3, prose, "en", "b", 5, "k", 2, "x", 2, "y"), (4, prose + " on 2024-03-05 there", "en", "c", 5, "k", 2, "x", 2, "y"), (5, " \n\t", "en", "a", 3, "k", 2, "x", 2, "y")]
    spark.createDataFrame(rows, EDGE).repartition(2).write.parquet(f"{tmp_path}/e")
    spark.createDataFrame([], EDGE).write.parquet(f"{tmp_path}/none")
    edge, none = spark.read.parquet(f"{tmp_path}/e"), spark.read.parquet(f"{tmp_path}/none")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).collect() == []
        out = stage(spark, edge, DATA)
        got = out.collect()
        if name != "byte_bpe":
            assert out.columns == edge.columns and [f.dataType for f in out.schema] == [f.dataType for f in edge.schema]
        ids = sorted((r.doc_id for r in got), key=str)
        if name == "simhash_dedup":
            assert len(got) == 2 and {r.doc_id for r in got} == {1, 3}
            assert {tuple(r) for r in got} <= set(rows)
        if name == "pseudonyms":
            new = next(r for r in got if r.doc_id == 4)
            assert len(got) == 7 and "2024-03-05" not in new.text and new.n_chars == len(new.text) and (new.n_date, new.kept) == (2, "k")
            assert {r for r in map(tuple, got) if r[0] in (1, 2)} == {r for r in rows if r[0] in (1, 2)}
        if name == "mixing":
            assert not {1, 2, 5} & set(ids)
        if name == "byte_bpe":
            assert ids == sorted((r[0] for r in rows), key=str)


def test_a_machine_local_scratch_folder_is_refused(spark):
    class Unset:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            applicationId = "x"

            class _jsc:
                class sc:
                    class getCheckpointDir:
                        isDefined = staticmethod(lambda: False)

    Unset.sparkContext.master = "spark://far:7077"
    with pytest.raises(RuntimeError):
        shared_dir(Unset)
    Unset.sparkContext.master = "local[2]"
    assert shared_dir(Unset).startswith("file:///")
    s = Scratch(spark)
    t = s.table(spark.range(3))
    assert t.count() == 3
    s.close()
