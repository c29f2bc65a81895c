"""The corpus operators against brute force, round trips and edge cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from pointloom.llm import bpe, pii, quality_model, quality_rules, repeats, simhash, token_shards
from pointloom.llm.common import Scratch, feistel, with_row_number
from pointloom.llm.mixing import mix, mix_documents
from pointloom.llm.sharding import shard_documents
from pointloom.llm.topk import search_embeddings

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, _h string"


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing names."""
    path = str(tmp_path_factory.mktemp("edge") / "d")
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None, "en", "a", None, "s", "h"), (2, "", "en", None, 0, None, None), (3, " \t\n", None, "b", 3, "", ""), (None, "null id text of some words here", "en", "b", 1, "x", "y"),
            (4, long, "en", "a", len(long), "", ""), (5, "one two three", "en", "c", 13, "", ""), (6, "the same text in two rows with many words in it, is it not", "en", "c", 1, "", ""),
            (6, "the same text in two rows with many words in it, is it not", "en", "c", 1, "", ""), (7, "The Same text in two rows with many words in it, is it not", "en", "a", 1, "", ""), (8, "é" * 300, "fr", "a", 300, "", "")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def both(docs, edge):
    return [(d, [tuple(r) for r in d.select("doc_id", "text").collect()]) for d in (docs, edge)]


def test_feistel_is_a_permutation(spark):
    for n in (1, 2, 3, 7, 100, 1023):
        assert sorted(r[0] for r in spark.range(n).select(feistel(F.col("id"), n, 9)).collect()) == list(range(n))


def test_row_numbers_follow_the_order_and_split_repeated_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("a"))
    got = with_row_number(df, [F.col("a")], "rn", Scratch(spark)).orderBy("rn").collect()
    assert [r.rn for r in got] == list(range(1000)) and [r.a for r in got] == sorted(r.a for r in got)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_fingerprint(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(s), 42) for s in ([w[i : i + 4] for i in range(len(w) - 3)] or [w])]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash(docs, edge):
    for df, rows in both(docs, edge):
        got = sorted(map(repr, map(tuple, simhash.deduplicate_documents(df).collect())))
        fp = [brute_fingerprint(t) for _, t in rows]
        comp = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                if (fp[i] ^ fp[j]).bit_count() <= 4:
                    a, b = comp[i], comp[j]
                    comp = [min(a, b) if c in (a, b) else c for c in comp]
        least = {c: min((r[0] for r, k in zip(rows, comp, strict=True) if k == c and r[0] is not None), default=None) for c in comp}
        assert got == sorted(map(repr, [(r[0], f"{f:016x}", least[c]) for r, f, c in zip(rows, fp, comp, strict=True)]))
        assert simhash.deduplicate_documents(df.limit(0)).count() == 0


def test_long_text_is_fingerprinted_in_blocks(monkeypatch):
    t = " ".join(random.Random(1).choices(["aa", "Bcd", "é", "efghij"], k=5000))
    want = brute_fingerprint(t)
    monkeypatch.setattr(simhash, "_CHARS", 97)
    monkeypatch.setattr(simhash, "_HASHES", 50)
    assert simhash.fingerprint(t.encode()) == want


def test_tiles_find_all_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    near = base[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    every = np.unique(np.concatenate((base, near)))
    a, b = simhash.link_tiles(every[:, None], None)
    assert len(a) == 200 and (np.bitwise_count(every[a] ^ every[b]) <= 4).all()
    a, _ = simhash.link_tiles(np.unique(base)[:, None], np.setdiff1d(near, base)[:, None])
    assert len(a) >= 200
    wide = np.stack((every, every[::-1]), 1)
    size = np.arange(len(every)) % 50 + 1
    want = {j for j in range(len(wide)) for i in range(j) if np.bitwise_count(wide[i] ^ wide[j]).sum() <= 48 and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j])}
    moved, _ = simhash.link_tiles(wide, None, 48, size, None, (4, 5))
    assert len(want) > 20 and set(moved.tolist()) >= want


def test_quality_rules(docs, edge, labels):
    for df, rows in both(docs, edge):
        got = {}
        for r in quality_rules.judge_documents(df, labels).collect():
            got.setdefault(r.doc_id, []).append(r)
        for i, t in rows:
            w = words(t)
            five = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
            hit = {p for k in range(len(w) - 4) if five[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
            lines = [x for x in (t or "").split("\n") if words(x)]
            want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
            r = got[i][0]
            assert tuple(r)[1:6] == want and r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
            assert not (r.kept and r.base_failed)
        assert quality_rules.judge_documents(df, labels.limit(0)).where("kept = base_failed").count() == 0
    assert quality_rules.judge_documents(docs.limit(0), labels).count() == 0


def test_quality_rules_keep_trusted_and_drop_junk(spark):
    d = "/root/testdata/sf0.01"
    got = quality_rules.judge_documents(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    rate = {r.quality: r.k for r in got.where("n_words >= 10 and not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rate[1] > 0.98 and rate[0] < 0.2


def test_top_k(spark):
    rows = [(i, [((i * 7919 + j * 104729) % 200 - 100) / 64 for j in range(8)]) for i in range(1, 700)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1100, None), (1200, [None] * 8), (1300, [float("nan")] * 8), (1400, [1.0, 2.0]), (1500, []), (1501, []), (None, rows[0][1])]
    got = {}
    for r in search_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    fine = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and len(v) == 8 and v[0] is not None and v[0] == v[0]]
    for q, v in fine:
        if q % 100 == 0:
            best = sorted((-int(v @ x), i) for i, x in fine if i != q)[:10]
            assert sorted(got.pop(q)) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == {1500: [(1, 1501, 0)]}


def test_token_shards(spark, docs, edge, reference_bpe, tmp_path):
    _, theirs = reference_bpe
    how = token_shards.layout(None, 64, 100)
    assert (how.width, how.end, how.pad, how.record) == (2, 50256, 50257, 129)
    for k, (df, rows) in enumerate(both(docs, edge)):
        path = f"{tmp_path}/{k}"
        placed = token_shards.write_shards(df, path, 64, 100).collect()
        read = {r.slot: np.frombuffer(bytes(r.payload), "<u2") for r in token_shards.read_shards(spark, path, how).collect()}
        assert sorted(read) == list(range(len(read))) and {r.slot for r in placed} == set(read)
        found, used = {}, Counter()
        for r in sorted(placed, key=lambda r: (str(r.doc_id), r.piece)):
            at = (r.byte_offset - r.slot % 100 * how.record) // 2
            part = read[r.slot][at : at + r.n_tokens]
            assert zlib.crc32(part.tobytes()) == r.crc32 and r.shard == r.slot // 100
            found[r.doc_id] = found.get(r.doc_id, []) + part.tolist()
            used[r.slot] += r.n_tokens
        texts = Counter(i for i, _ in rows)
        for i, t in rows:
            if texts[i] == 1:
                assert found[i] == [*theirs.encode_ordinary(t or ""), how.end]
        assert sum(map(len, found.values())) == sum(len(theirs.encode_ordinary(t or "")) + 1 for _, t in rows)
        assert all((read[s][n:] == how.pad).all() for s, n in used.items())
        # fixed stride: whole files of whole records, one for each shard
        sizes = {int(re.search(r"shard=(\d+)", str(f))[1]): f.stat().st_size for f in (tmp_path / str(k)).rglob("*.txt")}
        assert sizes == {s: how.record * min(100, len(read) - 100 * s) for s in range(-(-len(read) // 100))}
        late = token_shards.read_shards(spark, path, how, first_slot=150).collect()
        assert sorted(r.slot for r in late) == list(range(150, len(read)))
        streamed = list(token_shards.stream_slots(spark, path, how, 150, 7))
        assert [s for s, _ in streamed] == list(range(150, len(read))) and all((x == read[s]).all() for s, x in streamed)
    assert token_shards.write_shards(docs.limit(0), f"{tmp_path}/none", 64, 100).collect() == []


def test_token_shards_do_not_follow_the_splits_of_later_reads(spark, docs, tmp_path):
    try:
        seen = []
        for cores in (2, 16):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
            placed = token_shards.write_shards(docs.coalesce(1), f"{tmp_path}/{cores}", 64, 100)
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", 18 - cores)
            seen.append(sorted(map(tuple, placed.collect())))
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert seen[0] == seen[1] and {r[0] for r in seen[0]} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pseudonyms(edge):
    key = b"k"
    f = pii.Feistel(1000, b"x" * 32)
    assert sorted(f.pseudonym(i) for i in range(1000)) == list(range(1000))
    assert all(f.pseudonym(i) != i and f.original(f.pseudonym(i)) == i for i in range(1000))
    for s in ("4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "192.168.0.1", "078-05-1120", "+1 (743) 555-3824", "2024-02-29", "31/12/1999", "bob.19@mail5.example.com", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'):
        new, found = pii.pseudonymise(f"see {s}, then {s}!", key)
        assert sum(found.values()) == 2 and s not in new and len(new) == len(f"see {s}, then {s}!") or "." in s
        m = re.fullmatch(r"see (.*), then (.*)!", new)
        assert m[1] == m[2] != s
        assert pii.pseudonymise(m[1], key)[1] == pii.pseudonymise(s, key)[1]
    for s in ("1234567812345678", "version 1.2.3.4.5", "999.1.1.1", "13/32/2000", "plain words", "a@b", "000-12-3456"):
        assert pii.pseudonymise(s, key) == (s, {})
    days = [f"{y}-{m:02d}-{d:02d}" for y in (1999, 2000) for m in range(1, 13) for d in range(1, 29)]
    assert len({pii.pseudonymise(x, key)[0] for x in days}) == len(days)
    out = pii.pseudonymise_documents(edge, "k")
    assert out.count() == edge.count() and out.columns[: len(edge.columns)] == edge.columns
    assert sorted(map(repr, out.select("doc_id", "text").collect())) == sorted(map(repr, edge.select("doc_id", "text").collect()))


def test_mixing(spark, docs, edge):
    for df, rows in both(docs, edge):
        got = mix_documents(df).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, mix_documents(df).collect()))
        assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size and r.taken == r.size * r.copies for r in got)
        total = sum(len(words(t)) for _, t in rows)
        by = {}
        for r in df.select("source", "text").collect():
            by[r.source] = by.get(r.source, 0) + len(words(r.text))
        names = sorted(by, key=lambda s: (s is None, s or ""))
        weight, target, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, total
        while len(target) < len(names):
            open_ = [s for s in names if s not in target]
            over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * by[s]]
            if not over:
                target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            for s in over:
                target[s] = 3.0 * by[s]
            left = total - sum(target[s] for s in over) if len(over) == len(target) else left - sum(target[s] for s in over)
        want = sorted((by[r.source], round(target[r.source], 4)) for r in df.select("source").collect())
        assert sorted((r.source_size, round(r.target, 4)) for r in got) == want
    larger = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df in (docs, larger):
        sources = {r.doc_id: r.source for r in df.select("doc_id", "source").collect()}
        taken, aim, largest = Counter(), {}, Counter()
        for r in mix_documents(df).collect():
            s = sources[r.doc_id]
            taken[s] += r.taken
            aim[s] = r.target
            largest[s] = max(largest[s], r.size)
        # ten documents a source can't come closer than one of them; fifty can
        assert all(abs(taken[s] - aim[s]) <= (0.03 * aim[s] if df is larger else largest[s]) for s in aim)
    assert mix(docs).columns == docs.columns and mix(docs).count() == sum(r.copies for r in mix_documents(docs).collect())
    assert mix_documents(docs.limit(0)).count() == 0


def test_sharding(docs, edge):
    for df, rows in both(docs, edge):
        got = shard_documents(df).collect()
        want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
        for s in {r.shard for r in got}:
            own = sorted(r.slot for r in got if r.shard == s)
            assert own == list(range(len(own)))
        n = Counter(r.shard for r in got)
        assert max(n.values()) - min(n.get(k, 0) for k in range(8)) <= 1
        assert sorted(map(repr, got)) == sorted(map(repr, shard_documents(df.repartition(2)).collect()))
    assert shard_documents(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def reference_bpe():
    path = public_tokenizers.path(bpe.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return bpe.Codec(path), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(reference_bpe):
    ours, theirs = reference_bpe
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab' \n\t\x1c\x85　éh中½²_1٣😀the", k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 500, "ab" * 900, "the" * 400, "".join(rng.choices("aeonti", k=3000)), "", "<|endoftext|>"]
    for t, ids in zip(texts, ours.encode_many(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(t)
        assert ours.decode(ids) == t.encode()


def test_bpe_query(docs, edge, reference_bpe):
    _, theirs = reference_bpe
    for df, rows in both(docs, edge):
        want = []
        for i, t in rows:
            ids = np.array(theirs.encode_ordinary(t or ""), "<u4")
            want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert sorted(map(repr, map(tuple, bpe.encode_digests(df).collect()))) == sorted(map(repr, want))
    back = bpe.decode(bpe.encode(edge))
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())


def brute_repeats(texts):
    seen = Counter(r[i : i + 200] for r in texts for i in range(len(r) - 199))
    for r in texts:
        hit = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                hit[i : i + 200] = True
        edges = np.diff(np.concatenate(([0], hit.astype(np.int8))))
        yield len(r), int(hit.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~hit[:-1]])).hexdigest()


@pytest.mark.parametrize("hot", [False, True])
def test_repeats(spark, docs, edge, tmp_path, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(repeats, "BUCKET", 40)
        monkeypatch.setattr(repeats, "HOT", 10)
    rng = random.Random(3)
    w = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared = [w(n) for n in (199, 200, 201, 250, 300, 700, 3000)]
    texts = [w(50) + p + w(40) for p in shared for _ in range(20 if hot else 3)] + shared + ["a" * 700, "ab" * 300, "x" * 200, "x" * 200, shared[3] + w(5) + shared[3], shared[4][:260] + w(300) + shared[4][60:]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    for df in (spark.read.parquet(f"{tmp_path}/d"), docs, edge):
        rows = df.select("doc_id", "text").collect()
        want = [(r.doc_id, *x) for r, x in zip(rows, brute_repeats([(r.text or "").encode() for r in rows]), strict=True)]
        assert sorted(map(repr, map(tuple, repeats.remove_repeats(df).collect()))) == sorted(map(repr, want))


def test_anchors_in_blocks(monkeypatch):
    raw = bytes(random.Random(5).choices(range(97, 102), k=5000)) + b"a" * 900
    want = [x.tolist() for x in repeats.anchors(raw)]
    monkeypatch.setattr(repeats, "BLOCK", 333)
    own = lambda v: [a for a, f, last in zip(*v, strict=True) for _ in range(f, last + 1)]
    assert own([x.tolist() for x in repeats.anchors(raw)]) == own(want)


def test_quality_model(spark, docs, edge):
    d = "/root/testdata/sf0.01"
    got = quality_model.classify(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    held = Counter((r.quality, r.kept) for r in got)
    assert held[1, True] > 0.97 * (held[1, True] + held[1, False]) and held[0, False] > 0.9 * (held[0, True] + held[0, False])
    out = quality_model.classify(edge).collect()
    assert len(out) == edge.count() and not any(r.kept for r in out if r.doc_id in (1, 2, 3))
    assert quality_model.classify(docs.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = DATA
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, rows = docs.columns, docs.count()
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert name == "byte_bpe" or docs.columns == before
        if name == "simhash_dedup":
            assert simhash.deduplicate_documents(docs).select("component_id").distinct().count() == docs.count() <= rows
    got = sorted(map(tuple, docs.collect()))
    assert got == sorted(map(tuple, corpus_pipeline.run(spark, d).collect()))
