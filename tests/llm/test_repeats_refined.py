"""Repeated strings around anchors that very many contexts share."""

import hashlib
import random

import numpy as np

from pointloom.llm import repeats
from pointloom.llm.common import Scratch, with_uid


def brute(texts):
    seen = {}
    for d, t in enumerate(texts):
        for k in range(len(t) - 199):
            seen.setdefault(t[k : k + 200], []).append((d, k))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, k in places:
                gone[d][k : k + 200] = True
    out = []
    for t, g in zip(texts, gone):
        n_spans = int((np.diff(np.concatenate(([0], g.astype(int)))) == 1).sum())
        out.append((len(t), int(g.sum()), n_spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~g])).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    noise = lambda n: bytes(rng.choices(b"abcdefghijklmnop ", k=n))
    almost, shared, longer = noise(190), noise(211), noise(700)
    texts = [noise(rng.randrange(300)) + almost + noise(rng.randrange(300)) for _ in range(30)]
    texts += [noise(rng.randrange(200)) + shared + noise(rng.randrange(200)) for _ in range(30)]
    texts += [noise(40) + longer[i * 5 : 700 - i * 7] + noise(30) for i in range(20)]
    # pairs that agree a little further than the passage
    for _ in range(12):
        left, right = noise(rng.randrange(30)), noise(rng.randrange(30))
        texts += [noise(100) + left + almost + right + noise(100) for _ in range(2)]
    texts += [b"", noise(199), b"x" * 900, b"ab" * 350, noise(150) * 4, noise(300), almost]
    return texts


def test_refined_anchors_give_what_brute_force_gives(spark, tmp_path, monkeypatch):
    for seed, hot in ((1, 3), (2, 1), (3, 10_000)):
        monkeypatch.setattr(repeats, "HOT", hot)
        monkeypatch.setattr(repeats, "BUCKET", 37)
        texts = corpus(seed)
        rows = [(i, t.decode()) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/{seed}")
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(spark.read.parquet(f"{tmp_path}/{seed}")).collect()}
        want = dict(enumerate(brute(texts)))
        assert got == want


def test_a_passage_just_too_short_makes_no_rows_a_window(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 50)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    passage = noise(190)
    spark.createDataFrame([(i, noise(250) + passage + noise(250)) for i in range(400)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    scratch = Scratch(spark)
    rows = with_uid(spark.read.parquet(f"{tmp_path}/d"), ["text"], scratch)
    assert repeats.repeated_spans(rows.selectExpr("uid", "cast(text as binary) text"), scratch).count() == 0


def test_the_cover_orders_suffixes_of_any_two_residues():
    """Windows come out in the order of their bytes, whatever their places are modulo the period."""
    rng = random.Random(6)
    base = bytes(rng.choices(b"ab", k=600))
    texts = [bytes(rng.choices(b"ab", k=rng.randrange(40))) + base[rng.randrange(200) :] + bytes(rng.choices(b"ab", k=70)) for _ in range(40)]
    bucket = repeats.SuffixBucket(texts)
    at = np.concatenate([bucket.start[i] + np.arange(len(t) - 199) for i, t in enumerate(texts)])
    order, cls = bucket.classes(at)
    raw = bucket.buffer.tobytes()
    windows = [raw[a : a + 200] for a in at[order].tolist()]
    assert windows == sorted(windows)
    assert [x == y for x, y in zip(windows, windows[1:])] == [a == b for a, b in zip(cls.tolist(), cls[1:].tolist())]
    assert len({(x % 32, y % 32) for x, y, same in zip(at[order], at[order][1:], np.diff(cls) == 0) if same}) > 100
