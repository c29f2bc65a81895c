"""The pipeline's near-copies against the true similarity of all pairs."""

import random

import numpy as np

import corpus_pipeline
from pointloom.llm import near_copies


def brute_set(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_planted_copies_of_similarity_from_08_are_dropped_and_others_stay(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    rows, wanted = [], set()
    for k in range(60):
        base = rng.choices(vocabulary, k=200)
        rows.append((10 * k, " ".join(base)))
        wanted.add(10 * k)
        # words changed one here, one there, a fixed number apart
        for c, changed in enumerate((1, 3, 4, 12)):
            copy = list(base)
            for i in range(changed):
                copy[10 + i * (180 // changed)] = f"new{k}x{c}x{i}"
            a, b = brute_set(" ".join(base)), brute_set(" ".join(copy))
            rows.append((10 * k + 1 + c, " ".join(copy)))
            if 5 * len(a & b) < 4 * len(a | b):
                wanted.add(10 * k + 1 + c)
    assert len(wanted) == 120
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    got = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"{tmp_path}/d"), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(wanted)


def test_sets_and_their_similarity():
    texts = ["a b c d e f", "A B C d e F", "a b", "", " \n", "a b c d e f g"]
    sets = [near_copies.shingle_set(t.encode()) for t in texts]
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0, 3]
    assert near_copies.set_key(sets[0]) == near_copies.set_key(sets[1]) != near_copies.set_key(sets[5])
    linked = lambda *s: len(near_copies.similar_links(list(s))[0]) > 0
    assert not linked(sets[0], sets[5])
    a = np.arange(90, dtype=np.uint64)
    assert linked(a[:80], a[:64]) and not linked(a[:80], a[:63])


def test_links_by_lists_and_by_matrices_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    for m, spread in ((90, 40), (90, 4000), (3, 40), (1, 5)):
        base = rng.integers(0, spread, (6, 120)).astype(np.uint64)
        sets = []
        for i in range(m):
            s = base[i % 6].copy()
            s[rng.integers(0, 120, i % 30)] = rng.integers(0, spread, i % 30)
            sets.append(np.unique(s))
        label = list(range(m))
        for i in range(m):
            for j in range(i):
                if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])):
                    a, b = label[i], label[j]
                    label = [min(a, b) if x in (a, b) else x for x in label]
        got = list(range(m))
        moved, to = near_copies.similar_links(sets)
        for i, j in zip(moved.tolist(), to.tolist(), strict=True):
            got[i] = j
        assert got == label


def test_components_over_many_blocks_are_those_of_all_pairs(spark, tmp_path, monkeypatch):
    """A third of the rows are near copies of one text, verified in blocks of four."""
    monkeypatch.setattr(near_copies, "BLOCKS", ((40, 4), (80, 2), (1 << 62, 1)))
    rng = random.Random(4)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    base, texts = words(60), []
    for i in range(40):
        w = list(base[: 60 - i % 7])
        for _ in range(i % 3):
            w[rng.randrange(len(w))] = "x" * rng.randrange(1, 9)
        texts.append(" ".join(w))
    texts += [" ".join(words(rng.randrange(1, 130))) for _ in range(80)] + [None, "", " ", "a b c d", "A b  c d"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/d")
    sets = [brute_set(t or "") for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = near_copies.drop_near_copies(spark.read.parquet(f"{tmp_path}/d"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(label))


def test_an_empty_table_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, uid string, node string, root long, mark int, _f string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/e")
    assert near_copies.drop_near_copies(spark.read.parquet(f"{tmp_path}/e")).collect() == []
    rows = [(2, "one two three", "u", None, 1, 2, "f"), (1, "One two three", "v", "n", 3, 4, "g"), (None, "one two three", "w", None, 5, 6, "h"), (None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/c")
    got = near_copies.drop_near_copies(spark.read.parquet(f"{tmp_path}/c")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([rows[1], rows[3]], key=repr)
