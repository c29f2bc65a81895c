"""Operator 10: a quality classifier from weak labels."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets of the linear scorer.
BUCKETS = 1 << 16
#: Documents that the scorer is trained on, those with the smallest hash; the labellers' accuracies are fitted on all.
TRAINING_DOCS = 4_000
#: Different words a worker remembers.
REMEMBERED = 500_000
LABELLERS = ("symbols", "capitals", "repeats", "variety", "shouts", "length", "sentences", "tables")
_NOT_CAPITAL = re.compile("[^A-ZÀ-ÖØ-Þ]+")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_NOT_SYMBOL = re.compile(r"[^#*$%&|<>]+")


def votes(text: str) -> tuple[int, ...]:
    """What each of LABELLERS says of a text: 1 good, -1 bad, 0 nothing."""
    w = text.split()
    n = len(w)
    if not n:
        return (0, 0, 0, 0, 0, -1, 0, 0)
    symbols = len(_NOT_SYMBOL.sub("", text)) / n
    capitals = len(_NOT_CAPITAL.sub("", text)) / max(1, len(_NOT_LETTER.sub("", text)))
    repeats = sum(map(eq, w, w[1:])) / n
    variety = len(set(w)) / n
    ends = (text.count(". ") + text.count(", ") + text.count(".\n") + text.endswith(".")) / n
    bars = text.count("|") / n
    # the absence of one kind of junk says nothing of the others, so most labellers only vote against a text
    return (
        -(symbols > 0.1), -(capitals > 0.4), -(repeats > 0.15), -(n >= 20 and variety < 0.3), -(text.count("!!") > 0.05 * n), -(n < 4),
        1 if 0.03 <= ends <= 0.5 else -1 if n >= 20 and ends < 0.02 else 0, -(bars > 0.05),
    )


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns and how often each occurs: (posterior of good for each pattern, accuracies).

    Labellers are taken as independent given the class, with a rate of each vote for each class; accuracy is the chance that a vote cast is right.
    Rounds start from a text being bad if anyone votes so.
    """
    m = patterns.shape[1]
    good = np.where((patterns < 0).any(1), 0.1, 0.9)
    rate = np.zeros((2, m, 3))
    for _ in range(rounds):
        mass = np.stack(((1 - good) * counts, good * counts))
        prior = (mass.sum(1) + 1) / (counts.sum() + 2)
        for v in (-1, 0, 1):
            rate[:, :, v + 1] = mass @ (patterns == v) + 0.1
        rate /= rate.sum(2, keepdims=True)
        said = np.log(rate)[:, np.arange(m), patterns + 1].sum(2) + np.log(prior)[:, None]
        new = 1 / (1 + np.exp(np.clip(said[0] - said[1], -500, 500)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            good = new
            break
        good = new
    mass = np.stack(((1 - good) * counts, good * counts))
    right = mass[1] @ (patterns == 1) + mass[0] @ (patterns == -1)
    return good, right / np.maximum(counts @ (patterns != 0), 1e-9)


def _shape(word: str) -> str:
    s = re.sub("[^\\W\\d_]", "a", re.sub("[A-ZÀ-ÖØ-Þ]", "A", word), flags=re.ASCII) if word.isascii() else "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "9", s))


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


@lru_cache(1 << 17)
def word_buckets(word: str) -> tuple[int, int]:
    """The buckets of a word's lower-case form and of its shape (letters, capitals, digits, marks)."""
    return _bucket(word.lower()[:64]), _bucket("\0" + _shape(word[:64]))


_AGAIN = _bucket("\0again")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their shares of its words; the repeat of the word before is a feature of its own."""
    w = text.split()
    count: dict[int, float] = {}
    for x in w:
        for b in word_buckets(x):
            count[b] = count.get(b, 0) + 1
    if again := sum(map(eq, w, w[1:])):
        count[_AGAIN] = count.get(_AGAIN, 0) + again
    return np.fromiter(count.keys(), np.int32, len(count)), np.fromiter(count.values(), np.float64, len(count)) / max(1, len(w))


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Logistic weights (BUCKETS and a constant) for soft labels, by full-batch steps scaled by past gradients."""
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    idx = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int32)
    val = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0)
    w, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    # both classes weigh the same
    weight = np.where(target >= 0.5, 0.5 / max(1.0, (target >= 0.5).sum()), 0.5 / max(1.0, (target < 0.5).sum()))
    for _ in range(rounds if len(rows) else 0):
        z = np.bincount(at, val * w[idx], len(rows)) + w[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        grad = np.append(np.bincount(idx, val * err[at], BUCKETS), err.sum()) + decay * w
        seen += grad**2
        w -= rate * grad / np.sqrt(seen)
    return w


def _text(x: pa.Scalar) -> str:
    return (x.as_py() or b"").decode("utf-8", "replace")


def _binary(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def label_votes(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern): the votes on each document as one number, base 3 with -1 as 0."""

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            p = [int("".join(str(v + 1) for v in votes(_text(x))), 3) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.int32())], ["doc_id", "pattern"])

    return _binary(docs).mapInArrow(of, "doc_id bigint, pattern int")


def fit_weak_labels(docs: DataFrame) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of each vote pattern that occurs, and the labellers' accuracies; counts patterns over all documents (at most 3**8 rows come back)."""
    rows = label_votes(docs).groupBy("pattern").count().orderBy("pattern").collect()
    m = len(LABELLERS)
    patterns = np.array([[r.pattern // 3 ** (m - 1 - k) % 3 - 1 for k in range(m)] for r in rows], np.int64).reshape(-1, m)
    good, accuracy = fit_labellers(patterns, np.array([r["count"] for r in rows], np.float64))
    return {r.pattern: float(g) for r, g in zip(rows, good, strict=True)}, accuracy


def fit_scorer(docs: DataFrame, posterior: dict[int, float], limit: int = TRAINING_DOCS) -> np.ndarray:
    """Trains the scorer in one task on ``limit`` documents at most; the weights (BUCKETS + 1 numbers) come back."""
    order = F.xxhash64("doc_id", "text")
    # hashes alone are sorted; texts are then read again, so that tasks don't send a sample each
    last = docs.select(order.alias("_o")).orderBy("_o").limit(limit).agg(F.max("_o")).first()[0]
    sample = docs.select("doc_id", "text").where(order <= F.lit(last)).limit(limit)

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, target = [], []
        for b in it:
            for x in b.column("text"):
                t = x.as_py() or ""
                rows.append(features(t))
                target.append(posterior.get(int("".join(str(v + 1) for v in votes(t)), 3), 0.5))
        w = train(rows, np.array(target))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f8").tobytes()], pa.binary())], ["w"])

    # the sample is bounded, so one task may hold it
    out = sample.select("text").coalesce(1).mapInArrow(of, "w binary").first()
    return np.frombuffer(out["w"], "<f8") if out else np.zeros(BUCKETS + 1)


class _Scorer(dict):
    """Word to the sum of its weights."""

    def __init__(self, w: np.ndarray):
        super().__init__()
        self.w = w.tolist()

    def __missing__(self, word: str) -> float:
        a, b = word_buckets.__wrapped__(word)
        out = self.w[a] + self.w[b]
        self[word] = out
        return out

    def score(self, text: str) -> float:
        words = text.split()
        n = max(1, len(words))
        z = (sum(map(self.__getitem__, words)) + sum(map(eq, words, words[1:])) * self.w[_AGAIN]) / n + self.w[-1]
        if len(self) > REMEMBERED:
            self.clear()
        return z


@cache
def _scorer(raw: bytes) -> _Scorer:
    return _Scorer(np.frombuffer(raw, "<f8"))


def classify(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score double, kept boolean): the scorer's chance that a document is good, and whether it reaches ``threshold``.

    No gold labels are used. Overlapping heuristics vote on every document; expectation-maximisation over the counts of vote patterns finds
    their accuracies and each pattern's posterior; posteriors train a linear scorer on hashed words and word shapes.

    Null and empty texts have no features; they are voted too short and aren't kept. A null doc_id is kept. An empty table gives no rows.
    """
    posterior, _ = fit_weak_labels(docs)
    raw = fit_scorer(docs, posterior).astype("<f8").tobytes()
    shared = docs.sparkSession.sparkContext.broadcast(raw)  # 512 KB, whatever the corpus

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _scorer(shared.value)
        for b in it:
            z = []
            for x in b.column("text"):
                t = _text(x)
                z.append(s.score(t) if t and not t.isspace() else -30.0)
            p = 1 / (1 + np.exp(-np.clip(np.array(z), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array(p >= threshold)], ["doc_id", "score", "kept"])

    return _binary(docs).mapInArrow(of, "doc_id bigint, score double, kept boolean")
