"""Operator 9: removal of repeated byte strings by blockwise suffix sorting with difference-cover ranks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import Scratch, give_back, with_marks, with_uid

#: Length of the strings; of an anchor; the anchors that a window chooses from.
LENGTH, GRAM = 200, 64
WINDOW = LENGTH - GRAM + 1
#: Period of the difference cover and its residues: any two residues have a shift, below PERIOD, that takes both into the cover.
PERIOD = 32
COVER = (0, 1, 2, 3, 7, 11, 19)
#: Contexts of a suffix bucket on average; an anchor with more than HOT different ones is refined into buckets of its own.
BUCKET, HOT = 4_000, 1_000
#: Bytes whose anchors are looked for at once.
BLOCK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _BASE, np.uint64))))
    back = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64))))
    return up, back


_UP, _BACK = _powers(BLOCK + 2 * LENGTH)


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """``f`` (minimum or maximum) of each ``width`` neighbours."""
    step = 1
    while step * 2 <= width:
        x = f(x[:-step], x[step:])
        step *= 2
    return f(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def _owners(block: np.ndarray) -> np.ndarray:
    """For each 200-byte window of ``block``, where its anchor starts: the 64-byte string of least hash in it, the leftmost of equals.

    The choice depends on the window's bytes alone, so equal windows have their anchors at the same place.
    """
    b = block.astype(np.uint64) + np.uint64(1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(b * _UP[: len(b)])))
    h = (sums[GRAM:] - sums[:-GRAM]) * _BACK[: len(b) - GRAM + 1]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least = _slide(h, WINDOW, np.minimum)
    # the leftmost place of the least hash at or after the window's start
    at = np.flatnonzero(h == _slide(np.concatenate((np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64))), WINDOW, np.maximum))
    starts = np.arange(len(least))
    k = np.searchsorted(at, starts)
    out = at[k]
    wrong = np.flatnonzero(h[out] != least)
    while wrong.size:
        k[wrong] += 1
        out[wrong] = at[k[wrong]]
        wrong = wrong[h[out[wrong]] != least[wrong]]
    return out


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, first, last): each anchor of a text with the first and last of the windows that it belongs to; a text is worked on in blocks."""
    n = len(raw) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    every = np.frombuffer(raw, np.uint8)
    own = np.concatenate([_owners(every[a : min(a + BLOCK, n) + LENGTH - 1]) + a for a in range(0, n, BLOCK)])
    cuts = np.flatnonzero(np.diff(own)) + 1
    first = np.concatenate(([0], cuts))
    return own[first], first, np.concatenate((cuts, [n])) - 1


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(uid, at, first, last, upto, k, h, g): h is a hash of the anchor, g of all bytes of its windows and of where in them the anchor is.

    Neighbours in a text whose h and g are equal (periodic text) are one row: ``k`` anchors, whose windows reach to ``upto``.
    """

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash64 = xxhash.xxh3_64_intdigest
        for b in it:
            cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
            for u, x in zip(b.column("uid").to_pylist(), b.column("text"), strict=True):
                raw = x.as_py() or b""
                at, first, last = anchors(raw)
                if not len(at):
                    continue
                h = np.fromiter((hash64(raw[a : a + GRAM]) for a in at.tolist()), np.uint64, len(at)).view(np.int64)
                g = np.fromiter((hash64(raw[f : e + LENGTH], a - f) for a, f, e in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)), np.uint64, len(at)).view(np.int64)
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))
                ends = np.concatenate((new[1:], [len(at)])) - 1
                for col, v in zip(cols, (np.full(len(new), u, np.int64), at[new], first[new], last[new], last[ends], ends - new + 1, h[new], g[new]), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols], names)
        give_back()

    names = ["uid", "at", "first", "last", "upto", "k", "h", "g"]
    return docs.select("uid", "text").mapInArrow(rows, ", ".join(f"{n} bigint" for n in names))


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows by ``keys``, the first of which counts most."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _shifts() -> np.ndarray:
    """For two residues, the least shift that takes both into the cover."""
    out = np.zeros((PERIOD, PERIOD), np.int64)
    for i in range(PERIOD):
        for j in range(PERIOD):
            out[i, j] = next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER)
    return out


class SuffixBucket:
    """Sorts the suffixes of one bucket that start at given windows, and tells which windows are equal.

    Suffixes at the positions of the difference cover (7 of 32) are ranked first: by 32 bytes, then by three doublings, over 256 bytes. A window
    is sorted by its first 32 bytes. Ties are split by pivots: a window and its group's pivot, whatever their residues, are both at cover
    positions after the same shift of less than 32 bytes, which are equal, so the two ranks there order them. Long ties cost no byte comparisons and no memory.
    """

    _SHIFT = _shifts()
    _COLUMN = np.array([COVER.index(r) if r in COVER else -1 for r in range(PERIOD)])

    def __init__(self, texts: list[bytes]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(size) - size
        room = -(-(int(size.sum()) + LENGTH + 10 * PERIOD) // PERIOD) * PERIOD
        self.buffer = np.zeros(room, np.uint8)
        self.buffer[: int(size.sum())] = np.frombuffer(b"".join(texts), np.uint8)
        self._rank_cover()

    def _words(self, at: np.ndarray) -> list[np.ndarray]:
        """The first 32 bytes from each position on as 8-byte words, comparable as numbers."""
        view = np.lib.stride_tricks.sliding_window_view(self.buffer, 8)
        return [np.ascontiguousarray(view[at + 8 * k]).view(">u8").ravel().astype(np.uint64) for k in range(PERIOD // 8)]

    def _rank_cover(self) -> None:
        blocks = len(self.buffer) // PERIOD - 1
        at = (np.arange(blocks)[:, None] * PERIOD + np.array(COVER)).ravel()
        rank = _ranks(self._words(at))
        step = len(COVER)
        for _ in range(3):
            later = np.concatenate((rank[step:], np.zeros(min(step, len(rank)), np.int64)))
            rank = _ranks([rank, later])
            step *= 2
        self.rank = rank

    def _rank_at(self, at: np.ndarray) -> np.ndarray:
        return self.rank[at // PERIOD * len(COVER) + self._COLUMN[at % PERIOD]]

    def sort(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, group): the windows at ``at`` in suffix order, and numbers that are equal only for windows known to share 256 bytes."""
        words = self._words(at)
        order = np.lexsort(words[::-1])
        new = np.zeros(len(at), bool)
        for w in words:
            s = w[order]
            new[1:] |= s[1:] != s[:-1]
        group = np.cumsum(new)
        size = np.bincount(group, minlength=1)
        open_ = np.flatnonzero(size[group] > 1)
        while len(open_):
            g = group[open_]
            first = np.concatenate(([True], g[1:] != g[:-1]))
            begin = np.flatnonzero(first)
            length = np.diff(np.append(begin, len(g)))
            pivot = at[order[open_[begin + length // 2]]][np.cumsum(first) - 1]
            x = at[order[open_]]
            shift = self._SHIFT[x % PERIOD, pivot % PERIOD]
            side = np.sign(self._rank_at(x + shift) - self._rank_at(pivot + shift))
            part = np.cumsum(first) * 3 + side
            by = np.argsort(part, kind="stable")
            order[open_] = order[open_][by]
            part = part[by]
            settled = side[by] == 0
            # numbers of all places anew, so that parts lie between their neighbours
            cut = np.zeros(len(at), bool)
            cut[1:] = group[1:] != group[:-1]
            cut[open_[1:]] |= part[1:] != part[:-1]
            group = np.cumsum(cut)
            size = np.bincount(group)
            open_ = open_[~settled & (size[group[open_]] > 1)]
        return order, group

    def classes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, class): the windows at ``at`` in suffix order, and numbers that are equal for windows equal over LENGTH bytes."""
        order, group = self.sort(at)
        same = np.zeros(len(order), bool)
        same[1:] = group[1:] == group[:-1]
        words = self._words(at)
        near = ~same
        near[:1] = False
        for w in words:
            s = w[order]
            near[1:] &= s[1:] == s[:-1]
        near = np.flatnonzero(near)
        view = np.lib.stride_tricks.sliding_window_view(self.buffer, LENGTH)
        for a in range(0, len(near), 1 << 15):
            part = near[a : a + (1 << 15)]
            same[part] = (view[at[order[part]]] == view[at[order[part - 1]]]).all(1)
        return order, np.cumsum(~same)


def _runs(context: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, last) of runs of neighbouring windows; both arrays are in order."""
    cut = np.flatnonzero((np.diff(context) != 0) | (np.diff(offset) != 1)) + 1
    a = np.concatenate(([0], cut)).astype(np.int64)
    b = np.concatenate((cut, [len(context)])).astype(np.int64) - 1
    return context[a], offset[a], offset[b]


def _search_bucket(table: pa.Table) -> pa.Table:
    """(uid, first, last): runs of windows of one bucket that occur twice in it; those of contexts that are known to occur again (n > 1) are left out."""
    col = {c: table.column(c).to_numpy() for c in ("uid", "first", "last", "n")}
    bucket = SuffixBucket(table.column("context").to_pylist())
    count = col["last"] - col["first"] + 1
    context = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(context)) - np.repeat(np.cumsum(count) - count, count)
    order, cls = bucket.classes(bucket.start[context] + offset)
    size = np.bincount(cls)
    mark = np.zeros(len(order), bool)
    mark[order] = size[cls] > 1
    mark &= col["n"][context] == 1
    if not mark.any():
        return pa.table({c: pa.array([], pa.int64()) for c in ("uid", "first", "last")})
    c, a, b = _runs(context[mark], offset[mark])
    return pa.table({"uid": col["uid"][c], "first": col["first"][c] + a, "last": col["first"][c] + b})


def _refined(hot: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, marks) for the contexts of hot anchors (h, n, uid, at, first, last, context).

    Windows of an anchor are told apart by the bytes between their start and the anchor, so a bucket of starts [a, b] is halved: those who start further
    off share more bytes before the anchor, the others more bytes behind it. A half's bucket is keyed by all the bytes that its windows share.
    Parts of contexts that are equal are one row (marked, as they are repeated). A bucket of HOT rows at most goes to ``rows``, a lone row is dropped, and the others are
    halved again; after 8 halvings a bucket has one start and its windows are equal. Each context is in one bucket per start at most, and where nothing is repeated mostly in one bucket in all.
    """
    rows, marks = [], []
    level = hot.select(F.lit(0).alias("a"), F.lit(WINDOW - 1).alias("b"), "n", "uid", "at", "first", "last", "context")
    while True:
        mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.array(F.struct(F.col("a").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("b").alias("b")))
        t = level.select("n", "uid", "at", "first", "last", "context", F.explode(halves).alias("_i")).where("_i.a <= _i.b")
        # the windows that start between b and a bytes before the anchor
        first, last = F.greatest("first", F.col("at") - F.col("_i.b")), F.least("last", F.col("at") - F.col("_i.a"))
        t = t.select("n", "uid", "at", F.col("first").alias("_f"), first.alias("first"), last.alias("last"), "context", F.col("_i.a").alias("a"), F.col("_i.b").alias("b")).where("first <= last")
        core = F.substring(F.col("context"), (F.col("at") - F.col("a") - F.col("_f") + 1).cast("int"), (F.col("a") + LENGTH - F.col("b")).cast("int"))
        part = F.substring(F.col("context"), (F.col("first") - F.col("_f") + 1).cast("int"), (F.col("last") - F.col("first") + LENGTH).cast("int"))
        t = t.select("n", "uid", "at", "first", "last", "a", "b", F.xxhash64("a", "b", core).alias("key"), part.alias("context"))
        t = scratch.table(t.withColumn("same", F.concat(F.md5("context"), F.hex(F.col("at") - F.col("first")))))
        one = F.min(F.struct("uid", "at", "first", "last")).alias("r")
        # sums are made before the shuffle, so copies of a part cost one row a task
        folded = scratch.table(t.groupBy("key", "same").agg(F.sum("n").alias("m"), one))
        again = t.where("n = 1").join(folded.where("m > 1").select("key", "same"), ["key", "same"])
        marks.append(scratch.table(again.select("uid", "first", "last")))
        sizes = scratch.table(folded.groupBy("key").agg(F.count("*").alias("d")).where("d > 1"))
        # most parts meet no other: their bytes go no further than this join, before any shuffle where the keys that stay are few
        alive = t.join(sizes, "key").select("key", "same", "uid", "first", "last", "a", "b", "context")
        kept = folded.join(sizes, "key").select("key", "same", "d", "m", "r.uid", "r.at", "r.first", "r.last")
        kept = scratch.table(kept.join(alive, ["key", "same", "uid", "first", "last"]))
        rows.append(kept.where(F.col("d") <= HOT).select("key", F.col("m").alias("n"), "uid", "first", "last", "context"))
        level = kept.where(F.col("d") > HOT).select("a", "b", F.col("m").alias("n"), "uid", "at", "first", "last", "context")
        scratch.drop(t)
        if level.isEmpty():
            return reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, marks)


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(uid, first, last): runs of windows that occur more than once, for ``docs`` (uid bigint, text binary; see ``with_uid``).

    1. Each window belongs to one anchor (a content-defined sample, one in about 60 bytes), equal windows to anchors of equal hash h. Windows of an anchor that
       occurs once can't be repeated and are not sorted.
    2. Contexts (an anchor's windows with all their bytes) with equal h and g are one entry of the suffix sort, with a multiplicity; those of two or more are repeated whole.
       g need only tell the contexts of one anchor apart: two different ones are taken for equal with probability 2**-64.
    3. Where one h has several contexts, they go to the suffix bucket of h and are sorted there; anchors with more than HOT are first refined (``_refined``), so no bucket grows with the corpus.
    """
    a = scratch.table(anchor_rows(docs))
    many = scratch.table(a.groupBy("h").agg(F.sum("k").alias("m")).where("m > 1").select("h"))
    twice = scratch.table(a.join(many, "h"))
    scratch.drop(a)
    hg = scratch.table(twice.groupBy("h", "g").agg(F.sum("k").alias("n"), F.min(F.struct("uid", "at", "first", "last")).alias("r")))
    whole = twice.join(hg.where("n > 1").select("h", "g"), ["h", "g"]).select("uid", "first", F.col("upto").alias("last"))
    kinds = scratch.table(hg.groupBy("h").agg(F.count("*").alias("d")).where("d > 1"))
    asked = scratch.table(hg.join(kinds, "h").select("h", "n", "d", "r.uid", "r.at", "r.first", "r.last"))
    total, hot = asked.agg(F.count("*"), F.count_if(F.col("d") > HOT)).first()
    texts = with_marks(docs, asked.select("uid", F.lit(1).alias("mark")), scratch).drop("mark")
    cut = F.substring(F.col("text"), (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first") + LENGTH).cast("int"))
    fields = ["n", "uid", "first", "last", "context"]
    contexts = texts.join(asked, "uid").withColumn("context", cut).select("h", "d", "at", *fields)
    dealt, marks = contexts.where(F.col("d") <= HOT).select(F.col("h").alias("key"), *fields), None
    if hot:
        refined, marks = _refined(scratch.table(contexts.where(F.col("d") > HOT)), scratch)
        dealt = dealt.unionByName(refined.select("key", *fields))
        total += refined.count()
    buckets = max(1, -(-total // BUCKET))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    found = dealt.select("bucket", *fields).groupBy("bucket").applyInArrow(_search_bucket, "uid bigint, first bigint, last bigint")
    out = whole.unionByName(found)
    return scratch.table(out if marks is None else out.unionByName(marks))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row: bytes covered by a LENGTH-byte string that also starts elsewhere go.

    Strings are told apart within the whole table, same document included, and judged on the input; overlaps count, matches never cross documents.
    Rows are numbered by ``with_uid``, whatever the input is and however it is split.
    Null texts count as empty and lose nothing, as do texts below LENGTH bytes; repeated rows lose all. A null doc_id is kept. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = with_uid(docs, [F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")], scratch)
    spans = repeated_spans(rows.select("uid", "text"), scratch)
    per = spans.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("s"))

    def union(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            starts, ends, removed = [], [], []
            for s in b.column("s"):
                first = s.values.field("first").to_numpy()
                last = np.maximum.accumulate(s.values.field("last").to_numpy() + LENGTH)
                new = np.flatnonzero(np.concatenate(([True], first[1:] > last[:-1])))
                starts.append(first[new])
                ends.append(last[np.concatenate((new[1:] - 1, [len(last) - 1]))])
                removed.append(int((ends[-1] - starts[-1]).sum()))
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(removed, pa.int64())], ["uid", "starts", "ends", "n_removed"])

    cut = scratch.table(per.mapInArrow(union, "uid bigint, starts array<bigint>, ends array<bigint>, n_removed bigint"))

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for t, s, e in zip(b.column("text"), b.column("starts"), b.column("ends"), strict=True):
                raw, at, h = t.as_py(), 0, hashlib.sha256()
                for x, y in zip(s.as_py(), e.as_py(), strict=True):
                    h.update(raw[at:x])
                    at = y
                h.update(raw[at:])
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(out, pa.string())], ["uid", "kept"])

    texts = with_marks(rows.select("uid", "text"), cut.select("uid", F.lit(1).alias("mark")), scratch)
    kept = scratch.table(texts.join(cut, "uid").select("uid", "text", "starts", "ends").mapInArrow(keep, "uid bigint, kept string"))
    final = rows.select("uid", "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    small = cut.join(kept, "uid").select("uid", "n_removed", F.size("starts").cast("bigint").alias("n_spans"), "kept")
    out = final.join(scratch.table(small), "uid", "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("bigint")).alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))
