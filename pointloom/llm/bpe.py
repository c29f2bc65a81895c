"""Operator 8: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heappop, heappush
from itertools import batched, chain, compress, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import give_back

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes a worker holds for pre-tokens it remembers, about; when they are more, the store starts anew, also within a text.
REMEMBERED = 64 << 20
#: What a remembered pre-token takes besides its characters: two strings, their headers and places.
_OVERHEAD = 200
#: Longer pre-tokens have a queue of their own.
LONGEST_BATCHED = 64
#: Characters of new pre-tokens that are merged together at most, and of the texts that are worked on together.
MERGED_TOGETHER, TOGETHER = 1 << 20, 1 << 23


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: always merges the pair of least rank, the leftmost of equals.

    The queue holds a bucket of linked-list positions for each merge rank. ``top`` and ``low`` are a bitmap of two levels
    (256 ranks a word): two find-first-set steps give the least rank that has positions. An entry
    whose pair has changed since is stale and skipped. Each merge pushes two entries at most,
    so a pre-token of n bytes takes about n log n steps however long it is.
    """
    n = len(piece)
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    get = ranks.get
    # 12 bytes for each byte of the pre-token
    after = array("i", range(1, n + 2))
    before = array("i", range(-1, n + 1))
    pair = array("i", [-1]) * (n + 1)
    buckets: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    top = 0
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            pair[i] = r
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                w = r >> 8
                low[w] = low.get(w, 0) | 1 << (r & 255)
                top |= 1 << w
    while top:
        w = (top & -top).bit_length() - 1
        bits = low[w]
        r = w << 8 | (bits & -bits).bit_length() - 1
        bucket = buckets[r]
        i = heappop(bucket)
        if not bucket:
            del buckets[r]
            low[w] = bits = bits & bits - 1
            if not bits:
                top &= top - 1
        if pair[i] != r:
            continue
        j = after[i]
        k = after[j]
        after[i] = k
        before[k] = i
        pair[j] = -1
        h = before[i]
        for at, end in ((i, after[k] if k < n else -1), (h, k)):
            if at < 0:
                continue
            new = get(piece[at:end]) if end >= 0 else None
            if new is None:
                pair[at] = -1
                continue
            pair[at] = new
            if new in buckets:
                heappush(buckets[new], at)
            else:
                buckets[new] = [at]
                w = new >> 8
                low[w] = low.get(w, 0) | 1 << (new & 255)
                top |= 1 << w
    out = []
    i = 0
    while i < n:
        k = after[i]
        out.append(ranks[piece[i:k]])
        i = k
    return out


class PieceQueue:
    """Merges many short pre-tokens at once with one rank queue.

    All pre-tokens lie in one linked list with an end mark after each, so no pair crosses them. A bucket holds the places of 256 ranks, a bit of the bitmap ``top`` each.
    Of the least bucket that has places, every pre-token in it merges its own least rank, the leftmost of equals: a pre-token's least rank is there or in a later bucket,
    and pre-tokens don't meet. Its other places go back, as a merge may bring a lower rank.
    """

    #: No id: a pair with it has a negative key, whatever the vocabulary's size.
    _END = -1
    #: No pair's key, nor one with an end mark.
    _FREE = -(1 << 62)

    def __init__(self, ranks: dict[bytes, int]):
        found = {(ranks[t[:k]] << 32) | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        # an open table, a quarter of it taken at most; a key lies in the first free place from its own on
        bits = max(8, (4 * len(found)).bit_length())
        self._shift, self._last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.made = np.full(1 << bits, self._FREE, np.int64), np.full(1 << bits, -1, np.int32)
        key, rank = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int32, len(found))
        at = self._place(key)
        while len(key):
            free = self.keys[at] == self._FREE
            self.keys[at[free]] = key[free]
            here = self.keys[at] == key
            self.made[at[here]] = rank[here]
            key, rank, at = key[~here], rank[~here], at[~here] + 1 & self._last
        self.single = np.array([ranks[bytes([c])] for c in range(256)], np.int32)
        # the ranks of two bytes; 256 is the end mark
        self.double = np.full((257, 257), -1, np.int32)
        self.double[:256, :256] = self._rank(np.repeat(self.single, 256), np.tile(self.single, 256)).reshape(256, 256)
        self.double = self.double.ravel()

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, or -1."""
        key = left.astype(np.int64) << 32 | right
        at = self._place(key)
        there = self.keys[at]
        same = there == key
        out = np.where(same, self.made[at], np.int32(-1))
        on = np.flatnonzero(~same & (there != self._FREE))
        while len(on):
            at[on] = at[on] + 1 & self._last
            there = self.keys[at[on]]
            same = there == key[on]
            out[on[same]] = self.made[at[on[same]]]
            on = on[~same & (there != self._FREE)]
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens, one after the other, and how many each has."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(size.sum()) + len(pieces)
        end = np.cumsum(size + 1) - 1
        inside = np.ones(n, bool)
        inside[end] = False
        code = np.full(n + 1, 256, np.int32)
        code[:n][inside] = np.frombuffer(b"".join(pieces), np.uint8)
        pair = np.full(n + 1, -1, np.int32)
        pair[:n] = self.double[code[:n] * 257 + code[1:]]
        token = np.append(self.single, np.int32(self._END))[code]
        del code
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), size + 1)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)  # place -1 is the last, an end mark
        buckets: dict[int, list[np.ndarray]] = {}
        top = self._push(np.flatnonzero(pair >= 0).astype(np.int32), pair, buckets)
        while top:
            w = (top & -top).bit_length() - 1
            top &= top - 1
            at = np.concatenate(buckets.pop(w))
            # an entry whose pair has changed since is stale, one that was put in twice counts once
            at = np.sort(at[pair[at] >> 8 == w])
            if not len(at):
                continue
            at = at[_starts(at)]
            rank, whose = pair[at], owner[at]
            start = np.flatnonzero(_starts(whose))
            least = np.repeat(np.minimum.reduceat(rank, start), np.diff(start, append=len(at)))
            some = np.flatnonzero(rank == least)
            some = some[_starts(whose[some])]
            if len(some) < len(at):
                rest = np.ones(len(at), bool)
                rest[some] = False
                buckets[w] = [at[rest]]
                top |= 1 << w
            at, rank = at[some], rank[some]
            j = after[at]
            k = after[j]
            after[at] = k
            before[k] = at
            pair[j] = -1
            token[at] = rank
            both = np.concatenate((before[at], at))
            pair[both] = new = self._rank(token[both], np.concatenate((rank, token[k])))
            top |= self._push(both[new >= 0], pair, buckets)
        # what is still linked: every place that its predecessor points to
        alive = np.zeros(n + 2, bool)
        alive[0] = True
        alive[after[:n][self._linked(after, n)]] = True
        alive = alive[:n] & inside
        return token[:n][alive], np.bincount(owner[alive], minlength=len(pieces))

    @staticmethod
    def _push(places: np.ndarray, pair: np.ndarray, buckets: dict[int, list[np.ndarray]]) -> int:
        """Puts the places into the buckets of their pairs; returns the bits of those buckets."""
        word = pair[places] >> 8
        # ranks below 2**24 are sorted by two bytes, in one pass each
        order = np.argsort(word.astype(np.uint16) if len(word) and word.max() < 1 << 16 else word, kind="stable")
        places, word = places[order], word[order]
        cut = np.flatnonzero(_starts(word)).tolist()
        bits = 0
        for w, a, b in zip(word[cut].tolist(), cut, [*cut[1:], len(places)], strict=False):
            buckets.setdefault(w, []).append(places[a:b])
            bits |= 1 << w
        return bits

    @staticmethod
    def _linked(after: np.ndarray, n: int) -> np.ndarray:
        """Places on the list, from the first on: those no jump of an earlier listed place passes over."""
        reach = np.maximum.accumulate(np.concatenate(([0], after[:n])))[:n]
        return np.flatnonzero(reach <= np.arange(n))


def _starts(x: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return first


def _spelt_out(pattern: str, inside: dict[str, str], flags: int = 0) -> re.Pattern | None:
    r"""The pattern for the standard library, which is twice as fast, with the members of \s, \p{L} and \p{N} in place of these; None if it has what the two may read differently."""
    named = re.compile(r"\\s|\\p\{[LN]\}")
    spelt = re.sub(r"\[[^\]]*\]", lambda m: named.sub(lambda c: inside[c[0]], m[0]), pattern)
    spelt = re.sub(r"(\[[^\]]*\])|(\\s|\\S|\\p\{[LN]\})", lambda m: m[1] or (f"[^{inside[r'\s']}]" if m[2] == r"\S" else f"[{inside[m[2]]}]"), spelt)
    unlike = r"\\[pP]" if flags & re.ASCII else r"\\[pPsSwWdDbB]|\(\?[a-z]*i"
    return None if re.search(unlike, spelt) else re.compile(spelt, flags)


@cache
def _plane(prop: str) -> str:
    """The ranges of the characters up to U+FFFF that have a Unicode property, as the ``regex`` module knows it."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    return "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(rf"\p{{{prop}}}+", every))


class Codec:
    """Encodes and decodes with the ranks of one vocabulary file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = {i: b for b, i in self.ranks.items()}
        # white space by its Unicode property, as the library's patterns have it
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.ascii_split = _spelt_out(pattern, {r"\s": r"\t-\r ", r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}, re.ASCII) or self.split
        self.plane_split = _spelt_out(pattern, {r"\s": _plane("White_Space"), r"\p{L}": _plane("L"), r"\p{N}": _plane("N")}) or self.split
        self.queue = PieceQueue(self.ranks)
        self.seen = _Seen()
        self.forget()

    def encode_many(self, texts: Iterable[str], remembered: int | None = None) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; new pre-tokens of many texts are merged together.

        Held at once: TOGETHER characters of texts or one text, their ids, and about ``remembered`` (REMEMBERED) bytes of pre-tokens, which stay until ``forget``.
        """
        most = remembered or REMEMBERED
        for run in _by_size(texts):
            numbers, ids, sizes = array("I"), [np.zeros(0, np.int32)], [np.zeros(1, np.int32)]
            settled, bounds = 0, [0]
            for t in run:
                for found in self._pieces(t):
                    numbers.extend(map(self.seen.__getitem__, found))
                    if self.seen.waiting > MERGED_TOGETHER:
                        self._merge()
                    if self.seen.held > most:
                        settled += self._settle(numbers, ids, sizes)
                        self.forget()
                bounds.append(settled + len(numbers))
            self._settle(numbers, ids, sizes)
            every, cut = np.concatenate(ids).astype("<u4", copy=False), np.cumsum(np.concatenate(sizes))[bounds].tolist()
            for a, b in pairwise(cut):
                yield every[a:b].tobytes()

    def forget(self) -> None:
        """Drops the remembered pre-tokens."""
        self.seen.clear()
        self.seen.held = 0
        #: The ids of the pre-tokens by their numbers: those of number k lie from first[k] to first[k + 1].
        self.ids, self.first, self.merged = np.zeros(1 << 10, np.int32), np.zeros(1 << 10, np.int64), 0

    def _pieces(self, text: str) -> Iterator[list[str] | tuple[str, ...]]:
        # two bytes a character: none beyond U+FFFF
        split = self.ascii_split if text.isascii() else self.plane_split if len(text.encode("utf-16-le")) == 2 * len(text) else self.split
        if len(text) < 1 << 18:
            yield split.findall(text)
        else:
            yield from batched((m[0] for m in split.finditer(text)), 1 << 15)

    def _merge(self) -> None:
        """Encodes the pre-tokens that wait."""
        if not self.seen.new:
            return
        new = [x.encode() for x in self.seen.new]
        whole = [self.ranks.get(x, -1) for x in new]
        size = np.ones(len(new), np.int64)
        queued = (np.array(whole, np.int64) < 0) & (np.fromiter(map(len, new), np.int64, len(new)) <= LONGEST_BATCHED)
        merged, size[queued] = self.queue.encode(list(compress(new, queued.tolist())))
        others = [[r] if r >= 0 else encode_piece(x, self.ranks) for x, r, q in zip(new, whole, queued.tolist(), strict=True) if not q]
        size[~queued] = np.fromiter(map(len, others), np.int64, len(others))
        of = np.repeat(queued, size)
        ids = np.empty(len(of), np.int32)
        ids[of] = merged
        ids[~of] = np.fromiter(chain.from_iterable(others), np.int32, len(of) - len(merged))
        used = int(self.first[self.merged])
        self.ids = _put(self.ids, used, ids)
        self.first = _put(self.first, self.merged + 1, used + np.cumsum(size))
        self.merged += len(new)
        self.seen.new.clear()
        self.seen.waiting = 0

    def _settle(self, numbers: array, ids: list[np.ndarray], sizes: list[np.ndarray]) -> int:
        """Turns the numbers of pre-tokens so far into ids and how many each has; returns how many pre-tokens these are."""
        self._merge()
        count = len(numbers)
        for a in range(0, count, 1 << 18):
            x = np.array(numbers[a : a + (1 << 18)], np.int64)
            first = self.first[x]
            size = self.first[x + 1] - first
            ahead = np.cumsum(size) - size
            ids.append(self.ids[np.repeat(first - ahead, size) + np.arange(ahead[-1] + size[-1])])
            sizes.append(size.astype(np.int32))
        del numbers[:]
        return count

    def encode(self, text: str) -> bytes:
        return next(self.encode_many([text]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _put(a: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """``a`` with ``values`` from ``at`` on; where it is too short, a copy with room to spare."""
    if at + len(values) > len(a):
        a = np.concatenate((a[:at], np.empty(max(at, len(values)), a.dtype)))
    a[at : at + len(values)] = values
    return a


class _Seen(dict):
    """Pre-token to its number; what is new gets the next one and waits to be merged."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.waiting = self.held = 0

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        self.new.append(token)
        self.waiting += len(token)
        self.held += 2 * len(token) + _OVERHEAD
        return n


def _by_size(values: Iterable[str]) -> Iterator[list[str]]:
    """Runs of texts of TOGETHER characters or so."""
    run, size = [], 0
    for x in values:
        run.append(x)
        size += len(x)
        if size > TOGETHER:
            yield run
            run, size = [], 0
    if run:
        yield run


@cache
def codec(path: str) -> Codec:
    """One codec a worker and file."""
    return Codec(path)


def _utf8(x: pa.Scalar) -> str:
    return (x.as_py() or b"").decode("utf-8", "replace")


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Adds ``ids`` (array<int>), the token ids of ``text``; null and empty texts have none. Other columns are kept as they are.

    ``path``: a rank file that every worker can open, by default the installed vocabulary.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf("array<int>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for col in texts:
            yield pa.array([np.frombuffer(x, "<i4") for x in c.encode_many(map(_utf8, col))], pa.list_(pa.int32()))
        c.forget()
        give_back()

    return df.withColumn(ids, of(F.col(text).cast("binary")))


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds ``text`` (binary), the bytes of the tokens of ``ids``; a null list gives no bytes. An unknown id is an error."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf("binary")
    def of(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for col in lists:
            yield pa.array([c.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in col], pa.binary())

    return df.withColumn(text, of(F.col(ids)))


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes every text, decodes the ids again and returns doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts count as empty: 0 tokens, both digests those of no bytes. A null doc_id is kept; other columns of ``docs`` don't matter.
    Ids and decoded bytes stay in the worker, one document at a time. Nothing is shuffled.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, of_ids, of_text = [], [], []
            for ids in c.encode_many(map(_utf8, b.column("text"))):
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.forget()
        give_back()

    small = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return small.mapInArrow(digests, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
