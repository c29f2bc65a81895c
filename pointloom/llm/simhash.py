"""Operator 1: near-duplicate documents by SimHash fingerprints and a tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import Scratch, with_row_number
from pointloom.llm.components import connected_components

RADIUS = 4
#: Rows of a stored tile; of the pieces that are compared at once; the least and most rows of a band of tiles, and the bands aimed at.
TILE, PIECE, LEAST_BAND, MOST_BAND, BANDS = 2048, 256, 16_384, 1 << 20, 48
#: Hashes counted at once, and characters split at once.
_HASHES, _CHARS = 1 << 14, 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WHITE = b" \t\n\r\x0b\x0c"


def _words(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a block at a time, so that a very long text is never split whole."""
    if len(raw) <= _CHARS:
        yield raw.split()
        return
    rest = b""
    for a in range(0, len(raw), _CHARS):
        block = rest + raw[a : a + _CHARS]
        parts = block.split()
        rest = b""
        if parts and block[-1:] not in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c") and a + _CHARS < len(raw):
            rest = parts.pop()
        yield parts
    if rest:
        yield [rest]


def shingle_hashes(raw: bytes, shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 hashes of the word shingles of a UTF-8 text, a block at a time; A-Z become a-z, a text of fewer words is one shingle."""
    h = xxhash.xxh64_intdigest
    n, carry = 0, []
    for words in _words(raw.translate(_LOWER)):
        words = carry + words
        for a in range(0, len(words) - shingle + 1, _HASHES):
            part = words[a : a + _HASHES + shingle - 1]
            joined = b" ".join(part)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            starts = np.concatenate(([0], ends[: len(part) - shingle]))
            hashes = np.fromiter((h(joined[s:e], seed) for s, e in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
            n += len(hashes)
            yield hashes
        carry = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
    if not n and carry:
        yield np.array([h(b" ".join(carry), seed)], np.uint64)


def fingerprint(raw: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of the word shingles of a UTF-8 text; 0 without words.

    A-Z become a-z; shingles count as often as they occur; a text of fewer words is one shingle. A bit is 1 if
    it is set in over half the XXH64 hashes.
    """
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(raw, shingle, seed):
        n += len(hashes)
        ones += _bit_counts(hashes)
    return sum(1 << k for k in range(64) if 2 * int(ones[k]) > n)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the lowest first."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # sums of up to 255 rows fit a byte
    full = len(bits) // 255 * 255
    out = bits[full:].sum(axis=0, dtype=np.int64)
    return out + np.add.reduce(bits[:full].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) if full else out


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(uid, doc_id, fp): the row's number in the scan, and the fingerprint of each row's whole text as a signed bigint; null and empty texts have 0."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.fromiter((fingerprint(x.as_py() or b"", shingle, seed) for x in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), pa.array(fp.view(np.int64))], ["uid", "doc_id", "fp"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(batches, "uid bigint, doc_id bigint, fp bigint")


def set_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """A SimHash of ``words`` times 64 bits of a set of hashes; words after the first count the bits of remixed hashes."""
    out = np.zeros(words, np.uint64)
    for w in range(words if len(hashes) else 0):
        h = hashes
        if w:
            h = hashes + np.uint64(w * 0x9E3779B97F4A7C15 % (1 << 64))
            for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> np.uint64(s))) * np.uint64(m)
            h ^= h >> np.uint64(31)
        ones = _bit_counts(h)
        out[w] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out


def _quarters(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four quarters of each fingerprint (rows of 64-bit words)."""
    return np.bitwise_count(fp.view(np.uint16).reshape(len(fp), fp.shape[1], 4)).sum(1, dtype=np.int16)


class _Forest:
    """Least labels of linked rows; links are worked in by the million, so that dense groups need no list of all pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        self.pending.append((i, j))
        self.waiting += len(i)
        if self.waiting > 1 << 20:
            self.flush()

    def flush(self) -> None:
        if not self.pending:
            return
        i, j = (np.concatenate(x) for x in zip(*self.pending, strict=True))
        self.pending, self.waiting = [], 0
        lab = self.label
        while True:
            a, b = lab[i], lab[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
            while (lab != (up := lab[lab])).any():
                lab[:] = up


def link_tiles(
    left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, left_n: np.ndarray | None = None, right_n: np.ndarray | None = None, least: tuple[int, int] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``left``, or between ``left`` and ``right``: pairs of row numbers, those of ``right`` after those of ``left``.

    Both hold a fingerprint a row (uint64 words) and are cut into pieces of neighbours. Two fingerprints differ in at least as many bits as the population counts of
    their quarters differ in sum, so two pieces whose ranges of counts lie further apart than the radius are skipped; all pairs of
    the others are compared. With ``least`` (p, q), pieces are skipped, too, if no two set sizes (``left_n``, ``right_n``) have a ratio of p / q.
    """
    n = len(left) + (0 if right is None else len(right))
    forest = _Forest(n)

    def pieces(fp: np.ndarray, size: np.ndarray | None, base: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        q = _quarters(fp)
        cuts = range(0, len(fp), PIECE)
        cols = [np.ascontiguousarray(fp[:, w]) for w in range(fp.shape[1])]
        ends = [(int(size[a : a + PIECE].min()), int(size[a : a + PIECE].max())) if size is not None else (0, 0) for a in cuts]
        return [(base + a, [c[a : a + PIECE] for c in cols]) for a in cuts], np.array([q[a : a + PIECE].min(0) for a in cuts], np.int64), np.array([q[a : a + PIECE].max(0) for a in cuts], np.int64), np.array(ends, np.int64).reshape(-1, 2)

    a_pieces, a_low, a_high, a_size = pieces(left, left_n, 0)
    b_pieces, b_low, b_high, b_size = (a_pieces, a_low, a_high, a_size) if right is None else pieces(right, right_n, len(left))
    for k, (at, x) in enumerate(a_pieces):
        apart = np.maximum(np.maximum(b_low - a_high[k], a_low[k] - b_high), 0).sum(1)
        near = apart <= radius
        if least is not None:
            p, q = least
            near &= (q * b_size[:, 1] >= p * a_size[k, 0]) & (q * a_size[k, 1] >= p * b_size[:, 0])
        for m in np.flatnonzero(near):
            if right is None and m < k:
                continue
            to, y = b_pieces[m]
            bits = np.bitwise_count(x[0][:, None] ^ y[0][None, :])
            for u, v in zip(x[1:], y[1:], strict=True):
                bits = bits + np.bitwise_count(u[:, None] ^ v[None, :])  # up to 3 words fit a byte
            i, j = np.nonzero(bits <= radius)
            if right is None and m == k:
                keep = i < j
                i, j = i[keep], j[keep]
            if len(i):
                forest.link(i + at, j + to)
    forest.flush()
    moved = np.flatnonzero(forest.label != np.arange(n))
    return moved, forest.label[moved]


def fingerprint_links(nodes: DataFrame, scratch: Scratch, radius: int = RADIUS, words: int = 1, least: tuple[int, int] | None = None) -> DataFrame:
    """(a, b): links between the nodes of ``nodes`` (node bigint, f0.. ``words`` bigints, and n, a set's size, with ``least``) that differ in at most ``radius`` bits.

    The links span the components: of those inside one pair of bands a spanning forest is kept. Nodes are put in the order of their sets' sizes, if given, and of their population counts, and
    packed into tiles of TILE; bands of whole tiles form a triangle of cells, a task each, which holds two bands at most (MOST_BAND rows each).
    Cells whose ranges of population counts or sizes lie further apart than the radius or ``least`` allow are left out before anything is sent.
    """
    spark = nodes.sparkSession
    names = [f"f{w}" for w in range(words)]
    part = lambda k: sum((F.bit_count(F.shiftrightunsigned(f, 16 * k).bitwiseAND(F.lit(0xFFFF))) for f in names), F.lit(0))
    pops = [part(k) for k in range(4)]
    size = F.col("n").cast("bigint") if least else F.lit(0).cast("bigint")
    # sizes by classes within which all pairs have the least ratio
    by_size = [F.floor(F.log(F.greatest(size, F.lit(1))) / F.log(F.lit(least[1] / least[0])))] if least else []
    ranked = with_row_number(nodes.select("node", *names, size.alias("n")), [*by_size, *pops, F.col("node")], "rn", scratch)
    total = ranked.count()
    rows = min(max(LEAST_BAND, -(-total // BANDS)), MOST_BAND)
    rows = -(-rows // TILE) * TILE
    div = lambda k: F.call_function("div", F.col("rn"), F.lit(k).cast("bigint"))
    tile = ranked.select("node", *names, "n", "rn", div(TILE).alias("tile"), div(rows).alias("band"))
    fields = ["node", *names, "n"]
    packed = tile.groupBy("band", "tile").agg(F.sort_array(F.collect_list(F.struct("rn", *fields))).alias("x"))
    tiles = scratch.table(packed.select("band", "tile", *[F.col(f"x.{c}").alias(c) for c in fields]))
    # a row for each band: n / MOST_BAND at most, or BANDS
    bounds = [f(p).alias(f"{s}{k}") for k, p in enumerate([*pops, F.col("n")]) for f, s in ((F.min, "l"), (F.max, "h"))]
    ranges = tile.groupBy("band").agg(*bounds).orderBy("band").collect()
    low = np.array([[r[f"l{k}"] for k in range(5)] for r in ranges], np.int64).reshape(-1, 5)
    high = np.array([[r[f"h{k}"] for k in range(5)] for r in ranges], np.int64).reshape(-1, 5)
    cells = []
    for g in range(len(ranges)):
        near = np.maximum(np.maximum(low[:, :4] - high[g, :4], low[g, :4] - high[:, :4]), 0).sum(1) <= radius
        if least:
            near &= (least[1] * high[:, 4] >= least[0] * low[g, 4]) & (least[1] * high[g, 4] >= least[0] * low[:, 4])
        cells += [(f"{g}-{h}", int(s)) for h in np.flatnonzero(near).tolist() if h >= g for s in {g, h}]
    wanted = spark.createDataFrame(cells, "cell string, band bigint")

    def compare(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        band, order = table.column("band").to_numpy(), np.argsort(table.column("tile").to_numpy(), kind="stable")
        lists = {c: table.column(c).combine_chunks() for c in fields}
        take = lambda c, b: np.concatenate([lists[c][int(k)].values.to_numpy(zero_copy_only=False) for k in order if band[k] == b])
        prints = lambda b: np.stack([take(f, b).view(np.uint64) for f in names], 1)
        g, h = map(int, cell.split("-"))
        if g == h:
            a, b = link_tiles(prints(g), None, radius, take("n", g), None, least)
            node = take("node", g)
        else:
            a, b = link_tiles(prints(g), prints(h), radius, take("n", g), take("n", h), least)
            node = np.concatenate((take("node", g), take("node", h)))
        return pa.table({"a": node[a], "b": node[b]})

    return tiles.join(wanted, "band").groupBy("cell").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(uid, doc_id, fp bigint, root bigint, component_id): each row's fingerprint, the least fingerprint of its component, and the least doc_id of the documents linked to it, directly or by others.

    Documents with equal fingerprints are one node, so copies cost one comparison however many they are.
    Null and empty texts have fingerprint 0 and are linked like any other. A null doc_id takes no part in the minimum; a
    component of only such rows has a null id. Repeated rows give repeated results; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.table(fingerprints(docs, shingle, seed))
    nodes = scratch.table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = scratch.table(fingerprint_links(nodes.select(F.col("fp").alias("node"), F.col("fp").alias("f0")), scratch, radius))
    linked = connected_components(links, scratch).withColumnRenamed("node", "fp")
    own = scratch.table(linked.join(nodes, "fp").select("fp", "component", "least"))
    least = scratch.table(own.groupBy("component").agg(F.min("least").alias("component_id")))
    named = own.join(least, "component").select("fp", "component", F.col("component_id").alias("_c"))
    ids = scratch.table(nodes.join(named, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"), F.coalesce("_c", "least").alias("component_id")))
    return prints.join(ids, "fp").select("uid", "doc_id", "fp", "root", "component_id")


def deduplicate_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every document; see ``near_duplicates``."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
