"""Operator 1 for a least similarity: SimHash candidates of the tiled comparison, verified by the true Jaccard similarity of word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import Scratch, give_back, with_marks, with_row_number, with_uid
from pointloom.llm.components import connected_components
from pointloom.llm.simhash import _Forest, fingerprint_links, set_fingerprint, shingle_hashes

SHINGLE = 5
#: Texts are linked if their shingle sets have a Jaccard similarity of LEAST[0] / LEAST[1] or more.
LEAST = (4, 5)
#: 64-bit words of a fingerprint, and the radius of the tiled comparison. Two sets of similarity 0.8 have a cosine of 8/9, so each of the 128 bits differs with
#: probability acos(8/9) / pi = 0.152: 19.4 bits on average with a deviation of 4.06, of which 34 is 3.6 deviations away. Unlike sets differ in 64, with a deviation of 5.7; more words suit more than some 10**8 sets.
WORDS, RADIUS = 2, 34
#: Sets of a block by their size: up to so many shingles, so many sets.
BLOCKS = ((4096, 1024), (32_768, 128), (1 << 62, 16))
#: Cells of the matrix that counts common shingles of dense blocks, at once.
_COLUMNS = 2048


def shingle_set(raw: bytes) -> np.ndarray:
    """The distinct hashes of the SHINGLE-word shingles of a UTF-8 text, sorted; none without words. A-Z become a-z; a text of fewer words is one shingle."""
    parts = list(shingle_hashes(raw, SHINGLE))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> int:
    """A 64-bit digest of a set; texts of equal sets are one node."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def common_counts(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set but the last: its number, and how many elements each later set has in common with it.

    Elements that one set alone has are left out. The others are counted by their lists of owners or, where these are long (many near-copies), by products of 0-1 matrices.
    """
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[inverse] > 1
    owner, item = owner[keep], (np.cumsum(count > 1) - 1)[inverse[keep]]
    count = count[count > 1].astype(np.int64)
    if float((count.astype(np.float64) ** 2).sum()) > 0.05 * m * m * len(count) and m > 64:
        total = np.zeros((m, m), np.float32)  # counts below 2**24 are exact
        order = np.argsort(item, kind="stable")
        o, k = owner[order], item[order]
        for a in range(0, len(count), _COLUMNS):
            lo, hi = np.searchsorted(k, (a, a + _COLUMNS))
            has = np.zeros((m, _COLUMNS), np.float32)
            has[o[lo:hi], k[lo:hi] - a] = 1
            total += has @ has.T
        for i in range(m - 1):
            yield i, total[i, i + 1 :].astype(np.int64)
        return
    order = np.argsort(item, kind="stable")
    owners = owner[order]
    first = np.cumsum(count) - count
    starts = np.searchsorted(owner, np.arange(m + 1))
    for i in range(m - 1):
        mine = item[starts[i] : starts[i + 1]]
        n = count[mine]
        at = np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        yield i, np.bincount(owners[at], minlength=m)[i + 1 :]


def similar_links(sets: list[np.ndarray], side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs with similarity LEAST or more, counted in whole numbers; with ``side``, of those on different sides."""
    p, q = LEAST
    size = np.array([len(s) for s in sets], np.int64)
    forest = _Forest(len(sets))
    if len(sets) > 1:
        for i, common in common_counts(sets):
            both = size[i] + size[i + 1 :] - common
            found = (q * common >= p * both) & (common > 0)
            if side is not None:
                found &= side[i + 1 :] != side[i]
            j = np.flatnonzero(found) + i + 1
            if len(j):
                forest.link(np.full(len(j), i), j)
        forest.flush()
    moved = np.flatnonzero(forest.label != np.arange(len(sets)))
    return moved, forest.label[moved]


def _verify(table: pa.Table) -> pa.Table:
    """Links of a cell: within one block (or a bucket of small components), or between two blocks."""
    node, block = table.column("node").to_numpy(), table.column("block").to_pylist()
    sets = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in table.column("items")]
    two = table.column("cell")[0].as_py().split("|")[-1].split("/")
    side = np.array([b == two[0] for b in block]) if len(two) == 2 and two[0] != two[1] else None
    a, b = similar_links(sets, side)
    return pa.table({"a": node[a], "b": node[b]})


def _cells(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(cell, block, node): where the members (node, component, n) of candidate components are verified.

    Members go by size into blocks of bounded size. A component of one block is verified with others of a like place; of larger ones, each pair of blocks whose sizes
    may have the least ratio is a cell, so that no task holds more than two blocks however large a component is.
    """
    p, q = LEAST
    kind = F.when(F.col("n") <= BLOCKS[0][0], 0).when(F.col("n") <= BLOCKS[1][0], 1).otherwise(2)
    room = F.element_at(F.array(*[F.lit(b).cast("bigint") for _, b in BLOCKS]), F.col("kind") + 1)
    ranked = with_row_number(members.withColumn("kind", kind), [F.col("component"), F.col("n"), F.col("node")], "rn", scratch)
    starts = ranked.groupBy("component", "kind").agg(F.min("rn").alias("start"))
    placed = ranked.join(starts, ["component", "kind"])
    block = F.concat_ws(".", "kind", F.call_function("div", F.col("rn") - F.col("start"), room))
    placed = scratch.table(placed.select("component", "kind", "node", "n", "start", block.alias("block")))
    blocks = scratch.table(placed.groupBy("component", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("kind").alias("kind"), F.min("start").alias("start")))
    large = scratch.table(blocks.groupBy("component").agg(F.count("*").alias("k")).where("k > 1").select("component"))
    small = placed.join(large, "component", "left_anti")
    alone = small.select(F.concat_ws(".", F.lit("small"), "kind", F.call_function("div", F.col("start"), room)).alias("cell"), "block", "node")
    mine = blocks.join(large, "component")
    pairs = mine.alias("x").join(mine.alias("y"), (F.col("x.component") == F.col("y.component")) & (F.col("x.block") <= F.col("y.block")) & (F.col("y.most") * q >= F.col("x.least") * p) & (F.col("x.most") * q >= F.col("y.least") * p))
    name = F.concat(F.col("x.component").cast("string"), F.lit("|"), F.col("x.block"), F.lit("/"), F.col("y.block"))
    wanted = pairs.select(F.col("x.component").alias("component"), name.alias("cell"), F.explode(F.array_distinct(F.array("x.block", "y.block"))).alias("block"))
    shared = placed.join(scratch.table(wanted), ["component", "block"]).select("cell", "block", "node")
    return scratch.table(alone.unionByName(shared))


def near_copies(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, root) for ``docs`` (uid, _d; see ``with_uid``): each row's number, and the least node of the texts linked to its own, directly or by others.

    1. Texts of equal shingle sets are one node, with a SimHash of its set; the tiled comparison finds the nodes within RADIUS bits of each other.
    2. In each component of such candidates, all pairs of sets are verified, block by block: a link is a pair whose true similarity reaches LEAST. A pair inside a
       component is found whether or not its own fingerprints are near, so only pairs in different components of candidates can be missed.

    Null and empty texts are one node.
    """
    scratch = Scratch(docs.sparkSession)
    names = [f"f{w}" for w in range(WORDS)]

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            node, n, prints = [], [], []
            for x in b.column("text"):
                s = shingle_set(x.as_py() or b"")
                node.append(set_key(s))
                n.append(len(s))
                prints.append(set_fingerprint(s, WORDS))
            f = np.stack(prints).view(np.int64) if prints else np.zeros((0, WORDS), np.int64)
            cols = [b.column("uid"), b.column("doc_id"), pa.array(node, pa.int64()), pa.array(n, pa.int64()), *(pa.array(np.ascontiguousarray(f[:, w])) for w in range(WORDS))]
            yield pa.RecordBatch.from_arrays(cols, ["uid", "doc_id", "node", "n", *names])
        give_back()

    def items(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [shingle_set(x.as_py() or b"") for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["node", "items"])
        give_back()

    rows = docs.select("uid", F.col("_d.doc_id").cast("bigint").alias("doc_id"), F.col("_d.text").cast("binary").alias("text"))
    prints = scratch.table(rows.mapInArrow(keys, f"uid bigint, doc_id bigint, node bigint, n bigint, {', '.join(f'{f} bigint' for f in names)}"))
    nodes = scratch.table(prints.groupBy("node").agg(F.min("uid").alias("uid"), *[F.min(c).alias(c) for c in ("n", *names)]))
    near = scratch.table(fingerprint_links(nodes.select("node", "n", *names), scratch, RADIUS, WORDS, LEAST))
    candidates = scratch.table(connected_components(near, scratch))
    members = scratch.table(candidates.join(nodes, "node").select("node", "component", "n", "uid"))
    cells = _cells(members.select("node", "component", "n"), scratch)
    sets = scratch.table(with_marks(rows.select("uid", "text"), members.select("uid", F.lit(1).alias("mark")), scratch).mapInArrow(items, "node bigint, items array<bigint>"))
    links = scratch.table(cells.join(sets, "node").groupBy("cell").applyInArrow(_verify, "a bigint, b bigint"))
    labels = scratch.table(connected_components(links, scratch).select("node", F.col("component").alias("label")))
    return prints.join(labels, "node", "left").select("uid", "doc_id", F.coalesce("label", "node").alias("root"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of least doc_id (a null one last), of rows that share it that of least uid.

    All columns are kept as they are, whatever their names. Null and empty texts are copies of each other; a text of one to four words is a copy of those with the
    same words. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    placed = with_uid(docs, [F.struct("*").alias("_d")], scratch)
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid"))["uid"]
    marks = near_copies(placed).groupBy("root").agg(best.alias("uid")).select("uid", F.lit(1).alias("mark"))
    return with_marks(placed, marks, scratch).select("_d.*")
