"""Operator 6: mixing sources to target weights by pivotal dependent rounding (SQL functions only)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import SPACE, Scratch, let, with_marks, with_row_number, with_uid

BLOCK = 64


def n_words(text: Column) -> Column:
    """Words of a text, a bigint; null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple, stop: float, scratch: Scratch) -> DataFrame:
    """(source, source_size, docs, target, k): each source's share of the total by repeating ``weights``.

    ``sizes``: (source, source_size, docs). Sources go by code point, null last. Targets stop at ``stop`` times the
    source's size; the excess is shared again by weight until none is above. Rounds aggregate
    over the sources table and bring three scalars to the driver, however many sources there are.
    """
    src = F.col("source")
    t = with_row_number(sizes, [src.isNull(), src], "k", scratch)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    t = scratch.table(t.withColumn("w", w))
    total = float(t.agg(F.sum("source_size")).first()[0] or 0)
    level, open_w = None, t.agg(F.sum("w")).first()[0] or 0.0
    capped = -1
    left = total
    while open_w:
        level = left / open_w
        over = F.col("w") * level > F.col("source_size") * stop
        n, held, rest_w = t.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
        if n == capped:
            break
        capped, left, open_w = n, total - stop * float(held), rest_w
    share = F.least(F.col("w") * F.lit(level or 0.0), F.col("source_size") * F.lit(float(stop)))
    return t.select("source", "source_size", "docs", share.cast("double").alias("target"), "k")


def _uniform(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(float(1 << 53))


def _pivot(acc: Column, x: Column, seed: int) -> Column:
    """One pairing: moves words between the carried fraction ``acc.c`` and ``x`` until one of them is integral."""
    c = acc["c"]
    item = lambda rn, size, p: F.struct(rn.alias("rn"), size.alias("size"), p.alias("p"))
    done = lambda rn, up: F.concat(acc["done"], F.array(F.struct(rn.alias("rn"), F.lit(up).alias("up"))))

    def move(s: Column) -> Column:
        # raising c by d words lowers x by d, and the other way round; the odds keep both means
        c_up = s["d1"] > s["u"] * (s["d1"] + s["d2"])
        c_room, x_room = (1 - c["p"]) * c["size"], (1 - x["p"]) * x["size"]
        c_has, x_has = c["p"] * c["size"], x["p"] * x["size"]
        kept = lambda who, words: item(who["rn"], who["size"], F.least(F.greatest(words / who["size"], F.lit(0.0)), F.lit(1.0)))
        state = lambda carry, decided: F.struct(carry.alias("c"), decided.alias("done"))
        return (
            F.when(c_up & (c_room <= x_has), state(kept(x, x_has - c_room), done(c["rn"], 1)))
            .when(c_up, state(kept(c, c_has + x_has), done(x["rn"], 0)))
            .when(c_has <= x_room, state(kept(x, x_has + c_has), done(c["rn"], 0)))
            .otherwise(state(kept(c, c_has - x_room), done(x["rn"], 1)))
        )

    # the chance of raising c is d_down / (d_up + d_down), d being the words that each direction may move
    up, down = F.least((1 - c["p"]) * c["size"], x["p"] * x["size"]), F.least(c["p"] * c["size"], (1 - x["p"]) * x["size"])
    moved = let(F.struct(down.alias("d1"), up.alias("d2"), _uniform(F.lit(seed), c["rn"], x["rn"]).alias("u")), move)
    return F.when(c.isNull(), F.struct(item(x["rn"], x["size"], x["p"]).alias("c"), acc["done"].alias("done"))).otherwise(moved)


def pivotal_rounding(items: DataFrame, n: int, seed: int, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Rounds fractions to (rn, up) with ``up`` 0 or 1, keeping the sum of size * p within each group to one item's size.

    ``items``: (grp bigint, rn bigint below ``n``, size double > 0, p double strictly between 0 and 1), rn unique.
    A reduction tree: blocks of ``block`` neighbours are folded pair by pair and leave one
    residual each, which are the items of the next level, until a group has one, rounded by its own odds.
    """
    seen = None
    level = items.select("grp", "rn", "size", "p", F.call_function("div", F.col("rn"), F.lit(block).cast("bigint")).alias("blk"))
    width = n
    while True:
        width = -(-width // block)
        group = F.sort_array(F.collect_list(F.struct("rn", "size", "p")))
        start = F.struct(F.lit(None).cast("struct<rn:bigint,size:double,p:double>").alias("c"), F.array().cast("array<struct<rn:bigint,up:int>>").alias("done"))
        # _pivot reads the carry only once it is there
        folded = scratch.table(level.groupBy("grp", "blk").agg(group.alias("x")).select("grp", "blk", F.aggregate("x", start, lambda acc, x: _pivot(acc, x, seed)).alias("s")))
        decided = folded.select(F.explode("s.done").alias("d")).select("d.rn", "d.up")
        seen = decided if seen is None else seen.unionByName(decided)
        level = folded.where("s.c is not null").select("grp", "s.c.rn", "s.c.size", "s.c.p", F.call_function("div", F.col("blk"), F.lit(block).cast("bigint")).alias("blk"))
        if width <= 1:
            break
    last = level.select("rn", F.when(_uniform(F.lit(seed), F.col("rn"), F.lit(-1)) < F.col("p"), 1).otherwise(0).alias("up"))
    return seen.unionByName(last)


def _round_by_size(sized: DataFrame, n: int, seed: int, scratch: Scratch) -> DataFrame:
    """(rn, up) for the rows of ``sized`` whose ``want`` has a fraction: large documents first, small ones last.

    Three size classes (over 4 times the source's mean, over half of it, the rest) are rounded in turn. The words by which a class misses
    are spread evenly over the fractions of the classes still open, which keeps each
    document's odds in the mean and leaves the last miss to a document below half the mean size.
    """
    part = F.col("want") - F.floor("want")
    mean = F.col("source_size") / F.col("docs")
    rank = F.when(F.col("size") > mean * 4, 0).when(F.col("size") > mean / 2, 1).otherwise(2)
    open_rows = scratch.table(sized.where((F.col("size") > 0) & (part > 0)).select(F.col("k").alias("grp"), "rn", F.col("size").cast("double").alias("size"), part.alias("p"), rank.alias("rank")))
    ups, miss = [], None
    for r in range(3):
        rows = open_rows.where(F.col("rank") == r)
        if miss is not None:
            rows = rows.join(miss, "grp", "left").select("grp", "rn", "size", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") + F.coalesce("shift", F.lit(0.0)))).alias("p"))
        rows = scratch.table(rows.select("grp", "rn", "size", "p"))
        whole = rows.where("p <= 0 or p >= 1").select("rn", F.when(F.col("p") >= 1, 1).otherwise(0).alias("up"))
        ups.append(scratch.table(pivotal_rounding(rows.where("p > 0 and p < 1"), n, seed + r, scratch).unionByName(whole)))
        if r < 2:
            got = reduce(DataFrame.unionByName, ups)
            sums = open_rows.join(got, "rn", "left").groupBy("grp").agg(
                F.sum(F.when(F.col("rank") <= r, F.col("size") * (F.col("p") - F.coalesce("up", F.lit(0))))).alias("miss"), F.sum(F.when(F.col("rank") > r, F.col("size"))).alias("rest")
            )
            miss = scratch.table(sums.select("grp", F.when(F.col("rest") > 0, F.coalesce("miss", F.lit(0.0)) / F.col("rest")).otherwise(F.lit(0.0)).alias("shift")))
    return reduce(DataFrame.unionByName, ups)


def mix_documents(docs: DataFrame, row_id: Column | None = None, weights: tuple = (5, 2, 1), stop: float = 3.0, seed: int = 5) -> DataFrame:
    """How many copies of each document the mix takes: doc_id, size, source_size, target, taken, copies.

    A document's expected copies are its source's target over its source's size, at most ``stop``;
    the whole part is taken and the rest rounded by ``pivotal_rounding`` over words, so a source's taken words miss its target
    by less than one of its smaller documents (or of those it has). ``row_id``: an expression of ``docs`` to carry along as ``row_id``.

    Null texts and texts without a word have size 0 and are not taken. A null source is a source of its own.
    Equal rows are interchangeable; a null doc_id is kept; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    extra = [row_id.alias("row_id")] if row_id is not None else []
    text = F.coalesce("text", F.lit(""))
    small = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(text).alias("_h"), *extra)
    # in each source, documents are paired in the order of a hash of their ids; the text only tells rows of one id apart
    order = [F.col("source").isNull(), F.col("source"), F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id"), F.col("size"), F.col("_h")]
    # written first: numbering samples its input, which would count the words of every text twice
    rows = scratch.table(with_row_number(scratch.table(small), order, "rn", scratch))
    n = rows.count()
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    targets = scratch.table(source_targets(sums, weights, stop, scratch))
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sized = rows.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "source_size", "docs", "target", "k", want.alias("want"))
    ups = _round_by_size(sized, max(n, 1), seed, scratch)
    copies = F.when(F.col("size") > 0, F.floor("want").cast("bigint") + F.coalesce("up", F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    out = sized.join(ups, "rn", "left").withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *(["row_id"] if extra else []))


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), stop: float = 3.0, seed: int = 5) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as ``mix_documents`` takes it, with the columns of ``docs``.

    Rows are matched by ``with_uid``.
    """
    scratch = Scratch(docs.sparkSession)
    placed = with_uid(docs, [F.struct("*").alias("_d")], scratch)
    copies = mix_documents(placed.select("uid", "_d.doc_id", "_d.source", "_d.text"), F.col("uid"), weights, stop, seed).where("copies > 0")
    marks = copies.select(F.col("row_id").alias("uid"), F.col("copies").cast("int").alias("mark"))
    taken = with_marks(placed, marks, scratch, "_copies", math.ceil(stop).bit_length())
    return taken.select("_d", F.explode(F.sequence(F.lit(1), "_copies"))).select("_d.*")
