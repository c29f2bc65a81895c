"""Belief propagation by joins and sums: k-state pairwise graphs and factor graphs, in logarithms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.plans.lineage import cut

#: Rounds between two cuts of the lineage.
CUT_EVERY = 3


def log_sum(x: Column) -> Column:
    """log(sum(exp(x))) of an array, without overflow."""
    top = F.array_max(x)
    return top + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top)))


def normalised(x: Column) -> Column:
    return F.transform(F.array(log_sum(x)), lambda z: F.transform(x, lambda v: v - z))[0]


def _plus(a: Column, b: Column, sign: int = 1) -> Column:
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def _log(x: Column) -> Column:
    """Logarithms of an array; zeros become the least positive double."""
    return F.transform(x, lambda v: F.log(F.greatest(v, F.lit(2.2250738585072014e-308))))


def pairwise(vertices: DataFrame, edges: DataFrame, states: int, rounds: int = 50, eps: float = 1e-3) -> DataFrame:
    """(id, belief): normalised beliefs of ``vertices`` (id, prior array<double>) joined by ``edges`` (src, dst, factor array<double>, row src state, column dst state).

    Every round is two equi-joins and one sum, combined before its shuffle; it stops once no belief moves by ``eps`` or more. A vertex without edges keeps its prior.
    """
    k = range(states)
    f = _log(F.col("factor"))
    forth = edges.select("src", "dst", f.alias("f"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.array(*[f[i * states + j] for j in k for i in k]).alias("f"))
    ways = cut(forth.unionByName(back))
    prior = cut(vertices.select("id", normalised(_log(F.col("prior"))).alias("prior")))
    zero = F.array(*[F.lit(0.0)] * states)
    msgs = ways.select("src", "dst", zero.alias("m"))
    belief = prior.select("id", F.col("prior").alias("belief"))
    for turn in range(1, rounds + 1):
        other = msgs.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("m").alias("back"))
        left = ways.join(other, ["src", "dst"]).join(belief.withColumnRenamed("id", "src"), "src")
        rest = left.select("src", "dst", "f", _plus(F.col("belief"), F.col("back"), -1).alias("r"))
        new = F.array(*[log_sum(F.array(*[F.col("f")[i * states + j] + F.col("r")[i] for i in k])) for j in k])
        msgs = rest.select("src", "dst", normalised(new).alias("m"))
        if turn % CUT_EVERY == 0:
            msgs = cut(msgs)
        got = msgs.groupBy(F.col("dst").alias("id")).agg(F.array(*[F.sum(F.col("m")[i]) for i in k]).alias("s"))
        old = belief.withColumnRenamed("belief", "old")
        now = prior.join(got, "id", "left").select("id", normalised(_plus(F.col("prior"), F.coalesce("s", zero))).alias("belief"))
        if turn % CUT_EVERY == 0:
            now = cut(now)
            moved = now.join(old, "id").agg(F.max(F.array_max(F.zip_with("belief", "old", lambda x, y: F.abs(F.exp(x) - F.exp(y)))))).first()[0]
            if moved is None or moved < eps:
                belief = now
                break
        belief = now
    return belief.select("id", F.transform("belief", F.exp).alias("belief"))


def factor_graph(priors: DataFrame, factors: DataFrame, rounds: int = 20, eps: float = 1e-3) -> DataFrame:
    """(id, belief): beliefs of variables ``priors`` (id, prior) under ``factors`` (id, vars array<bigint>, cards array<int>, values array<double>, the first variable changing fastest).

    A factor's row holds its whole table; its messages to all of its variables come from one pass over the table. A variable's row in ``priors`` has an
    entry for each state. It stops once no message moves by ``eps`` or more.
    """
    prior = cut(priors.select("id", normalised(_log(F.col("prior"))).alias("prior")))
    tables = cut(factors.select(F.col("id").alias("fid"), "vars", F.transform("cards", lambda c: c.cast("bigint")).alias("cards"), _log(F.col("values")).alias("values")))
    slots = tables.select("fid", F.posexplode("vars").alias("pos", "id"))
    msgs = cut(slots.join(prior, "id").select("fid", "pos", "id", F.transform("prior", lambda _: F.lit(0.0)).alias("m")))
    divided = lambda a, b: F.call_function("div", a, b)
    stride = lambda cards, q: F.aggregate(F.slice(cards, 1, q), F.lit(1).cast("bigint"), lambda a, c: a * c)

    def total(m: DataFrame) -> DataFrame:
        sums = m.select("id", F.posexplode("m").alias("s", "v")).groupBy("id", "s").agg(F.sum("v").alias("v"))
        lists = sums.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("s", "v"))), lambda x: x["v"]).alias("sum"))
        return prior.join(lists, "id", "left").select("id", F.when(F.col("sum").isNull(), F.col("prior")).otherwise(_plus(F.col("prior"), F.col("sum"))).alias("b"))

    for _ in range(rounds):
        into = msgs.join(total(msgs), "id").select("fid", "pos", normalised(_plus(F.col("b"), F.col("m"), -1)).alias("q"))
        ins = into.groupBy("fid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "q"))), lambda x: x["q"]).alias("ins"))
        t = tables.join(ins, "fid").withColumn("strides", F.transform("cards", lambda c, q: stride(F.col("cards"), q)))
        digit = lambda i, q: divided(i, F.get("strides", q)) % F.get("cards", q)
        whole = F.transform("values", lambda v, i: F.aggregate(F.transform("ins", lambda x, q: F.get(x, digit(i, q).cast("int"))), v, lambda a, x: a + x))
        one = t.withColumn("all", whole).select("fid", F.posexplode("vars").alias("pos", "id"), "all", "ins", "cards", "strides")
        card, step, own = F.get("cards", F.col("pos")), F.get("strides", F.col("pos")), F.get("ins", F.col("pos"))
        sums = F.transform(F.sequence(F.lit(0).cast("bigint"), card - 1), lambda s: log_sum(F.filter("all", lambda _, i: divided(i.cast("bigint"), step) % card == s)) - F.get(own, s.cast("int")))
        new = cut(one.select("fid", "pos", "id", normalised(sums).alias("m")))
        moved = new.join(msgs.withColumnRenamed("m", "old"), ["fid", "pos", "id"]).agg(F.max(F.array_max(F.zip_with("m", "old", lambda x, y: F.abs(F.exp(x) - F.exp(y)))))).first()[0]
        msgs = new
        if moved is None or moved < eps:
            break
    return total(msgs).select("id", F.transform(normalised(F.col("b")), F.exp).alias("belief"))


def two_state(prior: DataFrame, edges: DataFrame, rounds: int = 50, eps: float = 1e-3) -> DataFrame:
    """(id, p0, p1): beliefs on two states, divided by the greater one. ``prior`` (id, prior) and ``edges`` (src, dst, factor by rows) as for ``pairwise``."""
    b = F.col("belief")
    return pairwise(prior, edges, 2, rounds=rounds, eps=eps).select("id", (b[0] / F.array_max(b)).alias("p0"), (b[1] / F.array_max(b)).alias("p1"))
