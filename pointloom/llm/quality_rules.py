"""Operator 2: quality rules and a hashed n-gram log-likelihood ratio (SQL functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import SPACE, let

#: Hash buckets of the two multinomials; bounds what is broadcast (8 bytes a bucket).
BUCKETS = 1 << 16
#: Trusted documents that the target multinomial is fitted on, those with the smallest hash of their id.
TRUSTED_DOCS = 20_000
#: Pseudo-counts a bucket.
PRIOR = 4.0
#: Documents whose mean log-likelihood ratio is below this are not kept; a fifth of a nat below even leaves room for the noise of short texts.
THRESHOLD = -0.2


def _blanks(text: Column) -> Column:
    """``text`` (null: none) with a blank for each white-space character. Rare ones are looked for first, which takes a fraction of a replacement's time."""
    text = F.coalesce(text, F.lit(""))
    rare = "\t\x0b\x0c\r"
    some = reduce(lambda t, c: t | c, [F.contains(text, F.lit(c)) for c in rare])
    return F.replace(F.when(some, reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), rare, text)).otherwise(text), F.lit("\n"), F.lit(" "))


def _parts(blanks: Column) -> Column:
    """What lies between the blanks, one more than these. A split at one fixed character needs no pattern matching."""
    return F.split(blanks, " ")


def rule_counts(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint) and base_failed for the column ``text``.

    Five-word windows are told apart by a 64-bit hash of their words. The windows of a document are only sorted
    if two of them are equal, and then by (hash, position), so a long text costs n log n.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    counted = lambda parts: let(_hashes(parts), lambda ids: F.struct(F.size(parts).alias("p"), F.size(ids).alias("n"), _repeat_words(ids).alias("r")))
    counts = let(_parts(_blanks(F.col("text"))), counted)
    t = df.withColumn("_c", counts)
    return t.select(
        *df.columns, F.col("_c.n").cast("bigint").alias("n_words"), (F.length(text) - F.col("_c.p") + 1).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        F.col("_c.r").cast("bigint").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))


def _repeat_words(ids: Column) -> Column:
    """Positions of ``ids`` that lie in a window of five which occurs again.

    Arrays that are used more than once are bound by ``let``: Catalyst may move an expression into a filter, and would
    then compute an array anew for every element that a lambda looks up in it.
    """
    five = F.transform(F.sequence(F.lit(0), F.size(ids) - 5), lambda i: F.xxhash64(ids[i], ids[i + 1], ids[i + 2], ids[i + 3], ids[i + 4]))

    def covered(p: Column) -> Column:
        # a window covers its five words less what the next one covers again
        own = F.transform(p, lambda at, k: F.least(F.coalesce(F.get(p, k + 1) - at, F.lit(5)), F.lit(5)))
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        again = F.filter(s, lambda x, k: (F.get(s, k + 1)["h"] == x["h"]) | ((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"])))
        return let(F.sort_array(F.transform(again, lambda x: x["i"])), covered)

    by_hash = lambda h: F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
    some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(by_hash(h), repeated)).otherwise(F.lit(0))
    return F.when(F.size(ids) >= 6, let(five, some)).otherwise(F.lit(0))


def token_ids(text: Column) -> Column:
    """A hash for each token of a text; a punctuation mark or symbol is a token of its own."""
    return _hashes(_parts(F.regexp_replace(_blanks(text), r"([^\p{L}\p{N} ])", " $1 ")))


def _hashes(parts: Column) -> Column:
    """A hash for each part that isn't empty."""
    return F.transform(F.array_remove(parts, ""), lambda w: F.xxhash64(w))


def _one(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1).cast("bigint"))


def _two(t: Column, h: Column, i: Column) -> Column:
    """The bucket of a token and its successor; null for the last token."""
    return F.when(i + 1 < F.size(t), F.xxhash64(h, F.get(t, i + 1)).bitwiseAND(F.lit(BUCKETS - 1).cast("bigint")))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_DOCS) -> DataFrame:
    """Ids of at most ``limit`` documents labelled of high quality and not toxic."""
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id")
    return good.groupBy("doc_id").agg(F.xxhash64("doc_id").alias("_o")).orderBy("_o", "doc_id").limit(limit).select("doc_id")


def fit_weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row ``w``: an array of BUCKETS log ratios, log p(bucket | trusted) - log p(bucket | corpus).

    The corpus counts cover every n-gram of every document. Counts are
    summed before the shuffle, so it moves at most BUCKETS rows a task.
    """
    t = docs.select("doc_id", "text").join(F.broadcast(trusted.withColumn("_good", F.lit(1))), "doc_id", "left")
    both = let(token_ids(F.col("text")), lambda t: F.concat(F.transform(t, _one), F.transform(t, lambda h, i: _two(t, h, i))))
    grams = t.select(F.col("_good"), F.explode_outer(both).alias("b")).where("b is not null")
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("_good").alias("good"))
    totals = counts.agg(F.sum("raw").alias("raws"), F.sum("good").alias("goods"))
    # against the count expected if the trusted documents were like the corpus
    expected = F.col("raw") * F.col("goods") / F.col("raws")
    ratio = F.log((F.col("good") + PRIOR) / (expected + PRIOR))
    pairs = counts.crossJoin(F.broadcast(totals)).select("b", F.when(F.col("goods") > 0, ratio).otherwise(F.lit(0.0)).alias("r"))
    every = pairs.sparkSession.range(BUCKETS, numPartitions=1).join(pairs, F.col("id") == F.col("b"), "left").select("id", F.coalesce("r", F.lit(0.0)).alias("r"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "r"))), lambda x: x["r"]).alias("w"))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds the counts of ``rule_counts``, ``llr`` (length-normalised log-likelihood ratio) and ``kept`` to all rows.

    A document is kept if the base rules pass and its mean log ratio over all n-grams reaches ``threshold``.
    Null and empty texts have no words and fail; without trusted documents the ratio is 0 throughout and the rules decide alone.
    Rows with a null doc_id are judged like others (they can't be trusted ones). Columns of the same names are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    docs = docs.drop(*made)
    # BUCKETS numbers, folded into one constant of the plan (subqueries are not allowed in lambdas)
    w = F.split(F.lit(",".join(f"{x:.9g}" for x in fit_weights(docs, trusted_ids(labels)).first()["w"])), ",").cast("array<double>")
    n = lambda t: F.size(t) * 2 - 1
    ratio = lambda t: F.transform(t, lambda h, i: F.get(w, _one(h)) + F.coalesce(F.get(w, _two(t, h, i)), F.lit(0.0)))
    mean = lambda t: F.when(F.size(t) > 0, F.aggregate(ratio(t), F.lit(0.0), lambda a, r: a + r) / n(t)).otherwise(F.lit(0.0))
    scored = rule_counts(docs).withColumn("llr", let(token_ids(F.col("text")), mean))
    return scored.select(*docs.columns, *made[:-1], (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"))


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The verdicts by doc_id; for the contents of each column see ``quality_rules``."""
    out = quality_rules(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
