"""Words are found with one replacement a white-space character, and only where a text has the rare ones."""

import random
import re

from pointloom.llm import quality_rules


def test_white_space_is_replaced_once(spark):
    df = spark.createDataFrame([("a b",)], "text string")
    for out in (quality_rules.rule_counts(df), df.select(quality_rules.token_ids(df.text).alias("t"))):
        plan = out._jdf.queryExecution().analyzed().toString()
        assert len(re.findall(r"(?<!regexp_)\breplace\(", plan)) == 5 and "array_remove(" in plan


def test_words_and_their_characters(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices("ab é😀#\t\n\x0b\x0c\r\x1c　 .", k=rng.randint(0, 60))) for _ in range(500)]
    texts += ["", " ", "\n", "\r\n", "x", " x ", "\tx\x0by\x0cz\r", "no rare ones\nhere  at all ", None]
    got = quality_rules.rule_counts(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.k] or "")
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
