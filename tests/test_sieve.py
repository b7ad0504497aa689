"""Sieves: patterns that are looked for only where a wider form of them matches give what they give alone."""

import itertools

from pyspark.sql import functions as F

from granary.functions import evidence, mining, scores, sieve, text
from granary.functions import fixed as V

SIEVES = [scores.RELEVANCE_SIEVE, scores.EVENT_SIEVE, scores.TOPIC_SIEVE, evidence.ANCHOR_SIEVE, text.DENSITY_SIEVE, text.INFO_SIEVE, text.SEMANTIC_SIEVE, text.UI_SIEVE]
WORDS = (
    "AI", "A.I.", "Series　B", "seed round", "$5", "$5, é", "$,é", "£3B", "12%", "12 B", "٣%", "v1.2.3", "2024", "OpenAI", "open\x85source", "open source", "HumanEval+", "基準測試", "權重", "hallucinated", "GPT-4o", "Mistral-é", "ınference",
    "İnference", "ſeed funding", "Kling", "last x was", "Last é was", "WHY IT MATTERS:", "的趨勢", "was ...", "and", "，", "3 gb", "5億美元", "$2.5 billion", "R1", "sign in", "cookies", "launch", "May", "fine_tune", "M&A", "a 7B model",
)


def test_sieves_lose_nothing(spark):
    rows = [(a + w + b,) for w, a, b in itertools.product(WORDS, ("", "é", "x ", "x", "_", "—", "é", "準"), ("", "é", " é", ".", "_", "\n", "準", "́", "-é"))]
    df = spark.createDataFrame([*rows, ("",)], "t string").repartition(4).cache()
    for own in SIEVES:
        patterns = [p for p in own.at if p not in ("hints", "entities", "boiler")]
        x = df.select("t", own.of(F.col("t")).alias("bits"))
        bad = x.select(*(F.count_if((own.count(F.col("bits"), F.col("t"), p) != F.regexp_count("t", F.lit(p))) | (own.has(F.col("bits"), F.col("t"), p) != F.col("t").rlike(p))).alias(str(i)) for i, p in enumerate(patterns))).first()
        assert not any(bad), [p for p, n in zip(patterns, bad, strict=True) if n]
    got = df.select(F.count_if(text.count_sentences(F.col("t")) != F.regexp_count("t", F.lit(V.SENTENCE)))).first()
    assert got[0] == 0


def test_texts_without_a_word_pass_no_sieve(spark):
    """The engine of patterns is asked about few texts; this is what makes the queries fast."""
    plain = spark.createDataFrame([("Thonre was anly hend oftionnten, enti wherer anhe ntedin thhe.",)], "t string")
    for own in SIEVES[:4]:
        assert plain.select(own.of(F.col("t"))).first()[0] == 0
    assert sieve.widened(r"(?iU)\b(?:a|b\s)\b(?!x)c*+") == r"(?i)\b(?:a|b[\s\x0b\x1c-\x1f\x{85}\pZ])c*"


def test_miners_sieve_loses_nothing_and_leaves_plain_sentences_alone(spark):
    words = (*WORDS, "a.b@c.de", ".@y.com", "sign-up", "sign　up", "percent", "٣ percent", "5 percent", "USD 5", "US$5", "H100", "RTX 4090", "Claude 3", "UPPER-2", "Paris Lyon", "He said", "We're asking", "terms", "sessions", "Q3", "May", "??", "a~b")
    rows = [(a + w + b,) for w, a, b in itertools.product(words, ("", "é", "x ", "x", "_", "準"), ("", "é", " é", ".", "_", "準", "́"))]
    df = spark.createDataFrame(rows, "t string").repartition(4).cache()
    own = mining.SIEVE
    x = df.select("t", own.of(F.col("t")).alias("bits"))
    bad = x.select(*(F.count_if(own.has(F.col("bits"), F.col("t"), p) != F.col("t").rlike(p)).alias(str(i)) for i, p in enumerate(own.at))).first()
    assert not any(bad), [p for p, n in zip(own.at, bad, strict=True) if n]
    plain = spark.createDataFrame([("Thonre was anly hend oftionnten, enti wherer anhe ntedin thhe é. And so it goes on and on.",)], "t string")
    assert [y.g for y in plain.select(mining.sieved_sentences(F.col("t"))).first()[0]] == [0, 0]
