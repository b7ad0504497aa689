"""Quality by weak supervision: rules vote good, vote bad or abstain; expectation-maximisation finds how far to trust each.

The model has two hidden classes. For each class and rule it holds the chances of the votes good and bad among those
given (an abstention says nothing), estimated from the counts of vote patterns over all documents (at most 3^rules of
them, whatever the input). A document's posterior
probability of the good class decides, in place of a demand that all rules pass.

Results in special cases: null and empty texts have no words, fail the base rules and are not kept; repeated rows are
judged alike; an empty table gives no rows; other columns are passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import WordHashes, apart, column_of, cut, holding, prepare, relieved, stored, words_of

WINDOW, BLOCK = 8, 100
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
#: Words that end in a symbol.
_tailed = re.compile(r"[#*$%&|<>](?![^\x20\x09-\x0D])").findall
#: What is measured of a text. n_distinct: the different words of each BLOCK words, summed, so that it does not depend on the length.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_echo", "n_distinct", "n_shout", "n_stops", "n_tailed")
GOOD, ABSTAIN, BAD = 0, 1, 2
_multiplier = np.random.default_rng(8).integers(0, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_hashes = WordHashes(150_000)


def repeated_words(h: np.ndarray) -> int:
    """Words that lie in a window of WINDOW words found twice or more, given the words' 64-bit hashes."""
    n = len(h) - WINDOW + 1
    if n < 2:
        return 0
    w = h[:n] * _multiplier[0]
    for k in range(1, WINDOW):
        w += h[k : k + n] * _multiplier[k]
    order = np.argsort(w)
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    step = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return int((np.cumsum(step) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = words_of(text)
    lines, seen, dup = 0, set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            lines += 1
            dup += line in seen
            seen.add(line)
    h = _hashes.of(words)
    return (
        len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeated_words(h), lines,
        sum(map(str.isupper, words)), int((h[1:] == h[:-1]).sum()), sum(len(set(words[i : i + BLOCK])) for i in range(0, len(words), BLOCK)), text.count("!!"), text.count(". ") + text.count(".\n") + text.endswith("."),
        len(_tailed(text)),
    )


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the MEASURES of its column `text`; columns of those names are replaced."""
    prepare(df.sparkSession)
    df = df.drop(*(c for c in MEASURES if c != text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(0, b.num_rows, 2000):
                part = b.slice(x, 2000)
                rows = [measure(t) for t in column_of(part, text).to_pylist()]
                cols = np.array(rows, np.int64).reshape(-1, len(MEASURES)).T
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, cols)], names=[*b.schema.names, *MEASURES])

    return df.mapInArrow(relieved(run), T.StructType([*df.schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)]))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> dict[str, tuple[Column, Column]]:
    """For each rule, when it votes good and when it votes bad; in between it abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c: F.col(c) / n
    size, lines = F.col("word_chars") / n, F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "length": (F.col("n_words") >= 60, F.col("n_words") < 20),
        "word_size": (size.between(2.5, 9), (size < 1.8) | (size > 14)),
        "symbols": (share("n_symbols") < 0.02, share("n_symbols") > 0.1),
        "letters": (F.col("n_symbols") < 0.02 * F.col("word_chars"), F.col("n_symbols") > 0.08 * F.col("word_chars")),
        "tails": (share("n_tailed") < 0.02, share("n_tailed") > 0.1),
        "windows": (share("n_repeat_words") < 0.05, share("n_repeat_words") > 0.25),
        "echo": (share("n_echo") < 0.05, share("n_echo") > 0.15),
        "capitals": (share("n_upper") < 0.1, share("n_upper") > 0.3),
        "shouting": (share("n_shout") < 0.01, share("n_shout") > 0.08),
        "lines": (F.col("n_dup_lines") / lines < 0.1, F.col("n_dup_lines") / lines > 0.4),
        "variety": (share("n_distinct") > 0.35, share("n_distinct") < 0.2),
        "sentences": ((F.col("n_stops") > 0) & (share("n_stops") < 0.4), F.lit(False)),
    }


def votes() -> list[Column]:
    return [F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN) for good, bad in rules().values()]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(log chances of the classes good and bad, log chances of votes by class, rule and vote).

    patterns: a row of votes for each pattern; counts: documents that have it. It begins with the belief that a
    pattern is bad as soon as one rule votes so.
    """
    n_rules = patterns.shape[1]
    bad = (patterns == BAD).any(axis=1)
    q = np.where(bad, 0.1, 0.9)
    hot = (patterns[:, :, None] == np.array([GOOD, BAD])).astype(float)
    prior, chance = np.log([0.5, 0.5]), np.full((2, n_rules, 2), np.log(0.5))
    for _ in range(rounds if len(patterns) else 0):
        weight = np.stack([counts * q, counts * (1 - q)])
        prior = np.log((weight.sum(axis=1) + 1) / (counts.sum() + 2))
        tally = np.einsum("cp,prv->crv", weight, hot) + 0.5
        chance = np.log(tally / tally.sum(axis=2, keepdims=True))
        score = np.einsum("prv,crv->cp", hot, chance) + prior[:, None]  # an abstention says nothing
        new = 1 / (1 + np.exp(np.clip(score[1] - score[0], -700, 700)))
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return prior, np.stack([chance[..., 0], np.zeros((2, n_rules)), chance[..., 1]], axis=-1)


def fit(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Estimates the model from all measured rows of 20 words or more."""
    n = len(rules())
    code = sum((v * 3**k for k, v in enumerate(votes())), F.lit(0))
    # One row for each pattern, at most 3^rules in all.
    got = rows.filter(F.col("n_words") >= 20).groupBy(code.alias("code")).count().collect()
    codes = np.array([r["code"] for r in got], np.int64)
    return estimate(codes[:, None] // 3 ** np.arange(n) % 3, np.array([r["count"] for r in got], float))


def posterior(model: tuple[np.ndarray, np.ndarray]) -> Column:
    """The probability that a measured row is good."""
    prior, chance = model
    odds = F.lit(float(prior[0] - prior[1]))
    for v, c in zip(votes(), chance[0] - chance[1], strict=True):
        odds = odds + F.element_at(F.array(*map(F.lit, c.tolist())), v + 1)
    return 1 / (1 + F.exp(-odds))


def judged(rows: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Measured rows with base_failed, quality (the posterior) and kept."""
    return rows.withColumn("base_failed", base_failed()).withColumn("quality", posterior(model)).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def score(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with MEASURES, base_failed, quality and kept. Reads docs twice: to fit, then to judge."""
    return judged(measured(docs, text), fit(measured(docs.select(text), text)))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns, whatever these are called. Texts are measured once, and held with their measures below the checkpoint folder until release() of the result."""
    rows = stored(measured(apart(docs), "own.text"))
    return holding(judged(rows, fit(rows)).filter("kept").select("own.*"), rows)


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept and quality; the measures are cut, so texts are read once."""
    rows = cut(measured(docs.select("doc_id", "text")).drop("text"))
    return judged(rows, fit(rows)).select("doc_id", *MEASURES[:5], "base_failed", "kept", "quality")
