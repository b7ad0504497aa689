"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Each language has one model over the letters of words; a word stands between boundary marks and its history begins at
the first. A text gets the language of the lowest cross-entropy for each character; a threshold for each language,
calibrated on documents that the counts have not seen, rejects texts that no model fits.

Results in special cases: null texts and texts without a letter are `und`, score 0, rejected; null languages are not
learned from; without any training row every text is `und`. Repeated rows get equal results.

Bounds: the models learn from at most DOCS distinct texts for each language (those of the smallest text hash), and a
language needs at least LEAST of them. Every document is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import apart, chunks, column_of, crc_bucket, cut, mix, prepare, relieved

DOCS = 1500
LEAST = 5
ORDER = 4
_word_characters = re.compile(r"[^\W\d_]+").findall
MARK = " "
#: Of five training documents one calibrates.
FOLDS = 5
_P = np.uint64(0x100000001B3)


def letters(text: str) -> list[str]:
    """The runs of letters of a text."""
    found = _word_characters(text)
    if not text.isascii() and not all(map(str.isalpha, found)):  # numbers such as a half or a Roman eight go
        found = [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]
    return found


def gram_keys(code: np.ndarray, upto: np.ndarray) -> list[np.ndarray]:
    """For orders 1 to ORDER, the hash of the gram that ends at each character; 0 where it would begin before its word. upto: characters before each one in its word."""
    out = []
    h = np.zeros(len(code), np.uint64)
    for k in range(ORDER):
        shifted = np.concatenate([np.zeros(k, np.uint64), code])[: len(code)]
        h = h * _P + (shifted + np.uint64(1))
        key = mix(h + np.uint64(k))
        key[upto < k] = 0
        out.append(key)
    return out


class Model:
    """Interpolated Kneser-Ney over grams of one language, from words with their counts."""

    def __init__(self, words: dict[str, int]):
        code, upto, times = _codes(list(words), np.array(list(words.values()), np.float64))
        keys = gram_keys(code, upto)
        inner = upto > 0  # the first mark is given, not predicted
        grams = []
        for k in range(ORDER):
            ok = inner & (keys[k] != 0) if k else inner
            uniq, first, inv = np.unique(keys[k][ok], return_index=True, return_inverse=True)
            at = np.flatnonzero(ok)[first]
            raw = np.bincount(inv, times[ok], len(uniq))
            grams.append((uniq, at, raw))
        # Adjusted counts: how many different characters stand before; occurrences where the gram begins its word.
        counts = [None] * ORDER
        counts[ORDER - 1] = grams[-1][2]
        for k in range(ORDER - 1):
            uniq, at, raw = grams[k]
            longer = grams[k + 1][1]
            cont = np.bincount(np.searchsorted(uniq, keys[k][longer]), minlength=len(uniq)).astype(float)
            counts[k] = np.where(upto[at] == k, raw, np.maximum(cont, 1))
        alphabet = len(np.unique(code)) + 1
        self.floor = np.log2(1 / (alphabet + 1))
        self.keys, self.logp, self.back = [], [], []
        below = None
        for k in range(ORDER):
            uniq, at, _ = grams[k]
            c = counts[k]
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = np.clip(n1 / (n1 + 2 * n2) if n1 + n2 else 0.5, 0.1, 0.9)
            if k == 0:
                total, kinds, ctx = c.sum(), len(c), np.zeros(len(c), np.int64)
                total, kinds = np.array([total]), np.array([float(kinds)])
                p = np.maximum(c - d, 0) / total[0] + d * kinds[0] / total[0] * 2.0**self.floor
            else:
                history = keys[k - 1][at - 1]
                hk, ctx = np.unique(history, return_inverse=True)
                total, kinds = np.bincount(ctx, c), np.bincount(ctx).astype(float)
                lower = below[np.searchsorted(grams[k - 1][0], keys[k - 1][at])]
                p = np.maximum(c - d, 0) / total[ctx] + (d * kinds / total)[ctx] * lower
            lam = np.log2(d * kinds / total).astype(np.float32)
            if k == 0:
                self.floor += float(lam[0])
            else:
                self.back.append((hk, lam))
            self.keys.append(uniq)
            self.logp.append(np.log2(p).astype(np.float32))
            below = p

    def bits(self, keys: list[np.ndarray]) -> np.ndarray:
        """log2 of the chance of each character after its history."""
        p = np.full(len(keys[0]), self.floor, np.float32)
        for k in range(ORDER):
            if k:
                hk, lam = self.back[k - 1]
                history = np.concatenate([np.zeros(1, np.uint64), keys[k - 1][:-1]])
                history[keys[k] == 0] = 0
                at, ok = _find(hk, history)
                p[ok] += lam[at[ok]]
            at, ok = _find(self.keys[k], keys[k])
            p[ok] = self.logp[k][at[ok]]
        return p


def _find(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    return at, (sorted_keys[at] == x) & (x != 0)


def _codes(words: list[str], times: np.ndarray | None = None):
    """Characters of all words with their marks, how many precede each in its word, and the word's count for each."""
    n = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer((MARK + (MARK + MARK).join(words) + MARK).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) if words else np.zeros(0, np.uint64)
    start = np.cumsum(n) - n
    upto = np.arange(len(code)) - np.repeat(start, n)
    return code, upto, None if times is None else np.repeat(times, n)


class Identifier:
    """The models of all languages; remembers the scores of up to `most` words."""

    def __init__(self, langs: list[str], models: list[Model], most: int = 300_000):
        self.langs, self.models, self.most = langs, models, most
        self.sharp, self.limit = 30.0, np.full(len(langs), np.inf)
        self.forget()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "score", "size")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def forget(self) -> None:
        from granary.llm.bpe import _Index

        self.index, self.score, self.size = _Index(), np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.int64)

    def _learn(self) -> None:
        new = self.index.new
        if new:
            code, upto, _ = _codes(new)
            keys = gram_keys(code, upto)
            inner = upto > 0
            start = np.flatnonzero(upto == 0)
            cols = [np.add.reduceat(np.where(inner, m.bits(keys), 0), start) for m in self.models]
            self.score = np.concatenate([self.score, np.stack(cols, 1).astype(np.float32)])
            self.size = np.concatenate([self.size, np.fromiter(map(len, new), np.int64, len(new)) + 1])
            new.clear()

    def entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(bits for each character by text and language, characters) ; a text without letters has 0 characters."""
        if len(self.index) > self.most:
            self.forget()
        bits, size = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for a, b in chunks(texts, 1_000_000):
            get, at = self.index.__getitem__, []
            for t in texts[a:b]:
                w = letters(t.lower()) if t else ()
                at.append(np.fromiter(map(get, w), np.int64, len(w)))
            self._learn()
            for i, x in enumerate(at, a):
                if len(x):
                    size[i] = self.size[x].sum()
                    bits[i] = -self.score[x].sum(axis=0, dtype=np.float64) / size[i]
        return bits, size

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """(language, calibrated probability, bits for each character, rejected)."""
        if not self.langs:
            return [("und", 0.0, 0.0, True)] * len(texts)
        bits, size = self.entropy(texts)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(texts)), best]
        p = 1 / np.exp(self.sharp * (low[:, None] - bits)).sum(axis=1)
        return [(self.langs[k], float(q), float(x), bool(x > self.limit[k] + 6 / n**0.5)) if n else ("und", 0.0, 0.0, True) for k, q, x, n in zip(best, p, low, size, strict=True)]

    def calibrate(self, texts: list[str], truth: list[str]) -> None:
        """Sets how sharply differences of entropy turn into probabilities, and the entropy beyond which a language is rejected."""
        bits, size = self.entropy(texts)
        y = np.array([self.langs.index(t) if t in self.langs else -1 for t in truth])
        ok = (size > 0) & (y >= 0)
        bits, y, size = bits[ok], y[ok], size[ok]
        if not len(y):
            return
        own = bits[np.arange(len(y)), y]
        grid = 2.0 ** np.arange(0, 9)
        loss = [np.log(np.exp(s * np.clip(own[:, None] - bits, -60 / s, 60 / s)).sum(axis=1)).mean() for s in grid]
        self.sharp = float(grid[int(np.argmin(loss))])
        for k in range(len(self.langs)):
            x = own[(y == k) & (size >= 30)]
            if len(x):
                # Far above all that was seen of the language: what is rejected is not a rare text of it.
                self.limit[k] = np.quantile(x, 0.99) + max(1.0, 6 * x.std())


def training_rows(docs: DataFrame, docs_per_language: int = DOCS) -> DataFrame:
    """(text, lang) of at most docs_per_language distinct texts of each language, of the smallest hashes."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("_h"))
    # Hashes alone go through the window, and each task passes on only its smallest ones.
    ranked = rows.select("lang", "_h").distinct().withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).filter(F.col("_k") <= docs_per_language)
    last = ranked.groupBy("lang").agg(F.max("_h").alias("last"), F.count("*").alias("n")).filter(F.col("n") >= LEAST).collect()
    if not last:
        return rows.limit(0).select("lang", "text", "_h")
    within = F.lit(False)
    for r in last:  # one row for each language
        within = within | ((F.col("lang") == r["lang"]) & (F.col("_h") <= r["last"]))
    return rows.filter(within).select("lang", "text", "_h")


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) over the training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tally.setdefault(lang, Counter()).update(letters(text.lower()))
        for lang, c in tally.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    return rows.select("lang", "text").mapInArrow(relieved(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, docs_per_language: int = DOCS) -> Identifier:
    """Learns from all of docs' text and lang, within the bound. What comes to the driver is bounded by it, too."""
    prepare(docs.sparkSession)
    rows = cut(training_rows(docs, docs_per_language).dropDuplicates(["lang", "_h"]))
    test = F.pmod(F.col("_h"), F.lit(FOLDS)) == 0
    words: dict[str, dict[str, int]] = {}
    for r in word_counts(rows.filter(~test)).toLocalIterator():
        words.setdefault(r["lang"], {})[r["word"]] = r["n"]
    langs = sorted(words)
    own = Identifier(langs, [Model(words[x]) for x in langs])
    if langs:
        # At most a fifth of the bounded sample, text by text.
        bits, truth = [], []
        for r in rows.filter(test).select("lang", "text").toLocalIterator():
            bits.append(r["text"])
            truth.append(r["lang"])
        own.calibrate(bits, truth)
        own.forget()
    return own


def identify(df: DataFrame, model: Identifier, text: str = "text") -> DataFrame:
    """df with lang_pred, score, bits_per_char and rejected; columns of those names are replaced."""
    sc = prepare(df.sparkSession).sparkContext
    held = sc.broadcast(model)  # a few MB: bounded by the training sample
    names = ("lang_pred", "score", "bits_per_char", "rejected")
    df = df.drop(*(c for c in names if c != text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            for x in range(0, b.num_rows, 2000):
                part = b.slice(x, 2000)
                got = own.predict(column_of(part, text).to_pylist())
                cols = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*b.schema.names, *names])
        own.forget()  # a worker keeps what was broadcast

    return df.mapInArrow(relieved(run), T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True))]))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by a model of the documents that are not held out."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", crc_bucket(F.col("doc_id"), 5) == 0)
    model = train(rows.filter(~F.col("held_out")))
    return identify(rows.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns, whatever these are called."""
    return identify(apart(docs), train(docs), "own.text").filter(~F.col("rejected")).select("own.*")
