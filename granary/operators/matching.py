"""Many words looked for at once: an automaton of all of them reads a text once, whatever their number.

Words are found as substrings of lower-cased texts. The automaton is built in each Python worker from the list of words
that its task brings, and kept there. Lists in code are small; a dictionary that is a table is measured first, and one
beyond MOST_CHARS goes over the texts in parts, so that no automaton outgrows a worker.
"""

from __future__ import annotations

from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Characters of the words of one automaton, some hundred bytes of memory each.
MOST_CHARS = 2_000_000
_built: dict[tuple, ahocorasick.Automaton] = {}


def automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """An automaton that gives the numbers of words; equal words have all their numbers."""
    if words not in _built:
        while len(_built) >= 8:
            _built.pop(next(iter(_built)))
        own, numbers = ahocorasick.Automaton(), {}
        for i, w in enumerate(words):
            if w:
                numbers.setdefault(w, []).append(i)
        for w, found in numbers.items():
            own.add_word(w, tuple(found))
        if numbers:
            own.make_automaton()
        _built[words] = own
    return _built[words]


def found_in(text: str | None, own: ahocorasick.Automaton) -> set[int]:
    """The numbers of the words in a text."""
    if not text or not len(own):
        return set()
    return {i for _, numbers in own.iter(text) for i in numbers}


def contained(text: Column, words: tuple[str, ...]) -> Column:
    """The numbers of the words that a lower-cased text contains, ascending."""
    words = tuple(words)

    @pandas_udf(T.ArrayType(T.IntegerType()))
    def numbers(text: pd.Series) -> pd.Series:
        own = automaton(words)
        return pd.Series([sorted(found_in(t, own)) for t in text])

    return numbers(text)


def class_hits(text: Column, classes: dict[str, tuple[str, ...]]) -> Column:
    """A struct of how many words of each class a lower-cased text contains, in fields c0, c1, ... in the classes' order."""
    words = tuple(w for own in classes.values() for w in own)
    of = np.repeat(np.arange(len(classes)), [len(own) for own in classes.values()])
    kind = T.StructType([T.StructField(f"c{k}", T.IntegerType()) for k in range(len(classes))])

    @pandas_udf(kind)
    def hits(text: pd.Series) -> pd.DataFrame:
        own, out = automaton(words), np.zeros((len(text), len(classes)), np.int32)
        for row, t in enumerate(text):
            found = found_in(t, own)
            if found:
                np.add.at(out[row], of[list(found)], 1)
        return pd.DataFrame(out, columns=kind.names)

    return hits(text)


def dictionary_matches(rows: DataFrame, words: DataFrame, text: str = "text", key: str = "ord", word: str = "word", most_chars: int = MOST_CHARS) -> DataFrame:
    """(key, word): each word of a table that a row's text contains, whatever the case, once.

    The words of a part come to the driver and go to all tasks, `most_chars` of their characters at most; a larger table
    is split by hash into as many parts as that takes, and the texts are read once for each.
    """
    own = words.select(F.lower(F.col(word)).alias("word")).filter("word != ''").distinct()
    size = own.agg(F.coalesce(F.sum(F.length("word") + 8), F.lit(0))).first()[0]
    parts = max(1, -(-size // max(most_chars // 2, 1)))  # by halves, for parts are not of one size
    texts = rows.select(F.col(key).alias(key), F.lower(F.col(text)).alias("_t"))
    found = []
    for k in range(parts):
        part = own if parts == 1 else own.filter(F.pmod(F.xxhash64("word"), F.lit(parts)) == k)
        listed = tuple(sorted(r["word"] for r in part.collect()))
        if listed:
            names = F.array(*map(F.lit, listed)) if len(listed) <= 200 else None
            hits = texts.select(key, F.explode(contained(F.col("_t"), listed)).alias("_i"))
            if names is not None:
                found.append(hits.select(key, F.get(names, F.col("_i")).alias("word")))
            else:
                numbered = rows.sparkSession.createDataFrame(pd.DataFrame({"_i": np.arange(len(listed), dtype=np.int32), "word": listed}), "_i int, word string")
                found.append(hits.join(F.broadcast(numbered), "_i").select(key, "word"))  # bounded by most_chars
    return reduce(DataFrame.unionAll, found) if found else rows.select(F.col(key).alias(key), F.lit("").alias("word")).limit(0)


def first_mentions(cards: DataFrame, names: list[str], text: Column, key: str = "ord") -> DataFrame:
    """(name, place, first, cards): of each name that any text contains, whatever the case, its place in the list, the smallest key and how many."""
    lower = [n.lower() for n in names]
    hits = cards.select(F.col(key).alias("k"), F.explode(contained(F.lower(text), tuple(lower))).alias("i"))
    one = F.array(*map(F.lit, names))
    return hits.groupBy("i").agg(F.min("k").alias("first"), F.count("*").alias("cards")).select(F.get(one, F.col("i")).alias("name"), F.col("i").alias("place"), "first", "cards")


# Glossary ---------------------------------------------------------------------------------------------------------------
def _low(text: str) -> str:
    """Lower-cased character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def glossed(fields: list[str | None], terms: tuple[str, ...], notes: tuple[str, ...], own: ahocorasick.Automaton) -> list[str]:
    """The fields with a note behind the first use of each term in any of them.

    Terms are whole words, whatever their case; where several begin or overlap, the leftmost and then the longest counts and
    what it covers is not looked at again. A term that has a note already gets no other.
    """
    fields = [f or "" for f in fields]
    if not len(own):
        return fields
    matches, seen = [], set()
    for k, text in enumerate(fields):
        low, at = _low(text), []
        for end, numbers in own.iter(low):
            i = numbers[0]
            a, b = end + 1 - len(terms[i]), end + 1
            left = a == 0 or not (_word(low[a - 1]) and _word(low[a]))
            right = b == len(low) or not (_word(low[b - 1]) and _word(low[b]))
            if left and right:
                at.append((a, -b, i))
                if low.startswith("（", b):
                    seen.add(terms[i])
        matches.append(sorted(at))
    out = []
    for text, at in zip(fields, matches, strict=True):
        done, pieces = 0, []
        upto = 0
        for a, b, i in at:
            if a < upto:
                continue  # within a longer or earlier term
            upto = -b
            if terms[i] in seen:
                continue
            seen.add(terms[i])
            pieces += [text[done:-b], "（", notes[i], "）"]
            done = -b
        out.append("".join([*pieces, text[done:]]))
    return out


def with_glossary(fields: Column, glossary: dict[str, str], never: tuple[str, ...] = ()) -> Column:
    """An array of a row's texts with the notes of a glossary, each at the first use in the row; `never` names terms that get none."""
    out = {_low(w).lower() for w in never}
    pairs = {t.lower(): note for t, note in glossary.items() if t and t.lower() not in out}
    terms, notes = tuple(pairs), tuple(pairs.values())

    @pandas_udf(T.ArrayType(T.StringType()))
    def gloss(fields: pd.Series) -> pd.Series:
        own = automaton(terms)
        return pd.Series([None if f is None else glossed(list(f), terms, notes, own) for f in fields])

    return gloss(fields)


def proper_nouns(text: Column, false: tuple[str, ...] = ()) -> Column:
    """Capitalised words, and such in a row as one, of three characters and more, each once whatever its case."""
    from granary.functions.mining import distinct_by

    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b[A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+)*\b"), F.lit(0))
    keep = lambda x: (F.length(F.replace(x, F.lit(" "), F.lit(""))) >= 3) & (~x.isin(*false) if false else F.lit(True))
    return distinct_by(F.filter(found, keep), F.lower)
