"""De-duplication: by key, by normalised address, against history, and by similarity of titles."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_type

from granary.functions import fixed as V
from granary.functions.links import normalize_url
from granary.functions.text import text_of


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the session's checkpoint folder, so that loops do not grow their plans."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix=f"granary-{os.getpid()}-"))
    return df.checkpoint(eager=True)


def first_of_each(rows: DataFrame, *keys: Column | str, order: tuple[Column | str, ...] = ("ord",)) -> DataFrame:
    """The first row of each key."""
    named = {f"_k{i}": F.col(k) if isinstance(k, str) else k for i, k in enumerate(keys)}
    w = Window.partitionBy(*named).orderBy(*order)
    return rows.withColumns(named).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", *named)


def by_url(rows: DataFrame, url: str = "url", source: str = "source_name", preferred: str = "HackerNews") -> DataFrame:
    """One row of each normalised address, that of the preferred source if there is one."""
    return first_of_each(rows, normalize_url(F.col(url)), order=((F.coalesce(F.col(source), F.lit("")) == preferred).desc(), "ord"))


def unseen(rows: DataFrame, history: DataFrame, key: str = "item_id") -> DataFrame:
    """Rows whose key is not in the history."""
    return rows.join(history.select(key), key, "left_anti").select(rows.columns)


def by_id_or_title(rows: DataFrame, used: DataFrame) -> DataFrame:
    """Rows whose id, or else the first 50 characters of whose title, is not among those of the used rows."""
    key = F.coalesce(F.nullif(text_of("item_id"), F.lit("")), F.substring(text_of("title"), 1, 50))
    keys = used.select(F.explode(F.array(text_of("item_id"), F.substring(text_of("title"), 1, 50))).alias("_key")).filter("_key != ''").distinct()
    return rows.withColumn("_key", key).join(keys, "_key", "left_anti").select(rows.columns)


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence, by bits: one row of the table is one integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & at.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


@pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * 2 * longest common subsequence / both lengths; 100 for two empty texts."""
    out = np.full(len(a), 100.0)
    for i, (x, y) in enumerate(zip(a.fillna(""), b.fillna(""), strict=True)):
        n = len(x) + len(y)
        if n:
            out[i] = 200.0 * _common(x, y) / n
    return pd.Series(out)


@pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching blocks against both lengths, from 0 to 1."""
    import difflib

    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a.fillna(""), b.fillna(""), strict=True)])


#: Texts, and 64-character stretches of texts, that a block of similar_pairs() has at most; buckets of its counts of characters and of pairs of them.
BLOCK_TEXTS, BUCKETS = 2048, (32, 128)


def _histogram(texts: list[str], width: int, size: int) -> np.ndarray:
    """Counts of the texts' substrings of `width` characters, dealt into buckets."""
    out = np.zeros((len(texts), size), np.int32)
    for i, t in enumerate(texts):
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(codes) >= width:
            mixed = codes if width == 1 else codes[:-1] * np.uint64(31) + codes[1:]
            out[i] = np.bincount((mixed % np.uint64(size)).astype(np.int64), minlength=size)
    return out if out.max(initial=0) > 255 else out.astype(np.uint8)


def _distances(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    if others.dtype == np.uint8:
        return (np.maximum(one, others) - np.minimum(one, others)).sum(1, dtype=np.int64)
    return np.abs(others - one).sum(1, dtype=np.int64)


def _similar_within(left: list[str], right: list[str], least: float, same: bool) -> Iterator[tuple[int, int]]:
    """Places of texts of two blocks, or of one block before and behind each other, with an indel ratio over `least`.

    An edit inserts or deletes a character, so it changes one count of characters and three counts of neighbours at most: pairs
    whose counts differ by more are decided without their common subsequence. Buckets only bring counts closer together.
    """
    n = np.array([len(t) for t in right])
    chars, pairs = ((_histogram(left, w, k), _histogram(right, w, k)) for w, k in ((1, BUCKETS[0]), (2, BUCKETS[1])))
    # Kinds that differ in width of their counts are compared in the wider one.
    chars, pairs = ((x, y) if x.dtype == y.dtype else (x.astype(np.int32), y.astype(np.int32)) for x, y in (chars, pairs))
    for i, t in enumerate(left):
        at = np.arange(i + 1 if same else 0, len(right))
        edits = (len(t) + n[at]) * (1 - least / 100)
        at = at[np.abs(len(t) - n[at]) <= edits]
        for own, other, each in ((*chars, 1), (*pairs, 3)):
            at = at[_distances(own[i], other[at]) <= (len(t) + n[at]) * (1 - least / 100) * each] if len(at) else at
        for j in at.tolist():
            if 200.0 * _common(t, right[j]) / (len(t) + len(right[j])) > least:
                yield i, j


def similar_pairs(rows: DataFrame, text: str = "title", least: float = V.FUZZY, key: str = "ord") -> DataFrame:
    """(a, b): pairs of keys, a < b, of different texts with an indel ratio over `least`.

    Exact. Texts are put into blocks by length, and blocks meet where lengths allow such a ratio, a pair of blocks at a time:
    the number of comparisons is the square of that of texts of about one length, memory that of two blocks.
    """
    from granary.operators.select import numbered

    texts = rows.select(F.col(key).alias("k"), text_of(text).alias("t")).groupBy("t").agg(F.min("k").alias("k")).filter("t != ''").withColumn("n", F.length("t"))
    kind = F.floor(F.log2(F.greatest(F.col("n"), F.lit(64)))).cast("int")
    ranked = numbered(texts.withColumn("_by", F.struct("n", "t")), "_by").withColumn("kind", kind)
    per = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_TEXTS * 64) / F.pow(F.lit(2.0), F.col("kind")))).cast("int")
    blocks = ranked.withColumn("block", F.floor(F.col("ord") / per).cast("int")).groupBy("kind", "block").agg(F.collect_list("k").alias("k"), F.collect_list("t").alias("t"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    blocks = cut(blocks)  # at most BLOCK_TEXTS texts each
    a = blocks.select(*(F.col(c).alias(f"{c}_a") for c in blocks.columns))
    b = blocks.select(*(F.col(c).alias(f"{c}_b") for c in blocks.columns))
    # Only numbers of blocks meet all others; their texts follow.
    ids = lambda x, s: x.select(*(f"{c}_{s}" for c in ("kind", "block", "lo", "hi")))
    met = ids(a, "a").join(F.broadcast(ids(b, "b")), (F.struct("kind_a", "block_a") <= F.struct("kind_b", "block_b")) & (F.col("hi_a") >= F.col("lo_b") * least / (200 - least) - 1))  # one row for each block
    met = met.select("kind_a", "block_a", "kind_b", "block_b").join(a.select("kind_a", "block_a", "k_a", "t_a"), ["kind_a", "block_a"]).join(b.select("kind_b", "block_b", "k_b", "t_b"), ["kind_b", "block_b"])
    met = met.withColumn("same", (F.col("kind_a") == F.col("kind_b")) & (F.col("block_a") == F.col("block_b"))).select("same", "k_a", "t_a", "k_b", "t_b")
    own = T.StructType([T.StructField(c, texts.schema["k"].dataType) for c in "ab"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same, ka, ta, kb, tb = (c[i].as_py() for c in batch.columns)
                found = [sorted((ka[x], kb[y])) for x, y in _similar_within(ta, tb, least, same)]
                yield pa.RecordBatch.from_arrays([pa.array([p[s] for p in found], to_arrow_type(own[s].dataType)) for s in (0, 1)], names=["a", "b"])

    # A pair of blocks is a piece of work of its own, dealt round.
    parallel = max(rows.sparkSession.sparkContext.defaultParallelism * 4, 32)
    return met.repartition(parallel).mapInArrow(run, own)


#: Pairs that one task decides in order, some 16 MB; more are decided in rounds.
IN_ORDER = 1_000_000


def _passed_over(pairs: DataFrame) -> DataFrame:
    """(k): what a pass in order drops, from pairs that one task can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sorted((b, a) for batch in batches for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        gone: set = set()
        for b, a in own:  # all that is earlier has been decided
            if a not in gone:
                gone.add(b)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(gone), kind)], names=["k"])

    kind = to_arrow_type(pairs.schema["b"].dataType)
    return pairs.select("a", "b").coalesce(1).mapInArrow(run, T.StructType([T.StructField("k", pairs.schema["b"].dataType)]))


def keep_first(keys: DataFrame, pairs: DataFrame, in_order: int = IN_ORDER) -> DataFrame:
    """The keys that a pass in order keeps: one is kept unless an earlier kept one is similar. keys: (k); pairs: (a, b), a < b.

    Up to `in_order` pairs are decided by one task. More are in rounds: what has no undecided earlier neighbour is kept, what
    has a kept one goes. Each round decides the first of every chain, so a chain of n similar texts takes n / 2 rounds at most.
    """
    open_, gone = cut(pairs.select("a", "b").distinct()), None
    if open_.count() <= in_order:
        return keys.join(_passed_over(open_), "k", "left_anti")
    while not open_.isEmpty():
        kept = open_.select(F.col("a").alias("k")).distinct().join(open_.select(F.col("b").alias("k")), "k", "left_anti")
        dropped = cut(open_.join(kept.withColumnRenamed("k", "a"), "a", "left_semi").select(F.col("b").alias("k")).distinct())
        gone = dropped if gone is None else cut(gone.unionAll(dropped))
        a, b = dropped.withColumnRenamed("k", "a"), dropped.withColumnRenamed("k", "b")
        open_ = cut(open_.join(a, "a", "left_anti").join(b, "b", "left_anti").join(kept.withColumnRenamed("k", "a"), "a", "left_anti"))
    return keys if gone is None else keys.join(gone, "k", "left_anti")


def fuzzy_titles(rows: DataFrame, text: str = "title", least: float = V.FUZZY, key: str = "ord") -> DataFrame:
    """Rows whose title is not similar to that of an earlier kept row; equal titles keep the first row. Empty titles all stay."""
    firsts = first_of_each(rows.filter(text_of(text) != ""), text, order=(key,))
    kept = keep_first(firsts.select(F.col(key).alias("k")), similar_pairs(firsts, text, least, key))
    return rows.join(kept.withColumnRenamed("k", key), key, "left_semi").unionByName(rows.filter(text_of(text) == "")).select(rows.columns)


def chain(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Rows with new ids, the first of each, then of similar titles the first."""
    return fuzzy_titles(first_of_each(unseen(rows, history), "item_id"))
