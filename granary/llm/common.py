"""What the operators of this folder share: tables, lineage cuts, words and hashes."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and the ASCII line and tab characters.
WORD = r"[^\x20\x09-\x0D]+"
words_of = re.compile(WORD).findall
#: Lower-cases A-Z alone, unlike str.lower.
LOWER_AZ = {c: c + 32 for c in range(65, 91)}

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Lets local Python workers import this package, and sets a checkpoint folder of its own in a local session that names none; a cluster has to name one that all its machines share."""
    sc = spark.sparkContext
    path = sc.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    if not sc.getConf().get("spark.checkpoint.dir") and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="granary-checkpoint-"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it without its lineage."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet below the shared checkpoint folder and reads it back; discard() removes it. Later reads prune columns, which those of a checkpoint don't."""
    spark = prepare(df.sparkSession)
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().get()
    path = f"{top.rstrip('/')}/granary-{sc.applicationId}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._granary_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes stored tables that no plan needs any more; shuffle files of plans that are gone go with the driver's garbage."""
    for t in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._granary_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def holding(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, whose plan reads stored tables: release(df) removes them. They are its own, whatever else runs in the session."""
    df._granary_held = tables
    return df


def release(df: DataFrame) -> None:
    """Removes the stored tables that df reads; called where what was made of it has been written."""
    discard(df.sparkSession, *getattr(df, "_granary_held", ()))
    df._granary_held = ()


#: Rows that are broadcast, 8 MB of ids at most; more are joined by a shuffle.
FEW = 1_000_000


def few(rows: DataFrame) -> DataFrame:
    """Narrow rows, to be broadcast if they are at most FEW."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def apart(docs: DataFrame) -> DataFrame:
    """docs as one column `own`, a struct: no name of theirs meets a name that an operator adds."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"))


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column of a batch, or that of apart()'s struct for `own.name`."""
    first, _, inner = name.partition(".") if name.startswith("own.") else (name, "", "")
    found = batch.column(batch.schema.get_field_index(first))
    return found.field(inner) if inner else found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def relieved(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a Python worker, that lives on for other tasks, gives back the memory that it and its tables of hashes held."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for module, name in _CACHES:
                found = sys.modules.get(module)
                if found:
                    getattr(found, name).clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return task


#: What modules keep of words, and arrays that they use again.
_CACHES = (("granary.llm.quality", "_hashes"), ("granary.llm.jaccard", "_hashes"), ("granary.llm.bpe", "_encoders"), ("granary.llm.gru", "_room"))


class WordHashes(dict):
    """word -> 64-bit hash, the same in every process. It is emptied when `most` words are held, which changes no result."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return v

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def chunks(texts: list, most_chars: int = 4_000_000):
    """Slices of consecutive texts with about most_chars characters; a longer text stands alone."""
    a = n = 0
    for i, t in enumerate(texts):
        k = len(t) if t else 0
        if n and n + k > most_chars:
            yield a, i
            a, n = i, 0
        n += k
    if a < len(texts):
        yield a, len(texts)
