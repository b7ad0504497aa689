"""Lexical retrieval packing: windows of related documents, by BM25 over sharded inverted indices.

Each input partition is dealt into shards of at most SHARD_DOCS documents and about SHARD_CHARS characters. A shard has
an inverted index of its own. Its documents become seeds in turn: a seed fills windows by itself as long as it can, then
the index returns the unused documents that score best for it, which fill the rest of its window; the last one is cut
and goes on where it was cut. So every window of a shard is full but for its last one.

Results in special cases: null and empty texts have the end id alone; texts of any length are cut into windows; equal
texts are each other's best neighbours and end up together; documents that share no word with a seed are taken in order
once no related one is left; rows with equal or null doc_id are packed one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.bpe import default_vocabulary, encoder
from granary.llm.common import crc32, prepare, relieved

WINDOW = 2048
END = 1
SHARD_DOCS = 1024
SHARD_CHARS = 6_000_000
K1, B = 1.2, 0.75


class Index:
    """BM25 over the documents of a shard, given the term numbers of all documents and where each document begins.

    Terms of half of the documents or more weigh nothing in BM25, and those of one document find no neighbour; neither
    is stored.
    """

    def __init__(self, terms: np.ndarray, start: np.ndarray):
        n = len(start) - 1
        doc = np.repeat(np.arange(n), np.diff(start))
        key, tf = np.unique(terms.astype(np.int64) * n + doc, return_counts=True) if len(terms) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        term, doc = np.divmod(key, max(n, 1))
        uniq, first, df = np.unique(term, return_index=True, return_counts=True)
        idf = np.log((n - df + 0.5) / (df + 0.5))
        used = (df > 1) & (idf > 0)
        keep = np.repeat(used, df)
        term, doc, tf = np.repeat(np.arange(used.sum()), df[used]), doc[keep], tf[keep]
        size = np.diff(start)
        norm = K1 * (1 - B + B * size / max(size.mean() if n else 1, 1e-9))
        self.weight = np.repeat(idf[used], df[used]) * tf * (K1 + 1) / (tf + norm[doc])
        self.doc, self.n = doc, n
        self.first = np.concatenate([[0], np.cumsum(df[used])])
        order = np.argsort(doc, kind="stable")
        self.by_doc, self.doc_start = term[order], np.searchsorted(doc[order], np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        terms = self.by_doc[self.doc_start[seed] : self.doc_start[seed + 1]]
        count = self.first[terms + 1] - self.first[terms]
        total = int(count.sum())
        if not total:
            return np.zeros(self.n)
        upto = np.cumsum(count) - count
        at = np.repeat(self.first[terms] - upto, count) + np.arange(total)
        return np.bincount(self.doc[at], self.weight[at], self.n)


def pack(sizes: np.ndarray, index: Index, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (document, its first token, tokens); every token of every document is in one of them."""
    n = len(sizes)
    at = np.zeros(n, np.int64)
    unused = np.ones(n, bool)
    for seed in range(n):
        if not unused[seed]:
            continue
        while sizes[seed] - at[seed] >= window:
            yield [(seed, int(at[seed]), window)]
            at[seed] += window
        left = int(sizes[seed] - at[seed])
        unused[seed] = False
        if not left:
            continue
        out, space = [(seed, int(at[seed]), left)], window - left
        at[seed] = sizes[seed]
        if space:
            rest = np.flatnonzero(unused)
            score = index.scores(seed)[rest]
            related = np.flatnonzero(score > 0)
            order = np.concatenate([related[np.argsort(-score[related], kind="stable")], np.flatnonzero(score <= 0)])
            for d in rest[order].tolist():
                k = min(space, int(sizes[d] - at[d]))
                out.append((d, int(at[d]), k))
                at[d] += k
                space -= k
                if at[d] == sizes[d]:
                    unused[d] = False
                if not space:
                    break
        yield out


def packed(docs: DataFrame, window: int = WINDOW, end: int = END, path: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece; with its ids, if asked for."""
    prepare(docs.sparkSession)
    path = path or default_vocabulary()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        sequence = TaskContext.get().partitionId() << 32  # the same again if the task is run again

        def shard(keys: list, texts: list) -> pa.RecordBatch:
            nonlocal sequence
            flat, at, words, wstart = own.encode(texts)
            sizes = np.diff(at) + 1
            tokens = np.insert(flat, at[1:], end).astype("<u4")
            at = at + np.arange(len(at))
            rows: list[tuple] = []
            for piece in pack(sizes, Index(words, wstart), window):
                offset = 0
                for d, start, length in piece:
                    own_ids = tokens[at[d] + start : at[d] + start + length]
                    rows.append((keys[d], start, length, crc32(own_ids.tobytes()), int(sizes[d]), sequence, offset, *([own_ids.tolist()] if ids else [])))
                    offset += length
                sequence += 1
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        keys: list = []
        texts: list = []
        size = 0
        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys.append(key)
                texts.append(text)
                size += len(text or "")
                if len(keys) >= SHARD_DOCS or size >= SHARD_CHARS:
                    yield shard(keys, texts)
                    keys, texts, size = [], [], 0
        if keys:
            yield shard(keys, texts)

    schema = ", ".join(f"{n} long" for n in names[:7]) + ", ids array<long>" * ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(relieved(run), schema)
