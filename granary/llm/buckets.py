"""Rows with equal 64-bit keys, brought together by one shuffle of packed rows.

A task sorts its rows by key and hands on what its keys need; the rows of a range of keys travel as one compressed
block. A key that a third of all rows have thus makes one row for each batch of a task, not one for each row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from granary.llm.common import relieved

#: Rows of a table for each task of the shuffle, at most.
ROWS = 20_000


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of one length; the first is ascending, so its differences are small."""
    parts = []
    for i, x in enumerate(arrays):
        x = np.ascontiguousarray(np.diff(x, prepend=x.dtype.type(0)) if i == 0 else x)
        parts.append(x.view(np.uint8).reshape(len(x), -1).T.tobytes())  # byte planes
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes, n: int, kinds: list[type]) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), 0, []
    for i, kind in enumerate(kinds):
        width = np.dtype(kind).itemsize
        x = np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).reshape(n)
        out.append(np.cumsum(x, dtype=kind) if i == 0 else x)
        at += n * width
    return out


def tasks(df: DataFrame, rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def blocks(kind: int, arrays: list[np.ndarray], bits: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(bucket, kind, n, payload) of arrays sorted by their first, by its highest bits."""
    if not len(arrays[0]):
        return
    bucket = (arrays[0] >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)], strict=True):
        yield int(bucket[a]), kind, b - a, pack([x[a:b] for x in arrays])


def batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = [*zip(*rows, strict=True)] or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "kind", "n", "payload"])


BLOCKS = "bucket long, kind int, n long, payload binary"


def bits_of(n: int) -> int:
    """Buckets as bits: some for each task, so that tasks get alike."""
    return max(3, (4 * n - 1).bit_length())


def gathered(packed: DataFrame, n: int, kinds: dict[int, list[type]], each: Callable[[dict[int, list[np.ndarray]]], Iterator[pa.RecordBatch]], schema: str, last: Callable[[], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """each(arrays by kind) of every bucket, over n tasks, and last() at a task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                yield from each({k: [np.concatenate(c) for c in zip(*(unpack(p, n, own) for kk, n, p in held if kk == k), strict=True)] or [np.zeros(0, x) for x in own] for k, own in kinds.items()})
                held.clear()

        for b in batches:
            for bucket, kind, size, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != key:
                    yield from done()
                    key = bucket
                held.append((kind, size, payload))
        yield from done()
        if last:
            yield from last()

    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(relieved(run), schema)
