"""Near-copies by SimHash fingerprints, joined with themselves as binary tries.

A fingerprint has 64 bits. Two fingerprints within `most` bits of each other have one half, of 32 bits, that differs in
most // 2 bits or fewer, so two tries are joined, one that begins with either half: pairs of nodes are traversed together
from the root, their differing bits add up, and a pair is pruned when it is beyond most // 2 within the first half, or
beyond `most` at all. Each pair that links survives in one of the two.

On Spark the first levels of the traversal are the shuffle. Equal fingerprints become one row. Their sorted arrays are
cut into subtries by the first bits, and a subtrie goes to each pair of subtries, itself included, whose first bits differ
little enough; there are 1 + b + b (b - 1) / 2 such pairs for b bits and 4 bits to differ, and b grows with the logarithm
of the number of fingerprints. A task traverses its pairs of subtries level by level, in numpy, a bounded number of pairs
of nodes at a time, first for 1 differing bit, then for 2, then for all: a pair of nodes whose fingerprints are all
connected already is pruned, too, so a group of copies makes links as many as it has members, not as it has pairs.

Results in special cases: a null, empty or wordless text has fingerprint zero, and links like any other; fewer words
than a shingle make one shingle of the whole; rows with a null doc_id get their fingerprint and a null component_id and
link nothing; rows that share a doc_id are one document, so what either links to is linked; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import buckets
from granary.llm.common import cut, discard, prepare, relieved, stored
from granary.llm.jaccard import components

#: Fingerprints of a subtrie, about; pairs of nodes that are traversed at once; pairs of fingerprints of two nodes that are compared outright.
SUBTRIE, FRONTIER, OUTRIGHT = 1 << 15, 1 << 20, 8
_words = re.compile(rb"[^\x20\x09-\x0D]+").findall


# Fingerprints -----------------------------------------------------------------------------------------------------------
def fingerprint(text: str | None, width: int = 4) -> int:
    """Bit k is 1 if it is in over half of the hashes of the text's shingles, repeated ones counted each time."""
    words = _words(text.encode("utf-8", "surrogatepass").lower()) if text else []
    if not words:
        return 0
    k, line = min(width, len(words)), b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    ones, total, most = np.zeros(64, np.int64), len(words) - k + 1, 1 << 16
    starts, ends, digest = starts[:total].tolist(), ends[k - 1 :].tolist(), xxhash.xxh64_intdigest
    for i in range(0, total, most):
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts[i : i + most], ends[i : i + most], strict=True)], np.dtype("<u8"))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed integer of the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                fp = np.array([fingerprint(t, width) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(relieved(run), "doc_id long, fp long")


# The join of a pair of subtries -------------------------------------------------------------------------------------------
class _Linked:
    """Fingerprints 0 to n - 1 and what is connected: a label for each, and the links that connected them."""

    def __init__(self, n: int):
        self.label, self.links = np.arange(n), []

    def connect(self, a: np.ndarray, b: np.ndarray) -> None:
        up = self.label
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = i, j
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            while up[y] != y:
                up[y] = up[up[y]]
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
                self.links.append((i, j))
        while not np.array_equal(up[up], up):  # labels of all point to their root
            self.label = up = up[up]


def _edges(v: np.ndarray, depth: int) -> np.ndarray:
    """Where the nodes of a depth begin in a sorted array, and its end."""
    if depth == 0:
        return np.array([0, len(v)] if len(v) else [0])
    return np.concatenate([np.flatnonzero(np.diff(v >> np.uint64(64 - depth), prepend=~(v[:1] >> np.uint64(64 - depth)))), [len(v)]])


def _spread(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places in the ranges a and b of each row."""
    w = b1 - b0
    n = (a1 - a0) * w
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    w = np.repeat(w, n)
    return np.repeat(a0, n) + k // w, np.repeat(b0, n) + k % w


def join(v: np.ndarray, one: int, depth: int, most: int, half: int) -> list[tuple[int, int]]:
    """Links (i, j) that connect all that links within `most` bits, and `half` of the first 32, do connect.

    v[:one] and v[one:] are the sorted fingerprints of two subtries below `depth` equal bits each; if v[one:] is empty the first
    is joined with itself.
    """
    found = _Linked(len(v))
    left, right = v[:one], v[one:] if one < len(v) else v[:one]
    shift = one if one < len(v) else 0  # where the right side's fingerprints are in v
    if not len(left):
        return []
    edges: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(depth: int) -> tuple[np.ndarray, np.ndarray]:
        if depth not in edges:
            edges[depth] = _edges(left, depth), _edges(right, depth)
        return edges[depth]

    start = int((left[0] ^ right[0]) >> np.uint64(64 - depth)).bit_count() if depth else 0
    for budget in sorted({x for x in (1, 2, most) if start <= x <= most}):
        # A pair of nodes: their places among the nodes of a depth, and the bits they differ in.
        stack = [(depth, np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, start))]
        while stack:
            d, a, b, far = stack.pop()
            (ea, eb) = at(d)
            # What is connected, all of it, needs no comparison.
            la, lb = found.label[:one], found.label[shift:] if shift else found.label[:one]
            low_a, high_a, low_b, high_b = np.minimum.reduceat(la, ea[:-1]), np.maximum.reduceat(la, ea[:-1]), np.minimum.reduceat(lb, eb[:-1]), np.maximum.reduceat(lb, eb[:-1])
            done = (low_a[a] == high_a[a]) & (low_b[b] == high_b[b]) & (low_a[a] == low_b[b])
            a, b, far = a[~done], b[~done], far[~done]
            a0, a1, b0, b1 = ea[a], ea[a + 1], eb[b], eb[b + 1]
            few = ((a1 - a0) * (b1 - b0) <= OUTRIGHT) | (d == 64)
            if few.any():
                i, j = _spread(a0[few], a1[few], b0[few], b1[few])
                x = left[i] ^ right[j]
                near = (np.bitwise_count(x) <= budget) & (np.bitwise_count(x >> np.uint64(32)) <= half) & (i < j + shift)
                i, j = i[near], j[near] + shift
                new = found.label[i] != found.label[j]
                if new.any():
                    found.connect(i[new], j[new])
            a, b, far = a[~few], b[~few], far[~few]
            if not len(a):
                continue
            # Children: the nodes of the next depth that begin within a node; there are one or two of them.
            ca, cb = at(d + 1)
            ka0, ka1 = np.searchsorted(ca, ea[a]), np.searchsorted(ca, ea[a + 1])
            kb0, kb1 = np.searchsorted(cb, eb[b]), np.searchsorted(cb, eb[b + 1])
            n = (ka1 - ka0) * (kb1 - kb0)
            i, j = _spread(ka0, ka1, kb0, kb1)
            bit = np.uint64(63 - d)
            far = np.repeat(far, n) + (((left[ca[i]] ^ right[cb[j]]) >> bit) & np.uint64(1)).astype(np.int64)
            ok = far <= (min(budget, half) if d < 32 else budget)
            if not shift:
                ok &= i <= j  # of a node with itself each pair of children once
            i, j, far = i[ok], j[ok], far[ok]
            for k in range(0, len(i), FRONTIER):
                stack.append((d + 1, i[k : k + FRONTIER], j[k : k + FRONTIER], far[k : k + FRONTIER]))
    return found.links


# The join on Spark --------------------------------------------------------------------------------------------------------
def masks(bits: int, half: int) -> list[int]:
    """In what the first bits of two subtries may differ: half of them at most."""
    return [sum(1 << x for x in chosen) for k in range(half + 1) for chosen in combinations(range(bits), k)]


def _turned(v: np.ndarray, trie: int) -> np.ndarray:
    """Trie 1 begins with the second half."""
    return v if trie == 0 else (v << np.uint64(32)) | (v >> np.uint64(32))


def links(nodes: DataFrame, n: int, most: int = 4) -> DataFrame:
    """(a, b): links between fingerprints that connect all that are within `most` bits of each other. nodes: (fp), n different ones."""
    half, n_tasks = most // 2, buckets.tasks(nodes, n)
    bits = max(4, min(20, (max(n, 1) // SUBTRIE).bit_length(), 32))
    apart = masks(bits, half)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The subtries of a task, once for each pair of subtries they take part in."""
        held, total = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            v = np.concatenate(held)
            for trie in (0, 1):
                own = np.sort(_turned(v, trie))
                head = (own >> np.uint64(64 - bits)).astype(np.int64)
                first = np.flatnonzero(np.diff(head, prepend=-1))
                rows = []
                for x, y in zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=True):
                    payload, p = buckets.pack([own[x:y]]), int(head[x])
                    for m in apart:
                        low = min(p, p ^ m)
                        # A bucket: the trie, the smaller first bits and what the others differ in.
                        rows.append(((trie << 60) | (low << 32) | m, int(p != low), y - x, payload))
                    if len(rows) > 2000:
                        yield buckets.batch(rows)
                        rows = []
                yield buckets.batch(rows)

        for b in batches:
            held.append(b.column(0).to_numpy().view(np.uint64))
            total += len(held[-1])
            if total > buckets.ROWS * 50:
                yield from flush()
                held, total = [], 0
        if held:
            yield from flush()

    return _gathered(nodes.select("fp").mapInArrow(relieved(run), buckets.BLOCKS), n_tasks, bits, most, half)


def _gathered(packed: DataFrame, n: int, bits: int, most: int, half: int) -> DataFrame:
    """The links of each bucket: its blocks come together, one bucket after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            left, right = (np.sort(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in held)
            alone = key is not None and key & 0xFFFFFFFF == 0  # a subtrie with itself
            if len(left) and (alone or len(right)):
                v = np.concatenate([left, right])
                found = np.array(join(v, len(left), bits, most, half), np.int64).reshape(-1, 2)
                if len(found):
                    a, b = (_turned(v[x], key >> 60).view(np.int64) for x in found.T)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            for x in held:
                x.clear()

        for batch in batches:
            for bucket, side, size, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != key:
                    yield from done()
                    key = bucket
                held[side].append(buckets.unpack(payload, size, [np.uint64])[0])
        yield from done()

    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(relieved(run), "a long, b long")


def classes(docs: DataFrame, most: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row: the smallest doc_id reachable by links, itself included."""
    spark = prepare(docs.sparkSession)
    rows = stored(fingerprints(docs, width))
    known = rows.filter("doc_id is not null")
    nodes = cut(known.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = links(nodes, nodes.count(), most)
    # Rows of one doc_id with several fingerprints connect these.
    several = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a != b").select("doc_id", "a")
    several = known.join(several, "doc_id").filter("fp != a").select("a", F.col("fp").alias("b"))
    roots = components(found.unionAll(several)).select(F.col("node").alias("fp"), "root")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = cut(named)
    smallest = named.groupBy("root").agg(F.min("node").alias("component_id"))
    labels = cut(named.join(smallest, "root").select("fp", "component_id"))
    out = rows.join(labels, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    discard(spark)
    return out
