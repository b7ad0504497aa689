"""Similarity join of word-shingle sets by parity sketches.

A text's set holds the hashes of its distinct shingles. XOR-hashing a set toggles one bit of a sketch for each element,
so the Hamming distance of two sketches is at most the size of the sets' symmetric difference. Two sets that link
differ in at most d elements, d following from their sizes: with d + 1 pieces in a sketch, one piece is equal. Sets are
joined on equal pieces, size band by size band, and candidates are verified on the shingles of their texts.

Equal sets are first put together into classes; a class is named by its smallest doc_id, a `node` below. The nodes of a
piece (a bucket) are not paired with each other. Four rounds link them, each leaving out what is connected already:
1. each node with the smallest node that it shares a bucket with;
2. each node with the smallest nodes of each of its buckets, its hubs;
3. for two components in a bucket, the two nodes whose sketches are closest;
4. all nodes of a bucket in different components whose sketches are close enough. This makes the result exact.
In rounds 3 and 4 sketches are compared in blocks of a bucket, so that no task holds a whole one.

Results in special cases: null and empty texts have an empty set, 0 shingles and link with nothing; fewer words than a
shingle make one shingle of the whole; rows with a null doc_id are returned with a null component_id and link nothing;
rows that share a doc_id are one document, so what either links to is linked; other columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import buckets
from granary.llm.common import WordHashes, cut, discard, few, mix, prepare, relieved, stored

#: Nodes of a bucket that are compared with each other at once.
BLOCK = 1024
#: Pieces that a task groups at once, some 40 MB with all that is made of them, and nodes of one piece that stay apart from other tasks' nodes beyond this.
HELD, HOT = 400_000, 4096
#: The natural log of 2^-64.
CHANCE = -44.4
_words = re.compile(rb"[^\x20\x09-\x0D]+").findall
_step = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Hashes(WordHashes):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


_hashes = _Hashes(200_000)


def shingles(text: str | None, width: int = 3) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; A-Z are lower-cased."""
    h = _hashes.of(_words(text.encode().lower())) if text else np.zeros(0, np.uint64)
    if not len(h):
        return h
    k = min(width, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out + h[i : i + n] * _step[i % len(_step)] + np.uint64(i))
    return np.unique(out)


def differs(total: int, percent: int) -> int:
    """The most elements in which two sets may differ that link, given the sum of their sizes."""
    return (100 - percent) * total // (100 + percent)


def bands(percent: int, most: int) -> list[int]:
    """The least sizes of the bands, up to one beyond `most`: sets that link lie in one band or in two neighbouring ones. Smaller sets link only if they are equal."""
    out = [next(n for n in range(1, 101) if 100 * n >= percent * (n + 1)) if percent < 100 else most + 1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return out


def sketched(h: np.ndarray, pieces: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A parity sketch of 64 bits for each piece, and the elements that each piece has got."""
    at = mix(h ^ np.uint64(pieces + (seed << 40))) % np.uint64(64 * pieces)
    where = (at >> np.uint64(6)).astype(np.int64)
    out = np.zeros(pieces, np.uint64)
    np.bitwise_xor.at(out, where, np.uint64(1) << (at & np.uint64(63)))
    return out, np.bincount(where, minlength=pieces)


def sketch(h: np.ndarray, pieces: int) -> np.ndarray:
    return sketched(h, pieces)[0]


def folded(x: np.ndarray) -> bytes:
    """A shorter parity sketch: an eighth of the words, still some bits for each element that may differ."""
    n = -(-len(x) // 8)
    return np.bitwise_xor.reduce(np.concatenate([x, np.zeros(8 * n - len(x), np.uint64)]).reshape(8, n), axis=0).tobytes()


class _Bands:
    """Bands as far as sets have needed them."""

    def __init__(self, percent: int, exact: bool = False):
        self.percent, self.exact, self.edges, self.plans = percent, exact, bands(percent, 1 << 12), {}

    def of(self, n: int) -> int:
        """The band of a size; -1 below the first."""
        if self.edges[-1] <= n:
            self.edges = bands(self.percent, 2 * n)
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def differs(self, band: int) -> int:
        """The most elements in which sets of a band, or of it and the one below, may differ that link."""
        while band + 1 >= len(self.edges):
            self.edges = bands(self.percent, 2 * self.edges[-1])
        return differs(2 * (self.edges[band + 1] - 1), self.percent)

    def plan(self, band: int) -> tuple[int, int, np.ndarray]:
        """(pieces, least, lost) of a band's sketches.

        least: the fewest elements of a piece to join on; 0: all pieces of one sketch are, which are more than the
        elements in which sets may differ. Else so many sketches are made that the chance of two sets that link
        differing in all pieces of `least` elements or more is below 2^-64. lost: for pieces of 0, 1, 2 ... elements the
        log of the chance of differing in one, at the worst: all elements they may differ in are one's own, or all the
        other's. The plan with the fewest rows is taken, light pieces counting more, as many sets have them; if exact is
        asked for it is always that of all pieces.
        """
        if band not in self.plans:
            d, k = self.differs(band), np.arange(64)
            n = self.edges[band]
            blank = d * np.exp(-self.edges[max(band - 1, 0)] / max(d, 1))
            enough = 1 + d + int(blank + 2 * blank**0.5)
            factorial, weight = np.cumsum(np.log(np.maximum(k, 1))), 1 + 30 * 0.4**k
            usual = lambda pieces: pieces * np.exp(k * np.log(n / pieces) - n / pieces - factorial)
            found = [((usual(enough) * weight).sum(), enough, 0, np.zeros(64))]
            for mean in () if self.exact else (3, 4, 5, 6, 8, 10):
                pieces = n // mean
                if pieces < 8:
                    break
                share = usual(pieces)
                lost = np.log1p(-np.minimum(np.minimum((self.percent / 100) ** k, (1 - 1 / pieces) ** d), 1 - 1e-12))
                for least in range(2, 20):
                    sketches = np.ceil(1.1 * CHANCE / (share * lost)[least:].sum())
                    if sketches <= 8:
                        found.append((sketches * (share * weight)[least:].sum() + sketches, pieces, least, lost))
            self.plans[band] = min(found, key=lambda x: x[:3])[1:]
        return self.plans[band]

    def pieces(self, band: int) -> int:
        return self.plan(band)[0]


def signs(h: np.ndarray, edges: _Bands, band: int) -> tuple[np.ndarray, np.ndarray]:
    """(sketch, signatures): a set's sketch in a band, and the pieces to join on, as 64-bit hashes.

    Sets that link have one in common. Where all pieces of a sketch are joined on that is sure: they have len(v) -
    differs pieces or more in common, and a set with fewer blank ones than that leaves these out, for one that is not
    blank is among them. Else it is sure but for a chance of 2^-64, that of two hashes being equal: a set goes on to
    further sketches until its own heavy pieces suffice, and each that it shares with another is one of the other's.
    """
    pieces, least, lost = edges.plan(band)
    v, count = sketched(h, pieces)
    if not least:
        blank = v == 0
        at = np.flatnonzero(~blank) if len(v) - edges.differs(band) > int(blank.sum()) else np.arange(len(v))
        return v, mix(v[at] ^ mix(at.astype(np.uint64) + (np.uint64(band) << np.uint64(32))))
    out, total, seed, own = [], 0.0, 0, v
    while True:
        at = np.flatnonzero(count >= least)
        out.append(mix(own[at] ^ mix(at.astype(np.uint64) + (np.uint64(band) << np.uint64(32)) + (np.uint64(seed) << np.uint64(44)))))
        total += lost[np.minimum(count[at], 63)].sum()
        if total <= CHANCE:
            return v, np.concatenate(out)
        seed += 1
        own, count = sketched(h, pieces, seed)


def _sketched(docs: DataFrame, percent: int, width: int, exact: bool = False) -> DataFrame:
    """doc_id, n, digest of the set, its band (-1: none), and for its own band and the next one folded sketches (low, high) and signatures of the pieces to join on (own, after)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _Bands(percent, exact)
        for b in batches:
            for x in range(0, b.num_rows, 500):
                part = b.slice(x, 500)
                n, digest, band, low, high, own, after = [], [], [], [], [], [], []
                for text in part.column(1).to_pylist():
                    h = shingles(text, width)
                    i = edges.of(len(h))
                    n.append(len(h))
                    digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                    band.append(i)
                    for k, short, whole in ((i, low, own), (i + 1, high, after)):
                        if i < 0:
                            short.append(None)
                            whole.append(None)
                            continue
                        v, sig = signs(h, edges, k)
                        short.append(folded(v))
                        whole.append(sig.tobytes())
                cols = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(band, pa.int32()), *(pa.array(c, pa.binary()) for c in (low, high, own, after))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "n", "digest", "band", "low", "high", "own", "after"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(relieved(run), "doc_id long, n long, digest binary, band int, low binary, high binary, own binary, after binary")


#: What is packed: rows (sig, node, side) of all pieces, and those (key, sig, node, side) of groups beyond HOT within a
#: task, which stay by themselves. A side is 4 * band + 2 (stands for such a group) + 1 (odd: a sketch for the next band).
ALL, APART = 0, 1
_kinds = {ALL: [np.uint64, np.int64, np.int32], APART: [np.uint64, np.uint64, np.int64, np.int32]}


def _grouped(key: np.ndarray, node: np.ndarray, side: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where each key's group begins, and the columns in order of key and node, with one row for both of them: odd if all its rows are, standing for a group if one does."""
    order = np.lexsort((node, key))
    key, node, side, *more = (x[order] for x in (key, node, side, *more))
    at = np.flatnonzero((np.diff(key, prepend=key[:1] ^ np.uint64(1)) != 0) | (np.diff(node, prepend=node[:1]) != 0))
    side = side[at] // 4 * 4 + (np.bitwise_or.reduceat(side, at) & 2) + (np.bitwise_and.reduceat(side, at) & 1)
    key, node, *more = (x[at] for x in (key, node, *more))
    return np.flatnonzero(np.diff(key, prepend=key[:1] ^ np.uint64(1))), key, node, side, *more


def _sent(sig: np.ndarray, node: np.ndarray, side: np.ndarray, salt: int, most: int, bits: int) -> pa.RecordBatch:
    """A task's pieces, packed. Of a group beyond `most` only the smallest node goes where all rows of the piece meet."""
    first, sig, node, side = _grouped(sig, node, side)
    size = np.diff(first, append=len(sig))
    hot = np.repeat(size > most, size)
    alone = np.ones(len(sig), bool)
    alone[hot] = False
    alone[first] = True
    mark = np.zeros(len(sig), np.int32)
    mark[first[size > most]] = 2
    odd = np.bitwise_and.reduceat(side & 1, first)
    meets = np.where(mark > 0, side // 4 * 4 + 2 + np.repeat(odd, size), side).astype(np.int32)
    rows = [*buckets.blocks(ALL, [sig[alone], node[alone], meets[alone]], bits)]
    if hot.any():
        key = mix(sig[hot] + mix(np.array([salt], np.uint64)))
        order = np.argsort(key, kind="stable")
        rows += buckets.blocks(APART, [x[order] for x in (key, sig[hot], node[hot], side[hot])], bits)
    return buckets.batch(rows)


def _met(key: np.ndarray, node: np.ndarray, sig: np.ndarray, side: np.ndarray, whole: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each group its pairs, rows of (hub, node, level), and the members (sig, node, level) that may link with each other.

    The pairs with the hub say all of two nodes, and of any number all that the hub links to, so neither groups of two
    nor hubs are members, but where a group is a part of one (it stands for others, or whole is false). A group of odd
    sides alone has its links in the band they come from.
    """
    if not len(key):
        return np.zeros((0, 3), np.int64), [sig, node, side]
    first, key, node, side, sig = _grouped(key, node, side, sig)
    size = np.diff(first, append=len(key))
    part = np.bitwise_or.reduceat(side & 2, first) > 0 if whole else np.ones(len(first), bool)
    linked = (np.bitwise_and.reduceat(side & 1, first) == 0) | part
    hub, level = np.repeat(node[first], size), (side >> 2).astype(np.int32)
    at = np.repeat(linked & (size > 1), size) & (node != hub)
    pairs = np.unique(np.stack([hub[at], node[at], level[at].astype(np.int64)], 1), axis=0)
    at = np.repeat(linked & (size > 2) | part, size) & ((node != hub) | np.repeat(part, size))
    return pairs, [sig[at], node[at], level[at]]


def _shared(sketches: DataFrame, n: int) -> DataFrame:
    """Pairs (node, level, hub; no sig) and members (sig, node, level; no hub) of all pieces that nodes share, over n tasks. sketches: (doc_id, band, own, after)."""
    bits = buckets.bits_of(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, salt = [], 0, TaskContext.get().partitionId() << 20

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal total, salt
            if held:
                sig, size, node, side = (np.concatenate(x) for x in zip(*held, strict=True))
                yield _sent(sig, np.repeat(node, size), np.repeat(side, size), salt, HOT, bits)
                held.clear()
                total, salt = 0, salt + 1

        for b in batches:
            for node, band, own, after in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for level, odd, pieces in ((band, 0, own), (band + 1, 1, after)):
                    sig = np.frombuffer(pieces, np.uint64)
                    held.append((sig, np.array([len(sig)]), np.array([node], np.int64), np.array([4 * level + odd], np.int32)))
                    total += len(sig)
                if total > HELD:
                    yield from flush()
        yield from flush()

    met: list[np.ndarray] = []  # a task's own: functions come to each task anew

    def pairs() -> Iterator[pa.RecordBatch]:
        if met:
            hub, node, level = np.unique(np.concatenate(met), axis=0).T
            met.clear()
            yield pa.RecordBatch.from_arrays([pa.nulls(len(hub), pa.int64()), pa.array(node), pa.array(level.astype(np.int32)), pa.array(hub)], names=["sig", "node", "level", "hub"])

    def each(arrays: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sig, node, side = arrays[ALL]
        key, apart, a_node, a_side = arrays[APART]
        for found, (sig, node, level) in (_met(sig, node, sig, side, True), _met(key, a_node, apart, a_side, False)):
            if len(found):
                met.append(found)
            if len(sig):
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node), pa.array(level), pa.nulls(len(sig), pa.int64())], names=["sig", "node", "level", "hub"])
        if sum(map(len, met)) > HELD:
            yield from pairs()

    return buckets.gathered(sketches.mapInArrow(relieved(run), buckets.BLOCKS), n, _kinds, each, "sig long, node long, level int, hub long", pairs)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the edges (a, b): the smallest node that is connected. Large and small stars in turn."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A spanning forest of a partition's edges, as stars."""
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in list(up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    e = cut(edges.select("a", "b").mapInArrow(relieved(local), "a long, b long").distinct())
    while True:
        # a > b throughout. Done when no node is above and below, and none has two above it.
        above = e.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m"))
        more = above.filter("n > 1").select("a").unionAll(e.select(F.col("b").alias("a")).join(e.select("a"), "a", "left_semi"))
        if more.isEmpty():
            break
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = cut(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        e = cut(both.join(m, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        m = cut(e.groupBy("a").agg(F.min("b").alias("m")))
        small = e.join(m, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionAll(m.select("a", F.col("m").alias("b"))).distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) whose sets link; texts: (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            ok = []
            for i in range(len(a)):
                if ta[i] != last:
                    last, own = ta[i], shingles(ta[i], width)
                other = shingles(tb[i], width)
                both = len(np.intersect1d(own, other, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(own) + len(other) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(relieved(run), "a long, b long").distinct()


def _merged(state: DataFrame, edges: DataFrame) -> DataFrame:
    """state (node, comp) after components connected by edges (a, b) of nodes have become one."""
    s = state.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    t = state.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    between = edges.join(s, "a").join(t, "b").filter("ca != cb").select(F.greatest("ca", "cb").alias("a"), F.least("ca", "cb").alias("b")).distinct()
    roots = components(between).select(F.col("node").alias("comp"), "root")
    return cut(state.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))


def _near(x: np.ndarray, y: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches (rows of words) allow a link of sets with this sum of sizes."""
    return np.bitwise_count(x ^ y).sum(axis=1) * (100 + percent) <= (100 - percent) * total


def _allowed(pairs: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sketches of a common band, the level, allow a link; pairs: (a, b, level)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, total, wa, wb = batch.columns
            total = total.to_numpy()
            ok = np.zeros(len(total), bool)
            sizes = np.array([len(x) for x in wa.to_pylist()]) if len(total) else np.zeros(0, int)
            for size in np.unique(sizes):  # sketches of one band have one size
                at = np.flatnonzero(sizes == size)
                x, y = (np.frombuffer(b"".join(c.take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), -1) for c in (wa, wb))
                ok[at] = _near(x, y, total[at], percent)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    side = lambda x: words.select(F.col("node").alias(x), "level", F.col("n").alias(f"{x}_n"), F.col("words").alias(f"{x}_words"))
    both = pairs.join(side("a"), ["a", "level"]).join(side("b"), ["b", "level"])
    return both.select("a", "b", (F.col("a_n") + F.col("b_n")).alias("total"), "a_words", "b_words").filter("length(a_words) = length(b_words)").mapInArrow(relieved(run), "a long, b long").distinct()


def _close(rows: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs (a, b) of one bucket, of different components, whose sketches allow a link; if best, for two components of a block the closest pair only.

    rows: (sig, node, comp, n, words, m), m being the size of the bucket. A bucket beyond BLOCK goes out in pairs of blocks.
    """
    parts = F.ceil(F.col("m") / BLOCK).cast("long")
    rows = rows.withColumn("_k", parts).withColumn("_i", F.pmod(F.xxhash64("node"), F.col("_k")))
    # Block pair (i, j), i <= j, holds blocks i and j; a row in block x goes to (min(x, y), max(x, y)) for all y.
    rows = rows.withColumn("_y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
    rows = rows.withColumn("_group", F.xxhash64("sig", F.least("_i", "_y"), F.greatest("_i", "_y"))).withColumn("_pair", F.col("_i") != F.col("_y"))

    def compare(node, comp, n, words, block, crossing) -> tuple[np.ndarray, np.ndarray]:
        ia, ib, apart = [], [], []
        for i in range(len(node) - 1):
            other = slice(i + 1, len(node))
            ok = comp[other] != comp[i]
            if crossing:
                ok &= block[other] != block[i]
            at = np.flatnonzero(ok) + i + 1
            if not len(at):
                continue
            far = np.bitwise_count(words[at] ^ words[i]).sum(axis=1)
            near = far <= (100 - percent) * (n[at] + n[i]) // (100 + percent)
            at, far = at[near], far[near]
            if best and len(at):
                order = np.lexsort((far, comp[at]))
                order = order[np.unique(comp[at][order], return_index=True)[1]]
                at, far = at[order], far[order]
            ia.append(np.full(len(at), i))
            ib.append(at)
            apart.append(far)
        none = np.zeros(0, np.int64)
        ia, ib, apart = (np.concatenate(x) if x else none for x in (ia, ib, apart))
        if best and len(ia):
            # one pair for two components, the closest; the others stay for the next round
            low, high = np.minimum(comp[ia], comp[ib]), np.maximum(comp[ia], comp[ib])
            order = np.lexsort((apart, high, low))
            first = order[(np.diff(low[order], prepend=low[order[0]] - 1) != 0) | (np.diff(high[order], prepend=high[order[0]] - 1) != 0)]
            ia, ib = ia[first], ib[first]
        return np.minimum(node[ia], node[ib]), np.maximum(node[ia], node[ib])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                words = [np.frombuffer(r[4], np.uint64) for r in held]
                # A collision of group names may mix buckets: rows of different lengths belong to different ones.
                for size in {len(w) for w in words}:
                    at = [i for i, w in enumerate(words) if len(w) == size]
                    cols = [np.array([held[i][k] for i in at], np.int64) for k in (1, 2, 3, 5)]
                    a, b = compare(cols[0], cols[1], cols[2], np.stack([words[i] for i in at]), cols[3], held[0][6])
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != key:
                    yield from done()
                    key = row[0]
                held.append(row)
        yield from done()

    spread = rows.select("_group", "node", "comp", "n", "words", "_i", "_pair")
    return spread.repartition("_group").sortWithinPartitions("_group").mapInArrow(relieved(run), "a long, b long").distinct()


def _nearest(pairs: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """Round 1: each node with one smaller node."""
    first = pairs.groupBy("node").agg(F.min("hub").alias("a"), F.min_by("level", "hub").alias("level"))
    return _allowed(first.select("a", F.col("node").alias("b"), "level"), words, percent)


def _undecided(members: DataFrame, state: DataFrame) -> DataFrame:
    """The rows of buckets that have members of several components."""
    own = members.join(state, "node")
    mixed = own.groupBy("sig").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 != c2").select("sig")
    return stored(members.join(mixed, "sig", "left_semi"))


def _to_hubs(pairs: DataFrame, state: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """Round 2: each node with the smallest nodes of its buckets, if these are of other components."""
    pairs = pairs.select("hub", "node", "level").distinct()
    pairs = pairs.join(state, "node").join(state.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp")), "hub").filter("comp != hub_comp")
    return _allowed(pairs.select(F.col("hub").alias("a"), F.col("node").alias("b"), "level"), words, percent)


def _across(members: DataFrame, state: DataFrame, words: DataFrame, percent: int, best: bool, only: DataFrame | None = None) -> DataFrame:
    """Rounds 3 and 4: nodes of a bucket that are of different components; of some components only, if given."""
    own = members.select("sig", "node", "level").distinct().join(state, "node")
    if only is not None:
        own = own.join(only, "comp", "left_semi")
    mixed = own.groupBy("sig").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("m")).filter("c1 != c2 and m > 1").select("sig", "m")
    return _close(own.join(mixed, "sig").join(words, ["node", "level"]).select("sig", "node", "comp", "n", "words", "m"), percent, best)


def classes(docs: DataFrame, percent: int = 90, width: int = 3, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of each row: the smallest doc_id reachable by links, itself included.

    exact: join on all pieces of one sketch in every band, which cannot fail, in place of heavy pieces of several, which
    miss a link with a chance below 2^-64; it costs more rows where sets are large.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    full = stored(_sketched(docs, percent, width, exact))
    rows = cut(full.select("doc_id", "n", "digest"))
    words = full.filter("band >= 0").select(F.col("doc_id").alias("node"), "n", F.col("band").alias("level"), F.col("low").alias("words"))
    words = words.unionAll(full.filter("band >= 0").select("doc_id", "n", F.col("band") + 1, "high"))
    # What has the same set becomes one node.
    known = rows.filter("n > 0 and doc_id is not null")
    named = cut(known.groupBy("digest").agg(F.min("doc_id").alias("node")))
    nodes_of = cut(known.join(named, "digest").filter("doc_id != node").select("doc_id", "digest", "node").distinct())
    sketches = full.filter("band >= 0 and doc_id is not null").join(few(nodes_of.select("doc_id", "digest")), ["doc_id", "digest"], "left_anti")
    shared = stored(_shared(sketches.select("doc_id", "band", "own", "after"), buckets.tasks(docs, rows.count())))
    pairs, members = shared.filter("sig is null").select("node", "level", "hub"), shared.filter("sig is not null").select("sig", "node", "level")
    # Rows of one doc_id with several sets connect these.
    several = known.join(known.groupBy("doc_id").agg(F.min("digest").alias("d1"), F.max("digest").alias("d2")).filter("d1 != d2").select("doc_id"), "doc_id", "left_semi")
    several = several.join(named, "digest").select("doc_id", "node").distinct()
    several = cut(several.join(several.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").filter("a != node").select("a", F.col("node").alias("b")).distinct())
    ends = [shared.select("node"), pairs.select("hub"), several.select("a"), several.select("b")]
    state = cut(functools.reduce(DataFrame.unionAll, ends).distinct().withColumn("comp", F.col("node")))
    if not several.isEmpty():
        state = _merged(state, several)

    def link(state: DataFrame, pairs: DataFrame) -> DataFrame:
        discard(spark)
        if pairs.isEmpty():
            return state
        wanted = cut(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct())
        texts = docs.join(few(wanted), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text")
        edges = cut(_verified(pairs, texts, percent, width))
        discard(spark)
        return _merged(state, edges)

    state = link(state, cut(_nearest(pairs, words, percent)))
    state = link(state, cut(_to_hubs(pairs, state, words, percent)))
    members = _undecided(members, state)
    discard(spark, shared)
    found = cut(_across(members, state, words, percent, True))
    if not found.isEmpty():  # without any close pair nothing is left
        ends = found.select(F.col("a").alias("node")).unionAll(found.select(F.col("b").alias("node")))
        state = link(state, found)
        # Components that had no close pair have none now; those that have become one go by their new name.
        open_ = cut(ends.join(state, "node").select("comp").distinct())
        state = link(state, cut(_across(members, state, words, percent, False, open_)))
    labels = cut(named.join(state, "node", "left").select("digest", F.coalesce("comp", "node").alias("component_id")))
    discard(spark, full, members)
    slim = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("digest")).alias("digest"))
    return slim.join(labels, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 90, width: int = 3) -> DataFrame:
    """docs without the near copies: of each component the document of the smallest doc_id stays, once. Rows with a null doc_id or no words all stay."""
    found = cut(classes(docs, percent, width))
    gone = few(cut(found.filter("doc_id != component_id").select("doc_id").distinct()))
    again = few(cut(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")))
    rest = docs.join(gone, "doc_id", "left_anti")
    once = rest.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return rest.join(again, "doc_id", "left_anti").unionByName(once).select(docs.columns)
