"""Centroid clustering by delta Lloyd rounds in exact integers.

Vectors are kept in blocks, one row for some thousands of them: their integer components, ids and owners, as bytes. A
round reads the blocks of the round before and writes its own; nothing but sums is shuffled, so no vector, id or cluster
that many rows share weighs on one task. A round compares a vector

- whose owner stayed where it was, or came no farther from it, with the centroids that changed alone: those that did
  not are no nearer than the owner was;
- whose owner moved away from it, with all.

Each block hands on what changed hands: for each cluster that won or lost vectors their number and the sum of their
components, with a sign. These transfers are added to the global numbers and sums, k x dimensions integers on the
driver, from which the next centroids follow; sums are never taken anew. When no centroid changed, the rounds are over.

Results in special cases: vectors that are null, of another length, or have a null or non-finite component are left out;
a null id never begins a cluster before all others have, and is else a vector like any other; ties of equal hashes go by
the components; fewer vectors than clusters make fewer clusters; an empty table gives no rows; other columns are not read.
Components are exact whatever their size up to 2^62; a distance beyond a long, and sums that hold it, are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import discard, holding, prepare, stored

#: Vectors of a block, and up to what component float64 products and sums of 64 squares are exact.
BLOCK, SMALL = 4096, 1 << 22
LONG = (1 << 63) - 1


def valid(embedding: Column, dims: int) -> Column:
    """Exactly `dims` components, each a finite number."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(embedding) == dims) & F.forall(embedding, finite), F.lit(False))


def whole(flat: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, as exact integers of the smallest type: int16, int32, int64 or, for some, Python's."""
    x = np.floor(flat.astype(np.float64) * scale).reshape(-1, dims)
    top = np.abs(x).max(initial=0.0)
    if top > 2.0**62:
        raise ValueError("a component is beyond 2^62")
    return x.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows x from rows c, exact: float64 holds them while components are small, else Python's integers do."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= SMALL and x.shape[1] <= 64:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    a, b = x.astype(object), c.astype(object)
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


def own_distances(x: np.ndarray, c: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Squared distance of each row from its owner."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= SMALL and x.shape[1] <= 64:
        return ((x.astype(np.int64) - c.astype(np.int64)[owner]) ** 2).sum(axis=1)
    return ((x.astype(object) - c.astype(object)[owner]) ** 2).sum(axis=1)


def reassigned(x: np.ndarray, owner: np.ndarray, before: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, distance) of each vector after centroids went from `before` to `now`; the smaller number wins a tie."""
    changed = np.flatnonzero((before != now).any(axis=1))
    best, own = own_distances(x, now, owner), owner.astype(np.int64)
    if not len(changed):
        return own, best
    moved = np.isin(owner, changed)
    away = np.flatnonzero(moved)
    away = away[own_distances(x[away], before, owner[away]) < best[away]]  # an owner that came nearer leaves all that stayed farther off
    rest = np.ones(len(x), bool)
    rest[away] = False
    out = own.copy()
    if rest.any():
        d = distances(x[rest], now[changed])
        k = d.argmin(axis=1)  # the first of equals
        d, k = d[np.arange(len(k)), k], changed[k]
        at, old = np.flatnonzero(rest), best[rest]
        wins = (d < old) | ((d == old) & (k < own[rest]))
        out[at[wins]], best[at[wins]] = k[wins], d[wins]
    if len(away):
        d = distances(x[away], now)
        out[away] = d.argmin(axis=1)
        best[away] = d[np.arange(len(away)), out[away]]
    return out, best


def transfers(x: np.ndarray, old: np.ndarray | None, new: np.ndarray) -> list[tuple[int, int, list[Decimal]]]:
    """(cluster, vectors, sums of components): what each cluster won less what it lost; old: None if there were no owners."""
    moved = np.arange(len(x)) if old is None else np.flatnonzero(old != new)
    rows = x[moved].astype(np.int64 if x.dtype != np.int64 else object)
    out = []
    for k in np.unique(new[moved] if old is None else np.concatenate([old[moved], new[moved]])).tolist():
        won, lost = new[moved] == k, np.zeros(len(moved), bool) if old is None else old[moved] == k
        sums = rows[won].sum(axis=0) - rows[lost].sum(axis=0)
        out.append((k, int(won.sum() - lost.sum()), [Decimal(int(v)) for v in np.broadcast_to(sums, x.shape[1])]))
    return out


_MOVED = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))]))
_STATE = "n int, ids array<{id}>, kind string, vectors binary, owner binary, moved array<struct<cluster int, n bigint, sums array<decimal(38,0)>>>"


def _state(ids: pa.Array, x: np.ndarray, owner: np.ndarray, moved: list) -> pa.RecordBatch:
    """A block as one row."""
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    cols = [pa.array([len(ids)], pa.int32()), lists, pa.array([x.dtype.str]), pa.array([x.tobytes()], pa.binary()), pa.array([owner.astype(np.int32).tobytes()], pa.binary()), pa.array([moved], _MOVED)]
    return pa.RecordBatch.from_arrays(cols, names=["n", "ids", "kind", "vectors", "owner", "moved"])


def _totals(state: DataFrame) -> list[tuple[int, int, list[int]]]:
    """The transfers of all blocks, added up: a row for each cluster."""
    each = state.select(F.explode("moved").alias("m")).select("m.cluster", "m.n", F.posexplode("m.sums").alias("place", "v"))
    sums = each.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).groupBy("cluster").agg(F.min("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "v"))).alias("v"))
    return [(r["cluster"], r["n"], [int(p["v"]) for p in r["v"]]) for r in sums.collect()]


class Clusters:
    """Numbers, sums and centroids, as Python's integers: k x dimensions of them."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids, self.n, self.sums = centroids, [0] * len(centroids), [[0] * len(c) for c in centroids]

    def take(self, moved: list[tuple[int, int, list[int]]]) -> None:
        for k, n, sums in moved:
            self.n[k] += n
            self.sums[k] = [a + b for a, b in zip(self.sums[k], sums, strict=True)]
        self.centroids = [[s // self.n[k] for s in self.sums[k]] if self.n[k] else c for k, c in enumerate(self.centroids)]

    def array(self) -> np.ndarray:
        return np.array(self.centroids, np.int64)


def first_centroids(rows: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    whole_ = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return [r["q"] for r in rows.select(digest.alias("h"), whole_.alias("q")).orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()]


def fitted(vectors: DataFrame, k: int = 16, dims: int = 64, rounds: int = 3, seed: int = 1, scale: int = 64) -> tuple[DataFrame, np.ndarray]:
    """(blocks, centroids) after some rounds and one more assignment; blocks: (ids, owner, distance), arrays of one length."""
    spark = prepare(vectors.sparkSession)
    rows = vectors.filter(valid(F.col("embedding"), dims)).select("vec_id", "embedding")
    id_type = rows.schema["vec_id"].dataType.simpleString()
    own = Clusters(first_centroids(rows, k, seed, scale))
    schema = _STATE.format(id=id_type)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, BLOCK) for x in batches for i in range(0, x.num_rows, BLOCK)):
            x = whole(b.column(1).flatten().to_numpy(zero_copy_only=False), dims, scale)
            owner = distances(x, start).argmin(axis=1)
            yield _state(b.column(0), x, owner, transfers(x, None, owner))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for b in batches:
            for i in range(b.num_rows):
                x = np.frombuffer(b.column(2)[i].as_buffer(), np.dtype(b.column(1)[i].as_py())).reshape(-1, dims)
                yield b.column(0)[i].values, x, np.frombuffer(b.column(3)[i].as_buffer(), np.int32)

    if not own.centroids:
        start = np.zeros((1, dims), np.int64)
        return rows.limit(0).mapInArrow(lambda _: iter(()), f"ids array<{id_type}>, owner array<int>, distance array<decimal(38,0)>"), np.zeros((0, dims), np.int64)
    start = own.array()
    state, before = stored(rows.mapInArrow(begin, schema)), start
    for i in range(rounds):
        own.take(_totals(state))
        now = own.array()
        if i + 1 == rounds or (now == before).all():
            break

        def step(batches: Iterator[pa.RecordBatch], before: np.ndarray = before, now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            for ids, x, owner in blocks(batches):
                new, _ = reassigned(x, owner, before, now)
                yield _state(ids, x, new, transfers(x, owner, new))

        after = stored(state.select("ids", "kind", "vectors", "owner").mapInArrow(step, schema))
        discard(spark, state)
        state, before = after, now

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, owner in blocks(batches):
            new, far = reassigned(x, owner, before, now)
            far = [None if v > LONG else Decimal(int(v)) for v in far.tolist()]
            at = pa.array([0, len(ids)], pa.int32())
            lists = [pa.ListArray.from_arrays(at, c) for c in (ids, pa.array(new.astype(np.int32)), pa.array(far, pa.decimal128(38, 0)))]
            yield pa.RecordBatch.from_arrays(lists, names=["ids", "owner", "distance"])

    out = stored(state.select("ids", "kind", "vectors", "owner").mapInArrow(last, f"ids array<{id_type}>, owner array<int>, distance array<decimal(38,0)>"))
    discard(spark, state)
    return out, now


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(v) for v in centroid.tolist()).encode()).hexdigest()


def clusters(vectors: DataFrame, k: int = 16, dims: int = 64, rounds: int = 3, seed: int = 1, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that is kept."""
    blocks, centroids = fitted(vectors, k, dims, rounds, seed, scale)
    each = blocks.select(F.explode(F.arrays_zip("ids", "owner", "distance")).alias("x")).select(F.col("x.ids").alias("vec_id"), F.col("x.owner").alias("cluster"), F.col("x.distance").alias("distance"))
    # A sum that a distance beyond a long is part of is unknown; so is one that is beyond a long itself.
    long = lambda c: F.when(c <= F.lit(LONG).cast("decimal(38,0)"), c).cast("long")
    sums = each.groupBy("cluster").agg(F.sum("distance").alias("d"), F.count_if(F.col("distance").isNull()).alias("unknown")).collect()  # k rows
    known = {r["cluster"]: None if r["unknown"] else int(r["d"]) for r in sums}
    total = None if None in known.values() else sum(known.values())
    whole_ = lambda v: v if v is not None and v <= LONG else None
    rows = [(c, whole_(v), whole_(total), digest(centroids[c])) for c, v in known.items()]
    one = each.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = each.join(F.broadcast(one), "cluster").select("vec_id", "cluster", long(F.col("distance")).alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")  # k rows
    return holding(rows, blocks) if hasattr(blocks, "_granary_path") else rows


def _sql() -> str:
    """The same over `embeddings`, for DuckDB: all distances in each round."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::bigint"
    part = ["v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)"]
    part.append("c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS k, q FROM v QUALIFY k < 16)")
    for i in range(4):
        part.append(f"a{i} AS MATERIALIZED (SELECT v.vec_id, v.q, min({{'d': {far}, 'k': c.k}}) AS m FROM v, c{i} c GROUP BY v.vec_id, v.q)")
        if i < 3:
            part.append(f"s{i} AS (SELECT k, i, sum(x)::bigint AS s, count(*) AS n FROM (SELECT m.k AS k, unnest(q) AS x, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY k, i)")
            part.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(g.q, c.q) AS q FROM c{i} c LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n) ORDER BY i) AS q FROM s{i} GROUP BY k) g USING (k))")
    part.append("h AS (SELECT k, sha256(array_to_string(q, ',')) AS centroid_sha256 FROM c3)")
    return "WITH " + ",\n".join(part) + "\nSELECT vec_id, m.k::int AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.k))::bigint AS cluster_inertia, (sum(m.d) OVER ())::bigint AS inertia, centroid_sha256 FROM a3 JOIN h ON h.k = a3.m.k"


SQL = _sql()
