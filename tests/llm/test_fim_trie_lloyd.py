"""Fill-in-the-middle, fingerprint tries and delta Lloyd: brute force, SQL and special cases."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from granary.llm import fim, lloyd, trie

SF = "/root/testdata/sf0.001"
WEIRD = [None, "", " ", "one", "one", "tab\tand\x0bmore\x0c\r\n", "çé ñ ß 中文 😀", "😀😀👩‍👩‍👧", "x" * 5000, "a b " * 4000, "a <P> b", "a <S", "S> <M <", "<M>", "\x00\x1c\x85\xa0 "]


def frame(spark, texts, ids=None):
    rows = [(i, t, "clash", "clash", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, form string, component_id string, n int")


# 11 -------------------------------------------------------------------------------------------------------------------
def brute_fim(doc_id, text):
    t, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n, sha = len(t), lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(t), sha(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, a, b - a, sha(out), sha(t)


def test_fim_brute_force(spark):
    texts = [*WEIRD * 6, *("ab😀\n"[: i % 5] * i for i in range(60))]
    ids = [*range(len(texts) - 2), None, 7]
    got = fim.digests(frame(spark, texts, ids)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute_fim(i, t) for i, t in zip(ids, texts, strict=True)), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.digests(frame(spark, [])).collect() == []


@pytest.mark.parametrize("grammar, pieces", [
    ("char", ["a", " ", "b", "\n", "😀", "!"]), ("word", ["a ", "b\n", "😀!"]), ("line", ["a b\n", "😀!"]), ("sentence", ["a b\n😀!"]), ("class", ["a", " ", "b", "\n", "😀!"]), ([("b", r"\n")], ["a b", "\n😀!"]),
])
def test_units(spark, grammar, pieces):
    df = spark.createDataFrame([("a b\n😀!",), ("",)], "t string").select("t", fim.units(F.col("t"), grammar).alias("u"))
    assert {r.t: r.u for r in df.collect()} == {"a b\n😀!": pieces, "": []}


@pytest.mark.parametrize("grammar", list(fim.UNITS))
def test_fim_keeps_texts_and_columns(spark, grammar):
    d = frame(spark, WEIRD)
    got = fim.transformed(d, grammar).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert [r.back for r in sorted(got, key=lambda r: r.own.doc_id)] == [t or "" for t in WEIRD]
    assert all(r.own.form == "clash" and r.own.n == 1 for r in got)
    assert all((r.prefix or "") + (r.middle or "") + (r.suffix or "") == (r.own.text or "") for r in got if r.form != "plain")


def test_fim_is_jvm_only_and_moves_nothing(spark):
    plan = fim.digests(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan.replace(",lang:string,source:string,n_chars:bigint", "")


# 12 -------------------------------------------------------------------------------------------------------------------
def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_classes(ids, prints, most=4):
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if ids[i] is not None and ids[j] is not None and ((prints[i] ^ prints[j]).bit_count() <= most or ids[i] == ids[j]):
                up[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(least.get(root(i), x), x)
    return [None if x is None else least[root(i)] for i, x in enumerate(ids)]


def test_fingerprints(spark):
    rng = random.Random(4)
    texts = [*WEIRD, *(" ".join(rng.choice("aA bB cc\tdé".split(" ")) for _ in range(rng.randint(0, 40))) for _ in range(200))]
    assert [trie.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def connected(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in pairs:
        up[root(i)] = root(j)
    return [min(k for k in range(n) if root(k) == root(i)) for i in range(n)]


@pytest.mark.parametrize("frontier, outright, most", [(1 << 20, 8, 4), (7, 1, 4), (100, 64, 4), (50, 8, 3), (50, 8, 0), (50, 2, 7)])
def test_tries_brute_force(monkeypatch, frontier, outright, most):
    """All that is within `most` bits, and half of them in the first 32, is connected, and nothing else."""
    monkeypatch.setattr(trie, "FRONTIER", frontier)
    monkeypatch.setattr(trie, "OUTRIGHT", outright)
    rng = np.random.default_rng(most)
    for centre, noise, size in ((3, 4, 120), (40, 2, 160), (1, 6, 100)):
        base = rng.integers(0, 1 << 63, centre, np.uint64)
        v = base[rng.integers(0, centre, size)]
        for _ in range(noise):
            v = v ^ np.where(rng.random(size) < 0.7, np.uint64(1) << rng.integers(0, 64, size).astype(np.uint64), np.uint64(0))
        v = np.unique(v)
        half = most // 2
        near = [(i, j) for i in range(len(v)) for j in range(i) if int(v[i] ^ v[j]).bit_count() <= most and int((v[i] ^ v[j]) >> np.uint64(32)).bit_count() <= half]
        found = trie.join(v, len(v), 0, most, half)
        assert set(found) <= {(min(x), max(x)) for x in near} and connected(len(v), found) == connected(len(v), near)
        assert len(found) < len(v) or not len(v)  # links, not pairs
        # As subtries below 3 bits
        pairs = []
        for p in range(8):
            for m in trie.masks(3, half):
                q = p ^ m
                left, right = (np.flatnonzero(v >> np.uint64(61) == np.uint64(x)) for x in (p, q))
                if q < p or not len(left) or not len(right):
                    continue
                at = left if p == q else np.concatenate([left, right])
                pairs += [(at[i], at[j]) for i, j in trie.join(v[at], len(left), 3, most, half)]
        assert connected(len(v), pairs) == connected(len(v), near)


@pytest.mark.parametrize("parts", [1, 5])
def test_simhash_components(spark, parts):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = list(WEIRD)
    for _ in range(25):
        t = [rng.choice(words) for _ in range(rng.choice((3, 60, 300, 900)))]
        for _ in range(rng.randint(1, 8)):
            texts.append(" ".join(t))
            t = list(t)
            t[rng.randrange(len(t))] = rng.choice(words)
    ids = [*range(1000, 1000 + len(texts))]
    ids[20], ids[21], ids[40], ids[2] = None, None, ids[60], None
    got = trie.classes(frame(spark, texts, ids).repartition(parts)).collect()
    prints = [brute_fingerprint(t) for t in texts]
    want = [(i, f"{p:016x}", c) for i, p, c in zip(ids, prints, brute_classes(ids, prints), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len({w[2] for w in want}) < len(want) - 25  # the fixture does have links
    assert trie.classes(frame(spark, [])).collect() == []


def test_simhash_query(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = d.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in trie.classes(d).collect()}
    assert got == {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(rows, prints, brute_classes([r.doc_id for r in rows], prints), strict=True)}


def test_a_large_group_of_copies_makes_few_links():
    """Each fingerprint within 3 bits of one text: every pair is a candidate, links are as many as members."""
    rng = np.random.default_rng(2)
    bits = np.uint64(1) << rng.integers(0, 64, (30_000, 3)).astype(np.uint64)
    v = np.unique(np.uint64(0x123456789ABCDEF0) ^ np.bitwise_xor.reduce(bits, axis=1))
    found = trie.join(v, len(v), 0, 4, 2)
    assert len(found) < len(v)


# 13 -------------------------------------------------------------------------------------------------------------------
def brute_lloyd(rows, k=16, rounds=3):
    """[(id, cluster, distance, ...)] in plain integers."""
    ok = [(i, [int(np.floor(64 * np.float64(np.float32(x)))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    first = sorted(ok, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [q for _, q in first]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [near(q)[1] for _, q in ok]
        c = [[sum(v) // own.count(j) for v in zip(*(q for (_, q), o in zip(ok, own, strict=True) if o == j), strict=True)] if j in own else c[j] for j in range(len(c))]
    out = [(i, *near(q)[::-1]) for i, q in ok]
    inertia = {j: sum(d for _, o, d in out if o == j) for j in range(len(c))}
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out), key=repr)


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, e, "clash", 1) for i, e in rows], "vec_id long, embedding array<float>, cluster string, label int").repartition(parts)


def test_lloyd_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "BLOCK", 17)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(5, 64))
    rows = [(i, (base[i % 5] + rng.normal(size=64) * 0.6).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(3, rows[3][1]), (None, rows[4][1]), (None, [0.0] * 64)]
    bad = [(300, None), (301, []), (302, [1.0] * 63), (303, [None] + [1.0] * 63), (304, [float("nan")] * 64), (305, [float("inf")] + [0.0] * 63), (306, [1.0] * 65)]
    got = lloyd.clusters(vectors(spark, rows + bad)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_lloyd(rows)


@pytest.mark.parametrize("size", [1e-3, 3e3, 5e5])
def test_lloyd_small_and_large_components(spark, size):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=64) * size).tolist()) for i in range(40)]
    assert sorted(map(tuple, lloyd.clusters(vectors(spark, rows)).collect()), key=repr) == brute_lloyd(rows)


def test_lloyd_special(spark):
    assert lloyd.clusters(vectors(spark, [])).collect() == []
    assert lloyd.clusters(vectors(spark, [(1, None)])).collect() == []
    few = [(i, [float(i % 2)] * 64) for i in range(5)]  # fewer than clusters, and ties
    assert sorted(map(tuple, lloyd.clusters(vectors(spark, few)).collect()), key=repr) == brute_lloyd(few)
    far = lloyd.clusters(vectors(spark, [(i, [float(i) * 1e15] * 64) for i in range(30)])).collect()
    assert len(far) == 30 and {r.inertia for r in far} == {None} and any(r.distance == 0 for r in far) and any(r.distance is None for r in far)


def test_lloyd_compares_only_what_may_change():
    rng = np.random.default_rng(7)
    x = rng.integers(-300, 300, (500, 64)).astype(np.int16)
    before = rng.integers(-300, 300, (9, 64))
    owner = lloyd.distances(x, before).argmin(axis=1)
    for changed in ([], [2], [0, 5, 8], list(range(9))):
        now = before.copy()
        now[changed] += rng.integers(-40, 40, (len(changed), 64))
        own, far = lloyd.reassigned(x, owner, before, now)
        full = lloyd.distances(x, now)
        assert (own == full.argmin(axis=1)).all() and (far == full.min(axis=1)).all()


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_delta_lloyd"])
def test_sql(spark, name):
    from granary.llm import queries as Q

    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in want.description]
    df = Q.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(want.fetchall(), key=repr)
