"""The pipeline on planted documents, its tables when several runs share a session, and the training order against a plain permutation."""

import random
import threading

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import jaccard, order, quality
from granary.llm.bpe import default_vocabulary
from granary.llm.common import release

from test_llm import WEIRD, brute_components, copies, frame

SF = "/root/testdata/sf0.001"


def prose(rng, n, words):
    return ". ".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() for _ in range(n)) + "."


@pytest.fixture(scope="module")
def planted(spark):
    """(documents, what was planted by its kind)"""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("n_chars", F.length("text").cast("long"))
    rng = random.Random(12)
    words = sorted({w.lower().strip(".,") for r in docs.filter("lang = 'en'").limit(60).collect() for w in (r.text or "").split() if w.isalpha()})
    clean = {10_000 + i: prose(rng, 40, words) for i in range(6)}
    own = dict(clean)
    own[20_000] = clean[10_000]  # an exact copy
    near = clean[10_001].split()
    near[100], near[300] = "zyxw", "wxyz"
    own[20_001] = " ".join(near)  # one line, a few words apart
    own[30_000] = " ".join(w + rng.choice(["###", "$$$", "%%%", "&&&"]) for w in prose(rng, 20, words).split())
    own[30_001] = "too short to stay"
    own[30_002] = prose(rng, 12, [a + b for a in ("при", "тек", "дру", "язы", "кото", "учи") for b in ("мер", "ста", "гом", "ком", "рого", "ла", "ние")])
    own[30_003] = None
    rows = [(k, t, None, "planted", len(t or "")) for k, t in own.items()]  # no language: the models learn from the others
    return docs.unionByName(spark.createDataFrame(rows, docs.schema)), clean, own


def test_pipeline_takes_what_was_planted(spark, planted):
    docs, clean, own = planted
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF).cache()
        seen[name] = {r.doc_id: r.text for r in at.filter("doc_id >= 10000").collect()}
    everything = set(own)
    assert set(seen["quality_rules"]) == everything - {30_000, 30_001, 30_003}
    assert set(seen["language_id"]) == set(seen["quality_rules"]) - {30_002}
    assert {k: seen["line_dedup"][k] for k in clean} == clean and 20_000 not in {k for k, t in seen["line_dedup"].items() if t and t.strip()}
    left = {k for k, t in seen["ngram_jaccard"].items() if t and t.strip()}
    assert set(clean) <= left and not left & {20_000, 30_000, 30_001, 30_002, 30_003}
    assert {k: seen["ngram_jaccard"][k] for k in clean} == clean
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, SF).filter("doc_id >= 10000").groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id for r in pieces} == set(seen["ngram_jaccard"]) and all(r.n == r["all"] for r in pieces)


def test_near_copies_alone(spark, planted):
    """The stage by itself, before lines go: of exact and near copies one stays."""
    docs, clean, _ = planted
    left = {r.doc_id for r in corpus_pipeline.ngram_jaccard(spark, docs, SF).filter("doc_id >= 10000").collect()}
    assert set(clean) <= left and not left & {20_000, 20_001}


def test_runs_at_once_keep_their_own_tables(spark, planted):
    docs = planted[0]
    first, second = quality.keep(docs), quality.keep(docs)
    n = second.count()
    release(first)
    assert second.count() == n  # its table is not the one that went
    release(second)
    got = []
    threads = [threading.Thread(target=lambda: got.append(corpus_pipeline.run(spark, SF).count())) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(got) == 2 and got[0] == got[1] > 0


@pytest.mark.parametrize("percent, width", [(90, 3), (80, 5)])
def test_jaccard_exact(spark, percent, width):
    texts = copies(percent) + WEIRD + [" ".join(f"w{(i * 7 + j) % 997}" for i in range(900)) for j in (0, 0, 400)]
    got = sorted(jaccard.classes(frame(spark, texts), percent, width, exact=True).collect())
    assert [(r.n_shingles, r.component_id) for r in got] == brute_components(texts, percent, width)
    edges = jaccard._Bands(percent, exact=True)
    assert all(edges.plan(k)[1] == 0 and edges.plan(k)[0] > edges.differs(k) for k in range(40))


def slot(x, n, key):
    """The permutation in plain integers."""
    mask64 = (1 << 64) - 1

    def mix(v):
        v = (v ^ (v >> 30)) * 0xBF58476D1CE4E5B9 & mask64
        v = (v ^ (v >> 27)) * 0x94D049BB133111EB & mask64
        return v ^ (v >> 31)

    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    low = (1 << half) - 1
    while True:
        left, right = x >> half, x & low
        for k in range(1, order.ROUNDS + 1):
            left, right = right, left ^ (mix((right + mix((k * 0x9E3779B97F4A7C15 + key) & mask64)) & mask64) & low)
        x = left << half | right
        if x < n:
            return x


def test_training_order_contents(spark, tmp_path):
    """Each sequence stands, whole, where the plain permutation of its number says."""
    texts = [*WEIRD, *(f"text number {i} " * (i % 23) for i in range(80))]
    df = frame(spark, texts).repartition(5).cache()
    undo = zstandard.ZstdDecompressor().decompress
    plain = sorted((r.part, r.number, undo(r.tokens, max_output_size=64)) for r in order.sequences(df, 32).collect())
    want = {slot(i, len(plain), 9): data for i, (_, _, data) in enumerate(plain)}
    order.write(df, str(tmp_path / "out"), length=32, per_shard=8, key=9)
    got = [x.tobytes() for x in order.read(str(tmp_path / "out"))]
    assert sorted(want) == list(range(len(plain))) and got == [want[i] for i in range(len(plain))]
    other = {slot(i, len(plain), 10): data for i, (_, _, data) in enumerate(plain)}
    assert got != [other[i] for i in range(len(plain))]
    # The texts themselves, partition by partition: each ends with the end id, and only a partition's last sequence is filled up.
    import tokenizers

    library = tokenizers.Tokenizer.from_file(default_vocabulary()) if default_vocabulary().endswith("json") else None
    if library:
        library.no_truncation()
        library.no_padding()
        by_part = {}
        for part, _, data in plain:
            by_part.setdefault(part, []).append(np.frombuffer(data, "<u2"))
        found = {part: np.concatenate(x).tolist() for part, x in by_part.items()}
        rows = df.select(F.spark_partition_id().alias("p"), "text").collect()
        for part, ids in found.items():
            flat = [t for r in rows if r.p == part for t in [*library.encode(r.text or "", add_special_tokens=False).ids, order.END]]
            assert ids[: len(flat)] == flat and set(ids[len(flat) :]) <= {order.END} and len(ids) - len(flat) < 32


def test_training_order_special(spark):
    nulls = order.shards(frame(spark, [None] * 5), length=4, per_shard=2).collect()
    assert sum(r.n_slots for r in nulls) == sum(-(-n // 4) for n in [r["count"] for r in frame(spark, [None] * 5).groupBy(F.spark_partition_id()).count().collect()])
    extra = frame(spark, ["a b c"]).withColumn("slot", F.lit("x")).withColumn("part", F.lit("y")).withColumn("number", F.lit("z"))
    assert len(order.shards(extra, length=4).collect()) == 1
