"""Training-order materialisation: token sequences in a keyed random order, in shards of fixed stride.

Documents become token ids, each followed by the end id; a partition's ids are cut into sequences of one length, the
last filled up with the end id. All N sequences are numbered; a keyed Feistel permutation of [0, N), with cycle-walking,
gives each number its slot in the training order. Slots are dealt to tasks by range, and each task writes shards in
which slot s stands at byte (s mod per_shard) * stride: a reader starts at any slot without reading what is before it.

Results in special cases: null and empty texts give the end id alone; equal texts are kept, each in its place; an empty
table gives no shard; other columns than text are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.bpe import default_vocabulary, encoder
from granary.llm.common import chunks, cut, few, mix, prepare

LENGTH = 2048
END = 50256
PER_SHARD = 1024
ROUNDS = 6


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of numbers below n: a Feistel network over the next even power of two, walked until it falls below n."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % 2**64))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return left << shift | right

    out = once(np.asarray(x, np.uint64))
    while len(at := np.flatnonzero(out >= n)):
        out[at] = once(out[at])
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int = LENGTH, end: int = END, path: str | None = None) -> DataFrame:
    """(part, number, tokens): sequences of each partition in order, as compressed little-endian 16-bit ids."""
    prepare(docs.sparkSession)
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, number = encoder(path), TaskContext.get().partitionId(), 0
        if len(own.bytes_of) > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        press = zstandard.ZstdCompressor(level=1).compress
        rest = np.zeros(0, "<u2")

        def rows(tokens: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            data = [press(x.tobytes()) for x in tokens.reshape(-1, length)]
            first, number = number, number + len(data)
            return pa.RecordBatch.from_arrays([pa.array([part] * len(data), pa.int32()), pa.array(range(first, number), pa.int64()), pa.array(data, pa.binary())], names=["part", "number", "tokens"])

        for b in batches:
            texts = b.column(0).to_pylist()
            for x, y in chunks(texts):
                flat, at, _, _ = own.encode(texts[x:y])
                rest = np.concatenate([rest, np.insert(flat, at[1:], end).astype("<u2")])
                full = len(rest) // length * length
                if full:
                    yield rows(rest[:full])
                    rest = rest[full:]
        if len(rest):
            yield rows(np.concatenate([rest, np.full(length - len(rest), end, "<u2")]))

    return docs.select("text").mapInArrow(run, "part int, number long, tokens binary")


def shards(docs: DataFrame, key: int = 0, length: int = LENGTH, per_shard: int = PER_SHARD, end: int = END, path: str | None = None) -> DataFrame:
    """(shard, first_slot, n_slots, stride, data): the bytes of each shard; slot s is data[(s - first_slot) * stride:][:stride]."""
    rows = cut(sequences(docs, length, end, path))
    # A row for each input partition.
    counts = cut(rows.groupBy("part").agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    starts = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    rows = rows.join(few(starts), "part").select((F.col("start") + F.col("number")).alias("number"), "tokens")
    stride = 2 * length

    def slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = permuted(b.column(0).to_numpy(), total, key)
            yield pa.RecordBatch.from_arrays([pa.array(s // per_shard), pa.array(s), b.column(1)], names=["shard", "slot", "tokens"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        undo = zstandard.ZstdDecompressor().decompress
        shard, data = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if data:
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([shard * per_shard], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([stride], pa.int32()), pa.array([b"".join(data)], pa.binary())], names=["shard", "first_slot", "n_slots", "stride", "data"])
                data.clear()

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != shard:
                    yield from done()
                    shard = k
                data.append(undo(x, max_output_size=stride))
        yield from done()

    placed = rows.mapInArrow(slot, "shard long, slot long, tokens binary")
    # So many tasks that each holds a few shards, whatever the input.
    tasks = max(1, -(-total // (16 * per_shard)))
    tasks = max(tasks, min(-(-total // per_shard), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return placed.repartitionByRange(tasks, "shard").sortWithinPartitions("shard", "slot").mapInArrow(join, "shard long, first_slot long, n_slots long, stride int, data binary")


def write(docs: DataFrame, uri: str, **options) -> dict:
    """Writes shards as files `shard-%08d.bin` under uri (a path or URI that Arrow's filesystems and all executors reach) and returns the manifest, kept beside them.

    A shard is written under another name and then moved, so a task that runs again leaves the same file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(uri)
        fs.create_dir(root, recursive=True)
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), strict=True):
                name = f"{root}/shard-{k:08d}.bin"
                own = f"{name}.{TaskContext.get().taskAttemptId()}"
                with fs.open_output_stream(own) as f:
                    f.write(data)
                fs.move(own, name)
            yield b.select(["shard", "n_slots", "stride"])

    out = shards(docs, **options).mapInArrow(run, "shard long, n_slots long, stride int").agg(F.sum("n_slots").alias("n"), F.max("stride").alias("stride")).first()
    manifest = {"slots": out["n"] or 0, "stride": out["stride"] or 2 * options.get("length", LENGTH), "per_shard": options.get("per_shard", PER_SHARD), "key": options.get("key", 0)}
    fs, root = _filesystem(uri)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _filesystem(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri)


def read(uri: str, slot: int = 0) -> Iterator[np.ndarray]:
    """The sequences from a slot on, one by one, without reading those before it."""
    fs, root = _filesystem(uri)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        m = json.loads(f.read())
    while slot < m["slots"]:
        k, at = divmod(slot, m["per_shard"])
        with fs.open_input_file(f"{root}/shard-{k:08d}.bin") as f:
            f.seek(at * m["stride"])
            while data := f.read(m["stride"]):
                yield np.frombuffer(data, "<u2")
                slot += 1


def materialised(docs: DataFrame, key: int = 0) -> DataFrame:
    """The shards of all documents in training order with their digests."""
    out = shards(docs, key)
    return out.select("shard", "first_slot", "n_slots", "stride", "data", F.sha2("data", 256).alias("data_sha256"))
