"""Deletion of repeated runs by winnowing over hashes of lines.

Lines are split further at sentence ends into units, so that a passage is found in the middle of a line, too. The gram
of a unit is the shortest row of units from it on of GRAM words or more. Of the grams that begin within SPAN words the one
with the smallest hash is a fingerprint; they are chosen within each line and again over the whole text, across line
ends. So each line of GRAM words or more has one, and each stretch of GRAM + SPAN words and its last unit has, however
short its lines. Fingerprints are joined: the first occurrence, by doc_id and position, is the
anchor of all later ones. Each later one is compared with its anchor's surroundings and the match is extended both ways,
REACH units far, which is as far as the neighbouring fingerprints. What matches is deleted; so of each unit deleted an
equal one stays, in an earlier document or further up. The result does not depend on how rows lie in partitions. Of a
repeated stretch that no single earlier text has whole among its anchors, the words between two fingerprints, fewer than
SPAN, may stay.

Results in special cases: null texts stay null, empty ones empty; rows with a null doc_id are passed through and are no
one's anchor; rows with equal doc_id and text are one document and stay all alike; of texts that are equal under several
doc_ids the smallest keeps its text and the others become empty, but for texts of fewer than GRAM words;
other columns are passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import buckets
from granary.llm.common import apart, column_of, crc32, cut, discard, prepare, relieved, stored

#: REACH: units of a word each that lie between two fingerprints, or before or after one of a stretch; AHEAD: those from a place on.
GRAM, SPAN, REACH, AHEAD = 10, 15, 16, 32
_cuts = re.compile(r"(\n+|(?<=[.!?])[ \t]+)").split


def units(text: str) -> tuple[list[str], list[str]]:
    """The units of a text and what follows each; together they are the text."""
    parts = _cuts(text)
    return parts[::2], [*parts[1::2], ""]


def hashes(own: list[str]) -> np.ndarray:
    """Hashes of units without the blanks around them; 0 for blank ones."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(u.strip().encode()) if u else 0 for u in own], np.uint64)


def fingerprints(own: list[str], seps: list[str], h: np.ndarray) -> list[tuple[int, int, int]]:
    """(hash, position, units) of the selected grams of a text."""
    out: dict[tuple[int, int, int], None] = {}
    words = [u.count(" ") + 1 if u else 0 for u in own]
    a, n, several = 0, len(own), False
    ints = h.tolist()

    def select(a: int, b: int) -> None:
        """Adds those of the units a to b, taken as one run."""
        # Grams of the run: (hash, position, units, words before it)
        grams, e, total, before = [], a, 0, 0
        for i in range(a, b):
            while e < b and total < GRAM:
                total += words[e]
                e += 1
            if total < GRAM:
                break
            if words[i]:
                v = ints[i] if e - i == 1 else xxhash.xxh3_64_intdigest(h[i:e].tobytes())
                grams.append((v, i, e - i, before))
            before += words[i]
            total -= words[i]
        before = sum(words[a:b])
        last = -1
        for k, g in enumerate(grams):
            if k and before - g[3] < SPAN:
                break
            # the smallest of the grams that begin within SPAN words from here
            best, x = k, k + 1
            while x < len(grams) and grams[x][3] - g[3] < SPAN:
                if grams[x][0] <= grams[best][0]:
                    best = x
                x += 1
            if best > last:
                out[grams[best][:3]] = None
                last = best

    while a < n:
        b = a
        while b < n - 1 and "\n" not in seps[b]:
            b += 1
        b += 1  # units a to b are a line
        select(a, b)
        several = a > 0
        a = b
    if several:
        select(0, n)
    return list(out)


#: What is packed: the places of grams (gram, doc_id, th, at, size).
_kinds = {0: [np.uint64, np.int64, np.int32, np.int32, np.int32]}


def _later(gram: np.ndarray, doc: np.ndarray, th: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The later places (doc_id, th, at, size, and the doc_id, th and at of the first place) of each gram; first by doc_id, text and position."""
    order = np.lexsort((at, th, doc, gram))
    gram, doc, th, at, size = (x[order] for x in (gram, doc, th, at, size))
    first = np.flatnonzero(np.diff(gram, prepend=gram[:1] ^ np.uint64(1)))
    anchor = np.repeat(first, np.diff(first, append=len(gram)))
    # Rows that are alike are one document: its own places are not later than themselves.
    later = (doc != doc[anchor]) | (th != th[anchor]) | (at != at[anchor])
    return [*(x[later] for x in (doc, th, at, size)), *(x[anchor][later] for x in (doc, th, at))]


def _prints(docs: DataFrame, n: int) -> DataFrame:
    """Rows of a document each (doc_id, th, units: the hashes of its units), and blocks of packed places."""
    bits = buckets.bits_of(n)
    schema = f"{buckets.BLOCKS}, doc_id long, th int, units array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(0, b.num_rows, 10_000):
                part = b.slice(x, 10_000)
                hs, places, count = [], [], []
                ths = []
                for text in part.column(1).to_pylist():
                    own, seps = units(text)
                    h = hashes(own)
                    got = fingerprints(own, seps, h)
                    hs.append(h.view(np.int64))
                    ths.append(crc32(text.encode()) - (1 << 31))
                    places += got
                    count.append(len(got))
                none = pa.nulls(len(hs))
                yield pa.RecordBatch.from_arrays([none.cast(t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.binary())] + [part.column(0), pa.array(ths, pa.int32()), pa.array(hs, pa.list_(pa.int64()))], names=names)
                if places:
                    gram, at, size = (np.array(c, t) for c, t in zip(zip(*places, strict=True), (np.uint64, np.int32, np.int32), strict=True))
                    cols = [gram, np.repeat(part.column(0).to_numpy(), count), np.repeat(np.array(ths, np.int32), count), at, size]
                    order = np.argsort(gram)
                    packed = buckets.batch([*buckets.blocks(0, [c[order] for c in cols], bits)])
                    none = pa.nulls(packed.num_rows)
                    yield pa.RecordBatch.from_arrays([*packed.columns, none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.list_(pa.int64()))], names=names)

    names = ["bucket", "kind", "n", "payload", "doc_id", "th", "units"]
    rows = docs.filter("doc_id is not null and text is not null and text != ''").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(relieved(run), schema)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, th, gone): for each document with repeated runs the stretches of units to delete, as from, to, from, to and so on. th: the text's crc32 less 2^31."""
    spark = prepare(docs.sparkSession)
    n = buckets.tasks(docs, docs.count())
    both = stored(_prints(docs, n))
    rows = both.filter("units is not null").select("doc_id", "th", "units")

    def each(arrays: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        cols = _later(*arrays[0])
        if len(cols[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "th", "at", "size", "a_doc", "a_th", "a_at"])

    blocks = both.filter("payload is not null").select("bucket", "kind", "n", "payload")
    later = cut(buckets.gathered(blocks, n, _kinds, each, "doc_id long, th int, at int, size int, a_doc long, a_th int, a_at int"))
    # The surroundings of each anchor, fetched once, and of each later place.
    around = lambda at: (F.expr(f"slice(units, greatest({at} - {REACH} + 1, 1), least({at}, {REACH}))"), F.expr(f"slice(units, {at} + 1, {AHEAD})"))
    wanted = later.select("a_doc", "a_th", "a_at").distinct().groupBy("a_doc", "a_th").agg(F.collect_list("a_at").alias("ats"))
    units_of = rows.dropDuplicates(["doc_id", "th"])
    left, right = around("a_at")
    anchors = units_of.select(F.col("doc_id").alias("a_doc"), F.col("th").alias("a_th"), "units").join(wanted, ["a_doc", "a_th"]).select("a_doc", "a_th", "units", F.explode("ats").alias("a_at"))
    anchors = cut(anchors.select("a_doc", "a_th", "a_at", left.alias("a_left"), right.alias("a_right")))
    found = later.join(anchors, ["a_doc", "a_th", "a_at"])
    found = found.select("doc_id", "th", F.struct("at", "size", F.when(F.col("a_doc") == F.col("doc_id"), F.col("at") - F.col("a_at")).otherwise(1 << 30).alias("most"), "a_left", "a_right").alias("m"))
    grouped = found.groupBy("doc_id", "th").agg(F.collect_list("m").alias("ms")).join(units_of, ["doc_id", "th"])
    left, right = around("at")
    pairs = grouped.select("doc_id", "th", "units", F.explode("ms").alias("m")).select("doc_id", "th", "units", "m.*").select("doc_id", "th", "at", "size", "most", "a_left", "a_right", left.alias("left"), right.alias("right"))

    def matrix(column: pa.Array, width: int, tail: bool) -> np.ndarray:
        """Lists as rows of a matrix, cut or filled with zeros; of longer lists the tail, reversed, if asked for."""
        flat, at = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
        n = np.diff(at)
        cols = np.arange(width)[None, :]
        where = at[1:, None] - 1 - cols if tail else at[:-1, None] + cols
        return np.where(cols < n[:, None], flat[np.clip(where, 0, max(len(flat) - 1, 0))] if len(flat) else 0, 0)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(0, b.num_rows, 20_000):
                part = b.slice(x, 20_000)
                at, size, most = (part.column(k).to_numpy().astype(np.int64) for k in (2, 3, 4))
                a, c = matrix(part.column(5), REACH, True), matrix(part.column(7), REACH, True)
                i = np.cumprod((a == c) & (a != 0), axis=1).sum(axis=1)
                a, c = matrix(part.column(6), AHEAD, False), matrix(part.column(8), AHEAD, False)
                k = np.cumprod((a == c) & ((a != 0) | (np.arange(AHEAD)[None, :] < size[:, None])), axis=1).sum(axis=1)
                same = k >= np.minimum(size, AHEAD)  # else two grams of one hash
                i = np.minimum(i, np.maximum(most - size, 0))  # a run of one document does not reach its anchor
                k = np.minimum(np.minimum(np.maximum(k, size), size + REACH), np.maximum(most - i, 0))
                keep = pa.array(same & (k > 0))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep), pa.array((at - i).astype(np.int32)).filter(keep), pa.array((at + k).astype(np.int32)).filter(keep)], names=["doc_id", "th", "a", "b"])

    spans = pairs.mapInArrow(relieved(extend), "doc_id long, th int, a int, b int")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = []
            for stretches in b.column(2).to_pylist():
                own: list[int] = []
                for x in sorted((s["a"], s["b"]) for s in stretches):
                    if own and x[0] <= own[-1]:
                        own[-1] = max(own[-1], x[1])
                    else:
                        own += x
                gone.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "th", "gone"])

    grouped = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("x"))
    out = cut(grouped.mapInArrow(relieved(merge), "doc_id long, th int, gone array<int>"))
    discard(spark, both)
    return out


def without(text: str, gone: list[int]) -> str:
    """A text without some of its units; a line that loses all of them goes with its end."""
    own, seps = units(text)
    drop, out, fresh = set(gone), [], True
    for i, (u, s) in enumerate(zip(own, seps, strict=True)):
        if i not in drop:
            out.append(u)
            fresh = fresh and not u
        if "\n" in s:
            if not fresh:
                out.append(s)
            fresh = True
        elif i not in drop:
            out.append(s)
    return "".join(out).rstrip()


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with their text without later repeated runs, and n_deleted, the units deleted; a column of that name is replaced."""
    own = [F.col("new").alias(c) if c == text else F.col(f"own.`{c}`").alias(c) for c in docs.columns if c.lower() != "n_deleted"]
    return _cleaned(docs, text).select(*own, F.col("deleted").alias("n_deleted"))


def _cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs as a struct `own`, their `new` texts and the units `deleted`."""
    prepare(docs.sparkSession)
    spans = repeats(docs.select("doc_id", F.col(text).alias("text"))).withColumnRenamed("doc_id", "key")
    few = spans.agg(F.sum(F.size("gone") + 12)).first()[0] or 0
    keyed = apart(docs).withColumn("th", (F.crc32(F.encode(f"own.`{text}`", "utf-8")) - (1 << 31)).cast("int")).withColumn("key", F.col("own.doc_id").cast("long"))
    # About 4 bytes each with what a row takes: broadcast up to 16 MB, else joined by a shuffle.
    both = keyed.join(F.broadcast(spans) if few <= 4_000_000 else spans, ["key", "th"], "left").select("own", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(0, b.num_rows, 1000):
                part = b.slice(x, 1000)
                old, gone = column_of(part, f"own.{text}"), part.column(1)
                mask = gone.is_valid()
                new, deleted = [], []
                for t, g in zip(old.filter(mask).to_pylist(), gone.filter(mask).to_pylist(), strict=True):
                    hit = [i for a, z in zip(g[::2], g[1::2], strict=True) for i in range(a, z)]
                    new.append(without(t, hit))
                    deleted.append(len(hit))
                n = pc.replace_with_mask(pa.array(np.zeros(part.num_rows, np.int64)), mask, pa.array(deleted, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pc.replace_with_mask(old.cast(pa.string()), mask, pa.array(new, pa.string())), n], names=["own", "new", "deleted"])

    return both.mapInArrow(relieved(run), T.StructType([both.schema["own"], T.StructField("new", T.StringType()), T.StructField("deleted", T.LongType())]))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, text without later repeated runs and n_deleted of every document."""
    return cleaned(docs.select("doc_id", "text")).select("doc_id", "text", "n_deleted")


def keep(docs: DataFrame) -> DataFrame:
    """docs with cleaned texts and their n_chars; documents that had words and lose all go."""
    out = _cleaned(docs).filter("deleted = 0 or trim(new) != ''")
    new = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col(f"own.`{c}`")).alias(c) for c in docs.columns))
