"""Byte-level BPE encoding and decoding with contiguous rank arrays.

A short word keeps its parts and the merge ranks of adjacent parts in contiguous arrays; the smallest rank is looked
for again and again, its boundary is deleted and the two neighbouring ranks are refreshed. Here that runs over all
short words of a batch at once: a word is a row of a matrix. Long words go through a heap, which gives the same merges.

Results in special cases: null text counts as empty and gives an empty list; the string of an added token in a text
becomes its id, as the tokenizers library does by default.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import chunks, prepare, relieved

#: The pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of PLAIN characters, several times as fast; what begins with an apostrophe is no letter, so letters may come first.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
FAST = rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\t-\r 0-9{LETTERS}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Characters for which the two patterns agree.
PLAIN = re.compile(r"[\t-\r\x20-\x7e¡-±´-¸º»¿-ɏ‐-‧‰-⁞₠-₿]*")
#: The ASCII characters for which they don't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
NONE = np.int32(2**31 - 1)
LONG = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """An encoder with a bounded memory of words; `most` words are held before it is emptied."""

    def __init__(self, path: str, most: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.added = added
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.byte_id = np.array([vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        a = np.array([vocab[x] for x, _ in merges], np.uint64)
        b = np.array([vocab[y] for _, y in merges], np.uint64)
        key = a << np.uint64(32) | b
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self._hash_ranks()
        self.made = np.array([vocab[x + y] for x, y in merges], np.int32)
        pair = (self.byte_id.astype(np.uint64)[:, None] << np.uint64(32) | self.byte_id.astype(np.uint64)[None, :]).ravel()
        self.byte_pair = self._rank(pair).reshape(256, 256)
        self.fast, self.exact = re.compile(FAST).findall, regex.compile(PATTERN).findall
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = _Index()
        self.flat = np.zeros(1 << 17, np.int32)
        self.start = np.zeros(1 << 15, np.int64)
        self.count = np.zeros(1 << 15, np.int64)
        self.used = self.known = 0

    def _hash_ranks(self) -> None:
        """Tables of a power of two of places; keys whose place is taken go on to the next, smaller table."""
        self.tables = []
        keys, ranks, bits = self.keys, self.ranks, 19
        while len(keys):
            factor = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.tables))
            place = (keys * factor) >> np.uint64(64 - bits)
            first = np.unique(place, return_index=True)[1]
            held, value = np.full(1 << bits, 2**64 - 1, np.uint64), np.full(1 << bits, NONE, np.int32)
            held[place[first]], value[place[first]] = keys[first], ranks[first]
            self.tables.append((factor, np.uint64(64 - bits), held, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, bits = keys[rest], ranks[rest], max(bits - 3, 8)

    def _rank(self, key: np.ndarray) -> np.ndarray:
        out = None
        for factor, shift, held, value in self.tables:
            place = (key * factor) >> shift
            got = np.where(held[place] == key, value[place], NONE)
            out = got if out is None else np.minimum(out, got)
        return out

    def words(self, text: str) -> list[str]:
        if self.split_added is None or not any(x in text for x in self.added):
            return self._split(text)
        out: list[str] = []
        for k, piece in enumerate(self.split_added.split(text)):
            # A zero byte pair marks an added token: no pre-token mixes NUL with letters.
            out += [f"\0a\0{piece}"] if k % 2 else self._split(piece)
        return out

    def _split(self, text: str) -> list[str]:
        plain = not any(c in text for c in SEPARATORS) if text.isascii() else PLAIN.fullmatch(text)
        return self.fast(text) if plain else self.exact(text)

    def _short(self, raw: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of words, bytes in rows of a matrix with their lengths, as a matrix, and their number."""
        width = raw.shape[1]
        parts = self.byte_id[raw]
        ranks = np.full(raw.shape, NONE, np.int32)
        if width > 1:
            ranks[:, :-1] = self.byte_pair[raw[:, :-1], raw[:, 1:]]
        cols = np.arange(width)
        ranks[cols[None, :] >= n[:, None] - 1] = NONE
        live = np.arange(len(raw))
        p, r, m = parts, ranks, n.copy()
        done_parts, done_n = np.zeros_like(parts), n.copy()
        while len(live):
            j = r.argmin(axis=1)
            rows = np.arange(len(live))
            least = r[rows, j]
            go = least != NONE
            if not go.all():
                end = ~go
                done_parts[live[end], : p.shape[1]] = p[end]
                done_n[live[end]] = m[end]
                live, p, r, m, j, least = live[go], p[go], r[go], m[go], j[go], least[go]
                if not len(live):
                    break
                rows = np.arange(len(live))
                w = int(m.max())
                p, r = p[:, :w], r[:, :w]
            # delete the boundary after part j, in both arrays
            w = p.shape[1]
            src = np.minimum(cols[None, :w] + (cols[None, :w] > j[:, None]), w - 1)
            p, r = np.take_along_axis(p, src, 1), np.take_along_axis(r, src, 1)
            p[rows, j] = self.made[least]
            m = m - 1
            r[rows, m - 1] = NONE
            q = p.astype(np.uint64)
            # refresh the ranks on both sides
            right = j < m - 1
            if right.any():
                x, y = rows[right], j[right]
                r[x, y] = self._rank(q[x, y] << np.uint64(32) | q[x, y + 1])
            left = j > 0
            if left.any():
                x, y = rows[left], j[left] - 1
                r[x, y] = self._rank(q[x, y] << np.uint64(32) | q[x, y + 1])
        return done_parts, done_n

    def _long(self, word: bytes) -> list[int]:
        """The same merges by a heap of (rank, position), for words too long for scans."""
        part = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(part)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        raw = np.frombuffer(word, np.uint8)
        heap = [(r, i) for i, r in enumerate(self.byte_pair[raw[:-1], raw[1:]].tolist()) if r != NONE]
        rank = dict((i, r) for r, i in heap)
        heapq.heapify(heap)
        table = self._pairs
        while heap:
            r, i = heapq.heappop(heap)
            if rank.get(i) != r:
                continue
            k = nxt[i]
            part[i], part[k] = int(self.made[r]), -1
            rank.pop(k, None)
            nxt[i] = nxt[k]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for x in (prv[i], i):
                if x >= 0:
                    new = table.get((part[x], part[nxt[x]])) if nxt[x] < n else None
                    rank.pop(x, None)
                    if new is not None:
                        rank[x] = new
                        heapq.heappush(heap, (new, x))
        return [x for x in part if x >= 0]

    @functools.cached_property
    def _pairs(self) -> dict[tuple[int, int], int]:
        return {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(r) for k, r in zip(self.keys.tolist(), self.ranks.tolist(), strict=True)}

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(raw) + bytes(LONG), np.uint8)
        # Words that are no rows of a matrix: added tokens and long ones.
        alone = {i: self._long(raw[i]) for i in np.flatnonzero(size > LONG).tolist()}
        if self.added:
            zero = np.flatnonzero((size > 3) & (flat[start] == 0)).tolist()
            alone |= {i: [self.added[words[i][3:]]] for i in zero if words[i].startswith("\0a\0") and words[i][3:] in self.added}
        group = (np.maximum(size, 1) - 1) // 6
        group[list(alone)] = -1
        count = np.zeros(len(words), np.int64)
        for i, ids in alone.items():
            count[i] = len(ids)
        done = []
        for g in np.unique(group[group >= 0]).tolist():
            own = np.flatnonzero(group == g)
            cols = np.arange(6 * g + 6)
            for x in range(0, len(own), 20_000):
                at = own[x : x + 20_000]
                parts, n = self._short(flat[start[at, None] + np.minimum(cols[None, :], np.maximum(size[at, None] - 1, 0))], size[at])
                count[at] = n
                done.append((at, n, parts[cols[None, :] < n[:, None]]))
        out = np.zeros(int(count.sum()), np.int32)
        first = np.cumsum(count) - count
        for at, n, ids in done:
            out[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        for i, ids in alone.items():
            out[first[i] : first[i] + len(ids)] = ids
        return out, count

    def _learn(self) -> None:
        new = self.index.new
        if not new:
            return
        ids, n = self.encode_words(new)
        total, upto = len(ids), self.known + len(new)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while upto > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.flat[self.used : self.used + total] = ids
        self.count[self.known : upto] = n
        self.start[self.known : upto] = self.used + np.cumsum(n) - n
        self.used, self.known = self.used + total, upto
        new.clear()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, where each text begins in them, word indices of all texts, where each text begins in those); both beginnings have one end more."""
        if self.known > self.most:
            self._forget()
        get, at = self.index.__getitem__, []
        for t in texts:
            w = self.words(t) if t else ()
            at.append(np.fromiter(map(get, w), np.int64, len(w)))
        self._learn()
        words = np.concatenate(at) if at else np.zeros(0, np.int64)
        wstart = np.concatenate([[0], np.cumsum([len(x) for x in at])]).astype(np.int64)
        n = self.count[words]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.start[words] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, upto[wstart], words, wstart

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class _Index(dict):
    """word -> its number; words met for the first time wait in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i


class _Encoders(dict):
    """Encoders by path, for a Python worker to keep over its tasks; clear() lets go of the words that they hold, not of their tables."""

    def clear(self) -> None:
        for own in self.values():
            own._forget()


_encoders = _Encoders()


def encoder(path: str) -> Bpe:
    """One for each Python worker, which keeps it over its tasks."""
    if path not in _encoders:
        _encoders[path] = Bpe(path)
    return _encoders[path]


def _with(df: DataFrame, name: str, kind: T.DataType, fn) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    prepare(df.sparkSession)
    return df.mapInArrow(relieved(fn), schema)


def encode(df: DataFrame, text: str = "text", into: str = "ids", path: str | None = None) -> DataFrame:
    """df with the token ids of its column `text` in column `into` (array of int); a column of that name is replaced."""
    path = path or default_vocabulary()
    df = df.drop(into) if into != text else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            col = b.schema.get_field_index(text)
            texts = b.column(col).to_pylist()
            for x, y in chunks(texts):
                ids, at, _, _ = own.encode(texts[x:y])
                part = b.slice(x, y - x)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], names=[*b.schema.names, into])

    return _with(df, into, T.ArrayType(T.IntegerType()), run)


def decode(df: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the text of its column of ids in column `into`; null ids give null."""
    path = path or default_vocabulary()
    df = df.drop(into) if into != ids else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            lists = b.column(b.schema.get_field_index(ids))
            for x in range(0, b.num_rows, 500):
                part, own_lists = b.slice(x, 500), lists.slice(x, 500)
                texts = [None if not v.is_valid else own.decode(v.values.to_numpy(zero_copy_only=False).tolist()) for v in own_lists]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*b.schema.names, into])

    return _with(df, into, T.StringType(), run)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; null texts count as empty."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = decode(encode(rows, path=path).drop("text"), path=path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
