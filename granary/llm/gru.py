"""Document log-likelihood by a gated recurrent language model, trained by truncated backpropagation in numpy.

Words are counted over all training documents. The most frequent ones, a number that grows with the square root of the
vocabulary, have entries of their own in the network. All others have an entry for their ending: their last two bytes
choose one of TAILS kinds, which the network reads and predicts like words of one more class, and within which a word's
probability follows from its count. The output is factored: first a softmax over classes, of words of similar frequency or of one kind
of endings, then one within the class. A document is scored whole, in windows between which the state is carried.

Training is local stochastic gradient descent: in each round every task trains on its own documents from the common
parameters, and the results are averaged. Each training document is trained on whole, in the windows of one round:
documents stand end to end, are cut into streams of one length, and the state is carried from window to window of a stream;
only the gradient ends with a window. A stream that begins within a document begins with an empty state. Counts of the KNOWN most frequent words go to all tasks, a bounded
table; the counts of all other words are joined.

Results in special cases: null and empty texts have the end token alone; without training documents all words are
unknown and the model is uniform over what it has; rows with equal or null doc_id are scored one by one (a null doc_id
counts as an empty text in the choice of training documents); equal texts of one choice get equal scores up to rounding.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import chunks, crc_bucket, cut, discard, mix, prepare, relieved, stored

#: Words with entries of their own come in so many, at least so many times, and there are so many of them for the square root of the vocabulary.
CLASS, LEAST_CLASSES, SHARE = 64, 16, 2
#: Words of the first class, by how many more the next one has, and kinds of endings of a class: where frequencies fall as ranks grow, as Zipf has it, a token's class and its place there take few outputs.
FIRST, MORE, KINDS = 8, 6, 32
#: Kinds of all other words, by their endings: a power of two, as the lowest bits of a word's hash say which, and whole classes.
TAILS = 256
KNOWN = 1 << 18
HIDDEN = 24
#: Tokens of a window of backpropagation, streams side by side, fewest of them, and tokens that are dealt to streams at once.
WINDOW, BATCH, FEWEST, DEALT = 32, 384, 96, 4_000_000
#: Tokens for an update, at least: windows of few streams are put together.
STEP = 1024
#: States whose outputs are held at once, so that a core's cache has them, documents scored side by side, and rows of a token that are summed one by one.
BLOCK, BESIDE, FEW_ROWS = 2048, 2048, 32
ROUNDS, LEAST_STEPS = 3, 48
RATE = 0.04
#: Tasks whose sums of parameters come to the driver, and those that sum up before them where there are many parts.
COMBINE, BEFORE, MANY = 16, 256, 1024
SMOOTH = 0.1
END = np.uint64(0x454E44)
#: What a byte adds to its word's hash, A-Z like a-z, and which bytes stand between words.
_BYTE = np.random.default_rng(29).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: The class of a word that ends in two bytes; one of a single byte has a blank before it.
_ENDING = np.random.default_rng(31).integers(0, TAILS, (256, 256)).astype(np.uint64)
_ENDING[65:91] = _ENDING[97:123]
_ENDING[:, 65:91] = _ENDING[:, 97:123]
_POWER, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes that are hashed at once.
SPAN = 1 << 17


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the factor and of its inverse, modulo 2^64."""
    return tuple(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)]).cumprod() for x in (_POWER, _INVERSE))


def hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the words of `data`: polynomials in a word's bytes, from sums that run over whole spans of it, so that no word is an object. The lowest bits are the class of a word's ending; the others tell some 10^8 words apart."""
    codes = np.frombuffer(data, np.uint8)
    space = _SPACE[codes]
    out, where, a = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while a < len(codes):
        b = min(a + SPAN, len(codes))
        if b < len(codes):  # a span ends at a space; one that has none goes on to the next
            at = np.flatnonzero(space[a:b])
            b = a + int(at[-1]) + 1 if len(at) else b + (int(space[b:].argmax()) if space[b:].any() else len(codes) - b)
        edge = np.flatnonzero(np.diff(space[a:b].view(np.int8), prepend=1, append=1))
        first, last = edge[::2], edge[1::2]
        power, inverse = _powers(SPAN) if b - a <= SPAN else _powers.__wrapped__(b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.multiply(_BYTE[codes[a:b]], power[: b - a], sums[1:])
        np.cumsum(sums, out=sums)
        h = mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
        own = codes[a:b]
        before = np.where(last - first > 1, own[np.maximum(last - 2, 0)], 32)
        out.append(h - (h & np.uint64(TAILS - 1)) + _ENDING[before, own[last - 1]])
        where.append(first + a)
        a = b
    return np.concatenate(out), np.concatenate(where)


def words_in(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, hashes of the distinct words, the most frequent first, each word's number among these)."""
    data = [t.encode() if t else b"" for t in texts]
    end = np.cumsum([len(d) + 1 for d in data])
    flat, at = hashed(b" ".join(data))
    own, ids, n = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    number = np.empty(len(own), np.int32)
    number[order] = np.arange(len(own))
    return np.diff(np.searchsorted(at, end), prepend=0), own[order], number[ids]


class Ranks:
    """Ranks of word hashes among the known ones, -1 for others."""

    def __init__(self, known: np.ndarray):
        self.order = np.argsort(known)
        self.known = known[self.order]

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        return np.where(self.known[at] == words, self.order[at], -1)


#: Documents of some CHARS characters in a row: their ids, choice and numbers of words, the hashes of their distinct words and each word's number among these.
CHUNK, CHARS = "doc_id array<long>, held_out array<boolean>, size array<int>, words binary, ids binary", 1_000_000


def chunked(docs: DataFrame) -> DataFrame:
    """doc_id, text and held_out as rows of CHUNK: texts are split into words once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for x, y in chunks(texts, CHARS):
                size, words, ids = words_in(texts[x:y])
                part = b.slice(x, y - x)
                row = [[part.column(0).to_pylist()], [part.column(2).to_pylist()], [size], [words.tobytes()], [ids.tobytes()]]
                kinds = (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=["doc_id", "held_out", "size", "words", "ids"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(relieved(run), CHUNK)


def unchunked(b: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids of documents, held out, words, distinct words' hashes, each word's number) of each row."""
    for i in range(b.num_rows):
        keys, held, size = (b.column(k)[i].values for k in range(3))
        yield keys.to_pylist(), held.to_numpy(zero_copy_only=False), size.to_numpy(), np.frombuffer(b.column(3)[i].as_buffer(), np.uint64), np.frombuffer(b.column(4)[i].as_buffer(), np.int32)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n): the hash and the number of each word of the training texts; the end token has the hash END. rows: CHUNK."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, ends = [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                words, n = (np.concatenate(x) for x in zip(*held, strict=True))
                own, at = np.unique(words, return_inverse=True)
                n = np.bincount(at, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], names=["word", "n"])
                held.clear()

        for b in batches:
            for _, away, size, words, ids in unchunked(b):
                ends += int((~away).sum())
                n = np.bincount(ids[np.repeat(~away, size)], minlength=len(words))
                held.append((words[n > 0], n[n > 0]))
                n_held += len(words)
                if n_held > 2_000_000:
                    yield from out()
                    n_held = 0
        yield from out()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([int(END)], pa.int64()), pa.array([ends], pa.int64())], names=["word", "n"])

    return rows.mapInArrow(relieved(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_size(vocabulary: int) -> int:
    """How many words have entries of their own."""
    return CLASS * max(LEAST_CLASSES, int(np.ceil(SHARE * vocabulary**0.5 / CLASS)))


@functools.lru_cache(maxsize=4)
def classes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each class of n head words and kinds begins, and the last one ends; the class of each of these, and of the end, a class by itself behind the others)."""
    i = np.arange(int((n / MORE) ** 0.5 * 2) + 2)
    at = FIRST * i + MORE * i * (i - 1) // 2
    at = at[at + (FIRST + MORE * i) // 2 <= n - TAILS]  # what is left is a class if it has half of its words, else the last one's
    at = np.concatenate([at, np.arange(n - TAILS, n + 1, KINDS)])
    size = np.append(np.diff(at), 1)
    return at, np.repeat(np.arange(len(size)), size).astype(np.int16 if len(size) < 1 << 15 else np.int32)


def ends_of(p: dict) -> tuple[int, int]:
    """(the token that ends a document, what stands before its first one). Tokens are head words, then TAILS kinds of endings, then these."""
    return p["bw"].size, p["bw"].size + 1


def targets(words: np.ndarray, rank: np.ndarray, ids: np.ndarray, size: np.ndarray, head: int) -> list[np.ndarray]:
    """The network's tokens of each document of a chunk, with its end."""
    kind = np.int16 if head + TAILS + 2 < 1 << 15 else np.int32
    flat = np.where((rank < 0) | (rank >= head), head + (words & np.uint64(TAILS - 1)).astype(np.int64), rank).astype(kind)[ids]
    return np.split(np.insert(flat, np.cumsum(size), head + TAILS), np.cumsum(size + 1)[:-1])


def initial(counts: np.ndarray, tails: np.ndarray, ends: float, head: int) -> dict[str, np.ndarray]:
    """Parameters that give each head word, and each kind of other words, its relative frequency in any state. counts: of the head words, at most `head`."""
    rng = np.random.default_rng(11)
    c = np.full(head + TAILS, SMOOTH)
    c[: len(counts)] += counts
    c[head:] += tails
    groups = np.append(np.add.reduceat(c, classes(len(c))[0][:-1]), ends + SMOOTH)
    p = {
        "x": rng.normal(0, 0.3, (head + TAILS + 2, 3 * HIDDEN)), "u": rng.normal(0, 1 / HIDDEN**0.5, (HIDDEN, 3 * HIDDEN)),
        "wc": rng.normal(0, 0.05, (HIDDEN, len(groups))), "bc": np.log(groups / groups.sum()),
        "ww": rng.normal(0, 0.05, (len(c), HIDDEN)), "bw": np.log(c / c.max()),
    }
    p["x"][:, :HIDDEN] -= 1.0  # slow gates: the state keeps what it has met
    return {k: v.astype(np.float32) for k, v in p.items()}


class Room(dict):
    """Arrays that are used again from window to window: memory that is given back and asked for again is cleared each time, a third of a window's seconds in a process that does nothing else."""

    def of(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        size = int(np.prod(shape))
        held = self.get((name, kind))
        if held is None or held.size < size:
            held = self[name, kind] = np.empty(size, kind)
        return held[:size].reshape(shape)


#: A worker has it during a task.
_room = Room()


def _taken(name: str, rows: np.ndarray, at: np.ndarray, axis: int = 0) -> np.ndarray:
    """Rows by their numbers, in the room."""
    return rows.take(at, axis=axis, out=_room.of(name, (*rows.shape[:axis], *at.shape, *rows.shape[axis + 1 :]), rows.dtype), mode="clip")


def _gates(w: np.ndarray) -> np.ndarray:
    """Rows of all three gates as one contiguous block for each gate."""
    return np.ascontiguousarray(w.reshape(-1, 3, HIDDEN).swapaxes(0, 1))


def _step(u: np.ndarray, x: np.ndarray, h: np.ndarray, kept: np.ndarray, new: np.ndarray) -> None:
    """A token's step, gate by gate: x, what the tokens give to update gate, reset gate and candidate, becomes these; `kept` and `new` what the reset gate leaves of the state h and the state after it."""
    gates, n = x[:2], x[2]
    gates += h @ u[:2]
    np.negative(gates, gates)
    np.exp(gates, gates)
    gates += 1
    np.reciprocal(gates, gates)
    np.multiply(gates[1], h, kept)
    n += kept @ u[2]
    np.tanh(n, n)
    np.subtract(n, h, new)
    new *= gates[0]
    new += h


def step(p: dict, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """(state after a token, update gate, reset gate and candidate, what the reset gate leaves of the state). x: the tokens' rows of p["x"]."""
    x, kept, new = _gates(x), np.empty_like(h), np.empty_like(h)
    _step(_gates(p["u"]), x, h, kept, new)
    return new, x, kept


def _softmax(h: np.ndarray, w: np.ndarray, t: np.ndarray, safe: bool, g: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """(log chance of each row's target t, gradient of h of the negative sum); that of w is added to g. The last column of h is one, that of w the bias; logits are moved only where they could leave the range of floats."""
    e = h @ w.T
    if not safe:
        e -= e.max(axis=1, keepdims=True)
    flat, at = e.reshape(-1), np.arange(0, e.size, e.shape[1]) + t
    own = flat.take(at)
    np.exp(e, e)
    total = e @ np.ones(e.shape[1], e.dtype)
    own -= np.log(total)
    if g is None:
        return own, None
    flat[at] -= total  # chances, less one for the target, are these by the sums; states have fewer columns to divide
    g += e.T @ (h / total[:, None])
    dh = e @ w[:, :-1]
    dh /= total[:, None]
    return own, dh


def output(p: dict, h: np.ndarray, target: np.ndarray, gradient: bool = False):
    """Natural log of each target's chance in its state; with gradient also those of the negative sum."""
    (begin, class_of), k = classes(p["bw"].size), h.shape[1]
    c = class_of.take(target)
    order = np.argsort(c, kind="stable")  # class by class, so that each is a slice
    own, target, c = _room.of("own", (len(order), k + 1), h.dtype), target.take(order), c.take(order)
    own[:, :k] = _taken("states", h, order)
    own[:, k] = 1
    # States lie within -1 and 1.
    wc, ww = np.concatenate([p["wc"].T, p["bc"][:, None]], axis=1), np.concatenate([p["ww"], p["bw"][:, None]], axis=1)
    safe = [np.abs(w).sum(axis=1).max() < 80 for w in (wc, ww)]
    gc, gw = (np.zeros_like(wc), np.zeros_like(ww)) if gradient else (None, None)
    logp, dh = np.empty(len(order), h.dtype), _room.of("dh", (len(order), k), h.dtype) if gradient else None
    for a in range(0, len(order), BLOCK):
        logp[a : a + BLOCK], d = _softmax(own[a : a + BLOCK], wc, c[a : a + BLOCK], safe[0], gc)
        if gradient:
            dh[a : a + BLOCK] = d
    cut_at = np.searchsorted(c, np.arange(len(begin))).tolist()
    for i, (first, last) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
        for a in range(cut_at[i], cut_at[i + 1], BLOCK):
            b = min(a + BLOCK, cut_at[i + 1])
            x, d = _softmax(own[a:b], ww[first:last], target[a:b] - first, safe[1], gw[first:last] if gradient else None)
            logp[a:b] += x
            if gradient:
                dh[a:b] += d
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    if not gradient:
        return logp.take(back)
    return logp.take(back), _taken("states", dh, back), {"wc": np.ascontiguousarray(gc[:, :-1].T), "bc": gc[:, -1].copy(), "ww": gw[:, :-1].copy(), "bw": gw[:, -1].copy()}


def log_likelihood(p: dict, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log of the chance of each document, a sequence of targets; states are carried through it whole."""
    size = np.array([len(d) for d in docs])
    order = np.argsort(-size, kind="stable")
    out, u, rows = np.zeros(len(docs)), _gates(p["u"]), _gates(p["x"])
    states, targets, which, held = [], [], [], 0

    def settle() -> None:
        nonlocal held
        t = np.concatenate(targets)
        out[:] += np.bincount(np.concatenate(which), output(p, np.concatenate(states), t).astype(float), len(docs))
        states.clear()
        targets.clear()
        which.clear()
        held = 0

    for a in range(0, len(docs), BESIDE):  # documents of about one length, side by side
        index = order[a : a + BESIDE]
        flat, own = np.concatenate([docs[i] for i in index]), size[index]
        start = np.cumsum(own) - own
        h, before = np.zeros((len(index), HIDDEN), np.float32), np.full(len(index), ends_of(p)[1])
        longer = np.searchsorted(-own, -np.arange(int(own[0])), "left")  # how many documents go beyond each step
        for t, n in enumerate(longer.tolist()):
            new = np.empty((n, HIDDEN), np.float32)
            _step(u, _taken("x", rows, before[:n], 1), h[:n], np.empty_like(new), new)
            h, before = new, flat.take(start[:n] + t)
            states.append(h)
            targets.append(before)
            which.append(index[:n])
            held += n
            if held > 60_000:
                settle()
    if held:
        settle()
    return out


def _by_token(rows: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows, put in order, from each of `first` to the next: the first FEW_ROWS of all sums one after the other, as most have no more, and the rest of each at once."""
    size = np.diff(first, append=len(order))
    by = np.argsort(-size, kind="stable")
    rows, first, size = _taken("ordered", rows, order), first[by], size[by]
    own, ones = rows.take(first, axis=0), np.ones(size[0], rows.dtype)
    for i, n in enumerate(np.searchsorted(-size, -np.arange(1, FEW_ROWS), "left").tolist(), 1):
        own[:n] += _taken("rows", rows, first[:n] + i)
    many = int(np.searchsorted(-size, -FEW_ROWS, "left"))
    for i, (a, n) in enumerate(zip(first[:many].tolist(), size[:many].tolist(), strict=True)):
        own[i] += ones[FEW_ROWS:n] @ rows[a + FEW_ROWS : a + n]
    out = np.empty_like(own)
    out[by] = own
    return out


def gradient(p: dict, tokens: np.ndarray, before: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Summed gradients of a window (rows x time) from the state h, the state after it, and its mean log chance. Targets below 0 are padding; after its end a document begins, with an empty state."""
    rows, time = tokens.shape
    k = HIDDEN
    inputs = np.concatenate([before[:, None], np.maximum(tokens[:, :-1], 0)], axis=1).T
    stop, begin = ends_of(p)
    fresh = inputs == stop
    inputs = np.where(fresh, begin, inputs)
    anew = fresh.any(axis=1).tolist()
    u, x = _gates(p["u"]), _taken("x", _gates(p["x"]), inputs, 1)  # x becomes gates and candidates
    came, kept, hs = (_room.of(name, (time, rows, k), u.dtype) for name in ("came", "kept", "hs"))
    for t in range(time):
        came[t] = h
        if anew[t]:
            came[t] *= ~fresh[t][:, None]
        _step(u, x[:, t], came[t], kept[t], hs[t])
        h = hs[t]
    flat = tokens.T.ravel()
    real = np.flatnonzero(flat >= 0)
    count = max(len(real), 1)
    if len(real) == len(flat):
        logp, dhs, g = output(p, hs.reshape(-1, k), flat, True)
    else:
        logp, d, g = output(p, hs.reshape(-1, k)[real], flat[real], True)
        dhs = np.zeros((time * rows, k), hs.dtype)
        dhs[real] = d
    dhs = dhs.reshape(time, rows, k)
    dgates = _room.of("dgates", x.shape, x.dtype)
    dh = np.zeros((rows, k), hs.dtype)
    back = np.ascontiguousarray(u.swapaxes(1, 2))
    for t in range(time - 1, -1, -1):
        dh += dhs[t]
        (z, r, n), (dz, dr, dn) = x[:, t], dgates[:, t]
        move = dh * z
        np.multiply(n, n, dn)
        np.subtract(1, dn, dn)
        dn *= move
        drh = dn @ back[2]
        stay = 1 - z
        np.subtract(n, came[t], dz)
        dz *= move
        dz *= stay
        np.subtract(1, r, dr)
        dr *= kept[t]
        dr *= drh
        dh *= stay
        drh *= r
        dh += drh
        dh += dz @ back[0]
        dh += dr @ back[1]
        if anew[t]:
            dh *= ~fresh[t][:, None]
    flat_g = _room.of("flat", (time * rows, 3 * k), u.dtype)
    flat_g.reshape(-1, 3, k)[:] = dgates.reshape(3, -1, k).swapaxes(0, 1)
    g["u"] = np.concatenate([came.reshape(-1, k).T @ flat_g[:, : 2 * k], kept.reshape(-1, k).T @ flat_g[:, 2 * k :]], axis=1)
    order = np.argsort(inputs.ravel().astype(np.int16 if begin < 1 << 15 else np.int32), kind="stable")
    own = inputs.ravel()[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    g["x"] = np.zeros_like(p["x"])
    g["x"][own[first]] = _by_token(flat_g, order, first)
    return g, h.copy(), float(logp.sum()) / count


class Adam:
    def __init__(self, p: dict, rate: float = RATE):
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def update(self, p: dict, g: dict) -> None:
        self.t += 1
        rate = np.float32(self.rate * (1 - 0.99**self.t) ** 0.5 / (1 - 0.9**self.t))
        for k, own in g.items():
            m, v = self.m[k], self.v[k]
            m *= np.float32(0.9)
            m += np.float32(0.1) * own
            own *= own
            own *= np.float32(0.01)
            v *= np.float32(0.99)
            v += own
            down = np.sqrt(v)
            down += np.float32(1e-6)
            np.divide(m, down, down)
            down *= rate
            p[k] -= down


def streams(docs: list[np.ndarray]) -> list[np.ndarray]:
    """Documents, end to end, cut into streams of one length, the longer first; so many that a pass has LEAST_STEPS windows where it can."""
    flat = np.concatenate(docs)
    n = min(max(len(flat) // (WINDOW * max(LEAST_STEPS, 1)), FEWEST), BATCH, len(flat))
    return np.array_split(flat, n)


def windows(docs: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Windows (streams x WINDOW, -1 for padding) that cover every token once; the rows of a window go on the first ones of the window before."""
    own = streams(docs)
    flat, size = np.concatenate(own), np.array([len(x) for x in own])
    start, along = np.cumsum(size) - size, np.arange(WINDOW)
    for t in range(0, int(size[0]), WINDOW):
        n = int(np.searchsorted(-size, -t, "left"))  # streams that go beyond t
        at = np.minimum(start[:n, None] + t + along, len(flat) - 1)
        yield np.where(t + along < size[:n, None], flat[at], -1).astype(np.int64)


def trained(p: dict, docs: list[np.ndarray], seed: int, rate: float = RATE) -> tuple[dict, int]:
    """Parameters after passes over whole documents (tokens, with their ends), and the updates made. One pass, or as many as LEAST_STEPS take."""
    p = {k: v.copy() for k, v in p.items()}
    rng, opt, steps = np.random.default_rng(seed), Adam(p, rate), 0
    total, count = None, 0

    def update() -> None:
        nonlocal total, count, steps
        for v in total.values():
            v /= np.float32(max(count, STEP))
        opt.update(p, total)
        total, count, steps = None, 0, steps + 1

    while docs:
        mixed, a = [docs[i] for i in rng.permutation(len(docs))], 0
        while a < len(mixed):
            b, n = a, 0
            while b < len(mixed) and n < DEALT:
                n, b = n + len(mixed[b]), b + 1
            h, before = None, None
            for tokens in windows(mixed[a:b]):
                rows = len(tokens)
                if h is None:
                    h, before = np.zeros((rows, HIDDEN), np.float32), np.full(rows, ends_of(p)[1])
                real = int((tokens >= 0).sum())
                g, h, _ = gradient(p, tokens, before[:rows], h[:rows])
                before = np.maximum(tokens[:, -1], 0)
                total = {k: v + total[k] for k, v in g.items()} if total else g
                count += real
                if count >= STEP:
                    update()
            a = b
        if count:
            update()
        if steps >= LEAST_STEPS:
            break
    return p, steps


def fit(rows: DataFrame, head: np.ndarray, start: dict[str, np.ndarray], rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """The average of what the tasks have learned from their training documents, of which each round takes its share, round after round: together they are one pass. rows: CHUNK; head: the head words' hashes."""
    names = sorted(start)
    sc = prepare(rows.sparkSession).sparkContext
    parts = rows.rdd.getNumPartitions()
    p = start
    for r in range(rounds):
        held = sc.broadcast(p)  # of one size, whatever the input

        def learn(batches: Iterator[pa.RecordBatch], r: int = r, held=held) -> Iterator[pa.RecordBatch]:
            own, ranks, i = [], Ranks(head), 0
            for b in batches:
                for _, away, size, words, ids in unchunked(b):
                    turn = (i + np.cumsum(~away) - 1) % rounds == r  # of the training texts one in so many
                    i += int((~away).sum())
                    turn &= ~away
                    if turn.any():
                        own += targets(words, ranks.of(words), ids[np.repeat(turn, size)], size[turn], start["bw"].size - TAILS)
            part = TaskContext.get().partitionId()
            if own:
                size = sum(map(len, own))
                q, steps = trained(held.value, own, part * rounds + r, RATE / (1 + r))
                flat = np.concatenate([q[k].ravel() for k in names]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([float(size)], pa.float64()), pa.array([(flat * np.float32(size)).tobytes()], pa.binary())], names=["part", "weight", "sum"])

        def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, weight, part = None, 0.0, 0
            for b in batches:
                for part, w, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    v = np.frombuffer(x.as_buffer(), np.float32)
                    total, weight = v.copy() if total is None else total + v, weight + w
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([weight], pa.float64()), pa.array([total.tobytes()], pa.binary())], names=["part", "weight", "sum"])

        sums = rows.mapInArrow(relieved(learn), "part long, weight double, sum binary")
        for n in (BEFORE, COMBINE) if parts > MANY else (COMBINE,):
            sums = sums.repartition(n, "part").mapInArrow(relieved(combine), "part long, weight double, sum binary")
        total, weight = 0.0, 0.0
        for row in sums.toLocalIterator():  # a row of fixed size from each of the last tasks
            total, weight = total + np.frombuffer(row["sum"], np.float32).astype(np.float64), weight + row["weight"]
        if not weight:
            break
        flat, p, at = (total / weight).astype(np.float32), {}, 0
        for k in names:
            p[k] = flat[at : at + start[k].size].reshape(start[k].shape)
            at += start[k].size
    return p


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("held_out", crc_bucket(F.col("doc_id"), 10) == 0)
    chunk = stored(chunked(docs))
    counts = cut(word_counts(chunk))
    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.filter(F.col("word") != int(END)).orderBy(F.desc("n"), "word").limit(KNOWN).toArrow()
    known, times = (top.column(c).to_numpy() for c in ("word", "n"))
    known, times = known.astype(np.int64).view(np.uint64), times.astype(np.float64)
    ends = float((counts.filter(F.col("word") == int(END)).first() or {"n": 0})["n"])
    head = head_size(v_all)
    # What the classes of endings have, less the words with entries of their own.
    ending = F.col("word").bitwiseAND(TAILS - 1)
    tail, v_tail = np.zeros(TAILS), np.zeros(TAILS)
    for row in counts.filter(F.col("word") != int(END)).groupBy(ending.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # TAILS rows
        tail[row["k"]], v_tail[row["k"]] = row["n"], row["v"]
    kinds = (known & np.uint64(TAILS - 1)).astype(np.int64)
    tail -= np.bincount(kinds[:head], times[:head], TAILS)
    v_tail -= np.bincount(kinds[:head], minlength=TAILS)
    p = fit(chunk, known[:head], initial(times[:head], tail, ends, head))
    held = spark.sparkContext.broadcast((p, known, times))
    base_all, tail_all = n_all + SMOOTH * (v_all + 1), tail + SMOOTH * (v_tail + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, known, times = held.value
        ranks = Ranks(known)
        base = np.log10((np.append(times, ends) + SMOOTH) / base_all)  # the last is the end's, and of words that are not known
        inner = np.append(np.log10((times + SMOOTH) / tail_all[(known & np.uint64(TAILS - 1)).astype(np.int64)]), 0.0)
        inner[:head] = 0
        part, row = TaskContext.get().partitionId() << 33, 0
        wait: list[tuple] = []

        def out() -> pa.RecordBatch:
            logp = log_likelihood(p, [d for w in wait for d in w[-1]]) / np.log(10)
            key, away, size, n_known, base_score, score, rare, n = ([x for w in wait for x in w[k]] for k in range(8))
            cols = [pa.array(c, t) for c, t in zip((range(part | row - len(key), part | row), size, n_known, base_score, logp + np.array(score), rare, n), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)]
            wait.clear()
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(away, pa.bool_()), *cols], names=["doc_id", "held_out", "key", "n_tokens", "n_known", "base_score", "score", "rare", "times"])

        held_ids = 0
        for b in batches:
            for keys, away, size, words, ids in unchunked(b):
                rank = ranks.of(words)
                n, doc = len(keys), np.repeat(np.arange(len(keys)), size)
                has = rank[ids] >= 0
                sums = [np.bincount(doc[has], x[rank][ids[has]], n) for x in (base, inner)]
                pairs, times_of = np.unique(doc[~has] * np.int64(len(words)) + ids[~has], return_counts=True)
                d, w = np.divmod(pairs, max(len(words), 1))
                at = np.searchsorted(d, np.arange(n + 1))
                rare, often = words[w].view(np.int64), times_of
                lists = [[x[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)] for x in (rare, often)]
                wait.append((keys, away.tolist(), (size + 1).tolist(), (np.bincount(doc[has], minlength=n) + (ends > 0)).tolist(), (sums[0] + base[-1]).tolist(), sums[1].tolist(), *lists, targets(words, rank, ids, size, head)))
                row += n
                held_ids += len(ids)
                if held_ids > 3_000_000:  # the longest documents of many go side by side
                    yield out()
                    held_ids = 0
        if wait:
            yield out()

    rows = cut(chunk.mapInArrow(relieved(run), "doc_id long, held_out boolean, key long, n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<long>"))
    discard(spark, chunk)
    rare = rows.select("key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("key", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    more = found.groupBy("key").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.col("n") + SMOOTH) / F.lit(float(base_all)))).alias("more_base"),
        F.sum(F.col("times") * F.log10((F.col("n") + SMOOTH) / F.element_at(F.array(*map(F.lit, tail_all.tolist())), (ending + 1).cast("int")))).alias("more_score"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return rows.drop("rare", "times").join(more, "key", "left").select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "more_known").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), plus("base_score", "more_base").alias("base_score"), plus("score", "more_score").alias("score")
    )
