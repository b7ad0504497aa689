"""Media columns: progressive JPEG written to and read from binary columns, with features of the pixels.

The encoder stores a payload without loss in the format's own unit, quantised DCT coefficients: a byte becomes a
coefficient of magnitude 2 to 129, quantisation tables hold ones, and progressive scans (DC and two spectral bands at a
point transform of 1, then their refinements) hold the coefficients of a luma and two subsampled chroma planes.

The decoder is general for progressive JPEG of one to four components: it accumulates the scans into coefficient arrays,
transforms these back in numpy, upsamples chroma and gives a full-resolution RGB tensor. Where a scan's code table gives
every coefficient the same number of bits, as this encoder's tables do, the scan is read as one array; else bit by bit.

Results in special cases: null text counts as empty, whose payload is 192 spaces; equal texts give equal media; null
media gives null results; a stream that breaks off gives what came before it, as zeros elsewhere.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import prepare

#: Payloads are padded to a multiple of this with spaces: three blocks of 64 units.
UNIT = 192
#: Minimum coded units (16 x 16 pixels) in a row of the picture.
ACROSS = 64


def _zigzag() -> np.ndarray:
    """Row * 8 + column of the coefficients in the order of the stream."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()


@functools.cache
def _inverse() -> np.ndarray:
    """A matrix that takes 64 dequantised coefficients in stream order to 64 samples in rows."""
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 1 / 2)  # [pixel, frequency]
    both = np.einsum("yu,xv->uvyx", basis, basis).reshape(64, 64)
    return both[ZIGZAG].astype(np.float32)


class Codes:
    """A Huffman table from the numbers of codes of each length and the symbols in order."""

    def __init__(self, counts: list[int], symbols: list[int]):
        self.counts, self.symbols = counts, symbols
        self.lookup: dict[tuple[int, int], int] = {}
        self.of: dict[int, tuple[int, int]] = {}
        code, i = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.lookup[length, code] = symbols[i]
                self.of[symbols[i]] = (length, code)
                code, i = code + 1, i + 1
            code <<= 1

    @classmethod
    def by_length(cls, lengths: dict[int, int]) -> Codes:
        counts = [0] * 16
        for n in lengths.values():
            counts[n - 1] += 1
        return cls(counts, sorted(lengths, key=lambda s: lengths[s]))

    def segment(self, kind: int, slot: int) -> bytes:
        body = bytes([kind << 4 | slot, *self.counts, *self.symbols])
        return b"\xff\xc4" + (len(body) + 2).to_bytes(2, "big") + body

    @functools.cached_property
    def width(self) -> int:
        """Bits of every symbol with its value, if these are the same for all symbols and no symbol skips coefficients; else 0."""
        sizes = {n + s for s, (n, _) in self.of.items()}
        return sizes.pop() if len(sizes) == 1 and max(sizes, default=99) <= 12 and all(s < 16 for s in self.of) else 0

    @functools.cached_property
    def values(self) -> np.ndarray:
        """The value behind each pattern of `width` bits; a pattern that is no code has 1 << 20."""
        out = np.full(1 << self.width, 1 << 20, np.int32)
        for s, (_, code) in self.of.items():
            v = np.arange(1 << s)
            out[(code << s) + v] = np.where(v >> (s - 1), v, v - (1 << s) + 1) if s else 0
        return out


#: Sizes 1 to 7 and 0 to 8 in 8 and 9 bits with their values; runs of block ends in 4 bits and their lengths.
AC, DC, ENDS = Codes.by_length({s: 8 - s for s in range(1, 8)}), Codes.by_length({s: 9 - s for s in range(9)}), Codes.by_length({n << 4: 4 for n in range(15)})
BANDS = ((1, 5), (6, 63))


def _patterns(codes: Codes, least: int, most: int) -> np.ndarray:
    """The bits of each value from least to most."""
    back = {int(v): i for i, v in reversed(list(enumerate(codes.values))) if v < 1 << 20}
    return np.array([back[v] for v in range(least, most + 1)], np.uint16)


_to_coef = np.array([b - 129 if b < 128 else b - 126 for b in range(256)], np.int16)
_half = np.where(_to_coef > 0, _to_coef >> 1, -(-_to_coef >> 1)).astype(np.int16)
_ac_bits = np.array([0 if v == 0 else p for v, p in zip(range(-64, 65), [*_patterns(AC, -64, -1), 0, *_patterns(AC, 1, 64)], strict=True)], np.uint8)[_half + 64]
_ac_low = (np.abs(_to_coef) & 1).astype(np.uint8)
_dc_bits = _patterns(DC, -255, 255)


def _stuff(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00")


def _pack(bits: np.ndarray) -> bytes:
    """Bits as bytes, filled with ones."""
    fill = -len(bits) % 8
    return _stuff(np.packbits(np.concatenate([bits, np.ones(fill, np.uint8)])).tobytes())


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _shape(units: int) -> tuple[int, int]:
    """Minimum coded units across and down for at least `units`."""
    across = min(units, max(ACROSS, -(-units // 4095)))
    return across, -(-units // across)


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload; len(payload) must be a positive multiple of UNIT."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"a payload has a positive multiple of {UNIT} bytes")
    across, down = _shape(-(-len(payload) // 384))
    n = across * down
    data = np.full(n * 384, 32, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = data.reshape(-1, 64)
    planes = [blocks[: 4 * n], blocks[4 * n : 5 * n], blocks[5 * n :]]
    out = [
        b"\xff\xd8", _segment(0xFE, b"%d" % len(payload)), _segment(0xDB, bytes([0, *[1] * 64])),
        _segment(0xC2, bytes([8]) + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        DC.segment(0, 0), AC.segment(1, 0), ENDS.segment(1, 1),
    ]

    def scan(c: int, first: int, last: int, high: int, low: int, slot: int, data: bytes) -> None:
        out.extend((_segment(0xDA, bytes([1, c + 1, slot, first, last, high << 4 | low])), data))

    for c, plane in enumerate(planes):
        dc = _to_coef[plane[:, 0]] >> 1
        bits = _dc_bits[np.diff(dc, prepend=np.int16(0)) + 255]
        scan(c, 0, 0, 0, 1, 0, _pack(((bits[:, None] >> np.arange(8, -1, -1)) & 1).astype(np.uint8).ravel()))
    for first, last in BANDS:
        for c, plane in enumerate(planes):
            scan(c, first, last, 0, 1, 0, _stuff(_ac_bits[plane[:, first : last + 1]].tobytes()))
    for c, plane in enumerate(planes):
        scan(c, 0, 0, 1, 0, 0, _pack((_to_coef[plane[:, 0]] & 1).astype(np.uint8)))
        low = _ac_low[plane[:, 1:]]
        parts = []
        for a in range(0, len(plane), 32767):
            k = min(32767, len(plane) - a)
            r = k.bit_length() - 1
            size, code = ENDS.of[r << 4]
            head = code << r | (k - (1 << r))
            parts += [(head >> np.arange(size + r - 1, -1, -1) & 1).astype(np.uint8), low[a : a + k].ravel()]
        scan(c, 1, 63, 1, 0, 1, _pack(np.concatenate(parts)))
    return b"".join([*out, b"\xff\xd9"])


class _Bits:
    """Bits of entropy-coded data without its stuffing; zeros follow its end."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n].tolist():
            v = v << 1 | b
        v <<= max(0, self.at + n - len(self.bits)) if self.at < len(self.bits) else n
        self.at += n
        return v

    def symbol(self, codes: Codes) -> int:
        v = 0
        for n in range(1, 17):
            v = v << 1 | (int(self.bits[self.at]) if self.at < len(self.bits) else 0)
            self.at += 1
            if (n, v) in codes.lookup:
                return codes.lookup[n, v]
        raise ValueError("no such code")

    def value(self, s: int) -> int:
        v = self.take(s) if s else 0
        return v if not s or v >> (s - 1) else v - (1 << s) + 1

    @property
    def over(self) -> bool:
        return self.at > len(self.bits) + 64


class Picture:
    """Coefficient arrays of a progressive JPEG, component by component, in stream order."""

    def __init__(self, data: bytes, fast: bool = True):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        self.fast, self.comment = fast, b""
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[tuple[int, int], Codes] = {}
        self.parts: list[dict] = []
        restart, at = 0, 2
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            marker = data[at + 1]
            if marker == 0xD9:
                break
            if marker in (0xFF, 0x00, 0x01) or 0xD0 <= marker <= 0xD8:
                at += 1 if marker == 0xFF else 2
                continue
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                self._quant(body)
            elif marker == 0xC4:
                self._codes(body)
            elif marker == 0xDD:
                restart = int.from_bytes(body[:2], "big")
            elif marker == 0xC2:
                self._frame(body)
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not progressive")
            elif marker == 0xDA:
                end = at
                while True:
                    end = data.find(b"\xff", end)
                    if end < 0 or end + 1 >= len(data):
                        end = len(data)
                        break
                    if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                        end += 2
                        continue
                    break
                self._scan(body, data[at:end], restart)
                at = end

    def _quant(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            n = 128 if wide else 64
            self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
            body = body[1 + n :]

    def _codes(self, body: bytes) -> None:
        while body:
            n = sum(body[1:17])
            own = bytes(body[: 17 + n])
            self.codes[body[0] >> 4, body[0] & 15] = _codes_of(own[1:])
            body = body[17 + n :]

    def _frame(self, body: bytes) -> None:
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        for i in range(body[5]):
            key, hv, q = body[6 + 3 * i : 9 + 3 * i]
            self.parts.append({"key": key, "h": hv >> 4, "v": hv & 15, "q": q})
        self.h, self.v = max(p["h"] for p in self.parts), max(p["v"] for p in self.parts)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for p in self.parts:
            p["cols"], p["rows"] = self.across * p["h"], self.down * p["v"]  # stored
            p["own_cols"], p["own_rows"] = -(-(-(-self.width * p["h"] // self.h)) // 8), -(-(-(-self.height * p["v"] // self.v)) // 8)
            p["coef"] = np.zeros((p["rows"] * p["cols"], 64), np.int16)

    def _order(self, parts: list[dict]) -> tuple[np.ndarray, np.ndarray, int]:
        """Which component and block each step of a scan is about, and the steps in a restart unit."""
        if len(parts) == 1:
            p = parts[0]
            at = (np.arange(p["own_rows"])[:, None] * p["cols"] + np.arange(p["own_cols"])[None, :]).ravel()
            return np.zeros(len(at), np.int64), at, 1
        which, where = [], []
        y, x = np.divmod(np.arange(self.across * self.down), self.across)
        for i, p in enumerate(parts):
            for dy in range(p["v"]):
                for dx in range(p["h"]):
                    which.append(np.full(len(y), i))
                    where.append((y * p["v"] + dy) * p["cols"] + x * p["h"] + dx)
        return np.stack(which, 1).ravel(), np.stack(where, 1).ravel(), len(which)

    def _scan(self, body: bytes, data: bytes, restart: int) -> None:
        n = body[0]
        parts, dc, ac = [], [], []
        for i in range(n):
            parts.append(next(p for p in self.parts if p["key"] == body[1 + 2 * i]))
            dc.append(self.codes.get((0, body[2 + 2 * i] >> 4)))
            ac.append(self.codes.get((1, body[2 + 2 * i] & 15)))
        first, last, hl = body[1 + 2 * n : 4 + 2 * n]
        high, low = hl >> 4, hl & 15
        which, where, unit = self._order(parts)
        if self.fast and not restart and n == 1 and self._whole(parts[0]["coef"], where, dc[0], ac[0], first, last, high, low, data.replace(b"\xff\x00", b"\xff")):
            return
        pieces, step = [data], len(where)
        if restart:
            step, pieces, a = restart * unit, [], 0
            for i in range(len(data) - 1):
                if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
                    pieces.append(data[a:i])
                    a = i + 2
            pieces.append(data[a:])
        for k, piece in enumerate(pieces):
            bits = _Bits(piece.replace(b"\xff\x00", b"\xff"))
            try:
                self._steps(bits, parts, dc, ac, which[k * step : (k + 1) * step], where[k * step : (k + 1) * step], first, last, high, low)
            except ValueError:
                continue  # the rest of the piece stays as it is

    def _steps(self, bits: _Bits, parts, dc, ac, which, where, first: int, last: int, high: int, low: int) -> None:
        before, ends = [0] * len(parts), 0
        for i, b in zip(which.tolist(), where.tolist(), strict=True):
            if bits.over:
                return
            row = parts[i]["coef"][b]
            if not first:
                if high:
                    row[0] |= bits.take(1) << low
                else:
                    before[i] += bits.value(bits.symbol(dc[i]))
                    row[0] = before[i] << low
            elif not high:
                if ends:
                    ends -= 1
                    continue
                k = first
                while k <= last:
                    run, size = divmod(bits.symbol(ac[i]), 16)
                    if size:
                        k += run
                        if k > 63:
                            raise ValueError("beyond the block")
                        row[k] = bits.value(size) * (1 << low)
                    elif run < 15:
                        ends = (1 << run) - 1 + (bits.take(run) if run else 0)
                        break
                    else:
                        k += 15
                    k += 1
            else:
                ends = self._refine(bits, row, ac[i], first, last, low, ends)

    @staticmethod
    def _refine(bits: _Bits, row: np.ndarray, codes: Codes, first: int, last: int, low: int, ends: int) -> int:
        one = 1 << low

        def correct(k: int) -> None:
            if bits.take(1) and not abs(int(row[k])) & one:
                row[k] += one if row[k] > 0 else -one

        k = first
        while not ends and k <= last:
            run, size = divmod(bits.symbol(codes), 16)
            new = 0
            if size:
                new = one if bits.take(1) else -one
            elif run < 15:
                ends = (1 << run) + (bits.take(run) if run else 0)
                break
            while k <= last:
                if row[k]:
                    correct(k)
                elif not run:
                    break
                else:
                    run -= 1
                k += 1
            if new and k <= last:
                row[k] = new
            k += 1
        if ends:
            for x in range(k, last + 1):
                if row[x]:
                    correct(x)
            ends -= 1
        return ends

    @staticmethod
    def _whole(coef: np.ndarray, where: np.ndarray, dc: Codes | None, ac: Codes | None, first: int, last: int, high: int, low: int, data: bytes) -> bool:
        """Reads a scan as one array, if its codes are of one width; else leaves it alone."""
        n, span = len(where), last - first + 1
        raw = np.frombuffer(data, np.uint8)
        if high and not first:
            if 8 * len(raw) < n:
                return False
            coef[where, 0] |= (np.unpackbits(raw, count=n).astype(np.int16)) << low
            return True
        if not high:
            codes = ac if first else dc
            width = codes.width if codes else 0
            if not width or first and 0 in codes.of or 8 * len(raw) < n * span * width:
                return False
            if width == 8:
                code = raw[: n * span]
            else:
                code = np.unpackbits(raw, count=n * span * width).reshape(-1, width) @ (1 << np.arange(width - 1, -1, -1)).astype(np.int32)
            v = codes.values[code]
            if v.size and v.max() >= 1 << 20:
                return False
            if first:
                coef[where, first : last + 1] = (v << low).reshape(n, span)
            else:
                coef[where, 0] = np.cumsum(v) << low
            return True
        band = coef[where, first : last + 1]
        if (band == 0).any():
            return False
        bits, got, at = _Bits(data), [], 0
        while at < n:
            run, size = divmod(bits.symbol(ac), 16)
            if size or run > 14:
                return False
            k = (1 << run) + (bits.take(run) if run else 0)
            if at + k > n or bits.at + k * span > len(bits.bits):
                return False
            got.append(bits.bits[bits.at : bits.at + k * span])
            bits.at, at = bits.at + k * span, at + k
        bit = np.concatenate(got).reshape(n, span).astype(np.int16) << low
        bit[(np.abs(band) & (1 << low)) != 0] = 0
        coef[where, first : last + 1] = band + np.where(band > 0, bit, -bit)
        return True

    def planes(self) -> list[np.ndarray]:
        """Samples of each component at full resolution."""
        out = []
        for p in self.parts:
            rows, cols = p["rows"], p["cols"]
            x = (p["coef"].astype(np.float32) * self.quant[p["q"]]) @ _inverse()
            x = np.clip(np.rint(x + 128), 0, 255).reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
            fy, fx = self.v // p["v"], self.h // p["h"]
            if fy > 1:
                x = np.repeat(x, fy, 0)
            if fx > 1:
                x = np.repeat(x, fx, 1)
            out.append(x[: self.height, : self.width])
        return out

    def rgb(self) -> np.ndarray:
        """A tensor of height x width x 3 bytes."""
        p = self.planes()
        if len(p) < 3:
            return np.repeat(p[0][:, :, None], 3, 2).astype(np.uint8)
        y, cb, cr = p[0], p[1] - 128, p[2] - 128
        out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
        return np.clip(np.rint(out), 0, 255).astype(np.uint8)

    def payload(self) -> bytes:
        """What encode_payload stored."""
        data = np.concatenate([p["coef"] for p in self.parts]).ravel()
        return np.where(data < 0, data + 129, data + 126).astype(np.uint8).tobytes()[: int(self.comment)]


@functools.lru_cache(maxsize=64)
def _codes_of(body: bytes) -> Codes:
    return Codes(list(body[:16]), list(body[16:]))


def feature(rgb: np.ndarray) -> str:
    """Size, mean and spread of the channels and the share of strong edges, as whole thousandths."""
    x = rgb.reshape(-1, 3).astype(np.float64)
    grey = rgb.mean(axis=2)
    edges = (np.abs(np.diff(grey, axis=1)) > 64).mean() if rgb.shape[1] > 1 else 0.0
    return f"{rgb.shape[1]}x{rgb.shape[0]};mean={','.join(f'{v:.2f}' for v in x.mean(axis=0))};std={','.join(f'{v:.2f}' for v in x.std(axis=0))};edges={edges:.3f}"


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def store(df: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    """df with the JPEG that stores its column `text` in column `into`, which is replaced."""
    prepare(df.sparkSession)
    df = df.drop(into) if into != text else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(0, b.num_rows, 500):
                part = b.slice(x, 500)
                media = [encode_payload(padded(t)) for t in part.column(b.schema.get_field_index(text)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(media, pa.binary())], names=[*b.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.BinaryType())]))


def load(df: DataFrame, media: str = "media", tensors: bool = True) -> DataFrame:
    """df with payload, height, width, tensor (bytes of height x width x 3; null if not tensors) and feature, read from its column of JPEGs."""
    prepare(df.sparkSession)
    names = ("payload", "height", "width", "tensor", "feature")
    kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string())
    df = df.drop(*(c for c in names if c != media))

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 5
        p = Picture(data)
        rgb = p.rgb()
        return p.payload() if p.comment.isdigit() else None, p.height, p.width, rgb.tobytes() if tensors else None, feature(rgb)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(0, b.num_rows, 200):
                part = b.slice(x, 200)
                got = [one(v) for v in part.column(b.schema.get_field_index(media)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True))], names=[*b.schema.names, *names])

    fields = [T.StructField(n, t) for n, t in zip(names, (T.BinaryType(), T.IntegerType(), T.IntegerType(), T.BinaryType(), T.StringType()), strict=True)]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def stored_texts(docs: DataFrame) -> DataFrame:
    """The digests of every document's payload and stored form, read back, with the feature of its picture."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    media = store(rows).withColumn("n_bytes", F.octet_length("text").cast("long")).drop("text")
    out = load(media, tensors=False)
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
