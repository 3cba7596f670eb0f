"""Progressive JPEG: scans accumulate in coefficient arrays, numpy inverts the transform, chroma is upsampled to RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.common import stored, through_python

BLOCK = 64


@cache
def zigzag() -> np.ndarray:
    """Place in the 8 x 8 block of the k-th coefficient: along the antidiagonals, up and down by turns."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


@cache
def basis() -> np.ndarray:
    """Row k: the 64 samples of the k-th coefficient (zigzag order) of size 1."""
    x = np.arange(8)
    one = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x[:, None] == 0, np.sqrt(0.5), 1) / 2
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[zigzag()].astype(np.float32)


# ---- writing a payload ------------------------------------------------------------------------------------------------


def _marker(code: int, body: bytes = b"") -> bytes:
    return bytes([0xFF, code]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, slot: int, length: int, symbols: list[int]) -> bytes:
    """A Huffman table whose codes all have one length."""
    counts = bytes(len(symbols) if i == length else 0 for i in range(1, 17))
    return _marker(0xC4, bytes([kind << 4 | slot]) + counts + bytes(symbols))


def _scan(component: int, first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    return _marker(0xDA, bytes([1, component, 0, first, last, high << 4 | low])) + data


def _stuffed(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)]) if pad else bits).tobytes().replace(b"\xff", b"\xff\x00")


#: Longest run of blocks that one end-of-band symbol covers.
_RUN = 32_767


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG (4:2:0, 3 components) whose quantised coefficients are the bytes of the payload, 64 to a block.

    Each of the blocks, luma first, holds 64 bytes in zigzag order: byte b is 512 + b as the first coefficient and b (if
    128 or more) or b - 255 as another. All these have one bit length after the point transform, so that each Huffman table
    of a first scan has one symbol and a reader can take its fields in one go. Per component: first coefficient without its
    lowest bit (a restart after each block), its lowest bit, coefficients 1-5 and 6-63 without theirs, and their lowest bits.
    """
    assert payload and len(payload) % BLOCK == 0
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    mcus = -(-len(blocks) // 6)
    wide = int(np.ceil(np.sqrt(mcus)))
    high = -(-mcus // wide)
    grid = np.zeros((6 * wide * high, BLOCK), np.uint8)
    grid[: len(blocks)] = blocks
    n = wide * high
    parts = [grid[: 4 * n], grid[4 * n : 5 * n], grid[5 * n :]]
    out = [b"\xff\xd8", _marker(0xDB, bytes([0]) + bytes([1] * 64))]
    out.append(_marker(0xC2, bytes([8]) + (16 * high).to_bytes(2, "big") + (16 * wide).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out += [_table(0, 0, 7, [9]), _table(1, 0, 1, [7])]
    single, none = _marker(0xDD, b"\x00\x01"), _marker(0xDD, b"\x00\x00")
    later = []
    for c, p in enumerate(parts, 1):
        m = len(p)
        dc = np.empty((m, 4), np.uint8)  # 7 bits of code and 9 of 256 + b / 2; then the restart marker
        dc[:, 0], dc[:, 1], dc[:, 2], dc[:, 3] = 1, p[:, 0] >> 1, 0xFF, 0xD0 + (np.arange(m) & 7)
        out += [single, _scan(c, 0, 0, 0, 1, dc.tobytes()[:-2]), none, _scan(c, 0, 0, 1, 0, _stuffed(p[:, 0] & 1))]
        half = p >> 1  # a code bit 0 and 7 bits
        out += [_scan(c, 1, 5, 0, 1, half[:, 1:6].tobytes()), _scan(c, 6, 63, 0, 1, half[:, 6:].tobytes())]
        lowest = (p[:, 1:] & 1) ^ (p[:, 1:] < 128)
        bits = []
        for a in range(0, m, _RUN):
            run = min(_RUN, m - a)
            k = run.bit_length() - 1
            lead = (k << k | run - (1 << k)) if k else 0  # 4 bits of code, k bits of length
            bits += [np.array([lead >> i & 1 for i in range(3 + k, -1, -1)], np.uint8), lowest[a : a + run].ravel()]
        later.append(_scan(c, 1, 63, 1, 0, _stuffed(np.concatenate(bits))))
    out += [_table(1, 0, 4, [k << 4 for k in range(15)]), *later, b"\xff\xd9"]
    return b"".join(out)


def payload_of(coefficients: list[np.ndarray], length: int) -> bytes:
    """The bytes that encode_payload() put into the coefficients."""
    q = np.concatenate(coefficients)[: length // BLOCK]
    b = np.where(q < 0, q + 255, q)
    b[:, 0] = q[:, 0] - 512
    return b.astype(np.uint8).tobytes()


# ---- reading any progressive JPEG ---------------------------------------------------------------------------------------


class _Bits:
    """Bits of one restart interval; past its end come ones."""

    def __init__(self, data: bytes):
        self.data, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | (int(self.data[self.at]) if self.at < len(self.data) else 1)
            self.at += 1
        return v

    def many(self, n: int) -> np.ndarray:
        got = self.data[self.at : self.at + n]
        self.at += n
        return got if len(got) == n else np.concatenate([got, np.ones(n - len(got), np.uint8)])


class _Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.codes, self.symbols, code, k = {}, symbols, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.width = next(iter(self.codes))[0] if self.codes else 0

    def read(self, bits: _Bits) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | bits.take(1)
            if (length, code) in self.codes:
                return self.codes[length, code]
        raise ValueError("no such Huffman code")


def _extend(v: int, size: int) -> int:
    return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1


class Decoder:
    """Coefficient arrays (one row of 64 in zigzag order for each block, in raster order) of a progressive JPEG."""

    def __init__(self, data: bytes):
        self.quant, self.huff, self.parts, self.interval = {}, {}, [], 0
        self._read(data)

    def _read(self, d: bytes) -> None:
        if d[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        at = 2
        while at < len(d):
            if d[at] != 0xFF:
                raise ValueError("a marker was expected")
            code = d[at + 1]
            if code == 0xFF:
                at += 1
                continue
            if code == 0xD9:
                return
            size = int.from_bytes(d[at + 2 : at + 4], "big")
            body, at = d[at + 4 : at + 2 + size], at + 2 + size
            if code == 0xDB:
                self._tables(body)
            elif code == 0xC4:
                self._codes(body)
            elif code == 0xDD:
                self.interval = int.from_bytes(body, "big")
            elif code == 0xC2:
                self._frame(body)
            elif code == 0xDA:
                end = self._end(d, at)
                self._decode(body, d[at:end])
                at = end
            elif 0xC0 <= code <= 0xCF and code != 0xCC:
                raise ValueError("not a progressive JPEG")

    @staticmethod
    def _end(d: bytes, at: int) -> int:
        """Where the next marker but restarts stands."""
        while (at := d.find(b"\xff", at)) >= 0:
            if d[at + 1 : at + 2] != b"\x00" and not 0xD0 <= d[at + 1] <= 0xD7:
                return at
            at += 2
        return len(d)

    def _tables(self, b: bytes) -> None:
        while b:
            wide, slot = b[0] >> 4, b[0] & 15
            n = 128 if wide else 64
            self.quant[slot] = np.frombuffer(b[1 : 1 + n], ">u2" if wide else "u1").astype(np.float32)
            b = b[1 + n :]

    def _codes(self, b: bytes) -> None:
        while b:
            n = sum(b[1:17])
            self.huff[b[0] >> 4, b[0] & 15] = _Huffman(b[1:17], b[17 : 17 + n])
            b = b[17 + n :]

    def _frame(self, b: bytes) -> None:
        self.height, self.width = int.from_bytes(b[1:3], "big"), int.from_bytes(b[3:5], "big")
        spec = [(b[6 + 3 * i], b[7 + 3 * i] >> 4, b[7 + 3 * i] & 15, b[8 + 3 * i]) for i in range(b[5])]
        self.hmax, self.vmax = max(s[1] for s in spec), max(s[2] for s in spec)
        self.mx, self.my = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for ident, h, v, q in spec:
            own = (-(-(-(-self.width * h // self.hmax)) // 8), -(-(-(-self.height * v // self.vmax)) // 8))
            self.parts.append({"id": ident, "h": h, "v": v, "q": q, "wide": self.mx * h, "high": self.my * v, "own": own, "c": np.zeros((self.mx * h * self.my * v, 64), np.int32)})

    def _order(self, chosen: list[dict]) -> list[list[tuple[dict, int]]]:
        """The units of a scan in order, each a list of (component, block)."""
        if len(chosen) == 1:
            p = chosen[0]
            return [[(p, y * p["wide"] + x)] for y in range(p["own"][1]) for x in range(p["own"][0])]
        return [[(p, (my * p["v"] + y) * p["wide"] + mx * p["h"] + x) for p in chosen for y in range(p["v"]) for x in range(p["h"])] for my in range(self.my) for mx in range(self.mx)]

    def _decode(self, head: bytes, data: bytes) -> None:
        n = head[0]
        chosen = [next(p for p in self.parts if p["id"] == head[1 + 2 * i]) for i in range(n)]
        slots = [head[2 + 2 * i] for i in range(n)]
        first, last, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        p = chosen[0]
        full = n == 1 and p["own"] == (p["wide"], p["high"])
        if full and self._at_once(p, slots[0], first, last, high, low, data):
            return
        pieces, at = [], 0
        for k in range(len(data) - 1):  # restart markers
            if data[k] == 0xFF and 0xD0 <= data[k + 1] <= 0xD7:
                pieces.append(data[at:k])
                at = k + 2
        pieces.append(data[at:])
        units = self._order(chosen)
        step = self.interval or len(units)
        for i, piece in enumerate(pieces):
            bits = _Bits(piece.replace(b"\xff\x00", b"\xff"))
            some = units[i * step : (i + 1) * step]
            if first == 0:
                self._first_coefficients(bits, some, dict(zip((q["id"] for q in chosen), slots, strict=True)), high, low)
            elif high == 0:
                self._band(bits, [b for u in some for _, b in u], p, self.huff[1, slots[0] & 15], first, last, low)
            else:
                self._refined_band(bits, np.array([b for u in some for _, b in u]), p, self.huff[1, slots[0] & 15], first, last, low)

    def _at_once(self, p: dict, slot: int, first: int, last: int, high: int, low: int, data: bytes) -> bool:
        """Scans whose fields all have one width: those of lowest bits, and those whose Huffman table has one symbol."""
        c, m = p["c"], len(p["c"])
        if first == 0 and high:
            if self.interval:
                return False
            bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
            c[:, 0] |= bits[:m].astype(np.int32) << low
            return True
        if high:
            return False
        table = self.huff[(0, slot >> 4) if first == 0 else (1, slot & 15)]
        if len(table.symbols) != 1:
            return False
        size, width = table.symbols[0], table.width + table.symbols[0]
        if first == 0:
            each = -(-width // 8) + 2
            if self.interval != 1 or size == 0 or len(data) != m * each - 2:
                return False
            rows = np.frombuffer(data + b"\xff\xd0", np.uint8).reshape(m, each)
            if not ((rows[:, -2] == 0xFF) & (rows[:, -1] >> 3 == 0xD0 >> 3)).all() or (rows[:, :-2] == 0xFF).any():
                return False
            fields = np.unpackbits(rows[:, :-2], axis=1)[:, table.width : width]
            count = m
        else:
            if self.interval or size == 0 or size > 15:
                return False
            raw, count = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8), m * (last - first + 1)
            if width == 8:
                v = (raw[:count] & ((1 << size) - 1)).astype(np.int32)
                c[:, first : last + 1] = np.where(v >> (size - 1), v, v - (1 << size) + 1).reshape(m, -1) * (1 << low)
                return True
            fields = np.unpackbits(raw)[: count * width].reshape(count, width)[:, table.width :]
        v = fields.astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
        v = np.where(v >> (size - 1), v, v - (1 << size) + 1) * (1 << low)
        if first == 0:
            c[:, 0] = v
        else:
            c[:, first : last + 1] = v.reshape(m, -1)
        return True

    def _first_coefficients(self, bits: _Bits, units: list, slots: dict, high: int, low: int) -> None:
        before = dict.fromkeys(slots, 0)
        for unit in units:
            for p, b in unit:
                if high:
                    p["c"][b, 0] |= bits.take(1) << low
                else:
                    size = self.huff[0, slots[p["id"]] >> 4].read(bits)
                    before[p["id"]] += _extend(bits.take(size), size)
                    p["c"][b, 0] = before[p["id"]] * (1 << low)

    @staticmethod
    def _band(bits: _Bits, blocks: list[int], p: dict, table: _Huffman, first: int, last: int, low: int) -> None:
        skip = 0
        for b in blocks:
            if skip:
                skip -= 1
                continue
            k = first
            while k <= last:
                run, size = divmod(table.read(bits), 16)
                if size:
                    k += run
                    p["c"][b, k] = _extend(bits.take(size), size) * (1 << low)
                    k += 1
                elif run == 15:
                    k += 16
                else:
                    skip = (1 << run) + bits.take(run) - 1
                    break

    @staticmethod
    def _refined_band(bits: _Bits, blocks: np.ndarray, p: dict, table: _Huffman, first: int, last: int, low: int) -> None:
        c, i, unit = p["c"], 0, 1 << low

        def correct(rows: np.ndarray, a: int) -> None:
            """The next bits go to the coefficients from a on that are not zero."""
            band = c[rows, a : last + 1]
            there = band != 0
            got = np.zeros(band.shape, np.int32)
            got[there] = bits.many(int(there.sum()))
            c[rows, a : last + 1] = band + np.sign(band) * got * unit

        while i < len(blocks):
            b, k = blocks[i], first
            while k <= last:
                run, size = divmod(table.read(bits), 16)
                if size == 0 and run < 15:
                    n = (1 << run) + bits.take(run)
                    correct(blocks[i : i + 1], k)
                    if n > 1:
                        correct(blocks[i + 1 : i + n], first)
                    i += n - 1
                    break
                value = (unit if bits.take(1) else -unit) if size else 0
                while k <= last:
                    if c[b, k]:
                        if bits.take(1):
                            c[b, k] += unit if c[b, k] > 0 else -unit
                    elif run == 0:
                        break
                    else:
                        run -= 1
                    k += 1
                if value and k <= last:
                    c[b, k] = value
                k += 1
            i += 1

    def rgb(self) -> np.ndarray:
        """Samples by the inverse transform, chroma repeated up to full resolution, as (height, width, 3) bytes."""
        planes = []
        for p in self.parts:
            s = (p["c"].astype(np.float32) * self.quant[p["q"]]) @ basis()
            np.clip(np.rint(s, out=s) + 128, 0, 255, out=s)
            plane = s.reshape(p["high"], p["wide"], 8, 8).transpose(0, 2, 1, 3).reshape(8 * p["high"], 8 * p["wide"])
            for axis, times in ((0, self.vmax // p["v"]), (1, self.hmax // p["h"])):
                plane = np.repeat(plane, times, axis) if times > 1 else plane
            planes.append(plane[: self.height, : self.width])
        y = planes[0]
        if len(planes) == 1:
            return np.repeat(y[..., None], 3, 2).astype(np.uint8)
        cb, cr = planes[1] - 128, planes[2] - 128
        out = np.empty((*y.shape, 3), np.uint8)
        for i, v in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
            out[..., i] = np.clip(np.rint(v), 0, 255)
        return out


def feature(rgb: np.ndarray) -> str:
    """Size, mean and deviation of each channel, and a checksum of the tensor."""
    flat = rgb.reshape(-1, 3)
    n = len(flat)
    mean = flat.sum(0, dtype=np.int64) / n
    dev = np.sqrt(np.maximum(np.einsum("ij,ij->j", flat, flat, dtype=np.int64) / n - mean**2, 0))
    values = " ".join(f"{m:.3f}/{d:.3f}" for m, d in zip(mean, dev, strict=True))
    return f"{rgb.shape[0]}x{rgb.shape[1]} {values} {zlib.crc32(flat.tobytes()):08x}"


# ---- Spark ------------------------------------------------------------------------------------------------------------


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, media: each text's UTF-8 bytes, with zeros up to a positive multiple of 64, as a JPEG.

    Written to the shared folder and read back. Null text is empty and has one block of zeros; a null id is kept; repeated
    rows stay; other columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), 500):
                g = f.iloc[a : a + 500]
                raw = [t.encode("utf-8", "surrogatepass") for t in g["text"]]
                full = [r + bytes(-len(r) % BLOCK or (BLOCK if not r else 0)) for r in raw]
                yield pd.DataFrame({"doc_id": g["doc_id"], "n_bytes": [len(r) for r in raw], "payload_bytes": [len(r) for r in full], "media": [encode_payload(r) for r in full]})

    return stored(through_python(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, "doc_id", "n_bytes long, payload_bytes long, media binary"))


def decode_media(media: DataFrame, column: str = "media") -> DataFrame:
    """Adds height, width and rgb (bytes in row order, three a pixel) to a table with a column of progressive JPEGs.

    Null, or bytes that are no progressive JPEG, give nulls.
    """
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), 100):
                g, rows = f.iloc[a : a + 100], []
                for b in g[column]:
                    try:
                        t = Decoder(b).rgb()
                        rows.append((t.shape[0], t.shape[1], t.tobytes()))
                    except (ValueError, IndexError, KeyError, TypeError, AttributeError):
                        rows.append((None, None, None))
                yield g.assign(height=[r[0] for r in rows], width=[r[1] for r in rows], rgb=[r[2] for r in rows])

    return media.mapInPandas(run, f"{out}, height int, width int, rgb binary")


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes of store_texts() say: the payload's checksums, the media's, and the feature of the RGB tensor."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, n, m, data in zip(f["doc_id"], f["n_bytes"], f["payload_bytes"], f["media"], strict=True):
                d = Decoder(data)
                p = payload_of([q["c"] for q in d.parts], m)
                rows.append((doc, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(d.rgb())))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return through_python(media, run, "doc_id", "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
