"""Media columns: progressive JPEG written from payload bytes, read back scan by scan, and rendered as RGB tensors."""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zigzag() -> np.ndarray:
    """Natural place (row * 8 + column) of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


def inverse_basis() -> np.ndarray:
    """Row k: the 64 samples of a block whose kth coefficient in zigzag order is 1 and whose others are 0."""
    x = np.arange(8)
    wave = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x[:, None] == 0, math.sqrt(1 / 8), 0.5)
    return np.kron(wave, wave)[zigzag()].astype(np.float32)


ZIGZAG, BASIS = zigzag(), inverse_basis()
#: Blocks that one step of the transform works on.
STRIP = 4096
#: A payload byte b is the coefficient OFFSET + b, so that no coefficient is 0 and all have one magnitude category.
OFFSET = 256
#: The longest run of blocks that one end-of-band code covers.
MAX_RUN = 32767


# --- writing ---------------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, number: int, length: int, symbols: list[int]) -> bytes:
    """DHT body: all symbols have codes of one length, counted up from 0."""
    counts = [0] * 16
    counts[length - 1] = len(symbols)
    return bytes([kind << 4 | number, *counts, *symbols])


def _stuffed(bits: np.ndarray) -> bytes:
    """Entropy-coded bytes: filled up with ones, and a zero byte after each 0xFF."""
    if len(bits) % 8:
        bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _bits(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The lowest lengths[i] bits of each value, one after another."""
    ends = np.cumsum(lengths)
    shift = np.repeat(ends, lengths) - 1 - np.arange(ends[-1] if len(ends) else 0)
    return ((np.repeat(values, lengths) >> shift) & 1).astype(np.uint8)


#: DC codes: 4 bits for categories 0 to 11. AC codes of first scans: one bit for 'no run, category 8'. Of refining scans: 4 bits for end-of-band runs.
TABLES = _segment(0xC4, _table(0, 0, 4, [*range(12)]) + _table(1, 0, 1, [0x08]) + _table(1, 1, 4, [n << 4 for n in range(15)]))


def _scan(components: list[tuple[int, int, int]], band: tuple[int, int], high: int, low: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([len(components), *(x for c, d, a in components for x in (c, d << 4 | a)), *band, high << 4 | low])) + data


def write_jpeg(payload: bytes, comment: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose coefficients are the bytes of payload (64 to a block), by spectral selection and successive approximation.

    Blocks fill the luma plane and then both chroma planes, row by row; those that are left over hold zero bytes.
    """
    n = len(payload) // 64
    mcus = -(-n // 6)
    wide = math.isqrt(mcus - 1) + 1
    high = -(-mcus // wide)
    mcus = wide * high
    blocks = np.zeros((6 * mcus, 64), np.uint8)
    blocks[:n] = np.frombuffer(payload, np.uint8).reshape(n, 64)
    planes = [blocks[: 4 * mcus], blocks[4 * mcus : 5 * mcus], blocks[5 * mcus :]]
    out = [b"\xff\xd8", _segment(0xFE, comment), _segment(0xDB, bytes([0]) + bytes([1]) * 64)]
    out.append(_segment(0xC2, bytes([8]) + (16 * high).to_bytes(2, "big") + (16 * wide).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(TABLES)
    luma = planes[0][:, 0].reshape(high, 2, wide, 2).transpose(0, 2, 1, 3).reshape(mcus, 4)
    dc = np.concatenate([luma, planes[1][:, :1], planes[2][:, :1]], axis=1).astype(np.int64) + OFFSET
    upper = dc >> 1
    step = np.empty_like(upper)
    step[:, 1:4], step[0, [0, 4, 5]] = np.diff(upper[:, :4], axis=1), upper[0, [0, 4, 5]]
    step[1:, 0], step[1:, 4:] = upper[1:, 0] - upper[:-1, 3], np.diff(upper[:, 4:], axis=0)
    step = step.ravel()
    size = np.frexp(np.abs(step))[1].astype(np.int64)
    extra = np.where(step < 0, step + (1 << size) - 1, step)
    every = [(c, 0, 0) for c in (1, 2, 3)]
    out.append(_scan(every, (0, 0), 0, 1, _stuffed(_bits(size << size | extra, size + 4))))
    for c, plane, bands in ((1, planes[0], ((1, 5), (6, 63))), (2, planes[1], ((1, 63),)), (3, planes[2], ((1, 63),))):
        for first, last in bands:
            part = plane[:, first : last + 1].ravel()
            bits = np.empty((len(part), 9), np.uint8)
            bits[:, 0], bits[:, 1] = 0, 1  # the code, and the offset's bit
            bits[:, 2:] = np.unpackbits(part[:, None], axis=1)[:, :7]
            out.append(_scan([(c, 0, 0)], (first, last), 0, 1, _stuffed(bits.ravel())))
    out.append(_scan(every, (0, 0), 1, 0, _stuffed((dc & 1).astype(np.uint8).ravel())))
    for c, plane in ((1, planes[0]), (2, planes[1]), (3, planes[2])):
        bits = []
        for at in range(0, len(plane), MAX_RUN):
            part = plane[at : at + MAX_RUN]
            run = len(part).bit_length() - 1
            bits += [_bits(np.array([run << run | (len(part) - (1 << run))]), np.array([4 + run])), (part[:, 1:] & 1).ravel()]
        out.append(_scan([(c, 0, 1)], (1, 63), 1, 0, _stuffed(np.concatenate(bits))))
    return b"".join([*out, b"\xff\xd9"])


# --- reading ---------------------------------------------------------------------------------------------------------


@dataclass
class Component:
    number: int
    h: int
    v: int
    quantiser: int
    wide: int = 0  # blocks that scans of this component alone cover
    high: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quantisers: dict[int, np.ndarray]
    comment: bytes = b""


class Bits:
    """Bits of one entropy-coded interval without its stuffing."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\xff" * 8, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 5], "big") >> (40 - (self.at & 7) - n) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        if not n:
            return 0
        out = self.peek(n)
        self.at += n
        if self.at > self.end + 64:
            raise ValueError("the scan ends early")
        return out

    def signed(self, n: int) -> int:
        out = self.take(n)
        return out if not n or out >> (n - 1) else out - (1 << n) + 1

    def symbol(self, table: Huffman) -> int:
        found = table.lookup[self.peek(16)]
        if not found:
            raise ValueError("no such code")
        self.at += found >> 8
        return found & 0xFF

    def array(self, n: int) -> np.ndarray:
        """The next n bits."""
        first = self.at >> 3
        raw = np.frombuffer(self.data, np.uint8, count=min(len(self.data), (self.at + n + 7) // 8) - first, offset=first)
        out = np.unpackbits(raw)[self.at & 7 : (self.at & 7) + n]
        if self.at + n > self.end:
            raise ValueError("the scan ends early")
        self.at += n
        return out


class Huffman:
    """lookup: for 16 bits, the code's length (upper byte) and symbol; 0 if there is none."""

    def __init__(self, counts: bytes, symbols: bytes):
        lookup = np.zeros(1 << 16, np.int32)
        code, k = 0, 0
        self.codes: list[tuple[int, int, int]] = []
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                first = code << (16 - length)
                lookup[first : first + (1 << (16 - length))] = length << 8 | symbols[k]
                self.codes.append((length, code, symbols[k]))
                code, k = code + 1, k + 1
            code <<= 1
        self.lookup = lookup.tolist()


_KNOWN: dict[bytes, Huffman] = {}


def _huffman(body: bytes) -> tuple[Huffman, int]:
    n = 17 + sum(body[1:17])
    if body[1:n] not in _KNOWN:
        if len(_KNOWN) > 256:
            _KNOWN.clear()
        _KNOWN[body[1:n]] = Huffman(body[1:17], body[17:n])
    return _KNOWN[body[1:n]], n


def _dc_scan(bits: Bits, scan: list[Component], tables: list[Huffman], units, high: int, low: int) -> None:
    if high:  # a raw bit for each block
        flat = bits.array(sum(len(u) for u in units))
        at = 0
        if len(scan) > 1:
            per = [c.h * c.v for c in scan]
            flat = flat.reshape(-1, sum(per))
            for c, n, u in zip(scan, per, units, strict=True):
                c.blocks.reshape(-1, 64)[u, 0] |= flat[:, at : at + n].ravel().astype(np.int32) << low
                at += n
        else:
            scan[0].blocks.reshape(-1, 64)[units[0], 0] |= flat.astype(np.int32) << low
        return
    per = [c.h * c.v if len(scan) > 1 else 1 for c in scan]
    values: list[list[int]] = [[] for _ in scan]
    last, symbol, signed = [0] * len(scan), bits.symbol, bits.signed
    for _ in range(len(units[0]) // per[0]):
        for k, n in enumerate(per):
            for _ in range(n):
                last[k] += signed(symbol(tables[k]))
                values[k].append(last[k])
    for c, u, v in zip(scan, units, values, strict=True):
        c.blocks.reshape(-1, 64)[u, 0] = np.array(v, np.int32) << low


def _ac_first(bits: Bits, blocks: np.ndarray, unit: np.ndarray, table: Huffman, first: int, last: int, low: int) -> None:
    n = last - first + 1
    if (head := next(((s, length) for length, code, s in table.codes if code == 0), None)) and head[0] >> 4 == 0 and (head[0] & 15):
        size, stride = head[0] & 15, head[1] + (head[0] & 15)
        if len(unit) * n * stride <= bits.end - bits.at and 8 * len(bits.data) - 64 - bits.at < len(unit) * n * stride + 8:
            # if every code is that one, no block ends early and all places are known
            start, rows = bits.at, max(1, STRIP * 63 // n)
            for at in range(0, len(unit), rows):
                part = unit[at : at + rows]
                found = bits.array(len(part) * n * stride).reshape(-1, stride)
                if found[:, : head[1]].any():
                    bits.at = start
                    break
                value = found[:, head[1] :] @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
                value = np.where(found[:, head[1]] == 1, value, value - (1 << size) + 1)
                blocks[part, first : last + 1] = value.reshape(-1, n) << low
            else:
                return
            blocks[unit, first : last + 1] = 0
    run = 0
    for u in unit.tolist():
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            symbol = bits.symbol(table)
            skip, size = symbol >> 4, symbol & 15
            if size:
                k += skip
                blocks[u, k] = bits.signed(size) * (1 << low)
                k += 1
            elif skip == 15:
                k += 16
            else:
                run = (1 << skip) + bits.take(skip) - 1
                break


def _ac_refine(bits: Bits, blocks: np.ndarray, unit: np.ndarray, table: Huffman, first: int, last: int, low: int) -> None:
    one, at, n = 1 << low, 0, last - first + 1

    def correct(u: int, k: int) -> None:
        if bits.take(1) and not abs(blocks[u, k]) & one:
            blocks[u, k] += one if blocks[u, k] > 0 else -one

    run = 0
    while at < len(unit):
        u, k = int(unit[at]), first
        if not run:
            while k <= last:
                symbol = bits.symbol(table)
                skip, size = symbol >> 4, symbol & 15
                if not size and skip < 15:
                    run = (1 << skip) + bits.take(skip)
                    break
                value = (one if bits.take(1) else -one) if size else 0
                while k <= last:
                    if blocks[u, k]:
                        correct(u, k)
                    elif skip:
                        skip -= 1
                    else:
                        blocks[u, k] = value
                        k += 1
                        break
                    k += 1
        if run and k == first:  # whole blocks of the run: one bit for each coefficient that isn't 0, in order
            some = unit[at : at + min(run, STRIP)]
            part = blocks[some, first : last + 1]
            live = np.flatnonzero(part)
            flat = part.ravel()
            old = flat[live]
            new = bits.array(len(live)).astype(np.int32) * one
            flat[live] = np.where(np.abs(old) & one, old, old + np.sign(old) * new)
            blocks[some, first : last + 1] = flat.reshape(-1, n)
            run, at = run - len(some), at + len(some)
            continue
        if run:
            for j in range(k, last + 1):
                if blocks[u, j]:
                    correct(u, j)
            run -= 1
        at += 1


def _intervals(data: bytes) -> list[bytes]:
    """Entropy-coded data cut at restart markers, without stuffing."""
    marks = [i for m in range(0xD0, 0xD8) for i in _finds(data, bytes([0xFF, m]))] if b"\xff" in data else []
    parts, last = [], 0
    for i in sorted(marks):
        parts.append(data[last:i])
        last = i + 2
    return [p.replace(b"\xff\x00", b"\xff") for p in [*parts, data[last:]]]


def _finds(data: bytes, what: bytes) -> list[int]:
    out, at = [], data.find(what)
    while at >= 0:
        out.append(at)
        at = data.find(what, at + 2)
    return out


def _scan_end(data: bytes, at: int) -> int:
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("no marker ends the scan")
        if data[at + 1] != 0 and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 2


def read_jpeg(data: bytes) -> Image:
    """Coefficients of a progressive JPEG, gathered from all its scans. ValueError if it is none or is broken."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, image, tables, restart, quantisers, comment = 2, None, {}, 0, {}, b""
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 4 > len(data) and data[at : at + 2] != b"\xff\xd9" or data[at : at + 1] != b"\xff":
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                tables[body[0]], n = _huffman(body)
                body = body[n:]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xC2:
            high, wide = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            if not parts or any(not 1 <= x <= 4 for c in parts for x in (c.h, c.v)):
                raise ValueError("sampling factors are from 1 to 4")
            h, v = max(c.h for c in parts), max(c.v for c in parts)
            mw, mh = -(-wide // (8 * h)), -(-high // (8 * v))
            if sum(c.h * c.v for c in parts) * mw * mh > 8 * len(data):  # each block takes a bit of the first scan at least
                raise ValueError("more blocks than the data can hold")
            for c in parts:
                c.wide, c.high = -(-(-(-wide * c.h // h)) // 8), -(-(-(-high * c.v // v)) // 8)
                c.blocks = np.zeros((mh * c.v, mw * c.h, 64), np.int32)
            image = Image(wide, high, parts, quantisers)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a progressive JPEG")
        elif marker == 0xDA:
            if image is None:
                raise ValueError("a scan before its frame")
            n = body[0]
            scan = [next(c for c in image.components if c.number == body[1 + 2 * i]) for i in range(n)]
            chosen = [body[2 + 2 * i] for i in range(n)]
            first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            end = _scan_end(data, at)
            if n > 1:
                units = [np.arange(c.blocks.shape[0] * c.blocks.shape[1]).reshape(-1, c.v, c.blocks.shape[1] // c.h, c.h).transpose(0, 2, 1, 3).ravel() for c in scan]
            else:
                units = [(np.arange(scan[0].high)[:, None] * scan[0].blocks.shape[1] + np.arange(scan[0].wide)).ravel()]
            per = [c.h * c.v if n > 1 else 1 for c in scan]
            for i, interval in enumerate(_intervals(data[at:end])):
                own = [u[i * restart * p : (i + 1) * restart * p] for u, p in zip(units, per, strict=True)] if restart else units
                bits = Bits(interval)
                if first == 0:
                    _dc_scan(bits, scan, [tables[t >> 4] for t in chosen] if not high else [], own, high, low)
                else:
                    (_ac_refine if high else _ac_first)(bits, scan[0].blocks.reshape(-1, 64), own[0], tables[0x10 | chosen[0] & 15], first, last, low)
            at = end
    if image is None:
        raise ValueError("no frame")
    image.comment = comment
    return image


def rgb_rows(image: Image):
    """The picture as uint8 tensors (rows, width, 3) from top to bottom, each of some rows of MCUs."""
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    mh = image.components[0].blocks.shape[0] // image.components[0].v
    step = max(1, STRIP // max(1, image.components[0].blocks.shape[1] * v))
    for top in range(0, mh, step):
        planes = []
        for c in image.components:
            part = c.blocks[top * c.v : (top + step) * c.v]
            flat = part.reshape(-1, 64).astype(np.float32) * image.quantisers[c.quantiser].astype(np.float32)
            samples = np.clip(np.rint(flat @ BASIS + 128), 0, 255).reshape(*part.shape[:2], 8, 8).transpose(0, 2, 1, 3).reshape(part.shape[0] * 8, -1)
            planes.append(samples.repeat(v // c.v, 0).repeat(h // c.h, 1))  # chroma at full resolution
        if len(planes) == 1:
            out = np.repeat(planes[0][:, :, None], 3, 2)
        else:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
        yield np.clip(np.rint(out), 0, 255).astype(np.uint8)[: max(0, image.height - top * 8 * v), : image.width]


def payload_of(text: str | None) -> bytes:
    """The text in UTF-8 and zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64)


def stored_payload(image: Image) -> bytes:
    """The bytes that write_jpeg() has put into the coefficients; their number stands in the comment."""
    n = int(image.comment.rpartition(b"=")[2])
    return b"".join([(c.blocks.reshape(-1, 64) - OFFSET).astype(np.uint8).tobytes() for c in image.components])[:n]


def tensor_of(image: Image) -> np.ndarray:
    """The picture at full resolution: uint8 (height, width, 3)."""
    out = np.empty((image.height, image.width, 3), np.uint8)
    at = 0
    for part in rgb_rows(image):
        out[at : at + len(part)] = part
        at += len(part)
    return out


def feature_of(image: Image, tensor: np.ndarray) -> str:
    """Size and, over the whole RGB tensor, each channel's mean and standard deviation."""
    n, total, square = 0, np.zeros(3), np.zeros(3)
    flat = tensor.reshape(-1, 3)
    for at in range(0, len(flat), 64 * STRIP):
        wide = flat[at : at + 64 * STRIP].astype(np.float32)
        n += len(wide)
        total += wide.sum(0, dtype=np.float64)
        square += np.einsum("ij,ij->j", wide, wide, dtype=np.float64)
    mean = total / n
    spread = np.sqrt(np.maximum(square / n - mean * mean, 0))
    return f"{image.width}x{image.height} mean {' '.join(f'{x:.3f}' for x in mean)} sd {' '.join(f'{x:.3f}' for x in spread)}"


#: What media_column() can return: its Spark and Arrow types.
OUTPUTS = {
    "n_bytes": ("bigint", pa.int64()), "payload_bytes": ("bigint", pa.int64()), "payload_sha256": ("string", pa.string()), "tail_crc32": ("bigint", pa.int64()), "media_bytes": ("bigint", pa.int64()), "media_sha256": ("string", pa.string()),
    "feature": ("string", pa.string()), "media": ("binary", pa.binary()), "payload": ("binary", pa.binary()), "width": ("int", pa.int32()), "height": ("int", pa.int32()), "rgb": ("binary", pa.binary()), "rgb_sha256": ("string", pa.string()),
}


def _mapped(df: DataFrame, keep: tuple[str, ...], column: str, outputs: tuple[str, ...], f) -> DataFrame:
    given = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias("__given"))
    schema = ", ".join([f"`{x.name}` {x.dataType.simpleString()}" for x in given.schema.fields[:-1]] + [f"{c} {OUTPUTS[c][0]}" for c in outputs])

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [f(x.as_py()) for x in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *[pa.array([m[c] for m in made], OUTPUTS[c][1]) for c in outputs]], names=[*part.schema.names[: len(keep)], *outputs])

    return given.mapInArrow(work, schema)


def media_column(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("media", "payload", "width", "height", "rgb", "feature")) -> DataFrame:
    """Store each whole text as a progressive JPEG, read the stored bytes back, and render them.

    The payload (UTF-8, zero bytes up to a positive multiple of 64) becomes the coefficients of the JPEG, its unit
    that is lossless. Reading accumulates all scans into coefficient arrays. outputs names columns of OUTPUTS, after
    those in keep: media is the stored form; payload, payload_bytes, payload_sha256 and tail_crc32 (of its last 64
    bytes) are read back from it; rgb is the tensor (height, width, 3) of its picture at full resolution, rgb_sha256 its digest; n_bytes
    counts the text's own bytes. A null text counts as empty: its payload is 64 zero bytes. Equal texts give equal
    values; an empty table gives an empty table; other columns of docs may have any names.
    """

    def make(given):
        payload = payload_of(given)
        media = write_jpeg(payload, b"payload bytes=%d" % len(payload))
        image = read_jpeg(media)
        back, tensor = stored_payload(image), tensor_of(image)
        return {
            "n_bytes": len((given or "").encode()), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-64:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
            "feature": feature_of(image, tensor) if "feature" in outputs else None, "media": media, "payload": back, "width": image.width, "height": image.height, "rgb": tensor.tobytes() if "rgb" in outputs else None, "rgb_sha256": hashlib.sha256(tensor).hexdigest() if "rgb_sha256" in outputs else None,
        }

    return _mapped(docs, keep, text, outputs, make)


def decode_media(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Width, height, rgb (tensor height, width, 3) and feature of any progressive JPEGs with one or three components, 8 bits deep.

    A value that is null, empty, broken or another kind of file gives nulls, as does one that declares more blocks
    than its bytes can hold (a bit each at least), which bounds what is allocated. Other columns may have any names.
    """
    outputs = ("width", "height", "rgb", "feature")

    def make(given):
        try:
            image = read_jpeg(bytes(given or b""))
            if not image.width or not image.height or len(image.components) not in (1, 3):
                raise ValueError("no picture")
            return {"width": image.width, "height": image.height, "rgb": (tensor := tensor_of(image)).tobytes(), "feature": feature_of(image, tensor)}
        except (ValueError, KeyError, IndexError, StopIteration, TypeError, ArithmeticError, MemoryError):
            return dict.fromkeys(outputs)

    return _mapped(df, keep, media, outputs, make)
