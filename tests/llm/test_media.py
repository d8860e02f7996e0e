import hashlib
import random
import zlib

import numpy as np
import pytest

from leafstack.llm import media as M


class Out:
    """A slow progressive writer of any coefficients: codes of 8 bits for all symbols, runs of blocks, refinements."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def code(self, symbol):
        self.put(SYMBOLS.index(symbol), 8)

    def value(self, v):
        n = int(abs(v)).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)


SYMBOLS = [r << 4 | s for r in range(16) for s in range(12)]
HUFFMAN = bytes([0, 0, 0, 0, 0, 0, 0, len(SYMBOLS), 0, 0, 0, 0, 0, 0, 0, 0, *SYMBOLS])


def shifted(v, n):
    return int(v) >> n if v >= 0 else -(int(-v) >> n)


def write(components, width, height, restart=0):
    """components: (h, v, blocks [rows, columns, 64] in zigzag order)."""
    out = [b"\xff\xd8", M._segment(0xDB, bytes([0]) + bytes(range(1, 65))), M._segment(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(components), *(x for i, (h, v, _) in enumerate(components) for x in (i + 1, h << 4 | v, 0))]))]
    out.append(M._segment(0xC4, b"\x00" + HUFFMAN + b"\x10" + HUFFMAN))
    hm, vm = max(h for h, _, _ in components), max(v for _, v, _ in components)
    if restart:
        out.append(M._segment(0xDD, restart.to_bytes(2, "big")))

    def coded(parts):
        return b"".join((M._stuffed(np.array(p.bits, np.uint8))) + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(parts) else b"") for i, p in enumerate(parts))

    def units(which):
        if len(which) == 1:
            h, v, b = components[which[0]]
            wide, high = -(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8)
            return [[(which[0], r, c)] for r in range(high) for c in range(wide)]
        rows, columns = components[0][2].shape[0] // components[0][1], components[0][2].shape[1] // components[0][0]
        return [[(i, r * components[i][1] + y, c * components[i][0] + x) for i in which for y in range(components[i][1]) for x in range(components[i][0])] for r in range(rows) for c in range(columns)]

    def pieces(us):
        return [us[i : i + restart] for i in range(0, len(us), restart)] if restart else [us]

    every = list(range(len(components)))
    for high, low in ((0, 1), (1, 0)):
        parts = []
        for piece in pieces(units(every)):
            o, last = Out(), [0] * len(components)
            for mcu in piece:
                for i, r, c in mcu:
                    v = int(components[i][2][r, c, 0]) >> low
                    if high:
                        o.put(v & 1, 1)
                    else:
                        n = int(abs(v - last[i])).bit_length()
                        o.code(n)
                        if n:
                            o.value(v - last[i])
                        last[i] = v
            parts.append(o)
        out.append(M._scan([(i + 1, 0, 0) for i in every], (0, 0), high, low, coded(parts)))
    for i in every:
        for first, last in ((1, 5), (6, 63)):
            for high, low in ((0, 2), (2, 1), (1, 0)):
                parts = []
                for piece in pieces(units([i])):
                    o, run, held = Out(), 0, []

                    def flush(o=o):
                        nonlocal run, held
                        if run:
                            n = run.bit_length() - 1
                            o.code(n << 4)
                            o.put(run - (1 << n), n)
                            o.bits += held
                        run, held = 0, []

                    for ((_, r, c),) in piece:
                        now = [shifted(v, low) for v in components[i][2][r, c]]
                        zeros, bits = 0, []
                        end = max((k for k in range(first, last + 1) if (abs(now[k]) == 1 if high else now[k])), default=0)
                        for k in range(first, last + 1):
                            v = now[k]
                            if high and abs(v) > 1:
                                if k > end:
                                    held.append(abs(v) & 1)
                                else:
                                    bits.append(abs(v) & 1)
                                continue
                            if k > end:
                                continue
                            if not v:
                                zeros += 1
                                if zeros == 16 and k < end:
                                    flush()
                                    o.code(0xF0)
                                    o.bits += bits
                                    zeros, bits = 0, []
                                continue
                            flush()
                            o.code(zeros << 4 | (1 if high else int(abs(v)).bit_length()))
                            if high:
                                o.put(v > 0, 1)
                                o.bits += bits
                            else:
                                o.value(v)
                            zeros, bits = 0, []
                        if end < last or (high and end == 0):
                            run += 1
                            if run == 3 or high:
                                flush()
                    flush()
                    parts.append(o)
                out.append(M._scan([(i + 1, 0, 0)], (first, last), high, low, coded(parts)))
    return b"".join([*out, b"\xff\xd9"])


def slow_rgb(components, width, height):
    """The picture by the plain formula."""
    q = np.arange(1, 65)
    hm, vm = max(h for h, _, _ in components), max(v for _, v, _ in components)
    wave = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for u in range(8)] for x in range(8)])
    planes = []
    for h, v, blocks in components:
        plane = np.zeros((blocks.shape[0] * 8, blocks.shape[1] * 8))
        for r in range(blocks.shape[0]):
            for c in range(blocks.shape[1]):
                natural = np.zeros(64)
                natural[M.ZIGZAG] = blocks[r, c] * q
                plane[r * 8 : r * 8 + 8, c * 8 : c * 8 + 8] = wave @ natural.reshape(8, 8) @ wave.T + 128
        planes.append(np.clip(np.rint(plane), 0, 255).repeat(vm // v, 0).repeat(hm // h, 1)[:height, :width])
    if len(planes) == 1:
        return np.stack([planes[0]] * 3, 2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)), 0, 255)


@pytest.mark.parametrize(("sampling", "width", "height", "restart"), [([(1, 1)], 20, 11, 0), ([(2, 2), (1, 1), (1, 1)], 37, 21, 0), ([(2, 1), (1, 1), (1, 1)], 16, 16, 2), ([(1, 1), (1, 1), (1, 1)], 9, 30, 3)])
def test_any_progressive(sampling, width, height, restart):
    rng = np.random.default_rng(width)
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    mw, mh = -(-width // (8 * hm)), -(-height // (8 * vm))
    components = []
    for h, v in sampling:
        blocks = rng.integers(-9, 10, (mh * v, mw * h, 64)) * (rng.random((mh * v, mw * h, 64)) < 0.15)
        blocks[rng.random(blocks.shape[:2]) < 0.4, 1:] = 0
        blocks[..., 0] = rng.integers(-60, 60, blocks.shape[:2])
        wide, high = -(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8)
        blocks[high:, :, 1:] = 0  # scans of one component don't reach the padding
        blocks[:, wide:, 1:] = 0
        components.append((h, v, blocks))
    image = M.read_jpeg(write(components, width, height, restart))
    for c, (_, _, blocks) in zip(image.components, components, strict=True):
        assert (c.blocks == blocks).all()
    rgb = np.concatenate(list(M.rgb_rows(image)))
    assert rgb.shape == (height, width, 3) and np.abs(rgb.astype(int) - slow_rgb(components, width, height)).max() <= 1


def test_zigzag():
    assert M.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and M.ZIGZAG[-1] == 63


def test_round_trip():
    rng = random.Random(1)
    for n in (1, 2, 6, 7, 25, 333, 40000):
        payload = bytes(rng.choice([0, 127, 128, 254, 255]) for _ in range(64 * n))
        media = M.write_jpeg(payload, b"payload bytes=%d" % len(payload))
        assert M.stored_payload(M.read_jpeg(media)) == payload


def test_slow_way_agrees(monkeypatch):
    payload = bytes(random.Random(2).randbytes(64 * 9))
    media = M.write_jpeg(payload, b"payload bytes=576")
    fast = M.read_jpeg(media)
    monkeypatch.setattr(M.Huffman, "codes", property(lambda self: [], lambda self, x: None), raising=False)
    M._KNOWN.clear()
    slow = M.read_jpeg(media)
    M._KNOWN.clear()
    assert all((a.blocks == b.blocks).all() for a, b in zip(fast.components, slow.components, strict=True))


def test_rows(spark):
    df = spark.createDataFrame([(1, "hello", 1), (2, None, 2), (3, "", 3), (4, "hello", 4), (4, "hello", 4), (5, "é" * 5000, 5)], "doc_id long, text string, media int")
    outputs = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "payload", "rgb", "width", "height")
    got = {r.doc_id: r for r in M.media_column(df, outputs=outputs).collect()}
    for k, text in ((1, "hello"), (2, ""), (3, ""), (5, "é" * 5000)):
        r, payload = got[k], M.payload_of(text)
        assert (r.n_bytes, r.payload_bytes, bytes(r.payload)) == (len(text.encode()), len(payload), payload) and len(payload) % 64 == 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media) and len(r.rgb) == r.width * r.height * 3
    assert got[1].feature == got[4].feature != got[2].feature and got[2].feature == got[3].feature
    assert M.media_column(df.filter("false")).count() == 0
    bad = spark.createDataFrame([(1, bytearray(got[1].media)), (2, None), (3, bytearray()), (4, bytearray(b"\xff\xd8nothing")), (5, bytearray(got[5].media[:900]))], "doc_id long, media binary")
    out = {r.doc_id: r for r in M.decode_media(bad).collect()}
    assert out[1].feature == got[1].feature and bytes(out[1].rgb) == bytes(got[1].rgb) and all(out[k].rgb is None for k in (2, 3, 4, 5))


def test_hostile_files(spark):
    """Factors of 0, sizes that the data can't hold, and cut or changed bytes give nulls or a picture, nothing else."""
    good = M.write_jpeg(M.payload_of("some text " * 40), b"payload bytes=%d" % len(M.payload_of("some text " * 40)))
    at = good.index(b"\xff\xc2")
    zero = good[: at + 11] + b"\x00" + good[at + 12 :]
    vast = good[: at + 5] + b"\xff\xff\xff\xff" + good[at + 9 :]
    rng = random.Random(1)
    broken = [good[: rng.randrange(len(good))] for _ in range(20)]
    for _ in range(60):
        b = bytearray(good)
        b[rng.randrange(2, len(b))] = rng.randrange(256)
        broken.append(bytes(b))
    rows = [(0, good), (1, zero), (2, vast), (3, None), (4, b""), (5, b"\xff\xd8\xff\xd9"), *((10 + i, b) for i, b in enumerate(broken))]
    got = {r.doc_id: r for r in M.decode_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert len(got) == len(rows) and got[0].rgb and all(got[k].rgb is None and got[k].feature is None for k in range(1, 6))


def test_tensor_is_behind_the_query(spark):
    docs = spark.createDataFrame([(1, "some text " * 900), (2, None)], "doc_id long, text string")
    for r in M.media_column(docs, outputs=("rgb", "rgb_sha256", "feature", "width", "height")).collect():
        tensor = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
        assert r.rgb_sha256 == hashlib.sha256(r.rgb).hexdigest()
        assert r.feature.startswith(f"{r.width}x{r.height} mean {tensor[..., 0].mean():.3f}")
