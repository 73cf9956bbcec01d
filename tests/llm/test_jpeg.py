import hashlib
import random
import zlib

import numpy as np
import pytest

from sieveline.llm import jpeg


def test_round_trip():
    rnd = random.Random(2)
    payloads = [bytes(rnd.randrange(256) for _ in range(192 * n)) for n in (1, 2, 3, 7, 50)]
    payloads += [bytes([b]) * 192 for b in (0, 127, 128, 255)] + [b"text " * 960 * 400]
    for p, im in zip(payloads, jpeg.decode(jpeg.encode(payloads))):
        assert jpeg.payload(im) == p
        y = np.array([jpeg.coefficient(p[i]) for i in range(0, len(p), 192)])
        assert (jpeg.thumbnail(im).reshape(-1)[: len(y)] == np.clip(np.rint(y / 8 + 128), 0, 255)).all()


def by_hand(coefs, sampling, interval, interleaved=True):
    """A plain one-symbol-at-a-time writer: coefs[c][y][x] blocks, runs and all, tables with every symbol."""
    dc = ([0, 0, 0, 12] + [0] * 12, list(range(12)))
    ac = ([0] * 7 + [162] + [0] * 8, [r << 4 | s for r in range(16) for s in range(1, 11)] + [0, 0xF0])
    dcs, acs = jpeg.codes(dc), jpeg.codes(ac)
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    my, mx = len(coefs[0]) // sampling[0][1], len(coefs[0][0]) // sampling[0][0]

    def bits(v, n):
        return format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def block(z, before):
        d = z[0] - before
        n = abs(d).bit_length()
        out, run = format(dcs[n][0], f"0{dcs[n][1]}b") + bits(d, n), 0
        top = max([i for i in range(1, 64) if z[i]], default=0)
        for i in range(1, top + 1):
            if not z[i]:
                run += 1
                continue
            while run > 15:
                out, run = out + format(acs[0xF0][0], f"0{acs[0xF0][1]}b"), run - 16
            n = abs(z[i]).bit_length()
            out, run = out + format(acs[run << 4 | n][0], f"0{acs[run << 4 | n][1]}b") + bits(z[i], n), 0
        return out + ("" if top == 63 else format(acs[0][0], f"0{acs[0][1]}b"))

    def scan(parts):
        units = [[(c, y * sampling[c][1] + i, x * sampling[c][0] + j) for c in parts for i in range(sampling[c][1]) for j in range(sampling[c][0])] for y in range(my) for x in range(mx)]
        if len(parts) == 1:
            c = parts[0]
            units = [[(c, y, x)] for y in range(len(coefs[c])) for x in range(len(coefs[c][0]))]
        out, k = b"", 0
        step = interval or len(units)
        for a in range(0, len(units), step):
            before, s = {c: 0 for c in parts}, ""
            for unit in units[a : a + step]:
                for c, y, x in unit:
                    s += block(coefs[c][y][x], before[c])
                    before[c] = coefs[c][y][x][0]
            s += "1" * (-len(s) % 8)
            out += bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00")
            if a + step < len(units):
                out, k = out + bytes([0xFF, 0xD0 + k % 8]), k + 1
        return jpeg._segment(0xDA, bytes([len(parts), *(b for c in parts for b in (c + 1, 0)), 0, 63, 0])) + out

    frame = bytes([8]) + (my * v * 8).to_bytes(2) + (mx * h * 8).to_bytes(2) + bytes([len(coefs), *(b for c, s in enumerate(sampling) for b in (c + 1, s[0] << 4 | s[1], 0))])
    raw = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0] + [3] * 64)) + jpeg._segment(0xC0, frame)
    raw += jpeg._segment(0xC4, bytes([0, *dc[0], *dc[1]])) + jpeg._segment(0xC4, bytes([0x10, *ac[0], *ac[1]]))
    raw += jpeg._segment(0xDD, interval.to_bytes(2)) if interval else b""
    return raw + b"".join(scan(p) for p in ([[*range(len(coefs))]] if interleaved else [[c] for c in range(len(coefs))])) + b"\xff\xd9"


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("interval", [0, 1, 3])
@pytest.mark.parametrize("interleaved", [True, False])
def test_foreign_images(sampling, interval, interleaved):
    rnd = random.Random(9)
    my, mx = 3, 4
    draw = lambda: [rnd.randrange(-900, 900)] + [rnd.choice([0, 0, 0, 0, 0, 0, rnd.randrange(-1000, 1000)]) for _ in range(63)]
    coefs = [[[draw() for _ in range(mx * s[0])] for _ in range(my * s[1])] for s in sampling]
    coefs[0][0][0] = [5] + [0] * 62 + [1]
    a, b = jpeg.decode([by_hand(coefs, sampling, interval, interleaved)] * 2)
    for im in (a, b):
        for c in range(len(coefs)):
            assert im.coefs[c + 1].tolist() == coefs[c]
        assert jpeg.thumbnail(im).shape == (my * sampling[0][1], mx * sampling[0][0])
        assert jpeg.thumbnail(im)[0, 0] == round(5 * 3 / 8 + 128)


def test_not_baseline():
    raw = jpeg.encode([b" " * 192])[0]
    with pytest.raises(ValueError):
        jpeg.decode([raw.replace(b"\xff\xc0", b"\xff\xc2")])
    with pytest.raises(ValueError):
        jpeg.decode([b"GIF89a"])


def features(spark, values):
    df = spark.createDataFrame([*enumerate(values)], "doc_id long, media binary").select("doc_id", jpeg.F.lit(1).cast("long").alias("n_bytes"), "media")
    return {r.doc_id: r for r in jpeg.media_features(df).collect()}


def test_damaged_media(spark):
    good = jpeg.encode([b"text " * 192])[0]
    cut = [good[:n] for n in range(0, len(good) - 1, 7)]
    huge = good.replace(jpeg.struct.pack(">HH", *jpeg.struct.unpack(">HH", good[good.index(b"\xff\xc0") + 5 :][:4])), b"\xff\xff\xff\xff", 1)
    rnd = random.Random(4)
    broken = [bytes(b if rnd.random() > 0.01 else rnd.randrange(256) for b in good) for _ in range(60)]
    values = [good, None, b"", b"GIF89a", b"\xff\xd8", b"\xff\xd8\xff\xd9", huge, good.replace(b"\xff\xc0", b"\xff\xc2"), *cut, *broken, good]
    got = features(spark, values)
    for i in (0, len(values) - 1):
        assert got[i].error is None and got[i].payload_sha256 == hashlib.sha256(b"text " * 192).hexdigest()
    assert all(x is None for x in tuple(got[1])[2:])
    for i in range(2, 8):
        assert got[i].error and got[i].payload_sha256 is None and got[i].media_sha256 == hashlib.sha256(values[i]).hexdigest()
    foreign = by_hand([[[[5] + [0] * 63] * 2] * 2], [(1, 1)], 0)
    r = features(spark, [foreign, good])[0]
    assert (r.width, r.height, r.payload_sha256, r.error) == (16, 16, None, None) and r.thumb_hash


def test_images_without_restart_markers_are_as_with_them():
    rnd = random.Random(6)
    coefs = [[[[rnd.randrange(-900, 900)] + [rnd.choice([0, 0, 7, -300]) for _ in range(63)] for _ in range(9)] for _ in range(8)]]
    one, many = jpeg.decode([by_hand(coefs, [(1, 1)], 0), by_hand(coefs, [(1, 1)], 1)])
    assert one.coefs[1].tolist() == many.coefs[1].tolist() == coefs[0]


def slow_feature(text):
    """Size and thumbnail hash from the payload itself: its first byte of each unit is the luminance's DC."""
    raw = (text or "").encode()
    p = raw + b" " * (-len(raw) % 192) or b" " * 192
    dc = [b - 128 if b < 128 else b - 127 for b in p[::192]]
    w = max(int(len(dc) ** 0.5), -(-len(dc) // 8191))
    h = -(-len(dc) // w)
    # Blocks that fill the last row hold the byte 80, coefficient 1.
    pixels = [min(255, max(0, round(c / 8 + 128))) for c in dc + [1] * (w * h - len(dc))]
    small = [pixels[(y * h // 8) * w + x * w // 8] for y in range(8) for x in range(8)]
    bits = "".join("1" if v * 64 > sum(small) else "0" for v in small)
    return f"{w * 8}x{h * 8}:{int(bits, 2):016x}"


def test_query(spark, sf):
    from sieveline.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_jpeg"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        p = raw + b" " * (-len(raw) % 192) or b" " * 192
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r.feature == slow_feature(texts[r.doc_id])


def test_table(spark):
    rows = [(1, "a", 5), (2, "", 5), (3, None, 5), (None, "ä" * 96, 5), (5, "x" * 193, 5), (5, "x" * 193, 5), (6, "long ß " * 300_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media int")
    media = jpeg.media_column(docs)
    got = {}
    for r in jpeg.media_features(media).collect():
        got.setdefault(r.doc_id, set()).add(r)
    for i, t, _ in rows:
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192) or b" " * 192
        (r,) = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert jpeg.media_features(jpeg.media_column(docs.limit(0))).collect() == []
    assert jpeg.media_features(spark.createDataFrame([(1, 2, None)], "doc_id long, n_bytes long, media binary")).first().payload_sha256 is None
