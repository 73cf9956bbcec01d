"""Baseline JPEG as a media column: a payload stored without loss, and a reader for it.

Writer: each payload byte becomes one quantised coefficient of a baseline scan (three
components, one block of each per MCU, so 192 bytes an MCU), Huffman-coded with the tables
below. Coefficients are integers that entropy coding keeps exactly, so no byte is lost.

Reader: a baseline decoder for any tables, sampling factors, restart intervals and number
of scans. It parses the markers, Huffman-decodes the scans to coefficients and rebuilds a
luminance thumbnail from the DC terms alone, one pixel a block. Restart intervals of all
images in a batch are decoded side by side in numpy ("lanes").
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import map_rows

UNIT = 192  # bytes of an MCU: three blocks of 64
#: Lanes below which they are decoded one after the other instead of side by side.
FEW_LANES = 24
#: The order in which a block's coefficients are coded, by row * 8 + column.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
#: Huffman tables of the writer as (number of codes by length 1 to 16, symbols). DC: size of the
#: difference. AC: run and size; sizes 5, 7 and 4 are those of lower-case letters and the blank.
DC_TABLE = ([0, 0, 1, 1, 12 - 4] + [0] * 11, [7, 5, 6, 4, 8, 3, 2, 1, 0, 9])
AC_TABLE = ([1, 1, 1, 1, 0, 0, 5, 1] + [0] * 8, [0x05, 0x07, 0x04, 0x06, 0x03, 0x08, 0x02, 0x01, 0x00, 0xF0])


def codes(table: tuple[list[int], list[int]]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length) of a Huffman table, codes counted upwards by length."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(table[0], 1):
        for s in table[1][at : at + n]:
            if code >> length:
                raise ValueError("a Huffman table has more codes than fit")
            out[s] = code, length
            code += 1
        at += n
        code <<= 1
    return out


def _words(table) -> tuple[np.ndarray, np.ndarray]:
    """For each payload byte: the code of its coefficient with the amplitude's bits, and their number."""
    word, bits, by = np.zeros(256, np.uint64), np.zeros(256, np.int64), codes(table)
    for b in range(256):
        v = coefficient(b)
        size = abs(v).bit_length()
        code, n = by[size]
        word[b], bits[b] = (code << size) | (v if v > 0 else v + (1 << size) - 1), n + size
    return word, bits


def coefficient(b: int) -> int:
    """The coefficient for a byte: -128 to -1 for 0 to 127, 1 to 128 for the rest; never 0, so no runs."""
    return b - 128 if b < 128 else b - 127


def pad(text: str | None) -> tuple[bytes, int]:
    """A text's payload, blanks appended to a positive multiple of UNIT, and its own number of bytes."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % UNIT or UNIT * (not raw)), len(raw)


def _scans(payloads: list[bytes]) -> list[bytes]:
    """The entropy-coded scan of each payload, a restart interval for every MCU."""
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
    n, (dc, dc_n), (ac, ac_n) = len(data), _words(DC_TABLE), _words(AC_TABLE)
    buf, off, rows = np.zeros((n, UNIT * 17 // 32 + 3), np.uint64), np.zeros(n, np.int64), np.arange(n)
    for j in range(UNIT):
        b = data[:, j]
        word, bits = (dc[b], dc_n[b]) if j % 64 == 0 else (ac[b], ac_n[b])
        at = off >> 5
        word = word << (64 - (off & 31) - bits).astype(np.uint64)
        buf[rows, at] |= word >> np.uint64(32)
        buf[rows, at + 1] |= word & np.uint64(0xFFFFFFFF)
        off += bits
    spare = -off & 7  # ones up to a whole byte
    buf[rows, off >> 5] |= ((np.uint64(1) << spare.astype(np.uint64)) - np.uint64(1)) << (32 - (off & 31) - spare).clip(0).astype(np.uint64)
    size = (off + spare) >> 3
    flat = buf.astype(">u4").view(np.uint8).reshape(n, -1)
    flat = flat[np.arange(flat.shape[1]) < size[:, None]]
    full = flat == 0xFF  # a byte FF is followed by 00
    twice = np.repeat(flat, 1 + full)
    twice[np.flatnonzero(full) + np.arange(1, full.sum() + 1)] = 0
    size += np.add.reduceat(full, np.cumsum(size) - size, dtype=np.int64)
    index = np.concatenate([np.arange(len(p) // UNIT) for p in payloads])
    start = np.cumsum(size + 2) - size - 2
    out = np.empty(int((size + 2).sum()), np.uint8)
    out[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(twice))] = twice
    out[start + size], out[start + size + 1] = 0xFF, 0xD0 + (index & 7)
    ends = (start + size)[np.cumsum([len(p) // UNIT for p in payloads]) - 1]  # no marker after the last
    starts = start[np.cumsum([0, *(len(p) // UNIT for p in payloads)])[:-1]]
    return [out[a:b].tobytes() for a, b in zip(starts, ends)]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG for each payload; payloads are positive multiples of UNIT bytes long.

    An image is about square: as many MCUs wide as the square root of their number, and at most 8,191
    high; MCUs that fill the last row are empty blocks. The number of payload bytes stands in a comment segment.
    """
    filled, wide = [], []
    for p in payloads:
        n = len(p) // UNIT
        w = max(int(n**0.5), -(-n // 8191))
        filled.append(p + b"\x80" * (UNIT * (-n % w)))
        wide.append(w)
    tables = b"".join(bytes([kind, *t[0], *t[1]]) for kind, t in ((0x00, DC_TABLE), (0x10, AC_TABLE)))
    out = []
    for p, f, w, scan in zip(payloads, filled, wide, _scans(filled)):
        size = struct.pack(">HH", len(f) // UNIT // w * 8, w * 8)
        out.append(
            b"\xff\xd8" + _segment(0xFE, b"payload %d" % len(p)) + _segment(0xDB, bytes([0] + [1] * 64))
            + _segment(0xC0, b"\x08" + size + bytes([3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])) + _segment(0xC4, tables)
            + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
        )
    return out


_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


class Image:
    """What the markers of one baseline JPEG say, and its coefficients once decode() has run."""

    def __init__(self, raw: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[int, bytes] = {}
        self.comment, self.scans, interval, at = b"", [], 0, 2
        self.parts: dict[int, tuple[int, int, int, int]] = {}
        if raw[:2] != b"\xff\xd8":
            raise ValueError("no JPEG: it doesn't begin with SOI")
        while at < len(raw):
            if raw[at] != 0xFF:
                raise ValueError("no marker where one belongs")
            marker = raw[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                break
            n = int.from_bytes(raw[at + 2 : at + 4])
            body, at = raw[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xDB:
                while body:
                    wide = 1 + (body[0] >> 4)
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8)
                    body = body[1 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    self.tables[body[0]], body = body[1:n], body[n:]
            elif marker == 0xC0:
                self.height, self.width = struct.unpack(">HH", body[1:5])
                self.parts = {body[i]: (body[i + 1] >> 4, body[i + 1] & 15, body[i + 2], k) for k, i in enumerate(range(6, 6 + 3 * body[5], 3))}
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError(f"not baseline: frame marker {marker:x}")
            elif marker == 0xDD:
                interval = int.from_bytes(body)
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                m = _END.search(raw, at)
                end = m.start() if m else len(raw)
                used = [(body[i], self.tables[body[i + 1] >> 4], self.tables[0x10 | (body[i + 1] & 15)]) for i in range(1, 1 + 2 * body[0], 2)]
                self.scans.append((used, interval, raw[at:end]))
                at = end
        self.h, self.v = max(p[0] for p in self.parts.values()), max(p[1] for p in self.parts.values())
        self.mcus = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        self.coefs: dict[int, np.ndarray] = {}  # by component: blocks down, blocks across, 64 in zigzag order

    def layout(self, used) -> tuple[list[tuple[int, int, int]], int, int]:
        """The (component, block down, block across) of one MCU of a scan; MCUs across and down."""
        if len(used) > 1:
            return [(c, y, x) for c, _, _ in used for y in range(self.parts[c][1]) for x in range(self.parts[c][0])], *self.mcus
        h, v, _, _ = self.parts[c := used[0][0]]
        return [(c, 0, 0)], -(-(-(-self.width * h // self.h)) // 8), -(-(-(-self.height * v // self.v)) // 8)


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits ahead: length of the code * 256 + symbol; 0 where no code begins."""
    out = np.zeros(1 << 16, np.int32)
    for s, (code, n) in codes((list(table[:16]), list(table[16:]))).items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
    return out


def _decode_lanes(data: np.ndarray, start: np.ndarray, blocks: np.ndarray, kinds: list[int], luts: np.ndarray) -> np.ndarray:
    """Coefficients [sum of blocks, 64] of lanes that begin at bit ``start`` and hold ``blocks`` blocks.

    kinds: for each block of an MCU its component. luts: [2 * block of the MCU + (0 DC, 1 AC), 65536].
    """
    ahead = np.zeros(len(data) + 8, np.uint64)
    padded = np.concatenate([data, np.full(16, 0xFF, np.uint8)]).astype(np.uint64)
    for i in range(8):
        ahead |= padded[i : i + len(ahead)] << np.uint64(56 - 8 * i)
    out = np.zeros((int(blocks.sum()), 64), np.int16)
    flat, luts, per = out.reshape(-1), luts.reshape(-1), len(kinds)
    pos, k, b = start.astype(np.int64), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    base, left = (np.cumsum(blocks) - blocks).astype(np.int64), blocks.astype(np.int64)
    before = np.zeros((len(start), max(kinds) + 1), np.int64)
    kind = np.array(kinds)
    last = len(ahead) - 1
    while len(pos):
        dc = k == 0
        word = ahead[np.minimum(pos >> 3, last)] << (pos & 7).astype(np.uint64)
        found = luts[(2 * (b % per) + 1 - dc) * 65536 + (word >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        n, symbol = found >> 8, found & 255
        if not n.all():
            raise ValueError("a scan holds bits that are no code")
        size = symbol & 15
        shift = (64 - size).astype(np.uint64)
        v = np.where(size > 0, ((word << n.astype(np.uint64)) >> np.minimum(shift, np.uint64(63))).astype(np.int64), 0)
        v = np.where(v < (1 << size >> 1), v - (1 << size) + 1, v)
        pos += n + size
        k += np.where(dc, 0, symbol >> 4)
        if dc.any():
            i = np.flatnonzero(dc)
            c = kind[b[i] % per]
            before[i, c] += v[i]
            v[i] = before[i, c]
        put = (dc | (size > 0)) & (k < 64)
        flat[((base + b) * 64 + k)[put]] = v[put]
        k = np.where(~dc & (symbol == 0), 64, k + 1)
        over = k > 63
        if over.any():
            b += over
            k[over] = 0
            stay = b < left
            if not stay.all():
                pos, k, b, base, left, before = (x[stay] for x in (pos, k, b, base, left, before))
    return out


def _decode_lane(data: bytes, pos: int, blocks: int, kinds: list[int], luts: list[list[int]]) -> np.ndarray:
    """As _decode_lanes() for one lane, symbol by symbol: for images of few restart intervals."""
    out = np.zeros((blocks, 64), np.int16)
    data, before, per, mask = data + b"\xff" * 16, [0] * (max(kinds) + 1), len(kinds), (1 << 64) - 1
    end = 8 * (len(data) - 8)
    for b in range(blocks):
        k, kind, block = 0, kinds[b % per], out[b]
        dc, ac = luts[2 * (b % per)], luts[2 * (b % per) + 1]
        while k < 64:
            if pos > end:
                raise ValueError("a scan ends before its blocks do")
            word = int.from_bytes(data[pos >> 3 : (pos >> 3) + 8]) << (pos & 7) & mask
            found = (ac if k else dc)[word >> 48]
            n, symbol = found >> 8, found & 255
            if not n:
                raise ValueError("a scan holds bits that are no code")
            size = symbol & 15
            v = (word << n & mask) >> (64 - size) if size else 0
            if size and v < 1 << size >> 1:
                v -= (1 << size) - 1
            pos += n + size
            if not k:
                before[kind] += v
                block[0] = (before[kind] + 32768) % 65536 - 32768
                k = 1
            elif not symbol:
                break
            else:
                k += symbol >> 4
                if size and k < 64:
                    block[k] = v
                k += 1
    return out


def decode(raws: list[bytes]) -> list[Image]:
    """Parse and decode baseline JPEGs together."""
    images = [Image(r) for r in raws]
    groups: dict[tuple, list] = defaultdict(list)
    for im in images:
        for used, interval, scan in im.scans:
            order, across, down = im.layout(used)
            kinds = tuple(im.parts[c][3] for c, _, _ in order)
            by = {c: (dc, ac) for c, dc, ac in used}
            groups[kinds, tuple(t for c, _, _ in order for t in by[c])].append((im, order, across, down, interval, scan))
    for (kinds, tables), scans in groups.items():
        luts = np.stack([_lookup(t) for t in tables])
        text = b"".join(x[-1] + b"\xff\xd0" for x in scans)
        marks = np.array([m.start() for m in _RESTART.finditer(text)], np.int64)
        data = np.frombuffer(text, np.uint8)
        keep = np.ones(len(data), bool)
        keep[1:] = ~((data[:-1] == 0xFF) & (data[1:] == 0))
        keep[marks], keep[marks + 1] = False, False
        where = np.cumsum(keep) - keep
        starts = np.concatenate([[0], marks[:-1] + 2])
        starts = np.where(starts < len(where), where[np.minimum(starts, len(where) - 1)], keep.sum()) * 8
        lanes = []
        for _, _, across, down, interval, _ in scans:
            n, step = across * down, interval or across * down
            lanes += [min(step, n - i) for i in range(0, n, step)]
        if len(lanes) != len(starts):
            raise ValueError("restart markers don't fit the image's size")
        blocks = np.array(lanes, np.int64) * len(kinds)
        if blocks.sum() > 4 * len(data):  # a block takes two bits at least
            raise ValueError("an image is larger than its scan can hold")
        if len(lanes) < FEW_LANES:
            tables, own = [t.tolist() for t in luts], data[keep].tobytes()
            coefs = np.concatenate([_decode_lane(own, int(a), int(n), list(kinds), tables) for a, n in zip(starts, blocks)])
        else:
            coefs = _decode_lanes(data[keep], starts, blocks, list(kinds), luts)
        at = 0
        for im, order, across, down, _, _ in scans:
            part = coefs[at : at + across * down * len(order)].reshape(down, across, len(order), 64)
            at += across * down * len(order)
            for c in dict.fromkeys(x[0] for x in order):
                own = [i for i, x in enumerate(order) if x[0] == c]
                h, v = (im.parts[c][:2] if len(order) > 1 else (1, 1))
                im.coefs[c] = part[:, :, own].reshape(down, across, v, h, 64).transpose(0, 2, 1, 3, 4).reshape(down * v, across * h, 64)
    return images


def thumbnail(im: Image) -> np.ndarray:
    """Luminance by the DC terms of the first component: a pixel for each block, 0 to 255."""
    first = min(im.parts, key=lambda c: im.parts[c][3])
    dc = im.coefs[first][:, :, 0] * np.int64(im.quant[im.parts[first][2]][0])
    return np.clip(np.rint(dc / 8 + 128), 0, 255).astype(np.uint8)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """16 hex digits: of 8 x 8 nearest pixels, which are above their mean."""
    h, w = pixels.shape
    small = pixels[np.arange(8) * h // 8][:, np.arange(8) * w // 8].astype(np.int64)
    return np.packbits(small * 64 > small.sum()).tobytes().hex()


def payload(im: Image) -> bytes:
    """The stored payload, from the coefficients."""
    n = int(im.comment.rpartition(b" ")[2])
    v = np.stack([im.coefs[c].reshape(-1, 64) for c in sorted(im.parts, key=lambda c: im.parts[c][3])], axis=1).reshape(-1)[:n]
    return np.where(v < 0, v + 128, v + 127).astype(np.uint8).tobytes()


def _parts(sizes: list[int], most: int = 3_000_000):
    """Ranges of neighbours that together hold about ``most`` bytes, to bound the arrays."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary): every whole text as a baseline JPEG.

    A null text counts as empty; an empty one is stored as one MCU of blanks. Null ids and
    repeated rows are kept as they are; other columns are not looked at. Nothing is shuffled.
    """

    def start():
        def run(cols):
            padded = [pad(t) for t in cols[1]]
            media: list[bytes] = []
            for a, b in _parts([len(p) for p, _ in padded]):
                media += encode([p for p, _ in padded[a:b]])
            return [cols[0], [n for _, n in padded], media]

        return run

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(kept, start, "doc_id long, n_bytes long, media binary")


def _each(f, raws: list[bytes]) -> list:
    """f(raw, image) of every value, or the exception that it raised: all are decoded together, and one by one
    if any of them is damaged."""
    try:
        return [f(r, im) for r, im in zip(raws, decode(raws))] if raws else []
    except _DAMAGED as e:
        if len(raws) == 1:
            return [e]
        return [x for r in raws for x in _each(f, [r])]


#: What damaged bytes raise: wrong values, positions beyond the end, tables and components that aren't there.
_DAMAGED = (ValueError, IndexError, KeyError, AttributeError, ZeroDivisionError, OverflowError, struct.error)


def media_features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what is read back from the media column: payload digests, width, height,
    the thumbnail's hash and an error.

    A null media value gives nulls. One that is no whole baseline JPEG gives its size and digest, nulls
    for the rest, and what is wrong as error; others of its batch are read all the same. A JPEG that
    stores no payload has nulls for the payload alone.
    """

    def one(raw: bytes, im: Image):
        about = len(raw), hashlib.sha256(raw).hexdigest()
        pixels = thumbnail(im)
        p = payload(im) if im.comment.startswith(b"payload ") else None
        stored = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])) if p is not None else (None,) * 3
        return *stored, *about, im.width, im.height, thumbnail_hash(pixels), None

    def start():
        def run(cols):
            raws = cols[2]
            out: list = [(None,) * 9] * len(raws)
            for a, b in _parts([len(r or b"") for r in raws]):
                there = [i for i in range(a, b) if raws[i] is not None]
                for i, found in zip(there, _each(one, [raws[i] for i in there])):
                    out[i] = found if not isinstance(found, Exception) else (None, None, None, len(raws[i]), hashlib.sha256(raws[i]).hexdigest(), None, None, None, f"{type(found).__name__}: {found}")
            return [cols[0], cols[1], *([x[k] for x in out] for k in range(9))]

        return run

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumb_hash string, error string"
    return map_rows(media.select("doc_id", "n_bytes", "media"), start, schema)
