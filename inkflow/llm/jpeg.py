"""Progressive JPEG media columns in numpy.

The decoder accumulates spectral-selection and successive-approximation scans (first and refining, DC and AC, with
end-of-band runs and restart intervals) into coefficient arrays, inverse-transforms them, upsamples chroma and gives
full-resolution RGB tensors.  Restart intervals are independent, so the intervals of a whole batch of images are
decoded side by side, one symbol of each a step: the arrays are as wide as the batch has intervals.

The encoder stores bytes losslessly as quantised coefficients of a 4:2:0 image with a quantiser of ones: a byte's
coefficient (VALUES) lies at the byte's place of the zigzag order, and frequent bytes have small ones; luma blocks come
first, then Cb, then Cr, and what the last blocks lack stays 0.  A comment segment holds the number of bytes.

Supported: 8-bit, three components or one, sampling factors 1 and 2, Huffman coding.  Others raise ValueError.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

#: Bytes of texts, frequent ones first; the others follow in order.  Ranks 0, 1, 2, 3, 4 ... are coefficients 0, 1, -1, 2, -2 ...
FREQUENT = b" etaonirshdlucmgfpwybv,.k\nxjqzETAONIRSHDLUCMGFPWYBVKXJQZ-'0123456789\xc3\xa9"
RANKED = FREQUENT + bytes(b for b in range(256) if b not in FREQUENT)
VALUES = np.zeros(256, np.int64)
VALUES[np.frombuffer(RANKED, np.uint8)] = [-(r // 2) if r % 2 == 0 else (r + 1) // 2 for r in range(256)]
#: The byte of a coefficient, from -127 on.
BYTES = np.zeros(256, np.uint8)
BYTES[VALUES + 127] = np.arange(256)
RESTART = 4
COMMENT = b"inkflow payload "
#: Widest row of units; more payload goes into further rows.
MOST_ACROSS = 4095
MOST_KEPT = 64

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: (components, first coefficient, last coefficient, high bit, low bit) of the encoder's scans.
SCANS = (
    ((0, 1, 2), 0, 0, 0, 1),
    *(((c,), 1, 5, 0, 1) for c in range(3)),
    *(((c,), 6, 63, 0, 0) for c in range(3)),
    *(((c,), 1, 5, 1, 0) for c in range(3)),
    ((0, 1, 2), 0, 0, 1, 0),
)
SAMPLING = ((2, 2), (1, 1), (1, 1))


def canonical(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(DHT counts and symbols, code by symbol, length by symbol)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(lengths[s] == n for s in order) for n in range(1, 17))
    codes, sizes, code, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in order:
        code <<= lengths[s] - last
        codes[s], sizes[s], last = code, lengths[s], lengths[s]
        code += 1
    return counts + bytes(order), codes, sizes


def lookup(dht: bytes) -> np.ndarray:
    """65536 entries by the next 16 bits: length << 8 | symbol; 0 where no code begins so."""
    out, code, at = np.zeros(65536, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(dht[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | dht[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


DC_DHT, DC_CODE, DC_SIZE = canonical(dict.fromkeys(range(12), 4))
#: Short codes for small values with few zeros before them, as texts give; run << 4 | number of bits.
SHORT_CODES = {
    0x02: 2, 0x03: 2, 0x01: 3, 0x04: 4, 0x05: 5, 0x12: 5, 0x13: 5, 0x11: 5, 0x06: 6, 0x14: 6, 0x00: 7, 0x07: 7, 0x15: 7, 0x22: 8, 0x23: 8, 0x21: 8, 0x08: 9, 0x16: 9,
}
AC_DHT, AC_CODE, AC_SIZE = canonical({r << 4 | s: 12 for r in range(16) for s in range(11) if r or s} | SHORT_CODES)


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def shape_of(n_bytes: int) -> tuple[int, int]:
    """(units across, units down) of 384 bytes each."""
    units = max(1, -(-n_bytes // 384))
    across = min(units, MOST_ACROSS)
    return across, -(-units // across)


def _kept_if_small(make):
    """Keeps what make gives for shapes (its last two arguments) of at most MOST_KEPT units, which most texts share."""
    kept = lru_cache(maxsize=1024)(make)
    return lambda *a: (kept if a[-2] * a[-1] <= MOST_KEPT else make)(*a)


@_kept_if_small
def block_order(across: int, down: int) -> np.ndarray:
    """Component << 40 | block, in the order of an interleaved scan."""
    my, mx = np.divmod(np.arange(across * down), across)
    parts = [((2 * my + v) * 2 * across + 2 * mx + h) for v in (0, 1) for h in (0, 1)]
    unit = my * across + mx
    return np.stack([*parts, unit | 1 << 40, unit | 2 << 40], axis=1).ravel()


class Bits:
    """Codes of one scan of a batch, packed by restart interval."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, interval: np.ndarray, n: int):
        used = np.bincount(interval, sizes, n).astype(np.int64)
        n_bytes = (used + 7) // 8
        ends = np.cumsum(n_bytes)
        base = (ends - n_bytes) * 8
        before = np.cumsum(sizes) - sizes
        first = np.cumsum(used) - used
        at = before - first[interval] + base[interval]
        # The padding of an interval is ones.
        pad = n_bytes * 8 - used
        codes = np.concatenate([codes, (1 << pad) - 1]).astype(np.uint64)
        sizes = np.concatenate([sizes, pad])
        at = np.concatenate([at, base + used])
        shifted = codes << (64 - sizes - (at & 7)).clip(0, 63).astype(np.uint64)
        total, out = int(ends[-1]) if n else 0, None
        for k in range((int(sizes.max(initial=0)) + 14) // 8):  # a code begins at bit 7 of its first byte at most
            part = (shifted >> np.uint64(56 - 8 * k)) & np.uint64(255)
            got = np.bincount((at >> 3) + k, part, total + 5)
            out = got if out is None else out + got
        raw = out[:total].astype(np.uint8)
        ff = raw == 255
        stuffed = np.repeat(raw, 1 + ff)
        if ff.any():
            stuffed[np.flatnonzero(np.repeat(ff, 1 + ff))[1::2]] = 0
        more = np.concatenate([[0], np.cumsum(ff)])
        bounds = np.concatenate([[0], ends])
        self.data, self.bounds = stuffed.tobytes(), (bounds + more[bounds]).tolist()

    def scan(self, first: int, n: int) -> bytes:
        """The intervals first..first+n-1 with restart markers between them."""
        out, b = [], self.bounds
        for i in range(n):
            if i:
                out.append(bytes((255, 0xD0 + (i - 1) % 8)))
            out.append(self.data[b[first + i] : b[first + i + 1]])
        return b"".join(out)


def value_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def encode_dc_first(v: np.ndarray, comp: np.ndarray, interval: np.ndarray, n: int, low: int) -> Bits:
    v = v >> low
    diff = np.empty_like(v)
    for c in np.unique(comp):
        k = np.flatnonzero(comp == c)
        d = v[k].copy()
        same = interval[k][1:] == interval[k][:-1]
        d[1:] -= np.where(same, v[k][:-1], 0)
        diff[k] = d
    size = bit_length(np.abs(diff))
    return Bits(DC_CODE[size] << size | value_bits(diff, size), DC_SIZE[size] + size, interval, n)


def encode_ac_first(band: np.ndarray, interval: np.ndarray, n: int, low: int) -> Bits:
    band = np.sign(band) * (np.abs(band) >> low)
    width = band.shape[1]
    block, k = np.nonzero(band)
    v = band[block, k].astype(np.int64)
    before = np.empty_like(k)
    before[:1] = -1
    before[1:] = np.where(block[1:] == block[:-1], k[:-1], -1)
    run = k - before - 1
    last = np.full(len(band), -1)
    last[block] = k
    ends = (last < width - 1).astype(np.int64)
    n_long = run >> 4
    at = np.cumsum(1 + n_long) - 1
    e = np.cumsum(ends)
    symbols_at = at + (e - ends)[block]
    count = np.bincount(block, 1 + n_long, len(band)).astype(np.int64)
    end_at = np.cumsum(count) + e - 1
    total = int(count.sum() + ends.sum())
    codes = np.full(total, AC_CODE[0xF0])  # what no value or end takes is a run of 16 zeros
    sizes = np.full(total, AC_SIZE[0xF0])
    size = bit_length(np.abs(v))
    s = (run & 15) << 4 | size
    codes[symbols_at] = AC_CODE[s] << size | value_bits(v, size)
    sizes[symbols_at] = AC_SIZE[s] + size
    b = np.flatnonzero(ends)
    codes[end_at[b]], sizes[end_at[b]] = AC_CODE[0], AC_SIZE[0]
    return Bits(codes, sizes, np.repeat(interval, count + ends), n)


def encode_ac_refine(band: np.ndarray, interval: np.ndarray, n: int, low: int) -> Bits:
    """For bands of at most 16 coefficients: no run of 16 zeros is needed."""
    size = np.abs(band) >> low
    blocks, width = band.shape
    codes, sizes = np.zeros((blocks, width + 1), np.int64), np.zeros((blocks, width + 1), np.int64)
    run, held, n_held = (np.zeros(blocks, np.int64) for _ in range(3))
    for k in range(width):
        s = size[:, k]
        old, new = s > 1, s == 1
        held = np.where(old, held << 1 | s & 1, held)
        n_held += old
        symbol = run << 4 | 1
        code = (AC_CODE[symbol] << 1 | (band[:, k] > 0)) << n_held | held
        codes[:, k] = np.where(new, code, 0)
        sizes[:, k] = np.where(new, AC_SIZE[symbol] + 1 + n_held, 0)
        run = np.where(new, 0, run + (s == 0))
        held, n_held = np.where(new, 0, held), np.where(new, 0, n_held)
    rest = (run > 0) | (n_held > 0)
    codes[:, width] = np.where(rest, AC_CODE[0] << n_held | held, 0)
    sizes[:, width] = np.where(rest, AC_SIZE[0] + n_held, 0)
    return Bits(codes.ravel(), sizes.ravel(), np.repeat(interval, width + 1), n)


def segment(marker: int, body: bytes) -> bytes:
    return bytes((255, marker)) + struct.pack(">H", len(body) + 2) + body


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file for each payload.  Memory: some 100 times the payloads; give about a megabyte."""
    shapes = [shape_of(len(p)) for p in payloads]
    units = np.array([a * d for a, d in shapes], np.int64)
    n_units = int(units.sum())
    coefs = [np.zeros((n_units * per, 64), np.int64) for per in (4, 1, 1)]
    starts = np.cumsum(units) - units
    for p, u, s in zip(payloads, units.tolist(), starts.tolist(), strict=True):
        flat = np.zeros(u * 384, np.int64)
        flat[: len(p)] = VALUES[np.frombuffer(p, np.uint8)]
        flat = flat.reshape(-1, 64)
        coefs[0][4 * s : 4 * (s + u)], coefs[1][s : s + u], coefs[2][s : s + u] = flat[: 4 * u], flat[4 * u : 5 * u], flat[5 * u :]
    order = np.concatenate([block_order(a, d) for a, d in shapes]) if payloads else np.empty(0, np.int64)
    comp, block = order >> 40, order & ((1 << 40) - 1)
    block = block + np.repeat(starts, units * 6) * np.where(comp == 0, 4, 1)
    dc = np.empty(len(order), np.int64)
    for c in range(3):
        dc[comp == c] = coefs[c][block[comp == c], 0]

    def intervals(per: int, each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(interval of each block, first interval and number of intervals of each image)."""
        n = units * per
        k = -(-n // RESTART)
        first = np.cumsum(k) - k
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.repeat(first, n) + inside // RESTART, each), first, k

    parts = []
    for cs, lo, hi, high, low in SCANS:
        of, first, k = intervals(1, 6) if len(cs) > 1 else intervals(4 if cs[0] == 0 else 1, 1)
        n = int(k.sum())
        if len(cs) > 1:
            bits = Bits(dc >> low & 1, np.ones(len(dc), np.int64), of, n) if high else encode_dc_first(dc, comp, of, n, low)
        else:
            band = coefs[cs[0]][:, lo : hi + 1]
            bits = (encode_ac_refine if high else encode_ac_first)(band, of, n, low)
        head = segment(0xDA, bytes((len(cs),)) + b"".join(bytes((c + 1, 0)) for c in cs) + bytes((lo, hi, high << 4 | low)))
        parts.append((head, bits, first.tolist(), k.tolist()))
    tables = segment(0xDB, bytes(1) + bytes([1] * 64)) + segment(0xC4, b"\x00" + DC_DHT + b"\x10" + AC_DHT) + segment(0xDD, struct.pack(">H", RESTART))
    out = []
    for i, (p, (a, d)) in enumerate(zip(payloads, shapes, strict=True)):
        frame = struct.pack(">BHHB", 8, 16 * d, 16 * a, 3) + b"".join(bytes((c + 1, h << 4 | v, 0)) for c, (h, v) in enumerate(SAMPLING))
        head = b"\xff\xd8" + segment(0xFE, COMMENT + str(len(p)).encode()) + segment(0xC2, frame) + tables
        out.append(head + b"".join(h + bits.scan(first[i], k[i]) for h, bits, first, k in parts) + b"\xff\xd9")
    return out


_NEXT = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")
_RESTARTS = re.compile(rb"\xff[\xd0-\xd7]")


@_kept_if_small
def interleaved(sampling: tuple, which: tuple[int, ...], across: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    my, mx = np.divmod(np.arange(across * down), across)
    cs, bs = [], []
    for c in which:
        h, v = sampling[c]
        for y in range(v):
            for x in range(h):
                bs.append((my * v + y) * (across * h) + mx * h + x)
                cs.append(np.full(len(mx), c))
    return np.stack(cs, 1).ravel(), np.stack(bs, 1).ravel()


@_kept_if_small
def alone(component: int, row: int, wide: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.divmod(np.arange(wide * high), wide)
    return np.full(len(x), component), y * row + x


class Image:
    """The segments of a file: sizes, tables, scans with their intervals."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG file")
        quant, huff, at, restart = {}, {}, 2, 0
        self.scans, self.payload_bytes, self.comps = [], None, None
        while True:
            if at + 2 > len(data) or data[at] != 255:
                raise ValueError("the JPEG file is cut off")
            marker = data[at + 1]
            if marker == 0xD9:
                break
            n = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                    body = body[129 if wide else 65 :]
            elif marker == 0xC4:
                while body:
                    k = 17 + sum(body[1:17])
                    huff[body[0]] = body[1:k]
                    body = body[k:]
            elif marker == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif marker == 0xFE and body.startswith(COMMENT):
                self.payload_bytes = int(body[len(COMMENT) :])
            elif marker == 0xC2:
                bits, self.height, self.width, k = struct.unpack_from(">BHHB", body)
                self.comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)]
                if bits != 8 or k not in (1, 3) or any(h not in (1, 2) or v not in (1, 2) for _, h, v, _ in self.comps):
                    raise ValueError("unsupported JPEG frame")
            elif marker == 0xDA:
                end = _NEXT.search(data, at)
                if self.comps is None or not end:
                    raise ValueError("the JPEG file is cut off")
                k, ids = body[0], [c[0] for c in self.comps]
                which = tuple(ids.index(body[1 + 2 * i]) for i in range(k))
                lo, hi, a = body[1 + 2 * k], body[2 + 2 * k], body[3 + 2 * k]
                tables = tuple(huff.get(t >> 4 if lo == 0 else 16 | t & 15) for t in body[2 : 2 + 2 * k : 2])
                data_of = [x.replace(b"\xff\x00", b"\xff") for x in _RESTARTS.split(data[at : end.start()])]
                self.scans.append(((which, lo, hi, a >> 4, a & 15, tables), restart, data_of))
                at = end.start()
            elif 0xC0 <= marker <= 0xCF:
                raise ValueError("no progressive Huffman-coded JPEG file")
        if self.comps is None:
            raise ValueError("the JPEG file has no frame")
        self.quant = tuple(quant[q].tobytes() for *_, q in self.comps)
        if len(self.comps) == 1:
            self.comps = [(self.comps[0][0], 1, 1, self.comps[0][3])]  # a single component has no units
        self.hmax, self.vmax = max(c[1] for c in self.comps), max(c[2] for c in self.comps)
        self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        self.key = (tuple((h, v) for _, h, v, _ in self.comps), self.quant, tuple(s[0] for s in self.scans))

    def blocks(self, which: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(component, block in its padded array), in the order of a scan of these components, a unit's blocks together."""
        if len(which) > 1:
            return interleaved(self.key[0], which, self.across, self.down)
        _, h, v, _ = self.comps[which[0]]
        wide, high = -(-(-(-self.width * h // self.hmax)) // 8), -(-(-(-self.height * v // self.vmax)) // 8)
        return alone(which[0], self.across * h, wide, high)

    def per_unit(self, which: tuple[int, ...]) -> int:
        return sum(self.comps[c][1] * self.comps[c][2] for c in which) if len(which) > 1 else 1


class Lanes:
    """A scan's intervals side by side: windows of 57 bits or more at every bit position."""

    def __init__(self, pieces: list[bytes]):
        n = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces) + bytes(16), np.uint8).astype(np.uint64)
        self.window = np.zeros(len(raw) - 8, np.uint64)
        for k in range(8):
            self.window |= raw[k : k + len(self.window)] << np.uint64(56 - 8 * k)
        self.bit = (np.cumsum(n) - n) * 8
        self.end = np.cumsum(n) * 8 + 64

    def peek(self, lanes: np.ndarray) -> np.ndarray:
        at = self.bit[lanes]
        if (at > self.end[lanes]).any():
            raise ValueError("a JPEG scan ends too soon")
        return self.window[np.minimum(at >> 3, len(self.window) - 1)] << (at & 7).astype(np.uint64)


def top(window: np.ndarray, skip: np.ndarray | int, n: np.ndarray | int) -> np.ndarray:
    """n bits (0 to 16) after the first skip ones."""
    w = (window << np.asarray(skip, np.uint64)) >> np.uint64(47)
    return (w >> (17 - np.asarray(n, np.int64)).astype(np.uint64)).astype(np.int64)


def extend(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << np.maximum(s - 1, 0)), v - (1 << s) + 1, v)


def _dc(lanes: Lanes, place: np.ndarray, comp: np.ndarray, begin: np.ndarray, end: np.ndarray, coefs: np.ndarray, luts: dict, high: int, low: int, n_comps: int) -> None:
    now, live = begin.copy(), np.flatnonzero(begin < end)
    pred = np.zeros((len(begin), n_comps), np.int64)
    while len(live):
        i = now[live]
        w = lanes.peek(live)
        if high:
            coefs[place[i], 0] |= top(w, 0, 1) << low
            lanes.bit[live] += 1
        else:
            c = comp[i]
            got = luts[0][c, (w >> np.uint64(48)).astype(np.int64)]
            n, s = got >> 8, got & 255
            if (n == 0).any() or (s > 11).any():
                raise ValueError("a JPEG scan has no such code")
            pred[live, c] += np.where(s > 0, extend(top(w, n, s), s), 0)
            coefs[place[i], 0] = pred[live, c] << low
            lanes.bit[live] += n + s
        now[live] += 1
        live = live[now[live] < end[live]]


def _ac_first(lanes: Lanes, place: np.ndarray, begin: np.ndarray, end: np.ndarray, coefs: np.ndarray, lut: np.ndarray, lo: int, hi: int, low: int) -> None:
    now, k, live = begin.copy(), np.full(len(begin), lo, np.int64), np.flatnonzero(begin < end)
    flat = coefs.ravel()
    while len(live):
        w = lanes.peek(live)
        got = lut[(w >> np.uint64(48)).astype(np.int64)]
        n, r, s = got >> 8, got >> 4 & 15, got & 15
        if (n == 0).any():
            raise ValueError("a JPEG scan has no such code")
        ends = (s == 0) & (r < 15)
        extra = np.where(ends, r, s)
        v = top(w, n, extra)
        lanes.bit[live] += n + extra
        kk = k[live] + r
        some = np.flatnonzero(s > 0)
        if (kk[some] > hi).any():
            raise ValueError("a JPEG scan leaves its band")
        flat[place[now[live[some]]] * 64 + kk[some]] = extend(v[some], s[some]) << low
        kk += 1
        done = ends | (kk > hi)
        k[live] = np.where(done, lo, kk)
        now[live] += np.where(ends, (1 << r) + v, done)
        if done.any():
            live = live[now[live] < end[live]]


def _ac_refine(lanes: Lanes, place: np.ndarray, begin: np.ndarray, end: np.ndarray, coefs: np.ndarray, lut: np.ndarray, lo: int, hi: int, low: int) -> None:
    m = len(begin)
    now, k, live = begin.copy(), np.full(m, lo, np.int64), np.flatnonzero(begin < end)
    run, new, band_ends, has = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, bool)
    flat, one = coefs.ravel(), 1 << low
    while len(live):
        w = lanes.peek(live)
        ask = (band_ends[live] == 0) & ~has[live]
        a = live[ask]
        if len(a):
            wa = w[ask]
            got = lut[(wa >> np.uint64(48)).astype(np.int64)]
            n, r, s = got >> 8, got >> 4 & 15, got & 15
            if (n == 0).any() or (s > 1).any():
                raise ValueError("a JPEG scan has no such code")
            ends = (s == 0) & (r < 15)
            extra = np.where(ends, r, s)
            v = top(wa, n, extra)
            lanes.bit[a] += n + extra
            band_ends[a] = np.where(ends, (1 << r) + v, 0)
            has[a] = ~ends
            run[a], new[a] = r, np.where(s == 1, np.where(v == 1, one, -one), 0)
        b = live[~ask]
        if len(b):
            at = place[now[b]] * 64 + k[b]
            c = flat[at]
            old = c != 0
            bit = top(w[~ask], 0, 1)
            lanes.bit[b] += old
            put = has[b] & ~old & (run[b] == 0)
            flat[at] = np.where(old & (bit == 1) & (np.abs(c) & one == 0), c + np.sign(c) * one, np.where(put, new[b], c))
            run[b] -= has[b] & ~old & ~put
            has[b] &= ~put
            k[b] += 1
            over = k[b] > hi
            k[b] = np.where(over, lo, k[b])
            now[b] += over
            band_ends[b] -= over & (band_ends[b] > 0)
            live = live[now[live] < end[live]]


def coefficients(images: list[Image]) -> list[np.ndarray]:
    """Coefficients (blocks, 64) of images of one key: all blocks of an image, component by component, padded to whole units."""
    first = images[0]
    per = [h * v for h, v in first.key[0]]
    units = np.array([i.across * i.down for i in images], np.int64)
    starts = np.cumsum(units * sum(per)) - units * sum(per)
    coefs = np.zeros((int(units.sum()) * sum(per), 64), np.int64)
    before = np.cumsum([0, *per])[:-1]
    for s, (which, lo, hi, high, low, tables) in enumerate(first.key[2]):
        pieces, begin, end, places, comps, n = [], [], [], [], [], 0
        for image, u, start in zip(images, units.tolist(), starts.tolist(), strict=True):
            _, restart, data = image.scans[s]
            c, b = image.blocks(which)
            places.append(start + u * before[c] + b)
            comps.append(c)
            step = restart * image.per_unit(which) if restart else len(b)
            marks = range(0, len(b), step)
            if len(marks) != len(data):
                raise ValueError("a JPEG scan lacks restart intervals")
            begin += [n + x for x in marks]
            end += [n + min(x + step, len(b)) for x in marks]
            pieces += data
            n += len(b)
        lanes, place, comp = Lanes(pieces), np.concatenate(places), np.concatenate(comps)
        begin, end = np.array(begin, np.int64), np.array(end, np.int64)
        if lo == 0:
            lut = np.zeros((len(per), 65536), np.int64)
            for c, t in zip(which, tables, strict=True):
                if t is not None and not high:
                    lut[c] = lookup(t)
            _dc(lanes, place, comp, begin, end, coefs, {0: lut}, high, low, len(per))
        else:
            (_ac_refine if high else _ac_first)(lanes, place, begin, end, coefs, lookup(tables[0]), lo, hi, low)
    cut = np.cumsum(units * sum(per)).tolist()
    return [coefs[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]


_K = np.arange(8)
_BASIS = np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5)


def planes(image: Image, coefs: np.ndarray) -> list[np.ndarray]:
    """Sample planes 0..255 of the components, each padded to whole units."""
    out, at, units = [], 0, image.across * image.down
    for c, (_, h, v, _) in enumerate(image.comps):
        n = units * h * v
        x = np.zeros((n, 64))
        x[:, ZIGZAG] = coefs[at : at + n] * np.frombuffer(image.quant[c], np.int64)
        at += n
        x = (x.reshape(-1, 8) @ _BASIS).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ _BASIS
        x = np.floor(x + (128.5 + 1e-7)).clip(0, 255).reshape(image.down * v, image.across * h, 8, 8)  # [.., column, row]
        out.append(x.transpose(0, 3, 1, 2).reshape(image.down * v * 8, image.across * h * 8))
    return out


def rgb(image: Image, coefs: np.ndarray) -> np.ndarray:
    """The full-resolution tensor (height, width, 3) of unsigned bytes."""
    full = []
    for p, (_, h, v, _) in zip(planes(image, coefs), image.comps, strict=True):
        p = p.repeat(image.vmax // v, 0) if image.vmax > v else p
        full.append((p.repeat(image.hmax // h, 1) if image.hmax > h else p)[: image.height, : image.width])
    if len(full) == 1:
        return np.repeat(full[0].astype(np.uint8)[:, :, None], 3, axis=2)
    y, cb, cr = full
    cb, cr = cb - 128, cr - 128
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.floor(out + (0.5 + 1e-7)).clip(0, 255).astype(np.uint8)


def decode(files: list[bytes]) -> list[tuple[Image, np.ndarray]]:
    """(image, coefficients) of each file; files of one layout and table set are decoded together."""
    images, out = [Image(f) for f in files], {}
    groups: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        groups.setdefault(image.key, []).append(i)
    for members in groups.values():
        for i, c in zip(members, coefficients([images[i] for i in members]), strict=True):
            out[i] = (images[i], c)
    return [out[i] for i in range(len(files))]


def payload(image: Image, coefs: np.ndarray) -> bytes:
    """The bytes that encode() stored."""
    return BYTES[coefs.ravel()[: image.payload_bytes] + 127].tobytes()
