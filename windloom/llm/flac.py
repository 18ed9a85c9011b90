"""FLAC frames of one 8-bit channel, many at a time: encoding, decoding and the checksums.

Frames are independent, so NumPy works on one sample (or one byte of a checksum) of all frames of a batch in step.  The
decoder reads constant, verbatim, fixed and linear-prediction subframes, both Rice coding methods, any partition order and
escaped partitions.  The encoder writes constant subframes and, whichever is shortest, fixed predictors of order 0 to 2 or
a quantised linear predictor of order 4, with one Rice parameter a frame; ``encode_lpc`` writes a linear-prediction frame
with given coefficients, partitions and escapes (for tests of the decoder).
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np

#: Samples of a block; codes of the block sizes written here (others: eight explicit bits); Hz.
BLOCK, SIZE_CODE, SAMPLE_RATE = 1024, {192: 1, 256: 8, 512: 9, 1024: 10}, 8000
#: The encoder's linear predictor: order, bits of a coefficient, and bits by which sums are shifted.
LPC_ORDER, LPC_BITS, LPC_SHIFT = 4, 12, 9


@cache
def crc_table(polynomial: int, width: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    out = np.zeros(256, np.uint16)
    for k in range(256):
        c = k << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ polynomial if c & top else c << 1) & mask
        out[k] = c
    return out


def crc8(data: bytes) -> int:
    table, c = crc_table(0x07, 8), 0
    for b in data:
        c = int(table[c ^ b])
    return c


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of bytes; zeros before a row's bytes don't count, so rows are right-aligned."""
    table = crc_table(0x8005, 16)
    c = np.zeros(len(rows), np.uint16)
    for k in range(rows.shape[1]):
        c = (c << np.uint16(8)) ^ table[(c >> np.uint16(8)) ^ rows[:, k]]
    return c


def number_bytes(n: int) -> bytes:
    """A frame number in the extended form of UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x20
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        if n < limit:
            break
        limit >>= 1
    lead = (0xFF << (7 - len(tail))) & 0xFF
    return bytes([lead | n, *reversed(tail)])


@cache
def _short_header(number: int, size: int) -> bytes:
    return _header(number, size)


def _header(number: int, size: int) -> bytes:
    code = SIZE_CODE.get(size, 6 if size <= 256 else 7)
    extra = b"" if size in SIZE_CODE else (size - 1).to_bytes(1 if size <= 256 else 2, "big")
    head = bytes([0xFF, 0xF8, code << 4, 0x02]) + number_bytes(number) + extra
    return head + bytes([crc8(head)])


def header(number: int, size: int) -> bytes:
    """Frame header with its checksum: fixed block size, rate from the stream's header, one channel, 8 bits."""
    return _short_header(number, size) if number < 4096 else _header(number, size)


def predictors(samples: np.ndarray) -> np.ndarray:
    """Quantised coefficients (n, LPC_ORDER) of each row by the Levinson-Durbin recursion on exact autocorrelations.

    Every step is one operation an element, so equal rows have equal coefficients wherever they are computed.
    """
    x = samples.astype(np.int64)
    n, width = x.shape
    r = [(x[:, k:] * x[:, : width - k]).sum(axis=1).astype(np.float64) for k in range(LPC_ORDER + 1)]
    error, a = r[0] * (1 + 2.0**-20) + 1, np.zeros((LPC_ORDER, n))
    for i in range(LPC_ORDER):
        rest = r[i + 1].copy()
        for j in range(i):
            rest -= a[j] * r[i - j]
        k = rest / error
        old = a.copy()
        a[i] = k
        for j in range(i):
            a[j] = old[j] - k * old[i - 1 - j]
        error = error * (1 - k * k)
    half = 1 << (LPC_BITS - 1)
    return np.clip(np.rint(a * (1 << LPC_SHIFT)), -half, half - 1).astype(np.int64).T


def encode_frames(samples: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of ``samples`` (n, BLOCK) int32, of which the first ``sizes`` count (at least 16)."""
    n, width = samples.shape
    live = np.arange(width)[None, :] < sizes[:, None]
    constant = (np.where(live, samples, samples[:, :1]) == samples[:, :1]).all(axis=1)
    taps = predictors(np.where(live, samples, 0))
    best_bits, best = None, None
    for order, linear in ((0, False), (1, False), (2, False), (LPC_ORDER, True)):
        if linear:
            guess = sum(taps[:, j : j + 1] * samples[:, order - 1 - j : width - 1 - j] for j in range(order)) >> LPC_SHIFT
            residual = (samples[:, order:] - guess).astype(np.int32)
        else:
            residual = np.diff(samples, n=order, axis=1)
        folded = np.where(live[:, order:], (residual << 1) ^ (residual >> 31), 0)
        count = sizes - order
        mean = folded.sum(axis=1) / count
        k = np.clip(np.floor(np.log2(np.maximum(mean, 1))), 0, 14).astype(np.int64)
        bits = (folded >> k[:, None]).astype(np.int64) + (1 + k)[:, None]
        total = np.where(live[:, order:], bits, 0).sum(axis=1) + 8 * order + linear * (9 + LPC_BITS * order)
        padded = np.zeros((n, width), np.int32)
        padded[:, order:] = folded
        if best is None:
            best_bits, best = total, [np.zeros(n, np.int64), k, padded, np.zeros(n, bool)]
        else:
            better = total < best_bits
            best_bits = np.where(better, total, best_bits)
            best = [np.where(better, order, best[0]), np.where(better, k, best[1]), np.where(better[:, None], padded, best[2]), np.where(better, linear, best[3])]
    order, k, folded, linear = best
    # The bits of a subframe: 8 of header, 8 a warm-up sample, for linear prediction 4 + 5 and the coefficients, 2 + 4 + 4 for
    # method, partition order and parameter, then quotient zeros, a one and k low bits a residual.
    coded = live & (np.arange(width)[None, :] >= order[:, None]) & ~constant[:, None]
    quotient = folded >> k[:, None]
    length = np.where(coded, quotient + 1 + k[:, None], 0)
    ends = np.cumsum(length, axis=1)
    lead = np.where(constant, 16, 18 + 8 * order + linear * (9 + LPC_BITS * LPC_ORDER))
    body = (lead + ends[:, -1] + 7) // 8
    base = (np.cumsum(body) - body) * 8
    out = np.zeros(int(body.sum()) * 8, np.uint8)

    def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            out[at + b] = value >> (width - 1 - b) & 1

    put(base, np.where(constant, 0, np.where(linear, 32 | (LPC_ORDER - 1), 8 | order) << 1), 8)
    rows = np.flatnonzero(constant)
    put(base[rows] + 8, samples[rows, 0] & 0xFF, 8)
    for o in range(1, LPC_ORDER + 1):
        rows = np.flatnonzero((order >= o) & ~constant)
        put(base[rows] + 8 * o, samples[rows, o - 1] & 0xFF, 8)
    rows = np.flatnonzero(linear & ~constant)
    at = base[rows] + 8 + 8 * LPC_ORDER
    put(at, np.full(len(rows), LPC_BITS - 1), 4)
    put(at + 4, np.full(len(rows), LPC_SHIFT), 5)
    for j in range(LPC_ORDER):
        put(at + 9 + LPC_BITS * j, taps[rows, j] & ((1 << LPC_BITS) - 1), LPC_BITS)
    rows = np.flatnonzero(~constant)
    put(base[rows] + lead[rows] - 4, k[rows], 4)  # method and partition order are zero
    r, c = np.nonzero(coded)
    one = base[r] + lead[r] + ends[r, c] - k[r] - 1
    out[one] = 1
    value, kr = folded[r, c], k[r]
    for b in range(int(kr.max()) if len(kr) else 0):
        has = kr > b
        out[one[has] + kr[has] - b] = value[has] >> b & 1
    packed = np.packbits(out).tobytes()
    cut = np.r_[0, np.cumsum(body)]
    frames = [header(int(numbers[i]), int(sizes[i])) + packed[cut[i] : cut[i + 1]] for i in range(n)]
    return [f + int(c).to_bytes(2, "big") for f, c in zip(frames, crc16(right_aligned(frames)), strict=True)]


def right_aligned(parts: list[bytes]) -> np.ndarray:
    size = np.array([len(p) for p in parts])
    width = int(size.max()) if len(size) else 0
    out = np.zeros((len(parts), width), np.uint8)
    at = np.repeat(np.arange(len(parts)) * width + width - size - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    out.reshape(-1)[at] = np.frombuffer(b"".join(parts), np.uint8)
    return out


def encode_lpc(samples: list[int], number: int, coefficients: list[int], shift: int, parameter: int = 3, precision: int = 12, partition_order: int = 0, method: int = 0, escape_bits: int | None = None) -> bytes:
    """One frame with the given linear predictor (for tests of the decoder): plain Python, bit by bit."""
    bits: list[str] = []
    order = len(coefficients)
    bits += [f"{(0b100000 | order - 1) << 1:08b}", *(f"{x & 0xFF:08b}" for x in samples[:order])]
    bits += [f"{precision - 1:04b}", f"{shift & 31:05b}", *(f"{c & (1 << precision) - 1:0{precision}b}" for c in coefficients)]
    bits += [f"{method:02b}", f"{partition_order:04b}"]
    each, wide = len(samples) >> partition_order, 5 if method else 4
    for start in range(0, len(samples), each):
        bits.append("1" * wide + f"{escape_bits:05b}" if escape_bits is not None else f"{parameter:0{wide}b}")
        for i in range(max(start, order), start + each):
            e = samples[i] - (sum(c * samples[i - 1 - j] for j, c in enumerate(coefficients)) >> shift)
            if escape_bits is not None:
                bits.append(f"{e & (1 << escape_bits) - 1:0{escape_bits}b}" if escape_bits else "")
                continue
            z = e << 1 if e >= 0 else -e * 2 - 1
            bits.append("0" * (z >> parameter) + "1" + (f"{z & (1 << parameter) - 1:0{parameter}b}" if parameter else ""))
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    frame = header(number, len(samples)) + int(text, 2).to_bytes(len(text) // 8, "big")
    return frame + int(crc16(right_aligned([frame]))[0]).to_bytes(2, "big")


class _Bits:
    """A bit reader for each frame, over one buffer."""

    def __init__(self, data: bytes, at: np.ndarray) -> None:
        raw = np.frombuffer(data + bytes(16), np.uint8).astype(np.uint64)
        n = len(data) + 8
        self.window = np.zeros(n, np.uint64)
        for k in range(8):
            self.window |= raw[k : n + k] << np.uint64(56 - 8 * k)
        self.at = at.astype(np.int64)

    def peek(self, rows: np.ndarray) -> np.ndarray:
        """At least 57 valid bits from each row's place, at the top."""
        at = self.at[rows]
        return self.window[np.minimum(at >> 3, len(self.window) - 1)] << (at & 7).astype(np.uint64)

    def read(self, rows: np.ndarray, width) -> np.ndarray:
        width = np.broadcast_to(np.asarray(width, np.int64), rows.shape)
        value = np.where(width > 0, self.peek(rows) >> np.minimum(64 - width, 63).astype(np.uint64), np.uint64(0)).astype(np.int64)
        self.at[rows] += width
        return value

    def unary(self, rows: np.ndarray) -> np.ndarray:
        """Zeros up to the next one, which is passed."""
        total = np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            top = (self.peek(rows[left]) >> np.uint64(16)).astype(np.int64)  # 48 bits, exact as a double
            zeros = np.where(top > 0, 48 - np.frexp(top.astype(np.float64))[1], 48)
            total[left] += zeros
            self.at[rows[left]] += zeros + (top > 0)
            left = left[top == 0]
            if len(left) and (self.at[rows[left]] >> 3 >= len(self.window)).any():
                raise ValueError("a frame ends inside a Rice code")
        return total


    def rice(self, rows: np.ndarray, k: np.ndarray) -> np.ndarray:
        """One Rice-coded number of each row: mostly from one look at its next bits."""
        seen = self.peek(rows)
        top = (seen >> np.uint64(16)).astype(np.int64)
        zeros = 48 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
        need = zeros + 1 + k
        z = (zeros << k) | ((seen << (zeros + 1).astype(np.uint64)) >> np.uint64(1) >> (63 - k).astype(np.uint64)).astype(np.int64)
        long = np.flatnonzero((top == 0) | (need > 57))
        if len(long):
            need[long] = 0
        self.at[rows] += need
        if len(long):
            r = rows[long]
            z[long] = (self.unary(r) << k[long]) | self.read(r, k[long])
        return (z >> 1) ^ -(z & 1)


def _sign(value: np.ndarray, width) -> np.ndarray:
    half = np.int64(1) << np.maximum(np.asarray(width, np.int64) - 1, 0)
    return np.where(np.asarray(width) > 0, (value ^ half) - half, 0)


def _residuals(bits: _Bits, rows: np.ndarray, size: np.ndarray, order: np.ndarray, out: np.ndarray) -> None:
    method = bits.read(rows, 2)
    if (method > 1).any():
        raise ValueError("reserved residual coding method")
    wide, parts = 4 + method, bits.read(rows, 4)
    # Longest frames first: those that are still read at a sample are the first of them.
    by_size = np.argsort(-size[rows], kind="stable")
    rows, wide, parts = rows[by_size], wide[by_size], parts[by_size]
    sizes, orders = size[rows], order[rows]
    each = np.maximum(sizes >> parts, 1)
    left = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(rows) else 0), "left")  # frames longer than i
    k, raw = np.zeros(len(rows), np.int64), np.full(len(rows), -1)
    split, warm, escapes = bool((parts > 0).any()), int(orders.max(initial=0)), False
    for i, m in enumerate(left.tolist()):
        if i == 0 or split:
            start = np.flatnonzero(i % each[:m] == 0)
            if len(start):
                k[start] = bits.read(rows[start], wide[start])
                escaped = start[k[start] == (1 << wide[start]) - 1]
                raw[start] = -1
                raw[escaped] = bits.read(rows[escaped], 5)
                escapes = bool((raw >= 0).any())
        if i >= warm and not escapes:
            out[rows[:m], i] = bits.rice(rows[:m], k[:m])
            continue
        live = i >= orders[:m]
        code = np.flatnonzero(live & (raw[:m] < 0))
        if len(code):
            out[rows[code], i] = bits.rice(rows[code], k[code])
        plain = np.flatnonzero(live & (raw[:m] >= 0))
        if len(plain):
            out[rows[plain], i] = _sign(bits.read(rows[plain], raw[plain]), raw[plain])


#: Coefficients of the fixed predictors by order.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def decode_frames(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(samples (n, longest) int64, sizes, numbers)``; raises ValueError where a checksum doesn't hold."""
    if not frames:
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if crc16(right_aligned(frames)).any():  # over a frame with its own checksum it is zero
        raise ValueError("frame checksum")
    n = len(frames)
    sizes, numbers, lead = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, f in enumerate(frames):
        sizes[i], numbers[i], lead[i] = _parsed(bytes(f[:16]))
    length = np.array([len(f) for f in frames], np.int64)
    bits = _Bits(b"".join(frames), (np.cumsum(length) - length + lead) * 8)
    out = np.zeros((n, int(sizes.max())), np.int64)
    everyone = np.arange(n)
    kind = bits.read(everyone, 8)
    if (kind & 0x80).any():
        raise ValueError("subframe padding")
    wasted = np.zeros(n, np.int64)
    some = np.flatnonzero(kind & 1)
    wasted[some] = bits.unary(some) + 1
    kind, depth = kind >> 1 & 63, 8 - wasted
    rows = np.flatnonzero(kind == 0)
    if len(rows):
        out[rows] = _sign(bits.read(rows, depth[rows]), depth[rows])[:, None]
    rows = np.flatnonzero(kind == 1)
    for i in range(int(sizes[rows].max()) if len(rows) else 0):
        r = rows[i < sizes[rows]]
        out[r, i] = _sign(bits.read(r, depth[r]), depth[r])
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if (~fixed & ~linear & (kind > 1)).any():
        raise ValueError("reserved subframe type")
    rows = np.flatnonzero(fixed | linear)
    if len(rows):
        order = np.where(linear, kind - 31, kind - 8)
        for i in range(int(order[rows].max())):
            r = rows[i < order[rows]]
            out[r, i] = _sign(bits.read(r, depth[r]), depth[r])
        most = max(1, int(order[rows].max()))
        taps, shift = np.zeros((n, most), np.int64), np.zeros(n, np.int64)
        for o, c in enumerate(FIXED):
            own = np.flatnonzero(kind == 8 + o)
            if len(own):
                taps[own, :o] = c
        some = rows[linear[rows]]
        if len(some):
            precision = bits.read(some, 4) + 1
            shift[some] = _sign(bits.read(some, 5), 5)
            for j in range(most):
                has = j < order[some]
                taps[some[has], j] = _sign(bits.read(some[has], precision[has]), precision[has])
        _residuals(bits, rows, sizes, order, out)
        rows = rows[order[rows] > 0]
        history, t, s, own = out[rows].T.copy(), taps[rows].T, shift[rows], order[rows]
        for i in range(1, history.shape[0]):
            guess = sum(t[j] * history[i - 1 - j] for j in range(min(i, most))) >> s
            history[i] += guess if i >= most else np.where(i >= own, guess, 0)
        out[rows] = history.T
    out[:, :] = out << wasted[:, None]
    out[np.arange(out.shape[1])[None, :] >= sizes[:, None]] = 0
    return out, sizes, numbers


def _number(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    if first < 0x80:
        return first, at + 1
    extra = 8 - (first ^ 0xFF).bit_length() - 1
    value = first & (0x3F >> extra)
    for k in range(extra):
        value = value << 6 | data[at + 1 + k] & 0x3F
    return value, at + 1 + extra


@cache
def _known(head: bytes) -> tuple[int, int, int]:
    return _parse(head)


def _parsed(head: bytes) -> tuple[int, int, int]:
    """Block size, frame number and length of a frame header, its checksum verified."""
    size, number, lead = _parse_lengths(head)
    return _known(head[:lead]) if number < 4096 else _parse(head[:lead])


def _parse_lengths(head: bytes) -> tuple[int, int, int]:
    if head[0] != 0xFF or head[1] != 0xF8 or head[3] != 0x02:
        raise ValueError("frame header")
    code = head[2] >> 4
    number, at = _number(head, 4)
    return code, number, at + (1 if code == 6 else 2 if code == 7 else 0) + 1


def _parse(head: bytes) -> tuple[int, int, int]:
    code, number, lead = _parse_lengths(head)
    if crc8(head[: lead - 1]) != head[lead - 1]:
        raise ValueError("header checksum")
    if code == 6:
        size = head[lead - 2] + 1
    elif code == 7:
        size = int.from_bytes(head[lead - 3 : lead - 1], "big") + 1
    elif code == 1:
        size = 192
    elif 2 <= code <= 5:
        size = 576 << (code - 2)
    elif code >= 8:
        size = 256 << (code - 8)
    else:
        raise ValueError("reserved block size")
    return size, number, lead


def stream_header(pcm: bytes, frame_sizes: list[int], block: int = BLOCK, seek_every: int = 1) -> bytes:
    """Marker, stream information with the MD5 of the samples, and a seek table with every frame (or every n-th)."""
    info = block.to_bytes(2, "big") * 2 + min(frame_sizes).to_bytes(3, "big") + max(frame_sizes).to_bytes(3, "big")
    info += (SAMPLE_RATE << 44 | 0 << 41 | 7 << 36 | len(pcm)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    points, at = b"", 0
    for k, size in enumerate(frame_sizes):
        if k % seek_every == 0:
            points += (k * block).to_bytes(8, "big") + at.to_bytes(8, "big") + min(block, len(pcm) - k * block).to_bytes(2, "big")
        at += size
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(points).to_bytes(3, "big") + points


def split_stream(data: bytes) -> tuple[bytes, list[tuple[int, int]], int]:
    """MD5 of the samples, seek points (sample, byte after the metadata) and where the first frame begins."""
    if data[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, md5, points, last = 4, b"", [], False
    while not last:
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            md5 = body[18:34]
        elif kind == 3:
            points = [(int.from_bytes(body[k : k + 8], "big"), int.from_bytes(body[k + 8 : k + 16], "big")) for k in range(0, size, 18)]
        at += 4 + size
    return md5, points, at
