"""Bit-sliced Hamming comparison: bit planes stored vertically, distances counted by carry-save adders.

A plane holds one bit position of 64 fingerprints per machine word, so one XOR and a few adder operations advance 64
distances at once.  A block of comparisons is abandoned as soon as every distance in it exceeds the radius.
"""

from __future__ import annotations

import numpy as np


def planes(words: np.ndarray) -> np.ndarray:
    """Vertical planes of ``words`` (n rows, L uint64 words): array (64 L, ceil(n / 64)) of uint64."""
    n, k = words.shape
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(n, 8 * k), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    out = np.zeros((64 * k, 8 * ((n + 63) // 64)), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")


class Counter:
    """Carry-save counters over lanes: ``add`` takes planes of weight one; ``exceeds`` says which lanes passed a radius."""

    def __init__(self) -> None:
        self.levels: list[list[np.ndarray]] = []

    def add(self, plane: np.ndarray, level: int = 0) -> None:
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            held = self.levels[level]
            held.append(plane)
            if len(held) < 3:
                return
            a, b, c = held
            half = a ^ b
            self.levels[level] = [half ^ c]
            plane = (a & b) | (half & c)
            level += 1

    def exceeds(self, radius: int) -> np.ndarray:
        digits, carry = [], []
        level = 0
        while level < len(self.levels) or carry:
            held = carry + (self.levels[level] if level < len(self.levels) else [])
            carry = []
            while len(held) > 1:
                a, b, *rest = held
                carry.append(a & b)
                held = [a ^ b, *rest]
            digits.append(held[0] if held else None)
            level += 1
        top = max(len(digits), radius.bit_length())
        over = equal = None
        for k in range(top - 1, -1, -1):
            digit = digits[k] if k < len(digits) else None
            want = radius >> k & 1
            if digit is None:
                if want:
                    equal = np.zeros(1, np.uint64) if equal is None else equal & np.uint64(0)
                continue
            if equal is None:
                equal = np.full_like(digit, np.uint64(0xFFFFFFFFFFFFFFFF))
            if not want:
                over = equal & digit if over is None else over | (equal & digit)
                equal = equal & ~digit
            else:
                equal = equal & digit
        return np.zeros(1, np.uint64) if over is None else over


def _within(xor, valid: np.ndarray, n_planes: int, radius: int) -> np.ndarray | None:
    """Lanes of ``valid`` whose distance is at most ``radius``; None once all exceed it.  ``xor(k)``: plane k of the XOR."""
    counter, every = Counter(), max(16, n_planes // 4)
    for k in range(n_planes):
        counter.add(xor(k))
        if (k + 1) % every == 0 or k + 1 == n_planes:
            valid = valid & ~counter.exceeds(radius)
            if not valid.any():
                return None
    return valid


def _lanes(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.ascontiguousarray(mask).view(np.uint8), bitorder="little"))


def _pack(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(8 * ((len(flags) + 63) // 64), np.uint8)
    packed = np.packbits(flags, bitorder="little")
    out[: len(packed)] = packed
    return out.view("<u8")


def _shifted(p: np.ndarray, s: int) -> np.ndarray:
    """Planes moved so that lane i holds what lane i + s held."""
    skip, bits = divmod(s, 64)
    out = np.zeros_like(p)
    width = p.shape[1] - skip
    if width > 0:
        out[:, :width] = p[:, skip:] >> np.uint64(bits)
        if bits and width > 1:
            out[:, : width - 1] |= p[:, skip + 1 :] << np.uint64(64 - bits)
    return out


def _small_blocks(words: np.ndarray, block: np.ndarray, largest: int, radius: int):
    """Pairs within blocks of at most ``largest`` rows: all rows against the rows s places on, for each s."""
    p = planes(words)
    for s in range(1, largest):
        same = np.zeros(len(block), bool)
        same[:-s] = block[:-s] == block[s:]
        valid = _pack(same)
        if not valid.any():
            return
        moved = p ^ _shifted(p, s)
        hit = _within(lambda k, m=moved: m[k], valid, len(p), radius)
        if hit is not None:
            i = _lanes(hit)
            yield i, i + s


def _large_block(words: np.ndarray, radius: int, tile: int = 192):
    """Pairs within one large block: tiles of queries against the planes of all later rows."""
    n, ones = len(words), np.uint64(0xFFFFFFFFFFFFFFFF)
    p = planes(words)
    for start in range(0, n, tile):
        end = min(n, start + tile)
        first = start // 64
        sub = p[:, first:]
        query = words[start:end]
        lane = np.arange(first * 64, first * 64 + sub.shape[1] * 64)
        flags = (lane[None, :] > np.arange(start, end)[:, None]) & (lane[None, :] < n)
        valid = np.packbits(flags, axis=1, bitorder="little").view("<u8")

        def xor(k: int, query=query, sub=sub) -> np.ndarray:
            bit = (query[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
            return sub[k][None, :] ^ np.where(bit == 1, ones, np.uint64(0))[:, None]

        hit = _within(xor, valid, len(p), radius)
        if hit is not None:
            at = _lanes(hit)
            q, lanes = np.divmod(at, sub.shape[1] * 64)
            yield start + q, first * 64 + lanes


def links(words: np.ndarray, block: np.ndarray, radius: int):
    """Yield index arrays (i, j) of all pairs of rows in the same block at Hamming distance ``radius`` or less.

    ``words``: (n, L) uint64; ``block``: n block numbers, equal ones adjacent.
    """
    if not len(block):
        return
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    size = np.diff(np.r_[starts, len(block)])
    of_row = np.repeat(size, size)
    for low, high in ((2, 4), (5, 16), (17, 64)):
        rows = np.flatnonzero((of_row >= low) & (of_row <= high))
        if len(rows):
            for i, j in _small_blocks(words[rows], block[rows], high, radius):
                yield rows[i], rows[j]
    for start, n in zip(starts[size > 64], size[size > 64], strict=True):
        for i, j in _large_block(words[start : start + n], radius):
            yield start + i, start + j


def forest(n: int, pairs) -> np.ndarray:
    """Smallest row index connected to each of ``n`` rows by the pairs."""
    parent = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = parent[i], parent[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            if (low == high).all():
                break
            np.minimum.at(parent, high, low)
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    return parent
