"""Wavelet-packed blocks of EXR files: a table of used values, Huffman codes and a two-dimensional Haar transform."""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the format: 16-bit values plus the run symbol, and code lengths that stand for runs of zeros.
SYMBOLS = 65537
SHORT_RUN, LONG_RUN, LEAST_LONG = 59, 63, 6
LOOKUP_BITS = 14


class Bits:
    """Bits of bytes, most significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, k: int) -> int:
        while self.n < k:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.n += 8
        self.n -= k
        out = self.held >> self.n & ((1 << k) - 1)
        self.held &= (1 << self.n) - 1
        return out


def code_lengths(bits: Bits, first: int, last: int) -> np.ndarray:
    out = np.zeros(SYMBOLS, np.int64)
    i = first
    while i <= last:
        n = bits.take(6)
        if n == LONG_RUN:
            i += bits.take(8) + LEAST_LONG
        elif n >= SHORT_RUN:
            i += n - SHORT_RUN + 2
        else:
            out[i] = n
            i += 1
    if i > last + 1:
        raise ValueError("a run beyond the table")
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol: longer codes are numbered first, equal lengths in order of the symbols."""
    count = np.bincount(lengths, minlength=59)
    start, code = np.zeros(59, np.int64), 0
    for n in range(58, 0, -1):
        start[n] = code
        code = code + int(count[n]) >> 1
    codes = np.zeros(len(lengths), np.int64)
    for n in np.flatnonzero(count[1:]) + 1:
        at = np.flatnonzero(lengths == n)
        codes[at] = start[n] + np.arange(len(at))
    return codes


def huffman(data: bytes, want: int) -> np.ndarray:
    """The 16-bit values of a Huffman block."""
    if not want:
        return np.zeros(0, np.uint16)
    first, last, _, n_bits = struct.unpack_from("<4I", data)
    if first >= SYMBOLS or last >= SYMBOLS:
        raise ValueError("a symbol beyond the table")
    head = Bits(data[20:])
    lengths = code_lengths(head, first, last)
    body = data[20 + head.at :][: -(-n_bits // 8)]
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    quick = np.full(1 << LOOKUP_BITS, -1, np.int64)
    long: dict[tuple[int, int], int] = {}
    for s in used.tolist():
        n, c = int(lengths[s]), int(codes[s])
        if n <= LOOKUP_BITS:
            quick[c << LOOKUP_BITS - n : (c + 1) << LOOKUP_BITS - n] = s << 6 | n
        else:
            long[(n, c)] = s
    table, out = quick.tolist(), []
    held = n = at = taken = 0
    while taken < n_bits and len(out) < want:
        while n < 48 and at < len(body):
            held = held << 8 | body[at]
            at += 1
            n += 8
        peek = held >> n - LOOKUP_BITS if n >= LOOKUP_BITS else held << LOOKUP_BITS - n
        hit = table[peek & (1 << LOOKUP_BITS) - 1]
        if hit >= 0:
            symbol, k = hit >> 6, hit & 63
        else:
            k = LOOKUP_BITS + 1
            while True:
                while n < k and at < len(body):
                    held = held << 8 | body[at]
                    at += 1
                    n += 8
                if k > 58 or n < k:
                    raise ValueError("an unknown code")
                if (symbol := long.get((k, held >> n - k), -1)) >= 0:
                    break
                k += 1
        n -= k
        held &= (1 << n) - 1
        taken += k
        if symbol == last:  # the run symbol: repeat the value before
            while n < 8 and at < len(body):
                held = held << 8 | body[at]
                at += 1
                n += 8
            n -= 8
            run = held >> n & 255
            held &= (1 << n) - 1
            taken += 8
            if not out:
                raise ValueError("a run without a value")
            out += out[-1:] * run
        else:
            out.append(symbol)
    if len(out) != want:
        raise ValueError(f"{len(out)} of {want} values")
    return np.array(out, np.int64)


def _pair(low: np.ndarray, high: np.ndarray, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
    """Two values from their mean and difference: signed where all fit 14 bits, else modulo 16 bits."""
    if narrow:
        low, high = (np.where(v > 32767, v - 65536, v) for v in (low, high))
        a = low + (high & 1) + (high >> 1)
        return a & 65535, a - high & 65535
    b = low - (high >> 1) & 65535
    return high + b - 32768 & 65535, b


def unwave(v: np.ndarray, largest: int) -> np.ndarray:
    """Undoes the transform of a plane (height x width), from the coarsest level to the finest."""
    h, w = v.shape
    narrow, p = largest < 1 << 14, 1
    while p <= min(h, w):
        p <<= 1
    p >>= 1
    step, p = p, p >> 1
    while p >= 1:
        ny, nx = (h - step) // step + 1 if h >= step else 0, (w - step) // step + 1 if w >= step else 0
        ys, xs = slice(0, ny * step, step), slice(0, nx * step, step)
        yp, xp = slice(p, ny * step, step), slice(p, nx * step, step)
        a, c = _pair(v[ys, xs], v[yp, xs], narrow)
        b, d = _pair(v[ys, xp], v[yp, xp], narrow)
        v[ys, xs], v[ys, xp] = _pair(a, b, narrow)
        v[yp, xs], v[yp, xp] = _pair(c, d, narrow)
        if w & p:  # a last column without partner
            x = nx * step
            v[ys, x], v[yp, x] = _pair(v[ys, x], v[yp, x], narrow)
        if h & p:
            y = ny * step
            v[y, xs], v[y, xp] = _pair(v[y, xs], v[y, xp], narrow)
        step, p = p, p >> 1
    return v


def unpacked(raw: bytes, width: int, rows: int, words: list[int]) -> bytes:
    """A block of `rows` lines as plain bytes; `words` are the 16-bit words of each channel's pixels."""
    lo, hi = struct.unpack_from("<HH", raw)
    bitmap, at = np.zeros(8192, np.uint8), 4
    if lo <= hi:
        if hi > 8191:
            raise ValueError("a value beyond the table")
        bitmap[lo : hi + 1] = np.frombuffer(raw, np.uint8, hi - lo + 1, at)
        at += hi - lo + 1
    known = np.unpackbits(bitmap, bitorder="little").astype(bool)
    known[0] = True
    values = np.flatnonzero(known)
    (size,) = struct.unpack_from("<i", raw, at)
    data = huffman(raw[at + 4 : at + 4 + size], rows * width * sum(words))
    planes, start = [], 0
    for n in words:
        plane = data[start : start + rows * width * n].reshape(rows, width, n)
        start += rows * width * n
        for j in range(n):
            plane[:, :, j] = unwave(np.ascontiguousarray(plane[:, :, j]), len(values) - 1)
        planes.append(plane.reshape(rows, width * n))
    table = np.zeros(65536, np.uint16)
    table[: len(values)] = values
    return np.concatenate([table[p] for p in planes], axis=1).astype("<u2").tobytes()
