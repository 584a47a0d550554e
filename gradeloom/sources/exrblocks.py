"""Blocks of EXR files whose packing may drop bits: 24-bit differences (pxr24) and 4 x 4 squares of half floats (b44, b44a)."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def differences(raw: bytes, width: int, rows: int, kinds: list[str]) -> bytes:
    """pxr24: byte planes of the differences along each line, deflated; floats keep their upper 24 bits."""
    data, at, out = np.frombuffer(zlib.decompress(raw), np.uint8), 0, []
    planes = {"half": (8, 0), "float": (24, 16, 8), "uint": (24, 16, 8, 0)}
    for _ in range(rows):
        for kind in kinds:
            line = np.zeros(width, np.uint64)
            for shift in planes[kind]:
                part = data[at : at + width]
                if len(part) < width:
                    raise ValueError("cut off")
                line += part.astype(np.uint64) << np.uint64(shift)
                at += width
            line = np.cumsum(line)
            out.append(line.astype("<u2" if kind == "half" else "<u4").tobytes())
    return b"".join(out)


def _square(b: np.ndarray) -> np.ndarray:
    """The 16 ordered values of squares of 14 bytes (n x 14): the first whole, the others as six-bit steps down the first column, then along the lines."""
    b = b.astype(np.int64)
    shift = (b[:, 2] >> 2)[:, None]
    bits = np.unpackbits(b[:, 2:].astype(np.uint8), axis=1)[:, 6:]  # fifteen steps follow the six bits of the shift
    steps = (bits.reshape(len(b), 15, 6) * np.array([32, 16, 8, 4, 2, 1])).sum(axis=2)
    steps = (steps - 32) << shift
    s = np.zeros((len(b), 4, 4), np.int64)
    s[:, 0, 0] = b[:, 0] << 8 | b[:, 1]
    for y in range(1, 4):
        s[:, y, 0] = s[:, y - 1, 0] + steps[:, y - 1]
    for x in range(1, 4):
        s[:, :, x] = s[:, :, x - 1] + steps[:, 4 * x - 1 : 4 * x + 3]
    return s & 65535


def squares(raw: bytes, width: int, rows: int, kinds: list[str]) -> bytes:
    """b44 and b44a: squares of 14 bytes, or of three if all values are equal; other kinds than half are stored plain, channel by channel."""
    at, planes = 0, []
    for kind in kinds:
        if kind != "half":
            size = rows * width * 4
            if len(raw) - at < size:
                raise ValueError("cut off")
            planes.append(np.frombuffer(raw, np.uint8, size, at).reshape(rows, width * 4))
            at += size
            continue
        ny, nx = -(-rows // 4), -(-width // 4)
        full, flat, where = [], [], []
        for i in range(ny * nx):
            if at + 3 > len(raw):
                raise ValueError("cut off")
            if raw[at + 2] >= 13 << 2:  # no shift is that large: an equal square
                flat.append((i, raw[at] << 8 | raw[at + 1]))
                at += 3
            else:
                where.append(i)
                full.append(raw[at : at + 14])
                at += 14
        s = np.zeros((ny * nx, 4, 4), np.int64)
        if full:
            if len(full[-1]) < 14:
                raise ValueError("cut off")
            s[where] = _square(np.frombuffer(b"".join(full), np.uint8).reshape(-1, 14))
        for i, v in flat:
            s[i] = v
        # values are in their order as numbers: the sign bit is turned, negative ones are turned whole
        s = np.where(s & 0x8000, s & 0x7FFF, ~s & 0xFFFF).astype("<u2")
        plane = s.reshape(ny, nx, 4, 4).transpose(0, 2, 1, 3).reshape(ny * 4, nx * 4)[:rows, :width]
        planes.append(np.ascontiguousarray(plane).view(np.uint8).reshape(rows, width * 2))
    return np.concatenate(planes, axis=1).tobytes()


def linear_flags(channels: bytes) -> list[int]:
    """The flag of each channel of a channel list that says its squares hold logarithms."""
    at, out = 0, []
    while at < len(channels) and channels[at]:
        at = channels.index(0, at) + 1
        out.append(struct.unpack_from("<iB", channels, at)[1])
        at += 16
    return out
