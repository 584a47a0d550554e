"""Images and films as DataFrames: files are read with Spark's binaryFile source and decoded in Arrow batches.

Every reader keeps going past a broken file: it yields a row with `error` set, or no
pixels, instead of failing the job. Decoders are plain functions of bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.color import COLORIMETRIC_NAMES, DESCRIPTOR_NAMES, TRANSFER_NAMES
from gradeloom.sources.exrblocks import differences, linear_flags, squares
from gradeloom.sources.piz import unpacked

EXTENSIONS = ("dpx", "exr", "mov")
DPX_HEADER = 2048


class MediaError(ValueError):
    """A file that can't be decoded."""


def scan(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS, content: bool = False) -> DataFrame:
    """(path, filename, format, length[, content]) of the top level of a folder; extensions in any case.

    Spark leaves files without a byte out of every scan; they are added from its listing of the folder, with empty content.
    """
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    cols = ["path", name.alias("filename"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("format"), "length"]
    shown = [*cols, *(["content"] if content else [])]
    listed = [(unquote(p).replace("file:///", "file:/"), 0, bytearray()) for p in f.inputFiles()]
    if not listed:
        return f.select(*shown)
    bare = spark.createDataFrame(listed, "path string, length long, content binary").join(f.select("path"), "path", "left_anti")
    return f.select(*shown).unionByName(bare.select(*shown))


def dpx_header(data: bytes) -> dict:
    """Header of a DPX file: size, depth, codes, packing, encoding, offset and byte order."""
    if len(data) < DPX_HEADER:
        raise MediaError(f"{len(data)} bytes are less than a header")
    order = {b"SDPX": ">", b"XPDS": "<"}.get(data[:4])
    if order is None:
        raise MediaError("not a DPX file")
    _, _, width, height = struct.unpack_from(order + "HHII", data, 768)
    descriptor, transfer, colorimetric, depth, packing, encoding, offset = struct.unpack_from(order + "BBBBHHI", data, 800)
    if not width or not height:
        raise MediaError("an empty image")
    if depth not in (1, 8, 10, 12, 16, 32, 64):
        raise MediaError(f"bit depth {depth}")
    if encoding or packing:
        raise MediaError("compressed or differently packed")
    return {
        "width": width, "height": height, "bit_depth": depth, "offset": offset, "order": order, "packing": packing,
        "transfer": TRANSFER_NAMES.get(transfer, "unknown"), "colorimetric": COLORIMETRIC_NAMES.get(colorimetric, "unknown"), "descriptor": DESCRIPTOR_NAMES.get(descriptor, "unknown"),
    }


def dpx_pixels(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, values n x 3 in 0..1) of an 8, 10 or 16 bit image; 10-bit pixels fill a word from bit 29 down."""
    h = dpx_header(data)
    n, at, depth = h["width"] * h["height"], h["offset"], h["bit_depth"]
    if at < DPX_HEADER or at >= len(data):
        raise MediaError("the pixel offset is outside of the file")
    kinds = {8: ("u1", 3), 10: ("u4", 1), 16: ("u2", 3)}
    if depth not in kinds:
        raise MediaError(f"pixels of {depth} bits")
    kind, per = kinds[depth]
    kind = kind if kind == "u1" else h["order"] + kind
    if len(data) - at < n * per * np.dtype(kind).itemsize:
        raise MediaError("cut off")
    raw = np.frombuffer(data, kind, n * per, at)
    if depth == 10:
        return h["width"], h["height"], np.stack([raw >> s & 1023 for s in (20, 10, 0)], axis=1) / 1023.0
    return h["width"], h["height"], raw.reshape(n, 3) / (255.0 if depth == 8 else 65535.0)


def ppm_pixels(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, values n x 3) of a binary P6 image with a maximum up to 65535."""
    fields, at = [], 0
    while len(fields) < 4:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise MediaError("cut off header")
        fields.append(data[at:end])
        at = end
    if fields[0] != b"P6" or not all(f.isdigit() for f in fields[1:]):
        raise MediaError("not a P6 image")
    width, height, top = map(int, fields[1:])
    if not width or not height or not 1 <= top <= 65535:
        raise MediaError("bad size or maximum")
    kind = "u1" if top < 256 else ">u2"
    if len(data) - at - 1 < width * height * 3 * np.dtype(kind).itemsize:
        raise MediaError("cut off")
    return width, height, np.frombuffer(data, kind, width * height * 3, at + 1).reshape(-1, 3) / float(top)


def _chunks(data: bytes, at: int) -> tuple[dict[str, tuple[str, bytes]], int]:
    found = {}
    while at < len(data) and data[at]:
        name_end = data.index(0, at)
        kind_end = data.index(0, name_end + 1)
        (size,) = struct.unpack_from("<I", data, kind_end + 1)
        found[data[at:name_end].decode("latin-1")] = (data[name_end + 1 : kind_end].decode("latin-1"), data[kind_end + 5 : kind_end + 5 + size])
        at = kind_end + 5 + size
    return found, at + 1


EXR_COMPRESSION = ("none", "rle", "zips", "zip", "piz", "pxr24", "b44", "b44a")


def exr_header(data: bytes) -> dict:
    """Header of a single-part EXR file: size, channels with their types, compression."""
    try:
        if data[:4] != b"\x76\x2f\x31\x01":
            raise MediaError("not an EXR file")
        attrs, start = _chunks(data, 8)
        x0, y0, x1, y1 = struct.unpack("<4i", attrs["dataWindow"][1])
        raw, at, channels = attrs["channels"][1], 0, []
        while raw[at]:
            end = raw.index(0, at)
            channels.append((raw[at:end].decode("latin-1"), ("uint", "half", "float")[struct.unpack_from("<i", raw, end + 1)[0]]))
            at = end + 17
        code = attrs["compression"][1][0]
    except MediaError:
        raise
    except (KeyError, IndexError, ValueError, struct.error) as e:
        raise MediaError(f"broken header: {e}") from None
    depth = max({"uint": 32, "half": 16, "float": 32}[k] for _, k in channels)
    names = ",".join(n for n, _ in channels)
    return {
        "width": x1 - x0 + 1, "height": y1 - y0 + 1, "channels": channels, "compression": EXR_COMPRESSION[code] if code < len(EXR_COMPRESSION) else "unknown",
        "logarithms": any(linear_flags(raw)), "bit_depth": depth, "descriptor": {"B,G,R": "rgb", "A,B,G,R": "rgba"}.get(names, names), "start": start, "first_line": y0,
    }


def _woven(raw: bytes) -> bytes:
    """Undoes the byte predictor and puts the two halves of the bytes back in turn, as the byte compressions have it."""
    p = np.frombuffer(raw, np.uint8).astype(np.int64)
    p = (np.cumsum(np.concatenate([p[:1], p[1:] - 128])) & 255).astype(np.uint8)
    half = (len(p) + 1) // 2
    out = np.empty(len(p), np.uint8)
    out[0::2], out[1::2] = p[:half], p[half:]
    return out.tobytes()


def _unrun(raw: bytes) -> bytes:
    """Run lengths: a negative count precedes as many plain bytes, another repeats the next byte once more than it says."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at] - 256 if raw[at] > 127 else raw[at]
        if n < 0:
            out += raw[at + 1 : at + 1 - n]
            at += 1 - n
        else:
            out += raw[at + 1 : at + 2] * (n + 1)
            at += 2
    return bytes(out)


#: Lines of a block by compression.
EXR_LINES = {"none": 1, "rle": 1, "zips": 1, "zip": 16, "piz": 32, "pxr24": 16, "b44": 32, "b44a": 32}
EXR_ITEMS = {"uint": "<u4", "half": "<f2", "float": "<f4"}


def exr_pixels(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, values n x 3) of scan lines in any of the eight packings; values stay scene-linear, unclamped. Squares of logarithms are refused."""
    h = exr_header(data)
    if h["compression"] not in EXR_LINES:
        raise MediaError(f"compression {h['compression']}")
    if h["compression"] in ("b44", "b44a") and h["logarithms"]:
        raise MediaError("squares of logarithms")
    lines, width, height, channels = EXR_LINES[h["compression"]], h["width"], h["height"], h["channels"]
    if any(k not in ("half", "float") for n, k in channels if n in "RGB") or {"R", "G", "B"} - {n for n, _ in channels}:
        raise MediaError("not half or float RGB")
    out = np.zeros((height, width, 3))
    try:
        offsets = struct.unpack_from(f"<{-(-height // lines)}Q", data, h["start"])
        for at in offsets:
            y, size = struct.unpack_from("<ii", data, at)
            raw = data[at + 8 : at + 8 + size]
            rows = min(lines, height - (y - h["first_line"]))
            want = rows * width * sum(int(EXR_ITEMS[k][-1]) for _, k in channels)
            if len(raw) < size or rows < 1:
                raise MediaError("cut off")
            if size < want:  # a block that packing would make larger is stored plain
                if h["compression"] == "pxr24":
                    raw = differences(raw, width, rows, [k for _, k in channels])
                elif h["compression"] in ("b44", "b44a"):
                    raw = squares(raw, width, rows, [k for _, k in channels])
                elif h["compression"] == "piz":
                    raw = unpacked(raw, width, rows, [int(EXR_ITEMS[k][-1]) // 2 for _, k in channels])
                elif h["compression"] != "none":
                    raw = _woven(_unrun(raw) if h["compression"] == "rle" else zlib.decompress(raw))
            pos = 0
            for row in range(rows):
                for name, kind in channels:
                    line = np.frombuffer(raw, EXR_ITEMS[kind], width, pos)
                    pos += line.nbytes
                    if name in ("R", "G", "B"):
                        out[y - h["first_line"] + row, :, "RGB".index(name)] = line
    except (struct.error, zlib.error, ValueError, IndexError) as e:
        raise MediaError(f"broken pixels: {e}") from None
    return width, height, out.reshape(-1, 3)


def png_pixels(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, values n x 3) of a PNG of 8 or 16 bit without interlacing; gray is repeated, alpha is left out."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise MediaError("not a PNG file")
    at, body, head, palette = 8, b"", None, None
    try:
        while at + 8 <= len(data):
            size, kind = struct.unpack_from(">I4s", data, at)
            part = data[at + 8 : at + 8 + size]
            if len(part) < size:
                raise MediaError("cut off")
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif kind == b"PLTE":
                palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                body += part
            at += 12 + size
        if head is None or head[6] or head[2] not in (8, 16) or (head[3] == 3 and palette is None):
            raise MediaError("an unknown kind of PNG")
        width, height, depth, color = head[:4]
        planes = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
        step = planes * depth // 8
        rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * step)
    except (struct.error, zlib.error, ValueError, KeyError) as e:
        raise MediaError(f"broken PNG: {e}") from None
    lines, above = np.zeros((height, width * step), np.uint8), np.zeros(width * step, np.int64)
    for y, row in enumerate(rows):
        above = _unfiltered(int(row[0]), row[1:].astype(np.int64), above, step)
        lines[y] = above
    if depth == 16:
        v = np.frombuffer(lines.tobytes(), ">u2").reshape(-1, planes) / 65535.0
    else:
        v = palette[lines.reshape(-1)] / 255.0 if color == 3 else lines.reshape(-1, planes) / 255.0
    return width, height, np.repeat(v[:, :1], 3, axis=1) if color in (0, 4) else v[:, :3]


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """One line of a PNG without its filter: none, left, above, their mean, or the Paeth predictor."""
    if kind == 0:
        return row
    if kind == 2:
        return (row + above) & 255
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0).reshape(-1) & 255
    if kind not in (3, 4):
        raise MediaError(f"PNG filter {kind}")
    out = row.tolist()
    up = above.tolist()
    for i in range(len(out)):
        a, b, c = (out[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
        if kind == 3:
            guess = (a + b) >> 1
        else:
            p = a + b - c
            guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
        out[i] = (out[i] + guess) & 255
    return np.array(out, np.int64)


def _boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, at + 8)
            head = 16
        size = size or end - at
        if size < head or at + size > end:
            raise MediaError("broken box")
        yield kind, at + head, at + size
        at += size


def _find(data: bytes, path: list[bytes], start: int, end: int) -> tuple[int, int] | None:
    for kind, a, b in _boxes(data, start, end):
        if kind == path[0]:
            return (a, b) if len(path) == 1 else _find(data, path[1:], a, b)
    return None


#: Names of the codecs of film tracks.
CODEC_NAMES = {
    b"avc1": "H.264", b"hvc1": "H.265", b"hev1": "H.265", b"av01": "AV1", b"vp09": "VP9", b"vp08": "VP8", b"mp4v": "MPEG-4", b"apch": "ProRes 422 HQ", b"apcn": "ProRes 422",
    b"apcs": "ProRes 422 LT", b"apco": "ProRes 422 Proxy", b"ap4h": "ProRes 4444", b"AVdn": "DNxHD",
}


def _video_track(data: bytes) -> tuple[int, int]:
    moov = _find(data, [b"moov"], 0, len(data))
    if not moov:
        raise MediaError("no movie box")
    for kind, a, b in _boxes(data, *moov):
        if kind == b"trak":
            handler = _find(data, [b"mdia", b"hdlr"], a, b)
            if handler and data[handler[0] + 8 : handler[0] + 12] == b"vide":
                return a, b
    raise MediaError("no video track")


def _times(data: bytes, a: int, b: int) -> tuple[int, list[tuple[int, int]]]:
    mdhd, stts = _find(data, [b"mdia", b"mdhd"], a, b), _find(data, [b"mdia", b"minf", b"stbl", b"stts"], a, b)
    if not mdhd or not stts:
        raise MediaError("no time table")
    (scale,) = struct.unpack_from(">I", data, mdhd[0] + (20 if data[mdhd[0]] else 12))
    (n,) = struct.unpack_from(">I", data, stts[0] + 4)
    if 8 + 8 * n > stts[1] - stts[0]:
        raise MediaError("cut off time table")
    return scale, [struct.unpack_from(">II", data, stts[0] + 8 + 8 * i) for i in range(n)]


def mov_header(data: bytes) -> dict:
    """Size, codec, frame rate (samples over ticks), duration, frames and depth of the first video track."""
    try:
        a, b = _video_track(data)
        stsd = _find(data, [b"mdia", b"minf", b"stbl", b"stsd"], a, b)
        if not stsd:
            raise MediaError("no sample description")
        entry = stsd[0] + 8
        codec = data[entry + 4 : entry + 8]
        width, height = struct.unpack_from(">HH", data, entry + 32)
        (depth,) = struct.unpack_from(">H", data, entry + 82)
        scale, table = _times(data, a, b)
    except struct.error as e:
        raise MediaError(f"cut off: {e}") from None
    frames, ticks = sum(c for c, _ in table), sum(c * d for c, d in table)
    return {
        "width": width, "height": height, "codec": CODEC_NAMES.get(codec, codec.decode("latin-1").strip()), "bit_depth": 10 if depth == 30 else 8,
        "fps": frames * scale / ticks if ticks else 0.0, "duration": ticks / scale if scale else 0.0, "frame_count": frames,
    }


def mov_keyframes(data: bytes, at_start: bool = False) -> list[tuple[int, float]]:
    """(frame from 1, seconds) of the sync frames, or of about one frame a second if there is no table of them.

    Times are the end of a frame, as in the import log; `at_start` gives its start.
    """
    try:
        a, b = _video_track(data)
        scale, table = _times(data, a, b)
        sync = _find(data, [b"mdia", b"minf", b"stbl", b"stss"], a, b)
        counts = np.array([c for c, _ in table], np.int64)
        deltas = np.repeat(np.array([d for _, d in table], np.int64), counts)
        if sync:
            (n,) = struct.unpack_from(">I", data, sync[0] + 4)
            frames = np.frombuffer(data, ">u4", n, sync[0] + 8).astype(np.int64)
        else:
            fps = len(deltas) * scale / deltas.sum() if len(deltas) and deltas.sum() and scale else 24.0
            frames = np.arange(1, len(deltas) + 1, int(max(fps, 1.0)))
    except (struct.error, ValueError) as e:
        raise MediaError(f"cut off: {e}") from None
    frames = frames[(frames >= 1) & (frames <= len(deltas))]
    ends = np.cumsum(deltas)
    ticks = ends[frames - 1] - (deltas[frames - 1] if at_start else 0)
    return [(int(f), float(t) / scale if scale else 0.0) for f, t in zip(frames, ticks)]


# Encoders: small files of known content, for round trips and for interchange.


def dpx_bytes(width: int, height: int, values: np.ndarray, depth: int = 10, big: bool = True, transfer: int = 1) -> bytes:
    """A DPX file of values n x 3 in 0..1, row by row."""
    order = ">" if big else "<"
    head = bytearray(DPX_HEADER)
    head[:4] = b"SDPX" if big else b"XPDS"
    struct.pack_into(order + "I", head, 4, DPX_HEADER)
    struct.pack_into(order + "HHII", head, 768, 0, 1, width, height)
    struct.pack_into(order + "BBBBHHI", head, 800, 50, transfer, transfer, depth, 0, 0, DPX_HEADER)
    codes = np.floor(np.clip(values, 0, 1) * ((1 << depth) - 1) + 0.5).astype(np.uint32)
    if depth == 10:
        body = (codes[:, 0] << 20 | codes[:, 1] << 10 | codes[:, 2]).astype(order + "u4").tobytes()
    else:
        body = codes.astype("u1" if depth == 8 else order + "u2").tobytes()
    return bytes(head) + body


def ppm_bytes(width: int, height: int, values: np.ndarray, top: int = 255) -> bytes:
    codes = np.floor(np.clip(values, 0, 1) * top + 0.5).astype("u1" if top < 256 else ">u2")
    return f"P6\n# image\n{width} {height}\n{top}\n".encode() + codes.tobytes()


def exr_bytes(width: int, height: int, values: np.ndarray, kind: str = "float", compression: str = "none") -> bytes:
    """A single-part scan-line EXR file of values n x 3."""

    def attr(name: str, type_: str, body: bytes) -> bytes:
        return name.encode() + b"\0" + type_.encode() + b"\0" + struct.pack("<I", len(body)) + body

    code = {"half": 1, "float": 2}[kind]
    item = {"half": "<f2", "float": "<f4"}[kind]
    channels = b"".join(c.encode() + b"\0" + struct.pack("<iB3xii", code, 0, 1, 1) for c in "BGR") + b"\0"
    box = struct.pack("<4i", 0, 0, width - 1, height - 1)
    head = b"\x76\x2f\x31\x01" + struct.pack("<I", 2)
    head += attr("channels", "chlist", channels) + attr("compression", "compression", bytes([EXR_COMPRESSION.index(compression)])) + attr("dataWindow", "box2i", box) + attr("displayWindow", "box2i", box)
    head += attr("lineOrder", "lineOrder", b"\0") + attr("pixelAspectRatio", "float", struct.pack("<f", 1)) + attr("screenWindowCenter", "v2f", bytes(8)) + attr("screenWindowWidth", "float", struct.pack("<f", 1)) + b"\0"
    lines = 16 if compression == "zip" else 1
    v, blocks = values.reshape(height, width, 3), []
    for y in range(0, height, lines):
        raw = b"".join(v[row, :, "RGB".index(c)].astype(item).tobytes() for row in range(y, min(y + lines, height)) for c in "BGR")
        if compression != "none":
            b = np.frombuffer(raw, np.uint8)
            split = np.concatenate([b[0::2], b[1::2]]).astype(np.int64)
            delta = np.concatenate([split[:1], (split[1:] - split[:-1] + 128) & 255]).astype(np.uint8)
            packed = _runs(delta.tobytes()) if compression == "rle" else zlib.compress(delta.tobytes())
            raw = packed if len(packed) < len(raw) else raw
        blocks.append(struct.pack("<ii", y, len(raw)) + raw)
    at, offsets = len(head) + 8 * len(blocks), []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    return head + struct.pack(f"<{len(offsets)}Q", *offsets) + b"".join(blocks)


def _runs(raw: bytes) -> bytes:
    """Run lengths of bytes: runs of three and more as a count, all else plain."""
    out, at, plain = bytearray(), 0, 0
    while at <= len(raw):
        end = at + 1
        while end < len(raw) and at < len(raw) and raw[end] == raw[at] and end - at < 128:
            end += 1
        if at == len(raw) or end - at >= 3:
            for i in range(plain, at, 127):
                part = raw[i : min(i + 127, at)]
                out += bytes([256 - len(part)]) + part
            if at < len(raw):
                out += bytes([end - at - 1, raw[at]])
            plain = end
        at = end
    return bytes(out)


def mov_bytes(width: int, height: int, scale: int, table: list[tuple[int, int]], codec: bytes = b"avc1", sync: list[int] | None = None) -> bytes:
    """A film file without frames: header boxes with a time table and, if given, sync frames."""

    def box(kind: bytes, *parts: bytes) -> bytes:
        body = b"".join(parts)
        return struct.pack(">I4s", len(body) + 8, kind) + body

    entry = bytes(8) + bytes(16) + struct.pack(">HH", width, height) + bytes(12) + struct.pack(">H", 1) + bytes(32) + struct.pack(">Hh", 24, -1)
    stsd = box(b"stsd", struct.pack(">II", 0, 1), box(codec, entry))
    stts = box(b"stts", struct.pack(">II", 0, len(table)), *(struct.pack(">II", *t) for t in table))
    stss = box(b"stss", struct.pack(">II", 0, len(sync)), *(struct.pack(">I", s) for s in sync)) if sync is not None else b""
    ticks = sum(c * d for c, d in table)
    mdhd = box(b"mdhd", struct.pack(">IIIII", 0, 0, 0, scale, ticks), bytes(4))
    hdlr = box(b"hdlr", bytes(8), b"vide", bytes(13))
    trak = box(b"trak", box(b"mdia", mdhd, hdlr, box(b"minf", box(b"stbl", stsd, stts, stss))))
    return box(b"ftyp", b"qt  ", bytes(4)) + box(b"moov", trak)


HEADERS: dict[str, Callable[[bytes], dict]] = {"dpx": dpx_header, "exr": exr_header, "mov": mov_header}
PIXELS: dict[str, Callable[[bytes], tuple[int, int, np.ndarray]]] = {"dpx": dpx_pixels, "exr": exr_pixels, "ppm": ppm_pixels, "png": png_pixels}
HEADER_SCHEMA = (
    "path string, filename string, format string, width long, height long, bit_depth long, transfer string, colorimetric string, descriptor string, compression string, "
    "codec string, fps double, duration double, frame_count long, error string"
)


def read_headers(files: DataFrame) -> DataFrame:
    """Header fields of scanned files (with content); broken ones have only `error`."""
    fields = [c.split()[0] for c in HEADER_SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = []
            for path, name, kind, data in zip(x["path"], x["filename"], x["format"], x["content"]):
                try:
                    h, error = HEADERS[kind](data), None
                except (MediaError, KeyError) as e:
                    h, error = {}, str(e)
                rows.append({"path": path, "filename": name, "format": kind, "error": error} | {k: h.get(k) for k in fields[3:-1]})
            yield pd.DataFrame(rows, columns=fields)

    return files.select("path", "filename", "format", "content").mapInPandas(run, HEADER_SCHEMA)


PIXEL_SCHEMA = "path string, width long, height long, x long, y long, r double, g double, b double, error string"


def small_size(width: int, height: int, longest: int | None) -> tuple[int, int]:
    """The size that keeps the aspect and has at most `longest` points a side."""
    if longest is None or max(width, height) <= longest:
        return width, height
    scale = longest / max(width, height)
    return tuple(max(int(np.floor(n * scale + 0.5)), 1) for n in (width, height))


def box_means(values: np.ndarray, width: int, height: int, longest: int | None) -> tuple[int, int, np.ndarray]:
    """(width, height, values) after averaging the source box of every target point; boxes of neighbours may share a line.

    Lines are averaged first, then points of a line: a box is the same mean either way, and no sum over the image is held.
    """
    nw, nh = small_size(width, height, longest)
    if (nw, nh) == (width, height):
        return width, height, values
    v = values.reshape(height, width, 3)
    t = np.arange(nh)
    lo, hi = t * height // nh, -(-(t + 1) * height // nh)
    lines = np.stack([v[a:b].mean(axis=0) for a, b in zip(lo, hi)])
    t = np.arange(nw)
    lo, hi = t * width // nw, -(-(t + 1) * width // nw)
    return nw, nh, np.stack([lines[:, a:b].mean(axis=1) for a, b in zip(lo, hi)], axis=1).reshape(-1, 3)


def read_pixels(files: DataFrame, longest: int | None = None) -> DataFrame:
    """(path, width, height, x, y, r, g, b, error): one row per point, in bounded batches; a file that can't be decoded is one row with `error`.

    With `longest` an image is brought down to that many points a side in the task that
    decodes it, so only the small image is ever a table.
    """
    names = [c.split()[0] for c in PIXEL_SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for path, kind, data in zip(x["path"], x["format"], x["content"]):
                try:
                    w, h, v = box_means(*_decoded(kind, data), longest)
                except MediaError as e:
                    yield pd.DataFrame([(path, *[None] * 7, str(e))], columns=names)
                    continue
                for at in range(0, len(v), 65536):
                    part = v[at : at + 65536]
                    i = np.arange(at, at + len(part))
                    yield pd.DataFrame({"path": path, "width": w, "height": h, "x": i % w, "y": i // w, "r": part[:, 0], "g": part[:, 1], "b": part[:, 2], "error": None})

    return files.select("path", "format", "content").mapInPandas(run, PIXEL_SCHEMA)


def _decoded(kind: str | None, data: bytes | None) -> tuple[np.ndarray, int, int]:
    if kind not in PIXELS:
        raise MediaError(f"no pixels are read from {kind!r}")
    w, h, v = PIXELS[kind](data or b"")
    return v, w, h


def read_keyframes(files: DataFrame, at_start: bool = False) -> DataFrame:
    """(path, frame_number, timestamp_secs, error) of films; a broken one is one row with `error`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for path, data in zip(x["path"], x["content"]):
                try:
                    k = mov_keyframes(data, at_start)
                except MediaError as e:
                    yield pd.DataFrame([(path, None, None, str(e))], columns=["path", "frame_number", "timestamp_secs", "error"])
                    continue
                yield pd.DataFrame({"path": path, "frame_number": [f for f, _ in k], "timestamp_secs": [t for _, t in k], "error": None})

    return files.where("format = 'mov'").select("path", "content").mapInPandas(run, "path string, frame_number long, timestamp_secs double, error string")


def extract_frames(films: DataFrame, command: Callable[[str, str], list[str]], folder: str, timeout: int = 3600) -> DataFrame:
    """(path, folder, error): runs an external tool once a film, on the cluster, that writes its frames (PPM, JPEG) into a folder of their own.

    `command(path, target)` gives the tool's arguments; read the result with `scan` and
    `read_pixels`. A missing tool, an error or a timeout is told in `error`, the other films
    go on. `folder` is one that all executors share.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import os
        import subprocess

        for x in frames:
            rows = []
            for path in x["path"]:
                target, error = os.path.join(folder, hashlib.sha1(path.encode()).hexdigest()), None
                try:
                    os.makedirs(target, exist_ok=True)
                    done = subprocess.run(command(path, target), capture_output=True, timeout=timeout, check=False)
                    if done.returncode:
                        error = done.stderr.decode("utf-8", "replace")[-500:] or f"exit code {done.returncode}"
                except (OSError, subprocess.TimeoutExpired) as e:
                    error = str(e)
                rows.append((path, target, error))
            yield pd.DataFrame(rows, columns=["path", "folder", "error"])

    return films.select("path").mapInPandas(run, "path string, folder string, error string")


def frame_command(interval: float = 1.0, most: int | None = None, tool: str = "ffmpeg") -> Callable[[str, str], list[str]]:
    """Frames every `interval` seconds as PPM files, at most `most`."""
    return lambda path, target: [tool, "-v", "error", "-i", path, "-vf", f"fps=1/{interval:g}", *(["-frames:v", str(most)] if most else []), f"{target}/%08d.ppm"]


def keyframe_command(tool: str = "ffmpeg") -> Callable[[str, str], list[str]]:
    """Every sync frame as a JPEG file."""
    return lambda path, target: [tool, "-v", "error", "-skip_frame", "nokey", "-i", path, "-vsync", "vfr", f"{target}/%08d.jpg"]


def audio_command(rate: int = 8000, tool: str = "ffmpeg") -> Callable[[str, str], list[str]]:
    """The sound as one raw file of 16-bit mono samples, which `pcm_samples` reads."""
    return lambda path, target: [tool, "-v", "error", "-i", path, "-vn", "-ac", "1", "-ar", str(rate), "-f", "s16le", f"{target}/audio.pcm"]


def pcm_samples(files: DataFrame) -> DataFrame:
    """(track, pos, sample) of raw little-endian 16-bit mono files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for path, data in zip(x["path"], x["content"]):
                v = np.frombuffer(data, "<i2", len(data) // 2)
                for at in range(0, len(v), 65536):
                    yield pd.DataFrame({"track": path, "pos": np.arange(at, min(at + 65536, len(v))), "sample": v[at : at + 65536].astype(np.int32)})

    return files.select("path", "content").mapInPandas(run, "track string, pos long, sample int")


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """Dataset images (dpx, exr) with the JSON file of the same stem: (image_path, stem, has_sidecar, material_type, color_space, grading_style_tags)."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    images = scan(spark, folder, ("dpx", "exr")).select(F.col("path").alias("image_path"), stem(F.col("path")).alias("stem"))
    text = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    body = F.from_json(F.decode("content", "utf-8"), "material_type string, color_space string, grading_style_tags array<string>")
    side = text.select(stem(F.col("path")).alias("stem"), body.alias("j"), F.lit(True).alias("has_sidecar"))
    return images.join(side, "stem", "left").select("image_path", "stem", F.coalesce("has_sidecar", F.lit(False)).alias("has_sidecar"), "j.*").orderBy("image_path")


# Feature and embedding blobs.


def floats(column: str, kind: str = "double") -> Column:
    """A little-endian float64 ('double') or float32 ('float') blob as an array; null if the length is no multiple of the item."""
    from pyspark.sql import types as T

    item, out = ("<f8", T.DoubleType()) if kind == "double" else ("<f4", T.FloatType())
    size = int(item[-1])

    @F.pandas_udf(T.ArrayType(out))
    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None or len(b) % size else np.frombuffer(b, item))

    return decode(F.col(column))


def blob(column: str, kind: str = "double") -> Column:
    """The reverse of `floats`."""
    item = "<f8" if kind == "double" else "<f4"

    @F.pandas_udf("binary")
    def encode(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else np.asarray(a, item).tobytes())

    return encode(F.col(column))


def combined_features(column: str, bins: int = 64) -> list[Column]:
    """hist_l, hist_a, hist_b and moments out of one blob of 3 * bins + 12 doubles, by position; null for other lengths."""
    v = floats(column)
    sound = F.octet_length(column) == 8 * (3 * bins + 12)
    parts = [("hist_l", 1, bins), ("hist_a", 1 + bins, bins), ("hist_b", 1 + 2 * bins, bins), ("moments", 1 + 3 * bins, 12)]
    return [F.when(sound, F.slice(v, at, n)).alias(name) for name, at, n in parts]
