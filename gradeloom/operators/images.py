"""Operators that need a whole image at once: segmentation, the polar picture of a film, PNG files.

One image is one group of bounded size (the importers downsample to 512 points a side), so
`applyInPandas` holds one image per task; images are spread over tasks by their key.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.features import grading_features


def slic_labels(lab: np.ndarray, segments: int, compactness: float = 0.1, rounds: int = 10) -> np.ndarray:
    """Superpixel labels (height x width) of an Oklab image.

    Seeds lie on a grid, moved to the lowest gradient of their 3 x 3 surroundings; each
    pixel joins the seed within two steps that is nearest in color and place; small pieces
    that hang nowhere together join a neighbour.
    """
    h, w, _ = lab.shape
    step = max(1.0, np.sqrt(h * w / max(segments, 1)))
    ys, xs = np.arange(step / 2, h, step).astype(int), np.arange(step / 2, w, step).astype(int)
    gy, gx = np.gradient(lab, axis=0) if h > 1 else np.zeros_like(lab), np.gradient(lab, axis=1) if w > 1 else np.zeros_like(lab)
    edge = (gy**2 + gx**2).sum(2)
    seeds = []
    for y in ys:
        for x in xs:
            y0, x0 = max(y - 1, 0), max(x - 1, 0)
            part = edge[y0 : y + 2, x0 : x + 2]
            dy, dx = np.unravel_index(int(part.argmin()), part.shape)
            seeds.append((y0 + dy, x0 + dx))
    at = np.array(seeds, float)
    color = lab[at[:, 0].astype(int), at[:, 1].astype(int)]
    yy, xx = np.mgrid[0:h, 0:w]
    label = np.zeros((h, w), int)
    for _ in range(rounds):
        best = np.full((h, w), np.inf)
        for k, ((cy, cx), c) in enumerate(zip(at, color)):
            y0, y1, x0, x1 = int(max(cy - 2 * step, 0)), int(min(cy + 2 * step + 1, h)), int(max(cx - 2 * step, 0)), int(min(cx + 2 * step + 1, w))
            d = ((lab[y0:y1, x0:x1] - c) ** 2).sum(2) + ((yy[y0:y1, x0:x1] - cy) ** 2 + (xx[y0:y1, x0:x1] - cx) ** 2) * (compactness / step) ** 2
            win = d < best[y0:y1, x0:x1]
            best[y0:y1, x0:x1][win] = d[win]
            label[y0:y1, x0:x1][win] = k
        n = np.bincount(label.ravel(), minlength=len(at))
        has = n > 0
        new = np.stack([np.bincount(label.ravel(), v.ravel(), len(at)) for v in (yy, xx)], 1)
        moved = np.abs(new[has] / n[has, None] - at[has]).max() if has.any() else 0
        at[has] = new[has] / n[has, None]
        color[has] = np.stack([np.bincount(label.ravel(), lab[..., j].ravel(), len(at)) for j in range(3)], 1)[has] / n[has, None]
        if moved < 0.5:
            break
    return connected(label, int(step * step / 4))


def connected(label: np.ndarray, least: int) -> np.ndarray:
    """New labels of the connected pieces of equal label; pieces under `least` pixels take the label met before them."""
    h, w = label.shape
    out = np.full((h, w), -1)
    count = 0
    for y in range(h):
        for x in range(w):
            if out[y, x] >= 0:
                continue
            before = out[y, x - 1] if x else (out[y - 1, x] if y else -1)
            stack, piece = [(y, x)], [(y, x)]
            out[y, x] = count
            while stack:
                a, b = stack.pop()
                for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                    if 0 <= c < h and 0 <= d < w and out[c, d] < 0 and label[c, d] == label[y, x]:
                        out[c, d] = count
                        stack.append((c, d))
                        piece.append((c, d))
            if len(piece) < least and before >= 0:
                i = np.array(piece)
                out[i[:, 0], i[:, 1]] = before
            else:
                count += 1
    return out


def whole(p: pd.DataFrame, y: str, x: str, values: list[str]) -> tuple[np.ndarray, pd.DataFrame]:
    """(height x width x values, its pixels): repeated places count once, the least values first; missing or NaN ones take the image's mean."""
    p = p.dropna(subset=[y, x]).sort_values([y, x, *values]).drop_duplicates([y, x])
    if not len(p):
        return np.zeros((0, 0, len(values))), p
    at, v = p[[y, x]].to_numpy(int), p[values].to_numpy(float)
    known = ~np.isnan(v)
    mean = np.where(known, v, 0).sum(0) / np.maximum(known.sum(0), 1)
    grid = np.broadcast_to(mean, (at[:, 0].max() + 1, at[:, 1].max() + 1, len(values))).copy()
    grid[at[:, 0], at[:, 1]] = np.where(known, v, mean)
    return grid, p


def segment_images(pixels: DataFrame, key: str = "image", segments: int = 64, compactness: float = 0.1) -> DataFrame:
    """(key, x, y, r, g, b, label) of images in long form with ok_l, ok_a, ok_b.

    Every pixel with a place comes out once; missing ones are filled for the labelling only.
    """
    kind = pixels.schema[key].dataType.simpleString()

    def run(p: pd.DataFrame) -> pd.DataFrame:
        lab, p = whole(p, "y", "x", ["ok_l", "ok_a", "ok_b"])
        out = p[[key, "x", "y", "r", "g", "b"]]
        if not len(out):
            return out.assign(label=0)
        return out.assign(label=slic_labels(lab, segments, compactness)[p["y"].to_numpy(int), p["x"].to_numpy(int)])

    return pixels.groupBy(key).applyInPandas(run, f"{key} {kind}, x long, y long, r double, g double, b double, label int")


def segment_features(labelled: DataFrame, key: str = "image", bins: int = 64) -> DataFrame:
    """Box, size and grading features of each segment."""
    box = labelled.groupBy(key, "label").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("pixels"))
    return box.join(grading_features(labelled, [key, "label"], bins), [key, "label"])


#: Taps of the blur over neighbouring frames (Gaussian, sigma 1.2).
TAPS = tuple(float(np.exp(-(k * k) / (2 * 1.2 * 1.2))) for k in (-2, -1, 0, 1, 2))


def bilinear(strip: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values of a (rows, frames, 3) strip at fractional places, clamped at the edges."""
    h, w, _ = strip.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    return (strip[y0, x0] * (1 - fx) + strip[y0, x1] * fx) * (1 - fy) + (strip[y1, x0] * (1 - fx) + strip[y1, x1] * fx) * fy


def iris(strip: np.ndarray, size: int = 512, inner: float = 0.15) -> np.ndarray:
    """A film as rings: frames run from the centre outwards, rows around; four samples a pixel, blurred over frames and then 3 x 3."""
    if not 2 <= size <= 4096:
        raise ValueError("size must be within 2 and 4096")
    h, w, _ = strip.shape
    out = np.zeros((size, size, 3))
    hits = np.zeros((size, size, 1))
    taps = np.array(TAPS) / sum(TAPS)
    for sy in (0.25, 0.75):
        for sx in (0.25, 0.75):
            gy, gx = np.mgrid[0:size, 0:size].astype(float)
            dy, dx = (gy + sy) / size * 2 - 1, (gx + sx) / size * 2 - 1
            r = np.hypot(dx, dy)
            inside = (r <= 1) & (r >= inner)
            frame = (r - inner) / (1 - inner) * (w - 1)
            row = np.mod(np.arctan2(dy, dx), 2 * np.pi) / (2 * np.pi) * (h - 1)
            v = sum(t * bilinear(strip, frame + k, row) for t, k in zip(taps, (-2, -1, 0, 1, 2)))
            out += np.where(inside[..., None], v, 0)
            hits += inside[..., None]
    out = np.where(hits > 0, out / np.maximum(hits, 1), 0)
    p = np.pad(out, ((1, 1), (1, 1), (0, 0)), mode="edge")
    blurred = sum(p[i : i + size, j : j + size] for i in range(3) for j in range(3)) / 9
    return np.where(hits > 0, blurred, 0)


def png(image: np.ndarray) -> bytes:
    """An 8-bit RGB PNG of values in 0..1 (height x width x 3)."""
    h, w, _ = image.shape
    raw = np.floor(np.clip(image, 0, 1) * 255 + 0.5).astype(np.uint8)
    lines = np.concatenate([np.zeros((h, 1), np.uint8), raw.reshape(h, -1)], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def strip_pictures(strip: DataFrame, size: int = 256) -> DataFrame:
    """(movie, strip_png, iris_png): each film's strip and its polar picture as PNG files; missing places have the film's mean color."""
    kind = strip.schema["movie"].dataType.simpleString()

    def run(p: pd.DataFrame) -> pd.DataFrame:
        v, p = whole(p, "row", "frame", ["r", "g", "b"])
        if not len(p):
            return pd.DataFrame({"movie": [], "strip_png": [], "iris_png": []})
        return pd.DataFrame({"movie": [p["movie"].iloc[0]], "strip_png": [png(v)], "iris_png": [png(iris(v, size))]})

    return strip.groupBy("movie").applyInPandas(run, f"movie {kind}, strip_png binary, iris_png binary")


def poster_layout(strip: DataFrame, thumbnails: int = 12) -> DataFrame:
    """(movie, position, frame): evenly spaced frames for a poster's thumbnails, with the film's mean color."""
    n = strip.groupBy("movie").agg((F.max("frame") + 1).alias("frames"), *[F.avg(c).alias(f"mean_{c}") for c in "rgb"])
    at = F.sequence(F.lit(0), F.least(F.lit(thumbnails), F.col("frames")).cast("int") - 1)
    x = n.select("movie", "frames", "mean_r", "mean_g", "mean_b", F.explode(at).alias("position"))
    k = F.least(F.lit(thumbnails), F.col("frames"))
    return x.select("movie", "position", F.floor((F.col("position") + 0.5) * F.col("frames") / k).cast("long").alias("frame"), "mean_r", "mean_g", "mean_b")
