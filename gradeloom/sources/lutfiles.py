"""LUT and grade files: parse and write .cube, .3dl, .look, .csp, color decisions and stored grades.

Tables are held as (title, size, domain, values): values are n**3 x 3, red fastest, whatever the
file's own order; .3dl files run with blue fastest and are turned around on the way in and out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from gradeloom.operators.lut import INDEX, Cdl, LutError, PowerGrade, check_grid

QUOTES = {"'": "&apos;", '"': "&quot;"}


@dataclass
class Table:
    size: int
    values: np.ndarray
    title: str | None = None
    domain: tuple[tuple[float, ...], tuple[float, ...]] = ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0))

    def checked(self) -> Table:
        check_grid(self.size)
        if self.values.shape != (self.size**3, 3) or not np.isfinite(self.values).all():
            raise LutError(f"{self.values.shape[0]} points in a table of {self.size} a side")
        if any(a >= b for a, b in zip(*self.domain)):
            raise LutError("the domain is empty")
        return self


def _turned(values: np.ndarray, n: int) -> np.ndarray:
    """From blue fastest to red fastest, or back."""
    return values.reshape(n, n, n, 3).transpose(2, 1, 0, 3).reshape(-1, 3)


def _numbers(lines: list[str]) -> np.ndarray:
    try:
        rows = [[float(x) for x in line.split()] for line in lines]
    except ValueError as e:
        raise LutError(f"not a number: {e}") from None
    if any(len(r) != 3 for r in rows):
        raise LutError("a row without three values")
    return np.array(rows, float).reshape(-1, 3)


def parse_cube(text: str) -> Table:
    title, size, lo, hi, rows = None, None, (0.0,) * 3, (1.0,) * 3, []
    for line in map(str.strip, text.splitlines()):
        word = line.split(None, 1)[0].upper() if line else ""
        rest = line[len(word) :].strip()
        if not line or line[0] == "#":
            continue
        if word == "TITLE":
            title = rest.strip('"')
        elif word == "LUT_3D_SIZE":
            size = int(rest) if rest.isdigit() else None
        elif word in ("DOMAIN_MIN", "DOMAIN_MAX"):
            v = tuple(_numbers([rest])[0])
            lo, hi = (v, hi) if word == "DOMAIN_MIN" else (lo, v)
        elif word[0].isdigit() or word[0] in "+-.":
            rows.append(line)
    if size is None:
        raise LutError("no LUT_3D_SIZE")
    return Table(size, _numbers(rows), title, (lo, hi)).checked()


def write_cube(t: Table) -> str:
    head = ([f'TITLE "{t.title}"'] if t.title else []) + [f"LUT_3D_SIZE {t.size}"]
    head += [f"DOMAIN_{n} " + " ".join(f"{x:.6f}" for x in v) for n, v in zip(("MIN", "MAX"), t.domain)]
    return "\n".join([*head, *_rows(t.values)]) + "\n"


def _rows(values: np.ndarray) -> list[str]:
    return ["%.6f %.6f %.6f" % tuple(v) for v in values]


def code_range(top: float) -> int:
    """The full scale that integer codes up to `top` suggest."""
    return next((m for m in (255, 1023, 4095) if top <= m), 65535)


def parse_3dl(text: str) -> Table:
    size, rows, first = None, [], True
    for line in map(str.strip, text.splitlines()):
        if not line or line[0] in "#<":
            continue
        parts = line.split()
        if parts[0].lower() == "mesh":
            size = (1 << int(parts[1])) + 1
            continue
        if not parts[0].lstrip("+-").isdigit():
            continue
        if first and len(parts) != 3:  # the input ramp
            first = False
            continue
        first = False
        rows.append(line)
    v = _numbers(rows)
    size = size or round(len(v) ** (1 / 3))
    if size < 2 or len(v) != size**3:
        if len(v) > 1 and round((len(v) - 1) ** (1 / 3)) ** 3 == len(v) - 1:  # a ramp of three values looks like a row
            v, size = v[1:], round((len(v) - 1) ** (1 / 3))
    return Table(size, _turned(v / code_range(v.max(initial=0.0)), size) if len(v) == size**3 else v).checked()


def write_3dl(t: Table, bits: int = 12) -> str:
    top = (1 << min(max(bits, 1), 30)) - 1
    ramp = " ".join(str(int(np.floor(i / (t.size - 1) * top + 0.5))) for i in range(t.size))
    codes = np.floor(np.clip(_turned(t.values, t.size), 0, 1) * top + 0.5).astype(int)
    return "\n".join([ramp, *("%d %d %d" % tuple(c) for c in codes)]) + "\n"


def parse_look(text: str) -> Table:
    head = re.search(r"<LUT3D\s[^>]*size\s*=\s*\"(\d+)\"[^>]*>(.*?)</LUT3D>", text, re.S | re.I)
    if not head:
        raise LutError("no LUT3D element")
    title = re.search(r"<Title>(.*?)</Title>", text, re.S)
    rows = [x for x in map(str.strip, head[2].splitlines()) if x]
    return Table(int(head[1]), _numbers(rows), unescape(title[1], {b: a for a, b in QUOTES.items()}) if title else None).checked()


def write_look(t: Table) -> str:
    title = [f"  <Title>{escape(t.title, QUOTES)}</Title>"] if t.title else []
    return "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', "<Look>", *title, f'  <LUT3D size="{t.size}">', *("    " + r for r in _rows(t.values)), "  </LUT3D>", "</Look>"]) + "\n"


def parse_csp(text: str) -> Table:
    lines = [x for x in map(str.strip, text.splitlines()) if x]
    if len(lines) < 2 or lines[0] != "CSPLUTV100" or lines[1] != "3D":
        raise LutError("not a 3D table of this kind")
    at, title = 2, None
    if at < len(lines) and lines[at].upper() == "BEGIN METADATA":
        end = next((i for i in range(at, len(lines)) if lines[i].upper() == "END METADATA"), None)
        if end is None:
            raise LutError("metadata without end")
        title, at = " ".join(lines[at + 1 : end]) or None, end + 1
    at += 9  # three ramps: count, inputs, outputs
    if at >= len(lines):
        raise LutError("cut off")
    dims = lines[at].split()
    if len(dims) != 3 or len(set(dims)) != 1 or not dims[0].isdigit():
        raise LutError("sides of different size")
    return Table(int(dims[0]), _numbers(lines[at + 1 :]), title).checked()


def write_csp(t: Table) -> str:
    ramp = " ".join(f"{i / (t.size - 1):.6f}" for i in range(t.size))
    return "\n".join(["CSPLUTV100", "3D", "", *[str(t.size), ramp, ramp] * 3, f"{t.size} {t.size} {t.size}", *_rows(t.values)]) + "\n"


def _element(text: str, name: str, n: int) -> tuple[float, ...] | None:
    m = re.search(rf"<{name}>\s*([^<]*?)\s*</{name}>", text, re.I)
    if not m:
        return None
    try:
        v = tuple(float(x) for x in m[1].split())
    except ValueError:
        raise LutError(f"{name} isn't numeric") from None
    if len(v) != n:
        raise LutError(f"{name} has {len(v)} values")
    return v


def parse_cdl(text: str) -> Cdl:
    """Missing elements keep their neutral values."""
    d = Cdl()
    s = _element(text, "Saturation", 1)
    return Cdl(_element(text, "Slope", 3) or d.slope, _element(text, "Offset", 3) or d.offset, _element(text, "Power", 3) or d.power, s[0] if s else d.saturation)


def write_cdl(c: Cdl, name: str = "grade") -> str:
    v = lambda x: " ".join(f"{k:.6f}" for k in x)
    return "\n".join(
        ['<?xml version="1.0" encoding="UTF-8"?>', "<ColorDecision>", f'  <ColorCorrection id="{escape(name, QUOTES)}">', "    <SOPNode>", f"      <Slope>{v(c.slope)}</Slope>", f"      <Offset>{v(c.offset)}</Offset>",
         f"      <Power>{v(c.power)}</Power>", "    </SOPNode>", "    <SatNode>", f"      <Saturation>{c.saturation:.6f}</Saturation>", "    </SatNode>", "  </ColorCorrection>", "</ColorDecision>"]
    ) + "\n"


def parse_powergrade(data: bytes) -> PowerGrade:
    """Text grades of version 2 and 3; version 1 and binary files are refused."""
    if len(data) < 4:
        raise LutError("too short for a grade")
    head = re.search(r"version ([123])", data[:256].decode("utf-8", "ignore"), re.I)
    if not head:
        raise LutError("no known version" if data[0] >= 0x20 else "an unknown binary grade")
    if head[1] == "1":
        raise LutError("version 1 isn't supported")
    try:
        lines = data.decode("utf-8").splitlines()
    except UnicodeDecodeError as e:
        raise LutError(f"not text: {e}") from None
    found: dict[str, object] = {"version": int(head[1])}
    for line in lines:
        m = re.match(r"\s*(gamma|gain|lift|power|offset|saturation|nodes)\b[\s=:]*(.*)", line)
        if not m:
            continue
        v = [float(x) for x in m[2].split() if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", x)]
        if m[1] in ("gamma", "saturation") and len(v) == 1:
            found[m[1]] = v[0]
        elif m[1] == "nodes" and len(v) == 1:
            found["nodes"] = int(v[0])
        elif m[1] in ("gain", "lift", "power", "offset") and len(v) in (1, 3):
            found[m[1]] = tuple(v) if len(v) == 3 else (v[0],) * 3
    return PowerGrade(**found)


PARSERS = {"cube": parse_cube, "3dl": parse_3dl, "look": parse_look, "csp": parse_csp}
WRITERS = {"cube": write_cube, "3dl": write_3dl, "look": write_look, "csp": write_csp}


def parse_bytes(data: bytes, kind: str, size: int = 33) -> Table:
    """A table by format name; a color decision is sampled on a grid of `size`."""
    kind = kind.lower().lstrip(".")
    if kind in ("cdl", "cc", "ccc"):
        return cdl_table(parse_cdl(data.decode("utf-8", "replace")), size)
    if kind not in PARSERS:
        raise LutError(f"unknown format: {kind!r}")
    return PARSERS[kind](data.decode("utf-8", "replace"))


def cdl_table(c: Cdl, n: int) -> Table:
    g = np.arange(n) / (n - 1)
    x = np.stack([np.tile(g, n * n), np.tile(np.repeat(g, n), n), np.repeat(g, n * n)], axis=1)
    x = np.maximum(x * c.slope + c.offset, 0) ** np.array(c.power)
    y = (x @ np.array([0.2126, 0.7152, 0.0722]))[:, None]
    return Table(n, y + c.saturation * (x - y)).checked()


def read_luts(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, size, error, ri, gi, bi, r, g, b): the points of all table files under a path; a broken file is one row with `error`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{cube,3dl,look,csp,cdl,CUBE,3DL,LOOK,CSP,CDL}").load(path).select("path", "content")
    schema = "path string, title string, size int, error string, ri int, gi int, bi int, r double, g double, b double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for name, data in zip(x["path"], x["content"]):
                try:
                    t = parse_bytes(data, name.rsplit(".", 1)[-1])
                except LutError as e:
                    yield pd.DataFrame({"path": [name], "title": None, "size": None, "error": str(e), "ri": None, "gi": None, "bi": None, "r": None, "g": None, "b": None})
                    continue
                i = np.arange(t.size**3)
                yield pd.DataFrame(
                    {"path": name, "title": t.title, "size": t.size, "error": None, "ri": i % t.size, "gi": i // t.size % t.size, "bi": i // t.size**2, "r": t.values[:, 0], "g": t.values[:, 1], "b": t.values[:, 2]}
                )

    return files.mapInPandas(run, schema)


def to_table(lut: DataFrame, n: int, title: str | None = None) -> Table:
    """The points of one table on the driver, to be written as a file; at most 256**3 of them."""
    x = lut.select(*INDEX, "r", "g", "b").toPandas()
    if len(x) != n**3:
        raise LutError(f"{len(x)} points in a table of {n} a side")
    x = x.sort_values(["bi", "gi", "ri"])
    return Table(n, x[["r", "g", "b"]].to_numpy(float), title).checked()


def from_table(spark: SparkSession, t: Table) -> DataFrame:
    i = np.arange(t.size**3)
    frame = pd.DataFrame({"ri": i % t.size, "gi": i // t.size % t.size, "bi": i // t.size**2, "r": t.values[:, 0], "g": t.values[:, 1], "b": t.values[:, 2]})
    return spark.createDataFrame(frame, "ri int, gi int, bi int, r double, g double, b double")


def export_lut(lut: DataFrame, n: int, path: str, title: str | None = None) -> str:
    """Writes a table file by its extension; an existing file isn't overwritten and a color decision can't hold a table."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in WRITERS:
        raise LutError(f"tables can't be written as {kind!r}")
    text = WRITERS[kind](to_table(lut, n, title))
    with open(path, "x", encoding="utf-8") as f:
        f.write(text)
    return path
