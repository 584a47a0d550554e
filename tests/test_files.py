"""Files against bytes that the package's own writers had no part in, and damaged ones."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from gradeloom.sources import lutfiles, media, piz


def dpx(order, depth, body, width, height):
    head = bytearray(2048)
    head[0:4] = b"SDPX" if order == ">" else b"XPDS"
    struct.pack_into(order + "II", head, 772, width, height)
    head[800:804] = bytes([50, 3, 1, depth])
    struct.pack_into(order + "HHI", head, 804, 0, 0, 2048)
    return bytes(head) + body


def test_dpx_words_by_hand():
    word = (1023 << 22) | (512 << 12) | (1 << 2)  # not this packing: pixels fill the word from bit 29 down
    assert word != (1023 << 20) | (512 << 10) | 1
    body = struct.pack(">2I", (1023 << 20) | (512 << 10) | 1, (0 << 20) | (7 << 10) | 1023)
    w, h, v = media.dpx_pixels(dpx(">", 10, body, 2, 1))
    assert (w, h) == (2, 1) and np.allclose(v * 1023, [[1023, 512, 1], [0, 7, 1023]])
    _, _, v = media.dpx_pixels(dpx("<", 16, struct.pack("<6H", 65535, 0, 1, 2, 3, 4), 1, 2))
    assert np.allclose(v * 65535, [[65535, 0, 1], [2, 3, 4]])
    assert media.dpx_header(dpx(">", 10, body, 2, 1))["transfer"] == media.TRANSFER_NAMES[3]
    for bad in (b"", b"SDPX", dpx(">", 10, body[:5], 2, 1), dpx(">", 12, body, 2, 1), dpx(">", 10, body, 0, 1)):
        with pytest.raises(media.MediaError):
            media.dpx_pixels(bad)


def exr(channels, compression, blocks, width, height):
    """A scan-line file from packed blocks; channels are (name, 1 half or 2 float)."""

    def attr(name, kind, body):
        return name + b"\0" + kind + b"\0" + struct.pack("<i", len(body)) + body

    chlist = b"".join(n + b"\0" + struct.pack("<iB3xii", k, 0, 1, 1) for n, k in channels) + b"\0"
    box = struct.pack("<4i", 0, 0, width - 1, height - 1)
    head = struct.pack("<II", 20000630, 2) + attr(b"channels", b"chlist", chlist) + attr(b"compression", b"compression", bytes([compression]))
    head += attr(b"dataWindow", b"box2i", box) + attr(b"displayWindow", b"box2i", box) + attr(b"lineOrder", b"lineOrder", b"\0") + b"\0"
    at, table, body = len(head) + 8 * len(blocks), b"", b""
    for y, raw in blocks:
        table += struct.pack("<Q", at + len(body))
        body += struct.pack("<ii", y, len(raw)) + raw
    return head + table + body


def forward(v, wide):
    """The wavelet transform as the format defines it, one 2 x 2 block at a time."""
    h, w = v.shape

    def pair(a, b):
        if not wide:
            a, b = (x - 65536 if x > 32767 else x for x in (a, b))
            return (a + b >> 1) & 65535, a - b & 65535
        a = a + 32768 & 65535
        m, d = a + b >> 1, a - b
        if d < 0:
            m = m + 32768 & 65535
        return m, d & 65535

    v, p = [[int(x) for x in row] for row in v], 1
    while 2 * p <= min(h, w):
        y = 0
        while y <= h - 2 * p:
            x = 0
            while x <= w - 2 * p:
                a, b = pair(v[y][x], v[y][x + p])
                c, d = pair(v[y + p][x], v[y + p][x + p])
                v[y][x], v[y + p][x] = pair(a, c)
                v[y][x + p], v[y + p][x + p] = pair(b, d)
                x += 2 * p
            if w & p:
                v[y][x], v[y + p][x] = pair(v[y][x], v[y + p][x])
            y += 2 * p
        if h & p:
            x = 0
            while x <= w - 2 * p:
                v[y][x], v[y][x + p] = pair(v[y][x], v[y][x + p])
                x += 2 * p
        p *= 2
    return np.array(v)


def huffman_block(values, runs):
    """Values in codes of two lengths, as text of bits; the last symbol of the table says how often the one before is repeated."""
    used = sorted(set(values))
    last = used[-1] + 1
    n = max(2, (len(used) + 1).bit_length() + 1)
    lengths = {s: n - 1 if i == 0 else n for i, s in enumerate([*used, last])}
    table, code = {}, 0
    for k in (n, n - 1):  # longer codes are numbered first
        for s in sorted(x for x in lengths if lengths[x] == k):
            table[s] = format(code, f"0{k}b")
            code += 1
        code = (code + 1) >> 1 if k == n and code % 2 else code >> 1
    counts = {k: sum(v == k for v in lengths.values()) for k in (n, n - 1)}
    first = (counts[n]) >> 1
    for s in [x for x in lengths if lengths[x] == n - 1]:
        table[s] = format(first, f"0{n - 1}b")
        first += 1
    head, i = "", used[0]
    while i <= last:
        if i in lengths:
            head += format(lengths[i], "06b")
            i += 1
            continue
        gap = next(j for j in range(i, last + 1) if j in lengths) - i
        if gap >= 6:
            k = min(gap, 261)
            head += format(63, "06b") + format(k - 6, "08b")
        elif gap >= 2:
            k = gap
            head += format(59 + k - 2, "06b")
        else:
            k = 1
            head += format(0, "06b")
        i += k
    body, i = "", 0
    while i < len(values):
        k = 1
        while runs and i + k < len(values) and values[i + k] == values[i] and k < 256:
            k += 1
        body += table[values[i]]
        if k > 3:
            body += table[last] + format(k - 1, "08b")
        else:
            body += table[values[i]] * (k - 1)
        i += k
    pack = lambda bits: bytes(int(bits[j : j + 8].ljust(8, "0"), 2) for j in range(0, len(bits), 8))
    return struct.pack("<5I", used[0], last, len(pack(head)), len(body), 0) + pack(head) + pack(body)


def piz_block(planes, runs=True):
    """planes: per channel an array (height, width, words)."""
    every = np.concatenate([p.reshape(-1) for p in planes])
    values = sorted(set(every.tolist()) | {0})
    at = {v: i for i, v in enumerate(values)}
    bitmap = np.zeros(65536, np.uint8)
    bitmap[[v for v in values if v]] = 1
    packed = np.packbits(bitmap, bitorder="little")
    nz = np.flatnonzero(packed)
    lo, hi = (int(nz[0]), int(nz[-1])) if len(nz) else (8191, 0)
    out = []
    for p in planes:
        q = np.vectorize(at.__getitem__)(p)
        for j in range(p.shape[2]):
            q[:, :, j] = forward(q[:, :, j], len(values) - 1 >= 1 << 14)
        out += q.reshape(-1).tolist()
    huf = huffman_block(out, runs)
    return struct.pack("<HH", lo, hi) + (packed[lo : hi + 1].tobytes() if lo <= hi else b"") + struct.pack("<i", len(huf)) + huf


@pytest.mark.parametrize(("width", "height", "kind"), [(7, 5, "half"), (16, 32, "half"), (33, 40, "half"), (1, 9, "half"), (12, 10, "float")])
def test_piz(width, height, kind):
    rng = np.random.default_rng(width)
    v = np.round(np.abs(np.sin(np.arange(width * height * 3) / 9)).reshape(height, width, 3), 2)
    v[:, : width // 2] = rng.random()
    item, words = ("<f2", 1) if kind == "half" else ("<f4", 2)
    blocks = []
    for y in range(0, height, 32):
        part = v[y : y + 32]
        planes = [np.frombuffer(np.ascontiguousarray(part[:, :, "RGB".index(c)]).astype(item).tobytes(), "<u2").reshape(len(part), width, words) for c in "BGR"]
        raw = piz_block(planes)
        plain = b"".join(part[r, :, "RGB".index(c)].astype(item).tobytes() for r in range(len(part)) for c in "BGR")
        blocks.append((y, raw if len(raw) < len(plain) else plain))
        assert piz.unpacked(raw, width, len(part), [words] * 3) == plain
    w, h, got = media.exr_pixels(exr([(b"B", 1 if kind == "half" else 2), (b"G", 1 if kind == "half" else 2), (b"R", 1 if kind == "half" else 2)], 4, blocks, width, height))
    assert (w, h) == (width, height) and np.array_equal(got.reshape(height, width, 3), v.astype(item).astype(float))


def test_piz_of_many_values():
    """More values than 14 bits take the other arithmetic."""
    rng = np.random.default_rng(3)
    plane = rng.permutation(20_000)[: 130 * 140].reshape(130, 140, 1)
    assert np.array_equal(np.frombuffer(piz.unpacked(piz_block([plane], runs=False), 140, 130, [1]), "<u2").reshape(130, 140), plane[:, :, 0])


def test_exr_runs_and_broken_files():
    line = [1.0] * 30 + [0.5, 0.25]
    rows = [np.array(line, "<f2").tobytes() * 3 for _ in range(2)]
    packed = []
    for raw in rows:
        b = np.frombuffer(raw, np.uint8)
        split = np.concatenate([b[0::2], b[1::2]]).astype(int)
        delta = [int(split[0])] + [(int(y) - int(x) + 128) & 255 for x, y in zip(split, split[1:])]
        out, i = b"", 0
        while i < len(delta):
            k = 1
            while i + k < len(delta) and delta[i + k] == delta[i] and k < 100:
                k += 1
            out += bytes([k - 1, delta[i]]) if k > 1 else bytes([255, delta[i]])
            i += k
        packed.append(out)
    data = exr([(b"B", 1), (b"G", 1), (b"R", 1)], 1, list(enumerate(packed)), 32, 2)
    _, _, v = media.exr_pixels(data)
    assert np.array_equal(v.reshape(2, 32, 3)[:, :, 0], [line, line])
    for bad in (data[:40], data[:-20], b"", data.replace(b"channels\0", b"chanels\0\0"), exr([(b"Y", 1)], 0, [], 4, 4), exr([(b"B", 1), (b"G", 1), (b"R", 1)], 9, [], 4, 4)):
        with pytest.raises(media.MediaError):
            media.exr_pixels(bad)


def test_rle_round_trip():
    rng = np.random.default_rng(1)
    for raw in (b"", b"a", b"aaa", bytes(500), rng.integers(0, 3, 999).astype(np.uint8).tobytes(), rng.integers(0, 256, 400).astype(np.uint8).tobytes()):
        assert media._unrun(media._runs(raw)) == raw
    v = np.repeat(rng.random((9, 1, 3)), 20, axis=1).reshape(-1, 3)
    assert np.allclose(media.exr_pixels(media.exr_bytes(20, 9, v, "float", "rle"))[2], v, atol=1e-6)


def test_png_filters_by_hand():
    rng = np.random.default_rng(0)
    for color, planes, depth in ((2, 3, 8), (6, 4, 8), (0, 1, 8), (2, 3, 16)):
        step = planes * depth // 8
        lines = rng.integers(0, 256, (6, 5 * step)).tolist()
        raw, above = b"", [0] * (5 * step)
        for y, line in enumerate(lines):
            kind, out = y % 5, []
            for i, x in enumerate(line):
                a, b, c = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
                p = a + b - c
                near = sorted([(abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)])[0][2]
                out.append(x - (0, a, b, (a + b) // 2, near)[kind] & 255)
            raw += bytes([kind, *out])
            above = line
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, depth, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
        w, h, v = media.png_pixels(data)
        want = np.array(lines, np.uint8).reshape(-1, step)
        want = np.frombuffer(want.tobytes(), ">u2" if depth == 16 else "u1").reshape(-1, planes) / (65535 if depth == 16 else 255)
        want = np.repeat(want[:, :1], 3, 1) if planes == 1 else want[:, :3]
        assert (w, h) == (5, 6) and np.allclose(v, want)
        with pytest.raises(media.MediaError):
            media.png_pixels(data[:60])


def test_ppm_by_hand():
    assert np.allclose(media.ppm_pixels(b"P6 # a note\n2 1\n255\n\x00\x80\xff\x01\x02\x03")[2] * 255, [[0, 128, 255], [1, 2, 3]])
    for bad in (b"P5 1 1 255\n\0", b"P6 2 2 255\n\0", b"P6 1 1 70000\n\0\0\0", b"P6"):
        with pytest.raises(media.MediaError):
            media.ppm_pixels(bad)


#: A table of two points a side whose value at (r, g, b) is (r / 2, g, b) but for one corner.
CORNERS = {(r, g, b): (r / 2, g, b) if (r, g, b) != (1, 1, 1) else (1, 1, 1) for r in (0, 1) for g in (0, 1) for b in (0, 1)}


def check(t):
    assert t.size == 2
    for i, v in enumerate(t.values):
        assert np.allclose(v, CORNERS[(i % 2, i // 2 % 2, i // 4)], atol=1e-3)


def test_luts_by_hand():
    red_first = [(r, g, b) for b in (0, 1) for g in (0, 1) for r in (0, 1)]
    blue_first = [(r, g, b) for r in (0, 1) for g in (0, 1) for b in (0, 1)]
    lines = lambda order, f="%g %g %g": "\n".join(f % tuple(CORNERS[k]) for k in order)
    check(lutfiles.parse_cube('# made by hand\nTITLE "x y"\nLUT_3D_SIZE 2\nDOMAIN_MIN 0 0 0\n' + lines(red_first) + "\n"))
    codes = "\n".join(" ".join(str(round(x * 1023)) for x in CORNERS[k]) for k in blue_first)
    check(lutfiles.parse_3dl("0 1023\n" + codes + "\n"))
    check(lutfiles.parse_look('<Look><Title>a &amp; b</Title><LUT3D size="2">\n' + lines(red_first) + "\n</LUT3D></Look>"))
    check(lutfiles.parse_csp("CSPLUTV100\n3D\nBEGIN METADATA\nnote\nEND METADATA\n" + "2\n0 1\n0 1\n" * 3 + "2 2 2\n" + lines(red_first)))
    t = lutfiles.Table(2, np.array([CORNERS[k] for k in red_first], float))
    assert lutfiles.write_3dl(t, 10).splitlines()[1:] == codes.splitlines()
    assert [x for x in lutfiles.write_cube(t).splitlines() if x[0].isdigit()][1] == "0.500000 0.000000 0.000000"
    for kind in ("cube", "3dl", "look", "csp"):
        check(lutfiles.parse_bytes(lutfiles.WRITERS[kind](t).encode(), kind))
        with pytest.raises(lutfiles.LutError):
            lutfiles.parse_bytes(b"nothing", kind)
    with pytest.raises(lutfiles.LutError):
        lutfiles.parse_cube("LUT_3D_SIZE 2\n" + lines(red_first[:7]))


def test_decisions_and_grades_by_hand():
    c = lutfiles.parse_cdl("<ColorCorrection><SOPNode><Slope>1.1 1 0.9</Slope><Offset>0 0.1 0</Offset><Power>1 2 1</Power></SOPNode><SatNode><Saturation>0.5</Saturation></SatNode></ColorCorrection>")
    assert c.slope == (1.1, 1, 0.9) and c.offset == (0, 0.1, 0) and c.power == (1, 2, 1) and c.saturation == 0.5
    assert lutfiles.parse_cdl(lutfiles.write_cdl(c)) == c and lutfiles.parse_cdl("<x/>").saturation == 1.0
    g = lutfiles.parse_powergrade(b"Grade Version 3\ngain 1.5\nlift = 0.1 0.2 0.3\nsaturation: 0.8\nnodes 4\n")
    assert g.version == 3 and g.gain == (1.5,) * 3 and g.lift == (0.1, 0.2, 0.3) and g.saturation == 0.8 and g.nodes == 4
    for bad in (b"", b"version 1\n", b"\x00\x01\x02\x03", b"plain text"):
        with pytest.raises(lutfiles.LutError):
            lutfiles.parse_powergrade(bad)


def test_box_means_against_the_definition():
    rng = np.random.default_rng(5)
    for w, h, longest in ((40, 21, 16), (100, 3, 10), (7, 9, 4), (5, 5, 8), (1, 50, 7)):
        v = rng.random((h, w, 3))
        nw, nh, got = media.box_means(v.reshape(-1, 3), w, h, longest)
        want = [v[y * h // nh : -(-(y + 1) * h // nh), x * w // nw : -(-(x + 1) * w // nw)].mean((0, 1)) for y in range(nh) for x in range(nw)]
        assert max(nw, nh) <= longest and np.allclose(got, want)


def test_exr_differences():
    """pxr24 by its definition: differences of each line as byte planes, deflated."""
    rng = np.random.default_rng(2)
    v = np.round(rng.random((20, 9, 3)), 3).astype("<f2")
    blocks = []
    for y in range(0, 20, 16):
        body = b""
        for line in v[y : y + 16]:
            for c in "BGR":
                bits = line[:, "RGB".index(c)].copy().view("<u2").astype(int)
                d = [(int(b) - int(a)) & 65535 for a, b in zip([0, *bits], bits)]
                body += bytes(x >> 8 for x in d) + bytes(x & 255 for x in d)
        packed = zlib.compress(body)
        plain = b"".join(line[:, "RGB".index(c)].tobytes() for line in v[y : y + 16] for c in "BGR")
        blocks.append((y, packed if len(packed) < len(plain) else plain))
    _, _, got = media.exr_pixels(exr([(b"B", 1), (b"G", 1), (b"R", 1)], 5, blocks, 9, 20))
    assert np.array_equal(got.reshape(20, 9, 3), v.astype(float))
    f = np.array([1.0, 1.5, -2.25, 3e5], "<f4")
    bits = f.view("<u4").astype(int)
    d = [(int(b) - int(a)) & 0xFFFFFFFF for a, b in zip([0, *bits], bits)]
    raw = zlib.compress(b"".join(bytes(x >> s & 255 for x in d) for s in (24, 16, 8)))
    assert np.array_equal(np.frombuffer(media.differences(raw, 4, 1, ["float"]), "<f4"), f)


def test_exr_squares():
    """b44 by its definition, with values whose steps fit six bits, so nothing is lost; edges repeat into the last squares."""
    rng = np.random.default_rng(8)
    height, width = 6, 10
    planes = {}
    for c in "BGR":
        base = int(rng.integers(0x3000, 0x3800))
        planes[c] = base + rng.integers(-7, 8, (height, width))
    planes["G"][:4, 4:8] = 0x3555
    planes["R"][0, 0] |= 0  # positive halves only, but for one negative square
    planes["R"][4:, 8:] = 0xB400
    body = b""
    for c in "BGR":
        p = np.pad(planes[c], ((0, 2), (0, 2)), mode="edge")
        for y in range(0, 8, 4):
            for x in range(0, 12, 4):
                t = [[int(v) for v in row] for row in p[y : y + 4, x : x + 4]]
                t = [[(v ^ 0xFFFF) if v & 0x8000 else v | 0x8000 for v in row] for row in t]
                if len({v for row in t for v in row}) == 1:
                    body += bytes([t[0][0] >> 8, t[0][0] & 255, 0xFC])
                    continue
                steps = [t[i][0] - t[i - 1][0] for i in (1, 2, 3)] + [t[i][j] - t[i][j - 1] for j in (1, 2, 3) for i in range(4)]
                bits = format(t[0][0], "016b") + "000000" + "".join(format(s + 32, "06b") for s in steps)
                body += bytes(int(bits[i : i + 8], 2) for i in range(0, 112, 8))
    data = exr([(b"B", 1), (b"G", 1), (b"R", 1)], 7, [(0, body)], width, height)
    want = np.stack([planes[c].astype("<u2").view("<f2") for c in "RGB"], axis=2).astype(float)
    assert np.array_equal(media.exr_pixels(data)[2].reshape(height, width, 3), want)
    with pytest.raises(media.MediaError):
        media.exr_pixels(data[:-9] + bytes(0))
