"""Files read back what was written, pixels read alone equal decoded ones, and broken files are refused."""

import struct
from dataclasses import replace

import numpy as np
import pytest

from tessella.operators import block_texture
from tessella.sources import adaptive_file, containers, dct_file, dct_records, hybrid_file, jpeg, mip_file, palette_file, pattern_file
from tessella.sources.bits import Reader, Writer, field_at, put_golomb, put_signed_golomb

RNG = np.random.default_rng(11)


def palette_image(w, h, block, local, shared, palettes=1, bits=24, scalar=False, narrow=False):
    colors = RNG.integers(0, 256, (palettes, shared, 3))
    if narrow:
        colors = 90 + RNG.integers(0, 9, (palettes, shared, 3))
    if scalar:
        colors = np.repeat(colors[..., :1], 3, axis=2)
    colors = palette_file.stored_colors(colors, bits)
    n = -(-w // block) * -(-h // block)
    indices = None if local == block**2 else RNG.integers(0, local, (h, w))
    return palette_file.PaletteImage(w, h, block, colors, RNG.integers(0, palettes, n), RNG.integers(0, shared, (n, local)), indices, bits, scalar)


def smooth(h, w):
    y, x = np.mgrid[0:h, 0:w]
    return np.clip(np.stack([128 + 60 * np.sin(x / 9), 100 + 50 * np.cos(y / 7), 90 + 40 * np.sin((x + y) / 17)], axis=-1), 0, 255).astype(np.uint8)


def places(w, h, n=40):
    return [(int(RNG.integers(w)), int(RNG.integers(h))) for _ in range(n)] + [(0, 0), (w - 1, h - 1)]


CASES = [(37, 29, 8, 4, 16, 1), (37, 29, 8, 4, 16, 4, 16), (16, 16, 4, 16, 32, 2), (33, 17, 16, 8, 64, 8, 24, False, True), (20, 20, 8, 2, 8, 1, 24, True), (9, 9, 2, 4, 8, 2, 16), (5, 3, 64, 2, 2, 128)]


@pytest.mark.parametrize("case", CASES)
def test_palette_file(case):
    image = palette_image(*case)
    data, px = palette_file.encode(image), image.pixels()
    assert (palette_file.decode(data).pixels() == px).all()
    assert all(palette_file.sample(data, x, y) == tuple(px[y, x]) for x, y in places(image.width, image.height))
    for bad in (data[:-1], data + b"\0", b"XXXX" + data[4:], data[:4] + b"\x40" + data[5:]):
        with pytest.raises(ValueError):
            palette_file.decode(bad)
    for x, y in ((-1, 0), (0, image.height)):
        with pytest.raises(ValueError):
            palette_file.sample(data, x, y)


def test_packed_palettes_never_enlarge():
    narrow = palette_file.encode(palette_image(16, 16, 8, 4, 64, 4, narrow=True))
    wide = palette_file.encode(palette_image(16, 16, 8, 4, 64, 4))
    assert palette_file.read_header(narrow).packed and not palette_file.read_header(wide).packed and len(narrow) < len(wide)


def test_payload_length_follows_the_formula():
    im = palette_image(100, 60, 8, 4, 32, 4, 16)
    blocks, pixels = 13 * 8, 6000
    assert len(palette_file.encode(im)) == 14 + -(-(4 * 32 * 16 + blocks * 2 + blocks * 4 * 5 + pixels * 2) // 8)


def test_vector_palettes_are_read():
    head = Writer()
    for v, w in ((5, 4), (7, 24), (7, 24), (2, 3), (0, 2), (2, 4), (1, 1), (1, 1), (0, 9), (0, 1), (0, 3), (0, 2), (0, 2)):
        head.put(v, w)
    body = Writer().put([0, 0, 0, 70, 140, 210], 8).put([0, 7], 3).put(np.arange(64) % 2, 1)
    image = palette_file.decode(b"BPAL" + head.bytes() + body.bytes())
    assert [tuple(c) for c in image.palette[0]] == [(10 * k, 20 * k, 30 * k) for k in range(8)]
    lab = palette_file.vector_palette(np.array([[[255, 0, 0], [0, 0, 255]]]), 8, True)
    assert tuple(lab[0]) == (255, 0, 0) and tuple(lab[-1]) == (0, 0, 255)


@pytest.mark.parametrize("change", [{"local": 64}, {"selectors": np.array([9] * 20)}, {"color_bits": 12}])
def test_invalid_images_are_refused(change):
    im = palette_image(37, 29, 8, 4, 16, 2)
    for k, v in change.items():
        if k == "local":
            im.table = np.zeros((len(im.selectors), v), dtype=np.int64)
        else:
            setattr(im, k, v)
    with pytest.raises(ValueError):
        palette_file.encode(im)


@pytest.mark.parametrize("case", [c for c in CASES if len(c) < 8 or not c[7]])
def test_mip_file(case):
    base = palette_image(*case)
    levels = mip_file.build(base)
    back, found = mip_file.decode(data := mip_file.encode(base, levels))
    assert (back.pixels() == base.pixels()).all() and (found[-1].width, found[-1].height) == (1, 1)
    assert all((mip_file.level_pixels(back, a) == mip_file.level_pixels(base, b)).all() for a, b in zip(found, levels, strict=True))
    for bad in (data[:-1], data + b"\0", data[:4] + b"\x02" + data[5:]):
        with pytest.raises(ValueError):
            mip_file.decode(bad)
    if levels:
        levels[0].width += 1
        with pytest.raises(ValueError):
            mip_file.encode(base, levels)


def test_adaptive_file():
    w, h = 150, 97
    four = [palette_image(w, h, s, 4, 16, 2) for s in (4, 8, 16, 32)]
    modes = [0, 3, 1, 2, 2, 0]
    opened = adaptive_file.Adaptive(data := adaptive_file.encode(four, modes))
    px = opened.pixels()
    assert len(data) % 4 == 0
    for x, y in places(w, h, 200):
        assert opened.sample(x, y) == tuple(px[y, x]) == tuple(four[modes[y // 64 * 3 + x // 64]].pixels()[y, x])
    for bad in (data[:-4], data[:11] + b"\1" + data[12:]):
        with pytest.raises(ValueError):
            adaptive_file.Adaptive(bad)
    with pytest.raises(ValueError):
        adaptive_file.encode(four, modes[:-1])
    with pytest.raises(ValueError):
        adaptive_file.encode(four[:3] + four[:1], modes)


def patterned(turn=True, edits=1):
    base, slots = [RNG.integers(0, 4, (8, 8)) for _ in range(3)], np.zeros((64, 64), dtype=np.int64)
    for b in range(64):
        t = base[b % 3].copy()
        t = np.rot90(t, b % 4).copy() if turn else t
        for _ in range(edits):
            t[RNG.integers(8), RNG.integers(8)] = RNG.integers(4)
        slots[b // 8 * 8 : b // 8 * 8 + 8, b % 8 * 8 : b % 8 * 8 + 8] = t
    return palette_file.PaletteImage(64, 64, 8, RNG.integers(0, 256, (1, 16, 3)).astype(np.uint8), np.zeros(64, dtype=np.int64), np.tile(np.arange(4), (64, 1)), slots)


@pytest.mark.parametrize("image", [patterned(), patterned(False, 0), patterned(False, 20), palette_image(37, 29, 8, 4, 16, 4, 16), palette_image(16, 16, 4, 16, 32, 2)])
def test_pattern_file(image):
    for checkpoint in (0, 4):
        opened = pattern_file.Patterned(pattern_file.encode(image, checkpoint=checkpoint))
        px = image.pixels()
        assert (opened.image().pixels() == px).all()
        assert all(opened.sample(x, y) == tuple(px[y, x]) for x, y in places(image.width, image.height))
    best = pattern_file.encode_smallest(image)
    assert len(best) <= len(palette_file.encode(image)) and pattern_file.sampler(best)(1, 2) == tuple(px[2, 1])


def test_runs_and_symmetries_are_used():
    plan = pattern_file.best_plan(pattern_file.canonical(patterned())[0], patterned())
    assert plan is not None
    stripes = np.tile(np.repeat(np.arange(4), 2), (64, 8))
    image = palette_file.PaletteImage(64, 64, 8, RNG.integers(0, 256, (1, 16, 3)).astype(np.uint8), np.zeros(64, dtype=np.int64), np.tile(np.arange(4), (64, 1)), stripes.T.copy())
    assert pattern_file.best_plan(pattern_file.canonical(image)[0], image).bits.sum() == 0
    for t in range(8):
        places_ = pattern_file.turned_places(4, t)
        assert sorted(places_) == list(range(16))


@pytest.mark.parametrize("modes", ["palette", "transform", "mixed"])
def test_hybrid_file(modes):
    rgb = smooth(45, 70)
    tables = hybrid_file.quality_tables(75)
    blocks = hybrid_file.quantise(hybrid_file.transformed(rgb), tables)
    n = len(blocks)
    chosen = {"palette": np.zeros(n, dtype=int), "transform": np.ones(n, dtype=int), "mixed": np.arange(n) % 2}[modes]
    image = hybrid_file.HybridImage(70, 45, chosen, palette_image(70, 45, 16, 8, 32, 2), tables, blocks)
    back = hybrid_file.decode(data := hybrid_file.encode(image))
    px = hybrid_file.pixels(back)
    assert (px == hybrid_file.pixels(image)).all() and all(hybrid_file.sample(back, x, y) == tuple(px[y, x]) for x, y in places(70, 45))
    if modes == "transform":
        assert ((px.astype(int) - rgb) ** 2).mean() < 20
    for bad in (data[:-1], data[:6] + b"\5" + data[7:]):
        with pytest.raises(ValueError):
            hybrid_file.decode(bad)


def test_fixed_transform_of_a_flat_block():
    from tessella.operators.transform import forward_fixed, inverse_fixed

    flat = np.full((1, 8, 8), 200)
    f = forward_fixed(flat)
    assert f[0, 0, 0] == 576 and not f[0].ravel()[1:].any() and (inverse_fixed(f) == 200).all()


@pytest.mark.parametrize("preset", list(dct_file.PRESETS))
def test_transform_file(preset):
    rgb = smooth(40, 52)
    opened = dct_file.Transformed(data := dct_file.encode(rgb, preset))
    px = opened.pixels()
    assert len(data) == 64 + 12 * dct_file.PRESETS[preset][1]
    assert all(opened.sample(x, y) == tuple(px[y, x]) for x, y in places(52, 40, 8))
    assert 10 * np.log10(65025 / ((px.astype(int) - rgb) ** 2).mean()) > 27
    with pytest.raises(ValueError):
        dct_file.Transformed(data[:-1])
    fields = opened.describe(0)
    assert sum(b for _, _, b in fields) == opened.layout.records()[0][4] * 8


@pytest.mark.parametrize("coding", range(8))
@pytest.mark.parametrize("order", [False, True])
def test_codings_store_what_they_chose(coding, order):
    kind = replace(dct_records.CODINGS[coding], zigzag=order)
    for (w, h), size in (((8, 8), 8), ((8, 8), 16), ((8, 8), 24), ((8, 8), 48), ((16, 16), 24), ((16, 16), 64), ((8, 16), 12)):
        f = RNG.normal(size=w * h) * 300 / (1 + np.arange(w * h))
        record = dct_records.choose(f, w, h, size, 70, False, kind)
        back = dct_records.read(dct_records.write(record, size), w, h, 70, False, kind)
        assert abs(((f - back) ** 2).sum() - ((f**2).sum() - record.gain)) < 1e-6 * (f**2).sum()


@pytest.mark.parametrize("kind", list(dct_file.LIBRARY_KINDS))
def test_prototype_libraries(kind):
    rgb = smooth(32, 48)
    opened = dct_file.Transformed(data := dct_file.encode(rgb, "2", library=3, library_kind=kind))
    px = opened.pixels()
    assert all(opened.sample(x, y) == tuple(px[y, x]) for x, y in places(48, 32, 6))
    assert [len(b) for b in opened.books] == [3, 3, 3]
    with pytest.raises(ValueError):
        dct_file.Transformed(data[:-1])


def test_searches_are_never_worse():
    rgb = smooth(32, 32)
    for preset in ("3", "9"):
        plain = dct_file.encode(rgb, preset, sizes=dct_file.PRESETS[preset][2:], **({"coding": 2, "zigzag_order": False} if preset == "9" else {}))
        assert dct_file.squared_error(rgb, dct_file.encode_best(rgb, preset)) <= dct_file.squared_error(rgb, plain)
    best = dct_file.best_quality(rgb, "1", sample=4, finalists=2)
    assert dct_file.squared_error(rgb, best) <= min(dct_file.squared_error(rgb, dct_file.encode(rgb, "1", q)) for q in (20, 50))


def test_block_textures():
    rgba = np.dstack([smooth(21, 30), np.full((21, 30), 255, np.uint8)])
    blocks = block_texture.blocks_of(rgba)
    assert (block_texture.image_of(blocks, 21, 30) == rgba).all()
    for encode, decode, bound in ((block_texture.encode_bc1, block_texture.decode_bc1, 40), (block_texture.encode_bc7, block_texture.decode_bc7, 5)):
        assert ((decode(encode(blocks)).astype(int) - blocks) ** 2).mean() < bound
    four = np.array([[[0, 0, 0, 255], [255, 255, 255, 255], [85, 85, 85, 255], [170, 170, 170, 255]] * 4])
    assert (block_texture.decode_bc1(block_texture.encode_bc1(four)) == four).all()
    _, _, slots = block_texture.inspect_bc7(block_texture.encode_bc7(four))
    assert slots[0, 0] < 8
    flat = np.full((1, 16, 4), 77)
    assert np.abs(block_texture.decode_bc7(block_texture.encode_bc7(flat)).astype(int) - flat).max() <= 1


def test_containers():
    rgb = smooth(5, 7)
    assert (containers.read_ppm(containers.write_ppm(rgb)) == rgb).all()
    assert (containers.read_ppm(b"P6 # a comment\n7 # another\n5\n255\n" + rgb.tobytes()) == rgb).all()
    for bad in (b"P5\n7 5\n255\n", b"P6\n7 5\n65535\n" + bytes(210), containers.write_ppm(rgb)[:-1]):
        with pytest.raises(ValueError):
            containers.read_ppm(bad)
    dds = containers.write_dds("bc7", bytes(16 * 4), 7, 5)
    assert dds[:4] == b"DDS " and len(dds) == 148 + 64 and struct.unpack_from("<I", dds, 128) == (98,)
    assert containers.write_astc(bytes(16), 7, 5, (8, 8))[:7] == bytes([0x13, 0xAB, 0xA1, 0x5C, 8, 8, 1])
    assert list(containers.scaled_16(np.array([0, 128, 129, 65535]))) == [0, 0, 1, 255]
    with pytest.raises(ValueError):
        containers.read_rgba(bytes(10), 2, 2)


def test_bits():
    w = Writer()
    values = [0, 1, -1, 7, -8, 1000]
    for v in values:
        put_signed_golomb(w, v)
        put_golomb(w, abs(v))
    r = Reader(w.bytes())
    for v in values:
        assert r.signed_golomb() == v and r.golomb() == abs(v)
    data = bytes(range(256))
    assert all(field_at(data, b, n) == int("".join(f"{x:08b}" for x in data)[b : b + n] or "0", 2) for b in (0, 3, 100) for n in (0, 1, 7, 9, 31))
    with pytest.raises(ValueError):
        Reader(b"a").take(9, 1)


# ------------------------------------------------------------------------ JPEG
def jpeg_bytes(blocks, factors, width, height, progressive=False, restart=0):
    """A JPEG of given quantised coefficients, with eight-bit codes for all symbols."""
    def segment(marker, body):
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    order = jpeg.ORDER
    code = {s: i for i, s in enumerate(range(255))}

    def symbol(out, s):
        out.put(code[s], 8)

    def number(out, v):
        n = abs(v).bit_length()
        if n:
            out.put(v if v > 0 else v + (1 << n) - 1, n)
        return n

    def size(v):
        return abs(v).bit_length()

    def ac(out, along, first, last, shift=0):
        run = 0
        for k in range(first, last + 1):
            v = int(np.sign(along[k])) * (abs(int(along[k])) >> shift)
            if v == 0:
                run += 1
                continue
            while run > 15:
                symbol(out, 0xF0)
                run -= 16
            symbol(out, run << 4 | size(v))
            number(out, v)
            run = 0
        if run:
            symbol(out, 0)

    def stuffed(out):
        tail = -out.bits % 8
        if tail:
            out.put((1 << tail) - 1, tail)
        return out.bytes().replace(b"\xff", b"\xff\x00")

    wide, tall = max(a for a, _ in factors), max(d for _, d in factors)
    units = [(y, x) for y in range(-(-height // (8 * tall))) for x in range(-(-width // (8 * wide)))]
    places_ = [[(k, y * d + j, x * a + i) for k, (a, d) in enumerate(factors) for j in range(d) for i in range(a)] for y, x in units]
    data = b"\xff\xd8" + segment(0xDB, b"\0" + bytes(range(1, 65)))
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(factors)])
    data += segment(0xC2 if progressive else 0xC0, frame + b"".join(bytes([k + 1, a << 4 | d, 0]) for k, (a, d) in enumerate(factors)))
    counts = bytes([0] * 7 + [255] + [0] * 8)
    for kind in (0x00, 0x10):
        data += segment(0xC4, bytes([kind]) + counts + bytes(range(255)))
    if restart:
        data += segment(0xDD, restart.to_bytes(2, "big"))

    def scan(parts, components, first, last, high, low):
        head = bytes([len(components)]) + b"".join(bytes([k + 1, 0]) for k in components) + bytes([first, last, high << 4 | low])
        return segment(0xDA, head) + b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(parts) else b"") for i, p in enumerate(parts))

    def dc_scan(shift, with_ac):
        parts, out, before = [], Writer(), [0] * len(factors)
        for n, unit in enumerate(places_):
            if restart and n and n % restart == 0:
                parts.append(stuffed(out))
                out, before = Writer(), [0] * len(factors)
            for k, y, x in unit:
                along = blocks[k][y, x][list(order)]
                dc = int(along[0]) >> shift
                symbol(out, size(dc - before[k]))
                number(out, dc - before[k])
                before[k] = dc
                if with_ac:
                    ac(out, along, 1, 63)
        return parts + [stuffed(out)]

    everything = list(range(len(factors)))
    if not progressive:
        return data + scan(dc_scan(0, True), everything, 0, 63, 0, 0) + b"\xff\xd9"
    data += scan(dc_scan(1, False), everything, 0, 0, 0, 1)
    out = Writer()
    for unit in places_:
        for k, y, x in unit:
            out.put(int(blocks[k][y, x][0]) & 1, 1)
    data += scan([stuffed(out)], everything, 0, 0, 1, 0)
    for k, (a, d) in enumerate(factors):
        rows, columns = -(-(-(-height * d // tall)) // 8), -(-(-(-width * a // wide)) // 8)
        own = [blocks[k][y, x][list(order)] for y in range(rows) for x in range(columns)]
        out = Writer()
        for along in own:
            ac(out, along, 1, 63, 1)
        data += scan([stuffed(out)], [k], 1, 63, 0, 1)
        out = Writer()
        for along in own:
            refine(out, along, symbol)
        data += scan([stuffed(out)], [k], 1, 63, 1, 0)
    return data + b"\xff\xd9"


def refine(out, along, symbol):
    """The last bit of every coefficient, for those that were zero before as new values."""
    run, held = 0, []
    last = max([k for k in range(1, 64) if abs(along[k]) == 1], default=0)
    for k in range(1, 64):
        v = int(along[k])
        if abs(v) > 1:
            held.append(abs(v) & 1)
        elif v == 0 and k < last:
            run += 1
            if run == 16:
                symbol(out, 0xF0)
                out.put(held, 1) if held else None
                run, held = 0, []
        elif abs(v) == 1:
            symbol(out, run << 4 | 1)
            out.put(int(v > 0), 1)
            out.put(held, 1) if held else None
            run, held = 0, []
    if last < 63:
        symbol(out, 0)
        out.put(held, 1) if held else None


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("factors", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_jpeg_coefficients(factors, progressive):
    width, height = 37, 21
    wide, tall = max(a for a, _ in factors), max(d for _, d in factors)
    blocks = []
    for a, d in factors:
        rows, columns = -(-height // (8 * tall)) * d, -(-width // (8 * wide)) * a
        f = RNG.integers(-40, 40, (rows, columns, 64)) * (RNG.random((rows, columns, 64)) < 0.15)
        f[..., 0] = RNG.integers(-200, 200, (rows, columns))
        own_rows, own_columns = -(-(-(-height * d // tall)) // 8), -(-(-(-width * a // wide)) // 8)
        f[own_rows:, :, 1:], f[:, own_columns:, 1:] = 0, 0
        blocks.append(f)
    for restart in (0, 2) if not progressive else (0,):
        image = jpeg.parse(data := jpeg_bytes(blocks, factors, width, height, progressive, restart))
        assert (image.width, image.height) == (width, height)
        assert all((c.blocks == b).all() for c, b in zip(image.components, blocks, strict=True))
        assert jpeg.pixels(image).shape == (height, width, 3)
    for preset in ("1", "3"):
        opened = dct_file.Transformed(jpeg.transcode(image, preset))
        assert opened.pixels().shape == (height, width, 3)
    for bad in (b"", data[:2], data[:60]):
        with pytest.raises((ValueError, IndexError)):
            jpeg.parse(bad)


def png_bytes(samples, kind, depth, filters=(0, 1, 2, 3, 4), table=None):
    """A PNG of whole-byte samples (h, w, channels), its lines filtered in turn."""
    import zlib

    h, w, channels = samples.shape
    lines = samples.astype(">u2" if depth == 16 else np.uint8).tobytes()
    row, step = len(lines) // h, channels * depth // 8
    out, above = b"", bytes(row)
    for y in range(h):
        x, f = lines[y * row : (y + 1) * row], filters[y % len(filters)]
        done = bytearray([f])
        for i in range(row):
            a, b, c = x[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            done.append((x[i] - (0, a, b, (a + b) // 2, paeth)[f]) & 255)
        out, above = out + bytes(done), x
    chunk = lambda t, b: len(b).to_bytes(4, "big") + t + b + zlib.crc32(t + b).to_bytes(4, "big")
    head = struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", table.tobytes()) if table is not None else b"") + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_png():
    rgb = smooth(11, 13)
    assert (containers.read_png(png_bytes(rgb, 2, 8)) == rgb).all()
    assert (containers.read_png(png_bytes(np.dstack([rgb, np.full((11, 13), 255)]), 6, 8)) == rgb).all()
    grey = rgb[..., :1]
    assert (containers.read_png(png_bytes(grey, 0, 8)) == np.repeat(grey, 3, axis=2)).all()
    wide = RNG.integers(0, 65536, (5, 7, 3))
    assert (containers.read_png(png_bytes(wide, 2, 16)) == (wide + 128) // 257).all()
    table = RNG.integers(0, 256, (9, 3)).astype(np.uint8)
    slots = RNG.integers(0, 9, (6, 5, 1))
    assert (containers.read_png(png_bytes(slots, 3, 8, table=table)) == table[slots[..., 0]]).all()
    for bad in (png_bytes(np.dstack([rgb, np.full((11, 13), 9)]), 6, 8), png_bytes(rgb, 2, 8)[:-30], b"\x89PNG", png_bytes(slots, 3, 8, table=table[:2])):
        with pytest.raises(ValueError):
            containers.read_png(bad)


@pytest.mark.parametrize("preset", ["0.75", "2", "3", "9"])
def test_records_are_chosen_for_many_units_at_once(monkeypatch, preset):
    rgb = np.random.default_rng(4).integers(0, 256, (64, 80, 3))
    calls, plain = [], dct_records._plain
    monkeypatch.setattr(dct_records, "_plain", lambda *a, **k: (calls.append(1), plain(*a, **k))[1])
    dct_file.encode(rgb[:16, :16], preset)
    alone = len(calls)
    whole = dct_file.Transformed(dct_file.encode(rgb, preset))
    assert len(calls) == 2 * alone  # twenty units take as many steps as one
    for unit in (0, 7, 19):
        y, x = unit // 5 * 16, unit % 5 * 16
        one = dct_file.Transformed(dct_file.encode(rgb[y : y + 16, x : x + 16], preset))
        assert whole.data[dct_file.HEAD + unit * whole.layout.unit :][: whole.layout.unit] == one.data[dct_file.HEAD :]


@pytest.mark.parametrize("coding,size", [(1, 16), (3, 24), (4, 32), (5, 16)])
def test_many_records_are_those_chosen_one_by_one(coding, size):
    f = np.random.default_rng(coding).normal(0, 60, (300, 64)) * np.exp(-np.arange(64) / 20)
    kind = replace(dct_records.CODINGS[coding], zigzag=True)
    many = dct_records.written(f, 8, 8, size, 60, False, kind)
    for k in (0, 1, 127, 128, 299):
        assert many[k].tobytes() == dct_records.write(dct_records.choose(f[k], 8, 8, size, 60, False, kind), size)


@pytest.mark.parametrize("coding,w,size", [(3, 8, 16), (4, 8, 16), (4, 16, 32), (5, 16, 64)])
def test_skips_look_at_no_place_out_of_reach_and_lose_nothing(monkeypatch, coding, w, size):
    """Against the gain of a plain search over all places, scale by scale."""
    kind, q = replace(dct_records.CODINGS[coding], zigzag=True), 60
    f = np.random.default_rng(coding).normal(0, 60, (3, w * w)) * np.exp(-np.arange(w * w) / 40)
    tokens, coarse, tail = dct_records.skip_layout(size, w, w, kind.skip)
    widths, ahead = [], dct_records._ahead
    monkeypatch.setattr(dct_records, "_ahead", lambda g: (widths.append(g.shape[-1] - 4), ahead(g))[1])
    step = dct_records.steps(w, w, q, False)
    got = dct_records._skips(f, step, w, w, size, kind)
    profiles = dct_records.profiles(kind, True)
    whole = 4 * (tokens - 1 + tail) + 1
    assert sum(widths) <= profiles * (sum(4 * t + 1 for t in range(tokens - 1)) + tail * whole)
    for v, gain in zip(f, got.gain, strict=True):
        best = -np.inf
        for profile in range(profiles):
            at = dct_records.profile_scan(kind, profile, w, w, True)
            for k, scale in enumerate(dct_records.SCALES):
                fine = dct_records.SCALES[1 if k >= 3 else 0]
                gains = [np.maximum(dct_records._stored(v[at], step[at] * s, b)[1], 0).tolist() for s, b in ((scale, 6), (fine, 4))]
                after, moves = [-np.inf] * (len(at) + 4), []
                for t in range(tokens - 1, -1, -1):
                    ahead_of = [after[p + 1 : p + 5] if t + 1 < tokens else [0.0] for p in range(len(at))]
                    moves.insert(0, [1 + a.index(max(a)) for a in ahead_of])
                    after = [gains[0 if t < coarse else 1][p] + max(a) for p, a in enumerate(ahead_of)] + [-np.inf] * 4
                end = 0
                for move in moves[:-1]:
                    end += move[end]
                more = [0.0] * (len(at) + 4)  # the tail goes on from the last token, whose place it does not change
                for _ in range(tail):
                    more = [max([gains[1][p + d] + more[p + d] for d in range(1, 5) if p + d < len(at)], default=0.0) for p in range(len(at))] + [0.0] * 4
                best = max(best, after[0] + more[end] + float(dct_records._stored(v[:1], step[:1] * scale, 10)[1][0]))
        assert gain == pytest.approx(best, rel=1e-12)
