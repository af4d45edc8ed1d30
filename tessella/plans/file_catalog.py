"""Queries over files and blocks whose parts are given by formulas, so that SQL can work out every value.

The SQL spells its tables and steps out by itself: no constant of it comes from the code it is compared with.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessella.operators import block_texture, reports, settings_search, transform
from tessella.plans.catalog import query
from tessella.plans.codec_catalog import _IMG, BAND, _formed, _per_image, _scanned, images
from tessella.plans.fixtures import BLK_SQL, PX_SQL, pixels, table
from tessella.sources import containers, dct_file, hybrid_file, palette_file, tables, unit_source
from tessella.sources.bits import Writer
from tessella.workspace import Workspace

c = F.col

_PLACED = f"CAST(y // {BAND} AS VARCHAR) AS image_id, CAST(y % {BAND} AS INTEGER) AS y, CAST(x AS INTEGER) AS x"
_RGB = "CAST({0} AS INTEGER) AS r, CAST({1} AS INTEGER) AS g, CAST({2} AS INTEGER) AS b"


def _half_away(x: str, d: int) -> str:
    """x / d, rounded, halves away from zero."""
    return f"(CASE WHEN ({x}) < 0 THEN -((-({x}) + {d // 2}) // {d}) ELSE (({x}) + {d // 2}) // {d} END)"


def _byte(x: str) -> str:
    return f"least(255, greatest(0, {x}))"


# ---------------------------------------------------------------- plain image files
def _png(rgb: np.ndarray) -> bytes:
    """A PNG whose lines take the five filters in turn."""
    height, width = rgb.shape[:2]
    raw = np.zeros((height + 1, width * 3 + 3), dtype=np.int64)
    raw[1:, 3:] = rgb.reshape(height, -1)
    x, a, b, d = raw[1:, 3:], raw[1:, :-3], raw[:-1, 3:], raw[:-1, :-3]
    p = a + b - d
    pa_, pb, pd_ = abs(p - a), abs(p - b), abs(p - d)
    paeth = np.where((pa_ <= pb) & (pa_ <= pd_), a, np.where(pb <= pd_, b, d))
    guesses = np.stack([np.zeros_like(x), a, b, (a + b) // 2, paeth])
    kinds = np.arange(height) % 5
    lines = np.concatenate([kinds[:, None], (x - guesses[kinds, np.arange(height)]) % 256], axis=1).astype(np.uint8)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


_SAME_PIXELS = f"WITH {PX_SQL} SELECT {_PLACED}, {_RGB.format('r', 'g', 'b')} FROM px"


@query(_SAME_PIXELS)
def ppm_file_scan(spark, sf_dir):
    """PPM files written and scanned again."""
    return _scanned(lambda rgba: containers.write_ppm(rgba[..., :3]))(spark, sf_dir)


@query(_SAME_PIXELS)
def png_file_scan(spark, sf_dir):
    """PNG files with every filter."""
    return _scanned(lambda rgba: _png(rgba[..., :3]))(spark, sf_dir)


# Grey JPEG files: each block's mean is the red byte of its first pixel, and two of its other coefficients, the second
# and the 21st of the zigzag order, come from the green and the blue one.
_DC_SIZES, _AC_SYMBOLS = range(12), (0x00, 0xF0, 0x01, 0x02, 0x03, 0x21, 0x22, 0x23, 0x24, 0x31, 0x32, 0x33, 0x34)
_DC_STEP, _SECOND_STEP, _LATE_STEP = 8, 3, 5


def _jpeg(rgba: np.ndarray) -> bytes:
    height, width = rgba.shape[:2]
    bits, before = [], 0

    def signed(v: int) -> tuple[int, str]:
        size = abs(v).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    def symbol(s: int) -> str:
        return format(_AC_SYMBOLS.index(s), "04b")

    for r, g, b in rgba[::8, ::8, :3].reshape(-1, 3).astype(int).tolist():
        size, value = signed(r - 128 - before)
        bits.append(format(size, "04b") + value)
        before, second, late = r - 128, g % 15 - 7, b % 31 - 15
        if second:
            size, value = signed(second)
            bits.append(symbol(size) + value)
        if late:  # 18 or 19 zeros before it, 16 of them in a symbol of their own
            size, value = signed(late)
            bits.append(symbol(0xF0) + symbol((2 if second else 3) << 4 | size) + value)
        bits.append(symbol(0))
    stream = "".join(bits)
    stream += "1" * (-len(stream) % 8)
    scan = bytes(int(stream[k : k + 8], 2) for k in range(0, len(stream), 8)).replace(b"\xff", b"\xff\x00")

    def segment(marker: int, body: bytes) -> bytes:
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    steps = bytearray([1] * 64)
    steps[0], steps[1], steps[20] = _DC_STEP, _SECOND_STEP, _LATE_STEP
    four_bits = lambda n: bytes([0, 0, 0, n] + [0] * 12)
    codes = bytes([0x00]) + four_bits(len(_DC_SIZES)) + bytes(_DC_SIZES) + bytes([0x10]) + four_bits(len(_AC_SYMBOLS)) + bytes(_AC_SYMBOLS)
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    return b"\xff\xd8" + segment(0xDB, b"\x00" + bytes(steps)) + segment(0xC0, frame) + segment(0xC4, codes) + segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"


_JPEG_SQL = f"""WITH {PX_SQL}, cells AS (SELECT y // {BAND} AS image, y % {BAND} AS y, x, r, g, b FROM px),
blocks AS (SELECT image, y // 8 AS j, x // 8 AS i, (r - 128) * {_DC_STEP} AS f0, (g % 15 - 7) * {_SECOND_STEP} AS f1, (b % 31 - 15) * {_LATE_STEP} AS f40 FROM cells WHERE y % 8 = 0 AND x % 8 = 0)"""


@query(f"""{_JPEG_SQL}, each AS (UNPIVOT blocks ON f0, f1, f40 INTO NAME place VALUE value)
SELECT CAST(image AS VARCHAR) AS image_id, CAST(j AS INTEGER) AS by, CAST(i AS INTEGER) AS bx, CAST(substr(place, 2) AS INTEGER) AS pos, CAST(value AS INTEGER) AS value FROM each WHERE value <> 0""")
def jpeg_file_blocks(spark, sf_dir):
    """Coefficients of JPEG files: Huffman codes, runs of zeros, differences of means, steps."""
    files = _per_image(images(spark, sf_dir), "image_id string, content binary", lambda rgba: (_jpeg(rgba),))
    each = tables.jpeg_blocks(files).select("image_id", "by", "bx", F.posexplode("coefficients").alias("pos", "value"))
    return each.where("value <> 0")


_GREY = "f0 / 8.0 + sqrt(0.5) / 4 * (f1 * cos((2 * (x % 8) + 1) * pi() / 16) + f40 * cos((2 * (y % 8) + 1) * 5 * pi() / 16)) + 128"


@query(f"{_JPEG_SQL}, grey AS (SELECT image, y, x, {_byte(f'floor({_GREY} + 0.5)')} AS v FROM cells JOIN blocks USING (image) WHERE j = y // 8 AND i = x // 8) SELECT CAST(image AS VARCHAR) AS image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {_RGB.format('v', 'v', 'v')} FROM grey")
def jpeg_file_scan(spark, sf_dir):
    """Pixels of JPEG files."""
    return _scanned(_jpeg)(spark, sf_dir)


# ---------------------------------------------------------------- block textures
def _texture(size: int, decode, mode_6: bool):
    """Pixels of the blocks of ``size`` bytes that each vector's 64 bytes form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            if not rows["vec_id"]:
                continue
            data = np.array(rows["s"], dtype=np.uint8).reshape(-1, size)
            if mode_6:
                data[:, 0] = data[:, 0] & 128 | 64
            px = decode(data).reshape(-1, 4).astype(np.int32)
            per = 64 // size * 16
            at = np.arange(len(px)) % per
            columns = [pa.array(np.repeat(np.array(rows["vec_id"], dtype=np.int64), per)), pa.array((at // 16).astype(np.int32)), pa.array((at % 16).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(px[:, k]) for k in range(4)], names=["vec_id", "block", "place", "r", "g", "b", "a"])

    return lambda spark, sf_dir: transform.block_samples(table(spark, sf_dir, "embeddings")).mapInArrow(run, "vec_id bigint, block int, place int, r int, g int, b int, a int")


def _bytes_sql(size: int) -> str:
    return f"{BLK_SQL}, raw AS (SELECT vec_id, pos // {size} AS block, list(s ORDER BY pos) AS l FROM blk GROUP BY 1, 2), places AS (SELECT range AS place FROM range(16))"


def _expanded(code: str) -> tuple[str, str, str]:
    r, g, b = f"(({code} >> 11) & 31)", f"(({code} >> 5) & 63)", f"({code} & 31)"
    return f"(({r} << 3) | ({r} >> 2))", f"(({g} << 2) | ({g} >> 4))", f"(({b} << 3) | ({b} >> 2))"


def _bc1_sql() -> str:
    channel = lambda p, q: f"CASE slot WHEN 0 THEN {p} WHEN 1 THEN {q} WHEN 2 THEN CASE WHEN c0 > c1 THEN (2 * {p} + {q}) // 3 ELSE ({p} + {q}) // 2 END ELSE CASE WHEN c0 > c1 THEN ({p} + 2 * {q}) // 3 ELSE 0 END END"
    rgb = [channel(p, q) for p, q in zip(_expanded("c0"), _expanded("c1"), strict=True)]
    return f"""WITH {_bytes_sql(8)}, ends AS (SELECT vec_id, block, l[1] + 256 * l[2] AS c0, l[3] + 256 * l[4] AS c1, l FROM raw),
slots AS (SELECT *, (l[5 + place // 4] >> (place % 4 * 2)) & 3 AS slot FROM ends, places)
SELECT vec_id, CAST(block AS INTEGER) AS block, CAST(place AS INTEGER) AS place, {_RGB.format(*rgb)}, CAST(CASE WHEN slot = 3 AND c0 <= c1 THEN 0 ELSE 255 END AS INTEGER) AS a FROM slots"""


def _bc7_sql() -> str:
    number = lambda at, width: "(" + " + ".join(f"(bits[{at + j + 1}] << {j})" for j in range(width)) + ")"
    ends = ", ".join(f"{number(7 + 14 * k + 7 * e, 7)} * 2 + bits[{64 + e}] AS {v}{e}" for k, v in enumerate("rgba") for e in (0, 1))
    slots = ", ".join([number(65, 3)] + [number(68 + 4 * i, 4) for i in range(15)])
    mixed = ", ".join(f"CAST(({v}0 * (64 - w) + {v}1 * w + 32) >> 6 AS INTEGER) AS {v}" for v in "rgba")
    return f"""WITH {_bytes_sql(16)}, sixth AS (SELECT vec_id, block, list_prepend((l[1] & 128) | 64, l[2:]) AS l FROM raw),
bit AS (SELECT vec_id, block, list_transform(range(128), lambda n: (l[n // 8 + 1] >> (n % 8)) & 1) AS bits FROM sixth),
ends AS (SELECT vec_id, block, {ends}, [{slots}] AS slots FROM bit),
each AS (SELECT *, [0, 4, 9, 13, 17, 21, 26, 30, 34, 38, 43, 47, 51, 55, 60, 64][slots[place + 1] + 1] AS w FROM ends, places)
SELECT vec_id, CAST(block AS INTEGER) AS block, CAST(place AS INTEGER) AS place, {mixed} FROM each"""


@query(_bc1_sql())
def bc1_decode(spark, sf_dir):
    """Pixels of BC1 blocks with any bytes, both kinds of palette included."""
    return _texture(8, block_texture.decode_bc1, False)(spark, sf_dir)


@query(_bc7_sql())
def bc7_decode(spark, sf_dir):
    """Pixels of BC7 blocks of mode 6 with any bytes."""
    return _texture(16, block_texture.decode_bc7, True)(spark, sf_dir)


# ---------------------------------------------------------------- hybrid files
def _formed_hybrid(rgba: np.ndarray) -> hybrid_file.HybridImage:
    """Units are palette and transform records in turn; coefficients and tables are formulas of unit, block and place."""
    p = _formed(rgba, 16)
    unit, k, at = np.meshgrid(np.arange(p.blocks), np.arange(6), np.arange(64), indexing="ij")
    other = np.where((at * 5 + unit + k) % 17 == 0, (unit + k * 3 + at) % 7 - 3, 0)
    blocks = np.where(at == 0, (unit * 13 + k * 29) % 61 - 30, other)
    steps = np.stack([np.arange(64) * 7 % 40 + 1, np.arange(64) * 5 % 50 + 3])
    return hybrid_file.HybridImage(rgba.shape[1], rgba.shape[0], np.arange(p.blocks) % 2, p, steps, blocks)


_HYBRID_SQL = f"""WITH {PX_SQL}, q AS (SELECT y // {BAND} AS image, y % {BAND} AS y, x, r % 4 AS slot, (y % {BAND}) // 16 * 7 + x // 16 AS unit FROM px),
grid AS (SELECT unit, k.range AS k, a.range AS pos FROM (SELECT DISTINCT unit FROM q WHERE unit % 2 = 1), range(6) k, range(64) a),
coefficients AS (SELECT unit, k, pos // 8 AS v, pos % 8 AS u, CASE WHEN pos = 0 THEN (unit * 13 + k * 29) % 61 - 30 WHEN (pos * 5 + unit + k) % 17 = 0 THEN (unit + k * 3 + pos) % 7 - 3 ELSE 0 END * CASE WHEN k < 4 THEN pos * 7 % 40 + 1 ELSE pos * 5 % 50 + 3 END AS d FROM grid),
basis AS (SELECT a.range AS bx, b.range AS bu, CAST(round(CASE WHEN b.range = 0 THEN sqrt(0.5) ELSE 1 END * cos((2 * a.range + 1) * b.range * pi() / 16) * 16384) AS BIGINT) AS w FROM range(8) a, range(8) b),
wide AS (SELECT unit, k, v, bx AS x, {_half_away('sum(d * w)', 16384)} AS h FROM coefficients JOIN basis ON bu = u GROUP BY 1, 2, 3, 4),
plane AS (SELECT unit, k, bx AS y, x, {_byte(_half_away('sum(h * w)', 65536) + ' + 128')} AS s FROM wide JOIN basis ON bu = v GROUP BY 1, 2, 3, 4),
tap AS (SELECT range AS at, greatest(0, range // 2 - 1 + range % 2) AS src, CASE WHEN range % 2 = 0 THEN 1 ELSE 3 END AS w FROM range(16) UNION ALL SELECT range, least(7, range // 2 + range % 2), CASE WHEN range % 2 = 0 THEN 3 ELSE 1 END FROM range(16)),
chroma AS (SELECT unit, k, ty.at AS y, tx.at AS x, {_half_away('sum(s * ty.w * tx.w)', 16)} - 128 AS s FROM plane JOIN tap ty ON plane.y = ty.src JOIN tap tx ON plane.x = tx.src WHERE k >= 4 GROUP BY 1, 2, 3, 4),
luma AS (SELECT unit, k // 2 * 8 + y AS y, k % 2 * 8 + x AS x, s FROM plane WHERE k < 4),
units AS (SELECT l.unit, l.y AS uy, l.x AS ux, l.s AS l, cb.s AS cb, cr.s AS cr FROM luma l JOIN chroma cb ON cb.k = 4 AND (cb.unit, cb.y, cb.x) = (l.unit, l.y, l.x) JOIN chroma cr ON cr.k = 5 AND (cr.unit, cr.y, cr.x) = (l.unit, l.y, l.x)),
looked AS (SELECT *, unit % 2 AS mode, (unit * 3 + slot * 5) % 16 AS i FROM q),
made AS (SELECT image, y, x, {_byte('l + ' + _half_away('91881 * cr', 65536))} AS r, {_byte('l + ' + _half_away('-22554 * cb - 46802 * cr', 65536))} AS g, {_byte('l + ' + _half_away('116130 * cb', 65536))} AS b FROM q JOIN units USING (unit) WHERE uy = y % 16 AND ux = x % 16
  UNION ALL SELECT image, y, x, i * 16 % 256, i * 9 % 256, (255 - i * 5) % 256 FROM looked WHERE mode = 0)
SELECT CAST(image AS VARCHAR) AS image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {_RGB.format('r', 'g', 'b')} FROM made"""


@query(_HYBRID_SQL)
def hybrid_file_pixels(spark, sf_dir):
    """Pixels of hybrid files, palette and transform units in turn."""
    return _scanned(lambda rgba: hybrid_file.encode(_formed_hybrid(rgba)))(spark, sf_dir)


# ---------------------------------------------------------------- transform files
# The base tables of luma and chroma.
_LUMA = """16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99""".split()
_CHROMA = """17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99""".split()


def _formed_transform(rgba: np.ndarray) -> bytes:
    """A file whose records hold a first coefficient, 18 or 7 others along the zigzag, and a scale, all given by formulas."""
    file = dct_file.encode(np.zeros_like(rgba[..., :3]), "1", coding=0)
    units = -(-rgba.shape[0] // 16) * -(-rgba.shape[1] // 16)
    out = [file[: dct_file.HEAD]]
    for unit in range(units):
        for k, (size, count) in enumerate(((16, 18), (8, 7), (8, 7))):
            record = Writer().put(0, 4).put((unit + k) % 3, 4).put(((unit * 31 + k * 17) % 120 - 60) & 1023, 10)
            for j in range(count):
                record.put(((unit * 5 + j * 7 + k * 3) % 7 - 3) & 63, 6)
            out.append(record.bytes().ljust(size, b"\0"))
    return b"".join(out)


_TRANSFORM_SQL = f"""WITH {PX_SQL}, q AS (SELECT y // {BAND} AS image, y % {BAND} AS y, x, (y % {BAND}) // 16 * 7 + x // 16 AS unit FROM px),
base AS (SELECT false AS chroma, unnest([{', '.join(_LUMA)}]) AS step, unnest(range(64)) AS slot UNION ALL SELECT true, unnest([{', '.join(_CHROMA)}]), unnest(range(64))),
grid AS (SELECT n, a.range AS u, b.range AS v, row_number() OVER (PARTITION BY n ORDER BY a.range + b.range, CASE WHEN (a.range + b.range) % 2 = 0 THEN a.range ELSE -a.range END) - 2 AS j FROM (VALUES (8), (16)) s(n), range(16) a, range(16) b WHERE a.range < n AND b.range < n),
component AS (SELECT * FROM (VALUES (0, 16, 18), (1, 8, 7), (2, 8, 7)) c(k, n, count)),
field AS (SELECT unit, k, n, u, v, j, (1 << ((unit + k) % 3)) * CASE WHEN j < 0 THEN (unit * 31 + k * 17) % 120 - 60 ELSE (unit * 5 + j * 7 + k * 3) % 7 - 3 END AS value FROM (SELECT DISTINCT unit FROM q), component JOIN grid USING (n) WHERE j < count),
coefficient AS (SELECT unit, k, n, u, v, value * greatest(1, step * 0.5 * n / 8) AS f FROM field JOIN base ON chroma = (k > 0) AND slot = CAST(floor(v * 7.0 / (n - 1) + 0.5) AS BIGINT) * 8 + CAST(floor(u * 7.0 / (n - 1) + 0.5) AS BIGINT)),
place AS (SELECT n, a.range AS px, b.range AS py FROM (VALUES (8), (16)) s(n), range(16) a, range(16) b WHERE a.range < n AND b.range < n),
plane AS (SELECT unit, k, py AS y, px AS x, sum(f * CASE WHEN u = 0 THEN sqrt(1.0 / n) ELSE sqrt(2.0 / n) END * CASE WHEN v = 0 THEN sqrt(1.0 / n) ELSE sqrt(2.0 / n) END * cos(pi() * (2 * px + 1) * u / (2 * n)) * cos(pi() * (2 * py + 1) * v / (2 * n))) AS s FROM coefficient JOIN place USING (n) GROUP BY 1, 2, 3, 4),
tap AS (SELECT range AS at, greatest(0, range // 2 - 1 + range % 2) AS src, CASE WHEN range % 2 = 0 THEN 1 ELSE 3 END AS w FROM range(16) UNION ALL SELECT range, least(7, range // 2 + range % 2), CASE WHEN range % 2 = 0 THEN 3 ELSE 1 END FROM range(16)),
chroma AS (SELECT unit, k, ty.at AS y, tx.at AS x, sum(s * ty.w * tx.w) / 16 AS s FROM plane JOIN tap ty ON plane.y = ty.src JOIN tap tx ON plane.x = tx.src WHERE k > 0 GROUP BY 1, 2, 3, 4),
units AS (SELECT l.unit, l.y AS uy, l.x AS ux, l.s + 128 AS l, cb.s AS cb, cr.s AS cr FROM plane l JOIN chroma cb ON cb.k = 1 AND (cb.unit, cb.y, cb.x) = (l.unit, l.y, l.x) JOIN chroma cr ON cr.k = 2 AND (cr.unit, cr.y, cr.x) = (l.unit, l.y, l.x) WHERE l.k = 0)
SELECT CAST(image AS VARCHAR) AS image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {_RGB.format(*[_byte(f'floor({v} + 0.5)') for v in ('l + 1.402 * cr', 'l - 0.344136 * cb - 0.714136 * cr', 'l + 1.772 * cb')])} FROM q JOIN units USING (unit) WHERE uy = y % 16 AND ux = x % 16"""


@query(_TRANSFORM_SQL)
def transform_file_pixels(spark, sf_dir):
    """Pixels of transform files, decoded image by image."""
    return _scanned(_formed_transform)(spark, sf_dir)


@query(_TRANSFORM_SQL)
def transform_units_scan(spark, sf_dir):
    """The same pixels from units cut out by position and decoded apart."""
    files = _per_image(images(spark, sf_dir), "image_id string, content binary", lambda rgba: (_formed_transform(rgba),))
    return tables.decode_units(tables.transform_units(files))


def _unit_folder(spark, sf_dir):
    """A folder with the transform file of every image, written by executors."""
    made = _per_image(images(spark, sf_dir), "image_id string, data binary", lambda rgba: (_formed_transform(rgba),))
    root = f"{Workspace(spark, 'units').root}/files"
    tables.write_files(made, root, ".dct")
    return root


@query(_TRANSFORM_SQL)
def unit_source_pixels(spark, sf_dir):
    """The same pixels from files that a source cuts into ranges of units."""
    return tables.decode_units(unit_source.read_units(spark, _unit_folder(spark, sf_dir), units=5))


@query(_TRANSFORM_SQL + " AND unit BETWEEN 3 AND 8")
def unit_source_range(spark, sf_dir):
    """Some units of each image; the condition reaches the source, which does not read the others."""
    units = unit_source.read_units(spark, _unit_folder(spark, sf_dir), units=5)
    return tables.decode_units(units.where("unit between 3 and 8"))


# ---------------------------------------------------------------- sizes of packed palettes
_PACKED_SQL = f"""WITH {PX_SQL}, q AS (SELECT y // {BAND} AS image, y % {BAND} AS y, x, r, g, b FROM px),
first AS (SELECT image, 2 + r AS m FROM q WHERE x = 0 AND y = 0),
entry AS (SELECT image, y AS p, unnest([0, 1, 2]) AS channel, unnest([r % m, g % m, b % m]) AS v FROM q JOIN first USING (image) WHERE y < 2 AND x < 16),
spans AS (SELECT image, p, channel, max(v) - min(v) AS span FROM entry GROUP BY 1, 2, 3),
widths AS (SELECT image, p, sum(CASE WHEN span = 0 THEN 0 ELSE floor(log2(span)) + 1 END) AS w FROM spans GROUP BY 1, 2),
records AS (SELECT image, sum(least(49, 5 + ceil(16 * w / 8))) AS records FROM widths GROUP BY 1),
size AS (SELECT image, count(*) AS pixels, 13 * CAST(ceil((max(y) + 1) / 8) AS BIGINT) AS blocks FROM q GROUP BY 1)
SELECT CAST(image AS VARCHAR) AS image_id, 4 + 8 + records < 96 AS packed, CAST(14 + ceil(((CASE WHEN 12 + records < 96 THEN 12 + records ELSE 96 END) * 8 + blocks * (1 + 4 * 4) + pixels * 2) / 8) AS BIGINT) AS bytes FROM size JOIN records USING (image)"""


@query(_PACKED_SQL)
def packed_palette_gain(spark, sf_dir):
    """Sizes of files whose palettes are pixels, the closer the darker the first one: packed only where that is smaller."""

    def one(rgba):
        image = _formed(rgba)
        image.palette = rgba[:2, :16, :3].astype(np.int64) % (2 + int(rgba[0, 0, 0]))
        data = palette_file.encode(image)
        if (palette_file.decode(data).pixels() != image.pixels()).any():
            raise ValueError("the file gives another image")
        return palette_file.read_header(data).packed, len(data)

    return _per_image(images(spark, sf_dir), "image_id string, packed boolean, bytes bigint", one)


# ---------------------------------------------------------------- sinks, folders and lists
def _written(spark, sf_dir) -> str:
    """A folder of PPM files."""
    root = f"{Workspace(spark, 'sinks').root}/scans"
    made = _per_image(images(spark, sf_dir), "image_id string, data binary", lambda rgba: (containers.write_ppm(rgba[..., :3]),))
    tables.write_files(made, root, ".ppm")
    return root


@query(_IMG + " SELECT image_id, 12 + length(CAST(pixels // 100 AS VARCHAR)) + pixels * 3 AS length, 'scans' AS image_class FROM img")
def corpus_scan(spark, sf_dir):
    """Files that executors wrote, listed with their folder as class."""
    return tables.corpus(spark, _written(spark, sf_dir), "*.ppm", {}).select("image_id", "length", "image_class")


@query(_IMG + """ SELECT '{"default":"' || min(image_id) || '.ppm","files":[' || string_agg('"' || image_id || '.ppm"', ',' ORDER BY image_id) || ']}' AS manifest FROM img""")
def asset_manifest(spark, sf_dir):
    return tables.manifest(spark, _written(spark, sf_dir), "*.ppm")


@query("SELECT n_name AS id, 'maps/' || n_nationkey AS path, r_name AS class, CASE WHEN n_nationkey % 2 = 0 THEN 'srgb' END AS transfer FROM nation JOIN region ON r_regionkey = n_regionkey")
def image_list_scan(spark, sf_dir):
    """A list of images in one JSON document."""
    root = f"{Workspace(spark, 'sinks').root}/list"
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), c("r_regionkey") == c("n_regionkey"))
    image = F.struct(c("n_name").alias("id"), F.concat(F.lit("maps/"), "n_nationkey").alias("path"), c("r_name").alias("class"), F.when(c("n_nationkey") % 2 == 0, "srgb").alias("transfer"))
    both.agg(F.to_json(F.struct(F.collect_list(image).alias("images"))).alias("value")).write.text(root)
    return tables.image_list(spark, root)


@query("SELECT 'part-' || p_partkey AS id, 'maps/' || p_brand || '/' || p_partkey AS path, p_type AS class, CASE WHEN p_partkey % 2 = 0 THEN 'srgb' END AS transfer FROM part WHERE p_size <= 25")
def image_lines_scan(spark, sf_dir):
    """A list of images on lines, written and read by many tasks, and the entries that a relation of ids asks for."""
    root = f"{Workspace(spark, 'sinks').root}/lines"
    k = c("p_partkey").cast("string")
    p = table(spark, sf_dir, "part")
    entry = [F.concat(F.lit("part-"), k).alias("id"), F.concat(F.lit("maps/"), "p_brand", F.lit("/"), k).alias("path"), c("p_type").alias("class"), F.when(c("p_partkey") % 2 == 0, "srgb").alias("transfer")]
    tables.spread(p.select(*entry), "id").write.json(root)
    return tables.image_list(spark, root, p.where("p_size <= 25").select(entry[0]), lines=True)


@query(_IMG + " SELECT image_id || '.ppm' AS name, image_id = min(image_id) OVER () AS is_default FROM img")
def asset_lines(spark, sf_dir):
    """A manifest of files as lines, in ranges of their names."""
    return tables.manifest_lines(spark, _written(spark, sf_dir), "*.ppm", f"{Workspace(spark, 'sinks').root}/assets")


@query("SELECT l_returnflag AS dataset, count(*) AS images, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS payload_bytes FROM lineitem GROUP BY 1")
def report_sinks(spark, sf_dir):
    """A report written as JSON, CSV and Markdown, and read back from each in turn."""
    root = f"{Workspace(spark, 'sinks').root}/report"
    r = table(spark, sf_dir, "lineitem").groupBy(c("l_returnflag").alias("dataset")).agg(F.count("*").alias("images"), F.sum(c("l_quantity").cast("long")).alias("payload_bytes"))
    tables.write_report(r, root, ["dataset", "images", "payload_bytes"])
    schema = "dataset string, images bigint, payload_bytes bigint"
    cells = F.split("value", r" *\| *")
    text = spark.read.text(f"{root}/markdown").where("value not like '| ---%' and value not like '| dataset%'")
    markdown = text.select(F.get(cells, F.lit(1)).alias("dataset"), F.get(cells, F.lit(2)).cast("long").alias("images"), F.get(cells, F.lit(3)).cast("long").alias("payload_bytes"))
    kinds = [spark.read.schema(schema).json(f"{root}/json"), spark.read.schema(schema).option("header", "true").csv(f"{root}/csv"), markdown]
    return kinds[0].intersectAll(kinds[1]).intersectAll(kinds[2])


@query(_IMG + ", k AS (SELECT * FROM (VALUES ('bc1', 8, 128, 'DXT1'), ('bc7', 16, 148, 'DX10')) k(kind, size, head, code)), s AS (SELECT image_id, kind, head, code, pixels // 100 AS height, 25 * CAST(ceil(pixels // 100 / 4.0) AS BIGINT) * size AS payload FROM img, k) SELECT image_id, kind, head + payload AS bytes, height, 100 AS width, payload, code FROM s")
def texture_containers(spark, sf_dir):
    """Fields of DDS files, cut out of their headers by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                rgba = np.frombuffer(r["rgba"], dtype=np.uint8).reshape(r["height"], r["width"], 4)
                b = block_texture.blocks_of(np.concatenate([rgba[..., :3], np.full_like(rgba[..., 3:], 255)], axis=-1))
                for kind, data in (("bc1", block_texture.encode_bc1(b, "fast")), ("bc7", block_texture.encode_bc7(b))):
                    rows.append({"image_id": r["image_id"], "kind": kind, "content": containers.write_dds(kind, data.astype(np.uint8).tobytes(), r["width"], r["height"])})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("image_id", pa.string()), ("kind", pa.string()), ("content", pa.binary())]))

    little = lambda at: F.conv(F.concat(*[F.hex(F.substring("content", at + k, 1)) for k in (4, 3, 2, 1)]), 16, 10).cast("long")
    return images(spark, sf_dir).mapInArrow(run, "image_id string, kind string, content binary").select(
        "image_id", "kind", F.length("content").cast("long").alias("bytes"), little(12).alias("height"), little(16).alias("width"), little(20).alias("payload"), F.substring("content", 85, 4).cast("string").alias("code")
    )


# ---------------------------------------------------------------- similarity
_SSIM_SQL = f"""WITH {PX_SQL}, cells AS (SELECT y // {BAND} AS image, y % {BAND} AS y, x, 0.2126 * r + 0.7152 * g + 0.0722 * b AS l, 0.2126 * (r // 64 * 64) + 0.7152 * (g // 64 * 64) + 0.0722 * (b // 64 * 64) AS m FROM px),
size AS (SELECT image, max(y) AS h FROM cells GROUP BY 1 HAVING max(y) >= 10),
tap AS (SELECT range AS k, exp(-((range - 5) ** 2) / 4.5) / sum(exp(-((range - 5) ** 2) / 4.5)) OVER () AS w FROM range(11)),
moved AS (SELECT image, y, x - k AS x, sum(l * w) AS l, sum(m * w) AS m, sum(l * l * w) AS ll, sum(m * m * w) AS mm, sum(l * m * w) AS lm FROM cells, tap WHERE x - k BETWEEN 0 AND 89 GROUP BY 1, 2, 3),
smooth AS (SELECT image, y - k AS y, x, sum(l * w) AS l, sum(m * w) AS m, sum(ll * w) AS ll, sum(mm * w) AS mm, sum(lm * w) AS lm FROM moved JOIN size USING (image), tap WHERE y - k BETWEEN 0 AND h - 10 GROUP BY 1, 2, 3)
SELECT CAST(image AS VARCHAR) AS image_id, round(avg((2 * l * m + 6.5025) * (2 * (lm - l * m) + 58.5225) / ((l * l + m * m + 6.5025) * (greatest(0, ll - l * l) + greatest(0, mm - m * m) + 58.5225))), 3) AS ssim FROM smooth GROUP BY 1"""


@query(_SSIM_SQL)
def ssim_coarse(spark, sf_dir):
    """Similarity of each image to itself in four levels of each channel; three digits, as the operator uses single precision."""
    coarse = [(F.floor(c(v) / 64) * 64).alias(f"{v}2") for v in "rgb"]
    p = pixels(spark, sf_dir).select((c("y") / BAND).cast("long").cast("string").alias("image_id"), (c("y") % BAND).alias("y"), "x", "r", "g", "b", *coarse)
    return reports.ssim(p).where("ssim is not null").select("image_id", F.round("ssim", 3).alias("ssim"))


@query(_SSIM_SQL.replace(f"y // {BAND} AS image, y % {BAND} AS y", "0 AS image, y"))
def ssim_whole(spark, sf_dir):
    """The same for all pixels as one image, which spreads over tasks by tiles."""
    coarse = [(F.floor(c(v) / 64) * 64).alias(f"{v}2") for v in "rgb"]
    p = pixels(spark, sf_dir).select(F.lit("0").alias("image_id"), "y", "x", "r", "g", "b", *coarse)
    return reports.ssim(p).where("ssim is not null").select("image_id", F.round("ssim", 3).alias("ssim"))


# ---------------------------------------------------------------- validation
_CHECKED = "p_partkey AS id, p_partkey % 11 AS width, [2, 3, 4, 8, 512][p_partkey % 5 + 1] AS block, [1, 2, 4, 8, 32][p_partkey // 5 % 5 + 1] AS local, [4, 16, 256, 512][p_partkey // 25 % 4 + 1] AS shared, [1, 2, 128, 256][p_partkey // 3 % 4 + 1] AS palettes, CASE WHEN p_partkey % 13 = 0 THEN 20 ELSE 24 END AS bits, p_partkey // 7 % 3 AS extra"


@query(f"""WITH s AS (SELECT {_CHECKED} FROM part)
SELECT id, CASE WHEN width = 0 THEN 'bad dimensions' WHEN block = 3 THEN 'block is not a power of two' WHEN block = 512 THEN 'block out of range'
  WHEN local NOT BETWEEN 2 AND 16 THEN 'local out of range' WHEN shared > 256 THEN 'shared out of range' WHEN palettes > 128 THEN 'palettes out of range'
  WHEN local > shared OR local > block * block THEN 'more local colours than shared colours or pixels' WHEN bits = 20 THEN 'bad colour mode'
  WHEN extra = 1 THEN 'wrong number of blocks' WHEN extra = 2 THEN 'value out of range' ELSE '' END AS fault FROM s""")
def palette_constraints(spark, sf_dir):
    """The first constraint that each of many settings breaks."""
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    div = lambda n: F.expr(f"p_partkey div {n}")
    s = table(spark, sf_dir, "part").select(
        c("p_partkey").alias("id"), (c("p_partkey") % 11).alias("width"), pick([2, 3, 4, 8, 512], c("p_partkey") % 5).alias("block"), pick([1, 2, 4, 8, 32], div(5) % 5).alias("local"),
        pick([4, 16, 256, 512], div(25) % 4).alias("shared"), pick([1, 2, 128, 256], div(3) % 4).alias("palettes"), F.when(c("p_partkey") % 13 == 0, 20).otherwise(24).alias("bits"), (div(7) % 3).alias("extra"),
    )

    blocks = F.ceil(c("width") / c("block")) * F.ceil(F.lit(2) / c("block"))
    given = blocks + (c("extra") == 1).cast("int")
    return s.select("id", settings_search.palette_fault(c("width"), F.lit(2), c("block"), c("local"), c("shared"), c("palettes"), c("bits"), given, F.when(c("extra") == 2, 300).otherwise(7)).alias("fault"))
