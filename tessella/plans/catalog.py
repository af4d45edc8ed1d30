"""Queries over the star-schema tables, each with its SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import coding, color
from tessella.functions import numeric as num
from tessella.operators import matching, prefix, reports, sampling, settings_search, transform
from tessella.operators import pixels as px_ops
from tessella.operators.settings_search import rate_bits, rate_guard
from tessella.plans.fixtures import BLK_SQL, PX_SQL, RECORDS_SQL, WIDTH, pixels, records, samples, table
from tessella.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- pixels and colours
RT = "floor(floor(CAST({0} AS BIGINT) * {1} / 255.0 + 0.5) * 255 / {1}.0 + 0.5)"
R5, G6, B5 = RT.format("r", 31), RT.format("g", 63), RT.format("b", 31)
QR, QG, QB = (f"CAST(floor({v} * {t} / 255.0 + 0.5) AS BIGINT)" for v, t in (("r", 31), ("g", 63), ("b", 31)))


def _with_565(px: DataFrame) -> DataFrame:
    back = {f"{v}2": color.expand_rounded(color.quantise_channel(c(v), bits), bits) for v, bits in zip("rgb", (5, 6, 5), strict=True)}
    return px.withColumns(back)


@query(f"WITH {PX_SQL} SELECT y // 8 * 13 + x // 8 AS block, CAST(sum((r-{R5})**2 + (g-{G6})**2 + (b-{B5})**2) AS BIGINT) AS sse, count(*) * 3 AS samples, round(10*log10(65025.0*count(*)*3/sum((r-{R5})**2 + (g-{G6})**2 + (b-{B5})**2)), 6) AS psnr FROM px GROUP BY 1")
def rgb565_psnr_by_block(spark, sf_dir):
    """Flagship: error and PSNR of every 8x8 block after a round trip through 16-bit colour."""
    blocks = px_ops.with_block(_with_565(pixels(spark, sf_dir)), 8, WIDTH)
    e = px_ops.squared_error(blocks, "block")
    return e.select("block", "sse", "samples", F.round(num.psnr(c("sse") / c("samples")), 6).alias("psnr"))


@query(f"WITH {PX_SQL}, e AS (SELECT y // 8 * 13 + x // 8 AS block, CAST(sum((r-{R5})**2 + (g-{G6})**2 + (b-{B5})**2) AS BIGINT) AS sse FROM px GROUP BY 1) SELECT block, sse FROM e ORDER BY sse DESC, block LIMIT 10")
def worst_blocks_topk(spark, sf_dir):
    return rgb565_psnr_by_block(spark, sf_dir).select("block", "sse").orderBy(F.desc("sse"), "block").limit(10)


@query(f"WITH {PX_SQL} SELECT r * 65536 + g * 256 + b AS rgb, count(*) AS n, min(pos) AS first_pos FROM px WHERE a <> 0 GROUP BY 1")
def hist_colors(spark, sf_dir):
    return px_ops.histogram(pixels(spark, sf_dir))


@query(f"WITH {PX_SQL} SELECT count(DISTINCT r * 65536 + g * 256 + b) AS colors FROM px WHERE a <> 0")
def unique_colors(spark, sf_dir):
    return px_ops.opaque(pixels(spark, sf_dir)).agg(F.count_distinct(color.color_key(c("r"), c("g"), c("b"))).alias("colors"))


_DESC = ", ".join(f"round(avg({v}), 6) AS mean_{v}, round(sqrt(greatest(0, avg({v}*{v}) - avg({v})*avg({v}))) * 0.5, 6) AS dev_{v}" for v in "rgb")


@query(f"WITH {PX_SQL} SELECT y // 8 * 13 + x // 8 AS block, {_DESC} FROM px WHERE a <> 0 GROUP BY 1")
def block_descriptors(spark, sf_dir):
    d = px_ops.block_descriptors(px_ops.with_block(pixels(spark, sf_dir), 8, WIDTH))
    return d.select("block", *[F.round(v, 6).alias(v) for v in d.columns if v != "block"])


@query(f"WITH {PX_SQL} SELECT pos, {QR} * 2048 + {QG} * 32 + {QB} AS packed, CAST({R5} AS BIGINT) AS r, CAST({G6} AS BIGINT) AS g, CAST({B5} AS BIGINT) AS b, ({QR} << 3) | ({QR} >> 2) AS r_rep, ({QG} << 2) | ({QG} >> 4) AS g_rep, ({QB} << 3) | ({QB} >> 2) AS b_rep FROM px")
def rgb565_codes(spark, sf_dir):
    """Packed code with both published expansions, by rounding and by repeating bits."""
    p = pixels(spark, sf_dir)
    rep = [color.expand_replicated(color.quantise_channel(c(v), bits), bits).alias(f"{v}_rep") for v, bits in zip("rgb", (5, 6, 5), strict=True)]
    return _with_565(p).select("pos", color.pack565(c("r"), c("g"), c("b")).alias("packed"), c("r2").alias("r"), c("g2").alias("g"), c("b2").alias("b"), *rep)


def _rd(x: str, d: int) -> str:
    return f"(CASE WHEN ({x}) < 0 THEN -((-({x}) + {d // 2}) // {d}) ELSE (({x}) + {d // 2}) // {d} END)"


def _cl(x: str) -> str:
    return f"least(255, greatest(0, {x}))"


_YCC = [_cl(_rd("19595*r + 38470*g + 7471*b", 65536)), _cl("128 + " + _rd("-11059*r - 21709*g + 32768*b", 65536)), _cl("128 + " + _rd("32768*r - 27439*g - 5329*b", 65536))]


@query(f"WITH {PX_SQL} SELECT pos, {_YCC[0]} AS yy, {_YCC[1]} AS cb, {_YCC[2]} AS cr FROM px")
def ycbcr_fixed(spark, sf_dir):
    yy, cb, cr = color.rgb_to_ycc_fixed(c("r"), c("g"), c("b"))
    return pixels(spark, sf_dir).select("pos", yy.alias("yy"), cb.alias("cb"), cr.alias("cr"))


@query(
    f"WITH {PX_SQL}, t AS (SELECT pos, r, g, b, {_YCC[0]} AS yy, {_YCC[1]} - 128 AS cb, {_YCC[2]} - 128 AS cr FROM px), "
    f"o AS (SELECT *, {_cl('yy + ' + _rd('91881*cr', 65536))} AS r2, {_cl('yy + ' + _rd('-22554*cb - 46802*cr', 65536))} AS g2, {_cl('yy + ' + _rd('116130*cb', 65536))} AS b2 FROM t) "
    "SELECT CAST(sum((r-r2)*(r-r2)+(g-g2)*(g-g2)+(b-b2)*(b-b2)) AS BIGINT) AS sse, count(*) * 3 AS samples FROM o"
)
def roundtrip_sse(spark, sf_dir):
    yy, cb, cr = color.rgb_to_ycc_fixed(c("r"), c("g"), c("b"))
    p = pixels(spark, sf_dir).select("r", "g", "b", yy.alias("yy"), cb.alias("cb"), cr.alias("cr"))
    back = color.ycc_to_rgb_fixed(c("yy"), c("cb"), c("cr"))
    return px_ops.squared_error(p.select("r", "g", "b", *[v.alias(f"{n}2") for n, v in zip("rgb", back, strict=True)]))


@query(f"WITH {PX_SQL} SELECT pos, round(0.299*r + 0.587*g + 0.114*b, 6) AS yy, round(128 - 0.168736*r - 0.331264*g + 0.5*b, 6) AS cb, round(128 + 0.5*r - 0.418688*g - 0.081312*b, 6) AS cr, round(0.2126*r + 0.7152*g + 0.0722*b, 6) AS luma FROM px")
def ycbcr_float(spark, sf_dir):
    out = color.rgb_to_ycc(c("r"), c("g"), c("b"))
    return pixels(spark, sf_dir).select("pos", *[F.round(v, 6).alias(n) for n, v in zip(("yy", "cb", "cr"), out, strict=True)], F.round(color.luma(c("r"), c("g"), c("b")), 6).alias("luma"))


def _lin(v: str) -> str:
    return f"CASE WHEN {v}/255.0 <= 0.04045 THEN {v}/255.0/12.92 ELSE pow(({v}/255.0 + 0.055)/1.055, 2.4) END"


def _row(k: tuple, names: str) -> str:
    return " + ".join(f"({w}) * {n}" for w, n in zip(k, names.split(), strict=True))


_LAB_SQL = (
    f"lin AS (SELECT DISTINCT r, g, b, {_lin('r')} AS lr, {_lin('g')} AS lg, {_lin('b')} AS lb FROM px), "
    f"lms AS (SELECT r, g, b, cbrt({_row(color.TO_LMS[0], 'lr lg lb')}) AS l, cbrt({_row(color.TO_LMS[1], 'lr lg lb')}) AS m, cbrt({_row(color.TO_LMS[2], 'lr lg lb')}) AS s FROM lin), "
    f"lab AS (SELECT r, g, b, {_row(color.TO_LAB[0], 'l m s')} AS ok_l, {_row(color.TO_LAB[1], 'l m s')} AS ok_a, {_row(color.TO_LAB[2], 'l m s')} AS ok_b FROM lms)"
)


@query(f"WITH {PX_SQL}, {_LAB_SQL} SELECT r, g, b, round(ok_l, 6) AS ok_l, round(ok_a, 6) + 0.0 AS ok_a, round(ok_b, 6) + 0.0 AS ok_b FROM lab")
def oklab_project(spark, sf_dir):
    lab = color.rgb_to_oklab(c("r"), c("g"), c("b"))
    return pixels(spark, sf_dir).select("r", "g", "b").distinct().select("r", "g", "b", *[(F.round(v, 6) + 0.0).alias(n) for n, v in zip(("ok_l", "ok_a", "ok_b"), lab, strict=True)])


@query(f"WITH {PX_SQL} SELECT DISTINCT r, g, b, r AS r2, g AS g2, b AS b2 FROM px")
def oklab_roundtrip(spark, sf_dir):
    """Bytes to OKLab and back: every colour returns to itself."""
    colors = pixels(spark, sf_dir).select("r", "g", "b").distinct()
    lab = colors.select("r", "g", "b", *[v.alias(n) for n, v in zip(("l", "m", "n"), color.rgb_to_oklab(c("r"), c("g"), c("b")), strict=True)])
    return lab.select("r", "g", "b", *[num.half_up(v).cast("long").alias(f"{n}2") for n, v in zip("rgb", color.oklab_to_rgb(c("l"), c("m"), c("n")), strict=True)])


@query(f"WITH {PX_SQL} SELECT pos, '#' || lpad(lower(to_hex(r * 65536 + g * 256 + b)), 6, '0') AS hex FROM px")
def color_hex(spark, sf_dir):
    return pixels(spark, sf_dir).select("pos", color.color_hex(color.color_key(c("r"), c("g"), c("b"))).alias("hex"))


_PAL = "pal AS (SELECT range AS idx, (range*53+17)%256 AS pr, (range*97+5)%256 AS pg, (range*29+101)%256 AS pb FROM range(16))"


def palette(spark: SparkSession, n: int = 16) -> DataFrame:
    """A fixed palette that a rule makes."""
    i = c("id")
    return spark.range(n).select(i.alias("idx"), ((i * 53 + 17) % 256).alias("r"), ((i * 97 + 5) % 256).alias("g"), ((i * 29 + 101) % 256).alias("b"))


_D2 = "(r-pr)*(r-pr)+(g-pg)*(g-pg)+(b-pb)*(b-pb)"


@query(f"WITH {PX_SQL}, {_PAL} SELECT r, g, b, arg_min(idx, {{'d': {_D2}, 'i': idx}}) AS idx, min({_D2}) AS distance FROM (SELECT DISTINCT r, g, b FROM px), pal GROUP BY 1, 2, 3")
def fixed_palette_nn(spark, sf_dir):
    return matching.nearest_join(pixels(spark, sf_dir).select("r", "g", "b").distinct(), palette(spark))


@query(f"WITH {PX_SQL}, {_PAL} SELECT idx, count(*) AS n FROM (SELECT pos, arg_min(idx, {{'d': abs(r-pr)+abs(g-pg)+abs(b-pb), 'i': idx}}) AS idx FROM px, pal GROUP BY 1) GROUP BY 1")
def palette_usage_l1(spark, sf_dir):
    """Pixels of each entry under the city distance, through distinct colours."""
    return matching.assign(pixels(spark, sf_dir), palette(spark), "l1").groupBy("idx").agg(F.count("*").alias("n"))


@query(f"WITH {PX_SQL}, {_PAL} SELECT r, g, b, row_number() OVER (PARTITION BY r, g, b ORDER BY {_D2}, idx) AS rank, idx, {_D2} AS distance FROM (SELECT DISTINCT r, g, b FROM px), pal QUALIFY row_number() OVER (PARTITION BY r, g, b ORDER BY {_D2}, idx) <= 4")
def knn_palette(spark, sf_dir):
    k = matching.k_nearest(pixels(spark, sf_dir).select("r", "g", "b").distinct(), palette(spark), 4)
    return k.withColumn("rank", c("rank").cast("long"))


@query("WITH " + _PAL + ", p2 AS (SELECT idx AS j, pr AS qr, pg AS qg, pb AS qb FROM pal) SELECT idx AS i, j, (pr-qr)*(pr-qr)+(pg-qg)*(pg-qg)+(pb-qb)*(pb-qb) AS distance FROM pal, p2")
def palette_distance_matrix(spark, sf_dir):
    return matching.distance_matrix(palette(spark))


def _bayer_sql(n: int, matrix: tuple) -> str:
    return f"(([{', '.join(map(str, matrix))}][(y % {n}) * {n} + x % {n} + 1] + 0.5) / {n * n} - 0.5) * 48"


@query(f"WITH {PX_SQL}, {_PAL}, t AS (SELECT pos, r + {_bayer_sql(4, px_ops.BAYER_4)} AS r, g + {_bayer_sql(4, px_ops.BAYER_4)} AS g, b + {_bayer_sql(4, px_ops.BAYER_4)} AS b FROM px WHERE a <> 0) SELECT pos, arg_min(idx, {{'d': {_D2}, 'i': idx}}) AS idx FROM t, pal GROUP BY 1")
def bayer_nearest_palette(spark, sf_dir):
    """Ordered dithering: the entry nearest to each shifted pixel, as a column expression."""
    entries = matching.palette_rows(palette(spark))
    t = px_ops.bayer_threshold(c("x"), c("y"), 4)
    p = px_ops.opaque(pixels(spark, sf_dir)).select("pos", *[(c(v) + t).alias(v) for v in "rgb"])
    return p.select("pos", matching.nearest_index(c("r"), c("g"), c("b"), entries).cast("long").alias("idx"))


@query(f"WITH {PX_SQL} SELECT pos, round({_bayer_sql(2, px_ops.BAYER_2)}, 6) AS t2, round({_bayer_sql(4, px_ops.BAYER_4)}, 6) AS t4 FROM px")
def bayer_thresholds(spark, sf_dir):
    return pixels(spark, sf_dir).select("pos", F.round(px_ops.bayer_threshold(c("x"), c("y"), 2), 6).alias("t2"), F.round(px_ops.bayer_threshold(c("x"), c("y"), 4), 6).alias("t4"))


@query(f"WITH {PX_SQL}, m AS (SELECT max(y) + 1 AS h FROM px), t AS (SELECT bx, b_y, lx, ly FROM range(7) a(bx), range(2000) d(b_y), range(16) e(lx), range(16) f(ly), m WHERE b_y * 16 < h) SELECT b_y * 7 + bx AS block, ly, lx, r, g, b FROM t, m JOIN px ON px.x = least(bx * 16 + lx, 99) AND px.y = least(b_y * 16 + ly, h - 1)")
def padded_tiles(spark, sf_dir):
    p = pixels(spark, sf_dir)
    height = p.agg(F.max("y")).first()[0] + 1
    return px_ops.padded_tiles(p, 16, WIDTH, height)


@query(f"WITH {PX_SQL}, m AS (SELECT max(y) + 1 AS h FROM px) SELECT y - (h - 8) // 2 AS y, x - 18 AS x, r, g, b FROM px, m WHERE x BETWEEN 18 AND 81 AND y BETWEEN (h - 8) // 2 AND (h - 8) // 2 + 7")
def center_crop(spark, sf_dir):
    p = pixels(spark, sf_dir)
    height = p.agg(F.max("y")).first()[0] + 1
    return px_ops.center_crop(p, WIDTH, height, 64, 8).select("y", "x", "r", "g", "b")


@query(f"WITH {PX_SQL}, m AS (SELECT max(y) + 1 AS h FROM px) SELECT y // 16 * 7 + x // 16 AS block, count(*) AS n FROM px GROUP BY 1")
def clipped_block_sizes(spark, sf_dir):
    """Real pixels of each 16x16 unit, by formula."""
    p = pixels(spark, sf_dir)
    height = p.agg(F.max("y")).first()[0] + 1
    count = -(-WIDTH // 16) * -(-height // 16)
    return spark.range(count).select(c("id").alias("block"), px_ops.block_pixel_count(c("id"), 16, WIDTH, height).cast("long").alias("n"))


@query(f"WITH {PX_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS k, count(*) OVER () AS n FROM px) SELECT pos FROM n WHERE k % CAST(ceil(n / 300.0) AS BIGINT) = 0")
def systematic_sample(spark, sf_dir):
    return px_ops.systematic_sample(pixels(spark, sf_dir).select("pos"), 300, "pos")


@query(f"WITH {PX_SQL}, h AS (SELECT r AS v, count(*) AS w FROM px WHERE a <> 0 GROUP BY 1), k AS (SELECT v, sum(w) OVER (ORDER BY v) AS run, sum(w) OVER () AS total FROM h) SELECT min(v) AS median FROM k WHERE 2 * run >= total")
def weighted_median_channel(spark, sf_dir):
    return weighted_median(px_ops.histogram(pixels(spark, sf_dir)).select((c("rgb").cast("long") / 65536).cast("long").alias("v"), "n"), "v", "n")


def weighted_median(df: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    """Least value at which the running weight reaches half of the total."""
    from pyspark.sql import Window

    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    run, total = F.sum("_w").over(Window.partitionBy(*keys).orderBy(value)), F.sum("_w").over(Window.partitionBy(*keys))
    return sums.withColumn("_r", run).withColumn("_t", total).where("2 * _r >= _t").groupBy(*keys).agg(F.min(value).alias("median"))


@query(f"WITH {PX_SQL}, h AS (SELECT g % 8 AS cluster, r, g, b, count(*) AS n, min(pos) AS p FROM px WHERE a <> 0 GROUP BY ALL), m AS (SELECT cluster, sum(r*n)/sum(n) AS mr, sum(g*n)/sum(n) AS mg, sum(b*n)/sum(n) AS mb FROM h GROUP BY 1) SELECT cluster, r, g, b FROM h JOIN m USING (cluster) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round((r-mr)**2+(g-mg)**2+(b-mb)**2, 6), n DESC, p) = 1")
def weighted_medoid(spark, sf_dir):
    """The colour nearest to its cluster's weighted mean; on ties the more frequent, then the first seen."""
    h = px_ops.opaque(pixels(spark, sf_dir)).groupBy((c("g") % 8).alias("cluster"), "r", "g", "b").agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    m = h.groupBy("cluster").agg(*[(F.sum(c(v) * c("n")) / F.sum("n")).alias(f"m{v}") for v in "rgb"])
    d = F.round(matching.squared_distance([c(v) for v in "rgb"], [c(f"m{v}") for v in "rgb"]), 6)
    best = F.min_by(F.struct("r", "g", "b"), F.struct(d, -c("n"), "p"))
    return h.join(F.broadcast(m), "cluster").groupBy("cluster").agg(best.alias("s")).select("cluster", "s.r", "s.g", "s.b")


@query(f"WITH {PX_SQL} SELECT pos, pal AS pal, idx, r, g, b FROM (SELECT pos, (y // 8 * 13 + x // 8) % 3 AS pal, ((y % 8 * 8 + x % 8) * 5 + y // 8 * 13 + x // 8) % 16 AS idx FROM px) JOIN (SELECT p.range AS pal, i.range AS idx, (i.range*53+p.range*17)%256 AS r, (i.range*97+p.range)%256 AS g, (i.range*29+p.range*7)%256 AS b FROM range(3) p, range(16) i) USING (pal, idx)")
def direct_lookup_decode(spark, sf_dir):
    """Pixels through slot, block table and shared palette; a direct-mapped block's slot is the pixel's place."""
    blocks = px_ops.with_block(pixels(spark, sf_dir), 8, WIDTH).withColumn("slot", matching.direct_slot(c("x"), c("y"), 8))
    p = blocks.select("block").distinct()
    tables = p.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")))).select("block", (c("block") % 3).alias("pal"), "slot", ((c("slot") * 5 + c("block")) % 16).alias("idx"))
    shared = spark.range(48).select((c("id") % 3).alias("pal"), F.expr("id div 3").alias("idx")).select("pal", "idx", ((c("idx") * 53 + c("pal") * 17) % 256).alias("r"), ((c("idx") * 97 + c("pal")) % 256).alias("g"), ((c("idx") * 29 + c("pal") * 7) % 256).alias("b"))
    # direct tables have an entry for each pixel; Spark takes entries made of few blocks for few and would send them whole
    return matching.decode_indexed(blocks.select("pos", "block", "slot"), tables.hint("merge"), shared).select("pos", "pal", "idx", "r", "g", "b")


def _mip_sql() -> str:
    parts = [f"m0 AS (SELECT 0 AS mip, y, x, {_lin('r')} AS r, {_lin('g')} AS g, {_lin('b')} AS b FROM px)"]
    parts += [f"m{k} AS (SELECT {k} AS mip, y // 2 AS y, x // 2 AS x, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM m{k - 1} GROUP BY 2, 3)" for k in (1, 2, 3)]
    return f"WITH {PX_SQL}, {', '.join(parts)} SELECT mip, y, x, round(r, 4) AS r, round(g, 4) AS g, round(b, 4) AS b FROM ({' UNION ALL '.join(f'SELECT * FROM m{k}' for k in range(4))})"


@query(_mip_sql())
def mip_chain_mean(spark, sf_dir):
    m = px_ops.mip_levels(pixels(spark, sf_dir), 4)
    return m.select("mip", "y", "x", *[F.round(v, 4).alias(v) for v in "rgb"])


# ---------------------------------------------------------------- blocks of samples
@query(f"WITH {BLK_SQL} SELECT vec_id, count(*) FILTER (s // 16 <> p) AS changes FROM (SELECT *, lag(s // 16) OVER (PARTITION BY vec_id ORDER BY pos) AS p FROM blk) GROUP BY 1")
def run_changes(spark, sf_dir):
    return matching.run_changes(samples(spark, sf_dir).withColumn("v", F.expr("s div 16")), "vec_id")


_SIZES = "sizes AS (SELECT vec_id, CAST(sum(s) % 61 + 3 AS BIGINT) AS size FROM blk GROUP BY 1)"


def _sizes(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("vec_id").agg((F.sum("s") % 61 + 3).alias("size"))


@query(f"WITH {BLK_SQL}, {_SIZES} SELECT vec_id, size, CAST(coalesce(sum(size) OVER (ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM sizes")
def prefix_offsets(spark, sf_dir):
    return prefix.prefix_offsets(_sizes(spark, sf_dir), "size", "vec_id", out="off")


@query(f"WITH {BLK_SQL}, {_SIZES}, o AS (SELECT *, CAST(coalesce(sum(size) OVER (ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM sizes) SELECT vec_id, size, min(off) OVER (PARTITION BY vec_id // 16) AS checkpoint, off - min(off) OVER (PARTITION BY vec_id // 16) AS within FROM o")
def checkpoint_offsets(spark, sf_dir):
    return prefix.checkpoint_offsets(_sizes(spark, sf_dir), "size", "vec_id", 16)


@query(f"WITH {BLK_SQL}, f AS (SELECT vec_id, s // 32 AS slot, count(*) AS usage, min(pos) AS first_use FROM blk GROUP BY 1, 2) SELECT vec_id, slot, usage, first_use, row_number() OVER (PARTITION BY vec_id ORDER BY first_use) - 1 AS ordinal FROM f")
def pattern_first_use_rank(spark, sf_dir):
    """Canonical slot numbers of a block: used slots by their first place."""
    f = samples(spark, sf_dir).groupBy("vec_id", F.expr("s div 32").alias("slot")).agg(F.count("*").alias("usage"), F.min("pos").cast("long").alias("first_use"))
    return prefix.rank_within(f, "first_use", "vec_id").withColumn("ordinal", c("ordinal").cast("long"))


def _patterns(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(c("vec_id").alias("block"), F.transform("embedding", lambda v: F.when(v >= 0, 1).otherwise(0)).alias("p"))


_PAT = "pat AS (SELECT vec_id AS block, list_transform(embedding, lambda v: CASE WHEN v >= 0 THEN 1 ELSE 0 END) AS p FROM embeddings)"
_HAM = "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN p[i] <> q[i] THEN 1 ELSE 0 END))"


@query(f"WITH {_PAT}, proto AS (SELECT block AS proto, p AS q FROM pat WHERE block < 8), d AS (SELECT block, proto, CAST({_HAM} AS BIGINT) AS d FROM pat, proto) SELECT block, arg_min(proto, {{'d': d, 'p': proto}}) AS proto, min(d) AS distance FROM d GROUP BY 1")
def hamming_dictionary(spark, sf_dir):
    p = _patterns(spark, sf_dir)
    h = matching.hamming_nearest(p, p.where("block < 8").select(c("block").alias("proto"), c("p").alias("q")))
    return h.select("block", "proto", c("distance").cast("long").alias("distance"))


def _dihedral_sql() -> str:
    places = []
    for t in range(8):
        swap, mx, my = matching.DIHEDRAL[t]
        u, v = ("i // 8", "i % 8") if swap else ("i % 8", "i // 8")
        places.append(f"SELECT CAST({t} AS BIGINT) AS t, i, {f'7 - {v}' if my else v} AS sy, {f'7 - {u}' if mx else u} AS sx FROM range(64) r(i)")
    return " UNION ALL ".join(places)


@query(f"WITH {_PAT}, proto AS (SELECT block AS proto, p AS q FROM pat WHERE block < 4), pl AS ({_dihedral_sql()}), d AS (SELECT block, proto, t, CAST(sum(CASE WHEN p[i + 1] <> q[sy * 8 + sx + 1] THEN 1 ELSE 0 END) AS BIGINT) AS d FROM pat, proto, pl GROUP BY 1, 2, 3) SELECT block, arg_min(proto, {{'d': d, 'p': proto, 't': t}}) AS proto, arg_min(t, {{'d': d, 'p': proto, 't': t}}) AS transform, min(d) AS distance FROM d GROUP BY 1")
def dihedral_min(spark, sf_dir):
    """The prototype and symmetry that show a block best."""
    p = _patterns(spark, sf_dir)
    places = [[y * 8 + x for x, y in (matching.dihedral(i % 8, i // 8, 8, t) for i in range(64))] for t in range(8)]
    turned = p.where("block < 4").select(c("block").alias("b"), "p", F.posexplode(F.array(*[F.array(*map(F.lit, at)) for at in places])).alias("t", "at"))
    protos = turned.select(F.struct("b", "t").alias("proto"), F.transform("at", lambda i: F.get("p", i)).alias("q"))
    h = matching.hamming_nearest(p, protos)
    return h.select("block", c("proto.b").alias("proto"), c("proto.t").cast("long").alias("transform"), c("distance").cast("long").alias("distance"))


_BASIS_VALUES = ", ".join(f"({x}, {u}, {v})" for x, row in enumerate(coding.integer_basis().tolist()) for u, v in enumerate(row))
_BASIS = f"basis AS (SELECT * FROM (VALUES {_BASIS_VALUES}) b(bx, bu, k))"
_FWD = (
    f"{_BASIS}, h AS (SELECT vec_id, v AS y, CAST(bu AS BIGINT) AS u, {_rd('sum((s - 128) * k)', 16384)} AS h FROM blk JOIN basis ON bx = blk.u GROUP BY 1, 2, 3), "
    f"fwd AS (SELECT vec_id, CAST(bu AS BIGINT) AS v, u, CAST({_rd('sum(h * k)', 65536)} AS BIGINT) AS f FROM h JOIN basis ON bx = y GROUP BY 1, 2, 3)"
)


def _spread(df: DataFrame, column: str, name: str) -> DataFrame:
    e = df.select("vec_id", F.posexplode(column).alias("p", name))
    return e.select("vec_id", F.expr("p div 8").alias("v"), (c("p") % 8).cast("long").alias("u"), name)


@query(f"WITH {BLK_SQL}, {_FWD} SELECT vec_id, v, u, f FROM fwd")
def dct_fixed_forward(spark, sf_dir):
    f = transform.mapped(transform.block_samples(table(spark, sf_dir, "embeddings")), "s", "f", transform.forward_fixed)
    return _spread(f, "f", "f")


def _table_sql(name: str, values: list[int]) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(f'({i // 8}, {i % 8}, {q})' for i, q in enumerate(values))}) t(qv, qu, q))"


_T50 = coding.scaled_table(coding.LUMA_TABLE, 50)
_RDQ = "(CASE WHEN f < 0 THEN -((2 * -f + q) // (2 * q)) ELSE (2 * f + q) // (2 * q) END)"


@query(f"WITH {BLK_SQL}, {_FWD}, {_table_sql('t', _T50)} SELECT vec_id, v, u, {_RDQ} AS q FROM fwd JOIN t ON qv = v AND qu = u")
def quantise_q(spark, sf_dir):
    f = transform.mapped(transform.block_samples(table(spark, sf_dir, "embeddings")), "s", "f", transform.forward_fixed)
    return _spread(f.select("vec_id", transform.quantised(c("f"), _T50).alias("q")), "q", "q")


_INV = (
    f"dq AS (SELECT vec_id, v, u, {_RDQ} * q AS d FROM fwd JOIN t ON qv = v AND qu = u), "
    f"ih AS (SELECT vec_id, v, bx AS x, {_rd('sum(d * k)', 16384)} AS h FROM dq JOIN basis ON bu = u GROUP BY 1, 2, 3), "
    f"inv AS (SELECT vec_id, bx AS y, x, CAST(least(255, greatest(0, {_rd('sum(h * k)', 65536)} + 128)) AS BIGINT) AS r FROM ih JOIN basis ON bu = v GROUP BY 1, 2, 3)"
)


@query(f"WITH {BLK_SQL}, {_FWD}, {_table_sql('t', _T50)}, {_INV} SELECT vec_id, CAST(y AS BIGINT) AS v, CAST(x AS BIGINT) AS u, r FROM inv")
def dct_fixed_inverse(spark, sf_dir):
    f = transform.mapped(transform.block_samples(table(spark, sf_dir, "embeddings")), "s", "f", transform.forward_fixed)
    d = f.select("vec_id", transform.dequantised(transform.quantised(c("f"), _T50), _T50).alias("d"))
    import numpy as np

    return _spread(transform.mapped(d, "d", "r", lambda x: np.clip(transform.inverse_fixed(x), 0, 255)), "r", "r")


_ZZ = f"zz AS (SELECT * FROM (VALUES {', '.join(f'({p}, {k})' for k, p in enumerate([0, *coding.zigzag(8, 8)]))}) z(zp, zk))"
_UE = "(2 * floor(log2({0} + 1)) + 1)"
_SE = "(2 * floor(log2(CASE WHEN {0} > 0 THEN 2 * {0} - 1 ELSE -2 * {0} END + 1)) + 1)"


def _bits_sql(quality: int) -> str:
    return (
        f"qq AS (SELECT vec_id, zk, {_RDQ} AS val FROM fwd JOIN t ON qv = v AND qu = u JOIN zz ON zp = v * 8 + u), "
        "nz AS (SELECT vec_id, zk, val, zk - coalesce(lag(zk) OVER (PARTITION BY vec_id ORDER BY zk), 0) - 1 AS run FROM qq WHERE zk > 0 AND val <> 0), "
        f"bits AS (SELECT vec_id, CAST({_SE.format('dc')} + 1 + coalesce(ac, 0) AS BIGINT) AS bits FROM (SELECT vec_id, val AS dc FROM qq WHERE zk = 0) LEFT JOIN (SELECT vec_id, sum(1 + {_UE.format('run')} + {_SE.format('val')}) AS ac FROM nz GROUP BY 1) USING (vec_id))"
    )


@query(f"WITH {BLK_SQL}, {_FWD}, {_table_sql('t', _T50)}, {_ZZ}, {_bits_sql(50)} SELECT vec_id, bits FROM bits")
def expgolomb_bits(spark, sf_dir):
    f = transform.mapped(transform.block_samples(table(spark, sf_dir, "embeddings")), "s", "f", transform.forward_fixed)
    return f.select("vec_id", transform.block_bits(transform.quantised(c("f"), _T50)).alias("bits"))


@query(f"WITH {BLK_SQL} SELECT vec_id, round(sum((s - 128.0) * (s - 128.0)), 6) AS energy FROM blk GROUP BY 1")
def dct_float_energy(spark, sf_dir):
    """The orthonormal transform keeps the energy of a block (Parseval)."""
    f = transform.mapped(transform.block_samples(table(spark, sf_dir, "embeddings")), "s", "f", lambda x: transform.forward_float(x - 128.0), "double")
    return f.select("vec_id", F.round(F.aggregate("f", F.lit(0.0), lambda t, v: t + v * v), 6).alias("energy"))


_FB = ", ".join(f"({x}, {u}, {v!r})" for u, row in enumerate(coding.float_basis(8).tolist()) for x, v in enumerate(row))


@query(f"WITH {BLK_SQL}, fb AS (SELECT * FROM (VALUES {_FB}) b(bx, bu, k)), h AS (SELECT vec_id, v AS y, CAST(bu AS BIGINT) AS u, sum((s - 128) * k) AS h FROM blk JOIN fb ON bx = blk.u GROUP BY 1, 2, 3) SELECT vec_id, CAST(bu AS BIGINT) AS v, u, round(sum(h * k), 4) + 0.0 AS f FROM h JOIN fb ON bx = y GROUP BY 1, 2, 3")
def dct_float_forward(spark, sf_dir):
    f = transform.mapped(transform.block_samples(table(spark, sf_dir, "embeddings")), "s", "f", lambda x: transform.forward_float(x - 128.0), "double")
    return _spread(f, "f", "f").withColumn("f", F.round("f", 4) + 0.0)


@query(f"WITH {BLK_SQL} SELECT vec_id, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list(s ORDER BY pos)), lambda h, v: (xor(h, v) * 16777619) % 4294967296) AS fnv FROM blk GROUP BY 1")
def block_fnv(spark, sf_dir):
    return transform.block_samples(table(spark, sf_dir, "embeddings")).select("vec_id", num.fnv1a(c("s")).alias("fnv"))


# ---------------------------------------------------------------- palette or transform for each unit
_QUALITIES = (35, 50, 75)
_LEVELS = (
    "lv AS (SELECT vec_id, s, min(s) OVER (PARTITION BY vec_id) AS lo, max(s) OVER (PARTITION BY vec_id) AS hi FROM blk), "
    "ls AS (SELECT vec_id, s, lo, hi - lo AS span, CASE WHEN hi = lo THEN 0 ELSE ((s - lo) * 6 + hi - lo) // ((hi - lo) * 2) END AS slot FROM lv), "
    "lev AS (SELECT vec_id // 4 AS unit, CAST(count(DISTINCT vec_id) * 144 AS BIGINT) AS bits0, CAST(sum((s - lo - (slot * span * 2 + 3) // 6) ** 2) AS BIGINT) AS sse0 FROM ls GROUP BY 1)"
)


def _candidates_sql() -> str:
    parts, unions = [BLK_SQL, _FWD, _ZZ, _LEVELS], []
    for q in _QUALITIES:
        t = coding.scaled_table(coding.LUMA_TABLE, q)
        own = ", ".join((_table_sql("t", t), _INV, _bits_sql(q)))
        for name in ("bits", "dq", "ih", "inv", "qq", "nz", "t"):
            own = own.replace(f"{name} AS (", f"{name}_{q} AS (").replace(f"FROM {name} ", f"FROM {name}_{q} ").replace(f"JOIN {name} ", f"JOIN {name}_{q} ")
        parts.append(own)
        unions.append(f"SELECT {q} AS quality, vec_id // 4 AS unit, CAST(sum(e) AS BIGINT) AS sse1, CAST(sum(bits) AS BIGINT) AS bits1 FROM (SELECT i.vec_id, sum((s - r) * (s - r)) AS e FROM inv_{q} i JOIN blk ON blk.vec_id = i.vec_id AND blk.v = y AND blk.u = x GROUP BY 1) JOIN bits_{q} USING (vec_id) GROUP BY 2")
    return f"WITH {', '.join(parts)}, dct AS ({' UNION ALL '.join(unions)}), cand AS (SELECT quality, unit, bits0, sse0, bits1, sse1 FROM dct JOIN lev USING (unit))"


@query(_candidates_sql() + " SELECT * FROM cand")
def rd_candidates(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    dct = transform.units(transform.dct_candidates(e, {q: coding.scaled_table(coding.LUMA_TABLE, q) for q in _QUALITIES}), "quality")
    levels = transform.units(transform.level_candidates(e))
    return dct.withColumnsRenamed({"bits": "bits1", "sse": "sse1"}).join(levels.withColumnsRenamed({"bits": "bits0", "sse": "sse0"}), "unit").select("quality", "unit", "bits0", "sse0", "bits1", "sse1")


_SWEEP = (
    ", i AS (SELECT *, CASE WHEN sse1 < sse0 OR (sse1 = sse0 AND bits1 < bits0) THEN 1 ELSE 0 END AS m FROM cand), "
    "z AS (SELECT quality, count(*) AS n, sum(CASE m WHEN 1 THEN sse1 ELSE sse0 END) AS s, sum(CASE m WHEN 0 THEN bits0 ELSE 0 END) AS b0, sum(CASE m WHEN 1 THEN bits1 ELSE 0 END) AS b1, count(*) FILTER (m = 0) AS c0, count(*) FILTER (m = 1) AS c1 FROM i GROUP BY 1), "
    "ev AS (SELECT quality, unit, CASE m WHEN 0 THEN sse1 - sse0 ELSE sse0 - sse1 END AS ds, CASE m WHEN 0 THEN -bits0 ELSE bits0 END AS d0, CASE m WHEN 0 THEN bits1 ELSE -bits1 END AS d1, CASE m WHEN 0 THEN 1 ELSE -1 END AS dc, (CASE m WHEN 0 THEN sse1 - sse0 ELSE sse0 - sse1 END) / CAST(CASE m WHEN 0 THEN bits0 - bits1 ELSE bits1 - bits0 END AS DOUBLE) AS th "
    "FROM i WHERE (CASE m WHEN 0 THEN bits0 - bits1 ELSE bits1 - bits0 END) > 0 AND (CASE m WHEN 0 THEN sse1 - sse0 ELSE sse0 - sse1 END) > 0), "
    "st AS (SELECT quality, row_number() OVER w AS step, sum(ds) OVER w AS ds, sum(d0) OVER w AS d0, sum(d1) OVER w AS d1, sum(dc) OVER w AS dc FROM ev WINDOW w AS (PARTITION BY quality ORDER BY th, unit ROWS UNBOUNDED PRECEDING) UNION ALL SELECT quality, 0, 0, 0, 0, 0 FROM z), "
    "sw AS (SELECT quality, step, CAST(s + ds AS BIGINT) AS sse, CAST(b0 + d0 AS BIGINT) AS bits0, CAST(b1 + d1 AS BIGINT) AS bits1, CAST(c0 - dc AS BIGINT) AS count0, CAST(c1 + dc AS BIGINT) AS count1, "
    "CAST(CASE WHEN c0 - dc > 0 THEN 96 ELSE 0 END + CASE WHEN c1 + dc > 0 THEN 128 ELSE 0 END + CASE WHEN c0 - dc > 0 AND c1 + dc > 0 THEN (n + 7) // 8 ELSE 0 END + (b0 + d0 + 7) // 8 + (b1 + d1 + 7) // 8 AS BIGINT) AS payload_bytes FROM st JOIN z USING (quality))"
)


@query(_candidates_sql() + _SWEEP + " SELECT * FROM sw")
def rd_sweep(spark, sf_dir):
    return transform.sweep(rd_candidates(spark, sf_dir), 96, "quality").withColumn("step", c("step").cast("long"))


@query(_candidates_sql() + _SWEEP + " SELECT *, payload_bytes <= 12000 AS within_target FROM sw ORDER BY payload_bytes > 12000, CASE WHEN payload_bytes <= 12000 THEN sse ELSE payload_bytes END, CASE WHEN payload_bytes <= 12000 THEN payload_bytes ELSE sse END, quality, step LIMIT 1")
def rd_select_budget(spark, sf_dir):
    return transform.select_state(rd_sweep(spark, sf_dir), 12000, ["quality", "step"])


# ---------------------------------------------------------------- literal grids
@query("WITH g AS (SELECT v.range AS v, u.range AS u FROM range(16) v, range(16) u WHERE u.range + v.range > 0) SELECT v * 16 + u AS position, row_number() OVER (ORDER BY u + v, CASE WHEN (u + v) % 2 = 0 THEN u ELSE -u END) - 1 AS rank FROM g")
def zigzag_scan(spark, sf_dir):
    return spark.createDataFrame([(p, k) for k, p in enumerate(coding.zigzag(16, 16))], "position bigint, rank bigint")


_BASE_SCORE = ("u + v + (CASE WHEN (u + v) % 2 = 0 THEN v ELSE u END) * 0.001", "u + v * 2.4", "u * 2.4 + v", "greatest(u, v) * 1.45 + abs(u - v) * 0.1")


@query("WITH g AS (SELECT CAST(v.range AS DOUBLE) AS v, CAST(u.range AS DOUBLE) AS u FROM range(8) v, range(8) u WHERE u.range + v.range > 0) " + " UNION ALL ".join(f"SELECT {p} AS profile, CAST(v * 8 + u AS BIGINT) AS position, row_number() OVER (ORDER BY round({s}, 9), u + v, v, u) - 1 AS rank FROM g" for p, s in enumerate(_BASE_SCORE)))
def base_scans(spark, sf_dir):
    rows = [(p, at, k) for p in range(4) for k, at in enumerate(coding.scan(p, 8, 8))]
    return spark.createDataFrame(rows, "profile int, position bigint, rank bigint")


_SKIP_SQL = """WITH g AS (SELECT a.range AS u, b.range AS v, a.range / 7.0 AS x, b.range / 7.0 AS y FROM range(8) a, range(8) b WHERE a.range + b.range > 0),
r AS (SELECT *, sqrt(CAST(x AS DOUBLE) * x + CAST(y AS DOUBLE) * y) AS r FROM (SELECT u, v, CAST(u AS DOUBLE) / 7 AS x, CAST(v AS DOUBLE) / 7 AS y FROM g)),
s AS (SELECT u, v, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS profile, unnest([CAST(r * r AS DOUBLE), 0.22::DOUBLE * x * x + 2.1::DOUBLE * y * y, 2.1::DOUBLE * x * x + 0.22::DOUBLE * y * y,
  least(0.18::DOUBLE * x * x + 2.4::DOUBLE * y * y, 2.4::DOUBLE * x * x + 0.18::DOUBLE * y * y), 0.72::DOUBLE * r * r + 1.35::DOUBLE * abs(x - y),
  0.72::DOUBLE * r * r + 0.55::DOUBLE * least(x, y) + 0.08::DOUBLE * abs(x - y), abs(r - 0.34::DOUBLE) + 0.18::DOUBLE * r, abs(r - 0.52::DOUBLE) + 0.10::DOUBLE * least(x, y)]) AS score FROM r)
SELECT CAST(profile AS INTEGER) AS profile, v * 8 + u AS position, row_number() OVER (PARTITION BY profile ORDER BY score, u + v, v, u) - 1 AS rank FROM s"""


@query(_SKIP_SQL)
def skip_scans(spark, sf_dir):
    rows = [(p, at, k) for p in range(8) for k, at in enumerate(coding.skip_scan(p, 8, 8))]
    return spark.createDataFrame(rows, "profile int, position bigint, rank bigint")


def _scale_sql(q: str) -> str:
    return f"least(255, greatest(1, CASE WHEN {q} < 50 THEN (b * 5000 + 50 * {q}) // (100 * {q}) ELSE (b * (200 - {q} * 2) + 50) // 100 END))"


@query(f"WITH t AS (SELECT * FROM (VALUES {', '.join(f'({i}, {v})' for i, v in enumerate(coding.LUMA_TABLE))}) t(pos, b)) SELECT range AS quality, CAST(pos AS BIGINT) AS pos, CAST({_scale_sql('range')} AS BIGINT) AS q FROM range(1, 101), t")
def jpeg_tables(spark, sf_dir):
    base = F.array(*map(F.lit, coding.LUMA_TABLE))
    q, b = c("quality"), c("b").cast("long")
    grid = spark.range(1, 101).select(c("id").alias("quality"), F.posexplode(base).alias("pos", "b"))
    low, high = F.call_function("div", b * 5000 + q * 50, q * 100), F.call_function("div", b * (200 - q * 2) + 50, F.lit(100).cast("long"))
    return grid.select("quality", c("pos").cast("long").alias("pos"), num.clamp(F.when(q < 50, low).otherwise(high), 1, 255).alias("q"))


_STEPS_SQL = f"""WITH t AS (SELECT pos, CAST(luma AS DOUBLE) AS luma, CAST(chroma AS DOUBLE) AS chroma FROM (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(zip(coding.LUMA_TABLE, coding.CHROMA_TABLE)))}) t(pos, luma, chroma)),
g AS (SELECT s.size, q.quality, a.range AS u, b.range AS v, CAST(floor(a.range * 7.0::DOUBLE / (s.size - 1) + 0.5) AS INTEGER) AS tu, CAST(floor(b.range * 7.0::DOUBLE / (s.size - 1) + 0.5) AS INTEGER) AS tv
  FROM (VALUES (8), (16)) s(size), (VALUES (30), (75)) q(quality), range(16) a, range(16) b WHERE a.range < s.size AND b.range < s.size)
SELECT size, quality, CAST(v * size + u AS INTEGER) AS position, greatest(1.0::DOUBLE, (CASE WHEN c.chroma THEN t.chroma ELSE t.luma END) * (CASE WHEN quality < 50 THEN 50.0::DOUBLE / quality ELSE 2 - quality * 0.02::DOUBLE END) * (size / 8)) AS step, c.chroma
FROM g JOIN t ON t.pos = least(7, tv) * 8 + least(7, tu), (VALUES (false), (true)) c(chroma)"""


@query(_STEPS_SQL)
def dct_steps(spark, sf_dir):
    rows = [(w, q, v * w + u, coding.quantisation_step(u, v, w, w, q, ch), ch) for w in (8, 16) for q in (30, 75) for ch in (False, True) for v in range(w) for u in range(w)]
    return spark.createDataFrame(rows, "size int, quality int, position int, step double, chroma boolean")


#: Image for which rates are computed.
_GRID_SIZE = 1024


def settings_grid(spark: SparkSession) -> DataFrame:
    """All valid settings: block size b, local colours l, shared colours g, palettes p, colour bits."""
    choices = {"b": [4, 8, 16, 32, 64], "l": [2, 4, 8, 16], "g": [8, 16, 32, 64, 128, 256], "p": [1, 2, 4, 8, 16, 32, 64, 128], "bits": [16, 24]}
    grid = spark.range(1).select()
    for name, values in choices.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v).cast("long") for v in values])))
    return grid.where("l <= g and l <= b * b")


_GRID = (
    "grid AS (SELECT * FROM (SELECT CAST(unnest([4,8,16,32,64]) AS BIGINT) AS b), (SELECT CAST(unnest([2,4,8,16]) AS BIGINT) AS l), (SELECT CAST(unnest([8,16,32,64,128,256]) AS BIGINT) AS g), (SELECT CAST(unnest([1,2,4,8,16,32,64,128]) AS BIGINT) AS p), (SELECT CAST(unnest([16,24]) AS BIGINT) AS bits) WHERE l <= g AND l <= b * b), "
    "rates AS (SELECT *, CAST(p * g * bits + (1024 // b) ** 2 * log2(p) + (1024 // b) ** 2 * l * log2(g) + CASE WHEN l = b * b THEN 0 ELSE 1048576 * log2(l) END AS BIGINT) AS payload_bits FROM grid)"
)


def _rates(spark):
    n = F.lit(_GRID_SIZE).cast("long")
    return settings_grid(spark).withColumn("payload_bits", rate_bits(c("p"), c("g"), c("bits"), c("b"), c("l"), n, n).cast("long"))


@query(f"WITH {_GRID}, tg AS (SELECT unnest([1.5, 2, 2.5, 3, 4, 5, 6, 8]) AS target) SELECT CAST(target AS DOUBLE) AS target, b, l, g, p, bits, payload_bits FROM rates, tg WHERE payload_bits / 1048576.0 <= target AND payload_bits / 1048576.0 > target - 0.25")
def settings_grid_rates(spark, sf_dir):
    targets = F.explode(F.array(*[F.lit(t) for t in (1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0)]))
    bpp = c("payload_bits") / float(_GRID_SIZE**2)
    return _rates(spark).withColumn("target", targets).where((bpp <= c("target")) & (bpp > c("target") - 0.25)).select("target", "b", "l", "g", "p", "bits", "payload_bits")


def _profiles(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    total = F.sum(F.round(c("o_totalprice") * 100).cast("long"))
    return o.groupBy(F.concat_ws("-", "o_orderpriority", (c("o_custkey") % 7).cast("string")).alias("profile")).agg(total.alias("t"), F.sum(c("o_orderkey") * 7919 % 1009).alias("e"), F.count("*").alias("n")).select("profile", F.expr("t div 10000000").alias("bytes"), F.expr("(e * 100) div n").alias("err"))


_PROF = "prof AS (SELECT o_orderpriority || '-' || CAST(o_custkey % 7 AS VARCHAR) AS profile, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) // 10000000 AS bytes, CAST(sum(o_orderkey * 7919 % 1009) * 100 AS BIGINT) // count(*) AS err FROM orders GROUP BY 1)"
_FRONT = "front AS (SELECT * FROM prof p WHERE NOT EXISTS (SELECT 1 FROM prof q WHERE q.bytes <= p.bytes AND q.err <= p.err AND (q.bytes < p.bytes OR q.err < p.err)))"


@query(f"WITH {_PROF}, {_FRONT} SELECT * FROM front")
def pareto_settings(spark, sf_dir):
    return prefix.undominated(_profiles(spark, sf_dir), "bytes", "err")


def balanced(front: DataFrame, cost: str, error: str, order: str) -> DataFrame:
    """The row of a frontier with the least 1.5 * error**2 + size**2, both scaled to 0..1, size by its logarithm."""
    edges = front.agg(F.min(error).alias("e0"), F.max(error).alias("e1"), F.min(F.log(cost)).alias("s0"), F.max(F.log(cost)).alias("s1"))
    scaled = lambda v, lo, hi: F.when(c(hi) == c(lo), 0.0).otherwise((v - c(lo)) / (c(hi) - c(lo)))
    e, s = scaled(c(error), "e0", "e1"), scaled(F.log(cost), "s0", "s1")
    scored = front.crossJoin(F.broadcast(edges)).withColumn("score", F.round(e * e * 1.5 + s * s, 9))
    return scored.orderBy("score", cost, error, order).limit(1).select(*front.columns, "score")


@query(f"WITH {_PROF}, {_FRONT}, e AS (SELECT min(err) AS e0, max(err) AS e1, min(ln(bytes)) AS s0, max(ln(bytes)) AS s1 FROM front) SELECT profile, bytes, err, round(1.5 * pow(CASE WHEN e1 = e0 THEN 0 ELSE (err - e0) / CAST(e1 - e0 AS DOUBLE) END, 2) + pow(CASE WHEN s1 = s0 THEN 0 ELSE (ln(bytes) - s0) / (s1 - s0) END, 2), 9) AS score FROM front, e ORDER BY score, bytes, err, profile LIMIT 1")
def balanced_pick(spark, sf_dir):
    return balanced(pareto_settings(spark, sf_dir).select("profile", "bytes", "err"), "bytes", "err", "profile")


@query(f"WITH {_PROF} SELECT profile, bytes, err FROM (SELECT *, max(-err) OVER (ORDER BY bytes, -err ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM prof WHERE bytes > 0) WHERE best IS NULL OR -err > best")
def rate_curve(spark, sf_dir):
    p = _profiles(spark, sf_dir).withColumn("q", -c("err"))
    return prefix.rate_curve(p, "bytes", "q").drop("q")


@query("SELECT CAST(target AS DOUBLE) AS target, CAST(greatest(0, (coalesce(lag(target) OVER o, target - (lead(target) OVER o - target)) + target) / 2) AS DOUBLE) AS low, CAST((coalesce(lead(target) OVER o, target + (target - lag(target) OVER o)) + target) / 2 AS DOUBLE) AS high FROM (SELECT unnest([1.5, 2, 2.5, 3, 4, 5, 6, 8]) AS target) WINDOW o AS (ORDER BY target)")
def bpp_midpoint_windows(spark, sf_dir):
    return prefix.midpoint_windows(spark.createDataFrame([(t,) for t in (1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0)], "target double"))


@query(f"WITH {_PROF}, b AS (SELECT bytes AS bb, err AS be FROM prof ORDER BY profile LIMIT 1) SELECT profile, CASE WHEN bytes <= 0 OR bb <= 0 OR err > be THEN false WHEN be = 0 THEN err = 0 AND bytes <= bb WHEN err = 0 THEN true ELSE 10 * log10(CAST(be AS DOUBLE) / err) + 1e-12 >= 15 * ln(CAST(bytes AS DOUBLE) / bb) END AS accepted FROM prof, b")
def rate_guard_accept(spark, sf_dir):
    p = _profiles(spark, sf_dir)
    base = p.orderBy("profile").limit(1).select(c("bytes").alias("bb"), c("err").alias("be"))
    return p.crossJoin(F.broadcast(base)).select("profile", rate_guard(c("err"), c("bytes"), c("be"), c("bb")).alias("accepted"))


_CHOICE_SQL = """WITH t AS (SELECT l_orderkey AS image_id, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS place, CAST(l_quantity AS DOUBLE) / 10 AS bpp, l_partkey * 7919 % 1003 AS error, l_suppkey % 50 AS payload_bits, l_returnflag = 'N' AS family FROM lineitem),
d AS (SELECT *, abs(bpp - 2.5) AS distance, bpp BETWEEN 2 AND 3 AS inside FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, only_family ORDER BY NOT inside, CASE WHEN inside THEN error ELSE distance END, CASE WHEN inside THEN distance ELSE bpp END, CASE WHEN inside THEN payload_bits ELSE 0 END, place) AS k FROM (SELECT *, false AS only_family FROM d UNION ALL SELECT *, true FROM d WHERE family)),
j AS (SELECT s.*, f.place AS f_place, f.error AS f_error, f.bpp AS f_bpp, f.place IS NOT NULL AND NOT CASE WHEN s.error > f.error THEN false WHEN f.error = 0 THEN s.error = 0 AND s.bpp <= f.bpp WHEN s.error = 0 THEN true ELSE 10 * log10(CAST(f.error AS DOUBLE) / s.error) + 1e-12 >= 15 * ln(s.bpp / f.bpp) END AS guarded
  FROM r s LEFT JOIN r f ON f.image_id = s.image_id AND f.k = 1 AND f.only_family WHERE s.k = 1 AND NOT s.only_family)
SELECT image_id, guarded, CASE WHEN guarded THEN f_place ELSE place END AS place, CASE WHEN guarded THEN f_error ELSE error END AS error, CASE WHEN guarded THEN f_bpp ELSE bpp END AS bpp FROM j"""


@query(_CHOICE_SQL)
def settings_choice(spark, sf_dir):
    """The choice among trials, with the guard: line items as trials, orders as images."""
    bpp = c("l_quantity").cast("double") / 10
    place = c("l_linenumber").cast("long") * 10000000000 + c("l_partkey") * 10000 + c("l_suppkey")
    t = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("image_id"), place.alias("place"), bpp.alias("bpp"), (c("l_partkey") * 7919 % 1003).alias("error"), (c("l_suppkey") % 50).alias("payload_bits"),
        (c("l_returnflag") == "N").alias("family"), F.abs(bpp - 2.5).alias("distance"), bpp.between(2, 3).alias("inside"),
    )
    return settings_search.choose(t).select("image_id", "guarded", "place", "error", "bpp")


_SCREEN_SQL = """WITH size AS (SELECT p_partkey AS image_id, 64 + p_partkey % 300 AS width, 48 + p_partkey % 200 AS height FROM part),
shapes AS (SELECT * FROM (VALUES (8, 8, 64, 0), (8, 4, 32, 1), (16, 8, 64, 2), (16, 4, 16, 3), (32, 2, 16, 4), (4, 4, 32, 5)) s(block, local, shared, shape)),
depths AS (SELECT p, b, (row_number() OVER (ORDER BY p, b) - 1) * 6 AS first FROM (SELECT unnest([2, 16, 32, 64]) AS p), (SELECT unnest([16, 24]) AS b)),
cand AS (SELECT 0 AS place, 4 AS block, 4 AS local, 32 AS shared, 1 AS palettes, 24 AS bits UNION ALL SELECT first + shape + 1, block, local, shared, p, b FROM shapes, depths),
rated AS (SELECT image_id, place, palettes = 1 AND bits = 24 AS family, CAST(palettes * shared * bits + ceil(width / block) * ceil(height / block) * (log2(palettes) + local * log2(shared)) + CASE WHEN local = block * block THEN 0 ELSE width * height * log2(local) END AS BIGINT) AS payload_bits, width * height AS area FROM size, cand),
b AS (SELECT *, payload_bits / CAST(area AS DOUBLE) AS bpp FROM rated),
d AS (SELECT *, abs(bpp - 3) AS distance, bpp BETWEEN 2.75 AND 3.5 AS inside FROM b),
w AS (SELECT *, bool_or(inside) OVER (PARTITION BY image_id) AS any_inside, bool_or(inside) OVER (PARTITION BY image_id, family) AS some_family, row_number() OVER (PARTITION BY image_id ORDER BY distance, bpp, place) AS k, row_number() OVER (PARTITION BY image_id, family ORDER BY distance, bpp, place) AS kf FROM d)
SELECT image_id, CAST(place AS INTEGER) AS place, payload_bits, inside, family FROM w WHERE inside OR (NOT any_inside AND k = 1) OR (family AND NOT some_family AND kf = 1)"""


@query(_SCREEN_SQL)
def settings_screen(spark, sf_dir):
    """Candidates whose rate, by formula, makes them worth encoding, for images of many sizes."""
    sizes = table(spark, sf_dir, "part").select(c("p_partkey").alias("image_id"), (64 + c("p_partkey") % 300).alias("width"), (48 + c("p_partkey") % 200).alias("height"))
    baseline = {"block": 4, "local": 4, "shared": 32, "palettes": 1, "bits": 24}
    found = settings_search.grid(baseline, [(8, 8, 64), (8, 4, 32), (16, 8, 64), (16, 4, 16), (32, 2, 16)])
    # rows of three numbers: a file of a million is one split, and the work on them many times that of reading them
    dealt = tables.spread(sizes, "image_id")
    return settings_search.screened(dealt, found, baseline, 3.0, 2.75, 3.5).select("image_id", "place", "payload_bits", "inside", "family")


@query("WITH RECURSIVE g(i, s) AS (SELECT CAST(0 AS BIGINT), CAST(2654435769 AS BIGINT) UNION ALL SELECT i + 1, (s * 1664525 + 1013904223) % 4294967296 FROM g WHERE i < 200) SELECT (a.i - 1) // 2 AS q, a.s % 100 AS x, b.s % 64 AS y FROM g a JOIN g b ON b.i = a.i + 1 WHERE a.i % 2 = 1")
def lcg_queries(spark, sf_dir):
    """Pseudorandom sampling places: x, then y, from one linear congruential sequence."""
    start = F.struct(F.lit(0x9E3779B9).cast("long").alias("s"), F.array().cast("array<bigint>").alias("seen"))
    step = lambda acc, i: F.struct(((acc["s"] * 1664525 + 1013904223) % (1 << 32)).alias("s"), F.concat(acc["seen"], F.array((acc["s"] * 1664525 + 1013904223) % (1 << 32))).alias("seen"))
    seq = spark.range(1).select(F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, step)["seen"].alias("s"))
    return seq.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))).alias("q"), "s").select("q", (F.get("s", (c("q") * 2).cast("int")) % 100).alias("x"), (F.get("s", (c("q") * 2 + 1).cast("int")) % 64).alias("y"))


# ---------------------------------------------------------------- reports
_POOL = (
    "count(*) AS images, CAST(sum(pixels) AS BIGINT) AS pixels, CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes, CAST(sum(artifact_bytes) AS BIGINT) AS artifact_bytes, round(sum(payload_bytes) * 8.0 / sum(pixels), 6) AS payload_bpp, "
    "round(sum(artifact_bytes) * 8.0 / sum(pixels), 6) AS file_bpp, round(10 * log10(65025.0 / (sum(squared_error) / CAST(sum(samples) AS DOUBLE))), 6) AS psnr, round(sum(ssim_milli * pixels) / CAST(sum(pixels) AS DOUBLE) / 1000, 6) AS ssim, CAST(sum(encode_us) AS BIGINT) AS encode_us, CAST(sum(decode_us) AS BIGINT) AS decode_us"
)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(n, digits).alias(n) if kind == "double" else c(n) for n, kind in df.dtypes])


@query(f"WITH {RECORDS_SQL} SELECT profile_id, {_POOL} FROM records GROUP BY 1")
def pooled_rd_report(spark, sf_dir):
    return _rounded(reports.pooled(records(spark, sf_dir), "profile_id"))


@query(f"WITH {RECORDS_SQL} SELECT profile_id, dataset, image_class, {_POOL} FROM records GROUP BY GROUPING SETS ((profile_id), (profile_id, dataset), (profile_id, dataset, image_class))")
def rd_grouping_sets(spark, sf_dir):
    return _rounded(reports.pooled_levels(records(spark, sf_dir)))


@query(
    f"WITH {RECORDS_SQL} SELECT profile_id, count(*) AS images, round(avg(ssim_milli) / 1000, 6) AS ssim_mean, round(avg(encode_us), 6) AS encode_us_mean, CAST(sum(palette_units) AS BIGINT) AS palette_units, CAST(sum(dct_units) AS BIGINT) AS dct_units, "
    "round(100.0 * sum(palette_units) / (sum(palette_units) + sum(dct_units)), 6) AS palette_percent, count(*) FILTER (palette_units > 0 AND dct_units > 0) AS mixed, count(*) FILTER (dct_units = 0) AS pure_palette, count(*) FILTER (palette_units = 0) AS pure_dct FROM records GROUP BY 1"
)
def hybrid_report(spark, sf_dir):
    return _rounded(reports.hybrid(records(spark, sf_dir), "profile_id"))


_SPECIAL_SQL = f"""WITH {RECORDS_SQL}, special AS (SELECT *, CASE WHEN image_class = 'O' THEN squared_error % 5003 END AS scalar_error, CASE WHEN image_class = 'O' THEN pixels END AS scalar_samples,
  CASE WHEN dataset = 'N' THEN list_transform(range(8), lambda k: (pixels * (k + 1) * 7 + palette_units) % 11) END AS angles FROM records),
rows AS (SELECT profile_id, dataset, image_class, {{_POOL}}, round(10 * log10(65025.0 * sum(scalar_samples) / sum(scalar_error)), 6) AS psnr_scalar, round(sum(CASE WHEN dataset = 'N' THEN squared_error % 997 / 10.0 END) / sum(list_sum(angles)), 6) AS angle_mean FROM special GROUP BY 1, 2, 3),
bins AS (SELECT profile_id, dataset, image_class, bin, sum(angles[bin + 1]) AS n FROM special, (SELECT unnest(range(8)) AS bin) WHERE angles IS NOT NULL GROUP BY 1, 2, 3, 4),
runs AS (SELECT *, sum(n) OVER (PARTITION BY profile_id, dataset, image_class ORDER BY bin) AS run, sum(n) OVER (PARTITION BY profile_id, dataset, image_class) AS total FROM bins),
edges AS (SELECT profile_id, dataset, image_class, round((min(bin) + 1) * 0.25, 6) AS angle_p95 FROM runs WHERE run >= ceil(total * 0.95) GROUP BY 1, 2, 3)
SELECT rows.*, angle_p95 FROM rows LEFT JOIN edges USING (profile_id, dataset, image_class)""".replace("{_POOL}", _POOL)


@query(_SPECIAL_SQL)
def special_maps_report(spark, sf_dir):
    """The pooled report with scalar maps (class O) and normal maps (dataset N)."""
    r = records(spark, sf_dir)
    scalar, normal = c("image_class") == "O", c("dataset") == "N"
    angles = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: (c("pixels") * k * 7 + c("palette_units")) % 11)
    r = r.withColumns({"scalar_error": F.when(scalar, c("squared_error") % 5003), "scalar_samples": F.when(scalar, c("pixels")), "angles": F.when(normal, angles)})
    total = F.aggregate("angles", F.lit(0).cast("long"), lambda a, b: a + b)
    r = r.withColumns({"angle_sum": F.when(normal, c("squared_error") % 997 / 10), "angle_count": total})
    return _rounded(reports.pooled_special(r, "profile_id", "dataset", "image_class", step=0.25))


@query(f"WITH {RECORDS_SQL} SELECT profile_id, round(10 * log10(65025.0 / avg(squared_error / CAST(samples AS DOUBLE))), 6) AS psnr FROM records GROUP BY 1")
def mean_mse_report(spark, sf_dir):
    return _rounded(reports.mean_mse(records(spark, sf_dir), "profile_id"))


@query(f"WITH {RECORDS_SQL} SELECT dataset, count(*) AS n, min(encode_us) AS least, round(quantile_cont(encode_us, 0.5), 6) AS median, round(quantile_cont(encode_us, 0.9), 6) AS p90, round(avg(encode_us), 6) AS mean, round(stddev_pop(encode_us), 4) AS deviation FROM records GROUP BY 1")
def encode_statistics(spark, sf_dir):
    return _rounded(reports.stage_statistics(records(spark, sf_dir), "encode_us", "dataset")).withColumn("deviation", F.round("deviation", 4))


@query(f"WITH {RECORDS_SQL}, u AS (SELECT count(*) AS n, sum(payload_bytes) AS pb, sum(artifact_bytes) AS artifact_bytes, sum(palette_units) AS palette_units, sum(dct_units) AS dct_units FROM records) SELECT field, CAST(total AS BIGINT) AS total, round(total / CAST(n AS DOUBLE), 6) AS mean, round(100.0 * total / pb, 6) AS percent FROM (UNPIVOT u ON artifact_bytes, palette_units, dct_units INTO NAME field VALUE total)")
def storage_summary(spark, sf_dir):
    return _rounded(reports.storage_summary(records(spark, sf_dir), ["artifact_bytes", "palette_units", "dct_units"], "payload_bytes"))


@query(f"WITH {RECORDS_SQL} SELECT dataset, image_class, CAST(sum(artifact_bytes) AS BIGINT) AS legacy, CAST(sum(payload_bytes) AS BIGINT) AS packed, CAST(sum(artifact_bytes) - sum(payload_bytes) AS BIGINT) AS saved, round(100.0 * (sum(artifact_bytes) - sum(payload_bytes)) / sum(artifact_bytes), 6) AS percent FROM records GROUP BY ROLLUP (dataset, image_class)")
def packing_summary(spark, sf_dir):
    return _rounded(reports.packing_summary(records(spark, sf_dir), "artifact_bytes", "payload_bytes", "dataset", "image_class"))


@query(f"WITH {RECORDS_SQL}, a AS (SELECT image_id, min(squared_error) AS a FROM records WHERE profile_id = 'AF' GROUP BY 1), b AS (SELECT image_id, min(squared_error) AS b FROM records WHERE profile_id = 'NO' GROUP BY 1) SELECT count(*) AS pairs, count(*) FILTER (a < b) AS wins FROM a JOIN b USING (image_id)")
def wins_versus_baseline(spark, sf_dir):
    return reports.wins(records(spark, sf_dir), "AF", "NO", "profile_id", ["image_id"], "squared_error")


@query(f"WITH {RECORDS_SQL}, p AS (SELECT profile_id, {_POOL} FROM records GROUP BY 1) SELECT a.profile_id AS left_id, b.profile_id AS right_id, round(a.psnr - b.psnr, 5) AS delta_psnr, round(a.ssim - b.ssim, 5) AS delta_ssim, round(a.payload_bpp - b.payload_bpp, 5) AS delta_payload_bpp FROM p a, p b WHERE (a.profile_id, b.profile_id) IN (('AF', 'NO'), ('RF', 'AF'), ('AF', 'XX'))")
def key_comparisons(spark, sf_dir):
    a = pooled_rd_report(spark, sf_dir)
    return _rounded(reports.compare(a, [("AF", "NO"), ("RF", "AF"), ("AF", "XX")], "profile_id", ["psnr", "ssim", "payload_bpp"]), 5)


_CURVE = [("a", 1.0, 30.0), ("a", 2.0, 33.0), ("a", 3.0, 35.5), ("a", 4.0, 37.0), ("a", 6.0, 39.5), ("b", 1.2, 31.0), ("b", 2.2, 34.0), ("b", 3.5, 36.0), ("b", 5.0, 38.0)]


@query(f"WITH p AS (SELECT curve, CAST(rate AS DOUBLE) AS rate, CAST(psnr AS DOUBLE) AS psnr, lead(rate) OVER o AS nr, lead(psnr) OVER o AS np FROM (VALUES {', '.join(map(str, _CURVE))}) v(curve, rate, psnr) WINDOW o AS (PARTITION BY curve ORDER BY rate)), t AS (SELECT unnest([0.5, 2.0, 2.5, 4.0, 5.5]) AS target) SELECT curve, CAST(target AS DOUBLE) AS target, round(CASE WHEN abs(rate - target) < 1e-12 THEN psnr ELSE psnr + (log2(target) - log2(rate)) / (log2(nr) - log2(rate)) * (np - psnr) END, 6) AS psnr FROM p, t WHERE abs(rate - target) < 1e-12 OR (target > rate + 1e-12 AND target < nr - 1e-12)")
def bracket_interpolate(spark, sf_dir):
    points = spark.createDataFrame(_CURVE, "curve string, rate double, psnr double")
    targets = spark.createDataFrame([(t,) for t in (0.5, 2.0, 2.5, 4.0, 5.5)], "target double")
    return _rounded(prefix.interpolated(points, targets, "rate", ["psnr"], "curve"))


# A cubic through five points in least squares misses each by a share of their fourth divided difference, and Simpson's
# rule is exact for cubics.
_BD_SQL = f"""WITH v AS (SELECT * FROM (VALUES {', '.join(map(str, _CURVE))}) v(curve, rate, psnr)),
sides AS (SELECT 'pair' AS key, curve AS side, ln(rate) AS y, CAST(psnr AS DOUBLE) AS x FROM v UNION ALL SELECT 'same', s.side, ln(rate), psnr FROM v, (SELECT unnest(['a', 'b']) AS side) s WHERE curve = 'a'),
p AS (SELECT *, row_number() OVER (PARTITION BY key, side ORDER BY x) AS i, count(*) OVER (PARTITION BY key, side) AS n FROM sides),
ends AS (SELECT key, max(least_x) AS low, min(most_x) AS high FROM (SELECT key, side, min(x) AS least_x, max(x) AS most_x FROM p GROUP BY 1, 2) GROUP BY 1),
w AS (SELECT a.key, a.side, a.i, a.x, a.y, a.n, 1 / product(a.x - b.x) AS w FROM p a JOIN p b ON (a.key, a.side) = (b.key, b.side) AND a.i <> b.i GROUP BY ALL),
fit AS (SELECT key, side, i, x, y - CASE WHEN n = 5 THEN w * sum(w * y) OVER (PARTITION BY key, side) / sum(w * w) OVER (PARTITION BY key, side) ELSE 0 END AS y FROM w),
nodes AS (SELECT key, unnest([low, (low + high) / 2, high]) AS t, unnest([1, 4, 1]) AS weight FROM ends),
terms AS (SELECT a.key, a.side, t, weight, a.i, a.y * product((t - b.x) / (a.x - b.x)) AS term FROM fit a JOIN fit b ON (a.key, a.side) = (b.key, b.side) AND a.i <> b.i AND a.i <= 4 AND b.i <= 4 JOIN nodes ON nodes.key = a.key GROUP BY a.key, a.side, t, weight, a.i, a.y),
means AS (SELECT key, side, sum(weight * term) / 6 AS mean FROM terms GROUP BY 1, 2)
SELECT a.key, round((exp(a.mean - b.mean) - 1) * 100, 6) + 0.0 AS bd_rate FROM means a JOIN means b ON a.key = b.key AND a.side = 'a' AND b.side = 'b' UNION ALL SELECT 'short', NULL"""


@query(_BD_SQL)
def bd_rate(spark, sf_dir):
    rows = [("pair", s, r, q) for s, r, q in _CURVE] + [("same", s, r, q) for k, r, q in _CURVE if k == "a" for s in "ab"] + [("short", s, r, q) for s, r, q in _CURVE[4:]]
    found = reports.bd_rate(spark.createDataFrame(rows, "key string, side string, rate double, quality double"))
    return found.select("key", (F.round("bd_rate", 6) + 0.0).alias("bd_rate"))


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def last_wins_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return sampling.last_wins(e, ["user_id", "event_type"], "event_id")


@query("SELECT user_id, event_type, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def first_wins_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return sampling.first_wins(e, ["user_id", "event_type"], "event_id").drop("event_id")


@query("SELECT DISTINCT user_id, event_type FROM events a WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND b.value > 50)")
def resume_anti_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    keys = ["user_id", "event_type"]
    return sampling.work_list(e.select(*keys).distinct(), e.where("value > 50").select(*keys), keys)


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def unknown_ids(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(c("c_custkey").alias("id"))
    return sampling.unknown_ids(table(spark, sf_dir, "orders").select(c("o_custkey").alias("id")), known, "id")


@query("WITH e AS (SELECT user_id, event_type, value, event_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS s FROM events) SELECT user_id, event_type, arg_max(value, {'s': s, 'e': event_id}) AS value, min({'s': s, 'e': event_id}).s AS first_side, min({'s': s, 'e': event_id}).e AS first_id FROM e GROUP BY 1, 2")
def union_keyed_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    u = sampling.keyed_union(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")
    return u.select("user_id", "event_type", "value", c("first_place._s").alias("first_side"), c("first_place.event_id").alias("first_id"))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS tags FROM events GROUP BY 1")
def merged_tags(spark, sf_dir):
    return sampling.merged_tags(table(spark, sf_dir, "events"), ["user_id"], "event_type").select("user_id", F.array_join("tags", ",").alias("tags"))


_PART = "pt AS (SELECT p_partkey, p_brand AS profile, 4 * (1 + p_size % 3) AS bsize, 2 + p_size % 2 AS l, CASE WHEN p_retailprice > 1200 THEN 24 ELSE 16 END AS bits FROM part)"


@query(f"WITH {_PART} SELECT profile AS profile_id, 'B' || bsize || '/L' || l || '/RGB' || bits AS settings, count(*) AS n FROM pt GROUP BY 1, 2")
def settings_distribution(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(c("p_brand").alias("profile"), ((c("p_size") % 3 + 1) * 4).alias("bsize"), (c("p_size") % 2 + 2).alias("l"), F.when(c("p_retailprice") > 1200, 24).otherwise(16).alias("bits"))
    return reports.settings_distribution(p, "profile", [("B", "bsize"), ("L", "l"), ("RGB", "bits")])


@query("WITH w AS (SELECT target, greatest(0, (coalesce(lag(target) OVER o, target - (lead(target) OVER o - target)) + target) / 2) AS low, (coalesce(lead(target) OVER o, target + (target - lag(target) OVER o)) + target) / 2 AS high FROM (SELECT unnest([1.0, 2.0, 4.0, 8.0]) AS target) WINDOW o AS (ORDER BY target)), r AS (SELECT o_orderpriority AS dataset, [1.0, 2.0, 4.0, 8.0][o_orderkey % 4 + 1] AS target, (o_custkey % 90) / 10.0 AS sel FROM orders) SELECT dataset, count(*) AS searched, count(*) FILTER (sel < low - 1e-9 OR sel > high + 1e-9) AS outside, CAST(min(sel) FILTER (sel < low - 1e-9 OR sel > high + 1e-9) AS DOUBLE) AS least, CAST(max(sel) FILTER (sel < low - 1e-9 OR sel > high + 1e-9) AS DOUBLE) AS most FROM r JOIN w USING (target) GROUP BY 1")
def fallback_summary(spark, sf_dir):
    targets = prefix.midpoint_windows(spark.createDataFrame([(t,) for t in (1.0, 2.0, 4.0, 8.0)], "target double"))
    o = table(spark, sf_dir, "orders")
    pick = F.get(F.array(*map(F.lit, (1.0, 2.0, 4.0, 8.0))), (c("o_orderkey") % 4).cast("int"))
    return reports.fallback_summary(o.select(c("o_orderpriority").alias("dataset"), pick.alias("target"), ((c("o_custkey") % 90) / 10.0).alias("selected")), targets)


@query(
    "WITH e AS (SELECT vec_id, i.range AS i, CAST(embedding[i.range * 3 + 1] AS DOUBLE) AS ax, CAST(embedding[i.range * 3 + 2] AS DOUBLE) AS ay, CAST(embedding[i.range * 3 + 3] AS DOUBLE) AS az, CAST(embedding[i.range * 3 + 4] AS DOUBLE) AS bx, CAST(embedding[i.range * 3 + 5] AS DOUBLE) AS b_y, CAST(embedding[i.range * 3 + 6] AS DOUBLE) AS bz FROM embeddings, range(20) i), "
    "a AS (SELECT degrees(acos(least(1, greatest(-1, (ax*bx + ay*b_y + az*bz) / (greatest(1e-8, sqrt(ax*ax+ay*ay+az*az)) * greatest(1e-8, sqrt(bx*bx+b_y*b_y+bz*bz))))))) AS deg FROM e), h AS (SELECT CAST(floor(round(deg, 6) / 0.25) AS BIGINT) AS bin, count(*) AS n FROM a GROUP BY 1), r AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS run, sum(n) OVER () AS total FROM h) SELECT CAST((min(bin) + 1) * 0.25 AS DOUBLE) AS edge FROM r WHERE run >= ceil(total * 0.95)"
)
def normal_angle_percentile(spark, sf_dir):
    """95th percentile of the angle between neighbouring triples, from quarter-degree bins."""
    e = table(spark, sf_dir, "embeddings").select("embedding", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
    at = lambda k: F.get("embedding", c("i") * 3 + k).cast("double")
    v = e.select(*[at(k).alias(n) for k, n in enumerate(("ax", "ay", "az", "bx", "by", "bz"))])
    norm = lambda s: F.greatest(F.lit(1e-8), F.sqrt(c(f"{s}x") * c(f"{s}x") + c(f"{s}y") * c(f"{s}y") + c(f"{s}z") * c(f"{s}z")))
    dot = (c("ax") * c("bx") + c("ay") * c("by") + c("az") * c("bz")) / (norm("a") * norm("b"))
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot))))
    bins = v.groupBy(F.floor(F.round(angle, 6) / 0.25).alias("bin")).agg(F.count("*").alias("n"))
    return reports.histogram_percentile(bins, 0.95, 0.25)


# ---------------------------------------------------------------- samples
@query("SELECT doc_id FROM documents ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def hash_ordered_sample(spark, sf_dir):
    return sampling.by_hash(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50)


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")
def limit_per_dataset(spark, sf_dir):
    return sampling.first_per_group(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"], 5)


@query("WITH t AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS turn FROM documents) SELECT doc_id, source FROM t ORDER BY turn, source LIMIT 47")
def stratified_round_robin(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.round_robin(d, "source", [F.sha2(c("doc_id").cast("string"), 256), "doc_id"], 47)


_WEIGHTS = {"src0": 100.0, "src1": 45.0, "src2": 55.0, "src3": 30.0}


@query(
    "WITH a AS (SELECT source, count(*) AS n FROM documents WHERE source IN ('src0','src1','src2','src3') GROUP BY 1), w AS (SELECT * FROM (VALUES ('src0',100.0),('src1',45.0),('src2',55.0),('src3',30.0)) v(source, w)), x AS (SELECT source, n, 15 * w / sum(w) OVER () AS raw, w FROM a JOIN w USING (source)), "
    "q AS (SELECT *, floor(raw) AS base, row_number() OVER (ORDER BY raw - floor(raw) DESC, w DESC) AS turn, 15 - sum(floor(raw)) OVER () AS left_over FROM x) SELECT source, CAST(base + CASE WHEN turn <= left_over THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q"
)
def quota_alloc(spark, sf_dir):
    """Largest-remainder quotas of four sources."""
    counts = table(spark, sf_dir, "documents").where(c("source").isin(list(_WEIGHTS))).groupBy("source").count().collect()
    q = sampling.quotas({r["source"]: r["count"] for r in counts}, _WEIGHTS, 15)
    return spark.createDataFrame(sorted(q.items()), "source string, quota bigint")


_STRATIFIED_SQL = """WITH wt AS (SELECT * FROM (VALUES ('src0', 100.0), ('src1', 45.0), ('src2', 55.0), ('src3', 30.0)) w(source, weight)),
have AS (SELECT source, weight, count(*) AS n FROM documents JOIN wt USING (source) GROUP BY 1, 2),
share AS (SELECT *, 33 * weight / sum(weight) OVER () AS exact FROM have),
base AS (SELECT *, least(n, CAST(floor(exact) AS BIGINT)) AS q FROM share),
spare AS (SELECT source, exact, weight, unnest(range(n - q)) AS round FROM base),
given AS (SELECT source, count(*) AS more FROM (SELECT source FROM spare QUALIFY row_number() OVER (ORDER BY round, exact - floor(exact) DESC, weight DESC) <= 33 - (SELECT sum(q) FROM base)) GROUP BY 1),
quota AS (SELECT source, q + coalesce(more, 0) AS q FROM base LEFT JOIN given USING (source)),
turn AS (SELECT doc_id, source, lang, q, row_number() OVER (PARTITION BY source, lang ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS turn FROM documents JOIN quota USING (source))
SELECT doc_id, source, lang FROM turn QUALIFY row_number() OVER (PARTITION BY source ORDER BY turn, lang NULLS FIRST) <= q"""


@query(_STRATIFIED_SQL)
def stratified_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return sampling.stratified(d, "source", "lang", "doc_id", _WEIGHTS, 33)


@query(f"WITH {BLK_SQL}, w AS (SELECT vec_id, pos, s, {', '.join(f'lag(s, {k}) OVER o AS a{k}, lead(s, {k}) OVER o AS b{k}' for k in range(1, 6))} FROM blk WINDOW o AS (PARTITION BY vec_id ORDER BY pos)) SELECT vec_id, pos, round({repr(prefix.gaussian_taps()[5])} * s + {' + '.join(f'{prefix.gaussian_taps()[5 + k]!r} * (a{k} + b{k})' for k in range(1, 6))}, 6) AS smooth FROM w WHERE a5 IS NOT NULL AND b5 IS NOT NULL")
def gaussian_window(spark, sf_dir):
    return prefix.gaussian_window(samples(spark, sf_dir), "s", "pos", "vec_id").select("vec_id", c("pos").cast("long").alias("pos"), F.round("smooth", 6).alias("smooth"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, 'left' AS side FROM orders WHERE o_orderstatus = 'F' AND o_totalprice <= 100000 UNION ALL SELECT o_orderkey, o_orderstatus, 'right' FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 100000")
def compare_states(spark, sf_dir):
    """Rows that only one of two results has."""
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("status"), "o_totalprice")
    return sampling.same_rows(o.where("status = 'F'").drop("o_totalprice"), o.where("o_totalprice > 100000").drop("o_totalprice"))


# ---------------------------------------------------------------- further windows, keys and searches
@query(f"WITH {BLK_SQL} SELECT vec_id, pos, max(s) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS best FROM blk")
def sliding_max(spark, sf_dir):
    """The largest of the four values before each one, as the skip coder's states need it."""
    return prefix.sliding_max(samples(spark, sf_dir), "s", "pos", 4, "vec_id").select("vec_id", c("pos").cast("long").alias("pos"), "best")


@query(f"WITH {_PAT}, b AS (SELECT block, range AS pos, p[range + 1] AS bit FROM pat, range(64)) SELECT block, pos, bit, CAST(coalesce(sum(bit) OVER (PARTITION BY block ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rank FROM b")
def bitmap_rank(spark, sf_dir):
    """Set bits before each place of a block's bitmap, by counting the bits of a masked word."""
    word = F.aggregate(F.zip_with("p", F.sequence(F.lit(0), F.lit(63)), lambda v, i: F.call_function("shiftleft", v.cast("long"), i)), F.lit(0).cast("long"), lambda a, v: a.bitwiseOR(v))
    each = _patterns(spark, sf_dir).select("block", "p", word.alias("word"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos"))
    below = c("word").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), c("pos"))))
    return each.select("block", c("pos").cast("long").alias("pos"), F.get("p", c("pos")).alias("bit"), F.bit_count(below).cast("long").alias("rank"))


@query("SELECT vec_id AS idx, vec_id % 64 AS u, vec_id // 64 AS v FROM embeddings")
def atlas_layout(spark, sf_dir):
    """Row-major places of values in a texture of a given width."""
    return table(spark, sf_dir, "embeddings").select(c("vec_id").alias("idx"), (c("vec_id") % 64).alias("u"), F.expr("vec_id div 64").alias("v"))


@query(f"WITH {_GRID}, tg AS (SELECT unnest([2.0, 4.0, 6.0]) AS target), s AS (SELECT CAST(target AS DOUBLE) AS target, b, l, g, p, bits, payload_bits, (b * 7 + l * 31 + g * 3 + p * 11 + bits) % 101 AS err FROM rates, tg WHERE payload_bits / 1048576.0 <= target AND payload_bits / 1048576.0 > target - 0.25) SELECT target, b, l, g, p, bits, err, rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY err, payload_bits DESC, b, l, g, p, bits) AS rank FROM s) WHERE rank <= 12")
def top_settings_per_target(spark, sf_dir):
    """The twelve settings of least error for each target rate, the higher rate first on ties."""
    from pyspark.sql import Window

    s = settings_grid_rates(spark, sf_dir).where(c("target").isin(2.0, 4.0, 6.0)).withColumn("err", (c("b") * 7 + c("l") * 31 + c("g") * 3 + c("p") * 11 + c("bits")) % 101)
    rank = F.row_number().over(Window.partitionBy("target").orderBy("err", F.desc("payload_bits"), "b", "l", "g", "p", "bits"))
    return s.withColumn("rank", rank).where("rank <= 12").select("target", "b", "l", "g", "p", "bits", "err", c("rank").cast("long").alias("rank"))


@query("SELECT lang, source, count(*) AS n, count(DISTINCT n_chars) AS lengths FROM documents GROUP BY 1, 2")
def counts_by_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_distinct("n_chars").alias("lengths"))


def duration(seconds):
    """Seconds as 1h 02m, 2m 03s or 4.5s."""
    whole = F.floor(seconds + 0.5)
    return (
        F.when(seconds >= 3600, F.format_string("%dh %02dm", F.floor(whole / 3600), F.floor(whole % 3600 / 60)))
        .when(seconds >= 60, F.format_string("%dm %02ds", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%.1fs", seconds))
    )


@query("WITH o AS (SELECT o_orderkey AS id, (o_orderkey * 37 % 90000) / 10.0 AS s FROM orders) SELECT id, CASE WHEN s >= 3600 THEN printf('%dh %02dm', CAST(floor(s + 0.5) AS BIGINT) // 3600, CAST(floor(s + 0.5) AS BIGINT) % 3600 // 60) WHEN s >= 60 THEN printf('%dm %02ds', CAST(floor(s + 0.5) AS BIGINT) // 60, CAST(floor(s + 0.5) AS BIGINT) % 60) ELSE printf('%.1fs', CAST(s AS DOUBLE)) END AS took FROM o")
def durations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), (((c("o_orderkey") * 37) % 90000) / 10.0).alias("s"))
    return o.select("id", duration(c("s")).alias("took"))


@query(r"SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM events")
def parsed_fields(spark, sf_dir):
    """A field of JSON text, with an explicit schema."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("WITH s AS (SELECT o_orderkey, o_custkey % 5 AS block_size, o_orderkey % 3 AS passes FROM orders) SELECT o_orderkey AS id, coalesce(nullif(block_size, 0), 8) AS block_size, coalesce(nullif(passes, 0), 4) AS passes FROM s")
def settings_defaults(spark, sf_dir):
    """Settings with what is not given filled in."""
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), F.nullif(c("o_custkey") % 5, F.lit(0)).alias("block_size"), F.nullif(c("o_orderkey") % 3, F.lit(0)).alias("passes"))
    return o.fillna({"block_size": 8, "passes": 4})


@query("SELECT o_orderkey AS id, (o_orderstatus IS NOT DISTINCT FROM 'F') AND (CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey % 4 END IS NOT DISTINCT FROM NULL) AS reusable FROM orders")
def reusable_records(spark, sf_dir):
    """Whether a stored record can stand for a job: all its fields are as expected, null being equal to null."""
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("status"), F.when(c("o_custkey") % 4 != 0, c("o_custkey") % 4).alias("setting"))
    return o.select("id", sampling.reusable(o, {"status": F.lit("F"), "setting": F.lit(None)}).alias("reusable"))


@query(f"WITH {RECORDS_SQL} SELECT profile_id, round(sum(squared_error) / CAST(sum(samples) AS DOUBLE), 9) AS mse FROM records GROUP BY 1")
def verified_metrics(spark, sf_dir):
    """Stored errors computed anew from their parts; the query fails where they differ."""
    r = records(spark, sf_dir).groupBy("profile_id").agg(F.sum("squared_error").alias("e"), F.sum("samples").alias("n"))
    stored = r.withColumn("mse", c("e") / c("n"))
    return reports.verified(stored, "mse", c("e").cast("double") / c("n").cast("double")).select("profile_id", F.round("mse", 9).alias("mse"))
