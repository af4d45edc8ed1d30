"""Formulas, tables and orders of the codecs applied to every row of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import coding
from tessella.functions import numeric as num
from tessella.operators import matching, prefix, reports
from tessella.operators.settings_search import rate_bits
from tessella.plans import catalog
from tessella.plans.catalog import query
from tessella.plans.fixtures import BLK_SQL, samples, table

c = F.col


def _pick(values: list[int], at):
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), at.cast("int"))


# ---------------------------------------------------------------- settings and rates
_B, _L, _G, _P, _T = [4, 8, 16, 32, 64], [2, 4, 8, 16], [8, 16, 32, 64, 128, 256], [1, 2, 4, 8, 16, 32, 64, 128], [16, 24]


@query(
    f"WITH s AS (SELECT p_partkey AS id, 64 + p_partkey % 300 AS w, 48 + p_partkey % 200 AS h, {_B}[p_partkey % 5 + 1] AS b, {_L}[p_partkey // 5 % 4 + 1] AS l, {_G}[p_partkey // 20 % 6 + 1] AS g, {_P}[p_partkey // 120 % 8 + 1] AS p, {_T}[p_partkey % 2 + 1] AS t FROM part) "
    "SELECT id, CAST(p * g * t + ceil(w / b) * ceil(h / b) * (log2(p) + l * log2(g)) + CASE WHEN l = b * b THEN 0 ELSE w * h * log2(l) END AS BIGINT) AS payload_bits FROM s WHERE l <= g AND l <= b * b"
)
def part_settings_rates(spark, sf_dir):
    """Rates by formula of the valid settings among those that parts stand for."""
    k, div = c("p_partkey"), lambda n: F.expr(f"p_partkey div {n}")
    s = table(spark, sf_dir, "part").select(k.alias("id"), (k % 300 + 64).alias("w"), (k % 200 + 48).alias("h"), _pick(_B, k % 5).alias("b"), _pick(_L, div(5) % 4).alias("l"), _pick(_G, div(20) % 6).alias("g"), _pick(_P, div(120) % 8).alias("p"), _pick(_T, k % 2).alias("t"))
    valid = s.where("l <= g and l <= b * b")
    return valid.select("id", rate_bits(c("p"), c("g"), c("t"), c("b"), c("l"), c("w"), c("h")).cast("long").alias("payload_bits"))


@query(
    "WITH t AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS target FROM part WHERE p_size % 3 = 0), w AS (SELECT target, greatest(0, (coalesce(lag(target) OVER o, target - (lead(target) OVER o - target)) + target) / 2) AS low, (coalesce(lead(target) OVER o, target + (target - lag(target) OVER o)) + target) / 2 AS high FROM t WINDOW o AS (ORDER BY target)) "
    "SELECT target, low, high, count(*) AS n FROM w JOIN lineitem ON l_quantity > low AND l_quantity <= high GROUP BY 1, 2, 3"
)
def rate_windows(spark, sf_dir):
    """Line items in the window about each of the target rates, sizes of parts."""
    targets = matching.small(table(spark, sf_dir, "part").where("p_size % 3 = 0").select(c("p_size").cast("double").alias("target")).distinct())
    windows = prefix.midpoint_windows(targets)
    rates = table(spark, sf_dir, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n"))
    met = rates.join(F.broadcast(windows), (c("l_quantity") > c("low")) & (c("l_quantity") <= c("high")))  # a short list of windows
    return met.groupBy("target", "low", "high").agg(F.sum("n").alias("n"))


_SIDES = "sides AS (SELECT c_custkey AS key, CASE s WHEN 0 THEN 'a' ELSE 'b' END AS side, ln((i + 1) * (1 + c_custkey % 7 / 10.0::DOUBLE + s * (c_custkey % 11) / 20.0::DOUBLE)) AS y, CAST(30 + i * 2.5 + (c_custkey * 7 + i * 13 + s * 5) % 10 / 10.0::DOUBLE AS DOUBLE) AS x FROM customer, range(5) r(i), range(2) q(s))"
_BD = catalog._BD_SQL
_BD_CUSTOMERS = "WITH " + _SIDES + _BD[_BD.index(",\np AS") :].replace(" UNION ALL SELECT 'short', NULL", "").replace(", 6) + 0.0", ", 4) + 0.0")


@query(_BD_CUSTOMERS)
def bd_rate_customers(spark, sf_dir):
    """The mean rate difference of two curves of five points for every customer."""
    k = c("c_custkey")
    points = table(spark, sf_dir, "customer").select(k.alias("key"), F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("i")).select("key", "i", F.explode(F.array(F.lit(0), F.lit(1))).alias("s"))
    key, i, s = c("key"), c("i"), c("s")
    rate = (i + 1) * (F.lit(1) + key % 7 / 10.0 + s * (key % 11) / 20.0)
    curves = points.select("key", F.when(s == 0, "a").otherwise("b").alias("side"), rate.alias("rate"), (i * 2.5 + 30 + (key * 7 + i * 13 + s * 5) % 10 / 10.0).alias("quality"))
    return reports.bd_rate(curves).select("key", (F.round("bd_rate", 4) + 0.0).alias("bd_rate"))


# ---------------------------------------------------------------- palettes, tables and scans
_BYTES = "CAST(floor((CAST(embedding[{0}] AS DOUBLE) + 1) * 127.5) AS BIGINT)"


@query(
    f"WITH e AS (SELECT vec_id, idx, {_BYTES.format('3 * idx + 1')} AS r, {_BYTES.format('3 * idx + 2')} AS g, {_BYTES.format('3 * idx + 3')} AS b FROM embeddings, range(8) i(idx)) "
    "SELECT a.vec_id, a.idx AS i, b.idx AS j, (a.r - b.r) * (a.r - b.r) + (a.g - b.g) * (a.g - b.g) + (a.b - b.b) * (a.b - b.b) AS distance FROM e a JOIN e b ON a.vec_id = b.vec_id"
)
def palette_matrices(spark, sf_dir):
    """Distances between all entries of each of many palettes, vectors of eight colours."""
    byte = lambda at: F.floor((F.get("embedding", at).cast("double") + 1) * 127.5).cast("long")
    idx = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("idx")
    entries = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", idx).select("vec_id", c("idx").cast("long").alias("idx"), *[byte(c("idx") * 3 + k).alias(v) for k, v in enumerate("rgb")])
    return matching.distance_matrix(entries, "vec_id")


_STEP = "greatest(1.0::DOUBLE, b * (CASE WHEN quality < 50 THEN 50.0::DOUBLE / quality ELSE 2 - quality * 0.02::DOUBLE END))"


@query(
    f"WITH {BLK_SQL}, t AS (SELECT * FROM (VALUES {', '.join(f'({i}, {v})' for i, v in enumerate(coding.LUMA_TABLE))}) t(slot, b)), q AS (SELECT vec_id, pos, s - 128 AS s, 1 + vec_id % 100 AS quality, b FROM blk JOIN t ON slot = pos) "
    f"SELECT vec_id, pos, CAST({catalog._scale_sql('quality')} AS BIGINT) AS entry, sign(s) * ((2 * abs(s) + {catalog._scale_sql('quality')}) // (2 * {catalog._scale_sql('quality')})) AS level, round({_STEP}, 6) AS step FROM q"
)
def block_quality_tables(spark, sf_dir):
    """Every block with the scaled table and the float steps of its own quality, 1 to 100, and its levels."""
    quality = c("quality")
    base = F.get(F.array(*[F.lit(v).cast("long") for v in coding.LUMA_TABLE]), c("pos"))
    low, high = F.call_function("div", base * 5000 + quality * 50, quality * 100), F.call_function("div", base * (200 - quality * 2) + 50, F.lit(100).cast("long"))
    b = samples(spark, sf_dir).select("vec_id", "pos", (c("s") - 128).alias("s"), (c("vec_id") % 100 + 1).alias("quality"))
    entry = num.clamp(F.when(quality < 50, low).otherwise(high), 1, 255).cast("long")
    # one row for each quality and place, 6,400 in all
    steps = spark.createDataFrame([(q, p, coding.quantisation_step(p % 8, p // 8, 8, 8, q, False)) for q in range(1, 101) for p in range(64)], "quality long, pos int, step double")
    with_entry = b.withColumn("entry", entry).join(F.broadcast(steps), ["quality", "pos"])
    return with_entry.select("vec_id", c("pos").cast("long").alias("pos"), "entry", num.divide_signed(c("s"), c("entry")).cast("long").alias("level"), F.round("step", 6).alias("step"))


def _scans_sql() -> str:
    base = "WITH g AS (SELECT CAST(v.range AS DOUBLE) AS v, CAST(u.range AS DOUBLE) AS u FROM range(8) v, range(8) u WHERE u.range + v.range > 0) " + " UNION ALL ".join(f"SELECT {p} AS profile, CAST(v * 8 + u AS BIGINT) AS position, row_number() OVER (ORDER BY round({s}, 9), u + v, v, u) - 1 AS rank FROM g" for p, s in enumerate(catalog._BASE_SCORE))
    return f"WITH {BLK_SQL}, scans AS (SELECT * FROM ({base}) UNION ALL SELECT profile + 4, position, rank FROM ({catalog._SKIP_SQL})) SELECT vec_id, rank, s FROM blk JOIN scans ON profile = vec_id % 12 AND position = pos"


@query(_scans_sql())
def scanned_blocks(spark, sf_dir):
    """The samples of every block in the order of one of the twelve scans."""
    orders = [coding.scan(p, 8, 8) for p in range(4)] + [coding.skip_scan(p, 8, 8) for p in range(8)]
    scans = F.array(*[F.array(*map(F.lit, order)) for order in orders])
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.posexplode(F.get(scans, (c("vec_id") % 12).cast("int"))).alias("rank", "position"))
    return e.select("vec_id", c("rank").cast("long").alias("rank"), F.floor((F.get("embedding", c("position")).cast("double") + 1) * 127.5).cast("long").alias("s"))


@query(
    "WITH RECURSIVE g AS (SELECT vec_id, 0 AS i, CAST((vec_id + 1) * 2654435769 % 4294967296 AS BIGINT) AS s FROM embeddings UNION ALL SELECT vec_id, i + 1, (s * 1664525 + 1013904223) % 4294967296 FROM g WHERE i < 16) "
    "SELECT a.vec_id, CAST((a.i - 1) // 2 AS INTEGER) AS q, a.s % 100 AS x, b.s % 64 AS y FROM g a JOIN g b ON b.vec_id = a.vec_id AND b.i = a.i + 1 WHERE a.i % 2 = 1"
)
def vector_queries(spark, sf_dir):
    """Eight pseudorandom places for every vector, from a linear congruential sequence that its id starts."""
    step = lambda s: (s * 1664525 + 1013904223) % (1 << 32)
    first = ((c("vec_id") + 1) * 2654435769 % (1 << 32)).cast("long")
    start = F.struct(first.alias("s"), F.array().cast("array<bigint>").alias("seen"))
    seen = F.aggregate(F.sequence(F.lit(1), F.lit(16)), start, lambda acc, i: F.struct(step(acc["s"]).alias("s"), F.concat(acc["seen"], F.array(step(acc["s"]))).alias("seen")))["seen"]
    each = table(spark, sf_dir, "embeddings").select("vec_id", seen.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("q"))
    return each.select("vec_id", "q", (F.get("s", c("q") * 2) % 100).alias("x"), (F.get("s", c("q") * 2 + 1) % 64).alias("y"))
