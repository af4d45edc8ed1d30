"""Queries over whole tables whose order, curves or neighbourhoods no single task holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import asof, corpus_palette, hamming_join, order_statistics, prefix, staged_search, transform, tree_join
from tessella.operators.farthest import farthest_first
from tessella.operators.matching import palette_rows
from tessella.plans import catalog
from tessella.plans.catalog import query
from tessella.plans.fixtures import PX_SQL, pixels, table
from tessella.streaming import records, sessions
from tessella.workspace import Workspace

c = F.col

# ---------------------------------------------------------------- skylines and curves
_TRIALS = (
    "trials AS (SELECT l_orderkey AS image_id, l_linenumber AS place, l_returnflag AS family, CAST(round(l_extendedprice * 100) AS BIGINT) AS cost, "
    "(l_partkey * 7919 + l_suppkey * 104729 + l_orderkey * 31) % 1000003 AS error FROM lineitem)"
)


def _trials(spark, sf_dir):
    error = (c("l_partkey") * 7919 + c("l_suppkey") * 104729 + c("l_orderkey") * 31) % 1000003
    return table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("image_id"), c("l_linenumber").alias("place"), c("l_returnflag").alias("family"), F.round(c("l_extendedprice") * 100).cast("long").alias("cost"), error.alias("error"))


@query(f"WITH {_TRIALS}, least AS (SELECT cost, min(error) AS error FROM trials GROUP BY 1), front AS (SELECT cost, error, min(error) OVER (ORDER BY cost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM least) SELECT t.* FROM trials t JOIN front f ON t.cost = f.cost AND t.error = f.error WHERE before IS NULL OR f.error < before")
def skyline_trials(spark, sf_dir):
    """Line items as trials: those that no other beats in both cost and error, over all of them."""
    return prefix.undominated(_trials(spark, sf_dir), "cost", "error")


@query(f"WITH {_TRIALS} SELECT family, cost, quality FROM (SELECT *, max(quality) OVER (PARTITION BY family ORDER BY cost, quality ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (SELECT DISTINCT family, cost, -error AS quality FROM trials WHERE cost > 0)) WHERE best IS NULL OR quality > best")
def rate_curve_trials(spark, sf_dir):
    """The curve of best quality so far of each family, a third of all rows or more belonging to one."""
    t = _trials(spark, sf_dir).select("family", "cost", (-c("error")).alias("quality"))
    return prefix.rate_curve(t, "cost", "quality", "family")


_UNITS = (
    "WITH cand AS (SELECT 50 AS quality, l_orderkey * 8 + l_linenumber AS unit, CAST(64 + l_partkey % 96 AS BIGINT) AS bits0, CAST((l_partkey * 7919) % 4001 AS BIGINT) AS sse0, "
    "CAST(40 + (l_suppkey * 13) % 120 AS BIGINT) AS bits1, CAST((l_orderkey * 31 + l_linenumber * 977) % 5003 AS BIGINT) AS sse1 FROM lineitem)"
)


def _units(spark, sf_dir):
    k, p, s, n = (c(f"l_{x}").cast("long") for x in ("orderkey", "partkey", "suppkey", "linenumber"))
    return table(spark, sf_dir, "lineitem").select(F.lit(50).alias("quality"), (k * 8 + n).alias("unit"), (p % 96 + 64).alias("bits0"), (p * 7919 % 4001).alias("sse0"), (s * 13 % 120 + 40).alias("bits1"), ((k * 31 + n * 977) % 5003).alias("sse1"))


@query(_UNITS + catalog._SWEEP + " SELECT * FROM sw")
def sweep_units(spark, sf_dir):
    """Every state of one quality's sweep, each line item being a unit."""
    return transform.sweep(_units(spark, sf_dir), 96, "quality")


@query(_UNITS + catalog._SWEEP + ", b AS (SELECT count(*) * 12 AS budget FROM lineitem) SELECT sw.*, payload_bytes <= budget AS within_target FROM sw, b ORDER BY payload_bytes > budget, CASE WHEN payload_bytes <= budget THEN sse ELSE payload_bytes END, CASE WHEN payload_bytes <= budget THEN payload_bytes ELSE sse END, quality, step LIMIT 1")
def sweep_budget(spark, sf_dir):
    """The state of least error within twelve bytes a unit."""
    units = _units(spark, sf_dir)
    return transform.select_state(transform.sweep(units, 96, "quality"), 12 * units.count(), ["quality", "step"])


# ---------------------------------------------------------------- as-of joins
@query(
    "WITH k AS (SELECT user_id, ts, arg_max(value, event_id) AS click_value, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) "
    "SELECT p.event_id, CASE WHEN epoch(p.ts) - epoch(k.ts) <= 86400 THEN click_id END AS click_id, CASE WHEN epoch(p.ts) - epoch(k.ts) <= 86400 THEN click_value END AS click_value "
    "FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN k ON p.user_id = k.user_id AND p.ts >= k.ts"
)
def purchase_asof_click(spark, sf_dir):
    """Each purchase with its user's last click of the day before it."""
    e = table(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", c("event_id").alias("click_id"), c("value").alias("click_value"))
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    out = asof.asof_join(bought, clicks, "ts", "click_id", "user_id", within=86400)
    return out.select("event_id", c("match.click_id").alias("click_id"), c("match.click_value").alias("click_value"))


@query(
    "WITH p AS (SELECT round(value * 100) / 100 AS rate, arg_max(user_id, event_id) AS q FROM events WHERE value > 0 GROUP BY 1), p2 AS (SELECT round(value * 100) / 100 AS rate, arg_min(user_id, event_id) AS q FROM events WHERE value > 0 GROUP BY 1), "
    "t AS (SELECT o_orderkey, o_totalprice / 1000 AS target FROM orders), lo AS (SELECT t.o_orderkey, t.target, p.rate AS r0, p.q AS q0 FROM t ASOF LEFT JOIN p ON t.target >= p.rate), hi AS (SELECT t.o_orderkey, p2.rate AS r1, p2.q AS q1 FROM t ASOF LEFT JOIN p2 ON t.target <= p2.rate) "
    "SELECT o_orderkey, r0, r1, round(CASE WHEN r1 = r0 THEN q0 ELSE q0 + ln(target / r0) / ln(r1 / r0) * (q1 - q0) END, 6) AS quality FROM lo JOIN hi USING (o_orderkey)"
)
def order_rate_brackets(spark, sf_dir):
    """Orders as target rates between the points of one curve, events: the bracket of each and the quality within it."""
    points = table(spark, sf_dir, "events").where("value > 0").select((F.round(c("value") * 100) / 100).alias("target"), c("user_id").cast("double").alias("q"), "event_id")
    targets = table(spark, sf_dir, "orders").select("o_orderkey", (c("o_totalprice") / 1000).alias("target"))
    low = asof.asof_join(targets, points, "target", "event_id").select("o_orderkey", "target", c("match.target").alias("r0"), c("match.q").alias("q0"))
    both = asof.asof_join(low, points, "target", "event_id", forward=True).withColumns({"r1": c("match.target"), "q1": c("match.q")})
    share = F.log(c("target") / c("r0")) / F.log(c("r1") / c("r0"))
    return both.select("o_orderkey", "r0", "r1", F.round(F.when(c("r1") == c("r0"), c("q0")).otherwise(c("q0") + share * (c("q1") - c("q0"))), 6).alias("quality"))


# ---------------------------------------------------------------- order statistics
@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1, 2")
def price_order_statistics(spark, sf_dir):
    """Exact quantiles of each of a few large groups."""
    rows = table(spark, sf_dir, "lineitem").select(c("l_returnflag").alias("flag"), c("l_linestatus").alias("status"), "l_extendedprice")
    q = order_statistics.quantiles(rows, "l_extendedprice", {"median": 0.5, "p95": 0.95, "p99": 0.99}, "flag", "status")
    return q.select("flag", "status", "n", *[F.round(v, 6).alias(v) for v in ("median", "p95", "p99")])


# ---------------------------------------------------------------- neighbourhoods
_BYTE = "CAST(floor((CAST(embedding[{0}] AS DOUBLE) + 1) * 127.5) AS BIGINT)"
_NEAREST = f"WITH {PX_SQL}, e AS (SELECT vec_id AS idx, {_BYTE.format(1)} AS pr, {_BYTE.format(2)} AS pg, {_BYTE.format(3)} AS pb FROM embeddings), q AS (SELECT DISTINCT r, g, b FROM px) SELECT r, g, b, arg_min(idx, {{'d': {catalog._D2}, 'i': idx}}) AS idx, min({catalog._D2}) AS distance FROM q, e GROUP BY 1, 2, 3"


@query(_NEAREST)
def tree_nearest_colors(spark, sf_dir):
    """The nearest of as many colours as there are vectors, for every distinct colour of the pixels."""
    byte = lambda i: F.floor((F.get("embedding", F.lit(i)).cast("double") + 1) * 127.5).cast("long")
    entries = table(spark, sf_dir, "embeddings").select(c("vec_id").alias("idx"), *[byte(i).alias(v) for i, v in enumerate("rgb")])
    return tree_join.tree_nearest(pixels(spark, sf_dir).select("r", "g", "b"), entries, ["r", "g", "b"])


_BITS = "pat AS (SELECT vec_id, CAST(array_to_string(list_transform(embedding, lambda v: CASE WHEN v >= 0 THEN '1' ELSE '0' END), '') AS BIT) AS p FROM embeddings), kinds AS (SELECT p, min(vec_id) AS head, count(*) AS n FROM pat GROUP BY 1)"


_HALF = _BITS.replace("list_transform(embedding,", "list_transform(embedding[1:32],")


@query(
    f"WITH {_HALF}, met AS (SELECT a.p, b.head AS other, b.n AS m, CAST(bit_count(xor(a.p, b.p)) AS INTEGER) AS d FROM kinds a JOIN kinds b ON a.p <> b.p AND bit_count(xor(a.p, b.p)) <= 5), "
    "t AS (SELECT p, sum(m) AS m, min({'d': d, 'o': other}) AS best FROM met GROUP BY 1) "
    "SELECT vec_id AS id, head, CAST(n - 1 + coalesce(m, 0) AS BIGINT) AS n_near, CASE WHEN n > 1 THEN 0 ELSE best.d END AS nearest, best.o AS partner FROM pat JOIN kinds USING (p) LEFT JOIN t USING (p)"
)
def near_patterns(spark, sf_dir):
    """The signs of every vector's first 32 components as a pattern, with how many others differ in five places or fewer."""
    patterns = table(spark, sf_dir, "embeddings").select(c("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 32), lambda v: F.when(v >= 0, 1).otherwise(0)).alias("p"))
    return hamming_join.near_patterns(patterns, 5, places=32)


def _dictionary_sql(k: int) -> str:
    """Each choice as a table of its own."""
    order = "ORDER BY {0} DESC, head LIMIT 1"
    parts = [_BITS, f"s0 AS MATERIALIZED (SELECT p FROM kinds {order.format('n')})", "t0 AS MATERIALIZED (SELECT kinds.*, bit_count(xor(kinds.p, s0.p)) AS near FROM kinds, s0)"]
    for i in range(1, k):
        parts.append(f"s{i} AS MATERIALIZED (SELECT p FROM t{i - 1} WHERE near > 0 {order.format('near * (1 + log2(n + 1))')})")
        parts.append(f"t{i} AS MATERIALIZED (SELECT t.p, t.head, t.n, coalesce(least(t.near, bit_count(xor(t.p, s{i}.p))), t.near) AS near FROM t{i - 1} t LEFT JOIN s{i} ON true)")
    chosen = " UNION ALL ".join(f"SELECT {i} AS proto, p AS q FROM s{i}" for i in range(k))
    return f"WITH {', '.join(parts)}, s AS ({chosen}) SELECT vec_id AS block, CAST(proto AS INTEGER) AS proto, CAST(bit_count(xor(p, q)) AS BIGINT) AS distance FROM pat, s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY bit_count(xor(p, q)), proto) = 1"


#: Entries of the dictionary of a corpus.
_ENTRIES = 24


@query(_dictionary_sql(_ENTRIES))
def corpus_dictionary(spark, sf_dir):
    """One dictionary of sign patterns for all vectors, frequent and far apart, and each vector's nearest entry."""
    patterns = table(spark, sf_dir, "embeddings").select(c("vec_id").alias("block"), hamming_join.word(F.transform("embedding", lambda v: F.when(v >= 0, 1).otherwise(0))).alias("word"))
    kinds = Workspace(spark, "dictionary").save(patterns.groupBy("word").agg(F.min("block").alias("head"), F.count("*").alias("n")), "kinds")
    far = lambda r: hamming_join.differing(c("word"), F.lit(r["word"])).cast("double")
    chosen = farthest_first(kinds, far, lambda near: near * (F.log2(c("n") + 1) + 1), c("n"), c("head"), _ENTRIES)
    near = F.array_min(F.array(*[F.struct(hamming_join.differing(c("word"), F.lit(r["word"])).cast("long").alias("d"), F.lit(i).alias("i")) for i, r in enumerate(chosen)]))
    return patterns.select("block", near.alias("near")).select("block", c("near.i").alias("proto"), c("near.d").alias("distance"))


def _palette_sql(k: int, rounds: int) -> str:
    """Each choice of the start and each round as tables of their own."""
    d2 = lambda a, b: " + ".join(f"({a}.{v} - {b}.{v}) * ({a}.{v} - {b}.{v})" for v in "rgb")
    parts = [PX_SQL, "cols AS MATERIALIZED (SELECT r, g, b, count(*) AS n, min(pos) AS first FROM px WHERE a <> 0 GROUP BY ALL)", "s0 AS MATERIALIZED (SELECT r, g, b FROM cols ORDER BY n DESC, first LIMIT 1)", f"t0 AS MATERIALIZED (SELECT c.*, {d2('c', 's0')} AS near FROM cols c, s0)"]
    for i in range(1, k):
        parts.append(f"s{i} AS MATERIALIZED (SELECT r, g, b FROM t{i - 1} WHERE near > 0 ORDER BY near * n DESC, first LIMIT 1)")
        parts.append(f"t{i} AS MATERIALIZED (SELECT t.r, t.g, t.b, t.n, t.first, coalesce(least(t.near, {d2('t', f's{i}')}), t.near) AS near FROM t{i - 1} t LEFT JOIN s{i} ON true)")
    start = " UNION ALL ".join(f"SELECT {i} AS slot, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM s{i}" for i in range(k))
    parts.append(f"m0 AS MATERIALIZED ({start})")
    own = "SELECT c.*, m.slot, {d} AS d FROM cols c, m{j} m QUALIFY row_number() OVER (PARTITION BY c.r, c.g, c.b ORDER BY {d}, m.slot) = 1"
    for j in range(rounds):
        means = ", ".join(f"sum({v} * n) / sum(n) AS {v}" for v in "rgb")
        parts.append(f"a{j} AS MATERIALIZED ({own.format(d=d2('c', 'm'), j=j)})")
        parts.append(f"m{j + 1} AS MATERIALIZED (SELECT o.slot, {', '.join(f'coalesce(q.{v}, o.{v}) AS {v}' for v in 'rgb')} FROM m{j} o LEFT JOIN (SELECT slot, {means} FROM a{j} GROUP BY 1) q USING (slot))")
    parts.append(f"a AS MATERIALIZED ({own.format(d=d2('c', 'm'), j=rounds)})")
    parts.append("p AS (SELECT slot, r AS pr, g AS pg, b AS pb, w FROM (SELECT *, sum(n) OVER (PARTITION BY slot) AS w, row_number() OVER (PARTITION BY slot ORDER BY round(d, 9), n DESC, first) AS k FROM a) WHERE k = 1)")
    parts.append("o AS (SELECT *, row_number() OVER (ORDER BY w DESC, slot) - 1 AS place FROM p)")
    return f"WITH {', '.join(parts)} SELECT r, g, b, n, CAST(place AS INTEGER) AS slot, pr, pg, pb FROM a JOIN o USING (slot)"


@query(_palette_sql(12, 6))
def corpus_palette_colors(spark, sf_dir):
    """One palette of twelve colours for all pixels, six rounds, and the entry of every distinct colour."""
    return corpus_palette.corpus_palette(pixels(spark, sf_dir), 12, rounds=6)


@query(f"WITH {PX_SQL}, {catalog._PAL}, q AS (SELECT r, g, b, count(*) AS n FROM px WHERE a <> 0 GROUP BY ALL), o AS (SELECT r, g, b, n, arg_min(idx, {{'d': {catalog._D2}, 'i': idx}}) AS idx FROM q, pal GROUP BY 1, 2, 3, 4) SELECT CAST(idx AS INTEGER) AS slot, CAST(sum(n) AS BIGINT) AS n, round(sum(r * n) / sum(n), 6) AS r, round(sum(g * n) / sum(n), 6) AS g, round(sum(b * n) / sum(n), 6) AS b FROM o GROUP BY 1")
def corpus_palette_round(spark, sf_dir):
    """One round from given centres."""
    centres = [[float(v) for v in row] for row in palette_rows(catalog.palette(spark))]
    means = corpus_palette.round_means(corpus_palette.weighted_colors(pixels(spark, sf_dir)), centres)
    return means.select("slot", "n", *[F.round(v, 6).alias(v) for v in "rgb"])


# ---------------------------------------------------------------- staged search
_TARGETS = (1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0)
_LIST = ", ".join(f"CAST({t} AS DOUBLE)" for t in _TARGETS)
_SEARCH_SQL = f"""WITH runs AS (SELECT l_partkey AS candidate, l_suppkey % 4 AS source, l_returnflag || l_linestatus AS policy, (l_orderkey * 31 + l_linenumber * 977 + l_suppkey * 7919) % 10007 AS error FROM lineitem),
candidates AS (SELECT p_partkey AS candidate, 1 + (p_partkey * 7919 % 2801) / 400.0::DOUBLE AS rate FROM part),
within AS (SELECT candidate, rate, target FROM candidates, (SELECT unnest([{_LIST}]) AS target) WHERE rate <= target AND rate >= target - 0.25),
screen AS (SELECT target, candidate, rate, error, row_number() OVER (PARTITION BY target ORDER BY error, rate DESC, candidate) AS rank FROM within JOIN (SELECT candidate, CAST(sum(error) AS DOUBLE) / count(*) AS error FROM runs WHERE source = 0 GROUP BY 1) USING (candidate) QUALIFY rank <= 12),
top AS (SELECT DISTINCT target, candidate, rate FROM screen WHERE rank <= 3),
validate AS (SELECT target, candidate, rate, error, row_number() OVER (PARTITION BY target ORDER BY error, rate DESC, candidate) AS rank FROM top JOIN (SELECT candidate, CAST(sum(error) AS DOUBLE) / count(*) AS error FROM runs GROUP BY 1) USING (candidate) QUALIFY rank <= 3),
policy AS (SELECT target, candidate, policy, rate, r.error, row_number() OVER (PARTITION BY target ORDER BY r.error, policy) AS rank FROM validate JOIN (SELECT candidate, policy, CAST(sum(error) AS DOUBLE) / count(*) AS error FROM runs GROUP BY 1, 2) r USING (candidate) WHERE rank = 1)
"""


def _searched(spark, sf_dir, root: str | None = None) -> tuple:
    """The rows of the three stages: parts as candidates, their line items as trial runs by source and policy."""
    k = lambda n: c(f"l_{n}").cast("long")
    error = (k("orderkey") * 31 + k("linenumber") * 977 + k("suppkey") * 7919) % 10007
    runs = table(spark, sf_dir, "lineitem").select(k("partkey").alias("candidate"), (k("suppkey") % 4).alias("source"), F.concat("l_returnflag", "l_linestatus").alias("policy"), error.alias("error"))
    candidates = table(spark, sf_dir, "part").select(c("p_partkey").cast("long").alias("candidate"), ((c("p_partkey") * 7919 % 2801) / 400.0 + 1).alias("rate"))
    mean = (F.sum("error").cast("double") / F.count("*")).alias("error")
    on = lambda rows, *by: lambda work: work.join(rows.groupBy(*by).agg(mean), list(by))
    stages = staged_search.Stages(spark, root)
    screen = staged_search.screened(stages, candidates, list(_TARGETS), on(runs.where("source = 0"), "candidate"))
    validate = staged_search.validated(stages, screen, on(runs, "candidate"))
    policies = runs.select("policy").distinct()
    return screen, validate, lambda: staged_search.with_policy(stages, validate, policies, on(runs, "candidate", "policy"))


@query(_SEARCH_SQL + "SELECT target, candidate, rate, error, rank FROM screen")
def search_screen(spark, sf_dir):
    """The twelve best candidates of each target rate on one source."""
    return _searched(spark, sf_dir)[0].withColumn("rank", c("rank").cast("long"))


@query(_SEARCH_SQL + "SELECT target, candidate, rate, error, rank FROM validate")
def search_validate(spark, sf_dir):
    """The three best of each target, scored on all sources."""
    return _searched(spark, sf_dir)[1].withColumn("rank", c("rank").cast("long"))


@query(_SEARCH_SQL + "SELECT target, candidate, policy, rate, error FROM policy QUALIFY row_number() OVER (PARTITION BY target ORDER BY error, policy) = 1")
def search_policy(spark, sf_dir):
    """The best policy for the winner of each target."""
    return _searched(spark, sf_dir)[2]().drop("rank")


# ---------------------------------------------------------------- sessions of a stream
_GAP, _LATE, _SLICES = 6 * 3600, 3600, 3


@query(
    f"WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_id, value FROM events WHERE value IS NOT NULL), s AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) <= {_GAP * 1000} THEN 0 ELSE 1 END AS fresh FROM e), "
    "n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS no FROM s), "
    "g AS (SELECT user_id, min(ms) AS begin_ms, max(ms) AS end_ms, count(*) AS records, round(sum(value), 4) AS total, max({'m': ms, 'e': event_id}).e AS last_order, arg_max(value, {'m': ms, 'e': event_id}) AS last_value FROM n GROUP BY user_id, no) "
    f"SELECT * FROM g WHERE end_ms + {_GAP * 1000} <= (SELECT max(ms) FROM e) - {_LATE * 1000}"
)
def stream_sessions(spark, sf_dir):
    """Sessions of each user, closed by timers; the log arrives in three parts, the stream is restarted for each from its checkpoint."""
    e = table(spark, sf_dir, "events").select("user_id", c("ts").cast("timestamp").alias("ts"), "event_id", "value")
    work = Workspace(spark, "sessions")
    first, last = e.agg(F.min(F.unix_millis("ts")), F.max(F.unix_millis("ts"))).first()
    slot = F.least(F.lit(_SLICES - 1), F.floor((F.unix_millis("ts") - F.lit(first)) * _SLICES / F.lit(max(1, last - first))))
    source = records.record_stream(spark, f"{work.root}/log/*", e.schema, "parquet")
    closed = sessions.closed_sessions(source, "user_id", "ts", "event_id", "value", str(_GAP), str(_LATE))
    for i in range(_SLICES):
        e.where(slot == i).write.parquet(f"{work.root}/log/{i}")
        sessions.run_available(closed, f"{work.root}/closed", f"{work.root}/state")
    out = spark.read.schema(closed.schema).option("basePath", f"{work.root}/closed").parquet(f"{work.root}/closed")
    return out.select(*[n for n in closed.columns if n != "total"], F.round("total", 4).alias("total"))
