"""Running values, skylines, sweeps, as-of joins and quantiles in ranges, against brute force over many ranges."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import asof, order_statistics, prefix, ranges, transform


@pytest.fixture(autouse=True)
def many_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(n, seed):
    rng = np.random.default_rng(seed)
    keys = [None, "a", "b", "c"]
    return [(keys[0 if i % 50 == 0 else 1 + min(2, int(rng.exponential(0.5)))], int(rng.integers(0, 30)), i, None if rng.random() < 0.2 else int(rng.integers(-9, 10))) for i in range(n)]


def test_running_values_by_brute_force(spark):
    data = rows(600, 1)
    df = spark.createDataFrame(data, "k string, t int, i int, v int").repartition(5)
    for inclusive in (True, False):
        out = ranges.running(df, {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "last": ("last", "v")}, ["t", "i"], "k", inclusive=inclusive).collect()
        want = set()
        for k in {r[0] for r in data}:
            group = sorted((r for r in data if r[0] == k), key=lambda r: r[1:3])
            for at, r in enumerate(group):
                seen = [x[3] for x in group[: at + inclusive] if x[3] is not None]
                want.add((*r, sum(seen), min(seen, default=None), max(seen, default=None), seen[-1] if seen else None))
        assert {tuple(r) for r in out} == want and len(out) == len(data)


def test_a_large_group_spreads_over_ranges(spark):
    df = spark.range(7000).select(F.lit("one").alias("k"), F.col("id").alias("t"))
    stored = ranges.in_ranges(df, ["t"], "k")
    sizes = [r["count"] for r in stored.groupBy("_range").count().collect()]
    assert len(sizes) == 7 and max(sizes) < 3000
    text = ranges.running(df, {"n": ("sum", "t")}, ["t"])._jdf.queryExecution().executedPlan().toString()
    alone = [i for i, line in enumerate(text.splitlines()) if "SinglePartition" in line]
    assert len(alone) == 1 and "HashAggregate(keys=[_range" in text.splitlines()[alone[0] + 1]  # one row a range


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, t int, i int, v int")
    assert ranges.running(df, {"s": ("sum", "v")}, ["t"], "k").count() == 0 and prefix.undominated(df, "t", "v").count() == 0 and prefix.rate_curve(df, "t", "v", "k").count() == 0
    assert asof.asof_join(df, df, "t", "i", "k").count() == 0 and order_statistics.quantiles(df, "v", {"m": 0.5}, "k").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_skyline_by_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    data = [(i, int(a), int(a * 0 + b)) for i, (a, b) in enumerate(zip(rng.integers(0, 60, 400), rng.integers(0, 60, 400), strict=True))]
    data = [(i, a, max(0, b - a // 2) if seed == 2 else b) for i, a, b in data] + [(900, None, 0), (901, 0, None), (902, data[0][1], data[0][2])]
    got = {r["i"] for r in prefix.undominated(spark.createDataFrame(data, "i int, cost int, error int").repartition(4), "cost", "error").collect()}
    fine = [r for r in data if r[1] is not None and r[2] is not None]
    want = {r[0] for r in fine if not any(q[1] <= r[1] and q[2] <= r[2] and q[1:] != r[1:] for q in fine)}
    assert got == want


def test_rate_curve_by_brute_force(spark):
    rng = np.random.default_rng(5)
    data = [(["a", "b", None][i % 3 if i < 60 else 0], float(rng.integers(0, 40)), float(rng.integers(0, 90))) for i in range(500)] + [("a", -1.0, 500.0), ("a", 3.0, None)]
    got = collections.Counter(map(tuple, prefix.rate_curve(spark.createDataFrame(data, "k string, rate double, q double").repartition(6), "rate", "q", "k").collect()))
    want = set()
    for k in ("a", "b", None):
        best = -math.inf
        for r in sorted(r for r in data if r[0] == k and r[1] > 0 and r[2] is not None):
            if r[2] > best:
                best = r[2]
                want.add(r)
    assert got == collections.Counter(want)


def test_ranges_are_thinned_before_they_are_ordered(spark):
    rows = spark.range(4000).select((F.col("id") % 3).alias("k"), (F.col("id") + 1).alias("rate"), (F.col("id") * 7919 % 4001).alias("q"))
    plan = prefix.rate_curve(rows, "rate", "q", "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window [max(q") < plan.index("Join Inner")


def test_sweep_in_ranges_is_the_sweep_in_one(spark):
    rng = np.random.default_rng(6)
    data = [(q, u, *(int(v) for v in rng.integers(1, 60, 4))) for q in (1, 2) for u in range(300 if q == 1 else 9)]
    got = {(r["quality"], r["step"]): tuple(r)[2:7] for r in transform.sweep(spark.createDataFrame(data, "quality int, unit long, bits0 long, sse0 long, bits1 long, sse1 long").repartition(3), 96, "quality").collect()}
    want = {}
    for q in (1, 2):
        mode = {u: int((s1, b1) < (s0, b0)) for k, u, b0, s0, b1, s1 in data if k == q}
        now = {u: ((b0, s0), (b1, s1)) for k, u, b0, s0, b1, s1 in data if k == q}
        moves = sorted(((now[u][1 - m][1] - now[u][m][1]) / (now[u][m][0] - now[u][1 - m][0]), u) for u, m in mode.items() if now[u][m][0] > now[u][1 - m][0] and now[u][1 - m][1] > now[u][m][1])
        for step in range(len(moves) + 1):
            if step:
                mode[moves[step - 1][1]] ^= 1
            want[q, step] = (sum(now[u][m][1] for u, m in mode.items()), *(sum(now[u][m][0] for u, m in mode.items() if m == side) for side in (0, 1)), *(sum(m == side for m in mode.values()) for side in (0, 1)))
    assert got == want


def test_sweep_of_repeated_units_does_not_depend_on_their_order(spark):
    data = [(1, u, 50 + k, 10, 50, 10 + 2 * k) for u in (1, 2) for k in range(1, 30)] + [(1, 2, 40, 10 + 2 * k, 40 + k, 10) for k in range(1, 9)]
    states = lambda rows: sorted(map(tuple, transform.sweep(spark.createDataFrame(rows, "quality int, unit long, bits0 long, sse0 long, bits1 long, sse1 long").coalesce(1), 96, "quality").collect()))
    first = states(data)
    assert first == states(data[::-1]) == states(data[::3] + data[1::3] + data[2::3]) and len(first) == len(data) + 1


@pytest.mark.parametrize("forward", [False, True])
def test_asof_by_brute_force(spark, forward):
    rng = np.random.default_rng(7)
    key = lambda: [None, "a", "a", "a", "b"][rng.integers(0, 5)]
    left = [(i, key(), None if rng.random() < 0.05 else int(rng.integers(0, 50))) for i in range(300)] + [(5, "a", 3), (5, "a", 3)]
    right = [(key(), None if rng.random() < 0.05 else int(rng.integers(0, 50)), j, f"v{j}") for j in range(60)]
    a, b = spark.createDataFrame(left, "i int, k string, t int").repartition(3), spark.createDataFrame(right, "k string, t int, j int, v string").repartition(3)
    for within in (None, 4):
        got = collections.Counter((r["i"], r["k"], r["t"], r["match"] and tuple(r["match"])) for r in asof.asof_join(a, b, "t", "j", "k", within=within, forward=forward).collect())
        want = collections.Counter()
        for i, k, t in left:
            fit = [] if k is None or t is None else [r for r in right if r[0] == k and r[1] is not None and (r[1] >= t if forward else r[1] <= t)]
            best = (min if forward else max)(fit, key=lambda r: r[1:3], default=None)
            want[i, k, t, best[1:] if best and (within is None or abs(best[1] - t) <= within) else None] += 1
        assert got == want


@pytest.mark.parametrize("few,parts", [(1, 2), (5, 3), (20_000, 1024)])
def test_quantiles_by_brute_force(spark, few, parts):
    rng = np.random.default_rng(few)
    data = [("long", float(v)) for v in np.exp(rng.normal(size=400) * 6)] + [("same", 3.0)] * 90 + [("tied", float(v)) for v in rng.integers(0, 4, 200)] + [("one", -7.5), (None, 1.0), (None, 2.0), ("none", None), ("nan", float("nan")), ("one", float("nan"))]
    shares = {"least": 0.0, "median": 0.5, "p95": 0.95, "most": 1.0}
    df = spark.createDataFrame(data, "k string, v double").repartition(4)
    got = {r["k"]: r for r in order_statistics.quantiles(df, "v", shares, "k", few=few, parts=parts).collect()}
    groups = collections.defaultdict(list)
    for k, v in data:
        if v is not None and v == v:
            groups[k].append(v)
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        assert got[k]["n"] == len(values)
        for name, share in shares.items():
            assert got[k][name] == pytest.approx(float(np.quantile(values, share)), rel=1e-12)
    whole = order_statistics.quantiles(df, "v", {"m": 0.25}, few=few, parts=parts).collect()
    assert len(whole) == 1 and whole[0]["m"] == pytest.approx(np.quantile([v for g in groups.values() for v in g], 0.25))
