"""Similarity in tiles, staged searches that carry on, and sessions as state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import reports, staged_search
from tessella.plans import range_catalog
from tessella.streaming import records, sessions

SF = "/root/testdata/sf0.001"


def pair_rows(name, h, w, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 256, (h, w, 3))
    b = np.clip(a + rng.integers(-40, 41, (h, w, 3)), 0, 255)
    return [(name, y, x, *map(int, a[y, x]), *map(int, b[y, x])) for y in range(h) for x in range(w)], a, b


def one_ssim(a, b):
    k = np.exp(-((np.arange(11) - 5) ** 2) / 4.5)
    k = np.outer(k, k) / k.sum() ** 2
    a, b = (v @ [0.2126, 0.7152, 0.0722] for v in (a, b))
    windows = lambda v: np.einsum("yxij,ij->yx", np.lib.stride_tricks.sliding_window_view(v, (11, 11)), k)
    ma, mb = windows(a), windows(b)
    va, vb, cov = windows(a * a) - ma**2, windows(b * b) - mb**2, windows(a * b) - ma * mb
    return ((2 * ma * mb + 6.5025) * (2 * cov + 58.5225) / ((ma**2 + mb**2 + 6.5025) * (va + vb + 58.5225))).mean()


@pytest.mark.parametrize("tile", [1, 7, 64])
def test_similarity_by_tiles(spark, tile):
    sizes = {"wide": (12, 33), "tall": (29, 11), "small": (10, 40)} if tile > 1 else {"tall": (13, 12), "small": (4, 4)}
    rows, want = [], {}
    for i, (name, (h, w)) in enumerate(sizes.items()):
        more, a, b = pair_rows(name, h, w, i)
        rows += more
        want[name] = one_ssim(a, b) if min(h, w) >= 11 else None
    df = spark.createDataFrame(rows, "image_id string, y long, x long, r int, g int, b int, r2 int, g2 int, b2 int").repartition(3)
    got = {r["image_id"]: r["ssim"] for r in reports.ssim(df, tile=tile).collect()}
    assert got.keys() == want.keys() and all(got[k] is None if v is None else abs(got[k] - v) < 1e-4 for k, v in want.items())


def test_an_image_with_a_hole_is_refused(spark):
    rows, _, _ = pair_rows("a", 12, 12, 1)
    with pytest.raises(Exception, match="without some of its pixels"):
        reports.ssim(spark.createDataFrame(rows[:50] + rows[51:], "image_id string, y long, x long, r int, g int, b int, r2 int, g2 int, b2 int")).collect()


def test_a_stage_carries_on_after_a_stop(spark, tmp_path):
    work = spark.createDataFrame([(i, i % 5) for i in range(200)] + [(None, 7), (3, 3)], "candidate long, n int")
    calls = []

    def score(rows, stop=None):
        calls.append(rows)
        if stop is not None and len(calls) > stop:
            raise RuntimeError("stopped")
        return rows.withColumn("error", F.coalesce(F.col("candidate"), F.lit(-1)) * 7919 % 101)

    with pytest.raises(RuntimeError):
        staged_search.Stages(spark, str(tmp_path)).scored("a", work, ["candidate"], lambda rows: score(rows, 3))
    stored = spark.read.parquet(f"{tmp_path}/a").count()
    assert 0 < stored < 201
    calls.clear()
    out = staged_search.Stages(spark, str(tmp_path)).scored("a", work, ["candidate"], score).collect()
    assert sorted((r["candidate"] is None, r["candidate"] or 0, r["error"]) for r in out) == sorted((i is None, i or 0, (-1 if i is None else i) * 7919 % 101 if i is not None else -7919 % 101 - 101) for i in [*range(200), None])
    assert sum(rows.count() for rows in calls[1:]) == 201 - stored
    calls.clear()
    assert staged_search.Stages(spark, str(tmp_path)).scored("a", work, ["candidate"], score).count() == 201 and len(calls) == 1


def test_a_stopped_search_gives_the_same_rows(spark, tmp_path, monkeypatch):
    whole = [sorted(map(tuple, f(spark, SF).collect())) for f in (range_catalog.search_screen, range_catalog.search_validate, range_catalog.search_policy)]
    real, seen = staged_search.Stages.scored, []

    def stopping(self, name, work, keys, score, slices=4):
        def scored(rows):
            seen.append(name)
            if len(seen) in (4, 9, 13):
                raise RuntimeError("stopped")
            return score(rows)

        return real(self, name, work, keys, scored, slices)

    monkeypatch.setattr(staged_search.Stages, "scored", stopping)
    for _ in range(6):
        try:
            screen, validate, policy = range_catalog._searched(spark, SF, str(tmp_path))
            got = [sorted(map(tuple, d.collect())) for d in (screen, validate, policy().drop("rank"))]
        except RuntimeError:
            continue
        break
    assert got == whole and len(seen) > 13 and all(whole)


def brute_sessions(rows, gap, until):
    out = set()
    for u in {r[0] for r in rows}:
        mine, groups = sorted((r for r in rows if r[0] == u), key=lambda r: r[1:3]), []
        for r in mine:
            if groups and r[1] - groups[-1][-1][1] <= gap:
                groups[-1].append(r)
            else:
                groups.append([r])
        out |= {(u, g[0][1], g[-1][1], len(g), round(sum(r[3] for r in g), 6), g[-1][2], g[-1][3]) for g in groups if g[-1][1] + gap <= until}
    return out


def test_sessions_merge_out_of_order_and_across_restarts(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(u), int(t), i, float(v)) for i, (u, t, v) in enumerate(zip(rng.integers(0, 7, 300), rng.integers(0, 400_000, 300), rng.integers(1, 9, 300), strict=True))]
    frame = lambda some: spark.createDataFrame(some, "user_id long, ms long, event_id long, value double").select("user_id", F.timestamp_millis("ms").alias("ts"), "event_id", "value")
    order = sorted(rows, key=lambda r: r[1] + int(rng.integers(0, 40_000)))  # out of order by less than the lateness allowed
    source = records.record_stream(spark, f"{tmp_path}/log/*", frame(rows[:1]).schema, "parquet")
    closed = sessions.closed_sessions(source, "user_id", "ts", "event_id", "value", "5", "60")
    conf = spark.conf.get(sessions.STORE[0], None)
    for i in range(4):
        part = order[i * 75 : (i + 1) * 75] + ([(0, 1, 999, 1.0)] if i == 3 else []) + [(None, r[1], 0, 1.0) for r in order[i * 75 :][:1]]  # one far too late, one without a key
        frame(part).coalesce(1).write.parquet(f"{tmp_path}/log/{i}")
        sessions.run_available(closed, f"{tmp_path}/closed", f"{tmp_path}/state")
    got = [(r["user_id"], r["begin_ms"], r["end_ms"], r["records"], round(r["total"], 6), r["last_order"], r["last_value"]) for r in spark.read.schema(closed.schema).option("basePath", f"{tmp_path}/closed").parquet(f"{tmp_path}/closed").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_sessions(rows, 5000, max(r[1] for r in rows) - 60_000) and len(got) > 100
    assert spark.conf.get(sessions.STORE[0], None) == conf
