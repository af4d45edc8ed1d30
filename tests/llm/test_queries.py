"""The registered queries on the test tables: SQL where there is some, columns and sizes for all."""

import collections

import duckdb
import pytest

from tessella.llm import queries

SF = "/root/testdata/sf0.01"
COLUMNS = {
    "op2_secret_ownership": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op3_minhash_classes": "doc_id n_shingles component_id kept",
    "op4_language_mixture": "doc_id held_out lang_pred score",
    "op5_path_templates": "page_id host path rule verdict",
    "op6_concat_pack": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op7_interleaved_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op8_block_mix": "doc_id size source_size target taken",
    "op9_vantage_search": "query_id rank vec_id score",
    "op10_range_classes": "vec_id n_links component_id kept",
    "op11_tiled_whitening": "vec_id component n deviation whitened explained identity_error",
    "op12_prefix_containment": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op13_annulus_clusters": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
}


@pytest.fixture(scope="module")
def results(spark):
    return {name: f(spark, SF).toPandas() for name, f in queries.QUERIES.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(pdf):
    return collections.Counter(tuple(None if v is None or v != v else v for v in r) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_gives_the_same(results, duck, name):
    assert rows(results[name]) == rows(duck.execute(queries.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(results, duck, name):
    assert set(COLUMNS[name].split()) <= set(results[name].columns)
    key = COLUMNS[name].split()[0]
    if key in ("doc_id", "page_id", "vec_id") and name not in ("op6_concat_pack", "op11_tiled_whitening"):
        table = {"doc_id": "documents", "page_id": "pages", "vec_id": "embeddings"}[key]
        ids = collections.Counter(r[0] for r in duck.execute(f"SELECT {key} FROM {table}").fetchall())
        assert collections.Counter(results[name][key]) == ids


def test_held_out_accuracy(results, duck):
    truth = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    held = results["op4_language_mixture"].query("held_out")
    assert len(held) > 100 and sum(truth[i] == p for i, p in zip(held["doc_id"], held["lang_pred"])) >= 0.97 * len(held)


def test_search_finds_the_nearest(results, duck):
    import numpy as np

    ids, x = zip(*duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall())
    x, ids, hit = np.array(x, dtype=np.float64), np.array(ids), 0
    for q, found in results["op9_vantage_search"].groupby("query_id"):
        s = x @ x[np.searchsorted(ids, q)]
        s[ids == q] = -np.inf
        hit += len(set(found["vec_id"]) & set(ids[np.lexsort((ids, -s))[:20]]))
    assert hit >= 0.99 * len(results["op9_vantage_search"])


def test_rules_by_brute_force(results):
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "block", "example.net/de/8": "allow", "org/es/": "block"}
    for r in results["op5_path_templates"].itertuples():
        fit = [k for k in rules if (r.host == k.split("/")[0] or r.host.endswith("." + k.split("/")[0])) and r.path.startswith(k[k.index("/") :])]
        best = max(fit, key=len, default=None)
        assert r.rule == best and (best is None or r.verdict == rules[best])
