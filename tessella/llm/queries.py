"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import centroids, decontamination, language_id, license_scan, mixing, near_dedup, packing, range_join, secret_scan, sharding, url_filter, vp_search, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(_table(spark, sf_dir, "documents"))


def op3_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = language_id.held_out("doc_id")
    return language_id.identify(docs, docs.where(~held), keep={"doc_id": F.col("doc_id"), "held_out": held})


def op5_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op6_concat_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32")
    )
    placed = sharding.assign_shards(rows, "source", ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op9_vantage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_search.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_range_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join.classes(_table(spark, sf_dir, "embeddings"), 0.9)


def op11_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_prefix_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_digests, op2_secret_ownership, op3_minhash_classes, op4_language_mixture, op5_path_templates, op6_concat_pack, op7_interleaved_shards, op8_block_mix, op9_vantage_search, op10_range_classes, op11_tiled_whitening, op12_prefix_containment, op13_annulus_clusters)
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NEAR_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
linked AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, linked.b FROM reach JOIN linked ON linked.a = reach.r),
comp AS (SELECT v AS doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN comp USING (doc_id)"""
_RANGE_SQL = """
WITH RECURSIVE ok AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
linked AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS v, vec_id AS r FROM embeddings UNION SELECT reach.v, linked.b FROM reach JOIN linked ON linked.a = reach.r),
comp AS (SELECT v AS vec_id, min(r) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM linked GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)"""
_SEARCH_SQL = """
WITH fine AS (SELECT row_number() OVER () AS n, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
ok AS (SELECT * FROM fine WHERE len(e) = (SELECT len(e) FROM fine GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)),
pairs AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM ok q JOIN ok c ON q.n <> c.n WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= 20"""
_PARTS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CONTAINED_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_PARTS} AS w FROM documents),
i AS (SELECT item_id, {_PARTS} AS w, least(len({_PARTS}), 10) AS l FROM benchmark),
iw AS (SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS s FROM i WHERE l > 0)),
g AS (SELECT r, l, s, array_to_string(w[s:s + l - 1], ' ') AS x FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
h AS (SELECT r, s, l, item_id FROM g JOIN iw USING (l, x)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + l)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)"""


def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """Every round as tables of its own: all distances, the nearest, and the means."""
    nearest = "SELECT v.r, v.vec_id, v.x, c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - m.x[i]) * (v.x[i] - m.x[i]))) AS d FROM kept v, m{n} m QUALIFY row_number() OVER (PARTITION BY v.r ORDER BY d, c) = 1"
    mean = "SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (SELECT c, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(range(1, 65)) AS i, unnest(x) AS v FROM a{n}) GROUP BY c, i) GROUP BY c"
    parts = [
        "fine AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        "kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(e, lambda v: CAST(floor(256 * v) AS BIGINT)) AS x FROM fine)",
        f"m0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM kept WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k}))",
    ]
    for n in range(rounds):
        parts += [f"a{n} AS MATERIALIZED ({nearest.format(n=n)})", f"m{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(q.x, o.x) AS x FROM m{n} o LEFT JOIN ({mean.format(n=n)}) q USING (c))"]
    parts.append(f"a AS MATERIALIZED ({nearest.format(n=rounds)})")
    return f"WITH {', '.join(parts)} SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256 FROM a JOIN m{rounds} m ON m.c = a.c"


ORACLE: dict[str, str] = {"op1_license_digests": license_scan.oracle_sql(), "op3_minhash_classes": _NEAR_SQL, "op9_vantage_search": _SEARCH_SQL, "op10_range_classes": _RANGE_SQL, "op12_prefix_containment": _CONTAINED_SQL, "op13_annulus_clusters": _clusters_sql()}
