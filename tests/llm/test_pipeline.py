"""The pipeline's stages, each on its own input."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tessella.llm import near_dedup, secret_scan  # noqa: E402
from tessella.workspace import Workspace  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    work, docs, out = Workspace(spark, "test"), spark.read.parquet(f"{SF}/documents.parquet"), [("input", None)]
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = work.save(stage(spark, docs, SF), name.replace(" ", "-"))
        out.append(docs)
    return out


def test_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_language_keeps_clean_documents(stages):
    assert stages[1].count() == stages[0].count()


def test_language_rejects_what_no_language_explains(spark, stages):
    rng = random.Random(4)
    odd = [(-1, "Ὁ δὲ ἀνὴρ οὗτος ἦλθεν εἰς τὴν πόλιν καὶ εἶδεν πολλοὺς ἀνθρώπους " * 5), (-2, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(8)) for _ in range(60))), (-3, "Это предложение написано на языке, которого нет среди выученных. " * 5)]
    docs = stages[0].unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    kept = {r["doc_id"] for r in corpus_pipeline.by_language(spark, docs, SF).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in stages[0].select("doc_id").collect()}


def test_one_of_each_group_stays(stages):
    kept = {r["doc_id"] for r in near_dedup.near_duplicates(stages[1]).where("kept").collect()}
    assert {r["doc_id"] for r in stages[2].collect()} == kept


def test_no_secret_is_left(stages):
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in stages[2:4])
    assert before.keys() == after.keys()
    for i, text in before.items():
        if secret_scan.find_spans((text or "").encode()):
            assert not secret_scan.find_spans(after[i].encode())
        else:
            assert after[i] == text


def test_mixture_has_as_many_words(stages):
    words = [sum(len((r["text"] or "").encode().split()) for r in d.collect()) for d in stages[3:5]]
    assert words[0] - 20 <= words[1] <= words[0]


def test_packing_is_gapless(stages):
    ends = {}
    for r in sorted(stages[5].select("sequence_id", "offset", "length").collect()):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == 2048 for s, n in ends.items() if s != max(ends))


def test_run_gives_the_same_rows(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[5].count()


def test_odd_rows_and_names_pass_through_every_stage(spark, stages):
    some = [tuple(r) for r in stages[0].orderBy("doc_id").limit(40).collect()]
    text = some[0][1]
    odd = [(1001, None, "en", "a", None), (1002, "", None, "a", 0), (1003, " \n", "en", None, 2), (1004, "12 34", "en", "a", 5), (None, text + " and more of it", None, None, None), (None, text + " and more of it", None, None, None), (1005, text, "en", "b", 1), (1006, text + " token = abcd1234efgh5678 done", "en", "b", 1), (1007, (text + " ") * 300, "en", "b", 1), some[1], some[1]]
    docs = spark.createDataFrame(some + odd, stages[0].schema)
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("row", "score", "md5", "g", "h", "hash", "part", "key", "n", "size", "found", "own_id", "explained", "languages"))])
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        after, none = stage(spark, docs, SF), stage(spark, empty, SF)
        assert none.count() == 0
        if name != "packing":
            assert after.columns == docs.columns and none.columns == docs.columns
            rows = after.collect()
            assert rows and {r["languages"] for r in rows} == {13}
            if name == "language":
                assert not {1001, 1002, 1003, 1004} & {r["doc_id"] for r in rows} and all(r["lang"] for r in rows)
                assert sum(r["doc_id"] is None for r in rows) == 2
            if name == "near duplicates":
                assert len({(r["doc_id"], r["text"]) for r in rows}) == len(rows)
            if name == "secrets":
                assert not any(secret_scan.find_spans(r["text"].encode()) for r in rows)
            docs = Workspace(spark, "test").save(after, "stage")
        else:
            tokens = after.agg(F.sum("length")).first()[0]
            assert tokens > docs.count()
