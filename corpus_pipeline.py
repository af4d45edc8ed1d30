"""A corpus pipeline: language, near duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
has kept. All but the last return the columns of documents.

Nulls and odd cases: a null or empty text, or one without a letter, has no
language and goes in the first stage, so the later ones see texts only, but they
take such rows too: they are no one's copy, hold no secret, give no words to the
mixture and are packed as their end token. Rows with null ids stay apart from
each other; of rows equal in id and text one stays. A null lang is filled in, a
null source is a source of its own, and a null n_chars of a text is counted.
Extra columns of any name pass through up to the mixture. Texts of any length
are read whole. An empty table gives no row in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import language_id, mixing, near_dedup, packing, secret_scan
from tessella.workspace import Workspace, released

#: A document without letters, or whose main language has a smaller share than this, is rejected as having no language of its own.
LEAST_SHARE = 1 / 3
#: A document is rejected as well if the learned languages explain a smaller share of its letters than this.
LEAST_EXPLAINED = 1 / 2


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; a null lang is filled with the predicted one."""
    train = docs.where(~language_id.held_out("doc_id"))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    judged = language_id.identify(docs, train, keep={"row": rest}, keep_text=True, explained=True)
    kept = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE) & (F.col("explained") >= LEAST_EXPLAINED))
    fresh = {"text": F.col("_text"), "lang": F.coalesce("row.lang", "lang_pred")}
    return kept.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with a marker in place of each secret found in its text."""
    cleaned = secret_scan.redacted(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that the mix takes, repeats included."""
    return mixing.Mix(docs).texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, with their token ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("language", by_language),
    ("near duplicates", without_copies),
    ("secrets", without_secrets),
    ("mixture", mixed),
    ("packing", packed),
]

#: SQL expresses neither the models nor the hashes of these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with released():  # a stage's scratch tables go once its result is written
            docs = work.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
