"""Mixing sources to target weights by fixed-length blocks, with DataFrame functions only.

The words of each source, its documents laid end to end in a seeded order, are
cut into blocks of fixed length. The mix is a line of slots cut into output
shards. Every slot draws its source by a seeded hash with the target weights, so
the source counts of a shard are a multinomial draw. Over all shards a source is
then drawn a little more or less often than its target asks, by about the square
root of the number of its slots. This is corrected: of a source drawn too often,
slots at even distances along the line go over to the sources drawn too rarely.
Counts of a shard are thus multinomial but for its share of these few slots, and
totals are exact. The k-th slot of a source takes the block that a keyed
permutation of the source's block numbers gives for k, and slots and blocks are
joined by block number.

There may be any number of sources. Their order, the level of their targets and
their places on the line that slots draw from are running sums in ranges; a slot
meets its source as the last one that begins at or before its point, by an as-of
join; and a source with a large share of all slots is joined apart from the rest.
The driver learns totals only.

Nulls and odd cases: a null text has size 0 and is never taken; a null source is
a source of its own, last in the order; a source without words has target 0;
repeated rows are separate documents; an empty table gives no row. Only the
named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WORD, as_row, bucket_bits, group_key, hash_bucket, hot_join, permuted, running_sum
from tessella.operators import ranges
from tessella.operators.asof import asof_join
from tessella.workspace import Workspace

#: Slots that one task makes.
CHUNK = 1 << 18


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), limit: float = 3.0) -> DataFrame:
    """Adds no (place in the order of sources), weight and target to one row per source (g, source, source_size).

    The targets share the sum of all sizes by weight; none is above ``limit``
    times its source's size, and what is cut off is shared out again by weight.
    The fixed point is least(limit * size, weight * level) with one level for
    all; sources in the order of limit * size / weight are cut off as long as
    that ratio is below the level that the others would then have.
    """
    by_name = sizes.withColumn("_null", F.col("source").isNull()).withColumn("_one", F.lit(1).cast("long"))
    placed = ranges.running(by_name, {"no": ("sum", "_one")}, ["_null", "source"], inclusive=False).drop("_one")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = placed.withColumn("weight", F.element_at(cycle, (F.pmod("no", F.lit(len(weights))) + 1).cast("int")))
    weighed = weighed.withColumn("_cap", F.col("source_size") * F.lit(float(limit))).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    size, weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    before = ranges.running(weighed, {"_cut": ("sum", "_cap"), "_used": ("sum", "weight")}, ["_ratio", "_null", "source"], inclusive=False)
    levelled = before.withColumn("_level", (F.lit(float(size or 0)) - F.col("_cut")) / (F.lit(weight or 0.0) - F.col("_used")))
    free = F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_null", "source", "_level"))
    last = levelled.agg(F.min(free)).first()[0]
    level = F.lit(last["_level"] if last else 0.0)
    return levelled.withColumn("target", F.least("_cap", F.col("weight") * level)).select(*sizes.columns, "no", "weight", "target")


def draws(spark, sized: DataFrame, total: int, seed: int) -> DataFrame:
    """id and no for ``total`` slots: each draws the source in whose stretch of the line of all slots its point lies."""
    starts = ranges.running(sized.where("slots > 0").select("no", "slots"), {"point": ("sum", "slots")}, ["no"], inclusive=False).select("point", "no")
    line = spark.range(0, total, 1, max(-(-total // CHUNK), spark.sparkContext.defaultParallelism))
    point = F.pmod(F.xxhash64(F.lit(seed), F.lit("point"), "id"), F.lit(max(1, total)))
    return asof_join(line.withColumn("point", point), starts, "point", "no").select("id", F.col("match.no").alias("no"))


def _slots(spark, sized: DataFrame, shard_slots: int, seed: int, work: Workspace) -> DataFrame:
    """id and i (its number among the slots of its source) of every slot with the columns of its source; sized has no and slots."""
    total = sized.agg(F.sum("slots")).first()[0] or 0
    drawn = work.save(draws(spark, sized, total, seed).withColumn("shard", F.expr(f"id div {shard_slots}")), "draws")
    counts = drawn.groupBy("no", "shard").agg(F.count("*").alias("n")).withColumn("b", F.expr("shard div 1024"))
    starts = running_sum(counts, "no", "b", ["shard"], F.col("n"), "before").select("no", "shard", "before")
    place = F.row_number().over(Window.partitionBy("shard", "no").orderBy("id")) - 1
    numbered = drawn.withColumn("place", place).join(starts, ["no", "shard"]).select("id", "no", (F.col("before") + F.col("place")).alias("i"))
    numbered = work.save(numbered, "numbered")
    per_source = work.save(counts.groupBy("no").agg(F.sum("n").alias("n")), "drawn-of-source")
    had, none = F.coalesce("n", F.lit(0).cast("long")), F.lit(0).cast("long")
    drift = sized.join(per_source, "no", "left").withColumn("had", had).drop("n")
    drift = drift.withColumn("extra", F.greatest(none, F.col("had") - F.col("slots"))).withColumn("lacks", F.greatest(none, F.col("slots") - F.col("had")))
    drift = ranges.running(drift, {"at": ("sum", "extra"), "short_at": ("sum", "lacks")}, ["no"], inclusive=False)
    lacking = drift.agg(F.sum("lacks")).first()[0] or 0
    # the j-th slot given up lies at even distances along the slots of its source
    split = hot_join(numbered, drift, ["no"], total, "inner", counts=per_source)
    split = split.withColumn("gone", F.expr("(i * extra) div had")).withColumn("goes", F.expr("((i + 1) * extra) div had > gone"))
    stay = split.where("not goes").withColumn("i", F.col("i") - F.col("gone"))
    given = split.where("goes").select("id", (F.col("at") + F.col("gone")).alias("j"))
    pieces = drift.where("lacks > 0").withColumn("c", F.explode(F.sequence(none, F.expr("(lacks - 1) div 4096")))).repartition(max(1, -(-lacking // 4096)), "no", "c")
    filled = pieces.withColumn("m", F.explode(F.sequence(F.col("c") * 4096, F.least(F.col("lacks"), (F.col("c") + 1) * 4096) - 1)))
    filled = filled.withColumn("j", F.col("short_at") + F.col("m")).withColumn("i", F.col("had") + F.col("m"))
    columns = ["id", "i", *sized.columns]
    return stay.select(*columns).unionByName(given.join(filled, "j").select(*columns))


class Mix:
    """The tables of one mix; see the module's text.

    sources: g, source, source_size, no, weight, target
    documents: doc_id, source, size, text_md5, g and first (words of the source before it)
    slots: shard, slot, g, epoch, block, block_size, take (words used of the block)
    pieces: g, block, first, at (place in the block), start (word of the document), length
    """

    def __init__(self, df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), limit: float = 3.0, block: int = 512, shard_slots: int = 4096, seed: int = 23):
        self.work = work = Workspace(df.sparkSession, "mixing")
        slim = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_md5"))
        hashed = slim.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_md5")).withColumn("g", group_key("source"))
        rows = work.save(hashed, "sizes")
        sizes = work.save(rows.groupBy("g", "source").agg(F.sum("size").alias("source_size")), "source-sizes")
        self.sources = sources = work.save(targets(sizes, weights, limit), "sources")
        bits = bucket_bits(rows.count())
        placed = running_sum(rows.withColumn("b", hash_bucket("h", bits)), "g", "b", ["h", "doc_id", "text_md5"], F.col("size"), "first")
        self.documents = work.save(placed.drop("h", "b"), "documents")
        sized = (
            sources.where(F.col("source_size") > 0)
            .withColumn("wanted", F.floor(F.col("target")))
            .withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
            .withColumn("epochs", F.expr("wanted div source_size"))
            .withColumn("rest", F.expr("wanted - epochs * source_size"))
            .withColumn("tail", F.col("source_size") - (F.col("blocks") - 1) * block)
            # one slot more than the rest needs, for the short last block may be among them
            .withColumn("slots", F.col("epochs") * F.col("blocks") + F.when(F.col("rest") > 0, F.least(F.col("blocks"), F.expr(f"(rest + {block - 1}) div {block}") + 1)).otherwise(0))
        )
        sized = work.save(sized.drop("weight", "target"), "sized")
        drawn = (
            _slots(df.sparkSession, sized, shard_slots, seed, work)
            .withColumn("epoch", F.expr("i div blocks")).withColumn("k", F.expr("i % blocks"))
            .withColumn("block", permuted(F.col("k"), F.col("blocks"), F.xxhash64(F.lit(seed), "g", "epoch")))
            .withColumn("block_size", F.when(F.col("block") == F.col("blocks") - 1, F.col("tail")).otherwise(F.lit(block)))
            .withColumn("shard", F.expr(f"id div {shard_slots}")).withColumn("slot", F.expr(f"id % {shard_slots}"))
        )
        drawn = work.save(drawn.select("g", "epoch", "epochs", "k", "block", "block_size", "rest", "shard", "slot"), "drawn")
        # the rest is taken in the order of k; only the short block shifts the words before a slot
        short = drawn.where((F.col("epoch") == F.col("epochs")) & (F.col("block_size") < block)).groupBy("g").agg(F.min("k").alias("short_k"), F.min("block_size").alias("short_size"))
        gone = F.col("k") * block - F.when(F.col("k") > F.col("short_k"), block - F.col("short_size")).otherwise(0)
        left = F.greatest(F.lit(0), F.col("rest") - gone)
        take = F.when(F.col("epoch") < F.col("epochs"), F.col("block_size")).otherwise(F.least(F.col("block_size"), left))
        slots = drawn.join(short, "g", "left").withColumn("take", take.cast("long")).where("take > 0")
        self.slots = slots.select("shard", "slot", "g", "epoch", "block", "block_size", "take")
        cut = self.documents.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"(first + size - 1) div {block}"))))
        begin, end = F.greatest(F.col("first"), F.col("block") * block), F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block)
        self.pieces = cut.select("g", "block", "first", (begin - F.col("block") * block).alias("at"), (begin - F.col("first")).alias("start"), (end - begin).alias("length"))

    def taken(self) -> DataFrame:
        """Pieces joined to the slots that take them: shard, slot, epoch, g, first, at, start, length (words taken)."""
        joined = self.pieces.join(self.slots, ["g", "block"])
        length = F.least(F.col("length"), F.col("take") - F.col("at"))
        return joined.withColumn("length", length).where("length > 0").select("shard", "slot", "epoch", "g", "first", "at", "start", "length")

    def per_document(self) -> DataFrame:
        """Every document with its source's size and target and the words that the mix takes of it."""
        words = self.taken().groupBy("g", "first").agg(F.sum("length").alias("taken"), F.lit(True).alias("sized"))
        documents = self.documents.join(self.sources.select("g", "source_size", "target"), "g")
        whole = documents.withColumn("sized", F.col("size") > 0)
        return whole.join(words, ["g", "first", "sized"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).drop("sized")

    def texts(self, df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
        """The mixed text itself: the columns of ``df``, one row for each piece taken.

        Pieces of one document that follow each other within an epoch are one
        row. A piece keeps the white space that follows its words. n_chars, if
        there, is set to the new length.
        """
        pieces = self.taken().groupBy("g", "first", "epoch").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("p"))
        # neighbours meet exactly, so a piece begins a run if none ends where it starts
        ends = F.transform("p", lambda x: x["start"] + x["length"])
        starts = F.transform("p", lambda x: x["start"])
        runs = F.arrays_zip(F.array_except(starts, ends).alias("a"), F.array_except(ends, starts).alias("z"))
        per_doc = pieces.select("g", "first", F.explode(runs).alias("r")).select("g", "first", "r.a", "r.z").groupBy("g", "first").agg(F.collect_list(F.struct("a", "z")).alias("runs"))
        again = ["doc_id", "text_md5", "g"]
        number = F.row_number().over(Window.partitionBy(*again).orderBy("first"))
        chosen = self.documents.where("size > 0").withColumn("nth", number).join(per_doc, ["g", "first"])
        chosen = chosen.select(F.col("doc_id").alias("own_id"), "text_md5", "g", "nth", F.col("size").alias("words"), "runs")
        here = df.where(word_count(text) > 0).select(as_row(df).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.md5(F.col(text).cast("binary")).alias("text_md5"), group_key(source).alias("g"))
        here = here.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "text_md5", "g").orderBy(F.lit(0))))
        rows = here.join(chosen, ["text_md5", "g", "nth"]).where(F.col("doc_id").eqNullSafe(F.col("own_id")))
        cut = rows.withColumn("run", F.explode("runs"))
        found = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), 1)
        part = F.array_join(F.slice(found, (F.col("run.a") + 1).cast("int"), (F.col("run.z") - F.col("run.a")).cast("int")), "")
        out = cut.withColumn("new", F.when(F.col("run.z") - F.col("run.a") == F.col("words"), F.col("text")).otherwise(part))
        fresh = {text: F.col("new")}
        if "n_chars" in df.columns:
            fresh["n_chars"] = F.length("new").cast(df.schema["n_chars"].dataType)
        return out.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in df.columns])


def mix_sources(df: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of ``df``; options as of Mix."""
    return Mix(df, **options).per_document().select("doc_id", "size", "source_size", "target", "taken")
