"""Benchmark passages in documents, found by a prefix-filtered set join.

An item's windows are ``window`` consecutive words of it, or all its words if it has fewer. A
window occurs in a document only if each of its shingles (``shingle`` consecutive
words, or the whole window if that is shorter) does, so one necessary token, the
prefix, is enough to find it: the shingle that the fewest documents hold. Shingles
are counted over all documents first; a window with a shingle that no document holds
occurs nowhere and goes. Documents then send the places of prefix shingles only,
with the words about them, and meet the windows on the shingle. Place and length
decide whether the window fits into the document there, and the words themselves
are compared. Ranges of hit words are merged for each document.

Words and shingles are hashed in whole batches of bytes; hashes lead to
candidates, never to results. A bit table of bounded size, made from the windows'
shingles, keeps other shingles from leaving the scan; what passes it by chance meets no
window in the join. Neither windows nor documents are broadcast or collected, and
a shingle that many documents share is split by Spark's skew join, as the plan
under it is a plain join.

Nulls and odd cases: a null text, or one without words, has no words and no hit; its row is
returned. An item without words has no window. Items are told apart by id; a null
id is one item, counted, but with no name in ``items_sha256``. Repeated items, and
items of equal words, count as the items they are. Null, repeated and equal
document ids, and repeated rows, are rows of their own. An empty benchmark leaves every
document clean; an empty table gives no row. Texts of any length are hashed in
pieces. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import group_key
from tessella.workspace import Workspace

#: Bits of the table for each shingle, and the most bits that it has (16 MiB, sent to every executor).
BITS_EACH, LEAST_BITS, MOST_BITS = 256, 1 << 20, 1 << 27
#: Bytes of text hashed at once.
PIECE = 1 << 20

_WORD = np.ones(256, dtype=bool)
_WORD[:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = bytes(int(_LOWER[b]) if _WORD[_LOWER[b]] else 32 for b in range(256))
_RANDOM = np.random.default_rng(12).integers(1, 1 << 63, 256 + 16, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> bytes:
    """The text with A-Z lower-cased and a space for each character between words."""
    return text.translate(_BYTES)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(clean: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of every word of a text made by ``words_of``."""
    hashes, begins, ends, at = [], [], [], 0
    while at < len(clean):
        cut = len(clean) if at + PIECE >= len(clean) else clean.rfind(b" ", at, at + PIECE) + 1 or clean.find(b" ", at + PIECE) + 1 or len(clean)
        b = np.frombuffer(clean, dtype=np.uint8, count=cut - at, offset=at)
        word = np.zeros(len(b) + 2, dtype=np.int8)
        word[1:-1] = b != 32
        edge = np.diff(word)
        begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        if len(begin):
            size = end - begin
            inside = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            place = inside - np.repeat(begin, size)
            powers = np.cumprod(np.full(int(size.max()), _BASE))
            starts = np.cumsum(size) - size
            h = np.add.reduceat(_RANDOM[b[inside]] * powers[place], starts)
            hashes.append(_mixed(h))
            begins.append(begin + at)
            ends.append(end + at)
        at = cut
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(begins), np.concatenate(ends)


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each ``size`` consecutive words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(size))
    for i in range(size):
        total = total + h[i : i + n] * _RANDOM[256 + i % 16] * np.uint64(2 * (i // 16) + 1)
    return _mixed(total)


class BitTable:
    """Which shingles are wanted; some others pass by chance."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        passed = np.ones(len(h), dtype=bool)
        for shift in (0, 32):
            at = (h >> np.uint64(shift)) & self.mask
            passed &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return passed

    @staticmethod
    def of(shingles: DataFrame, n: int) -> BitTable:
        """From a column h of ``n`` distinct longs. Spark sets the bits; at most MOST_BITS / 64 longs are fetched."""
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, n * BITS_EACH) - 1).bit_length()))
        at = F.explode(F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(F.lit(bits - 1)) for s in (0, 32)]))
        one = F.expr("shiftleft(1L, cast(at & 63 as int))")
        rows = shingles.select(at.alias("at")).select(F.shiftright("at", 6).cast("int").alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
        words = np.zeros(bits // 64, dtype=np.uint64)
        got = rows.toArrow()
        words[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
        return BitTable(words)


def _item_windows(window: int, shingle: int):
    """Every window of an item once, with its words and the hashes of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                clean = words_of((batch.column(1)[k].as_py() or b""))
                h, _, _ = word_hashes(clean)
                names = clean.split()
                size = min(window, len(names))
                if not size:
                    continue
                grams, step = shingle_hashes(h, min(shingle, size)).view(np.int64), size - min(shingle, size) + 1
                known = {}
                for a in range(len(names) - size + 1):
                    known.setdefault(b" ".join(names[a : a + size]), a)
                texts, at = list(known), list(known.values())
                for a in range(0, len(at), 512):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[k].as_py()] * len(at[a : a + 512]), batch.column(0).type), pa.array(texts[a : a + 512], pa.binary()), pa.array([size] * len(at[a : a + 512]), pa.int32()), pa.array([grams[i : i + step] for i in at[a : a + 512]], pa.list_(pa.int64()))],
                        names=["item_id", "words", "len", "h"],
                    )

    return run


def _holders(table: BitTable, sizes: list[int]):
    """For each shingle that may be wanted, how many of a batch's documents hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0):
                h, _, _ = word_hashes(words_of(text.as_py() or b""))
                for size in sizes:
                    grams = shingle_hashes(h, size)
                    grams = grams[table(grams)]
                    if len(grams):
                        found.append(np.unique(grams))
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return run


def _places(table: BitTable, sizes: list[int], window: int):
    """Every document with its number of words and the places of prefix shingles: their hash, place, and the words about them."""
    place = pa.struct([("h", pa.int64()), ("p", pa.int64()), ("left", pa.int32()), ("about", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, offsets, columns = [], [0], ([], [], [], [])
            for text in batch.column(2):
                clean = words_of(text.as_py() or b"")
                h, begin, end = word_hashes(clean)
                counts.append(len(h))
                for size in sizes:
                    grams = shingle_hashes(h, size)
                    for p in np.nonzero(table(grams))[0].tolist():
                        a, b = max(0, p - window + size), min(len(h), p + window)
                        for column, v in zip(columns, (grams[p], p, p - a, b" ".join(clean[begin[a] : end[b - 1]].split())), strict=True):
                            column.append(v)
                offsets.append(len(columns[0]))
            arrays = [pa.array(np.array(columns[0], dtype=np.uint64).view(np.int64)), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(place)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), lists], names=["row", "doc_id", "n_words", "places"])

    return run


def _hit_words(ranges: DataFrame) -> DataFrame:
    """row, n_hit: the words in any of a document's ranges [a, b), which are no more than it has words."""
    before = Window.partitionBy("row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("b") - F.greatest("a", F.coalesce(F.max("b").over(before), F.lit(0))))
    return ranges.distinct().withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))


def occurrences(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables: documents (row, doc_id, n_words), occurrences (row, a, b, win) and the items of each window (win, item_id).

    ``row`` numbers the documents, [a, b) are words of it, and ``win`` is a digest of
    the window's words.
    """
    work = Workspace(docs.sparkSession, "decontaminate")
    binary = lambda df, i, t: df.select(F.col(i).alias("id"), F.col(t).cast("binary").alias("text"))
    kind = items.schema[item_id].dataType.simpleString()
    each = binary(items, item_id, item_text).repartition(items.sparkSession.sparkContext.defaultParallelism).mapInArrow(_item_windows(window, shingle), f"item_id {kind}, words binary, len int, h array<long>")
    each = work.save(each.withColumn("win", F.sha2("words", 256)), "items")
    windows = work.save(each.groupBy("win").agg(F.first("words").alias("words"), F.first("len").alias("len"), F.first("h").alias("h")), "windows")
    sizes = sorted(r["g"] for r in windows.select(F.least("len", F.lit(shingle)).alias("g")).distinct().collect())  # at most `shingle` rows
    known = work.save(windows.select(F.explode("h").alias("h")).distinct(), "shingles")
    table = BitTable.of(known, known.count())
    held = binary(docs, doc_id, text).select("text").mapInArrow(_holders(table, sizes), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).join(known, "h", "left_semi")
    places = windows.select("win", "len", F.posexplode("h").alias("o", "h")).join(work.save(held, "held"), "h")
    rarest = places.groupBy("win", "len").agg(F.min(F.struct("n", "h", "o")).alias("rarest"), F.count("*").alias("there"))
    able = rarest.where(F.col("there") == F.col("len") - F.least("len", F.lit(shingle)) + 1)  # no shingle of the window is held by none
    prefixes = work.save(able.join(windows.select("win", "words"), "win").select("win", "words", "len", "rarest.h", "rarest.o"), "prefixes")
    chosen = work.save(prefixes.select("h").distinct(), "chosen")
    table = BitTable.of(chosen, chosen.count())
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = binary(docs, doc_id, text).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    read = work.save(rows.mapInArrow(_places(table, sizes, window), f"row long, doc_id {kind}, n_words long, places array<struct<h: long, p: long, left: int, about: binary>>"), "documents")
    found = read.where(F.size("places") > 0).select("row", "n_words", F.inline("places")).join(prefixes, "h")
    start = F.col("p") - F.col("o")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    own = F.array_join(F.slice(F.split(F.col("about").cast("string"), " "), F.greatest(F.lit(1), F.col("left") - F.col("o") + 1), F.col("len")), " ")
    same = F.when(fits, own == F.col("words").cast("string"))
    hits = work.save(found.where(same).select("row", start.alias("a"), (start + F.col("len")).alias("b"), "win"), "hits")
    return read.select("row", "doc_id", "n_words"), hits, each.select("win", "item_id")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every document."""
    rows, hits, members = occurrences(docs, items, window, shingle)
    return summary(rows, hits, members)


def summary(rows: DataFrame, hits: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each document from the tables of ``occurrences``."""
    named = members.select("win", F.col("item_id").cast("string").alias("item")).select("win", group_key("item").alias("key")).distinct()
    held = hits.select("row", "win").distinct().join(named, "win").groupBy("row").agg(F.collect_set("key").alias("keys"))
    names = F.array_join(F.array_sort(F.transform(F.filter("keys", lambda k: k != "n"), lambda k: F.substr(k, F.lit(2)))), ",")
    told = _hit_words(hits.select("row", "a", "b")).join(held.select("row", F.size("keys").cast("long").alias("n_items"), names.alias("names")), "row")
    out = rows.join(told, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
