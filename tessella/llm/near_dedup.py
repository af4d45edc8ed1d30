"""MinHash near-deduplication by fast similarity sketching.

Sketch: in rounds, every shingle is hashed to one bin and a value; a bin keeps
its least value, and a value of an earlier round is less than any of a later
one. Rounds go on until all bins are full; should as many rounds as there are
bins not suffice, each following round serves one bin with all shingles, so that
every coordinate fills. Two sketches agree in a share of their coordinates that
is concentrated about the Jaccard similarity.

Candidates: documents with equal shingle sets are one class from the start.
Bands of four coordinates put class representatives into buckets. First each
member of a bucket is checked against the bucket's first member. What these
links leave apart in a bucket is then checked pair by pair. Pairs whose sketches
agree in fewer coordinates than 4.5 standard deviations below the threshold are
screened out, in both steps, before any text moves; all others are checked on
their full shingle sets. Components are found without collecting links.

In the second step a bucket's largest component need not be compared with
itself. Its other members are dealt to parts of bounded size, each of which meets
all members in shares of bounded size, so no task holds a bucket, and a bucket
with few such members is sent on once.

Nulls and odd cases: a null text, an empty one and one of white space have no
shingle and link with nothing; a text with fewer words than a shingle has its
whole word sequence as its one shingle. A null id counts as larger than any id;
a class of null ids only has a null component_id and kept false. Repeated rows
are one class. Whole texts are used, however long. An empty table gives no row.
Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORD, as_row, group_key, hot_join
from tessella.llm.components import connected_components
from tessella.llm.decontamination import BitTable
from tessella.workspace import Workspace

BINS = 256
BANDS, ROWS = 32, 4
#: Coordinates by which pairs are screened.
MARKS = 128
#: Spokes of a hub, members outside of a bucket's largest component, and members of any kind that one group of rows has, about.
SETS, SKETCHES, SHARE = 256, 512, 8192
_U = np.uint64
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Words(dict):
    """Word to 64-bit hash, remembered for up to 2**17 words at a time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(raw: bytes, words: Words, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    ``bytes.lower`` folds A-Z only and ``bytes.split`` cuts at the six white-space bytes.
    """
    found = raw.lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=n)
    span = min(n, width)
    total = np.full(n - span + 1, span, dtype=np.uint64)
    for i in range(span):
        total += h[i : n - span + 1 + i] * (_PLACE[i % 5] + _U(2 * (i // 5)))  # odd factors, one for each place
    found = _mix(total)
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of hashes, ``bins`` 64-bit coordinates."""
    empty = _U(0xFFFFFFFFFFFFFFFF)
    out, done, n = np.full(bins, empty, dtype=np.uint64), 0, len(items)
    while done < bins:
        rounds = min(bins - done, max(1, -(-2 * bins // n)))
        seeds = np.arange(done, done + rounds, dtype=np.uint64)
        h = _mix(items[None, :] ^ _mix(seeds + _PLACE[0])[:, None])
        value = (seeds[:, None] << _U(50)) | (h & _U((1 << 50) - 1))
        np.minimum.at(out, (h >> _U(50)).ravel() % _U(bins), value.ravel())
        done += rounds
        if not (out == empty).any():
            return out
    for j in np.nonzero(out == empty)[0]:
        h = _mix(items ^ _mix(np.array([bins + j], dtype=np.uint64) + _PLACE[0]))
        out[j] = (_U(bins + j) << _U(50)) | (h & _U((1 << 50) - 1)).min()
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    rows = coordinates[: BANDS * ROWS].reshape(BANDS, ROWS)
    return _mix((_mix(rows + _PLACE[:ROWS]) * _PLACE[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            sizes, ids, bands, marks = [], [], [], []
            for cell in batch.column(at):
                items = shingles(cell.as_py() or b"", words, width)
                sizes.append(len(items))
                if len(items):
                    full = sketch(items)
                    ids.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(full))
                    marks.append(_mix(full[:MARKS]).astype(np.uint8).tobytes())
                else:
                    for column in (ids, bands, marks):
                        column.append(None)
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + [pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                names=[batch.schema.names[i] for i in kept] + ["n_shingles", "set_id", "bands", "marks"],
            )

    return run


def _compress(wanted: Broadcast[BitTable]):
    """Key and compressed text of the rows (key, text, h) whose h the table lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, table = zstandard.ZstdCompressor(level=3), wanted.value
        for batch in batches:
            passed = table(batch.column(2).to_numpy().view(np.uint64))
            if not passed.any():
                continue
            some = batch.filter(pa.array(passed))
            packed = [packer.compress(cell.as_py()) for cell in some.column(1)]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(packed, pa.binary())], names=["key", "packed"])

    return run


class _Union(dict):
    def root(self, x: int) -> int:
        while self.setdefault(x, x) != x:
            self[x] = self[self[x]]
            x = self[x]
        return x


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct arrays."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _verify(width: int, percent: int):
    """Rows come sorted by hub and part, the hub's own row first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, unpack = Words(), zstandard.ZstdDecompressor()
        group, center = None, None
        for batch in batches:
            rows, out = batch.to_pydict(), ([], [])
            for hub, part, id_, packed in zip(*(rows[c] for c in ("hub", "part", "id", "packed")), strict=True):
                items = shingles(unpack.decompress(packed), words, width)
                if (hub, part) != group:
                    group, center = (hub, part), items
                elif linked(center, items, percent):
                    out[0].append(hub)
                    out[1].append(id_)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    return run


def _near_hub(least_equal: int, percent: int):
    """The spokes whose sketches allow a link with their hub; rows come sorted by hub and part, the hub's own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, center, size = None, None, 0
        for batch in batches:
            hubs, parts, ids, sizes = (batch.column(i).to_numpy() for i in range(4))
            marks = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint8).reshape(-1, MARKS)
            keep = np.zeros(len(ids), dtype=bool)
            cuts = np.nonzero((np.diff(hubs) != 0) | (np.diff(parts) != 0))[0] + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)]) if len(ids) else ():
                if (hubs[a], parts[a]) != group:
                    group, center, size = (hubs[a], parts[a]), marks[a], sizes[a]
                alike = (marks[a:b] == center).sum(axis=1) >= least_equal
                keep[a:b] = alike & (100 * np.minimum(sizes[a:b], size) >= percent * np.maximum(sizes[a:b], size)) & (ids[a:b] != hubs[a])
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (hubs, parts, ids)], names=["hub", "part", "id"])

    return run


class Members:
    """Some members of a bucket: their sketches and, where texts came with them, their shingle sets as needed."""

    def __init__(self, columns: dict, words: Words, width: int):
        self.ids, self.comps, self.sizes = (columns[c] for c in ("id", "comp", "n_shingles"))
        self.marks = np.frombuffer(b"".join(columns["marks"]), dtype=np.uint8).reshape(-1, MARKS)
        self.bands = columns["bands"].reshape(-1, BANDS) if "bands" in columns else None
        self.packed, self.words, self.width, self._sets = columns.get("packed"), words, width, {}

    def items(self, i: int) -> np.ndarray:
        if i not in self._sets:
            self._sets[i] = shingles(zstandard.decompress(self.packed[i]), self.words, self.width)
        return self._sets[i]

    def partners(self, p: int, others: Members, key: int, least_equal: int, percent: int) -> np.ndarray:
        """Places in ``others`` of what may link with member p in another component; where bands came along, in no band before that of ``key``."""
        q = np.nonzero((others.comps != self.comps[p]) & (100 * np.minimum(others.sizes, self.sizes[p]) >= percent * np.maximum(others.sizes, self.sizes[p])))[0]
        q = q[(others.marks[q] == self.marks[p]).sum(axis=1) >= least_equal]
        if self.bands is None or not len(q):
            return q
        band = int(np.nonzero(self.bands[p] == key)[0][0])
        return q[~(others.bands[q, :band] == self.bands[p, :band]).any(axis=1)]


def _meet(least_equal: int, percent: int, width: int, check: bool):
    """Compares the own members of a group with each other, in its first share, and with all its other members.

    Rows come sorted by key, part, share and not own. Without ``check``, gives
    the rows of members that may have a link in the group: all its columns up to
    comp. With it, texts come along, and links are found on full sets, but for
    pairs whose components other links of the group connect.
    """
    place = ("key", "part", "share", "own", "id", "comp")
    names = (*place, "n_shingles", "marks", *(("bands", "packed") if check else ()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, group, parts, own, union = Words(), None, [], None, _Union()
        hopeful: set[int] = set()

        def columns(batch: pa.RecordBatch, a: int, b: int) -> dict:
            out = {}
            for name in names:
                cells = batch.column(batch.schema.get_field_index(name)).slice(a, b - a)
                out[name] = cells.flatten().to_numpy() if name == "bands" else cells.to_pylist() if name in ("marks", "packed") else cells.to_numpy(zero_copy_only=False)
            return out

        def compared(left: Members, right: Members, within: bool) -> Iterator[tuple[int, int]]:
            for p in range(len(left.ids)):
                q = left.partners(p, right, group[0], least_equal, percent)
                for s in q[q > p] if within else q:
                    if not check:
                        yield p, s
                        continue
                    one, two = union.root(int(left.comps[p])), union.root(int(right.comps[s]))
                    if one != two and linked(left.items(p), right.items(s), percent):
                        union[one] = two
                        yield p, s

        def told(left: Members, right: Members, pairs: list[tuple[int, int]]) -> pa.RecordBatch | None:
            if check:
                return pa.RecordBatch.from_arrays([pa.array([int(m.ids[i]) for i in side], pa.int64()) for m, side in zip((left, right), zip(*pairs))], names=["a", "b"]) if pairs else None
            hopeful.update(p for p, _ in pairs)
            if left is right:
                hopeful.update(s for _, s in pairs)
                return None
            at = sorted({int(s) for _, s in pairs})
            return rows(right, at, False) if at else None

        def rows(members: Members, at: list[int], mine: bool) -> pa.RecordBatch:
            n = len(at)
            fixed = [pa.array([group[0]] * n, pa.int64()), pa.array([group[1]] * n, pa.int64()), pa.array([group[2]] * n, pa.int64()), pa.array([mine] * n, pa.bool_())]
            return pa.RecordBatch.from_arrays([*fixed, pa.array(members.ids[at]), pa.array(members.comps[at])], names=list(place))

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal own
            if own is None and parts:
                own = Members({c: [v for part in parts for v in part[c]] if c in ("marks", "packed") else np.concatenate([part[c] for part in parts]) for c in names}, words, width)
                parts.clear()
                if group[2] == 0:
                    found = told(own, own, list(compared(own, own, True)))
                    if found:
                        yield found

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal own, union
            yield from close()
            if own is not None and hopeful:
                yield rows(own, sorted(map(int, hopeful)), True)
            own, union = None, _Union()
            hopeful.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            key, part, share, mine = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in place[:4])
            cuts = np.nonzero((np.diff(key) != 0) | (np.diff(part) != 0) | (np.diff(share) != 0) | (np.diff(mine.astype(np.int8)) != 0))[0] + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if (key[a], part[a], share[a]) != group:
                    yield from finish()
                    group = (int(key[a]), int(part[a]), int(share[a]))
                if mine[a]:
                    parts.append(columns(batch, a, b))
                    continue
                yield from close()
                if own is not None:
                    others = Members(columns(batch, a, b), words, width)
                    found = told(own, others, list(compared(own, others, False)))
                    if found:
                        yield found
        yield from finish()

    return run


def _row_key() -> Column:
    """One never-null string of columns doc_id and md5."""
    return F.concat("md5", group_key("doc_id"))


def _texts(work: Workspace, docs: DataFrame, sets: DataFrame, ids: DataFrame) -> DataFrame:
    """id and compressed text of the sets with these ids.

    A bit table of at most 16 MiB keeps the texts of other documents from leaving
    the scan. What passes it by chance is dropped by the join, so a table that is
    too small for the ids only means that more texts move.
    """
    placed = sets.join(ids, "id", "left_semi").select("id", "place.doc_id", "place.md5")
    sought = work.save(placed.select("id", _row_key().alias("key")), "sought")
    table = BitTable.of(sought.select(F.xxhash64("key").alias("h")), sought.count())
    rows = docs.where(F.length("text") > 0).select(_row_key().alias("key"), "text").withColumn("h", F.xxhash64("key"))
    packed = rows.mapInArrow(_compress(work.spark.sparkContext.broadcast(table)), "key string, packed binary")
    once = packed.groupBy("key").agg(F.first("packed").alias("packed"))  # each task sends one of its repeated rows
    return work.save(once.join(sought, "key").select("id", "packed"), "texts")


def _spoke_links(work: Workspace, spokes: DataFrame, sets: DataFrame, docs: DataFrame, width: int, least_equal: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links among spokes (hub, id), and the texts that were fetched for them.

    The spokes of a hub are dealt to groups of about SETS members, so that a
    hub's text is sent once to a group, not once for each of its spokes.
    """
    spokes = work.save(spokes, "spokes")
    degrees = work.save(spokes.groupBy("hub").agg(F.count("*").alias("n")), "degrees")
    groups = degrees.select("hub", F.ceil(F.col("n") / SETS).alias("groups"))
    dealt = hot_join(spokes, groups, ["hub"], spokes.count(), counts=degrees).select("hub", F.pmod(F.xxhash64("id"), F.col("groups")).alias("part"), "id")

    def gathered(pairs: DataFrame, table: DataFrame) -> DataFrame:
        wanted = pairs.unionByName(pairs.select("hub", "part", F.col("hub").alias("id")).distinct())
        rows = wanted.join(table, "id").select("hub", "part", *table.columns)
        return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("id") != F.col("hub"))

    sketches = gathered(work.save(dealt, "dealt"), sets.select("id", "n_shingles", "marks"))
    near = work.save(sketches.mapInArrow(_near_hub(least_equal, percent), "hub bigint, part bigint, id bigint"), "near-hubs")
    texts = _texts(work, docs, sets, near.select("id").unionByName(near.select(F.col("hub").alias("id"))).distinct())
    return work.save(gathered(near, texts).mapInArrow(_verify(width, percent), "a bigint, b bigint"), "spoke-links"), texts


def _loose_links(work: Workspace, placed: DataFrame, sets: DataFrame, docs: DataFrame, texts: DataFrame, width: int, least_equal: int, percent: int) -> DataFrame:
    """Links between members of one bucket that lie in different components; placed has key, id and comp, texts what has been fetched."""
    per = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = per.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.max("c").alias("top"), F.sum("c").alias("n"), F.count("*").alias("kinds")).where("kinds > 1")
    mixed = work.save(mixed, "mixed")
    loose = hot_join(placed, mixed.drop("kinds"), ["key"], placed.count(), "inner", counts=mixed.select("key", "n"))
    long = lambda v: F.lit(v).cast("long")
    parts, shares = F.ceil((F.col("n") - F.col("top")) / SKETCHES), F.ceil(F.col("n") / SHARE)
    block = F.when(F.col("comp") != F.col("major"), F.pmod(F.xxhash64("id"), parts)).otherwise(parts)  # the largest component's members are own to no part
    share = F.pmod(F.xxhash64(F.lit(7), "id"), shares)
    own = F.when(F.col("block") < parts, F.transform(F.sequence(long(0), shares - 1), lambda s: F.struct(F.col("block").alias("part"), s.alias("share"), F.lit(True).alias("own"))))
    met = F.when(F.col("block") > 0, F.transform(F.sequence(long(0), F.col("block") - 1), lambda i: F.struct(i.alias("part"), share.alias("share"), F.lit(False).alias("own"))))
    none = F.array().cast("array<struct<part:bigint,share:bigint,own:boolean>>")
    at = loose.withColumn("block", block).withColumn("at", F.concat(F.coalesce(own, none), F.coalesce(met, none)))
    dealt = at.select("key", "id", "comp", "at").join(sets.select("id", "n_shingles", "marks"), "id").select("key", F.inline("at"), "id", "comp", "n_shingles", "marks")
    order = ["key", "part", "share", ~F.col("own")]
    place = "key bigint, part bigint, share bigint, own boolean, id bigint, comp bigint"
    hopeful = dealt.repartition("key", "part", "share").sortWithinPartitions(*order).mapInArrow(_meet(least_equal, percent, width, False), place)
    hopeful = work.save(hopeful, "hopeful")
    more = work.save(hopeful.select("id").distinct().join(texts, "id", "left_anti"), "more")
    if not more.isEmpty():
        texts = texts.unionByName(_texts(work, docs, sets, more))
    whole = hopeful.join(sets.select("id", "n_shingles", "bands", "marks"), "id").join(texts, "id").select("key", "part", "share", "own", "id", "comp", "n_shingles", "bands", "marks", "packed")
    return work.save(whole.repartition("key", "part", "share").sortWithinPartitions(*order).mapInArrow(_meet(least_equal, percent, width, True), "a bigint, b bigint"), "loose-links")


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75, width: int = 5) -> DataFrame:
    """One row per row of ``df``: doc_id, md5 (of the text), n_shingles, component_id, kept, stays.

    stays marks one (doc_id, md5) of each class, also where ids are null.
    """
    work = Workspace(df.sparkSession, "neardup")
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).withColumn("md5", F.md5("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = work.save(docs.mapInArrow(_describe(width), f"doc_id {kind}, md5 string, n_shingles bigint, set_id binary, bands array<bigint>, marks binary"), "described")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "md5")
    first = {c: F.first(c).alias(c) for c in ("n_shingles", "bands", "marks")}
    sets = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min(place).alias("place"), F.count("*").alias("n"), *first.values())
    sets = work.save(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    members = work.save(rows.select("doc_id", "md5", "n_shingles", "set_id"), "rows")
    work.drop(rows)
    p = percent / 100
    # two coordinates that differ still agree in their low byte once in 256 times, which only lets more pairs through
    least_equal = int(MARKS * (p - 4.5 * (p * (1 - p) / MARKS) ** 0.5))

    banded = sets.select("id", F.explode("bands").alias("key"))
    buckets = work.save(banded.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = work.save(hot_join(banded, buckets.drop("n"), ["key"], sets.count() * BANDS, "inner", counts=buckets.select("key", "n")), "shared")
    spokes = shared.where("id != first_id").select(F.col("first_id").alias("hub"), "id").distinct()
    links, texts = _spoke_links(work, spokes, sets, docs, width, least_equal, percent)
    label = work.save(connected_components(work, links), "labels")

    def labelled(table: DataFrame, column: str, out: str) -> DataFrame:
        joined = table.join(label.select(F.col("node").alias("_node"), F.col("label").alias("_label")), F.col(column) == F.col("_node"), "left")
        return joined.withColumn(out, F.coalesce("_label", column)).drop("_node", "_label")

    placed = work.save(labelled(shared.select("key", "id"), "id", "comp"), "placed")
    more = _loose_links(work, placed, sets, docs, texts, width, least_equal, percent)
    over = labelled(labelled(more, "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    upper = work.save(connected_components(work, over), "upper").select(F.col("node").alias("comp"), F.col("label").alias("top"))

    total = members.count()
    lower = work.save(labelled(sets.select("id", "set_id", "place", "n"), "id", "comp"), "lower")
    final = work.save(hot_join(lower, upper, ["comp"], total).select("set_id", "place", "n", F.coalesce("top", "comp").alias("comp")), "final")
    heads = work.save(final.groupBy("comp").agg(F.min("place").alias("head"), F.count("*").alias("n")), "heads")
    known = hot_join(final.drop("n"), heads.drop("n"), ["comp"], total, counts=heads.select("comp", "n"))
    known = work.save(known.select("set_id", F.col("head.doc_id").alias("head_doc"), F.col("head.md5").alias("head_md5")), "known")
    some = members.where("n_shingles > 0")
    out = hot_join(some, known, ["set_id"], total, counts=final.select("set_id", "n"))
    stays = F.col("doc_id").eqNullSafe(F.col("head_doc")) & (F.col("md5") == F.col("head_md5"))
    out = out.select("doc_id", "md5", "n_shingles", F.col("head_doc").alias("component_id"), stays.alias("stays"))
    alone = members.where("n_shingles = 0").select("doc_id", "md5", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    both = out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return work.result(both.select("doc_id", "md5", "n_shingles", "component_id", "kept", "stays"))


def near_duplicates(df: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``df``; options as of classes."""
    return classes(df, **options).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df``, one of each class of near duplicates.

    A row without words is never a duplicate. Of repeated rows, equal in id and
    text, one stays.
    """
    stay = classes(df, doc_id, text, **options).where("stays and n_shingles > 0").select(_row_key().alias("key")).distinct()
    worded = F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    rows = df.where(worded).select(as_row(df).alias("row"), F.col(doc_id).alias("doc_id"), F.md5(F.col(text).cast("binary")).alias("md5"))
    once = rows.groupBy(_row_key().alias("key")).agg(F.first("row").alias("row"))  # each task sends one of its repeated rows
    return once.join(stay, "key").select(*[F.col(f"row.`{c}`") for c in df.columns]).unionByName(df.where(~worded))
