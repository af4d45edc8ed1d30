"""URL filtering by rules and by a tree of path templates for each host.

Rules name a host and a path prefix; the longest that fits decides. For other
URLs, each host's paths form a tree by segment, in which runs of digits become
``#`` and a node with one child only is one with it. At a node, siblings are
compared by their shares of bad labelled pages with two-proportion tests. A
child with fewer labels than a test needs, or alike with all its siblings taken
together, goes into the wildcard ``*``. Of the others, those that are worse than
their siblings are compared with each other, and the alike ones go into ``*+``;
so do those that are better, into ``*-``. What is like none of them keeps its
name. Merged branches are one from there on. The number of siblings and the
depth of paths play no part in this.

A template is rejected if its smoothed share of bad labelled pages is above a
threshold. A node's share is (bad + strength * above) / (labelled + strength),
above being the share of the node over it and, at the root, a prior; so labels
reach templates without labels, which have the share of the node over them.

All statistics are sums over distinct (host, path shape) pairs, aggregated
before the shuffle, and hot keys meet them by broadcast, so a host with any
share of the rows costs no single task. A node with at most ``within`` distinct shapes,
of at most ``BYTES`` together, is finished with all that lies under it in one step, many
such nodes in a task. Larger nodes are split in rounds of joins and sums, each of which
goes down to the next node where paths part, until what is left is small. Both ways give
the same templates.

Nulls and odd cases: a null url or one without ``://`` has empty host and path
and is a host like any other; a null id passes through; repeated rows are judged
alike and count each time; a literal ``*`` in a path is shown as ``%2A``; an
empty table gives no row. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import hot_join
from tessella.workspace import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
#: More elements than an array in a row can have; a start added to it is still an int, which slices need where they are interpreted.
ALL = 1 << 30
#: Bytes of the shapes of a node that is finished in one step, at most.
BYTES = 4 << 20

#: The rules of the registered query, as (verdict, host and path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def fitting_rule(rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits columns host and path, or null; of equally long ones, the first by name."""
    out = None
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(slash + rest)
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if out is None else out


def _apart(z: float, min_labels: int, labelled: Column, bad: Column) -> Column:
    """Whether a row's share of bad labels (b of l) differs from that of others; true where these are too few to tell."""
    rate = (F.col("b") + bad) / (F.col("l") + labelled)
    spread = F.sqrt(rate * (1 - rate) * (1 / F.col("l") + 1 / labelled))
    return F.when(labelled < min_labels, True).otherwise(F.abs(F.col("b") / F.col("l") - bad / labelled) > z * spread)


def branches(kids: DataFrame, total: int, min_labels: int, z: float) -> DataFrame:
    """host, template, seg and branch (a wildcard or the segment) for children (host, template, seg, l, b) with enough labels."""
    node = ["host", "template"]
    told = kids.where(F.col("l") >= min_labels)
    sums = kids.groupBy(*node).agg(F.sum("l").alias("ls"), F.sum("b").alias("bs"))
    rest_l, rest_b = F.col("ls") - F.col("l"), F.col("bs") - F.col("b")
    first = hot_join(told, sums, node, total).withColumn("apart", _apart(z, min_labels, rest_l, rest_b)).withColumn("worse", F.when(rest_l > 0, F.col("b") / F.col("l") > rest_b / rest_l).otherwise(True))
    sides = first.where("apart").groupBy(*node, "worse").agg(F.sum("l").alias("side_l"), F.sum("b").alias("side_b"))
    # the comparison of a side is with its other members; where there is none, the child is apart
    second = first.join(sides, [*node, "worse"], "left").withColumn("alone", _apart(z, min_labels, F.col("side_l") - F.col("l"), F.col("side_b") - F.col("b")))
    branch = F.when(~F.col("apart"), F.lit("*")).when(F.col("alone"), F.col("seg")).otherwise(F.when(F.col("worse"), F.lit("*+")).otherwise(F.lit("*-")))
    return second.select(*node, "seg", branch.alias("branch"))


class Subtrees:
    """Finishes whole nodes: members (shape, rest, labelled, bad), the segments up to ``template`` being behind them."""

    def __init__(self, strength: float, min_labels: int, z: float):
        self.strength, self.min_labels, self.z = strength, min_labels, z

    def apart(self, own: tuple[int, int], labelled: int, bad: int) -> bool:
        n, b = own
        if labelled < self.min_labels:
            return True
        rate = (b + bad) / (n + labelled)
        return abs(b / n - bad / labelled) > self.z * math.sqrt(rate * (1 - rate) * (1 / n + 1 / labelled))

    def branches(self, kids: dict[str, list[int]]) -> dict[str, str]:
        """The branch of each segment with enough labels, as ``branches`` finds it for many nodes."""
        n, b = (sum(kid[i] for kid in kids.values()) for i in (0, 1))
        told = {seg: tuple(kid) for seg, kid in kids.items() if kid[0] >= self.min_labels}
        worse, sides = {}, {True: [0, 0], False: [0, 0]}
        for seg, own in told.items():
            rest = n - own[0], b - own[1]
            if self.apart(own, *rest):
                worse[seg] = side = not rest[0] or own[1] / own[0] > rest[1] / rest[0]
                sides[side][0] += own[0]
                sides[side][1] += own[1]
        out = dict.fromkeys(told, "*")
        for seg, side in worse.items():
            alone = self.apart(told[seg], sides[side][0] - told[seg][0], sides[side][1] - told[seg][1])
            out[seg] = seg if alone else "*+" if side else "*-"
        return out

    def finish(self, members: list[tuple], template: str, above: float) -> Iterator[tuple[str, str, float]]:
        """shape, template and badness of every member; nodes wait on a list, as paths may be deeper than calls can be."""
        waiting = [(members, 0, template, above)]
        while waiting:
            members, at, template, above = waiting.pop()
            share = (sum(m[3] for m in members) + self.strength * above) / (sum(m[2] for m in members) + self.strength)
            least = min(len(m[1]) for m in members)
            if len(members) == 1 or all(len(m[1]) == at for m in members):
                for shape, rest, *_ in members:
                    yield shape, "/".join([template, *rest[at:]]), share
                continue
            end, first = at, members[0][1]
            while end < least and all(m[1][end] == first[end] for m in members):
                end += 1
            template = "/".join([template, *first[at:end]])
            kids, parts = defaultdict(lambda: [0, 0]), defaultdict(list)
            for m in members:
                if len(m[1]) > end:
                    kids[m[1][end]][0] += m[2]
                    kids[m[1][end]][1] += m[3]
            known = self.branches(kids)
            for m in members:
                parts[known.get(m[1][end], "*") if len(m[1]) > end else None].append(m)
            for branch, part in parts.items():
                waiting.append((part, end, template, share) if branch is None else (part, end + 1, f"{template}/{branch}", share))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (host, template, above, shape, rest, labelled, bad) come sorted by host and template."""
        node, members = None, []

        def finished() -> pa.RecordBatch:
            rows = list(self.finish(members, *node[1:])) if members else []
            names = [pa.array([row[i] for row in rows], pa.string()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array([node and node[0]] * len(rows), pa.string()), *names, pa.array([row[2] for row in rows], pa.float64())], names=["host", "shape", "template", "badness"])

        for batch in batches:
            for *own, shape, rest, labelled, bad in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if own != node:
                    yield finished()
                    node, members = own, []
                members.append((shape, rest, labelled, bad))
        yield finished()


def templates(shapes: DataFrame, work: Workspace, prior: float, strength: float, min_labels: int = 5, z: float = 1.96, within: int = 4096) -> DataFrame:
    """host, shape, template and badness for every row of ``shapes`` (host, shape, labelled, bad)."""
    subtrees = Subtrees(strength, min_labels, z)

    def finished(rows: DataFrame) -> DataFrame:
        dealt = rows.select("host", "template", "above", "shape", "rest", "labelled", "bad").repartition("host", "template").sortWithinPartitions("host", "template")
        return work.save(dealt.mapInArrow(subtrees, "host string, shape string, template string, badness double"), "finished")

    segments = F.slice(F.split(F.replace(F.col("shape"), F.lit("*"), F.lit("%2A")), "/"), 2, ALL)
    open_ = work.save(shapes.select("host", "shape", "labelled", "bad", segments.alias("rest"), F.lit("").alias("template"), F.lit(float(prior)).alias("above")), "tree")
    settled, total = None, open_.count()
    while True:
        nodes = open_.groupBy("host", "template").agg(F.count("*").alias("n"), F.count_if(F.size("rest") == 0).alias("ended"), F.min("rest").alias("lo"), F.max("rest").alias("hi"), F.sum("labelled").alias("ls"), F.sum("bad").alias("bs"), F.sum(F.octet_length("shape")).alias("size"))
        # what the least and the greatest path have in common, all have
        parts = F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), False)
        common = F.when(parts == 0, F.size("lo")).otherwise(parts - 1)
        small = (F.col("n") <= within) & (F.col("size") <= BYTES)
        nodes = work.save(nodes.select("host", "template", "n", "ended", common.cast("int").alias("common"), "ls", "bs", small.alias("small")), "nodes")
        if nodes.where("not small").isEmpty():
            last = finished(open_)
            return last if settled is None else settled.unionByName(last)
        share = (F.col("bs") + strength * F.col("above")) / (F.col("ls") + strength)
        here = hot_join(open_, nodes, ["host", "template"], total, counts=nodes.select("host", "template", "n")).withColumn("share", share)
        ended = finished(here.where("small"))
        settled = ended if settled is None else settled.unionByName(ended)
        done = (F.col("n") == 1) | (F.col("n") == F.col("ended"))
        longer = lambda part: F.when(F.size(part) > 0, F.concat("template", F.lit("/"), F.array_join(part, "/"))).otherwise(F.col("template"))
        prefix, left = F.slice("rest", F.lit(1), F.col("common")), F.slice("rest", F.col("common") + 1, F.lit(ALL))
        stepped = work.save(here.where("not small").select(
            "host", "shape", "labelled", "bad", done.alias("done"), "share",
            F.when(done, longer(F.col("rest"))).otherwise(longer(prefix)).alias("template"),
            F.get(left, F.lit(0)).alias("seg"), F.slice(left, F.lit(2), F.lit(ALL)).alias("rest"),
        ), "stepped")
        work.drop(open_, nodes)
        settled = settled.unionByName(stepped.where("done").select("host", "shape", "template", F.col("share").alias("badness")))
        going = stepped.where(~F.col("done"))
        if going.isEmpty():
            return settled
        kids = work.save(going.where("seg is not null").groupBy("host", "template", "seg").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")), "kids")
        known = work.save(branches(kids, total, min_labels, z), "branches")
        joined = hot_join(going.where("seg is not null"), known, ["host", "template", "seg"], total)
        grown = joined.withColumn("template", F.concat("template", F.lit("/"), F.coalesce("branch", F.lit("*")))).drop("branch")
        both = grown.unionByName(going.where("seg is null"))
        open_ = work.save(both.select("host", "shape", "labelled", "bad", "rest", "template", F.col("share").alias("above")), "tree")
        work.drop(kids, known)


def judge(df: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, bad: Column | None = None, page_id: str = "page_id", url: str = "url", prior: float = 0.2, strength: float = 5.0, most: float = 0.5, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, template and badness for every row of ``df``.

    ``bad`` labels rows for the purity of templates, true, false or null; by
    default a rule's verdict is the label of the rows that it decides.
    """
    work = Workspace(df.sparkSession, "urls")
    parts = df.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), (bad if bad is not None else F.lit(None).cast("boolean")).alias("bad"))
    verdicts = F.create_map(*[F.lit(v) for verdict, rule in rules for v in (rule, verdict)]) if rules else F.lit(None).cast("map<string,string>")
    ruled = parts.withColumn("rule", fitting_rule(rules)).withColumn("told", F.element_at(verdicts, F.col("rule")))
    if bad is None:
        ruled = ruled.withColumn("bad", F.col("told") == "block")
    shaped = work.save(ruled.withColumn("shape", F.regexp_replace("path", "[0-9]+", "#")), "shaped")
    shapes = work.save(shaped.groupBy("host", "shape").agg(F.count("bad").alias("labelled"), F.count_if("bad").alias("bad"), F.count("*").alias("n")), "shapes")
    known = templates(shapes.drop("n"), work, prior, strength, **options)
    told = hot_join(shaped, known, ["host", "shape"], shaped.count(), counts=shapes.select("host", "shape", "n"))
    own = F.when(F.col("badness") > most, "block").otherwise("allow")
    return work.result(told.select("page_id", "host", "path", "rule", F.coalesce("told", own).alias("verdict"), "template", "badness"))
