"""Secret scan with corpus-wide ownership frequency.

Every text is searched for candidate secrets. The hash of each candidate's value
is then counted over the whole corpus by distinct repositories and distinct
owners: a value that many owners share, or that is copied into many repositories
of few owners, is an example; any other that looks random is a live credential.

Nulls and odd cases: a null text counts as empty and has no spans; a null owner
or repository counts as one owner or repository of its own; repeated rows each
get their own result row and count once per distinct repository; an empty table
gives an empty result. Only the named columns are read, so extra columns with
any name do not matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import hot_join
from tessella.workspace import Workspace

# The patterns of the base kinds and of the added kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ADDED = {
    "pem": re.compile(
        r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----(?:(?>\s*(?=[A-Za-z]*[0-9+/])[A-Za-z0-9+/]{16,}+={0,2}+(?![^\s-]))++|(?=\s*[A-Za-z0-9+/]+={0,2}\s*-----END ))"
        r"(?:\s*[A-Za-z0-9+/]+={0,2}(?=\s*-----END ))?(?:\s*-----END (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----)?"
    ),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    "forge": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "urlauth": re.compile(r"://[A-Za-z0-9._-]+:[^\s:@/]{6,}@"),
}
KINDS = ("assign", "access", "hex", *ADDED)

#: Cheap byte tests that must hold before the pattern of a kind can match.
_MARKS = {"assign": (b"passw", b"secret", b"token", b"api"), "pem": (b"private key-----",), "jwt": (b"eyj",), "forge": (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"), "urlauth": (b"://",)}
_HEX_BYTES = re.compile(rb"[0-9a-f]{32,}")

_SCANNED = "doc binary, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int,hash:string,random:boolean>>"


def looks_random(value: str) -> bool:
    """Whether a value has the entropy of a generated credential."""
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0
    return bits >= 2.5 and any(c.isdigit() for c in value)


def find_spans(raw: bytes) -> list[tuple[int, int, int, str]]:
    """(start, kind's place in KINDS, end, value) of every candidate, in order of start.

    Places are code points. Per kind, matches are leftmost and do not overlap;
    a match that fails its length rule is dropped but still consumes its text.
    """
    low = raw.lower()
    kinds = {k for k, marks in _MARKS.items() if any(m in low for m in marks)}
    if b"AKIA" in raw:
        kinds.add("access")
    if _HEX_BYTES.search(raw):
        kinds.add("hex")
    if not kinds:
        return []
    text, out = raw.decode("utf-8", "replace"), []
    if "assign" in kinds:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "access" in kinds:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if "hex" in kinds:
        out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    for at, (kind, pattern) in enumerate(ADDED.items(), 3):
        if kind in kinds:
            out += [(m.start(), at, m.end(), m[0]) for m in pattern.finditer(text)]
    return sorted(out)


def joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()),
        ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("random", pa.bool_())]))),
    ])
    for batch in batches:
        at = batch.schema.get_field_index("_text")
        rows: dict[str, list] = {name: [] for name in schema.names}
        for cell in batch.column(at):
            spans = find_spans(cell.as_py() or b"")
            base = [s for s in spans if s[1] < 3]
            counts = Counter(s[1] for s in base)
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                rows[name].append(counts[k])
            rows["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            rows["spans"].append(joined(spans))
            rows["found"].append([{"kind": KINDS[k], "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest(), "random": looks_random(v)} for s, k, e, v in spans])
        kept = [i for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in kept] + [pa.array(rows[f.name], f.type) for f in schema],
            names=[batch.schema.names[i] for i in kept] + schema.names,
        )


def scan(df: DataFrame, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: the columns of ``keep``, counts, digest, spans and the candidates."""
    kept = df.select(*[c.alias(name) for name, c in (keep or {}).items()], F.col(text).cast("binary").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "_text")
    return kept.mapInArrow(_scan, f"{fields}, {_SCANNED.partition(', ')[2]}")


def ownership(candidates: DataFrame, repo: str, owner: str) -> DataFrame:
    """hash, n_repos, n_owners: in how many repositories and by how many owners a value occurs.

    Both counts go through distinct pairs first, so that copies collapse before
    the shuffle by hash and no task receives the occurrences of a hot value.
    """
    repos = candidates.select("hash", F.lit(0).alias("what"), F.col(repo).cast("string").alias("who"))
    owners = candidates.select("hash", F.lit(1).alias("what"), F.col(owner).cast("string").alias("who"))
    pairs = repos.unionByName(owners).distinct()
    return pairs.groupBy("hash").agg(F.count_if(F.col("what") == 0).alias("n_repos"), F.count_if(F.col("what") == 1).alias("n_owners"))


def is_example(example_owners: int, example_repos: int) -> Column:
    """Whether columns n_owners and n_repos make a value a copied example."""
    return (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)


def secret_scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source", example_owners: int = 3, example_repos: int = 100) -> DataFrame:
    """Spans of every row with a verdict on each candidate.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_live and
    n_example (long): how many candidates look like live credentials of one
    owner, and how many are examples. A value is an example if ``example_owners``
    or more owners hold it, or if it is in ``example_repos`` or more repositories;
    otherwise it is live if it looks random.
    """
    work = Workspace(df.sparkSession, "secrets")
    keep = {"doc_id": F.col(doc_id), "repo": F.col(repo), "owner": F.col(owner)}
    found = work.save(scan(df, text, keep).withColumn("row", F.monotonically_increasing_id()), "scanned")
    candidates = found.where(F.size("found") > 0).select("row", "repo", "owner", F.explode("found").alias("c")).select("row", "repo", "owner", "c.hash", "c.random")
    known = work.save(ownership(candidates, "repo", "owner"), "ownership")
    judged = (
        hot_join(candidates.select("row", "hash", "random"), known, ["hash"], candidates.count(), "inner")
        .groupBy("row").agg(
            F.count_if(is_example(example_owners, example_repos)).alias("n_example"),
            F.count_if(~is_example(example_owners, example_repos) & F.col("random")).alias("n_live"),
        )
    )
    none = F.lit(0).cast("long")
    return found.join(judged, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", F.coalesce("n_live", none).alias("n_live"), F.coalesce("n_example", none).alias("n_example"))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, spans_at = batch.schema.get_field_index("_text"), batch.schema.get_field_index("_spans")
        out = []
        for cell, spans in zip(batch.column(at), batch.column(spans_at).to_pylist(), strict=True):
            text = cell.as_py()
            if spans:
                parts, done = [], 0
                for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if span["start"] >= done:
                        parts += [text[done : span["start"]], f"<{span['kind']}:{'example' if span['example'] else 'removed'}>"]
                    done = max(done, span["end"])
                text = "".join(parts) + text[done:]
            out.append(text)
        columns, names = list(batch.columns), list(batch.schema.names)
        columns[at], names[at] = pa.array(out, batch.schema.field(at).type), "_text"
        yield pa.RecordBatch.from_arrays([c for i, c in enumerate(columns) if i != spans_at], names=[n for n in names if n != "_spans"])


def _only(spans: bool):
    """Rows whose column ``_text`` has spans, or those that have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(batch.schema.get_field_index("_text")).cast(pa.binary())
            yield batch.filter(pa.array([bool(find_spans(raw.as_py() or b"")) == spans for raw in raws], pa.bool_()))

    return run


def redacted(df: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source", example_owners: int = 3, example_repos: int = 100) -> DataFrame:
    """``df`` with a marker in place of every span; the marker tells the kind and whether the value is a known example.

    Spans that overlap become one. Rows without spans are unchanged, and are
    passed on without being stored.
    """
    work = Workspace(df.sparkSession, "redaction")
    columns = {f"_c{i}": F.col(f"`{c}`") for i, c in enumerate(df.columns)}
    named = df.select(*[c.alias(name) for name, c in columns.items()], F.col(text).alias("_text"), F.col(repo).alias("_repo"), F.col(owner).alias("_owner"))
    clean = named.mapInArrow(_only(False), named.schema)
    dirty = named.mapInArrow(_only(True), named.schema)
    found = work.save(scan(dirty, "_text", {c: F.col(c) for c in columns} | {"repo": F.col("_repo"), "owner": F.col("_owner"), "_body": F.col("_text")}).withColumn("row", F.monotonically_increasing_id()), "scanned")
    candidates = found.select("row", "repo", "owner", F.explode("found").alias("c"))
    known = work.save(ownership(candidates.select("c.hash", "repo", "owner"), "repo", "owner"), "ownership")
    judged = hot_join(candidates.select("row", "c", F.col("c.hash").alias("hash")), known, ["hash"], candidates.count(), "inner")
    span = F.struct(F.col("c.kind").alias("kind"), F.col("c.start").alias("start"), F.col("c.end").alias("end"), is_example(example_owners, example_repos).alias("example"))
    spans = judged.groupBy("row").agg(F.collect_list(span).alias("_spans"))
    kept = [*columns, F.col("_body").alias("_text"), "_spans"]
    ready = found.join(spans, "row").select(*kept)
    cut = ready.mapInArrow(_cut_out, ready.drop("_spans").schema)
    at = df.columns.index(text)
    both = clean.select(*columns, "_text").unionByName(cut)
    return both.select(*[F.col("_text" if i == at else f"_c{i}").alias(c) for i, c in enumerate(df.columns)])
