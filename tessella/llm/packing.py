"""Packing documents into fixed token windows: concatenate and cut.

Pass one tokenises each partition and notes the running token offset of every
document in it. The partition totals, one number for each task, are summed into
global offsets. Pass two lays all documents end to end at these offsets and cuts
the line at every multiple of the window; a document that crosses a boundary
leaves one record for each side. Only the very last window can be short.

Nulls and odd cases: a null text counts as empty, and an empty document is the
end token alone; repeated rows are packed once each; a text of any length is cut
over as many windows as it needs; a text that holds the string of an added token
has that token's one id there; an empty table gives no piece. Only the named
columns are read.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.workspace import Workspace

# Pre-token pattern of the byte-level vocabulary, and its added token, which the ranks file leaves out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ADDED = {"<|endoftext|>": 50256}

_ENCODERS: dict[str, object] = {}


def vocabulary_path(vocabulary: str) -> str:
    """A path stays as it is; a bare name is looked up among the public vocabularies of this machine."""
    if os.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def encoder(vocabulary: str):
    """Text to ids, for a ranks file of a byte-level vocabulary or for a tokenizer's JSON file.

    ``byte_bpe_50k.tiktoken`` holds the same vocabulary as ``byte_bpe_50k.json``
    and gives, with the added token, the same ids about four times as fast. Its pattern
    cannot be matched against hundreds of thousands of spaces in a row; a text that it
    refuses goes to the JSON file of the same name.
    """
    if vocabulary not in _ENCODERS:
        path = vocabulary_path(vocabulary)
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            coding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)

            def ids(text: str) -> list[int]:
                try:
                    return coding.encode(text, allowed_special="all")
                except ValueError:
                    return encoder(path.removesuffix(".tiktoken") + ".json")(text)

            _ENCODERS[vocabulary] = ids
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            _ENCODERS[vocabulary] = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    return _ENCODERS[vocabulary]


def _tokenize(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, counts, starts = [], [], []
            for cell in batch.column(1):
                row = np.asarray([*encode(cell.as_py() or ""), end_id], dtype="<u4")
                ids.append(row.astype("<u2").tobytes() if row.max() < 65536 else row.tobytes())
                counts.append(len(row))
                starts.append(at)
                at += len(row)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(starts, pa.int64())],
                names=["doc_id", "ids", "doc_tokens", "part", "start_in_part"],
            )

    return run


def _cut(bases: dict[int, int], window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, which, starts, lengths, crcs, pieces = batch.to_pydict(), [], [], [], [], []
            at = [bases[p] + s for p, s in zip(rows["part"], rows["start_in_part"], strict=True)]
            for i, (raw, n) in enumerate(zip(rows["ids"], rows["doc_tokens"], strict=True)):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                cuts = [0, *range(window - at[i] % window, n, window), n]
                for a, b in zip(cuts, cuts[1:]):
                    which.append(i)
                    starts.append(a)
                    lengths.append(b - a)
                    crcs.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        pieces.append(ids[a:b].astype("<i4"))
            which = np.asarray(which, dtype=np.int64)
            place = np.asarray(at, dtype=np.int64)[which] + np.asarray(starts, dtype=np.int64)
            columns = {
                "doc_id": batch.column(0).take(pa.array(which)),
                "start": pa.array(starts, pa.int64()),
                "length": pa.array(lengths, pa.int64()),
                "ids_crc32": pa.array(crcs, pa.int64()),
                "doc_tokens": pa.array(np.asarray(rows["doc_tokens"], dtype=np.int64)[which]),
                "sequence_id": pa.array(place // window),
                "offset": pa.array(place % window),
            }
            if with_ids:
                columns["ids"] = pa.array(pieces, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", end_id: int = 1, window: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``with_ids`` adds the token ids of the piece. The order of documents is that
    of the scratch table written by pass one, so a retried task changes nothing.
    """
    work = Workspace(df.sparkSession, "packing")
    kind = df.schema[doc_id].dataType.simpleString()
    plain = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    tokens = work.save(plain.mapInArrow(_tokenize(vocabulary, end_id), f"doc_id {kind}, ids binary, doc_tokens bigint, part int, start_in_part bigint"), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect()  # one row for each task of pass one
    bases, at = {}, 0
    for row in totals:
        bases[row["part"]] = at
        at += row["n"]
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return tokens.mapInArrow(_cut(bases, window, with_ids), schema + (", ids array<int>" if with_ids else ""))
