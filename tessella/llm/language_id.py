"""Language identification by mixture inference over character n-grams.

A multinomial model of hashed letter trigrams is fitted for each labelled
language. For each document, expectation-maximisation estimates the proportions
with which the languages mix to give its trigrams. Languages are then taken in
the order of their proportions, and the size of the set is chosen by the
likelihood of the refitted mixture less a penalty for each language in it.

Nulls and odd cases: a null text, an empty one and one without a letter give
``und`` with score 0; rows with null language are not learned from; a null id is
hashed as the empty text; repeated rows are judged alike; whole texts are read,
however long; with no labelled row everything is ``und``; an empty table gives
no row; of more labelled languages than ``most`` those with the most labelled
rows are learned, ties by name. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.workspace import steady_batches

BITS = 16
#: Languages learned unless told otherwise: their table, 0.5 MB each, is gathered on the driver and broadcast.
MOST = 512
#: Multipliers of the trigram hash.
_MIX = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint64)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams around every letter of a text; what is not a letter counts as a gap."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    letter = _letters()[codes.astype(np.int64)]
    codes = np.concatenate([[0], np.where(letter, codes, 0), [0]]).astype(np.uint64)
    mixed = codes[:-2] * _MIX[0] + codes[1:-1] * _MIX[1] + codes[2:] * _MIX[2]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)[letter]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            totals.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
            totals[lang] += np.bincount(trigrams(text.as_py()), minlength=1 << BITS)
    for lang, n in totals.items():
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "gram": pa.array(at.astype(np.int32)), "n": pa.array(n[at])})


def sample_labelled(df: DataFrame, lang: str, key: Column, per_lang: int, most: int = MOST) -> DataFrame:
    """About ``per_lang`` rows of each language, all if it has fewer: those with the smallest hashes of ``key``.

    Of more than ``most`` languages, those with the most labelled rows, ties by name.
    """
    labelled = df.where(F.col(lang).isNotNull())
    sizes = labelled.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(most).collect()  # at most ``most`` rows
    if not sizes:
        return labelled
    rates = F.create_map(*[F.lit(v) for row in sizes for v in (row[lang], min(1.0, per_lang / row["count"]))])
    share = F.pmod(F.xxhash64(F.lit(5), key), F.lit(1 << 32)) / (1 << 32)
    return labelled.where(share < F.element_at(rates, F.col(lang)))  # no rate, no row


def fit(df: DataFrame, text: str, lang: str, key: Column, per_lang: int = 2000, smoothing: float = 0.01, most: int = MOST) -> tuple[list[str], np.ndarray]:
    """Languages, in order, and P(trigram | language) as an array of 2**16 rows.

    Learned from about ``per_lang`` documents of each language, whole texts, and
    from ``most`` languages at most. So the size of the model does not depend on
    that of the corpus.
    """
    sample = sample_labelled(df.where(F.col(text).isNotNull()), lang, key, per_lang, most)
    counts = sample.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(_count, "lang string, gram int, n bigint")
    sums = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # one row a language, with 2**16 pairs at most
    table = sums.groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("p")).select("lang", "p.gram", "p.n").toArrow()
    rows = sorted(zip(table["lang"].to_pylist(), table["gram"], table["n"], strict=True), key=lambda row: row[0])
    matrix = np.full((1 << BITS, len(rows)), smoothing)
    for j, (_, gram, n) in enumerate(rows):
        matrix[gram.values.to_numpy(), j] += n.values.to_numpy()
    matrix /= matrix.sum(axis=0, keepdims=True)
    return [row[0] for row in rows], matrix


def _em(p: np.ndarray, c: np.ndarray, first: np.ndarray, doc: np.ndarray, pi: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions of each document; zero ones stay zero. first: where each document's rows begin.

    A document that has settled is left as it is, so its neighbours decide nothing.
    """
    total, live = np.add.reduceat(c, first)[:, None], np.ones(len(first), dtype=bool)
    for _ in range(rounds):
        r = p * pi[doc]
        r *= (c / r.sum(axis=1))[:, None]
        new = np.add.reduceat(r, first, axis=0) / total
        settled = np.abs(new - pi).max(axis=1) < 1e-3
        pi = np.where(live[:, None], new, pi)
        live &= ~settled
        if not live.any():
            break
    return pi


def _likelihood(p, c, first, doc, pi) -> np.ndarray:
    return np.add.reduceat(c * np.log((p * pi[doc]).sum(axis=1)), first)


def infer(grams: list[np.ndarray], matrix: np.ndarray, penalty: float, rounds: int) -> np.ndarray:
    """Proportions of the languages in each document, zero outside of the chosen set.

    grams: one array for each document, none of them empty.
    """
    n, (_, langs) = len(grams), matrix.shape
    doc = np.repeat(np.arange(n), [len(g) for g in grams])
    keys, c = np.unique((doc << BITS) | np.concatenate(grams), return_counts=True)
    doc, p, c = keys >> BITS, matrix[keys & ((1 << BITS) - 1)], c.astype(np.float64)
    first = np.searchsorted(doc, np.arange(n))
    cost = penalty * np.log(np.add.reduceat(c, first) + 1)
    alone = np.add.reduceat(c[:, None] * np.log(p), first, axis=0)
    best = alone.argmax(axis=1)
    chosen = np.zeros((n, langs))
    chosen[np.arange(n), best] = 1.0
    if langs == 1:
        return chosen
    value = alone.max(axis=1) - cost
    full = _em(p, c, first, doc, np.full((n, langs), 1 / langs), rounds)
    # no set of two or more can gain more than the full mixture does
    open_ = np.nonzero(_likelihood(p, c, first, doc, full) - 2 * cost > value)[0]
    order = np.argsort(-full, axis=1, kind="stable")
    for size in range(2, langs + 1):
        if not len(open_):
            break
        rows = np.isin(doc, open_)
        sub = np.searchsorted(open_, doc[rows])
        at = np.searchsorted(sub, np.arange(len(open_)))
        pi = np.zeros((len(open_), langs))
        pi[np.arange(len(open_))[:, None], order[open_, :size]] = 1 / size
        pi = _em(p[rows], c[rows], at, sub, pi, rounds)
        gained = _likelihood(p[rows], c[rows], at, sub, pi) - size * cost[open_]
        better = gained > value[open_]
        chosen[open_[better]], value[open_[better]] = pi[better], gained[better]
        open_ = open_[better]
    return chosen


def _predict(langs: list[str], matrix: np.ndarray, penalty: float, rounds: int, keep_text: bool, explained: bool = False, cells: int = 1 << 21):
    chunk = max(1, min(1 << 17, cells // max(1, len(langs))))  # letters judged together, fewer with more languages
    likely = matrix.max(axis=1) > 1 / (1 << BITS) if langs else np.zeros(1 << BITS, dtype=bool)  # better than by chance

    def judged(grams: dict[int, np.ndarray], out: list) -> None:
        if not grams:
            return
        for i, pi in zip(grams, infer(list(grams.values()), matrix, penalty, rounds), strict=True):
            order = [j for j in np.argsort(-pi, kind="stable") if pi[j] > 0]
            out[i] = (langs[order[0]], min(1.0, float(pi[order[0]])), [langs[j] for j in order], [float(pi[j]) for j in order])
        grams.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            out: list = [("und", 0.0, [], [])] * batch.num_rows
            waiting: dict[int, np.ndarray] = {}
            fit_for = [0.0] * batch.num_rows
            held = 0
            for i, cell in enumerate(batch.column(at)):
                grams = trigrams(cell.as_py() or "") if langs else np.zeros(0)
                if len(grams):
                    waiting[i] = grams
                    fit_for[i] = float(likely[grams].mean())
                    held += len(grams)
                if held > chunk:
                    judged(waiting, out)
                    held = 0
            judged(waiting, out)
            pred, score, names, shares = zip(*out, strict=True) if out else ((), (), (), ())
            kept = [i for i in range(batch.num_columns) if i != at or keep_text]
            more = [pa.array(fit_for, pa.float64())] if explained else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(names, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())), *more],
                names=[batch.schema.names[i] for i in kept] + ["lang_pred", "score", "languages", "shares", *["explained"] * len(more)],
            )

    return run


def identify(df: DataFrame, train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 2000, penalty: float = 6.0, rounds: int = 12, keep: dict[str, Column] | None = None, keep_text: bool = False, explained: bool = False, most: int = MOST) -> DataFrame:
    """The columns of ``keep``, and the text as _text if ``keep_text``, with lang_pred, score, languages and shares, for every row of ``df``.

    ``train`` holds labelled rows. lang_pred is the language with the largest
    share, score that share; languages and shares are the chosen mixture. At most
    ``most`` languages are learned, those with the most labelled rows.
    ``explained`` adds a column of this name: the share of a text's letters whose
    trigrams some learned language makes likelier than a uniform law does.
    """
    steady_batches(df.sparkSession)
    langs, matrix = fit(train, text, lang, F.coalesce(F.col(key).cast("string"), F.lit("")), per_lang, most=most)
    model = df.sparkSession.sparkContext.broadcast(matrix)  # 2**16 rows for each language, whatever the corpus
    kept = df.select(*[c.alias(name) for name, c in (keep or {key: F.col(key)}).items()], F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "_text" or keep_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _predict(langs, model.value, penalty, rounds, keep_text, explained)(batches)

    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double, languages array<string>, shares array<double>" + (", explained double" if explained else ""))


def held_out(key: str) -> Column:
    """Whether a row is kept from training: the CRC-32 of its id as text leaves 2 on division by 4."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2
