"""Running values over an order of any length, without a task that holds a whole group.

Rows are dealt to ranges of their order (``repartitionByRange``, whose bounds Spark
finds from a sample) and stored, so that every later plan sees the same ranges.
Running values are taken within a range; each range is reduced to one row, its
head, and running values of the heads, one row a range and group, give what a range
begins with. A group with a third of all rows spreads over as many ranges as its
share; rows equal in all order columns stay in one range, so callers end the
order with a column that tells rows apart.

Nulls: keys may be null and form a group of their own; nulls of the order come
first; running values pass over null values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.workspace import Workspace

RANGE = "_range"


def in_ranges(df: DataFrame, order: list[str], *keys: str) -> DataFrame:
    """``df`` stored in ranges of (keys, order), numbered along it in ``_range``; there are as many as shuffle partitions at most."""
    dealt = df.repartitionByRange(*keys, *order).withColumn(RANGE, F.spark_partition_id())
    return Workspace(df.sparkSession, "ranges").save(dealt, "rows")


def _folds(kind: str, column: str, order: list[str]) -> tuple[Column, Column, Column]:
    """The fold of a running window, of a range to its head, and of the heads before a range."""
    if kind == "last":
        at = F.when(F.col(column).isNotNull(), F.struct(*order))
        return F.last(column, ignorenulls=True), F.max_by(column, at), F.last(column, ignorenulls=True)
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[kind]
    return fold(column), fold(column), fold(column)


def _joined(kind: str, before: Column, own: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0))
    return {"min": F.least, "max": F.greatest, "last": lambda b, o: F.coalesce(o, b)}[kind](before, own)


def begins(ranged: DataFrame, folds: dict[str, tuple[str, str]], order: list[str], *keys: str) -> DataFrame:
    """For each range and group what the ranges before it fold to, null if none: (keys, _range, names of ``folds``)."""
    heads = ranged.groupBy(*keys, RANGE).agg(*[_folds(kind, column, order)[1].alias(name) for name, (kind, column) in folds.items()])
    group = keys or (F.lit(0),)  # without keys there is one row for each range, and no more
    before = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return heads.select(*keys, RANGE, *[_folds(kind, name, [RANGE])[2].over(before).alias(name) for name, (kind, _) in folds.items()])


def _with_begins(ranged: DataFrame, start: DataFrame, names: dict[str, str], *keys: str) -> DataFrame:
    same = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys] + [F.col(RANGE) == F.col(f"_s{RANGE}")]
    named = start.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col(RANGE).alias(f"_s{RANGE}"), *[F.col(a).alias(b) for a, b in names.items()])
    return ranged.join(named, same).drop(*[f"_s_{k}" for k in keys], f"_s{RANGE}")


def running(df: DataFrame, folds: dict[str, tuple[str, str]], order: list[str], *keys: str, inclusive: bool = True) -> DataFrame:
    """``df`` with running values along ``order`` within each group of ``keys``.

    ``folds`` gives each new column's kind (sum, min, max, or last, the last value
    that is not null) and the column it folds; with ``inclusive`` the row itself counts.
    A sum of no rows is 0, any other value of none null.
    """
    ranged = in_ranges(df, order, *keys)
    start = _with_begins(ranged, begins(ranged, folds, order, *keys), {n: f"_b_{n}" for n in folds}, *keys)
    within = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    own = {n: _folds(kind, column, order)[0].over(within) for n, (kind, column) in folds.items()}
    done = start.withColumns({f"_o_{n}": v for n, v in own.items()})
    out = [_joined(kind, F.col(f"_b_{n}"), F.col(f"_o_{n}")).alias(n) for n, (kind, _) in folds.items()]
    return done.select(*df.columns, *out)


def new_extremes(df: DataFrame, value: str, order: list[str], *keys: str, least: bool = True) -> DataFrame:
    """Rows whose value is strictly below (or above) that of every row before them.

    What the ranges before hold leaves few rows of a range as a rule, and only
    these are ordered within it; of a group's first range all rows are.
    """
    kind, beats = ("min", lambda a, b: a < b) if least else ("max", lambda a, b: a > b)
    ranged = in_ranges(df, order, *keys)
    start = begins(ranged, {"_before": (kind, value)}, order, *keys)
    met = _with_begins(ranged, start, {"_before": "_before"}, *keys)
    left = met.where(F.col(value).isNotNull() & (F.col("_before").isNull() | beats(F.col(value), F.col("_before")))).drop("_before")
    within = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    best = (F.min if least else F.max)(value).over(within)
    return left.withColumn("_best", best).where(F.col("_best").isNull() | beats(F.col(value), F.col("_best"))).select(*df.columns)
