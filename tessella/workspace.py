"""Scratch tables in the folder that driver and executors share.

Iterative plans cut their lineage by writing a table and reading it again. The
table survives the loss of any executor, which a local checkpoint does not.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []
#: Folders that are still there, each with the JVM objects that can delete it.
_OPEN: dict[str, tuple] = {}


def _delete(path: str, jvm, conf) -> None:
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place, True)


def _forget(paths: list[str]) -> None:
    for path in paths:
        jvm, conf = _OPEN.pop(path)
        try:
            _delete(path, jvm, conf)
        except Exception:  # the JVM may have ended before this process does
            pass


@atexit.register
def _forget_all() -> None:
    _forget(list(_OPEN))


@contextmanager
def released() -> Iterator[None]:
    """Deletes, at its end, every workspace opened within; what is to stay must be written elsewhere by then."""
    before = set(_OPEN)
    try:
        yield
    finally:
        _forget([path for path in _OPEN if path not in before])


def shared_root(spark: SparkSession) -> str:
    """Folder for scratch tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    single-process session (tests) gets a temporary folder and any other session
    the warehouse, if that is not a folder of one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        if not _LOCAL_ROOT:
            _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="tessella-"))
            _OPEN[_LOCAL_ROOT[0]] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
        return _LOCAL_ROOT[0]
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if urlsplit(warehouse).scheme in ("", "file"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: the warehouse is a local folder")
    return f"{warehouse}/_scratch"


def steady_batches(spark: SparkSession, rows: int = 512, size: int = 4 << 20) -> None:
    """Lowers the session's limits for batches, where they are higher.

    Texts and vectors have any length, and a batch is held several times over on
    its way through Python, so the default of 10,000 rows does not bound memory.
    A scan fills vectors of 4,096 rows by default, one large array for each column.
    """
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size, "spark.sql.parquet.columnarReaderBatchSize": rows}
    for key, most in limits.items():
        now = spark.conf.get(key, str((1 << 31) - 2))  # as if unlimited where it is unset
        if now.isdigit() and int(now) > most:
            spark.conf.set(key, str(most))


class Workspace:
    """Named scratch tables of one operator call, deleted when the process ends unless that is done before."""

    def __init__(self, spark: SparkSession, name: str):
        steady_batches(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._jvm = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
        _OPEN[self.root] = self._jvm
        self._n = 0
        self._tables: list[DataFrame] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table read back, with the same schema."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessella_path = path
        self._tables.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this workspace that no later plan reads."""
        for table in tables:
            _delete(table._tessella_path, *self._jvm)
            self._tables = [t for t in self._tables if t is not table]

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` as the one table that stays of this workspace."""
        before = list(self._tables)
        out = self.save(df, "result")
        self.drop(*before)
        return out
