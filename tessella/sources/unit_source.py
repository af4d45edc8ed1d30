"""Transform files as a splittable source: their units have a fixed size, so any range of them can be read alone.

    read_units(spark, folder).where("unit between 40 and 80")

A partition is a range of bytes of one file, so a large file spreads over tasks.
Conditions on ``unit`` and ``image_id`` are pushed to the source: ranges outside of them are not
read, and a range that they cut is read from its first to its last wanted unit. Heads
of all files, 64 bytes each, are read by the driver when partitions are planned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tessella.sources.dct_file import HEAD, MAGIC

SCHEMA = "image_id string, unit bigint, head binary, record binary"
#: Units of a partition, unless the option ``units`` says otherwise, and of a batch.
UNITS, BATCH = 1 << 14, 1 << 10


@dataclass
class UnitRange(InputPartition):
    path: str
    image_id: str
    size: int
    first: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that every executor reaches."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class UnitReader(DataSourceReader):
    def __init__(self, path: str, units: int):
        self.path, self.units = path, units
        self.low, self.high, self.some, self.images = 0, 1 << 62, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what it can apply in full and gives the rest back."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "unit" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif name == "unit" and isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            elif name == "unit" and isinstance(f, EqualTo | In):
                values = set(f.value if isinstance(f, In) else [f.value])
                self.some = values if self.some is None else self.some & values
            elif name == "image_id" and isinstance(f, EqualTo | In):
                values = set(f.value if isinstance(f, In) else [f.value])
                self.images = values if self.images is None else self.images & values
            else:
                yield f

    def partitions(self) -> list[UnitRange]:
        system, root = opened(self.path)
        low, high = self.low, self.high
        if self.some is not None:
            low, high = max(low, min(self.some, default=0)), min(high, max(self.some, default=-1) + 1)
        out = []
        for file in sorted(system.get_file_info(fs.FileSelector(root)), key=lambda f: f.path):
            name = file.base_name.rpartition(".")[0]
            if file.type != fs.FileType.File or file.base_name[0] in "._" or (self.images is not None and name not in self.images):
                continue
            with system.open_input_file(file.path) as stream:
                head = stream.read(HEAD)
            if len(head) < HEAD or head[:8] != MAGIC:
                raise ValueError(f"{file.path} is not a transform image")
            across, down, size = (int.from_bytes(head[k : k + 4], "little") for k in (24, 28, 32))
            if file.size < HEAD + across * down * size:
                raise ValueError(f"{file.path} is shorter than its head says")
            first, end = max(0, low), min(across * down, high)
            out += [UnitRange(file.path, name, size, a, min(a + self.units, end)) for a in range(first, end, self.units)]
        return [p for p in out if self.some is None or any(p.first <= u < p.end for u in self.some)]

    def read(self, partition: UnitRange | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, UnitRange):  # what Spark hands over where there is no partition
            return
        system, _ = opened(self.path)
        p = partition
        with system.open_input_file(p.path) as stream:
            head = stream.read(HEAD)
            for a in range(p.first, p.end, BATCH):
                n = min(BATCH, p.end - a)
                stream.seek(HEAD + a * p.size)
                data = stream.read(n * p.size)
                wanted = [i for i in range(n) if self.some is None or a + i in self.some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p.image_id] * len(wanted), pa.string()), pa.array([a + i for i in wanted], pa.int64()), pa.array([head] * len(wanted), pa.binary()), pa.array([data[i * p.size : (i + 1) * p.size] for i in wanted], pa.binary())],
                    names=["image_id", "unit", "head", "record"],
                )


class UnitSource(DataSource):
    """Options: path, a folder of files whose names without ending are the images; units, of a partition."""

    @classmethod
    def name(cls) -> str:
        return "transform_units"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> UnitReader:
        return UnitReader(self.options["path"], int(self.options.get("units", UNITS)))


def read_units(spark: SparkSession, path: str, units: int = UNITS) -> DataFrame:
    """image_id, unit, head and record of the files in a folder, ``units`` of them in a partition at most.

    Registers the source and lets this session push conditions to sources in Python.
    """
    spark.dataSource.register(UnitSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("transform_units").option("path", path).option("units", units).load()
