"""Image files, manifests and record logs as DataFrames, and back.

Files are read whole by Spark's ``binaryFile`` source, so any store that Spark
reaches will do; each file is decoded in one task. Fixed-rate transform images
are the exception: their units are cut out by position and decoded in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators.sampling import last_wins
from tessella.sources import adaptive_file, containers, dct_file, hybrid_file, jpeg, mip_file, palette_file, pattern_file

PIXELS = "image_id string, y int, x int, r int, g int, b int"
RECORD = "imageId string, profileId string, dataset string, imageClass string, width int, height int, pixelCount bigint, payloadBytes bigint, artifactBytes bigint, squaredErrorRgb double, rgbSampleCount bigint, encodeMilliseconds double, decodeMilliseconds double"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """image_id (the file's name without its ending), path, length and content of all matching files below ``path``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("image_id"), "path", "length", "content")


def corpus(spark: SparkSession, path: str, pattern: str, classes: dict[str, str], expected: int | None = None) -> DataFrame:
    """files with their class: the folder's name, or the class that ``classes`` gives for the name's last part.

    Fails if the number of files is not the expected one.
    """
    found = files(spark, path, pattern).drop("content")
    folder, suffix = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.lower(F.regexp_extract("image_id", r"_([^_]+)$", 1))
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in classes.items() for v in kv]), suffix), folder) if classes else folder
    out = found.withColumn("image_class", named)
    if expected is not None and (n := found.count()) != expected:
        raise ValueError(f"{n} files instead of {expected}")
    return out


def manifest(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """One row of JSON: the sorted names of the files, the first one as default."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    listed = names.agg(F.array_sort(F.collect_list("name")).alias("files"))
    return listed.select(F.to_json(F.struct(F.get("files", F.lit(0)).alias("default"), "files")).alias("manifest"))


def manifest_lines(spark: SparkSession, path: str, pattern: str, out: str) -> DataFrame:
    """The manifest as JSON lines below ``out``, in the order of names over its files: name and whether it is the default, the first.

    Each task writes a range of names, so a folder of any number of files has one.
    """
    names = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    first = names.agg(F.min("name").alias("first"))
    marked = names.crossJoin(F.broadcast(first)).select("name", (F.col("name") == F.col("first")).alias("is_default"))  # one row
    marked.repartitionByRange("name").sortWithinPartitions("name").write.json(out)
    return spark.read.schema("name string, is_default boolean").json(out)


ENTRY = "id string, path string, class string, transfer string"


def image_list(spark: SparkSession, path: str, wanted: list[str] | DataFrame | None = None, lines: bool = False) -> DataFrame:
    """The entries of a JSON manifest's ``images``, with all ids known and unique.

    With ``lines`` there is an entry on each line, and lists of any length are read by
    many tasks. ``wanted``, ids or a relation of column id, chooses entries.
    """
    if lines:
        images = spark.read.schema(ENTRY).option("mode", "FAILFAST").json(path)
    else:
        images = spark.read.schema(f"images array<struct<{ENTRY.replace(' string', ':string')}>>").json(path, multiLine=True).select(F.explode("images").alias("i")).select("i.*")
    twice = images.groupBy("id").count().where("count > 1 or id is null").limit(1).collect()
    if twice:
        raise ValueError("ids are not unique")
    if wanted is None:
        return images
    asked = wanted.select("id") if isinstance(wanted, DataFrame) else spark.createDataFrame([(w,) for w in wanted], "id string")
    missing = asked.join(images, "id", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"unknown id {missing[0]['id']}")
    return images.join(asked, "id", "left_semi")


def record_log(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Records of JSON lines, the last one of each (imageId, profileId). Lines are ordered within a file."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    numbered = rows.withColumn("_line", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    return last_wins(numbered, ["imageId", "profileId"], "_line").drop("_line")


def _rows(image_ids: list, images: list[np.ndarray]) -> pa.RecordBatch:
    ys, xs = zip(*[np.divmod(np.arange(i.shape[0] * i.shape[1]), i.shape[1]) for i in images], strict=True) if images else ((), ())
    rgb = np.concatenate([i[..., :3].reshape(-1, 3) for i in images]) if images else np.zeros((0, 3), dtype=np.uint8)
    names = np.repeat(np.arange(len(images)), [i.shape[0] * i.shape[1] for i in images])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0)
    return pa.RecordBatch.from_arrays(
        [pa.array(image_ids, pa.string()).take(pa.array(names))] + [pa.array(v.astype(np.int32)) for v in (join(ys), join(xs), rgb[:, 0], rgb[:, 1], rgb[:, 2])],
        names=["image_id", "y", "x", "r", "g", "b"],
    )


def decode(data: bytes) -> np.ndarray:
    """(height, width, 3) bytes of any file of this package, told by its first bytes."""
    if data[:2] == b"P6":
        return containers.read_ppm(data)
    if data[:4] == b"\x89PNG":
        return containers.read_png(data)
    if data[:2] == b"\xff\xd8":
        return jpeg.pixels(jpeg.parse(data))
    readers: dict[bytes, Callable] = {
        palette_file.MAGIC: lambda d: palette_file.decode(d).pixels(),
        mip_file.MAGIC: lambda d: mip_file.decode(d)[0].pixels(),
        adaptive_file.MAGIC: lambda d: adaptive_file.Adaptive(d).pixels(),
        pattern_file.MAGIC: lambda d: pattern_file.Patterned(d).image().pixels(),
        hybrid_file.MAGIC: lambda d: hybrid_file.pixels(hybrid_file.decode(d)),
        dct_file.MAGIC[:4]: lambda d: dct_file.Transformed(d).pixels(),
    }
    if data[:4] not in readers:
        raise ValueError("unknown kind of file")
    return readers[data[:4]](data)


def pixels(images: DataFrame) -> DataFrame:
    """image_id, y, x, r, g, b of files (image_id, content), one image at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _rows([name], [decode(data)])

    return images.select("image_id", "content").mapInArrow(run, PIXELS)


def raw_pixels(images: DataFrame, width: int, height: int | Column) -> DataFrame:
    """pos, y, x and r, g, b, a of headerless RGBA files, without Python: bytes are taken out by position.

    ``height`` is one number or a column of ``images``.
    """
    if width < 1 or (isinstance(height, int) and height < 1):
        raise ValueError("bad dimensions")
    lines = F.lit(height) if isinstance(height, int) else height.cast("int")
    fits = F.when(F.length("content") == lines * (width * 4), F.col("content")).otherwise(F.raise_error(F.lit("the size of the file does not match the dimensions")).cast("binary"))
    each = images.select("image_id", fits.alias("content"), F.explode(F.sequence(F.lit(0), lines - 1)).alias("y"))
    rows = each.select("image_id", "y", F.hex(F.substring("content", F.col("y") * (width * 4) + 1, F.lit(width * 4))).alias("h"))
    cells = rows.select("image_id", "y", "h", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    byte: Callable[[int], Column] = lambda k: F.conv(F.substring("h", F.col("x") * 8 + (1 + 2 * k), F.lit(2)), 16, 10).cast("int")
    return cells.select("image_id", (F.col("y") * width + F.col("x")).cast("long").alias("pos"), "y", "x", *[byte(k).alias(c) for k, c in enumerate("rgba")])


def sample_points(images: DataFrame, points: DataFrame) -> DataFrame:
    """image_id, x, y, r, g, b: single pixels (image_id, x, y) of palette files, read from their own fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            found = []
            for data, xs, ys in zip(rows["content"], rows["xs"], rows["ys"], strict=True):
                at = pattern_file.sampler(data)
                found.append([at(x, y) for x, y in zip(xs, ys, strict=True)])
            flat = [v for one in found for v in one]
            owner = [i for i, one in enumerate(found) for _ in one]
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array([x for xs in rows["xs"] for x in xs], pa.int32()), pa.array([y for ys in rows["ys"] for y in ys], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([v[k] for v in flat], pa.int32()) for k in range(3)], names=["image_id", "x", "y", "r", "g", "b"])

    asked = points.groupBy("image_id").agg(F.collect_list(F.struct("x", "y")).alias("p"))
    both = images.select("image_id", "content").join(asked, "image_id").select("image_id", "content", F.transform("p", lambda p: p["x"].cast("int")).alias("xs"), F.transform("p", lambda p: p["y"].cast("int")).alias("ys"))
    return both.mapInArrow(run, "image_id string, x int, y int, r int, g int, b int")


def transform_units(images: DataFrame) -> DataFrame:
    """image_id, unit, head and record bytes of transform files, cut out by position so that units spread over tasks."""
    little = lambda k: F.expr(" + ".join(f"cast(conv(hex(substring(content, {9 + 4 * k + i}, 1)), 16, 10) as bigint) * {256**i}" for i in range(4)))
    sized = images.select("image_id", "content", (little(4) * little(5)).alias("units"), little(6).cast("int").alias("size"))
    each = sized.withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)))
    record = F.substring("content", (F.col("unit") * F.col("size") + (dct_file.HEAD + 1)).cast("int"), F.col("size"))
    return each.select("image_id", "unit", F.substring("content", 1, dct_file.HEAD).alias("head"), record.alias("record"))


def decode_units(units: DataFrame) -> DataFrame:
    """Pixels of units without a prototype library; partial units at the edge are clipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("name", "y", "x", "rgb")}
            for row in batch.to_pylist():
                head = bytearray(row["head"])
                width, height, across = (int.from_bytes(head[k : k + 4], "little") for k in (16, 20, 24))
                head[16:24] = (16).to_bytes(4, "little") * 2  # an image of this one unit
                head[24:32] = (1).to_bytes(4, "little") * 2
                head[56:60] = len(row["record"]).to_bytes(4, "little")
                rgb = dct_file.Transformed(bytes(head) + row["record"]).unit(0)
                y, x = np.divmod(np.arange(256), 16)
                y, x = y + row["unit"] // across * 16, x + row["unit"] % across * 16
                keep = (y < height) & (x < width)
                out["name"] += [row["image_id"]] * int(keep.sum())
                for c, v in (("y", y[keep]), ("x", x[keep]), ("rgb", rgb.reshape(-1, 3)[keep])):
                    out[c].append(v)
            rgb = np.concatenate(out["rgb"]) if out["rgb"] else np.zeros((0, 3))
            join = lambda c: pa.array(np.concatenate(out[c]).astype(np.int32)) if out[c] else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(out["name"], pa.string()), join("y"), join("x"), *[pa.array(rgb[:, k].astype(np.int32)) for k in range(3)]], names=["image_id", "y", "x", "r", "g", "b"])

    return units.mapInArrow(run, PIXELS)


def packed(px: DataFrame, image_id: str = "image_id") -> DataFrame:
    """image_id, width, height and rgba bytes of pixel rows: one row for each line first, then one for each image."""
    byte = lambda c: F.lpad(F.hex(F.col(c).cast("long")), 2, "0")
    cell = F.struct("x", F.concat(byte("r"), byte("g"), byte("b"), byte("a") if "a" in px.columns else F.lit("FF")).alias("h"))
    lines = px.groupBy(image_id, "y").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    line = lines.select(F.col(image_id).alias("image_id"), F.struct("y", F.array_join(F.transform("c", lambda c: c["h"]), "").alias("h")).alias("line"), F.size("c").alias("width"))
    whole = line.groupBy("image_id").agg(F.max("width").alias("width"), F.count("*").cast("int").alias("height"), F.array_sort(F.collect_list("line")).alias("lines"))
    return whole.select("image_id", "width", "height", F.unhex(F.array_join(F.transform("lines", lambda x: x["h"]), "")).alias("rgba"))


def spread(images: DataFrame, *keys: str) -> DataFrame:
    """Images dealt to at least four tasks for each core.

    Their rows are few and small next to the work on them, so that Spark would
    otherwise put them together by size. They are dealt by a hash of ``keys``, as
    Spark leaves out a repartition by the keys themselves after a grouping by them.
    """
    spark = images.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return images.repartition(tasks, F.xxhash64(*keys))


def write_files(encoded: DataFrame, path: str, ending: str) -> None:
    """Writes each row (image_id, data) to its own file below ``path``, a folder or URI that every executor reaches.

    Executors write the files themselves; a repeated task writes the same files again.
    """

    def write(rows: Iterator) -> None:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        system.create_dir(root, recursive=True)
        for row in rows:
            with system.open_output_stream(f"{root}/{row['image_id']}{ending}") as stream:
                stream.write(bytes(row["data"]))

    encoded.select("image_id", "data").foreachPartition(write)


def write_report(aggregate: DataFrame, path: str, columns: list[str]) -> None:
    """An aggregate as JSON and CSV folders and, beside them, as a Markdown table."""
    from tessella.operators.reports import markdown

    spark = aggregate.sparkSession
    aggregate.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    aggregate.select(*columns).coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    lines = spark.createDataFrame([(i, line) for i, line in enumerate(markdown(aggregate, columns))], "n int, value string")
    lines.orderBy("n").select("value").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")


def mip_progression(levels: DataFrame) -> DataFrame:
    """Levels (image_id, mip, width, height, block) that do not halve the one before; must be empty."""
    before = Window.partitionBy("image_id").orderBy("mip")
    wrong = None
    for c in ("width", "height", "block"):
        last = F.lag(c).over(before)
        test = last.isNotNull() & (F.col(c) != F.greatest(F.lit(1), F.floor(last / 2)))
        wrong = test if wrong is None else wrong | test
    return levels.withColumn("_wrong", wrong).where("_wrong").drop("_wrong")


def jpeg_blocks(images: DataFrame) -> DataFrame:
    """image_id, component, by, bx and coefficients (dequantised, natural order) of JPEG files (image_id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image = jpeg.parse(data)
                for k, part in enumerate(image.components):
                    by, bx = np.divmod(np.arange(part.rows * part.columns), part.columns)
                    values = image.dequantised(k).reshape(-1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(by) + 1, dtype=np.int32) * 64), pa.array(values.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(by), pa.string()), pa.array(np.full(len(by), k, dtype=np.int32)), pa.array(by.astype(np.int32)), pa.array(bx.astype(np.int32)), lists], names=["image_id", "component", "by", "bx", "coefficients"])

    return images.select("image_id", "content").mapInArrow(run, "image_id string, component int, by int, bx int, coefficients array<int>")


def palette_relations(images: DataFrame) -> dict[str, DataFrame]:
    """The parts of palette files (image_id, content) as relations.

    palette: image_id, pal, idx, r, g, b; selector: image_id, block, pal;
    block_table: image_id, block, slot, idx; pixel_index: image_id, y, x, slot.
    """

    def part(which: str, schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    i = palette_file.decode(data)
                    arrays = {"palette": i.palette[..., 0], "selector": i.selectors, "block_table": i.table, "pixel_index": i.slots()}
                    values = np.asarray(arrays[which])
                    places = np.unravel_index(np.arange(values.size), values.shape)
                    columns = [*places, *(i.palette[..., k].ravel() for k in range(3))] if which == "palette" else [*places, values.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * values.size, pa.string())] + [pa.array(v.astype(np.int32)) for v in columns], names=[f.split()[0] for f in schema.split(", ")])

        return images.select("image_id", "content").mapInArrow(run, schema)

    return {
        "palette": part("palette", "image_id string, pal int, idx int, r int, g int, b int"),
        "selector": part("selector", "image_id string, block int, pal int"),
        "block_table": part("block_table", "image_id string, block int, slot int, idx int"),
        "pixel_index": part("pixel_index", "image_id string, y int, x int, slot int"),
    }
