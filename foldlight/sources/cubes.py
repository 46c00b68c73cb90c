"""Image cubes and image files as pixel tables; their headers, sizes and repairs."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header type codes and their number formats; any other code is float32.
TYPES = {1: "uint8", 2: "int16", 3: "int32", 4: "float32", 5: "float64", 12: "uint16", 13: "uint32"}


def find_headers(spark: SparkSession, root: str) -> DataFrame:
    """(leaf_dir, path): the first .hdr, in sorted order, of each `results` folder's parent."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.hdr").load(root).select("path", "length")
    leaf = F.regexp_extract("path", r"^(.*)/results/[^/]*$", 1)
    return files.withColumn("leaf_dir", leaf).where(F.col("leaf_dir") != "").groupBy("leaf_dir").agg(F.min("path").alias("path"))


def parse_headers(files: DataFrame) -> DataFrame:
    """(path, samples, lines, bands, dtype, interleave, wavelengths) from (path, content)."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"(?m)^\s*;.*$", "")

    def value(key: str) -> Column:
        return F.trim(F.regexp_extract(text, rf"(?im)^\s*{key}\s*=\s*([^\{{\r\n]*)", 1))

    code = value("data type").try_cast("int") if hasattr(Column, "try_cast") else value("data type").cast("int")
    kind = F.coalesce(F.get(F.array(*(F.lit(TYPES.get(i, "float32")) for i in range(16))), F.coalesce(code, F.lit(0))), F.lit("float32"))
    waves = F.regexp_extract(text, r"(?is)wavelength\s*=\s*\{([^}]*)\}", 1)
    numbers = F.transform(F.filter(F.split(waves, r"[,\s]+"), lambda w: w != ""), lambda w: w.cast("double"))
    return files.select("path", *(value(k).cast("int").alias(k) for k in ("samples", "lines", "bands")), kind.alias("dtype"), F.lower(F.coalesce(F.nullif(value("interleave"), F.lit("")), F.lit("bil"))).alias("interleave"), numbers.alias("wavelengths"))


def repaired_shape(total: Column, bands: Column, lines: Column, samples: Column) -> Column:
    """Struct (lines, samples): the header's, or where total values don't fit it, the square or the most square
    split of total / bands; null if total isn't divisible by bands."""
    n = F.floor(F.try_divide(total, bands))
    side = F.floor(F.sqrt(n)).cast("long")
    best = F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), F.greatest(side, F.lit(1).cast("long"))), lambda d: n % d == 0))
    fits = total == lines.cast("long") * samples * bands
    return F.when(fits, F.struct(lines.cast("long").alias("lines"), samples.cast("long").alias("samples"))).when(total % bands == 0, F.struct(best.alias("lines"), F.floor(n / best).alias("samples")))


def size_is_valid(length: Column, bands: int = 204, lines: int = 512, samples: int = 512, item: int = 4) -> Column:
    """The exact size of a whole cube, or a multiple of one pixel's bytes."""
    return (length == lines * samples * bands * item) | ((length > 0) & (length % (bands * item) == 0))


def cube_view(data: bytes, dtype: str, interleave: str, lines: int, samples: int, bands: int) -> np.ndarray:
    """(lines, samples, bands) over the file's own bytes; nothing is copied."""
    flat = np.frombuffer(data, dtype)
    if interleave == "bsq":
        return flat.reshape(bands, lines, samples).transpose(1, 2, 0)
    if interleave == "bip":
        return flat.reshape(lines, samples, bands)
    return flat.reshape(lines, bands, samples).transpose(0, 2, 1)


PIXELS = "image string, row int, col int, spectrum array<float>"
#: Pixels that leave a task at once.
PIXEL_ROWS = 4096
GREY_ROWS = 1 << 16


def pixel_blocks(image: str, cube: np.ndarray, mask: np.ndarray | None = None, first: int = 0) -> Iterator[pd.DataFrame]:
    """Pixel rows of a cube whose first line is number `first`, some lines at a time."""
    step = max(1, PIXEL_ROWS // max(1, cube.shape[1]))
    for at in range(0, cube.shape[0], step):
        part = cube[at : at + step].astype(np.float32)
        rows, cols = np.divmod(np.arange(part.shape[0] * part.shape[1]), part.shape[1])
        out = pd.DataFrame({"image": image, "row": (rows + at + first).astype(np.int32), "col": cols.astype(np.int32), "spectrum": list(part.reshape(len(rows), -1))})
        yield out if mask is None else out.assign(in_mask=mask[at : at + step].ravel())


def item_size(dtype: Column) -> Column:
    return F.when(dtype == "uint8", 1).when(dtype.isin("int16", "uint16"), 2).when(dtype == "float64", 8).otherwise(4)


#: Bytes of a cube that a task reads at once.
TASK_BYTES = 32 << 20


def cube_ranges(cubes: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(image, path, dtype, interleave, lines, samples, bands, first, n): ranges of lines of cubes (image, path, length,
    dtype, interleave, lines, samples, bands) of about task_bytes each. length is the file's, its shape is repaired by
    repaired_shape(); cubes that can't be are left out."""
    item = item_size(F.col("dtype"))
    shape = repaired_shape(F.floor(F.col("length") / item), F.col("bands"), F.col("lines"), F.col("samples"))
    shaped = cubes.withColumn("_s", shape).where(F.col("_s").isNotNull() & (F.col("_s.lines") > 0)).withColumns({"_lines": F.col("_s.lines"), "_samples": F.col("_s.samples")})
    step = F.greatest(F.lit(1).cast("long"), F.floor(task_bytes / (F.col("_samples") * F.col("bands") * item)))
    each = shaped.withColumn("_step", step).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lines") - 1, F.col("_step"))))
    return each.select("image", "path", "dtype", "interleave", F.col("_lines").alias("lines"), F.col("_samples").alias("samples"), "bands", "first", F.least(F.col("_step"), F.col("_lines") - F.col("first")).alias("n"))


def read_range(path: str, dtype: str, interleave: str, lines: int, samples: int, bands: int, first: int, n: int) -> np.ndarray:
    """(n, samples, bands) of a range of lines: one range of bytes, or one for each band of a bsq file. Any store that
    pyarrow knows by the path's scheme is read."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))
    line = samples * np.dtype(dtype).itemsize
    with store.open_input_file(name) as file:
        if interleave == "bsq":
            data = b"".join(file.read_at(n * line, (b * lines + first) * line) for b in range(bands))
        else:
            data = file.read_at(n * line * bands, first * line * bands)
    return cube_view(data, dtype, interleave, n, samples, bands)


def read_cubes(cubes: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Pixel rows of cube files (see cube_ranges()), each task a range of lines: cubes may be larger than a row or a
    task's memory."""
    ranges = cube_ranges(cubes, task_bytes)
    many = ranges.count()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                yield from pixel_blocks(r.image, read_range(r.path, r.dtype, r.interleave, int(r.lines), int(r.samples), int(r.bands), int(r.first), int(r.n)), first=int(r.first))

    # few rows with much work each: a partition for each, up to some for each core
    return ranges.repartition(max(1, min(many, 16 * cubes.sparkSession.sparkContext.defaultParallelism))).mapInPandas(run, PIXELS)


def read_pixels(cubes: DataFrame) -> DataFrame:
    """Pixel rows of (image, content, dtype, interleave, lines, samples, bands); one image's bytes and a block of
    its pixels in memory at a time. Sizes that don't fit are repaired by repaired_shape(); cubes that can't be are
    left out."""
    item = item_size(F.col("dtype"))
    shaped = cubes.withColumn("shape", repaired_shape(F.floor(F.length("content") / item), F.col("bands"), F.col("lines"), F.col("samples"))).where(F.col("shape").isNotNull())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                yield from pixel_blocks(r.image, cube_view(r.content, r.dtype, r.interleave, int(r.lines_), int(r.samples_), int(r.bands)))

    return shaped.select("image", "content", "dtype", "interleave", "bands", F.col("shape.lines").alias("lines_"), F.col("shape.samples").alias("samples_")).mapInPandas(run, PIXELS)


def read_npz(files: DataFrame) -> DataFrame:
    """(image, row, col, spectrum, in_mask) of npz files (path, content) with `data` (bands, height, width) and `mask`."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                with np.load(io.BytesIO(r.content)) as z:
                    data, mask = z["data"], z["mask"].astype(bool)
                yield from pixel_blocks(r.path, data.transpose(1, 2, 0), mask if mask.ndim == 2 else mask.any(axis=0))

    return files.select("path", "content").mapInPandas(run, f"{PIXELS}, in_mask boolean")


def read_band_images(spark: SparkSession, root: str, bands: int = 6) -> DataFrame:
    """(set, image, band, grey bytes) of IMG_<id>_<band>.png files; only images with all bands."""
    files = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "IMG_*_*.png").option("dropInvalid", "true").load(root)
    named = files.select(F.regexp_extract("image.origin", r"([^/]+)/IMG_\d+_\d+\.png$", 1).alias("set"), F.regexp_extract("image.origin", r"IMG_(\d+)_\d+\.png$", 1).alias("image"), F.regexp_extract("image.origin", r"_(\d+)\.png$", 1).cast("int").alias("band"), "image.data", "image.nChannels")
    whole = named.groupBy("set", "image").agg(F.count("*").alias("n")).where(F.col("n") == bands).drop("n")
    return named.join(whole, ["set", "image"], "left_semi")


#: 16-bit weights of blue, green and red in a grey value.
LUMA = np.array([7471, 38470, 19595])


def grey_values(data: bytes, channels: int) -> np.ndarray:
    """Whole grey numbers from an image's bytes: one channel as it is, three or four (blue, green, red, opacity) weighted
    and rounded."""
    values = np.frombuffer(data, np.uint8).reshape(-1, channels)
    return values[:, 0] if channels == 1 else (values[:, :3].astype(np.int64) @ LUMA + (1 << 15) >> 16).astype(np.uint8)


def grey_pixels(images: DataFrame) -> DataFrame:
    """(set, image, band, value): a row for each pixel of read_band_images(), some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                values = grey_values(one.column("data")[0].as_py(), one.column("nChannels")[0].as_py()).astype(float)
                for at in range(0, len(values), GREY_ROWS):
                    part = values[at : at + GREY_ROWS]
                    where = pa.array(np.zeros(len(part), np.int64))
                    yield pa.RecordBatch.from_arrays([*(one.column(c).take(where) for c in ("set", "image", "band")), pa.array(part)], ["set", "image", "band", "value"])

    return images.select("set", "image", "band", "data", "nChannels").where(F.col("data").isNotNull() & (F.length("data") > 0)).mapInArrow(run, "set string, image string, band int, value double")
