"""Images to pixel tables."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_BANDS = ["blue", "green", "red", "nir"]
_SCHEMA = "filename string, `row` int, `col` int, blue double, green double, red double, nir double"
_ROWS = 64  # image lines per batch
_PIXELS = 1 << 16  # pixels of raw images per batch


def _pixels(filename: str, image: np.ndarray) -> Iterator[pd.DataFrame]:
    """Some image lines at a time, so a large image does not double in memory."""
    height, width = image.shape[:2]
    for top in range(0, height, _ROWS):
        part = image[top:top + _ROWS]
        rows, cols = np.mgrid[top:top + len(part), 0:width].astype(np.int32)
        bands = {b: part[:, :, i].ravel().astype(float) if i < part.shape[2] else np.full(part[:, :, 0].size, np.nan)
                 for i, b in enumerate(_BANDS)}
        yield pd.DataFrame({"filename": filename, "row": rows.ravel(), "col": cols.ravel(), **bands})


def _without_nan(df: DataFrame) -> DataFrame:
    return df.withColumns({b: F.when(~F.isnan(b), F.col(b)) for b in _BANDS})


def pixels_from_images(spark: SparkSession, path: str) -> DataFrame:
    """One row per pixel of every readable image under a path. Bytes come as blue, green, red and, in a
    four-channel image, a fourth band taken as near infrared. ``failed_images`` lists the others."""
    images = spark.read.format("image").option("dropInvalid", True).load(path).select(
        F.element_at(F.split("image.origin", "/"), -1).alias("filename"), "image.height", "image.width",
        "image.nChannels", "image.data")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for g in pdf.itertuples(index=False):
                image = np.frombuffer(g.data, dtype=np.uint8).reshape(g.height, g.width, g.nChannels)
                yield from _pixels(g.filename, image)

    return _without_nan(images.mapInPandas(run, _SCHEMA))


def failed_images(spark: SparkSession, path: str) -> DataFrame:
    """(filename) of the files that are no readable image."""
    read = spark.read.format("image").load(path)
    return read.where("image.height <= 0").select(F.element_at(F.split("image.origin", "/"), -1).alias("filename"))


def pixels_from_raw(spark: SparkSession, path: str, rows: int, cols: int, bands: int = 4, dtype: str = "<u2") -> DataFrame:
    """One row per pixel of raw band-interleaved arrays of a known shape, one file per image."""
    files = spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    return raw_pixels(files, rows, cols, bands, dtype)


def raw_pixels(files: DataFrame, rows: int, cols: int, bands: int = 4, dtype: str = "<u2") -> DataFrame:
    """The same from a table (filename, content). Small images share a batch, and a large one is cut into strips of lines."""
    size, at_once = rows * cols * bands * np.dtype(dtype).itemsize, max(1, _PIXELS // (rows * cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                contents = part.column(1).to_pylist()
                if any(len(c) != size for c in contents):
                    raise ValueError(f"an image of {rows} x {cols} x {bands} has {size} bytes")
                image = np.frombuffer(b"".join(contents), dtype=dtype).reshape(len(contents), rows, cols, bands)
                for top in range(0, rows, high := max(1, _PIXELS // cols)):
                    strip = image[:, top:top + high]
                    whose, row, col = (x.ravel() for x in np.indices(strip.shape[:3], np.int32))
                    values = [strip[..., i].ravel().astype(float) if i < bands else np.full(len(row), np.nan) for i in range(len(_BANDS))]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(whose)), pa.array(row + np.int32(top)), pa.array(col), *map(pa.array, values)],
                        names=["filename", "row", "col", *_BANDS])

    return _without_nan(files.select("filename", "content").mapInArrow(run, _SCHEMA))
