"""Readers, writers, images and streams."""

import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mlframes.operators.encode import Prep
from mlframes.plans.storage import shared_path, shared_root
from mlframes.sources import images, sinks, tables
from mlframes.streaming.score import score_stream


def png(path, pixels):
    """Write an 8-bit PNG of shape (rows, cols, 3 or 4), bands red, green, blue[, alpha]."""
    height, width, bands = pixels.shape
    raw = b"".join(b"\0" + line.astype(np.uint8).tobytes() for line in pixels)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 6 if bands == 4 else 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_become_pixels(spark, tmp_path):
    image = np.arange(5 * 3 * 4).reshape(5, 3, 4)
    png(tmp_path / "a.png", image)
    png(tmp_path / "b.png", image[:, :, :3] + 100)
    (tmp_path / "c.png").write_bytes(b"no image")
    px = images.pixels_from_images(spark, str(tmp_path))
    got = {(r["filename"], r["row"], r["col"]): r for r in px.collect()}
    assert len(got) == 30
    for (f, y, x), r in got.items():
        red, green, blue = image[y, x, :3] + (100 if f == "b.png" else 0)
        assert (r["red"], r["green"], r["blue"]) == (red, green, blue)
        assert r["nir"] == (image[y, x, 3] if f == "a.png" else None)
    assert [r[0] for r in images.failed_images(spark, str(tmp_path)).collect()] == ["c.png"]


def test_raw_arrays(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 65536, (130, 2, 4)).astype("<u2")
    (tmp_path / "x.raw").write_bytes(image.tobytes())
    px = images.pixels_from_raw(spark, str(tmp_path), 130, 2)
    got = {(r["row"], r["col"]): r["nir"] for r in px.collect()}
    assert got == {(y, x): image[y, x, 3] for y in range(130) for x in range(2)}


def test_csv_folder_matches_columns_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n3,4\n")
    (tmp_path / "c.csv").write_text("x,z\n5,6\n")
    (tmp_path / "d.csv").write_text("x,y\n7,8\n")
    out = sorted((r["x"], r["y"], r["z"]) for r in tables.read_csv_folder(spark, f"{tmp_path}/*.csv").collect())
    assert out == [(1, 2, None), (4, 3, None), (5, None, 6), (7, 8, None)]
    with pytest.raises(FileNotFoundError):
        tables.read_csv_folder(spark, f"{tmp_path}/none/*.csv")


def test_tables_by_suffix(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2\n")
    (tmp_path / "a.json").write_text('[{"x": 1, "y": "u"},\n {"x": 2}]')
    assert tables.read_table(spark, f"{tmp_path}/a.csv", sep=";").collect() == [(1, 2)]
    assert tables.read_table(spark, f"{tmp_path}/a.json").count() == 2
    with pytest.raises(ValueError):
        tables.read_table(spark, f"{tmp_path}/csv_notes.txt")


def test_missing_objects_are_reported(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    table, missing = tables.read_objects(spark, str(tmp_path), ["a.csv", "b.csv"])
    assert table.count() == 1 and missing == ["b.csv"]
    assert tables.read_objects(spark, str(tmp_path), ["b.csv"]) == (None, ["b.csv"])


def test_load(spark):
    assert tables.load(spark, np.eye(2)).columns == ["0", "1"]
    assert tables.load(spark, pd.DataFrame({"a": [1]})).collect() == [(1,)]
    with pytest.raises(TypeError):
        tables.load(spark, [1])
    df, features = tables.with_target(tables.load(spark, pd.DataFrame({"a": [1], "y": [2]})), "y")
    assert features == ["a"] and df.columns == ["a", "y"]
    with pytest.raises(ValueError):
        tables.with_target(df, "z")


def test_publish(spark, tmp_path):
    folder = sinks.publish({"results": spark.range(3)}, str(tmp_path), "20240101_000000")
    assert folder.endswith("model_20240101_000000") and spark.read.parquet(f"{folder}/results").count() == 3


def test_shared_folder_comes_from_the_session(spark):
    assert shared_path(spark, "x").startswith(shared_root(spark))
    if spark.conf.get("spark.checkpoint.dir", None):
        assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_preparation_runs_on_a_stream(spark, frame, tmp_path):
    df = frame([(i, f"c{i % 3}", float(i)) for i in range(30)], "id int, s string, v double")
    model = Prep.fit(df, id_col="id")
    df.where("id < 20").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    score_stream(stream, [model.transform], f"{tmp_path}/out", checkpoint=f"{tmp_path}/progress").awaitTermination()
    df.where("id >= 20").write.mode("append").parquet(f"{tmp_path}/in")
    score_stream(stream, [model.transform], f"{tmp_path}/out", checkpoint=f"{tmp_path}/progress").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 30 and got.exceptAll(model.transform(df)).count() == 0
    assert got.where(F.col("s_c0") > 0).count() == 10


def test_csv_folder_has_one_type_per_column(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("x,y,z,flag,day\n1,2,7,true,2024-01-02\n")
    (tmp_path / "b+c.csv").write_text("y,x,z,flag,day\n3.5,two,9999999999,False,2024-02-03\n")
    (tmp_path / "c.csv").write_text("x,z,y,flag,day\n,8,,,\n")
    out = tables.read_csv_folder(spark, f"{tmp_path}/*.csv")
    assert dict(out.dtypes) == {"x": "string", "y": "double", "z": "bigint", "flag": "boolean", "day": "date"}
    assert sorted((r["x"] or "", r["y"], r["z"]) for r in out.collect()) == [("", None, 8), ("1", 2.0, 7), ("two", 3.5, 9999999999)]


def test_json_files_of_both_forms(spark, tmp_path):
    folder = tmp_path / "t.json"
    folder.mkdir()
    (folder / "array.json").write_text("[\n" + ",\n".join('{"a": %d}' % i for i in range(50)) + "\n]")
    (folder / "lines.json").write_text("".join('{"a": %d, "b": "x"}\n' % i for i in range(50, 53)))
    assert sorted(r["a"] for r in tables.read_table(spark, str(folder)).collect()) == list(range(53))
