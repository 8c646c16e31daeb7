"""Rows that must not go without a word."""

import pytest
from pyspark.sql import functions as F

from mlframes.operators import metrics
from mlframes.operators.encode import Prep
from mlframes.operators.raster import wide
from mlframes.sources import tables


def test_json_lines_and_documents(spark, tmp_path):
    spark.range(100).repartition(4).write.json(f"{tmp_path}/lines.json")
    assert tables.read_table(spark, f"{tmp_path}/lines.json").count() == 100
    (tmp_path / "array.json").write_text('[\n {"id": 1},\n {"id": 2}\n]')
    assert tables.read_table(spark, f"{tmp_path}/array.json").count() == 2


def test_null_is_a_class(frame):
    df = frame([("a", "a"), (None, "a"), ("b", None)], "t string, p string")
    out = metrics.confusion_matrix(df, "t", "p")
    assert out.select(F.sum("n")).first()[0] == 3 and out.count() == 9


def test_fewer_ranks_than_segments(frame):
    ranked = frame([("x", r, float(r)) for r in (1, 2, 3)], f"filename string, {wide.RANK} int, v double")
    with pytest.raises(ValueError, match="3 segments"):
        wide.pivot_segments(ranked, 2)
    assert wide.pivot_segments(ranked, 4).columns[-1] == "v_seg_4"


def test_bad_number_at_scoring(frame):
    prep = Prep.fit(frame([(i, str(i)) for i in range(30)], "id int, v string"), id_col="id", threshold=5)
    assert prep.transform(frame([(1, " 7 "), (2, None), (3, "")], "id int, v string")).count() == 3
    with pytest.raises(Exception, match="was numeric when fitted"):
        prep.transform(frame([(1, "oops")], "id int, v string")).collect()
