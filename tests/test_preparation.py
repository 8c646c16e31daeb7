"""Splits, encoding, statistics and column handling."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import MinMaxScaler
from pyspark.sql import functions as F

from mlframes.functions import nulls
from mlframes.operators import batches, columns, encode, split, stats


def labels(df):
    return {r["id"]: r["split"] for r in df.collect()}


def test_exact_split_sizes_and_layout(spark):
    df = spark.range(1003)
    first = labels(split.add_split(df, "id", mode="exact"))
    counts = {p: sum(v == p for v in first.values()) for p in ("Train", "Validation", "Test")}
    n_val = math.ceil(0.25 * 1003)
    n_test = math.ceil(0.1 / 0.75 * (1003 - n_val))
    assert counts == {"Validation": n_val, "Test": n_test, "Train": 1003 - n_val - n_test}
    assert first == labels(split.add_split(df.repartition(7).orderBy(F.desc("id")), "id", mode="exact"))
    assert first != labels(split.add_split(df, "id", mode="exact", seed=1))


def test_split_without_test_part(spark):
    out = labels(split.add_split(spark.range(40), "id", mode="exact", test_size=0))
    assert sorted(out.values()).count("Validation") == 10 and "Test" not in out.values()


@pytest.mark.parametrize("mode", ["hash", "exact"])
def test_groups_stay_together(frame, mode):
    df = frame([(i, None if i % 9 == 0 else i % 50) for i in range(900)], "id int, g int")
    out = split.add_split(df, "id", "g", mode=mode)
    assert out.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert out.count() == 900
    assert split.add_split(df, "id", "g", mode=mode, drop_null_groups=True).count() == 800


def test_existing_split_is_kept_only_when_valid(frame):
    good = frame([(1, "Train"), (2, "Train"), (3, "Validation")], "id int, split string")
    assert labels(split.add_split(good, "id")) == {1: "Train", 2: "Train", 3: "Validation"}
    bad = frame([(1, "Train"), (2, "x")], "id int, split string")
    assert "x" not in labels(split.add_split(bad, "id")).values()


def test_ttest_matches_the_textbook(frame):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 8.0, 10.0]
    df = frame([(v, True) for v in a] + [(v, False) for v in b] + [(None, True), (5.0, None)], "v double, c boolean")
    r = stats.ttest(df, "v", "c").first()
    pooled = (3 * np.var(a, ddof=1) + 4 * np.var(b, ddof=1)) / 7
    assert (r["n1"], r["n2"], r["df"]) == (4, 5, 7)
    assert r["t"] == pytest.approx((2.5 - 6) / math.sqrt(pooled * (1 / 4 + 1 / 5)))


@pytest.mark.parametrize("t, dof, p", [(2.228139, 10, 0.05), (12.7062, 1, 0.05), (0.0, 5, 1.0), (1.959964, 10 ** 6, 0.05),
                                       (-2.228139, 10, 0.05), (4.032143, 5, 0.01), (0.2, 3, 0.854336)])
def test_p_values(t, dof, p):
    assert stats.two_sided_p(np.array([t]), np.array([dof]))[0] == pytest.approx(p, rel=2e-4)


def test_ttest_of_one_row_has_no_p(frame):
    r = stats.ttest(frame([(1.0, True), (2.0, False)], "v double, c boolean"), "v", "c").first()
    assert r["t"] is None and r["p"] is None


def test_correlations_skip_missing_pairs(frame):
    df = frame([(1.0, 2.0, 1.0), (2.0, None, 5.0), (3.0, 6.0, float("nan")), (4.0, 8.5, 2.0)], "a double, b double, c double")
    out = {(r[0], r[1]): r[2] for r in stats.correlations(df, ["a", "b", "c"], None).collect()}
    assert out["a", "b"] == pytest.approx(np.corrcoef([1, 3, 4], [2, 6, 8.5])[0, 1])
    assert out["a", "c"] == pytest.approx(np.corrcoef([1, 2, 4], [1, 5, 2])[0, 1])
    assert len(out) == 6


def test_histogram_edges(frame):
    df = frame([(0.0, 9000.0), (300.0, 8999.0), (9000.1, -0.1), (None, 450.0)], "a double, b double")
    out = {r["bin"]: (r["n_a"], r["n_b"]) for r in stats.shared_histogram(df, ["a", "b"], 31).collect()}
    assert len(out) == 30 and out[0] == (1, 0) and out[1] == (1, 1) and out[29] == (0, 2)


def test_histogram2d_of_one_point(frame):
    out = stats.histogram2d(frame([(1.0, 2.0), (1.0, 2.0)], "x double, y double"), "x", "y", 3).collect()
    assert len(out) == 9 and sum(r["n"] for r in out) == 2


def test_trend_line_through_categories(frame):
    out = stats.trend_line(frame([("b", 3.0), ("a", 1.0), ("c", 5.0)], "x string, y double"), "x", "y").collect()
    assert {r["x"]: r["trend"] for r in out} == {"a": pytest.approx(1), "b": pytest.approx(3), "c": pytest.approx(5)}


def test_fit_band_holds_the_line(frame):
    rnd = random.Random(5)
    df = frame([(i, float(i), 2.0 * i + 1 + rnd.gauss(0, 5)) for i in range(500)], "k int, x double, y double")
    line = stats.fit_line(df, "x", "y").first()
    band = stats.fit_band(df, "x", "y", "k", points=5, replicates=200).collect()
    assert len(band) == 5
    for r in band:
        assert r["low"] <= r["fit"] <= r["high"] and r["high"] - r["low"] < 3
        assert r["fit"] == pytest.approx(line["intercept"] + line["slope"] * r["x"])


def test_shares_meet_on_the_category(frame):
    df = frame([("Train", "a")] * 3 + [("Train", "b")] + [("Test", "b")] * 2 + [("Test", "c"), ("Test", None)], "split string, c string")
    out = {r["category"]: (r["share_first"], r["share_second"]) for r in stats.category_shares(df, "c").collect()}
    assert out == {"a": (0.75, None), "b": (0.25, pytest.approx(2 / 3)), "c": (None, pytest.approx(1 / 3))}


def test_numeric_text(frame):
    df = frame([(" 1 ", "1d", "1", None, "x"), ("2e3", "2", None, None, "1")], "a string, b string, c string, d string, e string")
    assert encode.numeric_text_columns(df) == ["a", "c"]
    assert sorted(r["a"] for r in encode.to_numeric(df).collect()) == [1.0, 2000.0]


def test_onehot_nulls_and_booleans(frame):
    df = frame([(1, "x", True, "False"), (2, None, False, "y"), (3, "z", None, "y")], "id int, s string, b boolean, t string")
    out = encode.onehot_encode(df, 5).orderBy("id")
    assert out.columns == ["id", "s_x", "s_z", "t_False", "t_y", "b_True"]
    assert [tuple(r) for r in out.collect()] == [(1, 1, 0, 1, 0, 1), (2, 0, 0, 0, 1, 0), (3, 0, 1, 0, 1, 0)]


def test_onehot_threshold(frame):
    df = frame([("a", "p"), ("b", "p"), ("c", "q")], "s string, t string")
    assert encode.onehot_encode(df, 2).columns == ["s", "t_p", "t_q"]
    assert encode.distinct_counts(df).where("column = 's'").first()["n"] == 3


def test_codes_reject_or_number_unseen_values(frame):
    train, other = frame([("b",), ("a",), (None,)], "s string"), frame([("c",)], "s string")
    model = encode.Encoder.fit(train, -1)
    assert sorted(r[0] for r in model.transform(train).collect()) == [0, 1, 2]
    with pytest.raises(Exception, match="unseen value in s: c"):
        model.transform(other).collect()
    assert encode.Encoder.fit(train, -1, unseen=-9).transform(other).first()[0] == -9
    assert model.decode(model.transform(train), "s").where("s = 'b'").count() == 1


def test_prep_ignores_categories_absent_when_scoring(frame):
    train = frame([(1, "a", 1.0), (2, "b", 3.0), (3, None, None)], "id int, s string, v double")
    model = encode.Prep.fit(train, id_col="id")
    out = model.transform(frame([(9, "new", 3.0)], "id int, s string, v double"))
    assert out.columns == ["id", "v", "s_a", "s_b"]
    r = out.first()
    mean, std = 1.0, math.sqrt(((1 - 1) ** 2 + (3 - 1) ** 2 + (-1 - 1) ** 2) / 3)
    assert r["id"] == 9 and r["v"] == pytest.approx((3 - mean) / std)
    assert r["s_a"] == pytest.approx((0 - 1 / 3) / math.sqrt(2 / 9))


def test_prep_constant_column_and_own_scaler(frame):
    df = frame([(1, 5.0, 0.0), (2, 5.0, 4.0)], "id int, c double, v double")
    assert {r["c"] for r in encode.Prep.fit(df, id_col="id").transform(df).collect()} == {0.0}
    own = encode.Prep.fit(df, id_col="id", features=["v"], scaler=MinMaxScaler()).transform(df)
    assert {r["id"]: r["v"] for r in own.collect()} == {1: 0.0, 2: 1.0}


def test_prep_survives_saving(spark, frame, tmp_path):
    df = frame([(i, f"c{i % 20}", i % 2 == 0, str(i), None if i % 7 == 0 else float(i)) for i in range(60)],
               "id int, many string, flag boolean, num string, v double")
    model = encode.Prep.fit(df, id_col="id", threshold=5)
    model.save(spark, str(tmp_path))
    again = encode.Prep.load(spark, str(tmp_path))
    assert again.features == model.features == ["num", "v", "flag_True", "many"]
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(again.transform(df)) == key(model.transform(df))
    assert not [r for r in again.transform(df).collect() if any(x is None for x in r)]


def test_column_handling(frame):
    df = frame([(1, 2, 3)], "a int, b int, c int")
    twice = df.select("a", F.col("b").alias("x"), F.col("c").alias("x"))
    assert columns.first_of_each_name(twice).collect() == [(1, 2)]
    assert columns.safe_names(df.toDF("a[1]", "b<2", "c")).columns == ["a_1_", "b_2", "c"]
    assert columns.select_features(df, id_col="c").columns == ["c", "a", "b"]
    assert columns.stack(df.select("a"), df.select("b")).columns == ["a", "b"]


def test_member_rows(frame):
    df = frame([(1, "x"), (2, "y"), (2, "z")], "fieldID int, filename string")
    assert columns.member_rows(df, 2).count() == 2
    assert columns.member_rows(df, [2], ["z"]).count() == 1
    assert columns.member_rows(df, []).count() == 0


def test_batches(spark, frame):
    out = {r["id"]: r["batch"] for r in batches.id_batches(frame([(i % 7,) for i in range(30)], "id int"), "id", 3).collect()}
    assert out == {i: i // 3 for i in range(7)}
    assert sorted(map(tuple, batches.index_ranges(spark, 10, 4).collect())) == [(0, 4), (4, 8), (8, 10)]
    assert batches.index_ranges(spark, 0, 4).count() == 0
    assert sorted(map(tuple, batches.table_ranges(spark.range(8), 4).collect())) == [(0, 4), (4, 8)]


def test_nulls(frame):
    df = frame([(float("inf"),), (float("-inf"),), (float("nan"),), (1.0,)], "v double")
    assert df.select(F.count(nulls.replace_inf("v"))).first()[0] == 2
    assert df.select(F.count(nulls.finite("v"))).first()[0] == 1
    assert nulls.clean(df).where("v is null").count() == 1
