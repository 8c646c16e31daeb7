"""Joins, ranks, quantiles and components against plain Python, with limits set low to force the wide paths."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mlframes.plans.components import connected_components
from mlframes.plans.joins import attach, attach_small, join_on
from mlframes.plans.quantiles import grouped_interquartile_means, grouped_quantiles, ranks_within, split_by_size
from mlframes.plans.ranks import dense_codes, first_per_key, running_totals, with_share


def skewed(seed=1, n=3000):
    """A third of the rows in one group, many ties, some nulls."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else f"g{rnd.randrange(40)}"
        v = None if rnd.random() < 0.05 else rnd.choice([rnd.randrange(20) * 1.0, rnd.random() * 1e3, -rnd.random()])
        rows.append((i, g, v, rnd.randrange(5) * 1.0))
    return rows


@pytest.mark.parametrize("limit", [10, 100, 10 ** 6])
def test_quantiles_match_numpy_whatever_the_path(frame, limit):
    rows = skewed()
    df = frame(rows, "id int, g string, v double, w double")
    out = {r["g"]: r for r in grouped_quantiles(df, ["g"], ["v", "w"], [0.0, 0.25, 0.5, 1.0], limit).collect()}
    assert set(out) == {r[1] for r in rows}
    for g, r in out.items():
        for i, c in ((2, "v"), (3, "w")):
            values = [x[i] for x in rows if x[1] == g and x[i] is not None]
            assert np.allclose([r[f"{c}_q{j}"] for j in range(4)], np.percentile(values, [0, 25, 50, 100]), rtol=1e-12)


@pytest.mark.parametrize("limit", [10, 10 ** 6])
def test_interquartile_means(frame, limit):
    rows = skewed(2)
    df = frame(rows, "id int, g string, v double, w double")
    for r in grouped_interquartile_means(df, ["g"], ["v", "w"], limit).collect():
        for i, c in ((2, "v"), (3, "w")):
            values = np.array([x[i] for x in rows if x[1] == r["g"] and x[i] is not None])
            low, high = np.percentile(values, [25, 75])
            kept = values[(values > low) & (values < high)]
            assert (r[c] is None) if not len(kept) else r[c] == pytest.approx(kept.mean())


def test_split_by_size_is_a_partition(frame):
    df = frame(skewed(), "id int, g string, v double, w double")
    small, hot = split_by_size(df, ["g"], 500)
    assert {r[0] for r in hot.select("g").distinct().collect()} == {"hot"}
    assert small.count() + hot.count() == df.count()
    assert split_by_size(df, ["g"], 10 ** 6)[1] is None


def test_null_group_survives_the_hot_path(frame):
    df = frame([(None, float(i)) for i in range(30)] + [("a", 1.0)], "g string, v double")
    out = {r["g"]: r["v_q0"] for r in grouped_quantiles(df, ["g"], ["v"], [0.5], 5).collect()}
    assert out == {None: 14.5, "a": 1.0}


def test_running_totals(frame):
    rnd = random.Random(3)
    rows = [(k, float(v), rnd.randrange(1, 9)) for k in ("a", "b") for v in rnd.sample(range(10 ** 6), 500)]
    out = running_totals(frame(rows, "k string, v double, n int"), ["k"], "v", ["n"]).collect()
    assert len(out) == len(rows)
    for r in random.Random(4).sample(out, 60):
        mine = [x for x in rows if x[0] == r["k"]]
        assert r["n_before"] == sum(x[2] for x in mine if x[1] < r["v"])
        assert r["n_total"] == sum(x[2] for x in mine)


@pytest.mark.parametrize("limit", [10, 10 ** 6])
def test_dense_codes(frame, limit):
    words = sorted({f"w{random.Random(i).randrange(10 ** 6)}" for i in range(2000)})
    df = frame([(w,) for w in words], "w string")
    assert {r["w"]: r["code"] for r in dense_codes(df, "w", limit=limit).collect()} == {w: i for i, w in enumerate(words)}


def test_attach_keeps_all_rows_and_matches_null(frame):
    big = frame([(i, None if i % 3 == 0 else i % 5) for i in range(300)], "id int, k int")
    per_key = frame([(None, "n")] + [(i, str(i)) for i in range(4)], "k int, name string")
    for how in (attach(big, per_key, ["k"]), attach_small(big, per_key, ["k"]), attach_small(big, per_key, ["k"], limit=1)):
        out = {r["id"]: r["name"] for r in how.collect()}
        assert len(out) == 300 and how.columns == ["id", "k", "name"]
        assert out[0] == "n" and out[1] == "1" and out[4] is None


def test_join_on_keeps_the_left_keys(frame):
    a, b = frame([(1, None, "x")], "k int, j string, v string"), frame([(1, None, "y")], "k int, j string, u string")
    assert join_on(a, b, ["k", "j"]).collect()[0].asDict() == {"k": 1, "j": None, "v": "x", "u": "y"}


def test_first_per_key_does_not_depend_on_layout(frame):
    rows = [(i % 7, i % 4, i) for i in range(200)]
    results = [sorted(map(tuple, first_per_key(frame(rows, "k int, o int, v int", p), ["k"], ["o"]).collect())) for p in (1, 7)]
    assert results[0] == results[1] and len(results[0]) == 7
    assert all(r[1] == min(o for k, o, _ in rows if k == r[0]) for r in results[0])


def test_share_of_nothing_is_null(frame):
    df = frame([("a", 0), ("b", 0)], "k string, n int")
    assert [r["s"] for r in with_share(df, "n", "s").collect()] == [None, None]
    shares = with_share(frame([("a", 1), ("a", 3), (None, 5)], "k string, n int"), "n", "s", ["k"]).collect()
    assert sorted(r["s"] for r in shares) == [0.25, 0.75, 1.0]


def test_components_of_a_long_chain(spark):
    chain = spark.range(60).select(F.lit("f").alias("filename"), F.col("id").cast("int").alias("segment"))
    edges = spark.range(59).where("id != 30").selectExpr("'f' as filename", "cast(id as int) as n1", "cast(id + 1 as int) as n2")
    out = {r["segment"]: r["component"] for r in connected_components(chain, edges).collect()}
    assert out == {i: 0 if i <= 30 else 31 for i in range(60)}


def test_components_without_edges(spark):
    nodes = spark.createDataFrame([("f", 1), ("f", 2), ("g", 2)], "filename string, segment int")
    edges = spark.createDataFrame([], "filename string, n1 int, n2 int")
    assert all(r["segment"] == r["component"] for r in connected_components(nodes, edges).collect())


@pytest.mark.parametrize("limit", [20, 10 ** 6])
def test_ranks_within_groups(frame, limit):
    rows = [("hot", v * 3) for v in range(400)] + [(f"g{g}", v) for g in range(5) for v in range(9, 2, -1)]
    out = {(r["g"], r["v"]): r["i"] for r in ranks_within(frame(rows, "g string, v int"), ["g"], "v", "i", limit).collect()}
    assert out == {(g, v): 1 + sum(h == g and w < v for h, w in rows) for g, v in rows}
