"""The hash tree: shares, confined movement, gapless slots, and the query against its SQL on awkward rows."""

import zlib
from collections import Counter

import duckdb
import pytest

from mlframes.llm import sharding
from mlframes.llm.queries import OP13_SQL


def tree(**changed):
    return {r: {k: {s: changed.get(f"s{s}", 1.0) for s in shards} for k, shards in racks.items()}
            for r, racks in {"a": {"x": (0, 1), "y": (2, 3)}, "b": {"x": (4, 5), "y": (6,)}}.items()}


def placed(spark, weights, rows=20_000):
    return {r.id: (r.region, r.rack, r.shard) for r in sharding.place(spark.range(rows), "id", weights).collect()}


def test_shares_follow_weights(spark):
    weights = tree(s0=3.0, s5=0.0, s6=2.0)
    got, whole = Counter(p[2] for p in placed(spark, weights).values()), sharding.weight(weights)
    for racks in weights.values():
        for shards in racks.values():
            for s, w in shards.items():
                assert abs(got[s] / 20_000 - w / whole) < 0.015
    assert got[5] == 0


def test_movement_stays_in_the_subtrees_that_change(spark):
    before, after = placed(spark, tree()), placed(spark, tree(s2=2.0))
    moved = [(before[i], after[i]) for i in before if before[i] != after[i]]
    assert moved
    for old, new in moved:
        # into region a, or inside it into rack y, or inside that into shard 2: nothing else changed weight
        if old[0] != new[0]:
            assert new[0] == "a"
        elif old[1] != new[1]:
            assert new[:2] == ("a", "y")
        else:
            assert new == ("a", "y", 2)
    assert not [1 for old, new in moved if old[0] == new[0] == "b"]


@pytest.mark.parametrize("shards", [8, 9, 12])
def test_one_more_shard_takes_rows_only_into_itself(spark, shards):
    now, grown = placed(spark, sharding.layout(shards)), placed(spark, sharding.layout(shards + 1))
    moved = [grown[i][2] for i in now if now[i] != grown[i]]
    assert set(moved) == {shards} and abs(len(moved) / 20_000 - 1 / (shards + 1)) < 0.015


AWKWARD = [(i, f"text {i}") for i in range(300)] + [(None, "no id")] * 5 + [(None, None), (7, None), (8, ""), (9, "é" * 600_000)]
AWKWARD += [(1000, "repeated")] * 9000 + [(1000, "other text")] * 2


def test_query_equals_sql_on_awkward_rows(spark):
    docs = spark.createDataFrame(AWKWARD, "doc_id bigint, text string").repartition(5)
    got = sharding.shard_report(docs)
    db = duckdb.connect()
    documents = docs.toPandas().astype({"doc_id": "Int64"})  # noqa: F841  (read by the SQL)
    want = db.sql(OP13_SQL)
    assert want.columns == got.columns
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)


def test_slots_are_gapless_and_checksums_true(spark):
    rows = sharding.shard_report(spark.createDataFrame(AWKWARD, "doc_id bigint, text string")).collect()
    assert len(rows) == len(AWKWARD)
    for shard in range(8):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    sums = Counter((r.doc_id, r.text_crc32, r["size"]) for r in rows)
    assert sums == Counter((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in AWKWARD)


def test_empty_table_clashing_names_and_bad_weights(spark, tmp_path):
    assert sharding.shard_report(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    clash = spark.createDataFrame([(i, "x", i) for i in range(50)], "doc_id bigint, region string, Shard int")
    sharding.write_shards(clash, "doc_id", sharding.layout(8), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and {"doc_id", "region", "Shard"} <= set(back.columns)
    with pytest.raises(ValueError):
        sharding.place(clash, "doc_id", {"a": {"b": {0: 0.0}}})
