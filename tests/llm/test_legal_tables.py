"""Tables that are legal though unusual: any 64-bit ids, null ids, one id with several texts, ties."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mlframes.llm import ann, lines, mixing, packing, setjoin, warc

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def sentence(seed, n=40):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))


def test_ties_of_nearness_go_to_the_smaller_id(spark):
    rows = []
    for i in range(1, 64):
        v = np.zeros(64)
        v[0], v[i] = 1.0, 1.0
        rows.append((i, v.tolist()))
    rows.append((0, [1.0] + [0.0] * 63))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in found] == [(i, i, 1.0) for i in range(1, 21)]


def test_packing_of_any_ids(spark):
    ids = [2**62 + 7 * i for i in range(10)] + [-2**63, 2**63 - 1] + [5000 * i for i in range(8)] + [None, None]
    text = sentence(1, 100)
    df = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
    rows = packing.pack(df, WORD_BPE).collect()
    tokens = rows[0].doc_tokens
    held = {}
    for r in rows:
        held[r.sequence_id] = held.get(r.sequence_id, 0) + r.length
    padding = sum(2048 - n for n in held.values() if n & (n - 1))
    assert padding < 0.02 * len(ids) * tokens  # far ids share sequences
    for i in set(ids):
        pieces = sorted((r.start, r.length) for r in rows if r.doc_id == i)
        assert sum(n for _, n in pieces) == tokens * ids.count(i)
    again = packing.pack(df.repartition(5), WORD_BPE).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_archives_of_any_ids(spark):
    rows = [(-2**63, "u", "a" * 200), (2**63 - 1, "v", "a" * 200), (0, "w", None), (17, "x", "short")]
    out = {r.page_id: r for r in warc.archive_report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == 4 and out[2**63 - 1].record_type == "revisit" and out[2**63 - 1].refers_to == -2**63


def chain():
    """Three texts of which neighbours are near: a ~ b ~ c."""
    a = [f"w{i}" for i in range(200)]
    b = a[:190] + [f"x{i}" for i in range(10)]
    c = [f"y{i}" for i in range(10)] + b[10:]
    return " ".join(a), " ".join(b), " ".join(c)


@pytest.mark.parametrize("middle", [2, None])
def test_links_pass_through_null_ids(spark, middle):
    a, b, c = chain()
    df = spark.createDataFrame([(1, a), (middle, b), (3, c), (None, "alone " * 3), (9, sentence(3))], "doc_id long, text string")
    out = sorted((str(r.id), str(r.component_id)) for r in setjoin.jaccard_components(df).collect())
    assert out == sorted([("1", "1"), (str(middle), "1"), ("3", "1"), ("None", "None"), ("9", "9")])
    kept = {r.doc_id for r in setjoin.keep_one(df).collect()}
    assert kept == {1, 9, None} and setjoin.keep_one(df).count() == 3


def test_one_id_with_two_texts(spark):
    a, b, _ = chain()
    df = spark.createDataFrame([(1, a), (1, sentence(7, 200)), (2, b), (2, b)], "doc_id long, text string")
    out = sorted((r.id, r.n_shingles, r.component_id) for r in setjoin.jaccard_components(df).collect())
    assert out == [(1, 196, 1), (1, 196, 1), (2, 196, 1), (2, 196, 1)]
    assert sorted((r.doc_id, r.text) for r in setjoin.keep_one(df).collect()) == sorted([(1, a), (1, sentence(7, 200))])


def test_null_ids_stay_in_the_mix(spark):
    rows = [(None, f"a b c {i}", "s") for i in range(100)] + [(i, f"d e f {i}", None) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed(df).collect()
    assert sum(r.doc_id is None for r in out) > 0 and sum(r.doc_id is not None for r in out) > 0


def test_line_dedup_of_null_ids_repeats_and_long_texts(spark):
    words = [f"w{i}" for i in range(170_000)]  # over 1 MB
    long, passage = " ".join(words), " ".join(words[70_000:70_060])
    rows = [(1, long), (None, f"one {passage} two"), (None, None), (3, f"x {passage} y"), (3, f"x {passage} y"), (3, "short text"), (4, ""),
            (5, "ab " * 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.text or "") for r in lines.remove_repeats(docs).collect())
    # the null id comes first and keeps the passage; rows equal in id and text are one document
    kept = " ".join(words[:70_000] + words[70_060:])
    assert out == sorted([(1, kept), (0, f"one {passage} two"), (0, ""), (3, "x y"), (3, "x y"), (3, "short text"), (4, ""),
                          (5, ("ab " * 50).strip())])
    assert lines.remove_repeats(docs.limit(0)).count() == 0
