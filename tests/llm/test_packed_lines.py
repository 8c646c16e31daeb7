"""Columns of packed values, and lines counted without splitting."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from mlframes.llm import lines


def test_line_counts_are_those_of_the_lines():
    for text in ("", "a", "a. b", "a.  b!\tc?\n\nd", ". . ", "a.\n b", "?!. \t\n", "a.b ! c"):
        assert lines.count_lines(text) == len(lines.split_lines(text))
    assert lines.split_lines("a.  b!\tc\n d") == [(0, 2), (4, 6), (7, 8), (9, 11)]


def test_hashed_documents_travel_packed():
    text = " ".join(f"w{i}" for i in range(80)) + ". End\nlast"
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 2]), pa.array([1, 2], pa.int32()), pa.array([text, ""])],
                                       names=["id", "k1", "k2", "text"])
    out = next(lines._hash_documents([batch]))
    for name in ("lines", "words", "segments", "ats", "sizes"):
        assert out.column(name).type == pa.binary()
    before, words = lines._unpacked(out.column("words"), np.int32)
    assert before.tolist() == [0, 3, 4] and words.tolist() == [80, 1, 1, 0]
    assert [len(x) for x in lines._parts(out.slice(1).column("lines"), np.int64)] == [1]


def test_stages_bound_the_bytes_of_a_batch(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    docs = spark.createDataFrame([(1, "a b c", "en", "web", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, "")
        assert int(spark.conf.get(key)) == corpus_pipeline.BATCH_BYTES
    finally:
        spark.conf.unset(key)
