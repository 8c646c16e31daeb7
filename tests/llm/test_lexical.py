"""Ranked search against its SQL and against scores of every document."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from mlframes.llm import lexical
from mlframes.llm.queries import OP12_SQL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, keep=20):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, words = len(held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    texts = {}
    for i, t in items:
        if t is not None:
            texts.setdefault(i, set()).add(t)
    out = []
    for item, of in texts.items():
        wanted, found = Counter(terms(" ".join(sorted(of)))), []
        for doc, counts, n in held:
            m = 75 + 25 * n * n_docs // words
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * counts[w] // (1000 * counts[w] + 12 * m))
                        for w, k in wanted.items() if w in counts)
            if score > 0:
                found.append((score, doc))
        found.sort(key=lambda f: (-f[0], f[1] is None, f[1] or 0))
        out += [(item, r + 1, doc, score) for r, (score, doc) in enumerate(found[:keep])]
    return out


def made(seed, n):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "日本", "x9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, " ".join(draw.choices(vocabulary, weights, k=draw.randint(0, 40)))) for i in range(n)]


def got(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted(map(tuple, lexical.search(d, b, **kw).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_against_brute_force_with_ties_copies_nulls(spark):
    docs = made(1, 400) + [(5000 + i, "w3 w7 w9") for i in range(120)] + [(None, "w3 w7"), (9001, None), (9002, ""), (9003, "?! ..")]
    docs += [(7000, "w3 w7 w9 w11")] * 30 + [(9100, "w5 " * 200_000 + "W9-w9_W9")]
    items = [(i, t) for i, t in made(2, 30)] + [(100, "w3 w7 w9"), (101, "none of these"), (102, None), (103, ""), (None, "w7 w7 w9"),
                                                 (104, "W3"), (104, "w7"), (104, "W3")]
    assert got(spark, docs, items) == ordered(brute(docs, items))


def test_small_blocks_of_documents_and_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 7)
    monkeypatch.setattr(lexical, "TREE_BYTES", 1)
    docs, items = made(3, 500), made(4, 25)
    assert got(spark, docs, items, keep=5) == ordered(brute(docs, items, 5))


def test_equals_sql(spark):
    import pandas as pd
    docs, items = made(5, 300), made(6, 20)
    documents, benchmark = pd.DataFrame(docs, columns=["doc_id", "text"]), pd.DataFrame(items, columns=["item_id", "text"])  # noqa: F841
    assert got(spark, docs, items) == sorted(duckdb.sql(OP12_SQL).fetchall())


def test_bounds_hold_in_every_node():
    import numpy as np
    draw = random.Random(8)
    paths, counts = [], []
    for _ in range(300):
        held = sorted(draw.sample(range(40), draw.randint(1, 8)))
        paths.append(np.array(held, ">i4").tobytes())
        counts.append(np.array([draw.randint(1, 9) for _ in held]))
    m = np.array([draw.randint(75, 900) for _ in paths])
    tree = lexical.Tree(paths, counts, m, 40)

    def under(node):
        return [node] if node < len(paths) else [leaf for c in tree.below[node][:, 0] for leaf in under(c)]

    assert sorted(under(tree.root)) == list(range(300))
    for node in tree.below:
        leaves = under(node)
        assert (tree.most[node] == tree.most[leaves].max(0)).all() and tree.least[node] == tree.least[leaves].min()


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [(1, None)])])
def test_empty_tables(spark, docs, items):
    assert got(spark, docs, items) == []


def test_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id bigint, text string, n int, terms string")
    items = spark.createDataFrame([(1, "a", 5.0, 3)], "item_id bigint, text string, score double, item int")
    assert [tuple(r)[:3] for r in lexical.search(docs, items).collect()] == [(1, 1, 1)]
