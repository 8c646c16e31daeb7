"""Fingerprints and language distances against plain loops over one text."""

import base64
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mlframes.llm import langid, syncmers

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()


def xx(*values):
    """Spark's xxhash64 of strings and longs: each value's hash seeds the next."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - 2**64 if seed >= 2**63 else seed


def plain_syncmers(text, k=5, s=2):
    units = [xx(u) for w in text.split() for u in re.findall(".{1,16}", w)]
    if len(units) < k:
        return {xx(*units)} if units else set()
    out = set()
    for i in range(len(units) - k + 1):
        inner = [xx(*units[j:j + s]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.add(xx(*units[i:i + k]))
    return out


def test_chosen_kmers(spark):
    r = random.Random(4)
    texts = ["", "one", "one two three four", "a b c d e", "same " * 30, "x" * 40 + " y", " ".join(r.choices(WORDS, k=20_000))]
    texts += [" ".join(r.choices(WORDS, k=r.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(5)
    for row in df.select("i", syncmers.syncmers(F.col("t")).alias("p")).collect():
        assert row.p == sorted(plain_syncmers(texts[row.i]))


IDS = {"hashes": lambda i: xx(i), "far": lambda i: i if i % 7 else 2**62 + i, "both ends": lambda i: i - 2**63 if i % 2 else 2**63 - 1 - i,
       "one id": lambda i: i if i % 3 else 5, "nulls": lambda i: i if i % 3 else None}


@pytest.mark.parametrize("kind", IDS)
def test_the_next_text_for_any_ids(spark, kind):
    r = random.Random(5)
    rows = sorted(((IDS[kind](i), f"{i} " + " ".join(r.choices(WORDS, k=12))) for i in range(150)),
                  key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    parts = syncmers.with_parts(df, 8).groupBy("__part").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("z"))
    parts = sorted(parts.collect(), key=lambda x: x["__part"])
    assert all(a.z is None or a.z < b.a for a, b in zip(parts, parts[1:]))
    # about 2**63 a double tells 1,024 ids apart from the next ones only: they share a part
    assert kind == "both ends" or len(parts) >= 10 and (kind in ("one id", "nulls") or max(p.n for p in parts) <= 32)
    got = Counter((x.doc_id, x.n_chars, round(x.near_next, 12)) for x in syncmers.edit_report(df, per_part=8).collect())
    want = Counter()
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        a, b = plain_syncmers(text), plain_syncmers(after)
        want[i, len(text), round(2 * len(a & b) / (len(a) + len(b)), 12)] += 1
    assert got == want


def plain_ranks(texts, kept=300):
    """N-grams of words of letters, a blank on both sides, by falling count and then by their code points."""
    counts = Counter()
    for text in texts:
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f" {word} "
            grams = [padded[i:i + k] for k in (1, 2, 3) for i in range(len(padded) - k + 1)]
            counts.update(g for g in grams if g != " ")
    number = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))
    return {g: rank for rank, g in enumerate(sorted(counts, key=lambda g: (-counts[g], number(g)))[:kept])}


def test_out_of_place_distance(spark):
    r = random.Random(6)
    make = {"a": "the of and thing with er harbour".split(), "b": "der die und schön ung ge häfen".split(), "c": "le la été où ça garçon".split()}
    rows = [(" ".join(r.choices(make[lang], k=r.randint(5, 50))), lang) for lang in make for _ in range(30)]
    profiles = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    known = {lang: plain_ranks([t for t, l in rows if l == lang]) for lang in make}
    asked = ["the thing", "schön été", "zzz qqq", "a", "Der Häfen, der!", "x1y2 the", "", "12", " ".join(r.choices(WORDS, k=20_000))]
    asked += [" ".join(r.choices(sum(make.values(), []), k=9)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(asked)), "i int, text string").repartition(4)
    for row in langid.predict(df, profiles).collect():
        mine = plain_ranks([asked[row.i]])
        away = {lang: sum(min(abs(k[g] - rank), 300) if g in k else 300 for g, rank in mine.items()) for lang, k in known.items()}
        best = min(away, key=lambda l: (away[l], l))
        assert (row.lang_pred, row.score) == ((best, pytest.approx(1 - away[best] / (300 * len(mine)))) if mine else ("und", 0))


def test_noise_goes_and_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    finnish = ("Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, "
               "ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. ") * 3
    noise = [" ".join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(k)) for k in (40, 80, 400) for _ in range(10)]
    noise += [base64.b64encode(r.randbytes(n)).decode() for n in (300, 3000) for _ in range(10)]
    noise += [r.randbytes(n).hex() for n in (300, 3000) for _ in range(10)] + [finnish, "", "12 34"]
    ids = np.arange(len(noise)) + 10_000_000
    bad = spark.createDataFrame([(int(i), t, None, "noise", len(t)) for i, t in zip(ids, noise)], docs.schema)
    null = spark.createDataFrame([(None, docs.first().text, "en", "s", 1)], docs.schema)
    kept = langid.keep_identified(docs.unionByName(bad).unionByName(null))
    left = Counter(x.source == "noise" for x in kept.select("source").collect())
    assert kept.columns == docs.columns and left[True] == 0 and left[False] == docs.count() + 1


def test_profiles_learn_from_every_row(spark):
    """Forty words, each the text of 200 rows and more: a fit on a part of the rows would not know all of them, or not their order."""
    words = [chr(0x4E00 + i) for i in range(40)]
    rows = spark.createDataFrame([(w, 200 + i) for i, w in enumerate(words)], "text string, n int")
    rows = rows.selectExpr("text", "'x' as lang", "explode(sequence(1, n))").drop("col")
    found = {r["gram"]: r["rank"] for r in langid.fit(rows).collect()}
    alone = [ord(w) for w in words]
    assert sorted(alone, key=lambda g: found[g]) == alone[::-1]
