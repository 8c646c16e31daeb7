"""Language identification by rank-order profiles of character n-grams and their out-of-place distance."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from mlframes.llm.common import column, fresh, held, saved, sliced

#: N-grams kept in a profile, and the longest n-gram.
KEPT, LONGEST = 300, 3
#: Characters whose n-grams are counted at once.
PIECE = 1 << 18
#: Languages a model may hold: it goes to every task.
MOST_LANGUAGES = 2_000
#: The share of a language's fit rows, and of the likeness which that share of them stays under, that bound what is told.
LOW_SHARE, LOW_PART = 0.01, 0.6


def _letters() -> np.ndarray:
    return held("letters", lambda: np.array([chr(i).isalpha() for i in range(0x110000)]))


def grams(texts: list[str]):
    """(document, n-gram, count) of the n-grams of letters, up to three, in words padded by a blank on both sides.

    An n-gram is the number made of its code points, 21 bits each; rows are sorted by document and n-gram.
    """
    low = [t.lower() for t in texts]
    cp = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.concatenate([[0], np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])])
    letter = _letters()[cp]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # one blank after each word
    kept[0] = True
    cp, doc, letter = cp[kept], doc[kept], letter[kept]
    present = np.zeros(0x110000, bool)
    present[cp[letter]] = True
    number = np.cumsum(present)  # 0 is the blank
    code = np.where(letter, number[cp], 0).astype(np.int64)
    alphabet = np.concatenate([[32], np.flatnonzero(present)]).astype(np.int64)
    width = max(1, int(len(alphabet)).bit_length())
    whose = doc.astype(np.int64) << (3 * width)
    none = (1 << width) - 1  # an absent place: above any letter's number
    rows = []
    at = np.flatnonzero(letter)
    rows.append(whose[at] | none << 2 * width | none << width | code[at])
    pair = letter[:-1] | letter[1:]
    owner = np.where(letter[:-1], whose[:-1], whose[1:])
    rows.append((owner | none << 2 * width | code[:-1] << width | code[1:])[pair])
    if len(code) > 2:
        rows.append((whose[1:-1] | code[:-2] << 2 * width | code[1:-1] << width | code[2:])[letter[1:-1]])
    found, count = np.unique(np.concatenate(rows), return_counts=True)
    mask = (1 << width) - 1
    # the blank, number 0, is code point 32; an absent place is 0
    table = np.zeros(1 << width, np.int64)
    table[:len(alphabet)] = alphabet
    packed = table[found >> 2 * width & mask] << 42 | table[found >> width & mask] << 21 | table[found & mask]
    return found >> (3 * width), packed, count


def pieces(texts: list[str]):
    """The texts in lists of (text's number, part) of about ``PIECE`` characters at most: memory stays bounded for any
    text. A longer text is cut at white space where a piece has some."""
    held, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            end = at + PIECE
            if end < len(text):
                end = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end)) + 1 or at + PIECE
            part = text[at:end]
            if held and size + len(part) > PIECE:
                yield held
                held, size = [], 0
            held.append((i, part))
            size += len(part) + 2
            at = max(end, 1)
    if held:
        yield held


def summed(gram, count):
    """Distinct n-grams and the sums of their counts."""
    found, at = np.unique(gram, return_inverse=True)
    return found, np.bincount(at, count, len(found)).astype(np.int64)


def counted(texts: list[str]):
    """(document, n-gram, count) of texts of any length, a piece of them at a time; a text is in one result."""
    open_doc, grams_, counts = None, [], []
    for part in pieces(texts):
        whose, gram, count = grams([t for _, t in part])
        doc = np.array([i for i, _ in part])[whose]
        if grams_ and part[0][0] == open_doc:  # the text goes on: its counts are summed when it has ended
            mine = doc == open_doc
            grams_.append(gram[mine])
            counts.append(count[mine])
            doc, gram, count = doc[~mine], gram[~mine], count[~mine]
        if part[-1][0] != open_doc:
            if grams_:
                found, total = summed(np.concatenate(grams_), np.concatenate(counts))
                yield np.full(len(found), open_doc), found, total
            open_doc = part[-1][0]
            mine = doc == open_doc
            grams_, counts = [gram[mine]], [count[mine]]
            doc, gram, count = doc[~mine], gram[~mine], count[~mine]
        if len(doc):
            yield doc, gram, count
    if grams_:
        found, total = summed(np.concatenate(grams_), np.concatenate(counts))
        yield np.full(len(found), open_doc), found, total


def top_ranks(doc, gram, count, kept: int = KEPT):
    """(document, n-gram, rank from 0) of each document's most frequent n-grams, ties to the smaller number."""
    order = np.lexsort((gram, -count, doc))
    doc, gram = doc[order], gram[order]
    start = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1]) if len(doc) else np.zeros(0, np.int64)
    rank = np.arange(len(doc)) - np.repeat(start, np.diff(start, append=len(doc)))
    return doc[rank < kept], gram[rank < kept], rank[rank < kept]


def _strings(col) -> list[str]:
    return [x or "" for x in col.to_pylist()]


def _count(batches):
    """Counts by language, summed over the batches of a task before they are shuffled."""
    total: dict = {}
    for batch in sliced(batches):
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = _strings(batch.column(1))
        for lang in sorted(set(langs)):
            for _, gram, count in counted([t for t, l in zip(texts, langs) if l == lang]):
                mine = total.get(lang, (gram[:0], count[:0]))
                total[lang] = summed(np.concatenate([mine[0], gram]), np.concatenate([mine[1], count]))
    for lang, (gram, count) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(count)],
                                         names=["lang", "gram", "c"])


def fit_rows(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, text) that a model is fitted on: every row with a language and a text, whole. More than ``MOST_LANGUAGES``
    languages are an error.
    """
    rows = labelled.select(column(lang_col).cast("string").alias("lang"), column(text_col).cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null")
    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return rows


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Profiles (lang, gram, rank): the ``KEPT`` most frequent n-grams of each language, of all rows of ``fit_rows``."""
    return _profiles(fit_rows(labelled, text_col, lang_col))


def _profiles(learned: DataFrame) -> DataFrame:
    counts = (learned.mapInArrow(_count, "lang string, gram long, c long")
              .groupBy("lang", "gram").agg(F.sum("c").alias("c")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "gram")) - 1
    return counts.withColumn("rank", place).where(F.col("rank") < KEPT).select("lang", "gram", "rank")


def _model(profiles: DataFrame):
    """(languages, sorted n-grams, ranks by n-gram and language), ``KEPT`` where a language lacks the n-gram."""
    found = profiles.toArrow()  # fit() bounds it
    names = found.column("lang").to_pylist()
    langs = sorted(set(names))
    gram, at = np.unique(found.column("gram").to_numpy(), return_inverse=True)
    ranks = np.full((len(gram), len(langs)), KEPT, np.int32)
    ranks[at, np.searchsorted(np.array(langs, object), np.array(names, object))] = found.column("rank").to_numpy()
    return langs, gram, ranks


def _distances(texts: list[str], known: np.ndarray, ranks: np.ndarray):
    """Out-of-place distance of each text to each language, and its number of ranked n-grams. An n-gram that a
    profile lacks is as far as the profile is long."""
    out, n = np.zeros((len(texts), ranks.shape[1])), np.zeros(len(texts), np.int64)
    for part in counted(texts):
        doc, gram, rank = top_ranks(*part)
        at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
        there = known[at] == gram
        for j in range(ranks.shape[1]):
            theirs = np.where(there, ranks[at, j], KEPT)
            away = np.where(theirs < KEPT, np.minimum(np.abs(theirs - rank), KEPT), KEPT)
            out[:, j] += np.bincount(doc, away, len(texts))
        n += np.bincount(doc, minlength=len(texts))
    return out, n


def predict(docs: DataFrame, profiles: DataFrame, text_col: str = "text", names=("lang_pred", "score")) -> DataFrame:
    """The rows of ``docs`` with the nearest language and a likeness from 0 to 1, and under a third name, if one is
    given, the number of n-grams that were ranked.

    A null text, or one without a letter, is ``und`` with likeness 0, and so is every text when nothing was
    learned. Ties go to the language that sorts first. Only the text is read. The names must be free.
    """
    return _told(docs, _model(profiles), text_col, names)


def _told(docs: DataFrame, model, text_col: str, names) -> DataFrame:
    langs, known, ranks = model
    schema = StructType(list(docs.schema.fields))
    for name, kind in zip(names, ("string", "double", "long")):
        schema = schema.add(name, kind)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in sliced(batches):
            texts = _strings(batch.column(place))
            lang, score, n = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            if len(langs) and len(texts):
                away, n = _distances(texts, known, ranks)
                best = away.argmin(axis=1)
                some = n > 0
                lang[some] = np.array(langs, object)[best[some]]
                score[some] = 1 - away[np.arange(len(texts)), best][some] / (KEPT * n[some])
            told = [pa.array(lang, pa.string()), pa.array(score), pa.array(n)][:len(names)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], names=[*batch.schema.names, *names])
    return docs.mapInArrow(run, schema)


def held_out(id_col: str):
    """Whether a document is kept from the fit: crc32 of its id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(column(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def least_likeness(learned: DataFrame, model, share: float = LOW_SHARE, part: float = LOW_PART) -> DataFrame:
    """(lang, grams, least): by language and number of ranked n-grams (as its binary logarithm, rounded down),
    ``part`` of the likeness that ``share`` of the fit rows of that language stay under."""
    lang, score, n = "lang_pred", "score", "ranked"
    told = _told(learned, model, "text", (lang, score, n)).where(F.col(n) > 0)
    return told.groupBy(F.col(lang).alias("lang"), _grams(n).alias("grams")).agg(
        (F.percentile_approx(score, share, 10_000) * part).alias("least"))


def _grams(name: str):
    return F.floor(F.log2(column(name))).cast("int")


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The documents whose language could be told: those without letters go, and those that are less like their nearest
    language than ``least_likeness`` says of texts of as many n-grams. Noise made of known letters and languages
    that were not learned are as far from every profile as that, unless they are a few words. Where no fit row has as many
    n-grams nothing is known, and the document stays. Columns stay as they are."""
    names = fresh(docs.columns, "lang_pred", "score", "ranked", "grams", "least")
    learned = fit_rows(docs.where(~held_out(id_col)), text_col, lang_col)
    model = _model(_profiles(learned))
    lows = saved(least_likeness(learned, model), "likeness")  # a row per language and ten lengths at most
    lows = lows.select(F.col("lang").alias(names[0]), F.col("grams").alias(names[3]), F.col("least").alias(names[4]))
    told = _told(docs, model, text_col, names[:3]).where((column(names[0]) != "und") & (column(names[2]) > 0))
    told = told.withColumn(names[3], _grams(names[2])).join(F.broadcast(lows), [names[0], names[3]], "left")
    low = column(names[4])
    return told.where(low.isNull() | (column(names[1]) >= low)).select(*[column(c) for c in docs.columns])
