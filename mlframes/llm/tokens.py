"""Token counts by field and section: documents are encoded whole, tokens are attributed by their character spans."""

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mlframes.llm.common import column, held, sliced

#: What happens to a token that crosses a boundary: it goes to the section of its first character, to the one that
#: holds most of its characters (the earlier on ties), or to each by its share of the characters.
RULES = ("first", "most", "share")
#: The fields of a document are joined by this for encoding; it belongs to the field before it.
JOINT = "\n"


def encoder(path: str, pattern: str):
    """(encoding, number of bytes of each token)."""
    def read():
        import tiktoken
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths

    return held(f"encoding of {path}", read)


def token_spans(text: str, encoding, lengths):
    """First characters and ends of the tokens. A token that holds part of a character's bytes holds the character."""
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths[ids])
    return char[ends - lengths[ids]], char[ends - 1] + 1


def attribute(starts, ends, sections, rule: str) -> np.ndarray:
    """Tokens of each section; ``sections`` holds the first character of each, ascending, the text ends at the last entry."""
    n = len(sections) - 1
    begin = np.asarray(sections[:-1])
    first = np.searchsorted(begin, starts, side="right") - 1
    last = np.searchsorted(begin, ends - 1, side="right") - 1
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float)
    inside = first == last
    out = np.bincount(first[inside], minlength=n).astype(float)
    for i in np.flatnonzero(~inside):
        own = np.arange(first[i], last[i] + 1)
        shared = np.minimum(ends[i], np.asarray(sections)[own + 1]) - np.maximum(starts[i], begin[own])
        if rule == "most":
            out[own[np.argmax(shared)]] += 1
        else:
            out[own] += shared / shared.sum()
    return out


def section_starts(text: str) -> list[int]:
    """First characters of the lines of a text; a line break belongs to the line before it."""
    out, at = [0], text.find("\n")
    while at >= 0 and at + 1 < len(text):
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


def token_counts(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", fields=("text",),
                 rule: str = "first") -> DataFrame:
    """(doc_id, field, section, start, end, n_tokens, doc_tokens): tokens of every line of every field.

    The fields of a row, joined by a line break, are encoded once; so a token may cross sections and fields, and
    ``rule`` (one of ``RULES``) says whose it is. Sections are the lines of a field; ``start`` and ``end`` are characters
    of the field. Counts of a row add up to ``doc_tokens``. All of it is a projection: no shuffle.

    A null or empty field has one empty section; the break that follows it counts for the section before it, or for
    that section if there is none. Each of equal rows is counted; a null id stays; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule: one of {RULES}")
    slim = docs.select(column(id_col).cast("long").alias("doc_id"),
                       *[column(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    types_ = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    schema = "doc_id long, field string, section int, start long, end long, n_tokens double, doc_tokens long"

    def rows(key, texts, encoding, lengths):
        places, offset, own = [], 0, []
        for i, text in enumerate(texts):
            for k, start in enumerate(begin := section_starts(text)):
                own.append((fields[i], k, start, begin[k + 1] if k + 1 < len(begin) else len(text)))
                places.append(offset + start)
            offset += len(text) + (i + 1 < len(texts))
        starts, ends = token_spans(JOINT.join(texts), encoding, lengths)
        counts = attribute(starts, ends, [*places, offset], rule) if len(starts) else np.zeros(len(own))
        for (field, k, a, b), n in zip(own, counts.tolist()):
            yield key, field, k, a, b, n, len(starts)

    def run(batches):
        encoding, lengths = encoder(tokenizer, pattern)
        for batch in sliced(batches):
            found = [row for key, *texts in zip(*(c.to_pylist() for c in batch.columns))
                     for row in rows(key, [t or "" for t in texts], encoding, lengths)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types_)],
                                                 names=[x.split()[0] for x in schema.split(", ")])
    return slim.mapInArrow(run, schema)
