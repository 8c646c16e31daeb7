"""Secrets in texts: known forms, and windows of high character entropy, by DataFrame functions alone."""

import math
import re

from pyspark.sql import DataFrame, functions as F

from mlframes.llm.arrays import let, running_sums
from mlframes.llm.common import column, text_column

# The forms of the base matches, as Java patterns, with what a match must have.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

#: Characters of a window.
WINDOW = 20
#: Per character class: candidates, the characters in order, the bits a window needs. A random window of 20 has 3.46 bits of
#: hexadecimal digits and 4.03 of the 66 characters on average; words have about 3.
CLASSES = {
    "entropy_hex": (r"(?<![A-Za-z0-9])[0-9A-Fa-f]{20,}(?![A-Za-z0-9])", "0123456789abcdef", 3.1),
    "entropy_base64": (r"[A-Za-z0-9+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.75),
}
#: Pieces of candidates that are no secrets: universally unique identifiers, documentation examples, alphabets in order.
ALLOWED = (r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"(?i)example", r"(?i)abcdefghij", r"0123456789",
           r"(.)\1{9}")


def _found(text, pattern: str, kind: int, keep=None):
    """Spans of the matches, as (start, kind, end) in code points. The text between matches gives their places."""
    def spans(parts, hits):
        lengths = F.zip_with(F.slice(parts, 1, F.size(hits)), hits,
                             lambda gap, hit: (F.length(gap) + F.length(hit)).cast("long"))
        found = F.zip_with(running_sums(lengths), F.arrays_zip(
            F.slice(parts, 1, F.size(hits)).alias("gap"), hits.alias("hit")), lambda before, x: F.struct(
                (before + F.length(x["gap"])).alias("start"), F.lit(kind).alias("kind"),
                (before + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), x["hit"].alias("hit")))
        kept = found if keep is None else F.filter(found, lambda x: keep(x["hit"]))
        return F.transform(kept, lambda x: F.struct(x["start"], x["kind"], x["end"]))

    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    both = let(F.split(text, pattern, -1), lambda parts: let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: spans(parts, hits)))
    return F.when(F.regexp_like(text, F.lit(pattern)), both).otherwise(none)


def entropy_spans(text, symbols: str, bits: float, window: int = WINDOW):
    """(start, end) of the stretches of a string covered by windows whose Shannon entropy reaches ``bits``.

    One pass over the characters: counts of the window gain one character and lose one, and so does the sum of
    c * log2(c), from which the entropy is log2(window) - sum / window.
    """
    weigh = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    size = len(symbols)
    start = F.struct(
        F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1).alias("open"),
        F.lit(-1).alias("last"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def step(codes, w):
        def at(counts, i):
            return F.element_at(counts, i)

        def move(acc, i):
            come, go = F.element_at(codes, i), F.when(i > window, F.element_at(codes, i - window)).otherwise(F.lit(0))
            grown = F.element_at(w, at(acc["counts"], come) + 2) - F.element_at(w, at(acc["counts"], come) + 1)
            # the character that goes is counted after the one that comes
            left = at(acc["counts"], go) + F.when(come == go, 1).otherwise(0)
            shrunk = F.when(go > 0, F.element_at(w, left) - F.element_at(w, left + 1)).otherwise(F.lit(0.0))
            counts = F.transform(acc["counts"], lambda c, j: c + F.when(j + 1 == come, 1).otherwise(0)
                                 - F.when(j + 1 == go, 1).otherwise(0))
            return let(acc["total"] + grown + shrunk, lambda total: let(
                (i >= window) & (math.log2(window) - total / window >= bits), lambda hot: let(
                    ~hot & (acc["open"] >= 0) & (i - window >= acc["last"]), lambda closed: F.struct(
                        counts.alias("counts"), total.alias("total"),
                        F.when(hot & (acc["open"] < 0), i - window).when(closed, -1).otherwise(acc["open"]).alias("open"),
                        F.when(hot, i).otherwise(acc["last"]).alias("last"),
                        F.when(closed, F.concat(acc["out"], F.array(F.struct(acc["open"].alias("a"), acc["last"].alias("b")))))
                        .otherwise(acc["out"]).alias("out")))))
        return move

    def end(acc):
        return F.when(acc["open"] >= 0, F.concat(acc["out"], F.array(F.struct(acc["open"].alias("a"), acc["last"].alias("b"))))
                      ).otherwise(acc["out"])

    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(symbols), c))
    return let(weigh, lambda w: let(codes, lambda x: F.aggregate(
        F.sequence(F.lit(1), F.size(x)), start, step(x, w), end)))


def _any(rules) -> str:
    """One pattern for all rules; references to groups are numbered on."""
    out, groups = [], 0
    for rule in rules:
        out.append("(?:" + re.sub(r"\\([1-9])", lambda m: f"\\{int(m[1]) + groups}", rule) + ")")  # noqa: B023
        groups += re.compile(rule).groups
    return "|".join(out)


def _entropy(text, kind: str, allowed):
    pattern, symbols, bits = CLASSES[kind]
    number = KINDS.index(kind)

    def wanted(hit):
        mixed = F.regexp_like(hit, F.lit("[0-9]")) & F.regexp_like(hit, F.lit("[A-Za-z]"))
        if kind == "entropy_base64":
            mixed = mixed & ~F.regexp_like(hit, F.lit("^[0-9A-Fa-f]+$"))
        return mixed

    def part(x):
        return F.substring(text, x["start"].cast("int") + 1, (x["end"] - x["start"]).cast("int"))

    def without(rule):
        def left(x):
            def between(cut):
                starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(cut, lambda c: c["end"]))
                ends = F.concat(F.transform(cut, lambda c: c["start"]), F.array(x["end"] - x["start"]))
                return F.zip_with(starts, ends, lambda a, b: F.struct(
                    (x["start"] + a).alias("start"), F.lit(number).alias("kind"), (x["start"] + b).alias("end")))
            return F.filter(let(_found(part(x), rule, number), between), lambda y: y["end"] - y["start"] >= WINDOW)
        return left

    def inner(x):
        hit = F.lower(part(x)) if kind == "entropy_hex" else part(x)
        return F.transform(entropy_spans(hit, symbols, bits), lambda s: F.struct(
            (x["start"] + s["a"]).alias("start"), F.lit(number).alias("kind"), (x["start"] + s["b"]).alias("end")))

    pieces = _found(text, pattern, number, wanted)
    if allowed:
        pieces = F.flatten(F.transform(pieces, without(_any(allowed))))
    return F.flatten(F.transform(pieces, inner))


def _written(spans):
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed=ALLOWED) -> DataFrame:
    """(doc_id, base, extra): spans (start, kind, end) of the known forms, and of high entropy, in code points.

    Known forms: an assignment to a name such as ``token`` with a value of 6 characters or more, an access key of 20
    or more, 24 or more hexadecimal digits. High entropy: windows of ``WINDOW`` characters within strings that mix
    letters and digits, per character class; pieces that match a rule of ``allowed`` are cut out there, known
    forms never are. Hexadecimal digits may stand next to any character but letters and digits. ``kind`` counts through ``KINDS``.

    Every row gives one row; a null or empty text has no spans; a null id stays; other columns are ignored. All of
    it is a projection: no shuffle.
    """
    slim = docs.select(column(id_col).alias("doc_id"), text_column(text_col).alias("text"))
    text = F.col("text")
    value = F.regexp_extract
    base = F.concat(
        _found(text, ASSIGN, 0, lambda hit: F.length(value(hit, ASSIGN, 2)) >= 6),
        _found(text, ACCESS, 1, lambda hit: F.length(hit) >= 20), _found(text, HEX, 2))
    extra = F.concat(*[_entropy(text, kind, allowed) for kind in CLASSES])
    return slim.select("doc_id", base.alias("base"), extra.alias("extra"))


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row; spans as ``kind:start:end``."""
    found = find_secrets(docs, **options)

    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(kind) for kind in range(3)]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _written(F.concat("base", "extra")).alias("spans"))
