"""Document fingerprints of closed syncmers, by DataFrame functions alone."""

from pyspark.sql import DataFrame, Window, functions as F

from mlframes.llm.arrays import let
from mlframes.llm.common import column, key_map, may_hold, text_column

#: Letters of the sequence: words of up to 16 characters, and each character of scripts without spaces.
UNIT = (r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
        r"|[^\s\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]{1,16}")
#: Units of a k-mer and of its inner substrings.
K, S = 5, 2
#: Rows of successive ids that meet in one window, about.
ROWS_PER_PART = 256
#: Ranges that ids are cut into by a bounded sketch, and the numbers of parts kept for each.
RANGES, PARTS = 1 << 10, 1 << 40


def syncmers(text, k: int = K, s: int = S):
    """Sorted distinct hashes of the closed syncmers of a text: k-mers of units with the smallest of their inner
    s-mers at the start or the end. Whether a k-mer is chosen depends on it alone, so equal passages give equal
    anchors wherever they stand. A text with fewer than ``k`` units has one, of all of them; without units, none."""
    def inner(h):
        return F.transform(F.slice(h, 1, F.size(h) - (s - 1)),
                           lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, s)]))

    def chosen(h, m):
        last = k - s
        # null where the k-mer is no syncmer
        marks = F.transform(F.slice(m, 1, F.size(h) - k + 1), lambda x, i: F.when(
            F.least(x, *[F.get(m, i + j) for j in range(1, last + 1)]) == F.least(x, F.get(m, i + last)),
            F.xxhash64(*[F.get(h, i + j) for j in range(k)])))
        return F.array_sort(F.array_distinct(F.array_compact(marks)))

    units = F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u))
    return let(units, lambda h: F.when(F.size(h) >= k, let(inner(h), lambda m: chosen(h, m)))
               .when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>")))


def written(prints):
    """A fingerprint as text: its hashes as 16 hexadecimal digits each."""
    return F.array_join(F.transform(prints, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a, b):
    """Likeness of two fingerprints: twice the shared ones over all; 1 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def successors(parts: DataFrame, per_part: int, levels: int = 3) -> DataFrame:
    """(__part, __next) of distinct numbers: the next larger one, the smallest for the largest."""
    if not levels:  # a part holds per_part ** (levels + 1) keys by now
        following = F.lead("__part").over(Window.orderBy("__part"))
        return parts.select("__part", F.coalesce(following, F.min("__part").over(Window.partitionBy(F.lit(0)))).alias("__next"))
    parts = parts.withColumn("__up", F.floor(F.col("__part") / per_part))
    inside = Window.partitionBy("__up").orderBy("__part")
    placed = parts.withColumn("__next", F.lead("__part").over(inside))
    firsts = parts.groupBy("__up").agg(F.min("__part").alias("__first"))
    up = successors(firsts.select(F.col("__up").alias("__part")), per_part, levels - 1)
    heads = (up.join(firsts.select(F.col("__up").alias("__next"), "__first"), "__next")
             .select(F.col("__part").alias("__up"), "__first"))
    return placed.join(heads, "__up").select("__part", F.coalesce("__next", "__first").alias("__next"))


def with_parts(rows: DataFrame, per_part: int) -> DataFrame:
    """The rows with ``__part``, a number that grows with ``doc_id`` and that about ``per_part`` rows share.

    Quantiles of a sketch cut the ids into at most ``RANGES`` ranges, and each range is cut evenly, as its own ids lie. So
    parts are as large for ids without gaps as for hashes, and ids that lie close together far from the rest take a part
    of at most a range's rows. The sketch works in doubles, which keeps up to 1,024 (near 2**63) neighbouring ids together.
    Null ids are a part of their own, before all others.
    """
    probs = [i / RANGES for i in range(1, RANGES)]
    cut = rows.agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                   F.percentile_approx("doc_id", probs, 10 * RANGES).alias("b"))
    found = cut.first()  # one row, of RANGES numbers at most
    if not found.n:
        return rows.withColumn("__part", F.lit(-2**62))
    step = -(-RANGES * per_part // found.n)  # few rows need few ranges
    edges = found.b[step - 1::step]
    froms, tos = [found.low, *edges], [*edges, found.high]
    # a range's width as a share of the parts it should have
    widths = [max(1.0, (float(z) - float(a)) * per_part * RANGES / (float(found.n) * step)) for a, z in zip(froms, tos)]
    longs, coarse = (F.array(*[F.lit(x).cast("long") for x in xs]).cast("array<long>") for xs in (edges, edges[31::32]))

    def below(bounds):
        return F.size(F.filter(bounds, lambda x: x < F.col("doc_id")))

    held = rows.withColumn("__step", below(coarse) * 32)
    held = held.withColumn("__range", F.col("__step") + below(F.slice(longs, F.col("__step") + 1, 32)))
    start, width = (F.get(F.array(*[F.lit(x).cast("double") for x in xs]), F.col("__range")) for xs in (froms, widths))
    inside = F.least(F.lit(PARTS - 1), F.floor((F.col("doc_id").cast("double") - start) / width).cast("long"))
    part = F.when(F.col("doc_id").isNotNull(), F.col("__range") * F.lit(PARTS) + inside).otherwise(F.lit(-2**62))
    return held.withColumn("__part", part).drop("__step", "__range")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """(doc_id, text, prints): the fingerprint of every row. A null text is empty, an empty one has no anchors."""
    return docs.select(column(id_col).alias("doc_id"), text_column(text_col).alias("text")).withColumn(
        "prints", syncmers(F.col("text"), k, s))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S,
                per_part: int = ROWS_PER_PART) -> DataFrame:
    """For every row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next row's
    text, ids ascending, the first row's for the last. ``near_edited`` and ``near_next`` are the likeness of the
    fingerprint to the edited text's and the next row's.

    About ``per_part`` rows of successive ids meet in a window, which costs one shuffle of the texts; only its last row
    takes the next part's first text by a join. Ids may be any: ``with_parts`` cuts them by where they lie. A null text is empty; rows of one id are ordered by their text; a null
    id comes first.
    """
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), text_column(text_col).alias("text"))
    rows = with_parts(rows, per_part)
    inside = Window.partitionBy("__part").orderBy("doc_id", "text")
    ahead = rows.withColumn("next_text", F.lead("text").over(inside))
    ahead = ahead.withColumn("prints", syncmers(F.col("text"), k, s))
    ahead = ahead.withColumn("next_prints", F.lead("prints").over(inside))
    least = rows.groupBy("__part").agg(F.min("doc_id").alias("doc_id"))
    firsts = (may_hold(rows, key_map(least, "doc_id"), "doc_id").join(least.withColumnsRenamed({"__part": "p", "doc_id": "d"}),
                        (F.col("__part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
              .groupBy("__part").agg(F.min("text").alias("__head")))
    follow = successors(least.select("__part"), per_part)
    heads = follow.join(firsts.withColumnRenamed("__part", "__next"), "__next").select("__part", "__head")
    full = ahead.join(heads, "__part", "left")
    last = F.col("next_text").isNull()
    full = full.withColumns({"next_prints": F.when(last, syncmers(F.col("__head"), k, s)).otherwise(F.col("next_prints")),
                             "next_text": F.when(last, F.col("__head")).otherwise(F.col("next_text")),
                             "n_chars": F.length("text").cast("long")})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int"))
    full = full.withColumn("edited", F.concat(kept, F.substring("next_text", F.lit(1), half)))
    full = full.withColumn("edited_prints", syncmers(F.col("edited"), k, s))
    return full.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       written("prints").alias("fingerprint"), written("edited_prints").alias("edited_fingerprint"),
                       likeness("prints", "edited_prints").alias("near_edited"), likeness("prints", "next_prints").alias("near_next"))
