"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from pyspark.sql import DataFrame, Window, functions as F

from mlframes.llm.common import WORD, column, fresh, saved, text_column
from mlframes.plans.ranks import dense_codes

#: Weights of the sources in order, and the repetitions a source may reach.
WEIGHTS, EPOCHS = (5, 2, 1), 3
#: Parts that a source's random order is cut into, 16**3: no task holds a whole source.
PREFIX = 3


def _level(sources: DataFrame, total: int, epochs: int):
    """Words per weight once every source above its limit is held at it; None if all are.

    Each round takes what the held sources leave and shares it among the others by weight. The level only rises, and
    so do the held sources, so the rounds end; sums are of whole numbers, so every run gives the same level.
    """
    level = 0.0
    while True:
        held = F.col("source_size") * epochs < F.col("weight") * F.lit(level)
        left, weight = sources.select(
            F.lit(total) - F.coalesce(F.sum(F.when(held, F.col("source_size") * epochs)), F.lit(0)),
            F.sum(F.when(~held, F.col("weight")))).first()
        if not weight:
            return None
        after = left / weight
        if after == level:
            return level
        level = after


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights=WEIGHTS, epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, before, rounds, rest) of every row.

    A document's size is its number of words; a null text has none. Sources in code point order, null last, weigh
    ``weights`` in turn and share as many words as there are; none gets more than ``epochs`` times its own size, and
    what is over goes to the others by weight. A source repeats ``rounds`` times whole; the ``rest`` comes from its
    documents in a seeded random order, in which ``before`` words go ahead of the document. The order is cut into
    4,096 parts by hash, so running sums need no task with a whole source.

    An empty string is a source of its own; equal rows count each; a null id is ordered as the text ``null``.
    """
    rows = docs.select(column(id_col).alias("doc_id"), column(source_col).cast("string").alias("source"),
                       F.regexp_count(text_column(text_col), F.lit(WORD)).cast("long").alias("size"))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = saved(rows.withColumns({"name": F.coalesce("source", F.lit("")), "none": F.col("source").isNull(), "draw": draw})
                 .withColumn("part", F.substring("draw", 1, PREFIX)), "sizes")
    sizes = saved(rows.groupBy("name", "none").agg(F.sum("size").alias("source_size")), "sources")
    named = dense_codes(sizes.where("not none").select("name"), "name").withColumn("none", F.lit(False))
    last = sizes.where("none").select("name", F.lit(named.count()).cast("long").alias("code"), "none")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("code") % len(weights) + 1).cast("int"))
    sources = saved(sizes.join(named.unionByName(last), ["name", "none"]).withColumn("weight", turn.cast("long")), "weights")
    total = sources.select(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = _level(sources, total, epochs)
    limit = F.col("source_size") * epochs
    free = F.col("weight") * F.lit(level) if level is not None else limit
    target = F.when(free > limit, limit).otherwise(free).cast("double")
    want = F.round("target").cast("long")
    sources = sources.select("name", "none", "source_size", target.alias("target")).withColumns({
        "rounds": F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0)})
    sources = sources.withColumn("rest", want - F.col("rounds") * F.col("source_size"))
    whole = Window.partitionBy("name", "none").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (rows.groupBy("name", "none", "part").agg(F.sum("size").alias("held"))
             .withColumn("ahead", F.coalesce(F.sum("held").over(whole), F.lit(0))).drop("held")
             .join(sources, ["name", "none"]))
    inside = (Window.partitionBy("name", "none", "part").orderBy("draw", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    ordered = rows.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return (ordered.join(parts, ["name", "none", "part"])
            .select("doc_id", "source", "size", "source_size", "target", (F.col("ahead") + F.col("__in")).alias("before"),
                    "rounds", "rest"))


def words_taken():
    """Words of a document in the mix: its whole rounds, then its share of the rest, of which the last document in the
    random order gives a part."""
    return F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))


def copies_taken():
    """Times a document is in a mix of whole documents: the rest ends at the document nearest to it."""
    return F.col("rounds") + F.when((F.col("size") > 0) & (2 * F.col("before") + F.col("size") <= 2 * F.col("rest")), 1).otherwise(0)


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents of the mix, whole, each as often as it is taken, columns as they were. Rows that agree in id, source
    and size, null or not, are taken equally often; rows without words are not taken."""
    text_col, source_col = options.get("text_col", "text"), options.get("source_col", "source")
    key, of, words, times, here = fresh(docs.columns, "mix_id", "mix_source", "mix_words", "mix_times", "mix_size")
    taken = (plan(docs, id_col, **options).withColumn(times, copies_taken()).where(F.col(times) > 0)
             .groupBy(F.col("doc_id").alias(key), F.col("source").alias(of), F.col("size").alias(words))
             .agg(F.max(times).cast("int").alias(times)))
    sized = docs.withColumn(here, F.regexp_count(text_column(text_col), F.lit(WORD)).cast("long"))
    joined = sized.join(taken, column(id_col).eqNullSafe(F.col(key)) & column(source_col).cast("string").eqNullSafe(F.col(of))
                        & (F.col(here) == F.col(words)))
    return joined.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[column(c) for c in docs.columns])
