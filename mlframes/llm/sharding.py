"""Sharding by a hierarchical weighted hash tree: a row descends region, rack and shard by weighted hash draws.

At each level every child draws ``ln(u) / weight``, ``u`` in (0, 1) being a hash of the key and of the child's path; the
largest draw wins, so a child gets its weight's share of the keys. A change of one child's weight changes that child's draws
only: keys move into or out of its subtree, and none moves between subtrees whose weights stay. Nothing but the key and the
tree decides, so any task places any row without knowing the others, and no text is shuffled.

Nulls: a null key is a key of its own; a null text has no bytes and the checksum of none. Rows that share a key share a
shard. An empty table gives none. Columns of the input keep their names; names that clash get underscores before them.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from mlframes.llm.common import column, fresh, saved, text_column

LEVELS = ("region", "rack", "shard")

#: Equal rows are unfolded in stretches of so many, so that no row makes a long array.
STRETCH = 4096


def layout(shards: int, founded: int = 8, racks: int = 2, per_rack: int = 2) -> dict:
    """Regions of racks of shards, all of weight 1: the shards there from the start fill racks and regions in turn, each
    later one is a region of its own. So ``layout(n + 1)`` is ``layout(n)`` and one subtree beside the others, and only
    that one shard takes keys."""
    tree = {}
    for s in range(shards):
        of_region = s // (racks * per_rack) if s < founded else s
        rack = s // per_rack % racks if s < founded else 0
        tree.setdefault(f"r{of_region}", {}).setdefault(f"k{rack}", {})[s] = 1.0
    return tree


def weight(tree) -> float:
    """Of a shard its own, of a subtree the sum."""
    return sum(map(weight, tree.values())) if isinstance(tree, dict) else float(tree)


def draw(key: Column, path: str, heavy: float) -> Column:
    """A child's draw for a key, from 52 bits of a digest; a child without weight never wins over one with some."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{path}")).cast("binary")), 1, 13), 16, 10).cast("double")
    return F.log((bits + 0.5) / 2.0**52) / heavy if heavy > 0 else F.lit(float("-inf"))


def _winner(key: Column, children: dict, path: str) -> Column:
    """The name, as text, of the child with the largest draw."""
    drawn = [F.struct(draw(key, f"{path}/{name}", weight(child)).alias("draw"), F.lit(str(name)).alias("name"))
             for name, child in children.items()]
    return F.array_max(F.array(*drawn))["name"] if len(drawn) > 1 else F.lit(str(next(iter(children))))


def place(df: DataFrame, key: str, tree: dict, names=LEVELS) -> DataFrame:
    """Add the region, rack and shard of each row, one narrow step per level. ``tree`` maps regions to racks to shards
    (integers) to weights of 0 or more; their sum must exceed 0."""
    if not weight(tree) > 0 or any(not w >= 0 for racks in tree.values() for shards in racks.values() for w in shards.values()):
        raise ValueError("weights must not be negative, and not all be 0")
    text = F.coalesce(column(key).cast("string"), F.lit("null"))
    region, rack, shard = names
    out = df.withColumn(region, _winner(text, tree, ""))
    of_rack, of_shard = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, racks in tree.items():
        of_rack = F.when(column(region) == r, _winner(text, racks, f"/{r}")).otherwise(of_rack)
        for k, shards in racks.items():
            here = (column(region) == r) & (column(rack) == k)
            of_shard = F.when(here, _winner(text, shards, f"/{r}/{k}")).otherwise(of_shard)
    return out.withColumn(rack, of_rack).withColumn(shard, of_shard.cast("int"))


def number(df: DataFrame, shard: str, order: list[str], name: str = "slot") -> DataFrame:
    """The rows with gapless numbers from 0 within each shard, by ``order``, nulls first; ``order`` and ``shard`` must be
    all columns that tell rows apart.

    Equal rows are counted before the shuffle and take their numbers as one stretch. The rest is cut into ranges; the
    numbers run inside one range at a time, from offsets that are sums of the ranges' counts.
    """
    rest = [c for c in df.columns if c not in order and c != shard]
    n, part, before, start, first = fresh([*df.columns, name], "n", "part", "before", "start", "first")
    keys = [column(c) for c in (shard, *order)]
    counted = df.groupBy(*keys, *map(column, rest)).agg(F.count("*").alias(n))
    ranged = saved(counted.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()), "slots")
    sums = ranged.groupBy(part, shard).agg(F.sum(n).alias(n))
    earlier = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(part, shard, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    inside = (Window.partitionBy(part, shard).orderBy(*map(column, [*order, *rest]))
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (ranged.withColumn(start, F.coalesce(F.sum(n).over(inside), F.lit(0))).join(offsets, [part, shard])
              .withColumn(start, column(start) + column(before)))
    unfolded = placed.withColumn(first, F.explode(F.sequence(F.lit(0).cast("bigint"), column(n) - 1, F.lit(STRETCH).cast("bigint"))))
    last = F.least(column(first) + STRETCH, column(n)) - 1
    return (unfolded.withColumn(first, F.explode(F.sequence(column(first), last)))
            .select(*[column(c) for c in df.columns], (column(start) + column(first)).alias(name)))


def shard_report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Size, checksum, shard and slot of every document, and its shard with one shard more. The law is ``key``: the id and
    the number of shards decide, and the added shard takes documents only into itself. Slots go by id, nulls first."""
    text = text_column("text").cast("binary")
    slim = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = place(slim, "doc_id", layout(shards))
    grown = place(placed, "doc_id", layout(shards + 1), ("grown_region", "grown_rack", "grown_shard"))
    numbered = number(grown.drop("grown_region", "grown_rack"), "shard", ["doc_id", "size", "text_crc32"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


def write_shards(docs: DataFrame, key: str, tree: dict, path: str) -> None:
    """Whole rows to one folder per shard. Every task writes its own part of each shard, so no shard passes through one
    task; with ``partitionBy`` the rows of a task are sorted by shard, which spills to disk."""
    names = fresh(docs.columns, *LEVELS)
    placed = place(docs, key, tree, names).drop(*names[:2])
    placed.write.partitionBy(names[2]).mode("errorifexists").parquet(path)
