"""What the operators of this subpackage share: saved tables, free column names, hashes of words and shingles."""

import re
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mlframes.plans.storage import shared_path

#: A word: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder of the cluster and read it back: the lineage ends there, and a lost
    executor costs no more than the tasks that read it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(taken, *names: str) -> list[str]:
    """The names, with underscores before those that ``taken`` (columns, in any case) already holds."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


#: Bits of a map of keys. It goes to every task as at most a row of 16 bytes per 64 bits, whatever the tables' size.
MAP_BITS = 1 << 24


def key_map(keys: DataFrame, *columns: str) -> DataFrame:
    """A map with a bit set for the hash of every key."""
    bit = F.pmod(F.xxhash64(*[column(c) for c in columns]), F.lit(MAP_BITS))
    return saved(keys.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("place"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("word")), "map")


def may_hold(df: DataFrame, keys: DataFrame, *columns: str, hold: bool = True) -> DataFrame:
    """The rows whose key may be in a map, or with ``hold`` false those whose key cannot be. Few rows need a shuffle
    then for the exact join that follows; a full map only leaves all of them to it."""
    bit, place, word = fresh(df.columns, "bit", "place", "word")
    marked = df.withColumn(bit, F.pmod(F.xxhash64(*[column(c) for c in columns]), F.lit(MAP_BITS)))
    told = keys.select(F.col("place").alias(place), F.col("word").alias(word))
    found = marked.join(F.broadcast(told), F.floor(column(bit) / 64) == column(place), "left")
    there = F.coalesce(F.getbit(column(word), (column(bit) % 64).cast("int")) == 1, F.lit(False))
    return found.where(there if hold else ~there).select(*[column(c) for c in df.columns])


def text_column(name: str):
    """The text, empty where it is null."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def column(name: str):
    return F.col(f"`{name}`")


_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES[SPACE] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_powers = _inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 2 * len(_powers)), _STEP)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers[:n]


def inverses(n: int) -> np.ndarray:
    """The first ``n`` powers of the inverse of the number whose powers are ``powers``."""
    global _inverses
    if len(_inverses) < n:
        more = np.full(max(n, 2 * len(_inverses)), _BACK)
        more[0] = 1
        _inverses = np.multiply.accumulate(more)
    return _inverses[:n]


def hashed_words(data: np.ndarray, block: int = 1 << 16):
    """(start, 64-bit hash) of each word of bytes, hashed in blocks of about so many bytes."""
    inside = ~SPACE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    cuts = np.unique(np.concatenate([np.searchsorted(starts, np.arange(0, len(data), block)), [len(starts)]]))
    sums = [np.zeros(0, np.uint64)]
    for low, high in zip(cuts[:-1], cuts[1:]):
        part, first = data[starts[low]:ends[high - 1]], starts[low:high] - starts[low]
        before = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * powers(len(part)), out=before[1:])
        sums.append((before[ends[low:high] - starts[low]] - before[first]) * inverses(len(part))[first])
    return starts, mix(np.concatenate(sums) + (ends - starts).astype(np.uint64) * _STEP)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as a-z."""
    return hashed_words(np.frombuffer(text.lower(), np.uint8))[1]


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the runs of ``k`` words; of fewer words, of the whole sequence."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mix((words * _PLACE[:n]).sum(keepdims=True) + np.uint64(n))
    sums = words[:n - k + 1] * _PLACE[0]
    for i in range(1, k):
        sums = sums + words[i:n - k + 1 + i] * _PLACE[i]
    return np.unique(mix(sums + np.uint64(k)))


def signed(x) -> np.ndarray:
    """As Spark's long."""
    return np.asarray(x, np.uint64).view(np.int64)


def texts_of(column) -> list[bytes]:
    """The bytes of an Arrow column of strings; empty for null."""
    return [x or b"" for x in column.cast("binary").to_pylist()]


def sliced(batches, rows: int = 512):
    """Arrow batches in slices, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        pa.default_memory_pool().release_unused()


def parts_of(column):
    """The arrays of an Arrow column of lists, without copies."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


SENTENCE_END = re.compile(r"(?<=[.!?])[ \t]+")


def held(name: str, make):
    """What ``make()`` returned the first time in this worker: tables and caches outlive the tasks that share them."""
    store = sys.modules.setdefault("_held_by_worker", types.ModuleType("_held_by_worker")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]
