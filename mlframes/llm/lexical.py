"""Ranked lexical search over a tree of documents' term vectors.

Each document becomes a vector of the searched terms it holds, most frequent term of the corpus first. A task takes its
documents in blocks and keeps each block as a tree in which vectors with equal beginnings share a path. A node knows, of all
documents below it, the largest count of every term and the least ``m``; the score grows with the one and falls with the
other, so the score of these two bounds every document below. An item then descends from the root, best bound first, and
leaves out every branch whose bound is under the lowest score it still has to beat. Leaves are single documents, whose bound
is their score, so results are exact.

An item is all rows of one ``item_id``: its distinct texts, one after the other. Nulls: a document or an item without text,
or without terms, finds nothing and counts nowhere; null ids are ids of their own, last among equal scores. Rows of equal
``doc_id`` are documents of their own. Empty tables give no rows. Items are the stated set of queries: they are searched in
blocks, each against all documents.
"""

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mlframes.llm.common import parts_of, saved, sliced, texts_of

#: Items searched together. Their terms go to every task.
ITEMS = 2048
#: Bytes of the tree's table of maxima in a task.
TREE_BYTES = 64 << 20
#: A branch of at most so many documents has them as its leaves.
BUNDLE = 32

_letters = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TERMS = bytes(b if b in _letters else 0x20 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of digits, letters and all beyond ASCII, A-Z as a-z."""
    return text.translate(_TERMS).split()


def vectors(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """Of every document with a term: id, number of all terms, and the places in ``words`` of those it holds, with counts."""
    place = {w: i for i, w in enumerate(words)}

    def read(batches):
        for batch in sliced(batches):
            ids, sizes, held, counts = [], [], [], []
            for i, text in zip(batch.column(0), texts_of(batch.column(1))):
                found = terms(text)
                if found:
                    here = Counter(map(place.get, found))
                    here.pop(None, None)
                    ids.append(i)
                    sizes.append(len(found))
                    held.append(list(here))
                    counts.append(list(here.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i.as_py() for i in ids], batch.schema.field(0).type), pa.array(sizes, pa.int64()),
                 pa.array(held, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        read, f"doc_id {kind}, n bigint, terms array<int>, tfs array<bigint>")


def scores(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Score of every row of ``tf``, whose columns go with the weights."""
    return (1_000_000_000 * tf // (1000 * tf + 12 * m[:, None])) @ weights


class Tree:
    """A block of documents: paths of terms, and for each node the largest counts and the least ``m`` below it.

    Rows of ``most`` and ``least`` are first the documents in the order of their paths, then the inner nodes.
    """

    def __init__(self, paths, counts, m, width):
        order = sorted(range(len(paths)), key=lambda i: paths[i])
        size = len(order)
        paths = [paths[i] for i in order]
        shared = [_common(a, b) for a, b in zip(paths, paths[1:])]
        self.order, self.below = np.array(order), {}
        self.most = np.zeros((2 * size, width), np.int64 if max(map(max, filter(len, counts)), default=0) > 2**31 - 1 else np.int32)
        self.least = np.zeros(2 * size, np.int64)
        for row, i in enumerate(order):
            self.most[row, np.frombuffer(paths[row], ">i4")] = counts[i]
            self.least[row] = m[i]
        self.root = self._grow(shared, size)

    def _grow(self, shared, size):
        """Nodes where neighbouring paths part, from a stack of open ones; neighbours that share more close first."""
        node, stack = size, []  # of [shared terms, children]
        last = 0
        for row, depth in enumerate([*shared, -1]):
            last = row
            while stack and stack[-1][0] > depth:
                _, children = stack.pop()
                children.append(last)
                last, node = self._close(children, node), node + 1
            if depth < 0:
                break
            if stack and stack[-1][0] == depth:
                stack[-1][1].append(last)
            else:
                stack.append([depth, [last]])
        return last

    def _close(self, children, node):
        leaves = np.concatenate([np.atleast_1d(c if c < len(self.order) else self.below[c][:, 0]) for c in children])
        if len(leaves) <= BUNDLE and leaves.max() < len(self.order):
            children = leaves
        children = np.array(children)
        self.most[node] = self.most[children].max(0)
        self.least[node] = self.least[children].min()
        self.below[node] = children[:, None]
        return node

    def search(self, weights, columns, found, ids, keep):
        """Add the block's documents to ``found``, a heap of the ``keep`` best (score, order of id) so far."""
        top = int(scores(weights, self.most[self.root:self.root + 1, columns].astype(np.int64), self.least[self.root:self.root + 1])[0])
        stack, size = [(top, self.root)], len(self.order)
        while stack:
            bound, node = stack.pop()
            if bound <= 0 or len(found) == keep and bound < found[0][0]:
                continue
            if node < size:
                entry = (bound, ids[self.order[node]])
                if len(found) < keep:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
                continue
            children = self.below[node]
            bounds = scores(weights, self.most[children, columns].astype(np.int64), self.least[children[:, 0]])
            good = (bounds >= (found[0][0] if len(found) == keep else 1)).nonzero()[0]
            stack.extend(sorted(zip(bounds[good].tolist(), children[good, 0].tolist())))


def _common(a: bytes, b: bytes) -> int:
    """How many terms two paths share at their beginnings."""
    x, y = np.frombuffer(a, ">i4"), np.frombuffer(b, ">i4")
    n = min(len(x), len(y))
    differ = x[:n] != y[:n]
    return int(differ.argmax()) if differ.any() else n


def _late(i):
    """Ids so that of equal scores the greater entry is the smaller id, null the least."""
    return (0, 0) if i is None else (1, -i)


def _block(docs: DataFrame, items: list, keep: int) -> DataFrame:
    """The best documents of each item of a block, from every task that holds some."""
    wanted = [(i, Counter(found)) for i, found in items]
    words = sorted(set().union(*(c for _, c in wanted)))
    held = saved(vectors(docs, words), "vectors")
    n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(words), np.int64)
    for term, n in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the items' terms
        df[term] = n
    by_df = np.argsort(-df, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[by_df] = np.arange(len(words))
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df]
    place = {w: i for i, w in enumerate(words)}
    asked = []
    for number, (_, found) in enumerate(wanted):
        at = [place[w] for w in found if df[place[w]]]
        asked.append((number, rank[at], np.array([weight[place[w]] * found[w] for w in found if df[place[w]]], np.int64)))
    asked = [a for a in asked if len(a[1])]
    width = max(1, int((df > 0).sum()))
    block = max(64, TREE_BYTES // (8 * width))

    def find(batches):
        best = {number: [] for number, _, _ in asked}

        def take(ids, sizes, paths, counts):
            m = 75 + 25 * np.array(sizes, np.int64) * n_docs // n_terms
            tree, keys = Tree(paths, counts, m, width), [_late(i) for i in ids]
            for number, columns, weights in asked:
                tree.search(weights, columns, best[number], keys, keep)

        ids, sizes, paths, counts = [], [], [], []
        for batch in sliced(batches, 1024):
            for i, n, at, tf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                    parts_of(batch.column(2)), parts_of(batch.column(3))):
                if not len(at):
                    continue
                ranks = rank[at]
                order = np.argsort(ranks)
                ids.append(i)
                sizes.append(n)
                paths.append(ranks[order].astype(">i4").tobytes())
                counts.append(tf[order])
                if len(ids) == block:
                    take(ids, sizes, paths, counts)
                    ids, sizes, paths, counts = [], [], [], []
        if ids:
            take(ids, sizes, paths, counts)
        rows = [(number, -late if there else None, score)
                for number, found in best.items() for score, (there, late) in found]
        for start in range(0, len(rows), 10_000):
            numbers, found, points = zip(*rows[start:start + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(found, pa.int64()),
                                              pa.array(points, pa.int64())], names=["item", "doc_id", "score"])

    hits = held.where("size(terms) > 0").mapInArrow(find, "item int, doc_id bigint, score bigint")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    names = docs.sparkSession.createDataFrame([(n, i) for n, (i, _) in enumerate(items)], "item int, item_id bigint")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, keep: int = 20) -> DataFrame:
    """The ``keep`` best documents of each item, best first, equal scores by id. Ids are integers."""
    texts = (items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
             .groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("text")), " ").alias("text")))
    out, block = None, []

    def searched(block, out):
        found = _block(docs, block, keep)
        return found if out is None else out.unionByName(saved(found, "found"))

    for row in texts.toLocalIterator():
        found = terms(row.text.encode())
        if found:
            block.append((row.item_id, found))
        if len(block) == ITEMS:
            out, block = searched(block, out), []
    if block:
        out = searched(block, out)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
