"""Packing token streams into sequences: order kept, cuts at document or sentence ends by dynamic programming."""

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mlframes.llm.common import SPACE, column, held, sliced, texts_of

#: About so many documents are packed together; a part ends early at so many tokens.
PART_DOCS, PART_TOKENS = 1024, 1 << 22
#: What a cut costs, in tokens of padding: at a sentence's end, and within one.
SENTENCE_CUT, WORD_CUT = 4, 16
#: Cuts within a sentence are considered every so many tokens.
STRIDE = 32
#: Words and pieces of words whose ids a worker remembers.
REMEMBERED = 1_600_000
ENDS = np.zeros(256, bool)
ENDS[[33, 46, 63]] = True  # ! . ?


# How the tokenizer cuts a word into pieces, here for the characters of ``PLAIN``.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


class Words(dict):
    """The ids of words between ASCII white space, as little-endian 32-bit numbers, each word encoded once.

    The tokenizer drops white space and never joins what stands on both sides of it, so a text's ids are those of
    its words. Words of ASCII and Latin-1 letters are cut here and their pieces, which repeat more than words do,
    given to the tokenizer's model, in half of the time; the tokenizer takes any other word whole.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        from tokenizers import Tokenizer, pre_tokenizers
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        # words and pieces not met since the younger tables began go when those are full; none is emptied at once
        self.pieces, self.old, self.old_pieces = {}, {}, {}
        self.most = most
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if word.isalpha():
                found = (word.decode().lower(),)
            elif word[-1:] in b".,;:!?" and word[:-1].isalpha():
                text = word.decode().lower()
                found = text[:-1], text[-1]
            else:
                text = word.decode("utf-8")
                found = PIECES.findall(text.lower()) if PLAIN.fullmatch(text) and "<|" not in text else None
            if found is None:
                ids, known = array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes(), True
            else:
                parts = [self.pieces.get(x) for x in found]
                known = None not in parts
                ids = b"".join(parts if known else [p or self._piece(x) for p, x in zip(parts, found)])
            if not known:  # a word with a new piece may be the only one of its kind: its pieces are kept, not yet the word
                return ids
        self[word] = ids
        self._turn()
        return ids

    def _piece(self, text: str) -> bytes:
        ids = self.old_pieces.get(text)
        if ids is None:
            ids = array("I", [t.id for t in self.model.tokenize(text if text.isascii() else text.translate(self.letters))]).tobytes()
        self.pieces[text] = ids
        self._turn()
        return ids

    def _turn(self):
        """Full young tables become the old ones."""
        if len(self) + len(self.pieces) > self.most // 2:
            self.old, self.old_pieces, self.pieces = dict(self), self.pieces, {}
            self.clear()


def encode(text: bytes, words: Words, end: int = 1):
    """The ids of a text with the end id, as bytes, and the places of its sentence ends."""
    parts = list(map(words.__getitem__, text.split()))
    ids = b"".join(parts) + end.to_bytes(4, "little")
    data = np.frombuffer(text, np.uint8)
    closed = np.empty(len(data), bool)  # last bytes of words
    gap = SPACE[data]
    closed[:-1] = gap[1:] & ~gap[:-1]
    closed[-1:] = ~gap[-1:]
    stops = ENDS[data[closed]]
    places = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    return ids, places[stops] // 4


def boundaries(n: int, stops: np.ndarray):
    """Places in a document of ``n`` ids where a sequence may end, and the price of each cut. No two neighbouring
    places are further apart than ``STRIDE``."""
    stops = np.unique(stops[(stops > 0) & (stops < n)])
    edges = np.concatenate([[0], stops, [n]])
    gaps = np.diff(edges)
    far = np.flatnonzero(gaps > STRIDE)
    inner = [np.arange(edges[i] + STRIDE, edges[i + 1], STRIDE) for i in far]
    places = np.concatenate([stops, *inner, [n]]).astype(np.int64)
    price = np.concatenate([np.full(len(stops), SENTENCE_CUT), np.full(sum(map(len, inner)), WORD_CUT), [0]]).astype(np.int64)
    order = np.argsort(places, kind="stable")
    return places[order], price[order]


def cuts(places: np.ndarray, price: np.ndarray, size: int) -> list[int]:
    """Ends of the sequences over ``places`` (ascending, gaps up to ``size``) that cost least: padding to ``size`` plus
    the price of each cut. Sequences that still have much padding are then split into powers of two.

    The cost of a sequence from j to i is size - (p[i] - p[j]) + price[i], so the best j minimises cost[j] + p[j]
    over a window of places that only moves on: a queue of rising values has it at its head.
    """
    at, pay = [0, *places.tolist()], [0, *price.tolist()]
    back = [0] * len(at)
    queue, head = [0], 0  # places whose cost[j] + p[j] rises
    value = [0]  # cost[j] + p[j]
    for i in range(1, len(at)):
        p = at[i]
        low = p - size
        while at[queue[head]] < low:
            head += 1
        j = queue[head]
        back[i] = j
        new = value[j] + size + pay[i]  # cost[i] + p[i], as cost[i] = value[j] + size - p[i] + price[i]
        value.append(new)
        while len(queue) > head and value[queue[-1]] >= new:
            queue.pop()
        queue.append(i)
    out, i = [], len(at) - 1
    while i:
        out.append(at[i])
        i = back[i]
    out.reverse()
    return finish(out, size)


def finish(ends: list[int], size: int) -> list[int]:
    """Split a sequence into powers of two where its padding would cost more than those cuts."""
    out, start = [], 0
    for end in ends:
        rest = end - start
        if rest & (rest - 1) and size - rest > WORD_CUT * (rest.bit_count() - 1):
            for bit in range(rest.bit_length() - 1, 0, -1):
                if rest & (1 << bit) and start + (1 << bit) < end:
                    start += 1 << bit
                    out.append(start)
        out.append(end)
        start = end
    return out


def _pieces(docs, size: int):
    """Rows of one part: (id, start, length, crc, tokens, sequence, offset) from (id, ids, stops) of its documents."""
    places, price, base = [], [], 0
    for _, ids, stops in docs:
        n = len(ids) // 4
        p, c = boundaries(n, stops)
        places.append(p + base)
        price.append(c)
        base += n
    ends = cuts(np.concatenate(places), np.concatenate(price), size)
    sequence, seq_start, done = 0, 0, 0
    for key, ids, _ in docs:
        n, start = len(ids) // 4, 0
        view = memoryview(ids)
        while start < n:
            length = min(n, ends[sequence] - done) - start
            yield (key, start, length, zlib.crc32(view[4 * start:4 * (start + length)]), n, sequence,
                   done + start - seq_start)
            start += length
            if done + start == ends[sequence]:
                seq_start = ends[sequence]
                sequence += 1
        done += n


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048,
         end: int = 1, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of documents in sequences of up to ``size`` (a power of two) ids: (doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset).

    A part holds about ``PART_DOCS`` documents, chosen by a hash of id and text, in the order of their ids (null first), then
    texts. Its number follows from the rows and their count alone, whatever the ids and the partitions of the input, so every
    run gives the same rows. Parts share no sequence, and a part ends early at ``PART_TOKENS`` ids, which bounds a task's
    memory beyond its longest text. Sequence numbers count within a part, the part's number above them (2**24 sequences each).

    A null text is empty and has its end id only; so has an empty one. Equal rows are packed each; other columns are ignored.
    """
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))
    parts = max(1, -(-docs.count() // PART_DOCS))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))
    rows = rows.withColumn("part", part).repartition("part").sortWithinPartitions("part", "doc_id", "text")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

    def run(batches):
        words, part_docs, now, first, tokens = held(f"{remembered} words of {tokenizer}", lambda: Words(tokenizer, remembered)), [], None, 0, 0

        def flush():
            nonlocal part_docs, first, tokens
            found = list(_pieces(part_docs, size))
            columns = list(zip(*found))
            columns[5] = [(now << 24) + first + s for s in columns[5]]
            first += found[-1][5] + 1
            part_docs, tokens = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

        for batch in sliced(batches):
            for key, text, part in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist()):
                if part != now or tokens > PART_TOKENS:
                    if part_docs:
                        yield flush()
                    first = first if part == now else 0
                    now = part
                ids, stops = encode(text, words, end)
                part_docs.append((key, ids, stops))
                tokens += len(ids) // 4
        if part_docs:
            yield flush()

    return rows.select("doc_id", "text", "part").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
