"""Removal of repeated runs of lines, found by winnowed line hashes and extended both ways, and of repeated passages of words."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from mlframes.llm.common import (MAP_BITS, WORD, column, fresh, hashed_words, inverses, key_map, may_hold, mix, parts_of, powers,
                                 saved, signed, sliced)

#: Words that make a run worth deleting, and words hashed together.
RUN_WORDS, GRAM_WORDS = 32, 16
#: Words that make a passage worth deleting wherever it starts and ends, and words hashed together to find candidates.
PASSAGE_WORDS, ANCHOR_WORDS = 50, 25
#: Bits of the map of repeated anchors.
ANCHOR_BITS = 1 << 26


#: What ends a line: a break, or white space after the end of a sentence.
LINE_END = re.compile(r"\n|[.!?][ \t]+")


def split_lines(text: str):
    """(start, end) of the lines of a text; a line of several sentences counts as that many lines."""
    out, begin = [], 0
    for stop in LINE_END.finditer(text):
        a, b = stop.span()
        out.append((begin, a if text[a] == "\n" else a + 1))
        begin = b
    out.append((begin, len(text)))
    return out


def count_lines(text: str) -> int:
    """How many lines ``split_lines`` finds."""
    return text.count("\n") + sum(map(text.count, (". ", "! ", "? ", ".\t", "!\t", "?\t"))) + 1


def spans_hashed(values: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of ``values[first:stop]`` for each pair; equal stretches have equal hashes wherever they stand."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(len(values)))])
    return mix((sums[stop] - sums[first]) * inverses(len(values) + 1)[first] + (stop - first + 1).astype(np.uint64))


def read_texts(texts):
    """(hash of each word, words before each text, hash of each line, number of its words, lines before each text) of
    texts one after the other, upper and lower case and white space aside; the lines are those of ``split_lines``."""
    lowered = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(lowered), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    starts, words = hashed_words(data)
    sentence = (data[:-1] == 33) | (data[:-1] == 46) | (data[:-1] == 63)
    breaks = data == 10
    breaks[1:] |= sentence & ((data[1:] == 32) | (data[1:] == 9))
    breaks = np.flatnonzero(breaks)
    first = np.concatenate([[0], np.searchsorted(starts, breaks), [len(starts)]])  # the first word of each line, and the end
    return (words, np.concatenate([[0], np.searchsorted(starts, ends)]), spans_hashed(words, first[:-1], first[1:]),
            np.diff(first), np.concatenate([[0], np.searchsorted(breaks, ends - 1) + 1]))


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on."""
    first = np.arange(max(0, len(words) - size + 1))
    return spans_hashed(words, first, first + size)


def last_least(values: np.ndarray, size: int):
    """(least of each ``size`` neighbours, its last place)."""
    def both(value, place, by):
        ahead = value[:-by] < value[by:]
        return np.where(ahead, value[:-by], value[by:]), np.where(ahead, place[:-by], place[by:])
    width, found = 1, (values, np.arange(len(values)))
    while 2 * width <= size:
        found, width = both(*found, width), 2 * width
    return both(*found, size - width) if size > width else found


def segments(words: np.ndarray, before: np.ndarray):
    """(first passage, number of passages, anchor, hash of all its words) of each segment of texts one after the other.

    A passage is the ``PASSAGE_WORDS`` words from a word on; its anchor is the smallest hash of ``ANCHOR_WORDS`` words in
    a row in it, the last on ties. A segment is the passages in a row with their anchor at one place: at most
    ``PASSAGE_WORDS - ANCHOR_WORDS + 1``, no two alike. Equal passages have equal anchors, and copies of a longer
    stretch equal segments except at its ends.
    """
    count = len(words) - PASSAGE_WORDS + 1
    if count < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    least, place = last_least(rolled(words, ANCHOR_WORDS), PASSAGE_WORDS - ANCHOR_WORDS + 1)
    whole = np.flatnonzero(np.arange(count) + PASSAGE_WORDS <= np.repeat(before[1:], np.diff(before))[:count])
    place = place[whole]
    new = np.flatnonzero(np.diff(place, prepend=-1))
    at, sizes = whole[new], np.diff(new, append=len(whole))
    return at, sizes, least[at], spans_hashed(words, at, at + sizes + PASSAGE_WORDS - 1)


def _least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place of the least of ``values[first:last + 1]`` for each pair, the last on ties."""
    chosen, level = np.zeros(len(first), np.int64), np.frexp(last - first + 1.0)[1] - 1
    place = np.arange(len(values))
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            a, b = place[:-(1 << k >> 1)], place[1 << k >> 1:]
            place = np.where(values[a] < values[b], a, b)
        here = np.flatnonzero(level == k)
        a, b = place[first[here]], place[last[here] - (1 << k) + 1]
        chosen[here] = np.where(values[a] < values[b], a, b)
    return chosen


def winnow(lines: np.ndarray, words: np.ndarray, before: np.ndarray, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS):
    """(line at which each window starts, hash of the window, line of the gram it chooses, hash of that gram) of texts one
    after the other. A window chooses the gram with the smallest hash in it, the last on ties.

    A gram is as many lines from a line on as make ``gram_words`` words, a window those that make ``run_words``. Any
    run that two documents share and that has ``run_words`` words covers a window, so both choose its gram.
    """
    n = len(lines)
    counted = np.concatenate([[0], np.cumsum(words)])
    gram_end = np.searchsorted(counted, counted[:-1] + gram_words)  # lines up to here make a gram
    window_end = np.searchsorted(counted, counted[:-1] + run_words)
    first = np.flatnonzero(window_end <= np.repeat(before[1:], np.diff(before)))
    value = spans_hashed(lines, np.arange(n), np.minimum(gram_end, n))
    # the last gram that ends within each window
    last = np.searchsorted(gram_end, window_end[first], side="right") - 1
    chosen = _least_between(value, first, last)
    return first, spans_hashed(lines, first, window_end[first]), chosen, value[chosen]


def _lists(rows: np.ndarray, values: np.ndarray, kind) -> pa.ListArray:
    """Values one after the other as lists; ``rows`` holds the number of values before each list."""
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(values, kind))


def _packed(rows: np.ndarray, values: np.ndarray) -> pa.Array:
    """``_lists`` as bytes: Spark moves and stores a row's values at once, not one by one."""
    return pa.Array.from_buffers(pa.binary(), len(rows) - 1, [
        None, pa.py_buffer((rows * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind):
    """(values before each row from 0 on, the rows' values one after the other) of a column of ``_packed`` values."""
    column, size = column.cast(pa.binary()), np.dtype(kind).itemsize
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset:column.offset + len(column) + 1]
    values = np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]].view(kind)
    return (ends - ends[0]).astype(np.int64) // size, values


def _parts(column: pa.Array, kind) -> list[np.ndarray]:
    """The arrays of a column of ``_packed`` values."""
    before, values = _unpacked(column, kind)
    return [values[a:b] for a, b in zip(before[:-1], before[1:])]


#: Two numbers from 0 to 2**31 - 1 as one: Spark collects and Arrow moves plain numbers faster than structs.
LOW_HALF = (1 << 32) - 1


def _paired(high, low):
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long"))


def _halves(values: np.ndarray):
    return values >> 32, values & LOW_HALF


def _by_bytes(batches, place: int, limit: int = 1 << 18):
    """Arrow batches cut after about ``limit`` bytes of a column of texts."""
    for batch in batches:
        sizes = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(place)).to_numpy(zero_copy_only=False).astype(float)))
        cuts = np.searchsorted(sizes, np.arange(1, int(sizes[-1]) // limit + 1) * limit) + 1 if len(sizes) else []
        cuts = np.unique(np.concatenate([[0], cuts, [batch.num_rows]])).astype(int)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b > a:
                yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()


def _hash_documents(batches):
    for batch in _by_bytes(batches, 3):
        words, word_rows, lines, counts, line_rows = read_texts(batch.column(3).to_pylist())
        _, _, chosen, value = winnow(lines, counts, line_rows)
        new = np.flatnonzero(np.diff(chosen, prepend=-1))
        at, sizes, anchor, segment = segments(words, word_rows)
        print_rows, segment_rows = np.searchsorted(chosen[new], line_rows), np.searchsorted(at, word_rows)
        at = at - np.repeat(word_rows[:-1], np.diff(segment_rows))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), _packed(line_rows, signed(lines)), _packed(line_rows, counts.astype(np.int32)),
             _lists(print_rows, signed(value[new]), pa.int64()), _lists(segment_rows, signed(anchor), pa.int64()),
             *(_packed(segment_rows, x) for x in (signed(segment), at.astype(np.int32), sizes.astype(np.int32)))],
            names="id k1 k2 lines words prints anchors segments ats sizes".split())


def _known(told, hashes: np.ndarray, size: int) -> np.ndarray:
    """Places of the hashes whose bit is set."""
    bit = (hashes & np.uint64(size - 1)).astype(np.int64)
    return np.flatnonzero(told.value[bit >> 6] >> (bit & 63) & 1)


def _windows(told):
    """Windows (id, k1, k2, print, at) whose fingerprint may stand in another place, from hashed documents."""
    def run(batches):
        for batch in sliced(batches):
            before, lines = _unpacked(batch.column(3), np.uint64)
            first, whole, _, value = winnow(lines, _unpacked(batch.column(4), np.int32)[1].astype(np.int64), before)
            at = _known(told, value, MAP_BITS)
            row = np.searchsorted(before, first[at], side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.select([0, 1, 2]).take(pa.array(row)).columns, pa.array(signed(whole[at])),
                 pa.array(first[at] - before[row], pa.int32())], names="id k1 k2 print at".split())
    return run


def _segments(told):
    """Segments (id, k1, k2, anchor, segment, at, size) whose anchor may stand in another place, from hashed documents."""
    def run(batches):
        for batch in sliced(batches):
            before, segment = _unpacked(batch.column(4), np.int64)
            anchor = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            at, size = (_unpacked(batch.column(i), np.int32)[1] for i in (5, 6))
            found = _known(told, anchor.view(np.uint64), ANCHOR_BITS)
            row = np.searchsorted(before, found, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.select([0, 1, 2]).take(pa.array(row)).columns, *(pa.array(x[found]) for x in (anchor, segment, at, size))],
                names="id k1 k2 anchor segment at size".split())
    return run


def _passages(batches):
    """Passages (id, k1, k2, print, at) in the given segments of texts."""
    for batch in _by_bytes(batches, 3):
        words, before, *_ = read_texts(batch.column(3).to_pylist())
        spots = batch.column(4)
        rows = np.repeat(np.arange(batch.num_rows), np.diff(spots.offsets.to_numpy()))
        at, size = _halves(spots.flatten().to_numpy(zero_copy_only=False))
        place = np.repeat(at, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        rows = np.repeat(rows, size)
        first = place + before[rows]
        yield pa.RecordBatch.from_arrays(
            [*batch.select([0, 1, 2]).take(pa.array(rows)).columns, pa.array(signed(spans_hashed(words, first, first + PASSAGE_WORDS))),
             pa.array(place, pa.int32())], names="id k1 k2 print at".split())


def _joined(batches):
    """Stretches of words (k1, k2, a, b, words) covered by the repeated passages of a document."""
    for batch in sliced(batches):
        rows, first, end = [], [], []
        spots = batch.column(2)
        for i, part in enumerate(parts_of(spots)):
            a, b = _halves(np.sort(part))
            b = np.maximum.accumulate(b)
            new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
            rows.append(np.full(len(new), i))
            first.append(a[new])
            end.append(b[np.concatenate([new[1:] - 1, [len(b) - 1]])])
        if rows:
            taken = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(np.concatenate(first), pa.int32()),
                 pa.array(np.concatenate(end), pa.int32()), pa.array(np.ones(len(taken), bool))], names=["k1", "k2", "a", "b", "words"])


def matched(lines, words, other, shifts, run_words: int = RUN_WORDS):
    """Runs of lines equal to an earlier text's, each (first, end): every shift between the two texts is followed as
    far as the lines agree, in both directions. A shift whose seeds a run already covers is not followed again."""
    out, covered = [], np.zeros(len(lines) + 1, bool)
    before = np.concatenate([[0], np.cumsum(words)])
    for shift, seeds in shifts:
        if all(covered[s] for s in seeds):
            continue
        lo, hi = max(0, shift), min(len(lines), len(other) + shift)
        agree = lines[lo:hi] == other[lo - shift:hi - shift]
        edges = np.flatnonzero(np.diff(agree, prepend=False, append=False)) + lo
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if before[b] - before[a] >= run_words:
                out.append((a, b))
                covered[a:b] = True
    return out


def _extend(batches):
    for batch in sliced(batches):
        k1, k2, seeds, lines, words, other = batch.columns
        rows, first, end = [], [], []
        for i, (seed, x, w, y) in enumerate(zip(parts_of(seeds), _parts(lines, np.int64), _parts(words, np.int32), _parts(other, np.int64))):
            a, t = _halves(seed)
            shifts: dict = {}
            for place, shift in sorted(zip(a.tolist(), (a - t).tolist())):
                shifts.setdefault(shift, []).append(place)
            for begin, stop in matched(x, w, y, sorted(shifts.items(), key=lambda s: abs(s[0]))):
                rows.append(i)
                first.append(begin)
                end.append(stop)
        taken = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([k1.take(taken), k2.take(taken), pa.array(first, pa.int32()), pa.array(end, pa.int32())],
                                         names=["k1", "k2", "a", "b"])


def without(text: str, runs, passages=()) -> tuple[str, list[tuple[int, int]], int, int]:
    """The text without the lines of the runs and the words of the passages, the character spans deleted, and the
    numbers of lines and of those deleted whole. A line break goes with a line that has no sentence left."""
    spans = split_lines(text)
    gone = np.zeros(len(spans), bool)
    for a, b in runs:
        gone[a:b] = True
    parts: dict = {}
    if passages:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.flatnonzero(np.diff((points != 32) & ((points < 9) | (points > 13)), prepend=False, append=False))
        begins, stops = edges[::2], edges[1::2]
        lost = np.zeros(len(begins) + 1, np.int64)
        for a, b in passages:
            lost[a + 1:b + 1] = 1
        lost = np.cumsum(lost)
        low, high = (np.searchsorted(begins, [s[k] for s in spans]) for k in (0, 1))
        for a, b in passages:
            inside = np.flatnonzero((high > a) & (low < b) | (low == high) & (low > a) & (low < b))
            for i in inside[~gone[inside]].tolist():
                if lost[high[i]] - lost[low[i]] == high[i] - low[i]:
                    gone[i] = True
                else:
                    parts.setdefault(i, []).append((int(begins[max(a, low[i])]), int(stops[min(b, high[i]) - 1]), b >= high[i]))
    out, pieces, dropped = [], [], False
    for i, (a, b) in enumerate(spans):
        end = spans[i + 1][0] if i + 1 < len(spans) else len(text)
        gap = text[b:end]
        if gone[i]:
            dropped = True
        else:
            for x, y, last in sorted(parts.get(i, ())):
                dropped = True
                pieces.append(text[a:x].rstrip(" \t") if last else text[a:x])
                a = y
                while a < b and text[a] in " \t\r\x0b\x0c":
                    a += 1
            pieces.append(text[a:b] + ("" if "\n" in gap else gap))
        if "\n" in gap or i + 1 == len(spans):
            if pieces or not dropped:
                line = "".join(pieces)
                out.append(line.rstrip(" \t") if dropped else line)
            pieces, dropped = [], False
    edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
    cut = [(spans[a][0], spans[b - 1][1]) for a, b in zip(edges[::2], edges[1::2])]
    if passages:
        cut, found = [], sorted(cut + [(int(begins[a]), int(stops[b - 1])) for a, b in passages])
        for a, b in found:
            if cut and a <= cut[-1][1]:
                cut[-1] = cut[-1][0], max(b, cut[-1][1])
            else:
                cut.append((a, b))
    return "\n".join(out), cut, len(spans), int(gone.sum())


def _delete(place: int, runs: int):
    def run(batches):
        for batch in sliced(batches):
            texts, spans, total, gone = [], [], [], []
            for text, found in zip(batch.column(place).to_pylist(), batch.column(runs).to_pylist()):
                if found:
                    text, cut, n, m = without(text, *([(r >> 33, r >> 1 & LOW_HALF) for r in found if r & 1 == kind] for kind in (0, 1)))
                else:
                    cut, n, m = [], count_lines(text) if text is not None else 0, 0
                texts.append(text)
                spans.append(",".join(f"{a}:{b}" for a, b in cut))
                total.append(n)
                gone.append(m)
            kept = [batch.column(i) for i in range(batch.num_columns) if i != runs]
            kept[place] = pa.array(texts, pa.string())
            names = [n for i, n in enumerate(batch.schema.names) if i != runs]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.string())],
                                             names=[*names, "t", "g", "s"])
    return run


def _repeated(hashes: DataFrame, name: str, size: int):
    """A broadcast map of ``size`` bits, with those set that fingerprints of more than one document or place choose."""
    again = hashes.select(F.explode(name).alias("print")).groupBy("print").count().where("count > 1")
    words = (again.groupBy(F.expr(f"(print & {size - 1}) div 64").alias("place"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(print & 63 as int))")).alias("word")).toArrow())
    bits = np.zeros(size // 64, np.int64)  # at most so many rows reach the driver
    bits[words.column("place").to_numpy()] = words.column("word").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(bits)


def _repeated_passages(hashes: DataFrame, slim: DataFrame) -> DataFrame:
    """Stretches of words (k1, k2, a, b, words) in which every passage stands earlier as well. Of a passage that
    overlaps its own first place only the words after that place go.

    A segment that stands earlier goes as a whole. Passages are compared one by one only where a segment that stands
    first shares its anchor with another one, and where a segment overlaps its own first place: the first place of any
    passage lies in the first place of a segment, so the outcome is that of comparing all passages.
    """
    spot = F.struct("id", "k1", "k2", "at")
    cut = hashes.select("id", "k1", "k2", "anchors", "segments", "ats", "sizes").mapInArrow(
        _segments(_repeated(hashes, "anchors", ANCHOR_BITS)), "id long, k1 long, k2 int, anchor long, segment long, at int, size int")
    cut = saved(cut, "segments")
    first = saved(cut.groupBy("anchor", "segment").agg(F.min(spot).alias("first"), F.max(spot).alias("last"), F.max("size").alias("size")),
                  "segment_firsts")
    again = first.where("first <> last").select("segment", "first")
    later = may_hold(cut, key_map(again, "segment"), "segment").join(again, "segment").where(spot != F.col("first"))
    own = (F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2"))
    later = saved(later.select("k1", "k2", "at", "size", F.when(own & (F.col("at") < F.col("first.at") + PASSAGE_WORDS), F.col("first.at"))
                               .alias("near")), "later_segments")
    shared = first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    near = later.where("near is not null")
    open_ = (may_hold(first, key_map(shared, "anchor"), "anchor").join(shared, "anchor").select("first.k1", "first.k2", "first.at", "size")
             .union(near.select("k1", "k2", "at", "size")).union(near.select("k1", "k2", "near", "size")))
    open_ = saved(open_.groupBy("k1", "k2").agg(F.collect_set(_paired(F.col("at"), F.col("size"))).alias("spots")), "open_segments")
    texts = (may_hold(slim, key_map(open_, "k1"), "k1").join(open_, ["k1", "k2"])
             .select("id", "k1", "k2", "text", "spots"))
    prints = saved(texts.mapInArrow(_passages, "id long, k1 long, k2 int, print long, at int"), "passages")
    begun = (prints.groupBy("print").agg(F.min(spot).alias("first"), F.max(spot).alias("last"))
             .where("first <> last").select("print", "first"))
    begun = saved(begun, "passage_firsts")
    begin = F.when(own, F.greatest("at", F.col("first.at") + PASSAGE_WORDS)).otherwise(F.col("at"))
    single = (may_hold(prints, key_map(begun, "print"), "print").join(begun, "print").where(spot != F.col("first"))
              .select("k1", "k2", _paired(begin, F.col("at") + PASSAGE_WORDS).alias("spot")))
    whole = later.where("near is null").select(
        "k1", "k2", _paired(F.col("at"), F.col("at") + F.col("size") + (PASSAGE_WORDS - 1)).alias("spot"))
    return (single.union(whole).groupBy("k1", "k2").agg(F.collect_set("spot").alias("spots"))
            .mapInArrow(_joined, "k1 long, k2 int, a int, b int, words boolean"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   names=("n_lines", "n_deleted", "deleted")) -> DataFrame:
    """The rows of ``docs`` with their texts free of repeated runs, the numbers of lines and of deleted ones, and the
    deleted character spans (``start:end``, comma-joined) of the original text.

    A run repeats when its lines, ``RUN_WORDS`` words or more in all, stand in a document of a smaller id, or earlier in
    the same text. Windows over the line hashes choose fingerprints; those that occur again give their windows, and each window is
    tied to its first place (ids ascending), never to all others; between two texts so tied every run of equal lines
    is followed both ways. The first place of a run always stays. Shorter repeated lines, such as licence notes, stay.
    A passage of ``PASSAGE_WORDS`` words or more that stands earlier goes wherever it starts and ends, word by word:
    the smallest hashes within passages cut texts into segments, and segments, or single passages where segments differ,
    are compared with their first place.

    A line of several sentences counts as that many lines, so passages within a paragraph are found. A null text stays
    null and an empty one empty. Rows equal in id and text are one document and are treated alike; rows of one id
    with other texts, or with a null id, are ordered by a hash of the text, null ids first. The names must be free.
    """
    k1, k2, runs = fresh([*docs.columns, *names], "key_one", "key_two", "runs")
    text = column(text_col).cast("string")
    keyed = docs.withColumns({k1: F.xxhash64(column(id_col), text), k2: F.hash(text, column(id_col))})
    slim = keyed.where(text.isNotNull()).select(column(id_col).cast("long").alias("id"), F.col(k1).alias("k1"), F.col(k2).alias("k2"),
                                                text.alias("text"))
    schema = ("id long, k1 long, k2 int, lines binary, words binary, prints array<long>, "
              "anchors array<long>, segments binary, ats binary, sizes binary")
    hashes = saved(slim.mapInArrow(_hash_documents, schema), "lines")
    told = _repeated(hashes, "prints", MAP_BITS)
    spot = F.struct("id", "k1", "k2", "at")
    prints = hashes.select("id", "k1", "k2", "lines", "words").mapInArrow(
        _windows(told), "id long, k1 long, k2 int, print long, at int")
    prints = saved(prints, "windows")
    first = saved(prints.groupBy("print").agg(F.min(spot).alias("first"), F.max(spot).alias("last"))
                  .where("first <> last").select("print", "first"), "firsts")
    later = (may_hold(prints, key_map(first, "print"), "print").join(first, "print").where(spot != F.col("first"))
             .select("k1", "k2", F.col("first.k1").alias("f1"), F.col("first.k2").alias("f2"),
                     _paired(F.col("at"), F.col("first.at")).alias("seed")))
    pairs = saved(later.groupBy("k1", "k2", "f1", "f2").agg(F.collect_set("seed").alias("seeds")), "pairs")
    met = key_map(pairs.select("k1").union(pairs.select("f1")), "k1")
    once = may_hold(hashes.select("k1", "k2", "lines", "words"), met, "k1").dropDuplicates(["k1", "k2"])
    sides = (pairs.join(once, ["k1", "k2"])
             .join(once.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), F.col("lines").alias("other")), ["f1", "f2"])
             .select("k1", "k2", "seeds", "lines", "words", "other"))
    found = sides.mapInArrow(_extend, "k1 long, k2 int, a int, b int").withColumn("words", F.lit(False))
    found = found.union(_repeated_passages(hashes, slim))
    run = F.shiftleft(_paired(F.col("a"), F.col("b")), 1).bitwiseOR(F.col("words").cast("long"))
    found = saved(found.groupBy("k1", "k2").agg(F.collect_set(run).alias("runs")), "runs")
    o1, o2 = fresh(keyed.columns, "other_one", "other_two")
    found = found.select(F.col("k1").alias(o1), F.col("k2").alias(o2), F.col("runs").alias(runs))
    keyed, changed = keyed.withColumn(text_col, text), key_map(found, o1)
    touched = may_hold(keyed, changed, k1).join(found, (column(k1) == column(o1)) & (column(k2) == column(o2)), "left")
    whole = may_hold(keyed, changed, k1, hold=False).withColumn(runs, F.lit(None).cast(found.schema[runs].dataType))
    joined = touched.select(*docs.columns, runs).unionByName(whole.select(*docs.columns, runs))
    out = StructType(list(docs.withColumn(text_col, text).schema.fields))
    out = out.add(names[0], "long").add(names[1], "long").add(names[2], "string")
    return joined.mapInArrow(_delete(docs.columns.index(text_col), len(docs.columns)), out)


def keep_unrepeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents without their repeated runs; those of which nothing is left go, as do empty ones. The length
    follows the text; other columns stay."""
    names = fresh(docs.columns, "n_lines", "n_deleted", "deleted")
    left = remove_repeats(docs, id_col, text_col, names).drop(*names)
    left = left.where(F.regexp_like(column(text_col), F.lit(WORD)))
    if length_col in docs.columns:
        left = left.withColumn(length_col, F.length(column(text_col)).cast(docs.schema[length_col].dataType))
    return left
