"""Repair of conversations: the cheapest edits after which the roles' initials read ``(s?(ua)+)?``.

A turn has one fault at most, the first that holds of: blank (nothing but white space), duplicate (role and text seen earlier
in the conversation), truncated (the last character that is not white space is none of ``. ! ?``). Keeping a turn costs 0, a
new role (user or assistant) 2, deleting 3, inserting an empty user or assistant turn 2; blank and duplicate turns must go,
and a truncated one that stays adds 1. Of equally cheap edits those count whose initials (D, I, K, R) come first in ASCII.

Turns become symbols of role and fault. Equal consecutive symbols are one run, and a run of n is n steps of one min-plus
matrix over four states (nothing yet, after system, after user, after assistant), taken by binary powers that a worker keeps.
The cost to go is known backwards, the edits follow forwards, inside a run by halves.

Rows are cut by range of (conversation, turn, role, text), so a long conversation lies in many tasks, and gathered in blocks
of bounded size. Where a conversation may go on in another block, the block is first one matrix; the matrices, one per block,
are put in order per conversation and give each block its cost to go and its state at entry. Texts stay in their blocks. Only
the digest of a whole conversation must pass through one task, as a stream of blocks.

Nulls: a null role or text is one space; null turns come first; a null conversation is one of its own. Turns are integers;
equal turns go by role, then text, so repeated rows are neighbours. A conversation without rows has no edits. Very long texts
fill a block of their own. Empty tables give no rows; columns beside the four named ones are left out.
"""

import hashlib
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from mlframes.llm.common import saved
from mlframes.plans.joins import join_on

#: Rows and characters of text at which a block ends.
ROWS, CHARS = 65_536, 4 << 20

SPACE = r"\x20\x09-\x0D"
_NEVER = 1 << 40
#: From a state by a kept role's initial: s, u, a.
_KEEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
#: The state after the turn that an insertion or a new role makes, and that turn's role.
_MADE, _ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: Cost to go at the end of a conversation: the turns still to insert.
END = (0, 4, 2, 0)
GO = 0  # the symbol of a turn that must be deleted; others are 1 + 4 * truncated + initial


def _joined(a, b):
    """Product of two min-plus matrices."""
    return (a[:, :, None] + b[None]).min(1)


def _inserts():
    m = np.full((4, 4), _NEVER)
    np.fill_diagonal(m, 0)
    for state in range(4):
        m[state, _MADE[state]] = 2
    return _joined(_joined(m, m), m)


def _step(symbol):
    m = np.full((4, 4), _NEVER)
    for state in range(4):
        m[state, state] = 3
        if symbol != GO:
            more, initial = divmod(symbol - 1, 4)
            m[state, _MADE[state]] = 2 + more
            if (state, initial) in _KEEP:
                m[state, _KEEP[state, initial]] = more
    return _joined(_inserts(), m)


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> np.ndarray:
    """Cheapest costs between states over ``2 ** k`` turns of one symbol, insertions before each included."""
    return _joined(power(symbol, k - 1), power(symbol, k - 1)) if k else _step(symbol)


def _bits(n):
    return [k for k in range(n.bit_length()) if n >> k & 1]


def runs(symbols: bytes):
    return [(symbol, sum(1 for _ in same)) for symbol, same in groupby(symbols)]


def matrix(symbols: bytes) -> np.ndarray:
    """Cheapest costs between the states before and after the turns."""
    out = np.where(np.eye(4, dtype=bool), 0, _NEVER)
    for symbol, n in runs(symbols):
        for k in _bits(n):
            out = np.minimum(_joined(out, power(symbol, k)), _NEVER)
    return out


def to_go(symbol: int, n: int, after):
    """Cost to go before ``n`` turns of one symbol, from that after them."""
    for k in _bits(n):
        after = (power(symbol, k) + np.asarray(after)).min(1)
    return after


def unroll(symbols: bytes, state: int, after) -> tuple[str, int]:
    """Initials of the cheapest edits, the first in ASCII, from a state and the cost to go after the turns; and the state then."""
    out, steps, at = [], runs(symbols), [after]
    for symbol, n in reversed(steps[1:]):
        at.append(to_go(symbol, n, at[-1]))
    for (symbol, n), then in zip(steps, reversed(at)):
        state = _unroll_run(symbol, n, state, then, out)
    return "".join(out), state


def _unroll_run(symbol, n, state, after, out):
    while n > 1:
        k = (n - 1).bit_length() - 1
        state = _unroll_run(symbol, n - (1 << k), state, (power(symbol, k) + np.asarray(after)).min(1), out)
        n = 1 << k
    after, now = [int(c) for c in after], [int(c) for c in (power(symbol, 0) + np.asarray(after)).min(1)]
    more, initial = divmod(symbol - 1, 4)
    while True:
        if 3 + after[state] == now[state]:
            out.append("D")
            return state
        if 2 + now[_MADE[state]] == now[state]:
            out.append("I")
            state = _MADE[state]
        elif symbol != GO and (state, initial) in _KEEP and more + after[_KEEP[state, initial]] == now[state]:
            out.append("K")
            return _KEEP[state, initial]
        else:
            out.append("R")
            return _MADE[state]


def repaired_turns(edits: str, state: int, roles, texts):
    """Roles and texts that the edits leave, from a state before them."""
    out_roles, out_texts, row = [], [], 0
    for edit in edits:
        if edit in "IR":
            out_roles.append(_ROLE[state])
            out_texts.append("" if edit == "I" else texts[row])
            state = _MADE[state]
        elif edit == "K":
            out_roles.append(roles[row])
            out_texts.append(texts[row])
            state = _KEEP[state, "sua".index(roles[row][0])]
        row += edit != "I"
    return out_roles, out_texts


def _slim(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"),
                       *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def _with_faults(rows: DataFrame) -> DataFrame:
    """Add ``fault``: 1 blank, 2 duplicate of an earlier turn, 3 truncated, else 0. Roles and texts that two turns of a
    conversation share are found by an aggregate over their digests, so only those digests are shuffled."""
    at, key = F.struct(F.col("turn").isNotNull(), F.col("turn")), F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary")))
    rows = rows.withColumn("digest", key)
    shared = saved(rows.groupBy("conv_id", "digest").agg(F.min(at).alias("first"), F.max(at).alias("last"))
                   .where("first < last").drop("last"), "shared")
    fault = (F.when(~F.col("text").rlike(f"[^{SPACE}]"), 1).when(F.col("first") < at, 2)
             .when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), 3).otherwise(0))
    return join_on(rows, shared, ["conv_id", "digest"], "left").withColumn("fault", fault).drop("first", "digest")


def _blocks(rows: DataFrame, most_rows: int) -> DataFrame:
    """Sorted rows in blocks of one conversation each, saved. ``edge`` marks those whose conversation may go on elsewhere:
    the first and the last of a task, and all of a conversation with more than one block."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    ranged = rows.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "role", F.substring("text", 1, 64))
    ordered = ranged.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")

    def gather(batches):
        part, number, block, waiting = TaskContext.get().partitionId(), 0, None, None
        schema = None

        def made(b, edge):
            b["edge"] = edge
            return pa.RecordBatch.from_pylist([b], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([
                ("conv_id", batch.schema.field(0).type), ("part", pa.int32()), ("block", pa.int64()), ("edge", pa.bool_()),
                ("turns", pa.list_(pa.int64())), ("faults", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
            for conv, turn, role, text, fault in zip(*[c.to_pylist() for c in batch.columns]):
                other = block is None or conv != block["conv_id"]
                if other or len(block["turns"]) >= most_rows or chars > CHARS:
                    if block is not None:
                        yield made(block, number == 0 or not other or block["edge"])
                        number += 1
                    block = {"conv_id": conv, "part": part, "block": number, "edge": block is not None and not other, "turns": [],
                             "faults": b"", "roles": [], "texts": []}
                    faults, chars = bytearray(), 0
                    waiting = waiting if block["edge"] else None
                if fault in (0, 3) and waiting == (turn, role, text):
                    fault = 2
                waiting = (turn, role, text)
                block["turns"].append(turn)
                block["roles"].append(role)
                block["texts"].append(text)
                faults.append(fault)
                block["faults"] = faults
                chars += len(text)
        if block is not None:
            yield made(block, True)

    return saved(ordered.select("conv_id", "turn", "role", "text", "fault").mapInArrow(
        gather, f"conv_id {kind}, part int, block bigint, edge boolean, turns array<bigint>, faults binary, "
                "roles array<string>, texts array<string>"), "blocks")


def _symbols(faults: bytes, roles) -> bytes:
    initials = ["sua".find(r[:1]) if r else -1 for r in roles]
    return bytes(GO if f in (1, 2) else 1 + 4 * (f == 3) + (i if i >= 0 else 3) for f, i in zip(faults, initials))


def _per_row(make, names, types):
    """A function over Arrow batches from one over rows as dicts."""
    schema = pa.schema(list(zip(names, types)))

    def over(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = [make(r) for r in batch.slice(start, 256).to_pylist()]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)
    return over


def _chain(blocks: DataFrame) -> DataFrame:
    """For each block of a conversation in several: cost to go after it, state at its entry, the turn and initial before
    it, and whether it is the last."""
    def summed(r):
        return (r["part"], r["block"], matrix(_symbols(r["faults"], r["roles"])).ravel().tolist(), r["turns"][-1], r["roles"][-1][:1])

    kind = blocks.schema["conv_id"].dataType.simpleString()
    edges = blocks.where("edge")
    sums = edges.select("part", "block", "turns", "faults", "roles").mapInArrow(
        _per_row(summed, ("part", "block", "costs", "turn", "initial"),
                 (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.string())),
        "part int, block bigint, costs array<bigint>, turn bigint, initial string")
    sums = saved(join_on(sums, edges.select("conv_id", "part", "block"), ["part", "block"]), "sums")

    def backwards(table):
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"]))
        after = np.array(END)
        for r in reversed(rows):
            r["after"] = after.tolist()
            after = (np.array(r["costs"]).reshape(4, 4) + after).min(1)
        for r, then in zip(rows, [*rows[1:], None]):
            r["last"] = then is None
        for before, r in zip([None, *rows], rows):
            r["turn_before"], r["initial_before"] = (before["turn"], before["initial"]) if before else (None, None)
        return pa.Table.from_pylist(rows, schema=pa.schema(
            [table.schema.field("conv_id"), ("part", pa.int32()), ("block", pa.int64()), ("after", pa.list_(pa.int64())),
             ("last", pa.bool_()), ("turn_before", pa.int64()), ("initial_before", pa.string())]))

    told = saved(sums.groupBy("conv_id").applyInArrow(
        backwards, f"conv_id {kind}, part int, block bigint, after array<bigint>, last boolean, turn_before bigint, initial_before string"),
        "told")

    def exits(r):
        symbols = _symbols(r["faults"], r["roles"])
        return r["part"], r["block"], [unroll(symbols, state, r["after"])[1] for state in range(4)]

    left = join_on(edges.select("part", "block", "faults", "roles"), told.select("part", "block", "after"), ["part", "block"]).mapInArrow(
        _per_row(exits, ("part", "block", "exits"), (pa.int32(), pa.int64(), pa.list_(pa.int32()))), "part int, block bigint, exits array<int>")
    both = join_on(told.select("conv_id", "part", "block"), left, ["part", "block"])

    def forwards(table):
        state, rows = 0, sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"]))
        for r in rows:
            r["entry"], state = state, r["exits"][state]
        return pa.Table.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("block", pa.int64()), ("entry", pa.int32())]))

    entries = both.groupBy("conv_id").applyInArrow(forwards, "part int, block bigint, entry int")
    return saved(join_on(told.drop("conv_id"), entries, ["part", "block"]), "chain")


def repair(rows: DataFrame, most_rows: int = ROWS) -> DataFrame:
    """The repaired conversations in blocks, in order of (part, block): edits, roles and texts that are left, and what the
    block adds to the counts of faults, illegal neighbours, turns and cost. ``whole`` tells blocks that hold all of their
    conversation. ``turns`` has them row by row. Conversations without rows are not there."""
    blocks = _blocks(_with_faults(_slim(rows)), most_rows)
    chain = _chain(blocks)
    names = ("conv_id", "part", "block", "whole", "edits", "roles", "texts", "blank", "duplicate", "truncated", "illegal", "cost",
             "least_turn", "most_turn", "n_turns")

    def made(r):
        symbols, faults = _symbols(r["faults"], r["roles"]), r["faults"]
        whole = not r["edge"]
        entry, after, last = (0, END, True) if whole else (r["entry"], r["after"], r["last"])
        edits, state = unroll(symbols, entry, after)
        while last and END[state]:
            edits, state = edits + "I", _MADE[state]
        roles, texts = repaired_turns(edits, entry, r["roles"], r["texts"])
        stays = (f for f, e in zip(faults, edits.replace("I", "")) if e != "D")
        cost = 3 * edits.count("D") + 2 * (edits.count("I") + edits.count("R")) + sum(f == 3 for f in stays)
        initials = ([] if whole or r["initial_before"] is None else [r["initial_before"]]) + [x[:1] for x in r["roles"]]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = {t for t in r["turns"] if t is not None}
        again = not whole and r["turn_before"] in turns
        return (r["conv_id"], r["part"], r["block"], whole, edits, roles, texts, faults.count(1), faults.count(2), faults.count(3),
                illegal, cost, min(turns, default=None), max(turns, default=None), len(turns) - again)

    kind = blocks.schema["conv_id"].dataType
    types = ("part int, block bigint, whole boolean, edits string, roles array<string>, texts array<string>, blank bigint, duplicate bigint, "
             "truncated bigint, illegal bigint, cost bigint, least_turn bigint, most_turn bigint, n_turns bigint")
    long, text = pa.int64(), pa.string()
    from pyspark.sql.pandas.types import to_arrow_type
    arrow = (to_arrow_type(kind), pa.int32(), long, pa.bool_(), text, pa.list_(text), pa.list_(text), *[long] * 8)
    told = join_on(blocks.where("edge"), chain, ["part", "block"])
    alone = blocks.where("not edge")
    for f in chain.schema:
        if f.name not in alone.columns:
            alone = alone.withColumn(f.name, F.lit(None).cast(f.dataType))
    return alone.unionByName(told).mapInArrow(_per_row(made, names, arrow), f"conv_id {kind.simpleString()}, {types}")


def turns(repaired: DataFrame) -> DataFrame:
    """The turns that ``repair`` left, one per row, in order of (part, block, place)."""
    return (repaired.select("conv_id", "part", "block", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "turn"))
            .select("conv_id", "part", "block", "place", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text")))


def report(rows: DataFrame, most_rows: int = ROWS) -> DataFrame:
    """Counts, cost, edits and the digest of the repaired turns of every conversation that has rows."""
    done = saved(repair(rows, most_rows), "repaired")
    lines = F.expr("array_join(transform(arrays_zip(roles, texts), t -> concat(t.roles, ':', t.texts)), '\n')")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    span = "cast(most_turn as decimal(20)) - least_turn + 1 - n_turns"
    gaps = F.expr(f"case when n_turns > 0 then cast(least({span}, 9223372036854775807) as bigint) else 0L end")
    whole = done.where("whole").select("conv_id", gaps.alias("gaps"), *counts, F.col("edits").alias("audit"),
                                       F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    pieces = done.where("not whole")
    sums = pieces.groupBy("conv_id").agg(F.min("least_turn").alias("least_turn"), F.max("most_turn").alias("most_turn"),
                                         F.sum("n_turns").alias("n_turns"), *[F.sum(c).alias(c) for c in counts])
    kind = done.schema["conv_id"].dataType.simpleString()

    def digest(batches):
        """Blocks come in order; a conversation ends where the next begins."""
        conv, edits, sha, kind, started, lines = None, [], hashlib.sha256(), None, False, False

        def closed():
            return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array(["".join(edits)]), pa.array([sha.hexdigest()])],
                                              names=["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for i in range(batch.num_rows):
                here, _, _, more, text = [c[i].as_py() for c in batch.columns]
                if started and here != conv:
                    yield closed()
                    edits, sha, lines = [], hashlib.sha256(), False
                conv, started = here, True
                edits.append(more)
                if text:
                    sha.update((b"\n" if lines else b"") + text)
                    lines = True
        if started:
            yield closed()

    streamed = (pieces.select("conv_id", "part", "block", "edits", lines.cast("binary").alias("lines")).repartition("conv_id")
                .sortWithinPartitions("conv_id", "part", "block").mapInArrow(digest, f"conv_id {kind}, audit string, repaired_sha256 string"))
    long = join_on(sums, streamed, ["conv_id"]).withColumn("gaps", gaps).select(*whole.columns)
    return whole.unionByName(long)


def damaged(rows: DataFrame) -> DataFrame:
    """Known damage, by the checksum of ``conv_id:turn`` modulo 20: 0 drops a turn, 1 empties its text, 2 takes out its
    ``. ! ?``, 3 repeats it, 4 makes it the user's."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = _slim(rows).withColumn("harm", F.crc32(key.cast("binary")) % 20).where("harm != 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def repair_report(rows: DataFrame, most_rows: int = ROWS) -> DataFrame:
    """``report`` of the damaged conversations, with a row for every conversation of the undamaged table."""
    found = report(damaged(rows), most_rows)
    out = join_on(rows.select("conv_id").distinct(), found, ["conv_id"], "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.select("conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
