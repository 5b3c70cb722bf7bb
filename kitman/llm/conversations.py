"""Conversation structure repair by a square-root checkpointed dynamic program.

A conversation is repaired by the cheapest edits after which the initials of its
roles read ``(s?(ua)+)?``.  Four states suffice: nothing yet, after s, after u,
after a; which role may come next, hence which one is inserted or given to a
turn, follows from the state.  Costs to the end are computed backwards.  Only
every square-root-th vector of them is kept; a walk forwards recomputes the
stretch it is in and takes, of the edits that keep the total least, the first in
ASCII order, which gives the least of all cheapest edit strings.

One conversation may hold a large part of all turns.  Turns are therefore put in
order by range, not by conversation, and a conversation that lies in several
partitions is repaired block by block: a block is summed up in the costs from
each state at its start to each at its end, the blocks' summaries give the costs
behind every block, each block walks from every state, and the walks that meet
are joined.  What one task holds is a block's turns without their texts (a byte
each) or a conversation's blocks, one a partition.  Only the digest of the repaired text, which is
one chain by definition, reads a whole conversation in one task, as a stream.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import save

BLANKS = " \t\n\x0b\x0c\r"
START, AFTER_S, AFTER_U, AFTER_A = STATES = range(4)
#: State after the turn that may follow; it is a user's in all states but AFTER_U.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
NEXT_ROLE = ("user", "user", "assistant", "user")
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: Costs at the end: what must still be inserted.
END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 60
#: A turn is one byte: initial (s u a or another) plus four times its fault.
INITIALS = "sua"
SOUND, CUT, BLANK, REPEATED = range(4)
LEGAL = {(0, 1), (1, 2), (2, 1)}
_PART = 33                                                  # bits of the row in a partition


def _edits(code: int) -> list[list[tuple[str, int, int]]]:
    """(edit, cost, next state) of a turn in each state, in ASCII order; without inserts."""
    initial, fault = code % 4, code // 4
    out = [[("D", DELETE, s)] for s in STATES]
    if fault in (SOUND, CUT):
        more = TRUNCATED if fault == CUT else 0
        for s, to in {0: ((START, AFTER_S),), 1: ((START, AFTER_U), (AFTER_S, AFTER_U), (AFTER_A, AFTER_U)), 2: ((AFTER_U, AFTER_A),)}.get(initial, ()):
            out[s].append(("K", more, to))
        for s in STATES:
            out[s].append(("R", REROLE + more, NEXT[s]))
    return out


EDITS = [_edits(code) for code in range(16)]


def before(code: int, behind: list[int]) -> list[int]:
    """Costs to the end before a turn, from those behind it."""
    own = [min(cost + behind[to] for _, cost, to in edits) for edits in EDITS[code]]
    u, a = min(own[AFTER_U], INSERT + own[AFTER_A]), min(own[AFTER_A], INSERT + own[AFTER_U])
    return [min(own[START], INSERT + u), min(own[AFTER_S], INSERT + u), u, a]


def transfer(codes: bytes) -> list[int]:
    """Least costs from each state before the turns to each behind them (16, by start)."""
    columns = []
    for to in STATES:
        v = [0 if s == to else NEVER for s in STATES]
        for code in reversed(codes):
            v = before(code, v)
        columns.append(v)
    return [min(columns[t][s], NEVER) for s in STATES for t in STATES]


def walk(codes: bytes, behind: list[int], starts: list[int], last: bool) -> list[tuple[str, int]]:
    """The ASCII-least cheapest edits of the turns and the state they end in, from
    each start; ``behind``: the costs after the turns.  ``last``: with what is inserted at the end."""
    width = isqrt(len(codes)) + 1
    kept, v = {}, list(behind)
    for i in range(len(codes) - 1, -1, -1):
        if (i + 1) % width == 0 or i == len(codes) - 1:
            kept[i // width] = v                            # behind stretch i // width
        v = before(codes[i], v)
    out, states = [[] for _ in starts], list(starts)
    for k in range(len(kept)):
        stretch = codes[k * width:(k + 1) * width]
        costs = [kept[k]]
        for code in reversed(stretch):
            costs.append(before(code, costs[-1]))
        costs.reverse()
        for which, s in enumerate(states):
            audit = out[which]
            for code, here, after in zip(stretch, costs, costs[1:]):
                while True:
                    edits = EDITS[code][s]
                    if DELETE + after[s] == here[s]:
                        audit.append("D")
                        break
                    if INSERT + here[NEXT[s]] == here[s]:
                        audit.append("I")
                        s = NEXT[s]
                        continue
                    edit, s = next((e, to) for e, cost, to in edits[1:] if cost + after[to] == here[s])
                    audit.append(edit)
                    break
            states[which] = s
    if last:
        for which, audit in enumerate(out):
            while END[states[which]]:
                audit.append("I")
                states[which] = NEXT[states[which]]
    return [("".join(a), s) for a, s in zip(out, states)]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that crc32(``conv_id:turn``) % 20
    names: 0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it,
    4 makes its role user.  In that text, role and text a null is one space."""
    written = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(written[0], F.lit(":"), written[1]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(written[3], "[.!?]", "")).otherwise(written[3])
    return rows.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(written[2]).alias("role"), text.alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest, at), written: ``at`` numbers the turns in
    the order of conversation, turn (nulls first), role and digest of the text; the
    bits above ``_PART`` are the partition.  Rows equal in all of these are divided too."""
    keyed = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    keyed = keyed.select("*", F.unhex(F.sha2("text", 256)).alias("digest"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    order = ("conv_id", "turn", "role", "digest", "salt")
    return save(keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
                .withColumn("at", F.monotonically_increasing_id()), "turns")


def _by(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """A join on keys that may be null."""
    named = right.select(*(F.col(k).alias(f"right_{k}") if k in keys else k for k in right.columns))
    on = [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys]
    return left.join(named, on, how).drop(*(f"right_{k}" for k in keys))


def _part() -> Column:
    return F.shiftright("at", _PART)


def blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, part, codes), written: a byte a turn for each partition that a
    conversation lies in."""
    first = turns.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first")).select("first")
    bare = F.rtrim("text", F.lit(BLANKS))
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS)) - 1
    initial = F.when((F.col("role") == "") | (initial < 0), 3).otherwise(initial)
    fault = (F.when(bare == "", BLANK).when(F.col("first").isNull(), REPEATED)
             .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(SOUND))
    marked = turns.select("conv_id", "at", initial.alias("initial"), F.when(bare == "", "").otherwise(F.right(bare, F.lit(1))).alias("text"))
    coded = marked.join(first, F.col("at") == F.col("first"), "left").select(
        "conv_id", "at", (F.col("initial") + 4 * fault).cast("tinyint").alias("code"))
    codes = F.transform(F.sort_array(F.collect_list(F.struct("at", "code"))), lambda x: x["code"])
    return save(coded.groupBy("conv_id", _part().alias("part")).agg(codes.alias("codes")), "blocks")


def _mapped(df: DataFrame, one, schema: str) -> DataFrame:
    """``one``: a row of plain values → an iterable of rows; conv_id is passed on as it is."""
    schema = f"conv_id {dict(df.dtypes)['conv_id']}, {schema}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, (r["conv_id"], *made))) for r in b.to_pylist() for made in one(r)], arrow)

    return df.mapInArrow(run, schema)


def _summary(r: dict):
    codes = bytes(r["codes"])
    initials = [c % 4 for c in codes]
    illegal = sum(pair not in LEGAL for pair in zip(initials, initials[1:]))
    yield (r["part"], initials[0], initials[-1], illegal, *(sum(c // 4 == f for c in codes) for f in (BLANK, REPEATED, CUT)), transfer(codes))


def _behind(r: dict):
    """Sums over a conversation's blocks, and the costs behind each of them."""
    parts = sorted(r["parts"], key=lambda p: p["part"])
    v, ends = list(END), []
    for p in reversed(parts):
        ends.append({"part": p["part"], "behind": v, "starts": list(STATES) if p is not parts[0] else [START], "last": p is parts[-1]})
        v = [min(p["costs"][4 * s + t] + v[t] for t in STATES) for s in STATES]
    illegal = sum(p["illegal"] for p in parts) + sum((p["last"], q["first"]) not in LEGAL for p, q in zip(parts, parts[1:]))
    yield (*(sum(p[c] for p in parts) for c in ("blank", "repeated", "cut")), illegal, v[START], ends)


def _walked(r: dict):
    got = walk(bytes(r["codes"]), r["behind"], r["starts"], r["last"])
    yield r["part"], [{"start": s, "audit": audit, "end": end} for s, (audit, end) in zip(r["starts"], got)]


def _joined(r: dict):
    state = START
    for part in sorted(r["walks"], key=lambda w: w["part"]):
        yield part["part"], state
        state = next(x["end"] for x in part["ends"] if x["start"] == state)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of conversations, the edits of each part before its turns → the
    digest of every repaired conversation."""
    none = object()
    conv, made, first, edits, state = none, None, True, iter(()), START

    def write(role: str, text: str) -> None:
        nonlocal first
        made.update((("" if first else "\n") + role + ":" + text).encode("utf-8", "replace"))
        first = False

    def inserted(left: Iterator[str]) -> str | None:
        nonlocal state
        for e in left:
            if e != "I":
                return e
            write(NEXT_ROLE[state], "")
            state = NEXT[state]
        return None

    kind = None
    for b in batches:
        kind, done = b.schema.field(0).type, []
        for c, role, text, audit in zip(*(b.column(i).to_pylist() for i in range(4))):
            if conv is none or c != conv:
                if conv is not none:
                    inserted(edits)
                    done.append((conv, made.hexdigest()))
                conv, made, first, edits, state = c, hashlib.sha256(), True, iter(()), START
            if audit is not None:
                inserted(edits)
                edits = iter(audit)
                continue
            e = inserted(edits)
            if e == "K":
                write(role, text)
                state = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}[role[0]]
            elif e == "R":
                write(NEXT_ROLE[state], text)
                state = NEXT[state]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([h for _, h in done])], names=["conv_id", "sha"])
    if conv is not none:
        inserted(edits)
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([made.hexdigest()])], names=["conv_id", "sha"])


def repair(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) → one row a conversation: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A turn's first fault counts: blank (nothing but ASCII white space), duplicate
    (role and text are there earlier), truncated (does not end in ``.!?``).  Kept
    turns cost 0, reroled ones 3, deleted ones 4 (blank and duplicate ones must go),
    inserted ones 3; truncated ones that stay 3 more.  Null turns come first and count
    in no gap; null roles and texts are one space; equal turns are in the order of role,
    then of the text's SHA-256; rows equal in all columns are one and its duplicates; a
    null conv_id is a conversation; texts of any length are read whole; an empty table
    gives an empty one; further columns are ignored."""
    turns = ordered(rows)
    coded = blocks(turns)
    sums = _mapped(coded, _summary, "part long, first int, last int, illegal long, blank long, repeated long, cut long, costs array<bigint>")
    of = [c for c in sums.columns if c != "conv_id"]
    kept = save(_mapped(sums.groupBy("conv_id").agg(F.collect_list(F.struct(*of)).alias("parts")), _behind,
                        "blank long, repeated long, cut long, illegal long, cost long, "
                        "ends array<struct<part:bigint,behind:array<bigint>,starts:array<int>,last:boolean>>"), "costs")
    ends = kept.select("conv_id", F.explode("ends").alias("e")).select("conv_id", "e.*")
    walks = save(_mapped(_by(coded, ends, "conv_id", "part"), _walked, "part long, ends array<struct<start:int,audit:string,end:int>>"), "walks")
    starts = _mapped(walks.groupBy("conv_id").agg(F.collect_list(F.struct(
        "part", F.transform("ends", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"))).alias("ends"))).alias("walks")),
        _joined, "part long, start int")
    pieces = save(_by(walks, starts, "conv_id", "part").select(
        "conv_id", "part", F.filter("ends", lambda e: e["start"] == F.col("start"))[0]["audit"].alias("audit")), "audits")
    audits = pieces.groupBy("conv_id").agg(F.concat_ws("", F.transform(
        F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda p: p["audit"])).alias("audit"))
    stream = turns.select("conv_id", "role", "text", F.lit(None).cast("string").alias("audit"), "at", F.lit(1).alias("turn")).unionAll(
        pieces.select("conv_id", F.lit(None), F.lit(None), "audit", F.shiftleft("part", _PART), F.lit(0)))
    hashes = (stream.repartition("conv_id").sortWithinPartitions("conv_id", "at", "turn").select("conv_id", "role", "text", "audit")
              .mapInArrow(_hashed, f"conv_id {dict(turns.dtypes)['conv_id']}, sha string"))
    gaps = turns.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    out = _by(_by(_by(kept.drop("ends"), gaps, "conv_id"), audits, "conv_id"), hashes, "conv_id")
    return out.select("conv_id", F.col("gaps").cast("long").alias("gaps"), "blank", F.col("repeated").alias("duplicate"),
                      F.col("cut").alias("truncated"), "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def repaired_after_damage(rows: DataFrame) -> DataFrame:
    """``repair`` of the ``damaged`` rows, with a row for every conversation of ``rows``:
    one that lost all its turns has zeros, no edits and the digest of nothing."""
    got = _by(rows.select("conv_id").distinct(), repair(damaged(rows)), "conv_id", how="left")
    return got.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
