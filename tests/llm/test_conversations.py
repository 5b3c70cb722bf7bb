"""Conversation repair against an enumeration of all edits and a plain recursion."""
import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from kitman.llm import conversations as C

WHITE = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()


def fault_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def edits_of(role, fault):
    """(letter, cost, role afterwards or None)."""
    more = 3 * (fault == "truncated")
    yield "D", 4, None
    if fault not in ("blank", "duplicate"):
        yield "K", more, role
        for r in ("user", "assistant"):
            yield "R", 3 + more, r


def enumerate_all(rows):
    """Least (cost, audit, repaired) over all edits, up to two inserts in a place."""
    inserts = [p for n in range(3) for p in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    places = [list(edits_of(r[1], f)) for r, f in zip(rows, fault_of(rows))]
    for chosen in itertools.product(*places):
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(c[1] for c in chosen) + 3 * sum(map(len, put))
            if best and cost > best[0]:
                continue
            roles, lines, audit = "", [], ""
            for i in range(len(rows) + 1):
                for r in put[i]:
                    roles, audit = roles + r[0], audit + "I"
                    lines.append(f"{r}:")
                if i < len(rows):
                    letter, _, role = chosen[i]
                    audit += letter
                    if role is not None:
                        roles += role[:1]
                        lines.append(f"{role}:{rows[i][2]}")
            if re.fullmatch("(s?(ua)+)?", roles):
                made = (cost, audit, "\n".join(lines))
                best = made if best is None else min(best, made)
    return best


def recursion(rows):
    """Least (cost, audit, repaired) by state, without checkpoints."""
    faults = fault_of(rows)
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @cache
    def rest(i, state, put):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if put < 2:
            for role in ("user", "assistant"):
                if role[0] in after[state]:
                    cost, audit, lines = rest(i, role[0], put + 1)
                    found.append((cost + 3, "I" + audit, (f"{role}:", *lines)))
        if i < len(rows):
            for letter, cost, role in edits_of(rows[i][1], faults[i]):
                if role is None:
                    more, audit, lines = rest(i + 1, state, 0)
                    found.append((cost + more, letter + audit, lines))
                elif role[:1] in after[state]:
                    more, audit, lines = rest(i + 1, role[:1], 0)
                    found.append((cost + more, letter + audit, (f"{role}:{rows[i][2]}", *lines)))
        return min(found, default=(1 << 40, "", ()))
    cost, audit, lines = rest(0, "", 0)
    return cost, audit, "\n".join(lines)


def wanted(rows):
    """The whole row of a conversation from its rows in order."""
    turns = [t for t, _, _ in rows if t is not None]
    faults, roles = fault_of(rows), [r[1][:1] for r in rows]
    cost, audit, text = recursion(tuple(rows))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
            hashlib.sha256(text.encode()).hexdigest())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


TEXTS = ["Yes.", "No!", "well", "", " \n", "Yes. ", "Ça va?", "x" * 30]


def conversation(r, n):
    roles = ["user", "assistant", "system", "tool", "", "s", "umbrella"]
    return [(r.choice([i, i, i, None, 2 * i]), r.choice(roles[:3] if r.random() < 0.8 else roles), r.choice(TEXTS)) for i in range(n)]


def test_recursion_equals_all_edits():
    r = random.Random(3)
    for n in (0, 1, 1, 2, 2, 2, 2, 3, 3):
        rows = in_order(conversation(r, n))
        assert recursion(tuple(rows)) == enumerate_all(rows)


def coded(rows):
    return bytes((("sua".index(x[1][0]) if x[1][:1] in ("s", "u", "a") else 3) + 4 * ["", "truncated", "blank", "duplicate"].index(f))
                 for x, f in zip(rows, fault_of(rows)))


def test_walk_and_blocks_equal_recursion():
    r = random.Random(4)
    for _ in range(300):
        rows = in_order(conversation(r, r.randrange(1, 40)))
        codes, (cost, audit, _) = coded(rows), recursion(tuple(rows))
        assert C.walk(codes, list(C.END), [0], True)[0][0] == audit
        cut = r.randrange(len(codes) + 1)
        behind = [min(C.transfer(codes[cut:])[4 * s + t] + C.END[t] for t in range(4)) for s in range(4)]
        assert min(C.transfer(codes[:cut])[t] + behind[t] for t in range(4)) == cost
        (first, state), = C.walk(codes[:cut], behind, [0], False)
        assert first + C.walk(codes[cut:], list(C.END), [state], True)[0][0] == audit


SCHEMA = "conv_id long, turn long, role string, text string, at long, part int, copy string"


def collected(df):
    got = {}
    for x in df.collect():
        assert x["conv_id"] not in got
        got[x["conv_id"]] = tuple(x[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
    return got


def test_repair_equals_recursion(spark):
    r = random.Random(5)
    convs = {c: conversation(r, r.randrange(1, 9)) for c in [*range(60), None]}
    convs[7] = convs[7] * 3                                 # repeated rows
    convs[8] = [(None, "user", "Null turns."), (None, "assistant", "Both.")]
    convs[9] = [(0, "user", "long " * 200_000 + "."), (1, "assistant", "Yes.")]
    rows = [(c, t, role, text, 1, 2, "clash") for c, turns in convs.items() for t, role, text in turns]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert collected(C.repair(df)) == {c: wanted(in_order(t)) for c, t in convs.items()}


def test_one_long_conversation_over_many_partitions(spark):
    r = random.Random(6)
    long = [(i, r.choice(["user", "assistant", "assistant", "system"]), r.choice(TEXTS[:3]) + (str(i) + "." if r.random() < 0.8 else "")) for i in range(700)]
    rows = [(1, *x, 0, 0, "") for x in long] + [(2, 0, "user", "Hello.", 0, 0, ""), (2, 1, "assistant", "Hi.", 0, 0, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = C.ordered(df)
        assert C.blocks(turns).where("conv_id = 1").count() > 3
        got = collected(C.repair(df))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    import sys
    sys.setrecursionlimit(10_000)
    assert got[1] == wanted(in_order(long)) and got[2][5:7] == (0, "KK")


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        one = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{one(c)}:{one(t)}".encode()) % 20
        role, text = one(role), one(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def test_damage_and_lost_conversations(spark):
    r = random.Random(8)
    rows = [(c, t, *x[1:]) for c in [*range(120), None] for t, x in enumerate(conversation(r, r.choice([1, 1, 6])))]
    rows += [(500, None, None, None), (501, 3, "user", None)]
    df = spark.createDataFrame([(*x, 0, 0, "") for x in rows], SCHEMA).repartition(3)
    left = {}
    for c, *x in brute_damage(rows):
        left.setdefault(c, []).append(tuple(x))
    want = {c: wanted(in_order(left[c])) if c in left else (0, 0, 0, 0, 0, 0, "", EMPTY) for c in {x[0] for x in rows}}
    assert any(c not in left for c in want)
    assert collected(C.repaired_after_damage(df)) == want


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.repair(none).count() == 0 and C.repaired_after_damage(none).count() == 0


@pytest.mark.parametrize("codes", [b"", b"\x00", b"\x0c\x0c\x0c"])
def test_nothing_left_is_empty(codes):
    (audit, state), = C.walk(codes, list(C.END), [0], True)
    assert audit == "D" * len(codes) or audit in ("KII", "D", "")
