"""Repairs against an enumeration of all edits, whole and in pieces."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tracelake.llm import conversation_repair as cr

GOOD = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, id long, segment long, rows string, whole int, content string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, "y") for r in rows], SCHEMA).repartition(3)


def broken(rows):
    """Rows after damage, by conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, fault = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        text = "" if fault == 1 else re.sub(r"[.!?]", "", text) if fault == 2 else text
        out.setdefault(conv, []).extend([] if fault == 0 else [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1))
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """By the best (cost, audit, result) of every state, row by row; states by the roles so far."""
    ways = {"": (0, "", ())}

    def put(to, state, cost, audit, result):
        if GOOD.fullmatch(state) or GOOD.fullmatch(state + "a") or GOOD.fullmatch(state + "ua"):
            state = re.sub(r"(ua)+", "ua", state)
            if state not in to or (cost, audit) < to[state][:2]:
                to[state] = (cost, audit, result)

    def inserted(ways):
        for _ in range(2):
            for state, (cost, audit, result) in list(ways.items()):
                for role in ("user", "assistant"):
                    put(ways, state + role[0], cost + 5, audit + "I", (*result, f"{role}:"))
        return ways

    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        to, more = {}, 5 * (fault == "truncated")
        for state, (cost, audit, result) in inserted(ways).items():
            put(to, state, cost + 2, audit + "D", result)
            if fault in ("", "truncated"):
                if role:
                    put(to, state + role[0], cost + more, audit + "K", (*result, f"{role}:{text}"))
                for other in ("user", "assistant"):
                    put(to, state + other[0], cost + 1 + more, audit + "R", (*result, f"{other}:{text}"))
        ways = to
    return min(x for state, x in inserted(ways).items() if GOOD.fullmatch(state))


def brute(rows):
    ids = {r[0] for r in rows}
    out = []
    for conv, own in (broken(rows) | {c: [] for c in ids if c not in broken(rows)}).items():
        turns = [r[0] for r in own if r[0] is not None]
        kinds, pairs = faults(own), [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        cost, audit, result = cheapest(own)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(result).encode()).hexdigest()))
    return sorted(out, key=str)


def drawn(n, most, seed):
    draw = random.Random(seed)
    texts = ["Yes.", "no", " \t", "", None, "Why?", "Ünd!  ", "ok…", "Go. on", "é!\n"]
    rows = []
    for conv in range(n):
        rows += [(conv if conv else None, draw.choice([k, k, k + 3, None]), draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), draw.choice(texts) if draw.random() < 0.4 else f"text {draw.random()}.") for k in range(draw.randint(1, most))]
    return rows


def test_states_of_the_enumeration_are_enough():
    for word in ("", "s", "u", "su", "ua", "sua", "suau", "uaua"):
        assert GOOD.fullmatch(word) or GOOD.fullmatch(word + "a") or GOOD.fullmatch(word + "ua")


@pytest.mark.parametrize("most_rows", [cr.MOST_ROWS, 3])
def test_repairs_are_the_cheapest(spark, most_rows):
    rows = drawn(60, 14, 1) + [(99, k % 50, "user" if k % 2 else "assistant", f"{k}.") for k in range(150)] + [(98, 7, "user", "same.")] * 40
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7" if most_rows == 3 else "1000")
    got = cr.report(cr.repair(cr.segments(cr.damaged(table(spark, rows)), most_rows=most_rows))).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=str) == [x for x in brute(rows) if x[0] in broken(rows) and broken(rows)[x[0]]]


def test_every_conversation_has_a_row(spark):
    dropped = next(k for k in range(100, 1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [*drawn(20, 6, 2), (dropped, 0, "user", "gone."), (77, None, None, None), (78, None, "user", "x" * 300_000 + ".")]
    got = cr.audited(table(spark, rows))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert cr.audited(table(spark, []).limit(0)).count() == 0
