"""Repair against a forward pass over all states, and conversations with nulls, ties and clashing columns."""

import hashlib
import random
import re
import zlib
from itertools import product

from callweave.llm import turn_repair


def forward(initials, faults):
    """Best (cost, edits) by trying every edit at every row, in another direction and without bounds."""
    best = {"": (0, "")}  # by the last initial

    def insert(best):
        for _ in range(2):
            for state, (cost, edits) in list(best.items()):
                to = "a" if state == "u" else "u"
                best[to] = min(best.get(to, (10**9, "")), (cost + 3, edits + "I"))
        return best

    for i, f in zip(initials, faults, strict=True):
        after = {}
        for state, (cost, edits) in insert(best).items():
            tries = [(state, 4, "D")]
            if f in (0, 3):
                cut, to = 3 * (f == 3), "a" if state == "u" else "u"
                tries.append((to, 3 + cut, "R"))
                if i == to or (i == "s" and state == ""):
                    tries.append((i, cut, "K"))
            for to, more, edit in tries:
                after[to] = min(after.get(to, (10**9, "")), (cost + more, edits + edit))
        best = after
    best = insert(best)
    return min(best.get("", (10**9, "")), best.get("a", (10**9, "")))


def test_short_rows_exhaustively():
    for n in range(5):
        for initials in product("sua", repeat=n):
            for faults in product((0, 1, 3), repeat=n):
                assert turn_repair.repair(list(initials), list(faults)) == forward(initials, faults)


def test_long_rows_and_odd_initials():
    rng = random.Random(5)
    for n in [1, 5, 63, 64, 65, 128, 129, 400, *[rng.randrange(9, 150) for _ in range(60)]]:
        initials = [rng.choice("uauauasx") for _ in range(n)] if n % 2 else ["ua"[k % 2] if rng.random() < 0.9 else rng.choice(["s", "", "U"]) for k in range(n)]
        faults = [rng.choice((0, 0, 0, 0, 1, 2, 3)) for _ in range(n)]
        assert turn_repair.repair(initials, faults) == forward(initials, faults)


def test_a_very_long_row_of_faults_is_solved_in_stretches():
    initials, faults = ["u"] * 20_000, [0] * 20_000
    assert turn_repair.repair(initials, faults) == (30_000, "KR" * 10_000)


def naive(rows):
    """rows: (conv_id, turn, role, text) -> result by conv_id."""
    space, out = "\x20\t\n\x0b\x0c\r", {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            role = "user" if hit == 4 else role
            own += [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        faults = []
        for k, (_, role, text) in enumerate(own):
            bare = text.rstrip(space)
            faults.append(1 if not bare else 2 if (role, text) in [r[1:] for r in own[:k]] else 0 if bare[-1] in ".!?" else 3)
        initials = [r[1][:1] for r in own]
        cost, edits = forward(initials, faults)
        lines, left, last = [], iter(own), ""
        for e in edits:
            row = None if e == "I" else next(left)
            if e != "D":
                role = row[1] if e == "K" else "assistant" if last == "u" else "user"
                last = role[:1]
                lines.append(f"{role}:{'' if row is None else row[2]}")
        turns = {r[0] for r in own} - {None}
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def test_conversations_with_odd_rows(spark):
    rng, texts = random.Random(3), ["Yes.", "No", "", " \t", None, "what?", "a\nb. ", "ö ü!", " ", "x" * 50_000 + "."]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", None, "", "User", "tool"]), rng.choice(texts)) for c in [None, *range(60)] for t in range(rng.randrange(1, 12))]
    rows += rows[:20] + [(500, k * 3, "user" if k % 2 else "assistant", f"turn {k}.") for k in range(300)]
    frame = spark.createDataFrame([(*r, "x", True) for r in rows], "conv_id long, turn long, role string, text string, whole string, gone boolean")
    got = turn_repair.repaired(turn_repair.damaged(frame.repartition(7))).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == naive(rows) and len(got) == 62


def test_no_rows_and_dropped_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.repaired(turn_repair.damaged(none)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    (row,) = turn_repair.repaired(turn_repair.damaged(spark.createDataFrame([(gone, 0, "user", "hi.")], none.schema))).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
