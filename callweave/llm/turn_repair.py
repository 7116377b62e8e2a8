"""Conversation structure repair by iterative-deepening A*.

A conversation is a sequence of turns, and a cheapest sequence of edits (Delete, Insert, Keep, Rerole) must bring
its role initials to `(s?(ua)+)?`. `Stretch` searches depth first, tries edits in ASCII order under a cost bound that
rises to the least cost seen beyond it, and keeps what is known of failed states (row, place in the pattern) in a
transposition table: a state that failed with some budget is not tried again with as much. The first accepting path
is the cheapest and, of the cheapest, the ASCII-least. The bound's heuristic is what every path still has to pay: 4
for each blank or repeated row, 3 for each truncated one.

Long conversations are searched in stretches of STRETCH rows from the last to the first. A search ends where the
next stretch begins, whose cost and edits are known for each place in the pattern, so work grows linearly.

One shuffle deals rows by conversation and sorts them. A conversation comes twice in that order: first as codes of
a few bytes a row (role initial, fault, hash), from which the edits are found, then with its texts, which a running
SHA-256 takes in without gathering them. A task holds the codes of one conversation and one Arrow batch.

Defined cases: nulls in the damage key, role or text are one space, a null conv_id is a conversation of its own and
stays null, a null turn comes first and has no part in gaps; rows of one turn go by role and then by SHA-256 of the
text; a role that begins with another letter (or with none, or a capital) cannot be kept; a text of white space only
is blank; repeated rows are duplicates; texts are read whole; an empty table gives an empty result; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

STRETCH = 64  # rows searched at once
START, SYSTEM, USER, ASSISTANT = range(4)  # the last initial so far
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what an inserted or re-roled turn becomes
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
END = {START: (0, ""), SYSTEM: (6, "II"), USER: (3, "I"), ASSISTANT: (0, "")}  # cost and edits after the last row
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}


class Stretch:
    """IDA* over some rows; `after` gives cost and edits of the rest for each state they may end in."""

    def __init__(self, initials: list[str], faults: list[int], after: dict[int, tuple[int, str]]):
        self.initials, self.faults, self.after = initials, faults, after
        self.least = [min(c for c, _ in after.values())]
        for f in reversed(faults):
            self.least.append(self.least[-1] + (DELETE if f in (BLANK, DUPLICATE) else CUT if f == TRUNCATED else 0))
        self.least.reverse()
        self.known: dict[tuple[int, int], int] = {}  # failed state -> the least that it can still cost

    def moves(self, row: int, state: int):
        """(edit, cost, row, state) in ASCII order of the edits."""
        fault, more = self.faults[row], row + 1
        yield "D", DELETE, more, state
        yield "I", INSERT, row, NEXT[state]
        if fault not in (BLANK, DUPLICATE):
            cut = CUT if fault == TRUNCATED else 0
            kept = KEPT.get((state, self.initials[row]))
            if kept is not None:
                yield "K", cut, more, kept
            yield "R", REROLE + cut, more, NEXT[state]

    def search(self, row: int, state: int, budget: int):
        """The edits of the first accepting path within the budget, or the least cost beyond it."""
        if row == len(self.faults):
            cost, edits = self.after[state]
            return edits if cost <= budget else cost
        bound = self.known.get((row, state), self.least[row])
        if bound > budget:
            return bound
        beyond = None
        for edit, cost, at, to in self.moves(row, state):
            rest = self.search(at, to, budget - cost)
            if isinstance(rest, str):
                return edit + rest
            beyond = rest + cost if beyond is None else min(beyond, rest + cost)
        self.known[row, state] = beyond
        return beyond

    def solve(self, state: int) -> tuple[int, str]:
        bound = self.least[0]
        while not isinstance(found := self.search(0, state, bound), str):
            bound = found
        return bound, found


def repair(initials: list[str], faults: list[int]) -> tuple[int, str]:
    """Cost and edits, the cheapest and among them the ASCII-least."""
    solved = [{state: (cost, edits, None) for state, (cost, edits) in END.items()}]
    for a in reversed(range(0, len(faults), STRETCH)):
        # edits of a stretch end in a digit, the state in which the next one goes on
        part = Stretch(initials[a : a + STRETCH], faults[a : a + STRETCH], {s: (v[0], str(s)) for s, v in solved[-1].items()})
        found = {s: part.solve(s) for s in (END if a else (START,))}
        solved.append({s: (cost, edits[:-1], int(edits[-1])) for s, (cost, edits) in found.items()})
    (total, _, _), edits, state = solved[-1][START], [], START
    for one in reversed(solved):
        _, part, state = one[state]
        edits.append(part)
    return total, "".join(edits)


class Conversation:
    """Takes the codes of a conversation's rows, then their roles and texts in the same order."""

    def __init__(self, conv_id):
        self.conv_id, self.initials, self.faults, self.seen = conv_id, [], [], set()
        self.low = self.high = None
        self.turns, self.edits, self.at, self.state, self.cost = 0, None, 0, START, 0
        self.lines, self.hash = 0, hashlib.sha256()

    def code(self, turn, role: str, last: str, sha: bytes) -> None:
        if turn is not None:  # turns ascend
            self.low, self.turns = (turn if self.low is None else self.low), self.turns + (turn != self.high)
            self.high = turn
        fault = BLANK if not last else DUPLICATE if (role, sha) in self.seen else CLEAN if last in ".!?" else TRUNCATED
        self.seen.add((role, sha))
        self.initials.append(role[:1])
        self.faults.append(fault)

    def _solve(self) -> None:
        if self.edits is None:
            self.cost, self.edits = repair(self.initials, self.faults)
            self.seen = None

    def _line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def _insert(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self.state, self.at = NEXT[self.state], self.at + 1
            self._line(ROLES[self.state], "")

    def text(self, role: str, text: str) -> None:
        self._solve()
        self._insert()
        edit, self.at = self.edits[self.at], self.at + 1
        if edit != "D":
            self.state = NEXT[self.state] if edit == "R" else KEPT[self.state, role[:1]]
            self._line(ROLES[self.state] if edit == "R" else role, text)

    def result(self) -> tuple:
        self._solve()
        self._insert()
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(self.initials, self.initials[1:], strict=False))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        counts = (self.faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED))
        return self.conv_id, gaps, *counts, illegal, self.cost, self.edits, self.hash.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows with their damage; dropped ones are marked, so that their conversation stays."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    role = F.when(hit == 4, "user").otherwise(text_of("role"))
    times = F.when(hit == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (hit == 0).alias("gone"), F.explode(times).alias("time"))
    return out.drop("time")


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation of damaged(): counts of faults, cost, edits and the hash of the repaired turns."""
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    coded = F.struct(F.lit(False).alias("whole"), F.lit(None).cast("string").alias("text"))
    whole = F.struct(F.lit(True).alias("whole"), F.col("text").alias("text"))
    dealt = rows.select("conv_id", "turn", "role", "gone", F.unhex(F.sha2("text", 256)).alias("sha"), last.alias("last"), F.explode(F.when(F.col("gone"), F.array(coded)).otherwise(F.array(coded, whole))).alias("of"))
    dealt = dealt.select("conv_id", "of.whole", "gone", "turn", "role", "last", "sha", "of.text")
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "whole", F.col("turn").asc_nulls_first(), "role", "sha")

    def work(batches):
        now = kind = None
        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            for conv_id, whole, gone, turn, role, last, sha, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(conv_id)
                if whole:
                    now.text(role, text)
                elif not gone:
                    now.code(turn, role, last, sha)
            if done:
                yield as_batch(done, kind)
        if now is not None:
            yield as_batch([now.result()], kind)

    def as_batch(done, kind):
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], NAMES)

    return dealt.mapInArrow(work, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {', '.join(f'{n} long' for n in NAMES[1:7])}, audit string, repaired_sha256 string")


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def query(spark, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))


# CRC-32 by bits, then one forward pass over each conversation's rows that carries the best (nine digits of cost, edits)
# of the states n (start), s, u and a; nn, ss, uu and aa are those after inserts. Another route to the same answer.
def _edit(v: str, cost: str, edit: str) -> str:
    return f"lpad((substr({v}, 1, 9)::int + {cost})::varchar, 9, '0') || substr({v}, 10) || '{edit}'"


def _after(edit: str, cost: str, *states: str) -> str:
    return f"least(NULL::varchar, {', '.join(_edit(v, cost, edit) for v in states)})"


_CUT, _INSERTED = "3 * (fault = 3)::int", f"""k, pos, n AS nn, s AS ss, least(u, {_after("I", "3", "n", "s", "a")}) AS uu, a"""
ORACLE = rf"""
WITH RECURSIVE t AS (SELECT conv_id, dense_rank() OVER (ORDER BY conv_id) AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(flatten([[4294967295::BIGINT], flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '')])]),
    lambda x, b: xor(xor(x, b) >> 1, 3988292384 * (xor(x, b) & 1))), 4294967295::BIGINT) % 20 AS hit FROM conversations),
d AS (SELECT k, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN hit = 3 THEN [1, 2] ELSE [1] END) AS copy FROM t WHERE hit <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos, left(role, 1) AS i, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS z FROM d),
x AS (SELECT *, CASE WHEN z = '' THEN 1 WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY pos) > 1 THEN 2 WHEN z IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault, lag(i) OVER (PARTITION BY k ORDER BY pos) AS i0 FROM p),
g AS (SELECT k, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i0 IS NOT NULL AND i0 || i NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY 1),
r AS (SELECT DISTINCT k, 0::bigint AS pos, '000000000' AS n, NULL::varchar AS s, NULL::varchar AS u, NULL::varchar AS a FROM t
  UNION ALL SELECT k, pos, {_edit("nn", "4", "D")},
    least({_edit("ss", "4", "D")}, CASE WHEN free AND i = 's' THEN {_edit("nn", _CUT, "K")} END),
    least({_edit("uu", "4", "D")}, CASE WHEN free AND i = 'u' THEN {_after("K", _CUT, "nn", "ss", "aa")} END, CASE WHEN free THEN {_after("R", "3 + " + _CUT, "nn", "ss", "aa")} END),
    least({_edit("aa", "4", "D")}, CASE WHEN free AND i = 'a' THEN {_edit("uu", _CUT, "K")} END, CASE WHEN free THEN {_edit("uu", "3 + " + _CUT, "R")} END)
    FROM (SELECT x.k, x.pos, x.i, x.fault, x.fault IN (0, 3) AS free, nn, ss, uu, least(a, {_edit("uu", "3", "I")}) AS aa FROM (SELECT {_INSERTED} FROM r) q JOIN x ON x.k = q.k AND x.pos = q.pos + 1)),
b AS (SELECT q.k, least(nn, a, {_edit("uu", "3", "I")}) AS v FROM (SELECT {_INSERTED} FROM r) q LEFT JOIN g USING (k) WHERE q.pos = coalesce(g.rows, 0)),
c AS (SELECT k, substr(v, 1, 9)::bigint AS cost, substr(v, 10) AS audit FROM b),
e AS (SELECT *, sum((edit <> 'D')::int) OVER w AS made, sum((edit <> 'I')::int) OVER w AS pos FROM (SELECT k, unnest(string_split(audit, '')) AS edit, unnest(range(1, len(audit) + 1)) AS j FROM c WHERE audit <> '') WINDOW w AS (PARTITION BY k ORDER BY j)),
o AS (SELECT e.k, j, edit, made, role, text, max((edit = 'K' AND i = 's')::int) OVER (PARTITION BY e.k) AS lead FROM e LEFT JOIN x ON x.k = e.k AND x.pos = e.pos WHERE edit <> 'D'),
h AS (SELECT k, string_agg(CASE WHEN edit = 'K' THEN role WHEN (made - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole FROM o GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM t) JOIN c USING (k) LEFT JOIN g USING (k) LEFT JOIN h USING (k)
"""
