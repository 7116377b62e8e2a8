"""The audit against a plain count over rows, with nulls, ties, repeated rows and clashing columns."""

import re
from itertools import permutations

from callweave.llm import filter_audit


def naive(docs, labels):
    least, good, toxic = {}, set(), set()
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, q, t in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if t == 1 and i is not None else set()
    rows = []
    for i, text, lang in docs:
        x = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        fails = {k for k, bad in {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", x)) > 10 * len(x),
            "D": bool(re.search(r"[#$%&*|]", x)), "E": i is not None and i > least[x],
        }.items() if bad}
        rows.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        gone = {(o, s): [r for r in own if o[s] in r[1] and not r[1] & set(o[:s])] for o in permutations("ABCDE") for s in range(5)}
        for (o, s), removed in gone.items():
            k = o[s]
            out[part, "".join(o), s + 1] = (
                sum(not r[1] & set(o[: s + 1]) for r in own), len(removed), sum(k in r[1] for r in own) - len(removed), sum(r[1] == {k} for r in own),
                sum(r[2] for r in removed), sum(r[3] for r in removed), sum(len(v) for (p, q), v in gone.items() if p[q] == k),
            )
    return out


def test_audit_equals_plain_counts(spark):
    long = " ".join(f"w{i}" for i in range(150))
    docs = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (None, long, None), (3, None, ""), (4, "", "en"), (5, "A B C $", "de"), (6, "a " * 500, "de"),
        (7, "\x1f\x20one\x0btwo three", "de"), (8, long + " %", "fr"), (9, (long + " ") * 200, "fr"), (10, "TITLE " + long, "fr"), (None, None, "fr"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (8, 1, None), (None, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", 7) for d in docs], "doc_id long, text string, lang string, part string, id int")
    got = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in got.collect()}
    assert found == naive(docs, labels) and len(found) == 4 * 600


def test_audit_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
