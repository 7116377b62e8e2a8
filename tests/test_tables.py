"""Tables that take changes, an index of segments, percentiles and term tables against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.functions import terms
from callweave.operators import percentiles, tables
from callweave.operators.segments import Segments



def at():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


RECORD = "id long, title string, body string, verified boolean, verified_by string, verified_at timestamp, revision int, created_at timestamp, updated_at timestamp"


def files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


@pytest.fixture
def store(spark, tmp_path):
    rows = [(i, f"t{i}", f"b{i}", False, None, None, 1, None, None) for i in range(300)]
    tables.create(spark.createDataFrame(rows, RECORD), str(tmp_path / "t"), "id")
    return tmp_path / "t", tmp_path / "h"


def test_upsert_touches_only_its_buckets_and_repeats_nothing(spark, store):
    path, history = map(str, store)
    before = files(store[0])
    batch = spark.createDataFrame([(5, "t5", "new"), (7, "t7", "b7"), (900, "made", None), (900, "made", "last"), (None, "no", "key")], "id long, title string, body string").withColumn("order", F.coalesce("body", F.lit("")))
    assert 1 <= tables.upsert(spark, path, history, batch, "id", ["title", "body"], at(), "me", "order") <= 3
    kept = files(store[0]).keys() & before.keys()
    assert len(kept) >= len(before) - 3  # other buckets are the same files
    got = {r.id: r for r in tables.read(spark, path).collect()}
    assert len(got) == 301 and (got[5].body, got[5].revision, got[7].revision, got[900].body, got[900].revision) == ("new", 2, 1, "last", 1)
    rows = {(r.id, r.revision): r for r in tables.read_history(spark, history, "id").withColumn("body", F.variant_get("snapshot", "$.body", "string")).drop("snapshot").collect()}
    assert {k: (r.action, r.body, r.changed_by) for k, r in rows.items()} == {(5, 2): ("update", "b5", "me"), (900, 1): ("create", "last", "me")}
    for _ in range(2):
        tables.upsert(spark, path, history, batch, "id", ["title", "body"], at(), "me", "order")
    assert {r.id: r for r in tables.read(spark, path).collect()} == got and tables.read_history(spark, history, "id").count() == 2
    assert tables.upsert(spark, path, history, batch.limit(0), "id", ["title", "body"], at(), "me", "order") == 0


def test_verify_audits_once(spark, store):
    path, history = map(str, store)
    for _ in range(2):
        tables.verify(spark, path, history, spark.createDataFrame([(1,), (2,), (2,), (None,), (5000,)], "id long"), "id", at(), "boss")
    got = {r.id: (r.verified, r.verified_by, r.revision) for r in tables.read(spark, path).collect()}
    assert {k for k, v in got.items() if v[0]} == {1, 2} and got[1] == (True, "boss", 2) and got[3] == (False, None, 1) and len(got) == 300
    assert sorted((r.id, r.revision, r.action) for r in tables.read_history(spark, history, "id").drop("snapshot").collect()) == [(1, 2, "verify"), (2, 2, "verify")]


def test_delete_cascades_and_may_empty_a_bucket(spark, tmp_path):
    parents, children = str(tmp_path / "p"), str(tmp_path / "c")
    tables.create(spark.createDataFrame([(i, "x") for i in range(40)], "id long, a string"), parents, "id")
    tables.create(spark.createDataFrame([(i % 40, i) for i in range(200)], "id long, part long"), children, "id")
    tables.delete(spark, parents, spark.createDataFrame([(i,) for i in range(35)], "id long"), "id", {children: "part"})
    assert {r.id for r in tables.read(spark, parents).collect()} == set(range(35, 40))
    assert {r.id for r in tables.read(spark, children).collect()} == set(range(35, 40)) and tables.read(spark, children).count() == 25


def test_index_of_segments_equals_a_rebuild(spark, tmp_path):
    rng, words = random.Random(6), [f"w{i}" for i in range(30)] + ["fees", "hostel"]
    said = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))
    live, index = {}, Segments(spark, str(tmp_path / "i"))
    schema = "doc_id long, text string"

    def same():
        fresh = Segments(spark, str(tmp_path / f"r{rng.random()}"))
        if live:
            fresh.add(spark.createDataFrame(list(live.items()), schema))
        a, b = index.statistics(), fresh.statistics()
        assert sorted(map(tuple, a[0].collect())) == sorted(map(tuple, b[0].collect())) and a[1].first() == b[1].first()
        asked = spark.createDataFrame([(1, "w1 w2 fees")], "item_id long, text string")
        scores = [{r.doc_id: round(r.score, 9) for r in x.scored(asked).collect()} for x in (index, fresh)]
        assert scores[0] == scores[1]

    same()
    for step in range(3):
        batch = {rng.randrange(40): said() if rng.random() < 0.9 else None for _ in range(15)}
        index.add(spark.createDataFrame([*batch.items(), (None, "no id")], schema))
        live |= batch
        if step == 1:
            gone = rng.sample(sorted(live), 5) + [12345]
            index.remove(spark.createDataFrame([(i,) for i in gone] + [(None,)], "doc_id long"))
            live = {k: v for k, v in live.items() if k not in gone}
    same()
    assert index.compact(1000) is not None and index.compact(1000) is None
    same()
    index.add(spark.createDataFrame([(3, "w1 again")], schema))
    live[3] = "w1 again"
    same()


def test_nearest_rank_is_exact_for_hot_and_odd_groups(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in rng.lognormal(size=20_000)] + [("same", 7.0)] * 5000 + [("few", 1.0), ("few", 2.0), ("few", 3.0), ("few", 4.0), ("none", None), ("nan", float("nan")), (None, 5.0)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(6)
    ps = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: (r.p0, r.p50, r.p95, r.p100) for r in percentiles.nearest_rank(frame.filter("k is not null"), ["k"], "v", ps).collect()}
    want = {}
    for k in ("hot", "same", "few"):
        own = sorted(v for key, v in rows if key == k)
        want[k] = tuple(own[round(p * (len(own) - 1))] for p in ps.values())
    assert got == want and want["few"][1] == 3.0
    assert [tuple(r) for r in percentiles.nearest_rank(frame.filter("k = 'few'"), [], "v", ps).collect()] == [want["few"]]
    assert percentiles.nearest_rank(frame.limit(0), ["k"], "v", ps).count() == 0


def test_sketch_that_is_wrong_does_not_matter(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "EPS", 0.0)  # brackets of one value: most places fall outside
    rows = [("a", float(i)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k string, v double")
    assert tuple(percentiles.nearest_rank(frame, ["k"], "v", {"x": 0.37, "y": 0.9}, k=8).first()) == ("a", float(round(0.37 * 2999)), float(round(0.9 * 2999)))


def naive_hits(table, text, edge, longest):
    low, found = (text or "").lower(), []
    for place, (term, value) in enumerate(table):
        for start in range(len(low)):
            if low.startswith(term, start):
                left = start == 0 or not terms._inside(low[start - 1])
                right = start + len(term) == len(low) or not terms._inside(low[start + len(term)])
                if edge == "any" or left and (edge == "left" or right):
                    found.append((start, -len(term), place))
    out, free = [], 0
    for start, size, place in sorted(found):
        if not longest or start >= free:
            free = start - size
            out.append((*table[place], start, place))
    return out


@pytest.mark.parametrize("edge", ["any", "left", "word"])
@pytest.mark.parametrize("longest", [False, True])
def test_terms_like_a_search_for_each(spark, edge, longest):
    rng = random.Random(9)
    table = terms.table([("ab", "1"), ("a", "2"), ("abc", "3"), ("bca", "4"), ("Fee Waiver", "5"), ("fee", "6"), ("फी", "7"), ("एमए", "8"), ("", "no"), ("AB", "later")])
    assert len(table) == 8
    texts = ["".join(rng.choice(["a", "b", "c", " ", "fee", " waiver", "फी", "एसएमएस", "एमए", "-", "_"]) for _ in range(rng.randrange(0, 25))) for _ in range(300)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", terms.find(F.col("t"), table, edge, longest).alias("h")).collect()
    assert all([tuple(h) for h in r.h] == naive_hits(table, r.t, edge, longest) for r in rows)


def test_term_tables_are_bounded_and_bridges_follow_the_intent(spark, monkeypatch):
    monkeypatch.setattr(terms, "MOST_TERMS", 2)
    assert len(terms.table([("a", ""), ("b", ""), ("A", "")])) == 2
    with pytest.raises(ValueError):
        terms.table(spark.createDataFrame([("a", ""), ("b", ""), ("c", "")], "t string, v string"))
    monkeypatch.undo()
    asked = [("परीक्षा शुल्क", "other", ["BTECH"]), ("परीक्षा सत्र", "dates", None), (" सत्र ", "other", []), ("एसएमएस से भेजो", "other", ["MBA", "MBA"]), (None, None, None)]
    frame = spark.createDataFrame(asked, "t string, i string, x array<string>")
    got = [r[0] for r in frame.select(terms.augmented(F.col("t"), F.col("i"), F.col("x"))).collect()]
    assert got == ["परीक्षा शुल्क Fees Exam BTECH", "परीक्षा सत्र examination dates calendar calendar", "सत्र", "एसएमएस से भेजो MBA", ""]
