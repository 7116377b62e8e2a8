"""Operators on small tables: search, changes, windows, streams, readers."""

import json

from pyspark.sql import functions as F

from callweave.functions import batches, text
from callweave.operators import ann, changes, hybrid, rows, rules, search
from callweave.sources import readers
from callweave.streaming import calls

DAY = "2024-01-01 "


def test_one_hot_cosine(spark):
    vectors = spark.createDataFrame([(i, [float(i % 8 == k) for k in range(8)], i % 2) for i in range(16)], "vec_id long, embedding array<float>, label int")
    scored = search.against(vectors, vectors.filter("vec_id = 3"), search.cosine)
    assert {r.vec_id: r.score for r in scored.collect()} == {i: float(i % 8 == 3) for i in range(16)}
    zero = spark.createDataFrame([([0.0] * 3, [1.0, 0.0, 0.0])], "a array<double>, b array<double>")
    assert zero.select(search.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(1, "common rare words"), (2, "common words"), (3, "common things"), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "rare common")], "item_id long, text string")
    best = hybrid.ranked(docs, asked, lexical=3, dense=0).orderBy("rank").collect()
    assert [r.doc_id for r in best] == [1, 2, 3] and best[0].list == "lexical"


def test_lists_equal_a_loop_over_all_pairs(spark, monkeypatch):
    """Both lists, over blocks of questions and of documents that hold few rows, with ties, nulls and repeated rows."""
    import math
    import random
    from collections import Counter

    import numpy as np

    rng = random.Random(8)
    said = ["alpha", "beta", "gammas", "fee", "fees", "hostel", "financial aid", "the", "x", "7", "last date"]
    texts = [" ".join(rng.choice(said) for _ in range(rng.randrange(0, 9))) for _ in range(80)] + [None, "", "omega", "alpha beta"]
    docs = spark.createDataFrame([(i if i != 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    asked = spark.createDataFrame([(f"q{i}", " ".join(rng.choice(said) for _ in range(4))) for i in range(9)] + [("none", None), ("odd", "nowhere to be found")], "item_id string, text string")
    monkeypatch.setattr(hybrid, "MOST_QUESTIONS", 4)
    monkeypatch.setattr(hybrid, "ROWS", 5)
    got = hybrid.ranked(docs, asked, lexical=6, dense=5, dims=32).collect()

    features = lambda df, key: {r[0]: r for r in df.filter(F.col(key).isNotNull()).select(key, text.expand(F.col("text")).alias("fs"), text.compact(F.col("text")).alias("c")).collect()}
    held, wanted = features(docs, "doc_id"), features(asked, "item_id")
    vector = lambda r: batches.hash_vectors(np.zeros(len(r.fs), dtype=np.int64), np.arange(len(r.fs)), r.fs, [r.c], 32)[0]
    mean = sum(max(1, len(r.fs)) for r in held.values()) / len(held)
    df = Counter(f for r in held.values() for f in set(r.fs))
    want = []
    for item, q in wanted.items():
        for name, k in (("lexical", 6), ("dense", 5)):
            scores = []
            for d, r in held.items():
                tf = Counter(r.fs)
                part = lambda f: math.log(1 + (len(held) - df[f] + 0.5) / (df[f] + 0.5)) * tf[f] * 2.6 / (tf[f] + 1.6 * (0.28 + 0.72 * max(1, len(r.fs)) / mean))  # noqa: B023, E731
                scores.append((-round(sum(part(f) for f in set(q.fs) if tf[f]) if name == "lexical" else float(vector(q) @ vector(r)), 9), d))
            want += [(item, name, place, d) for place, (score, d) in enumerate(sorted(s for s in scores if s[0] < 0)[:k], 1)]
    assert sorted((r.item_id, r.list, r.rank, r.doc_id) for r in got) == sorted(want)


def test_dense_list_finds_a_synonym_without_a_shared_word(spark):
    docs = spark.createDataFrame([(1, "tuition"), (2, "garden"), (3, "meadow"), (4, "river")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "fee")], "item_id long, text string")
    both = hybrid.ranked(docs, asked, lexical=4, dense=1).collect()
    assert {(r.list, r.doc_id) for r in both if r.rank == 1} == {("lexical", 1), ("dense", 1)}


RECORD = dict(asked="tell me", spoken="tell me", categories=[], language="", intent="", tokens=[], specialisations=[], distinctive=[], title="", body="", category="", lang="", verified=None, stale=False, aliases=[], not_offered=[], rrf_norm=0.4, dense=0.4, lexical=2.0)
BASE = 0.43
# each rule alone: what to set, the amount, the signals
ALONE = [
    (dict(category="b", categories=["a", "b"]), 0.10, "category"),
    (dict(category="a", categories=["a", "b"]), 0.18, "category,primary_category"),
    (dict(lang="en", language="en"), 0.06, "language"),
    (dict(verified=True), 0.05, "verified"),
    (dict(verified=False), -0.06, "unverified"),
    (dict(stale=True), -0.07, "stale"),
    (dict(tokens=["B.TECH", "CSE"], title="Lateral B.Tech, CSE"), 0.28, "course_match"),
    (dict(tokens=["BBA"], title="BBA (Honours)"), 0.39, "course_match,degree_exact"),
    (dict(tokens=["BPHARM"], title="Bachelor of Pharmacy (B.Pharm)"), 0.39, "course_match,degree_exact"),
    (dict(tokens=["BBA", "LLB"], title="BBA"), 0.14, "course_match"),
    (dict(tokens=["BBA"], title="BBA LL.B. (Honours)"), 0.32, "course_match,degree_prefix"),
    (dict(tokens=["BTECH"], title="B.Tech + MBA"), 0.18, "course_match,degree_combined"),
    (dict(tokens=["BCOM"], not_offered=["B.Com (Hons) and others"]), 0.55, "not_offered"),
    (dict(tokens=["MBA"], not_offered=["A standalone MBA"]), 0.55, "not_offered"),
    (dict(tokens=["BBA"], not_offered=["BBA LL.B. or any law degree"]), 0, ""),
    (dict(tokens=["XX"], aliases=["एमबीए"], not_offered=["MBA"], asked="एमबीए चा कोर्स", body="\nAlso known as: a"), 0.43, "not_offered,alias_dump"),
    (dict(specialisations=["ai"], title="Digital AI lab"), 0.45, "specialisation_title"),
    (dict(specialisations=["ai", "it"], title="Digital", body="the ai part"), 0.04, "specialisation_body"),
    (dict(body="head\n Also known as: x, y"), -0.12, "alias_dump"),
    (dict(aliases=["wifi"], asked="is there Wi-Fi here"), 0.12, "alias"),
    (dict(aliases=["hostel", "hostel mess rules"], asked="the hostel mess rules please"), 0.24, "alias"),
    (dict(aliases=["a bb c dd e f g h"], asked="a bb c dd e f g h"), 0.30, "alias"),
    (dict(distinctive=["wifi", "account", "campus"], title="Campus Wi-Fi account"), 0.24, "title_terms"),
    (dict(title="library hours", asked="Library hours today"), 0.18, "title_in_query"),
    (dict(title="fees", asked="fees"), 0, ""),
    (dict(category="important_dates", intent="important_dates"), 0.08, "timely"),
    (dict(title=None, body=None, aliases=None, tokens=None, not_offered=None, asked=None, specialisations=None, distinctive=None), 0, ""),
]


def test_every_rerank_rule_alone(spark):
    schema = "i int, asked string, spoken string, categories array<string>, language string, intent string, tokens array<string>, specialisations array<string>, distinctive array<string>, title string, body string, category string, lang string, verified boolean, stale boolean, aliases array<string>, not_offered array<string>, rrf_norm double, dense double, lexical double"
    frame = spark.createDataFrame([(i, *(RECORD | dict(lang="x") | change).values()) for i, (change, _, _) in enumerate(ALONE)], schema)
    got = {r.i: r for r in rules.rerank(rules.features(frame)).collect()}
    for i, (change, amount, signals) in enumerate(ALONE):
        assert (round(got[i].score - BASE, 4), got[i].signals) == (amount, signals), change
    table = spark.createDataFrame([("only", "stale", 0.5)], "name string, holds string, amount double")
    assert {round(r.score, 4) for r in rules.rerank(rules.features(frame), table).filter("i in (0, 5)").collect()} == {0.43, 0.93}


def test_rare_title_words(spark):
    records = spark.createDataFrame([(i, f"Campus guide w{i}") for i in range(40)] + [(99, None)], "doc_id long, title string")
    asked = spark.createDataFrame([(1, "where is the campus W7 and w8x w9", ["W-9"]), (2, "guide", [])], "item_id long, spoken string, tokens array<string>")
    assert [tuple(r) for r in rules.title_terms(records, asked).collect()] == []
    named = spark.createDataFrame([(1, "where is w07x and w08x and campus", ["W08X"])], "item_id long, spoken string, tokens array<string>")
    more = records.union(spark.createDataFrame([(100, "About w07x, w08x")], records.schema))
    assert [tuple(r) for r in rules.title_terms(more, named).collect()] == [(1, ["w07x"])]


def test_query_blocks_answer_all(spark):
    vectors = spark.createDataFrame([(i, [float(i % 5), float(i % 7) + 1], i % 2) for i in range(60)], "vec_id long, embedding array<float>, label int")
    whole = {(r.query_id, r.vec_id): r.score for r in search.against(vectors, vectors.filter("vec_id < 20"), search.cosine).collect()}
    cut = search.against(vectors, vectors.filter("vec_id < 20"), search.cosine, most=6).collect()
    assert len(cut) == len(whole) == 1200 and {(r.query_id, r.vec_id): r.score for r in cut} == whole


def test_fusion_is_monotone(spark):
    a = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.8)], "item_id long, doc_id long, rank int, score double")
    b = spark.createDataFrame([(1, 10, 1, 5.0), (1, 12, 2, 4.0)], "item_id long, doc_id long, rank int, score double")
    fused = {r.doc_id: r for r in search.fuse(a, b).collect()}
    assert abs(fused[10].rrf_norm - 1) < 1e-12 and fused[10].rrf > fused[11].rrf == fused[12].rrf and fused[12].dense_rank == 999


def test_fusion_of_one_frame_equals_fusion_of_two(spark):
    rows = [(q, d, name, r, 1.0 / r) for q in range(3) for name, step in (("dense", 2), ("lexical", 3)) for r, d in enumerate(range(q, 20, step), 1)]
    frame = spark.createDataFrame(rows, "item_id long, doc_id long, list string, rank int, score double")
    two = search.fuse(frame.filter("list = 'dense'"), frame.filter("list = 'lexical'"))
    assert sorted(map(tuple, search.fuse_lists(frame).collect())) == sorted(map(tuple, two.collect()))


def test_context_block_keeps_the_first(spark):
    ranked = spark.createDataFrame([(1, 1, 50), (1, 2, 5), (2, 1, 5), (2, 2, 5)], "k int, rank int, length int")
    kept = {(r.k, r.rank) for r in search.context_block(ranked, "k", 20).collect()}
    assert kept == {(1, 1), (2, 1), (2, 2)}


def test_inverted_file_prunes_grouped_vectors(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.25 * rng.normal(size=16)).tolist()) for i in range(3000)] + [(5000, [0.0] * 16), (5001, None), (5002, [1.0]), (None, [1.0] * 16), (5003, [None] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = vectors.filter("vec_id % 100 = 0 and vec_id < 3000")
    made = ann.fit(vectors, 10)
    ann.write(vectors, made, str(tmp_path / "lists"))
    index = spark.read.parquet(str(tmp_path / "lists"))
    assert index.count() == 3001  # every vector that has the length, the zero vector too
    found = ann.search(index, made, asked, 10)
    scanned = found.agg(F.sum("scanned")).first()[0]
    assert scanned <= 0.2 * 3000 * 30
    got = {(r.query_id, r.vec_id) for r in ann.neighbours(vectors, asked, 10, centroids=made).collect()}
    plain = ann.units(np.array([r[1] for r in rows[:3000]]))
    want = {(q, int(v)) for q in range(0, 3000, 100) for v in np.argsort(-(plain @ plain[q]))[:10]}
    assert len(got) == 300 and len(got & want) >= 0.9 * len(want)


def test_inverted_file_blocks_of_queries_and_no_vectors(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(200)], "vec_id long, embedding array<double>")
    asked = vectors.filter("vec_id < 20")
    made = ann.fit(vectors, 3)
    whole = sorted(map(tuple, ann.neighbours(vectors, asked, 3, centroids=made).collect()))
    monkeypatch.setattr(ann, "MOST_QUERIES", 6)
    assert sorted(map(tuple, ann.neighbours(vectors, asked, 3, centroids=made).collect())) == whole and len(whole) == 60
    assert ann.neighbours(vectors.limit(0), vectors.limit(0), 3).count() == 0


def test_upsert_twice_skips(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, print string")
    none = spark.createDataFrame([], "k long, revision int, print string")
    first = changes.plan_upsert(none, new, "k")
    assert {r.action for r in first.collect()} == {"create"}
    stored = first.join(new, "k").select("k", "revision", "print")
    assert {r.action for r in changes.plan_upsert(stored, new, "k").collect()} == {"skip"}
    edited = new.withColumn("print", F.when(F.col("k") == 2, "c").otherwise(F.col("print")))
    assert {(r.k, r.action, r.revision) for r in changes.plan_upsert(stored, edited, "k").collect()} == {(1, "skip", 1), (2, "update", 2)}


def test_chunk_changes_add_up(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "r long, h string")
    new = spark.createDataFrame([(1, "b"), (1, "d"), (2, "c")], "r long, h string")
    got = {(r.r, r.h): r.change for r in changes.chunk_changes(old, new, "r", "h").collect()}
    assert got == {(1, "a"): "remove", (1, "b"): "keep", (1, "d"): "add", (2, "c"): "keep"}


def test_streak_and_carry(spark):
    df = spark.createDataFrame([(1, i, h, v) for i, (h, v) in enumerate([(True, 1.0), (True, None), (False, None), (True, None), (True, None)])], "k int, i int, h boolean, v double")
    assert [r.streak for r in rows.streak(df, "k", "i", F.col("h")).orderBy("i").collect()] == [1, 2, 0, 1, 2]
    assert [r.carried for r in rows.carry_forward(df, "k", "i", "v").orderBy("i").collect()] == [1.0, 1.0, 1.0, 1.0, None]


def test_nearest_rank_percentile(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "k int, v double")
    assert df.groupBy("k").agg(rows.percentile(F.collect_list("v"), 0.5).alias("p")).first().p == 3.0
    assert rows.ranked_percentile(df, ["k"], "v", 0.5, "p").first().p == 3.0


def _stream(spark, tmp_path, events):
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)


def _events(spark):
    kinds = ["signup", "view", "click", "error", "purchase"]
    data = [(i, f"{DAY}{i % 6:02d}:{i % 60:02d}:00", i % 7, kinds[(i * i + i // 3) % 5]) for i in range(120)]
    return spark.createDataFrame(data, "event_id long, t string, user_id long, event_type string").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type")


def test_stream_counts_equal_batch(spark, tmp_path):
    events = _events(spark)
    live = _stream(spark, tmp_path, events)
    counts = calls.per_hour(live, late="1 day")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("hourly").collect()}
    assert got == {tuple(r) for r in calls.per_hour(events).collect()}


def test_stream_backlog_equals_batch(spark, tmp_path):
    events = _events(spark).withColumns({"canonical_key": F.col("event_type"), "score": F.col("event_id").cast("double")})
    live = _stream(spark, tmp_path, events)
    out = str(tmp_path / "out")
    q = live.writeStream.foreachBatch(calls.merge_backlog(spark, out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    import os

    last = max(map(int, os.listdir(out)))
    got = {tuple(r) for r in spark.read.parquet(f"{out}/{last}").select("canonical_key", "occurrences", "best_score").collect()}
    want = events.groupBy("canonical_key").agg(F.count(F.lit(1)), F.max("score"))
    assert got == {tuple(r) for r in want.collect()}


def test_state_walk_equals_fold(spark):
    events = _events(spark)
    got = {r.user_id: (r.state, r.steps) for r in calls.final_states(events).collect()}
    by: dict = {}
    for r in sorted(events.collect(), key=lambda r: r.event_id):
        by.setdefault(r.user_id, []).append(r.event_type)
    assert got == {u: calls.walk("started", e) for u, e in by.items()}


def test_states_do_not_depend_on_ranges(spark):
    kinds = ["signup", "view", "click", "view", "other", "error", "view", "purchase", None]
    rows = [(i, i % 3 if i % 5 else 7, kinds[(i * 7 + i // 4) % len(kinds)]) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string")
    by = {}
    for _, user, kind in rows:
        by.setdefault(user, []).append(kind)
    want = {u: calls.walk("started", e) for u, e in by.items()}
    for span in (1, 10, 100_000):
        assert {r.user_id: (r.state, r.steps) for r in calls.final_states(events, span).collect()} == want


def test_spans_do_not_depend_on_batches(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    tracks = {u: np.repeat(rng.choice([-60.0, -20.0], 40), 25) for u in (1, 2, 5)}
    frames = spark.createDataFrame([(u, i, float(x)) for u, t in tracks.items() for i, x in enumerate(t)], "stream_id long, frame long, level double")
    want = sorted((u, a, b) for u, t in tracks.items() for a, b in calls.voice_activity(t))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        assert sorted(tuple(r) for r in calls.speech_spans(frames).collect()) == want and want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_voice_activity():
    levels = [-60.0] * 20 + [-20.0] * 30 + [-60.0] * 60
    assert calls.voice_activity(levels) == [(20, 50)]
    assert calls.voice_activity([]) == []


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Title , Slug\n one ,x\n,\n", encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.json").write_text(json.dumps({"items": [{"title": "two"}, {"title": "three"}]}))
    (tmp_path / "c.json").write_text("{broken")
    got = readers.read_folder(spark, str(tmp_path)).collect()
    assert [(r.source, r.position) for r in got] == [("seed:a.csv", 0), ("seed:b.json", 0), ("seed:b.json", 1), ("seed:c.json", -1)]
    assert json.loads(got[0].record) == {"slug": "x", "title": "one"}
    assert readers.read_csv(spark, str(tmp_path / "a.csv")).collect()[0].title == "one"
    assert {r.title for r in readers.read_json(spark, str(tmp_path / "sub" / "b.json")).collect()} == {"two", "three"}
    readers.write_csv(spark.createDataFrame([(1, ["a", "b"], True)], "i int, l array<string>, b boolean"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).collect()[0].l == "a;b"


def test_sniff():
    assert readers.sniff("x.yml", "") == "yaml" and readers.sniff("x", " [1]") == "json" and readers.sniff("x", "a,b\n1,2") == "csv"
