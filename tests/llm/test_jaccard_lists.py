"""What the Jaccard join moves: packed keys of lists, members that can link by position, texts that can link by their maps."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_corpus import CLASH, brute_components, rows

from callweave.llm import jaccard


def test_lists_of_equal_keys_lose_no_link(spark, monkeypatch):
    """Keys narrowed to 64 values join lists of different shingles, also within one document; the result stays."""
    honest = jaccard.class_rows

    def narrow(docs, lengths, long):
        def work(batches):
            for batch in batches:
                keys = [jaccard.unpack(x.as_py()).astype(np.uint64) for x in batch.column("short")]
                short = pa.array([jaccard.pack(k >> np.uint64(1) & np.uint64(63), k & np.uint64(1)) for k in keys], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), short], schema=batch.schema)

        return honest(docs, lengths, long).mapInArrow(work, jaccard.CLASSES)

    monkeypatch.setattr(jaccard, "class_rows", narrow)
    docs = spark.createDataFrame([(i, t, *[None] * 13) for i, t in rows()], CLASH)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.near_classes(docs).collect()) == brute_components()


def test_offers_against_plain_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 500)
    rng = random.Random(4)
    made, lists = [], defaultdict(list)
    for i in range(300):
        size = rng.randint(20, 60)
        keys = np.array([rng.randrange(900) if rng.random() < 0.7 else rng.randrange(1 << 39) for _ in range(size // 5 + 1)], dtype=np.uint64)
        long = keys % np.uint64(10) == 3
        common = rng.randrange(2000)
        made.append((i * 7 << 33, size, common, jaccard.pack(keys, long)))
        for pos, (k, is_long) in enumerate(zip(keys.tolist(), long.tolist(), strict=True)):
            lists[2 * k + is_long].append((-common, size, i * 7 << 33, pos))
    got = defaultdict(list)
    for r in jaccard.offers(spark.createDataFrame(made, "id long, size long, common int, short binary").repartition(3), 2).collect():
        got[r.shingle, r.salt].append(r)
    parts = defaultdict(list)
    for (key, salt), found in got.items():
        assert (salt > 0) == bool(key & 1) and len({r.a for r in found}) == 1 and all(r.members == len(found) for r in found)
        parts[key] += [r.b for r in found]
        ranks = sorted((-r.b.common, r.b.size, r.b.id) for r in found)
        assert (-found[0].a.common, found[0].a.size, found[0].a.id) == ranks[0]
        double = len({r.b.id for r in found}) < len(found)
        assert all((r.b.pos is None) == double for r in found)
        for r in found:
            others = [x.b for x in found if x.b.id not in (r.b.id, r.a.id)]
            least = [min(x.pos, r.b.pos) + min(x.size - x.pos, r.b.size - r.b.pos) for x in others] if not double else []
            can = any(9 * min(n, x.size, r.b.size) >= 4 * (x.size + r.b.size) for n, x in zip(least, others, strict=False))
            assert r.open or not can or r.b.id == r.a.id
            assert not r.open or len(found) > 2
    assert {k: sorted((-b.common, b.size, b.id) for b in v) for k, v in parts.items()} == {k: sorted(x[:3] for x in v) for k, v in lists.items() if len(v) > 1 or k & 1}


def test_texts_follow_near_copies(spark, monkeypatch):
    """400 documents share a phrase of their own group of four and nothing else, so none can link: no text is sent for them."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for i in range(400):
        words = [word() for _ in range(60)]
        words[10:16] = [f"phrase{i // 4}of{k}" for k in range(6)]
        texts.append(" ".join(words))
    texts += [texts[0] + " one", texts[0] + " two"]
    sent, honest = [], jaccard.with_texts

    def counted(placed, classes, docs):
        sent.append(placed.select("id").distinct().count())
        return honest(placed, classes, docs)

    monkeypatch.setattr(jaccard, "with_texts", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = jaccard.near_classes(docs)
    assert {r.doc_id: r.component_id for r in found.filter(F.col("doc_id") != F.col("component_id")).collect()} == {400: 0, 401: 0}
    assert 0 < sum(sent) <= 40  # before: every text of such a list, some 400


def test_copies_of_a_wanted_text_stay_out_of_the_shuffle(spark):
    docs = spark.createDataFrame([(i, "the same text of many documents") for i in range(3000)], "doc_id long, text string")
    classes = docs.filter("doc_id = 7").select(F.lit(1).cast("long").alias("id"), F.col("doc_id").alias("doc"), F.xxhash64("text").alias("print"))
    seen, honest = [], jaccard.marked
    kept = jaccard.marked
    try:
        jaccard.marked = lambda rows_, wanted: (out := honest(rows_, wanted), seen.append(out.filter("marked").count()))[0]
        filled, _ = jaccard.with_texts(classes.select("id"), classes, docs)
        assert [tuple(r) for r in filled.collect()] == [(1, "the same text of many documents")]
    finally:
        jaccard.marked = kept
    assert seen[0] < 200  # before: all 3000


def test_sketch_leaves_tasks_as_bytes(spark, monkeypatch):
    """The driver gets a byte a cell, and the levels are those of the counts, also above one byte."""
    texts = [f"w{i} w{i + 1} w{i + 2} w{i + 3} w{i + 4} w{i + 5}" for i in range(300)] + ["one two three four five"] * 700 + ["", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    frame, sent = type(docs), []
    honest = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda self: sent.append(honest(self)) or sent[-1])
    lengths, long = jaccard.sketch(docs)
    counts = np.zeros((2, jaccard.CELLS), dtype=np.int64)
    for t in texts:
        for row, cells in enumerate(jaccard._cells(jaccard.shingles(t or ""))):
            np.add.at(counts[row], cells, 1)
    assert (lengths == np.minimum(255, 8 * np.log2(1 + counts)).astype(np.uint8)).all() and lengths.dtype == np.uint8
    assert long == int(8 * np.log2(1001))
    assert sum(t.nbytes for t in sent) <= 2 * jaccard.CELLS + 100_000
    none = jaccard.sketch(docs.filter("false"))
    assert not none[0].any() and none[1] == long


def test_a_run_of_a_single_entry_is_read():
    one = np.array([(7 << 33, 5, 2, -3)], dtype=jaccard.ENTRY)
    assert jaccard._entries(jaccard._columns(one), 1).tolist() == one.tolist()


def _texts_shuffled(df):
    """Rows with a text that the exchanges of a query have written, once it has run."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        below = sum(walk(node.children().apply(i)) for i in range(node.children().size()))
        own = node.output().toString()
        return below + (node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" and ("row#" in own or "text#" in own) else 0)

    return walk(df._jdf.queryExecution().executedPlan())


def test_kept_documents_are_not_shuffled(spark):
    """However large the tables are, only dropped documents and a few others meet the dropped ids by a shuffle."""
    rng = random.Random(6)
    made = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(600)]
    made += [(1000 + i, made[i][1]) for i in range(8)] + [(None, made[20][1]), (None, "a b c d e f"), (599, made[3][1])]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.keep_one(docs)
        assert _texts_shuffled(kept) < 150
        assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id is None or r.doc_id < 1000)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
