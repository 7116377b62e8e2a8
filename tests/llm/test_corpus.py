"""Operators on small tables with nulls, empty and long texts, repeated rows, clashing columns and no rows."""

import math
import random
import zlib
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from callweave.llm import ctw, exact_dedup, jaccard, mixing, packing, quality, secrets, telephony, url_filter, warc

WORDS = [a + b for a in "ka lo mi ne pu ra".split() for b in "ti so re na vu da".split()]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, digest string, size string, label string, slot string, kept string, word string, block string, id string, x string, row string"


def rows():
    rng = random.Random(9)
    made = [(None, "a text without an id"), (1, None), (2, ""), (3, " \n\t"), (4, "two words"), (5, "Two  WORDS"), (6, "word " * 30_000)]
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(30, 120))) for _ in range(25)]
    made += [(10 + i, t) for i, t in enumerate(base)]
    made += [(100 + i, base[i % 5]) for i in range(15)]  # copies
    for i in range(20):  # near copies of a few texts
        words = base[5 + i % 4].split()
        words[rng.randrange(len(words))] = "changed"
        made.append((200 + i, " ".join(words)))
    made += [(10, base[0]), (10, base[0])]  # repeated rows
    return made


@pytest.fixture(scope="module")
def docs(spark):
    full = [(i, t, [None, "en", "fr"][k % 3], f"src{k % 4}", len(t or ""), *["clash"] * 10) for k, (i, t) in enumerate(rows())]
    return spark.createDataFrame(full, CLASH).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


def test_exact_against_brute_force(docs, none):
    by: dict = {}
    for i, t in rows():
        by.setdefault(t or "", []).append(i)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(rows())
    key = lambda i: (i is not None, i or 0)
    want = sorted((str(i), str(max(ids, key=key)), len(ids), i == max(ids, key=key)) for ids in by.values() for i in ids)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == want
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(by)
    assert exact_dedup.exact_duplicates(none).count() == 0 and exact_dedup.drop_exact_duplicates(none).count() == 0


def test_native_operators_run_no_python(docs):
    for df in (exact_dedup.exact_duplicates(docs), mixing.sampled(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_filter_has_false_positives_only(spark):
    ids = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("d"))
    twice = ids.unionByName(ids.limit(40))
    marked = exact_dedup.marked(twice.withColumnRenamed("d", "digest"))
    again = {r.digest for r in marked.filter("again").collect()}
    assert {r.d for r in twice.groupBy("d").count().filter("count > 1").collect()} <= again
    assert len(again) < 200


def brute_components():
    def shingle(t):
        w = bytes(t or "", "utf8").lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    nodes = [(i, shingle(t)) for i, t in rows()]
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            s, t = nodes[a][1], nodes[b][1]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                parent[find(a)] = find(b)
    groups: dict = {}
    for k, (i, _) in enumerate(nodes):
        groups.setdefault(find(k), []).append(i)
    return sorted((str(i), len(s), str(min((x for x in groups[find(k)] if x is not None), default=None) if s else i)) for k, (i, s) in enumerate(nodes))


def test_jaccard_against_brute_force(docs, none, monkeypatch):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.near_classes(docs).collect())
    assert got == brute_components()
    assert jaccard.near_classes(none).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] if r[0] != "None" else None for r in [(c if c == "None" else int(c),) for _, _, c in brute_components()]}


def test_jaccard_with_every_list_long(docs, monkeypatch):
    """All lists marked as long: they are offered in salted parts, and the result stays."""
    honest = jaccard.sketch
    monkeypatch.setattr(jaccard, "sketch", lambda d: (honest(d)[0], 0))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.near_classes(docs).collect())
    assert got == brute_components()


def test_t_occurrence_against_brute_force():
    """Heap-merged short lists and probed long ones find just the sets that reach T, for sets of many sizes."""
    import numpy as np

    rng = random.Random(8)
    base = [rng.sample(range(4000), n) for n in (1, 3, 20, 150, 700)]
    sets = []
    for b in base:
        for edits in (0, 1, 0.05, 0.1, 0.2, 0.3):
            n = edits if isinstance(edits, int) else int(edits * len(b))
            sets.append(np.array(sorted(set(b[n:]) | set(rng.sample(range(4000, 9000), n))), dtype=np.uint64))
    lists = jaccard.Lists(sets)
    for q in sets:
        want = [i for i, s in enumerate(sets) if 100 * len(set(q) & set(s)) >= 80 * len(set(q) | set(s))]
        assert sorted(lists.search(q).tolist()) == want
    assert len(jaccard.Lists([]).search(sets[0])) == 0 and len(lists.search(np.zeros(0, dtype=np.uint64))) == 0


def test_maps_bound_the_overlap():
    import numpy as np

    rng = np.random.default_rng(4)
    for n, m, shared in ((10, 12, 9), (300, 320, 290), (300, 320, 10), (1000, 700, 650)):
        x = rng.choice(1 << 40, n + m - shared, replace=False).astype(np.uint64)
        p, q = np.unique(x[:n]), np.unique(x[n - shared :])
        one, two = jaccard.parity(p), jaccard.parity(q)
        words = min(len(one), len(two))
        differ = int(np.bitwise_count(jaccard.fold(one, words) ^ jaccard.fold(two, words)).sum())
        assert (len(p) + len(q) - differ) // 2 >= shared
        if 100 * shared >= 80 * (n + m - shared):
            assert jaccard.can_link(len(p), len(q), differ)


def test_chains_become_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "x long, y long")
    got = {r.id: r.label for r in jaccard.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_raking_meets_its_marginals(spark):
    rng = random.Random(3)
    cells = spark.createDataFrame([(s, l, t, rng.randint(1, 500)) for s in "abc" for l in "xy" for t in "pq"], "source string, lang string, topic string, tokens long")
    out = mixing.rake(cells.coalesce(1), rounds=30).toPandas()
    total = out.tokens.sum()
    for axis, power in mixing.POWERS.items():
        share = out.groupby(axis).tokens.sum() / total
        want = share**power / (share**power).sum()
        assert (abs(out.groupby(axis).weight.sum() / total - want) < 1e-3).all()
    fixed = mixing.rake(cells.coalesce(1), targets={"source": {"a": 1, "b": 1}}, rounds=30).toPandas()
    assert fixed[fixed.source == "c"].weight.sum() == 0


def test_mixing_cases(docs, none):
    got = mixing.sampled(docs)
    assert got.count() == len(rows()) and mixing.sampled(none).count() == 0
    kept = mixing.mix(docs)
    assert kept.columns == docs.columns
    twice = {r.doc_id: r["count"] for r in kept.filter("doc_id = 10").groupBy("doc_id").count().collect()}
    assert twice in ({}, {10: 3})


def test_packing_exact_cover(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    import numpy as np

    plain = tokenizers.Tokenizer.from_file(packing.vocabulary())
    got = packing.pack(docs).toPandas()
    assert packing.pack(none).count() == 0
    want: dict = {}
    for i, t in rows():
        ids = np.asarray([*plain.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
        for start, n in packing.cuts(len(ids) // 4):
            key = (str(i), start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4)
            want[key] = want.get(key, 0) + 1
    found: dict = {}
    for r in got.itertuples():
        i = "None" if math.isnan(r.doc_id) else str(int(r.doc_id))
        key = (i, r.start, r.length, r.ids_crc32, r.doc_tokens)
        found[key] = found.get(key, 0) + 1
    assert found == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= packing.CAPACITY and g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]


def test_language_model_against_brute_force(spark, none):
    from test_small_models import brute_ctw

    texts = [(i, t) for i, t in enumerate(["Ab ab cab", "", None, "bab  ba\tb", "abc cab é", "cab cab cab", "zz", "b", "ab cab ab", "q r s"])]
    df = spark.createDataFrame([*texts, (None, "ab")], "doc_id long, text string")
    held = lambda i: crc32(b"" if i is None else str(i).encode()) % 7 == 2
    flat = [(i, b" ".join((t or "").encode().lower().split())) for i, t in [*texts, (None, "ab")]]
    for depth in (1, 3):
        want = brute_ctw([t for i, t in flat if not held(i)], [t for _, t in flat], depth)
        got = {r.doc_id: r for r in ctw.score(df, depth=depth).collect()}
        for (i, t), w in zip(flat, want, strict=True):
            assert abs(got[i].score - w) < 1e-6 * max(1, abs(w)), (i, t)
    train = [w for i, t in flat if not held(i) for w in [*t.split(), "end"]]
    c = lambda w: sum(x == w for x in train)
    for i, t in flat:
        words = [*t.split(), "end"]
        assert got[i].n_tokens == len(words) and got[i].n_known == sum(c(w) > 0 for w in words) and got[i].train_tokens == len(train)
        assert abs(got[i].base_score - sum(math.log10((c(w) + 1) / (len(train) + len(set(train)) + 1)) for w in words)) < 1e-9
    assert ctw.score(none).count() == 0


def test_quality_learns_and_hides_held_out_labels(spark, none):
    rng = random.Random(1)
    good = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(150)]
    bad = [" ".join(rng.choice(WORDS).upper() + "!!" for _ in range(60)) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    vectors, net = quality.fitted(df, labels)
    out = quality.score(df, vectors, net).toPandas()
    held = out[[crc32(str(i).encode()) % 4 == 2 and i < 300 for i in out.doc_id]]
    assert ((held.quality_score >= quality.ACCEPT) == (held.doc_id < 150)).mean() > 0.95
    assert out.quality_score.between(0, 1).all() and len(out) == 302
    flipped = labels.withColumn("quality", F.when(quality.fold() == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.score(df, *quality.fitted(df, flipped)).toPandas()
    assert (again.sort_values("doc_id").quality_score.to_numpy() == out.sort_values("doc_id").quality_score.to_numpy()).all()
    assert quality.accept(none, labels).count() == 0 and quality.accept(none, labels.limit(0)).columns == none.columns


def test_columns_of_clashing_names_stay(spark):
    """Columns named like the operators' own keep their values through every filtering stage."""
    names = ["quality_score", "__source", "__kept", "__digest", "__map0", "again", "digest", "map0", "bits0", "row", "prob", "kept", "kept_id", "tokens", "topic", "made"]
    texts = ["one two three four five six seven", "one two three four five six seven", None, "", "eight nine ten eleven twelve thirteen"]
    rows_ = [(i, t, "en", "s", 1, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {"quality": quality.accept(df, labels), "exact": exact_dedup.drop_exact_duplicates(df), "jaccard": jaccard.keep_one(df), "mixing": mixing.mix(df)}
    want = {r[0]: r for r in rows_}
    for name, out in kept.items():
        assert out.columns == df.columns
        got = out.collect()
        assert got and all(tuple(r) == want[r.doc_id] for r in got), name
    assert sorted(r.doc_id for r in kept["exact"].collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in kept["jaccard"].collect()) == [0, 2, 3, 4]


def test_index_vectors_and_pooling_against_brute_force(spark):
    import numpy as np

    texts = ["a b a c", "b c, d!", None, "", "a a a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    at, sign = quality.index_vectors()
    want = np.zeros((quality.BUCKETS, quality.DIMS))
    for t in texts:
        w = quality.word_rows(t or "")
        for i in range(len(w)):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if i != j:
                    want[w[i], at[w[j]]] += sign[w[j]]
    got = quality.context_vectors(df)
    assert (got == want).all()
    unit = quality.unit_vectors(got)
    for t, x in zip(texts, quality.pooled([t or "" for t in texts], unit), strict=True):
        w = quality.word_rows(t or "")
        rows_ = unit[w].astype(float)
        mean = rows_.mean(axis=0) if len(w) else np.zeros(quality.DIMS)
        spread = rows_.std(axis=0) if len(w) else np.zeros(quality.DIMS)
        assert np.allclose(x, [*mean, *spread, np.log1p(len(w))], atol=1e-4)


def test_secret_table_against_brute_force(docs):
    import hashlib
    import re

    def naive(text):
        found = []
        for k, (pattern, group, least) in enumerate([(r"((?:(?i:password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8), (r"AKIA[A-Z0-9]+", 0, 16), (r"[0-9a-f]+", 0, 32)]):
            found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m.group(group)) >= least]
        return sorted(found)

    extra = [(900 + i, t) for i, t in enumerate(["token: abcdefgh API_KEY='x1x2x3x4x5' " + "ab12" * 9, "AKIA" + "Q" * 12 + " AKIA" + "Q" * 11, 'SECRET = "short" passwd:12345678'])]
    df = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(extra, "doc_id long, text string"))
    tagger = secrets.Tagger()
    for r, t in ((r, t) for r in secrets.scan(df, tagger).collect() for t in {x for i, x in [*rows(), *extra] if i == r.doc_id}):
        base = naive(t or "")
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.spans == said


def test_secrets_added_by_the_chain(spark, docs, none):
    leak = 'and so on credential = "ghp0Zq8Lm3XyT7bVn2KdR5wE" then more'
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900, leak), (901, "token = abcdefgh12345")], "doc_id long, text string"))
    tagger = secrets.train(df)
    got = {r.doc_id: r for r in secrets.scan(df, tagger).collect()}
    assert got[901].n_assign == 1 and got[901].spans == "assign:0:21"
    assert got[900].spans.startswith("crf:") and "ghp0Zq8Lm3XyT7bVn2KdR5wE" in leak[int(got[900].spans.split(":")[1]) : int(got[900].spans.split(":")[2])]
    assert all(got[i].spans == "" for i in (1, 2, 3, 4, 6, 15))
    assert secrets.scan(none, tagger).count() == 0


def test_telephony_round_trip(docs, none):
    got = telephony.digest(telephony.encode_text(docs)).collect()
    media = {r.doc_id: r for r in telephony.decode(telephony.encode_text(docs)).collect()}
    import hashlib

    assert len(got) == len(rows())
    for i, t in rows():
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        mine = [r for r in got if r.doc_id == i]
        assert all((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])) for r in mine)
        assert bytes(media[i].payload) == padded and len(media[i].pcm) == 4 * len(padded)
    assert telephony.digest(telephony.encode_text(none)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "ä" * 1200
    pages = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, None), (4, "http://a/4", ""), (5, "x", "small"), (6, "x", "small"), (7, "u", "<b>" * 300_000), (2, "http://a/2", big), (None, "n", big)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, bundle string").repartition(3)
    folder = f"file://{tmp_path}/bundles"
    index = warc.write_bundles(warc.plan_records(df), folder, frame_bytes=2000)
    got = warc.read_bundles(index, folder, payloads=True).collect()
    assert len(got) == len(pages)
    text = {p[0]: (p[2] or "").encode() for p in pages}
    import hashlib

    for r in got:
        assert r.payload_bytes == len(text[r.page_id]) and r.payload_digest == hashlib.sha1(text[r.page_id]).hexdigest()
        again = r.page_id in (1, None)
        assert (r.record_type, r.refers_to, bytes(r.content)) == (("revisit", 2, b"") if again else ("response", None, text[r.page_id]))
    empty = warc.write_bundles(warc.plan_records(df.limit(0)), folder)
    assert warc.read_bundles(empty, folder).count() == 0


def test_url_templates_judge_hosts(spark):
    pages = [(i, f"http://casino-x.example.org/en/{i}") for i in range(40)] + [(100 + i, f"http://good.example.org/{w}/{i}.html") for i, w in enumerate(["en", "fr"] * 20)]
    pages += [(200 + i, f"http://mix.net/{'es' if i % 2 else 'en'}/{i}") for i in range(60)] + [(300, None), (301, "no scheme"), (302, "http://one.example.org")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, template string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert len(got) == len(pages)
    assert {got[i].verdict for i in range(40)} == {"block"} and {got[i].template for i in range(40)} <= {"en/{n}", "{*}/{n}"}
    assert {got[i].verdict for i in range(100, 140)} == {"allow"}
    assert all(got[200 + i].verdict == ("block" if i % 2 else "allow") for i in range(60))  # rows without a rule keep their branch's purity
    # one host, marks that vary by path: the tree separates its branches, whatever the host says
    paths = [(i, f"http://shop.example.org/{'promo' if i % 2 else 'news'}/{'x/y/z/w/deep/' if i % 4 > 1 else ''}{i}", "block" if i % 2 else "allow") for i in range(80)]
    paths += [(100, "http://shop.example.org/promo/777", None), (101, "http://shop.example.org/news/x/y/z/w/deep/9", None), (102, "http://shop.example.org/" + "a/" * 300, None)]
    paths += [(200 + i, f"http://wide.example.org/u/{a}{b}/b/c/d/{b}{a}/{i}", "block") for i, (a, b) in enumerate((a, b) for a in WORDS[:6] for b in WORDS[6:12])]
    told = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(paths, "page_id long, url string, mark string"), label_column="mark").collect()}
    assert told[100].verdict == "block" and told[101].verdict == "allow" and len(told) == len(paths)
    assert {told[200 + i].template for i in range(36)} == {"u/{s}/b/c/d/{s}/{n}"} and told[200].verdict == "block"
    assert got[300].host == "" and got[301].path == "" and got[302].verdict == "allow"
    assert url_filter.judge(df.limit(0)).count() == 0
