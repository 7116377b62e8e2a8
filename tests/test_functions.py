"""Golden values of text functions and classifiers."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from callweave.functions import batches, classify, passages, text


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("asked", "key"),
    [
        ("What is the fee for B.Tech CSE?", "what fee b tech cse"),
        ("hostel mandatory hai kya", "hostel mandatory"),
        ("Fee for B.Tech CSE??", "fee b tech cse"),
        ("", ""),
    ],
)
def test_canonical_key(spark, asked, key):
    assert one(spark, asked, text.canonical_key) == key


def test_canonical_key_is_bounded(spark):
    key = one(spark, " ".join(f"word{i}" for i in range(60)), text.canonical_key)
    assert len(key.split()) == 8 and len(key) <= 160


def test_tokenize(spark):
    assert one(spark, "What is the _Fee_ for x 7 rooms?", text.tokenize) == ["fee", "7", "rooms"]
    assert one(spark, None, text.tokenize) == []


def test_expand_adds_groups(spark):
    # a word's own group and its singular's, words that are part of a phrase, then the phrase itself
    assert one(spark, "fees and financial aid", text.expand) == ["fees", "financial", "aid", "#g:price", "#g:price", "#g:aid", "#g:aid", "#g:aid"]
    own = {"sea": ["ship", "deep water"], "land": ["water", "road"]}
    assert one(spark, "Deep WATERS, roads", lambda c: text.expand(c, own)) == ["deep", "waters", "roads", "#g:sea", "#g:land", "#g:land", "#g:sea"]


@pytest.mark.parametrize(("said", "value"), [("1.5 lakh", 150000.0), ("INR 6,00,000", 600000.0), ("1.2 crore", 1.2e7), ("none", None), ("5 thousand", 5000.0)])
def test_parse_money(spark, said, value):
    assert one(spark, said, text.parse_money) == value


def test_number_words(spark):
    rows = spark.createDataFrame([(0,), (21,), (140000,), (12345678,)], "n long").select(text.number_words(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["zero", "twenty one", "one lakh forty thousand", "one crore twenty three lakh forty five thousand six hundred seventy eight"]


def test_phone_and_email(spark):
    assert one(spark, "98 76 54 32 10", text.extract_phone) == "+919876543210"
    assert one(spark, "write a.b@c.org now", text.extract_email) == "a.b@c.org"


def test_clip(spark):
    assert one(spark, "alpha beta gamma", lambda c: text.clip(c, 12)) == "alpha beta…"
    assert one(spark, "short", lambda c: text.clip(c, 12)) == "short"


def test_mask(spark):
    assert one(spark, "mail a.b@c.org or 98765 43210", passages.masked) == "mail [email:*******rg] or [phone:********210]"
    assert one(spark, "pan ABCDE1234F, id 1234 5678 9012", passages.masked) == "pan [pan:********4F], id [aadhaar:**********12]"
    assert one(spark, "card 4111111111111111 end", passages.masked) == "card [card:" + "*" * 14 + "11]end" and one(spark, None, passages.masked) == ""
    assert one(spark, "none here", passages.masked) == "none here" and set(one(spark, "a@b.io 98765 43210", lambda c: passages.found_hashes(c, "k"))) == {"email", "phone"}


def ungrounded(spark, answer, context):
    return spark.createDataFrame([(answer, context)], "a string, c string").select(passages.ungrounded(F.col("a"), F.col("c")).alias("y")).first()["y"]


def test_numeric_grounding(spark):
    assert ungrounded(spark, "about 1.4 lakh", "the fee is 140000") == []
    assert ungrounded(spark, "about 9 lakh", "the fee is 140000") == ["900000"]
    assert ungrounded(spark, "1 lakh 40 thousand", "the fee is 140000") == []
    assert one(spark, "1 lakh and a 40 thousand, 7,500", passages.numbers) == ["100000", "40000", "7500", "750000000", "75000000000"]
    assert one(spark, None, passages.numbers) == []


def naive_numbers(body):
    scales = "|".join(sorted(passages.SCALES, key=len, reverse=True))
    groups, spans = [], []
    for m in re.finditer(rf"(\d[\d,]*(?:\.\d+)?)\s*({scales})(?![^\W_]|_)", body, re.I):
        value = float(m[1].replace(",", "")) * passages.SCALES[m[2].lower()]
        if spans and m.start() - spans[-1][1] <= passages.GAP:
            groups[-1] += value
            spans[-1][1] = m.end()
        else:
            groups.append(value)
            spans.append([m.start(), m.end()])
    out = {f"{g:.0f}" for g in groups if g}
    for m in re.finditer(r"\b\d[\d,]*(?:\.\d+)?\b", body):
        if not any(a <= m.start() and m.end() <= b for a, b in spans):
            plain = m[0].replace(",", "")
            out |= {plain, *(f"{float(plain) * k:.0f}" for k in (1, 1e5, 1e7))}
    return sorted(out)


def test_numbers_like_a_loop(spark):
    rng = random.Random(4)
    parts = ["1", "40", " 2,50,000", " 3.5", " lakh", " hazar", "हज़ार", " लाख", " crore", "cr", " ", " , ", " and ", "x", "thousand", "7", "~", ". ", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(3000)] + ["1 लाख 40 हज़ार", "5, lakh", "12 lakhs"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    exact = lambda found: [n for n in found if len(n) < 16]  # noqa: E731  doubles hold whole numbers up to 9e15
    wrong = [(r.t, r.n, naive_numbers(r.t)) for r in frame.select("t", passages.numbers(F.col("t")).alias("n")).collect() if exact(r.n) != exact(naive_numbers(r.t))]
    assert wrong == []


def test_numbers_of_whole_tables(spark):
    for table in ("documents", "conversations"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").select("text", passages.numbers(F.col("text")).alias("n")).collect()
        assert all([n for n in r.n if len(n) < 16] == [n for n in naive_numbers(r.text or "") if len(n) < 16] for r in rows) and any(r.n for r in rows) == (table == "documents")


def test_long_texts_take_linear_time(spark):
    began = time.time()
    texts = ["1 lakh " * 150_000, "1" * 1_000_000, "a" * 1_000_000, "a.b" * 300_000, " " * 1_000_000 + "x" + " " * 1_000_000, "12,3," * 200_000, "1 lakh and more of it. " * 40_000]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    counts = [tuple(r) for r in frame.select(F.size(passages.numbers(F.col("t"))), F.length(passages.masked(F.col("t")))).collect()]
    assert counts[0] == (1, 1_050_000) and counts[2] == (0, 1_000_000) and counts[6][0] == 1
    assert time.time() - began < 90


def test_chunks_keep_every_word(spark):
    body = "\n\n".join(" ".join(f"w{p}x{i}." for i in range(90)) for p in range(6))
    made = one(spark, body, passages.chunks)
    assert all(len(c) <= passages.MOST + passages.OVERLAP + 2 for c in made) and len(made) > 3
    assert {w for c in made for w in c.replace("…", " ").split()} >= set(body.split())
    assert one(spark, "", passages.chunks) == [] and one(spark, " short ", passages.chunks) == ["short"] and one(spark, None, passages.chunks) == []


def naive_chunks(text):
    """Brute force: every way of reading the rule, character by character."""
    import re

    text = re.sub(r"\n{3,}", "\n\n", text.strip())
    if len(text) <= 900:
        return [text] if text else []

    def cut(p):
        ends, out = [0], []
        for m in re.finditer(r"[.!?\u0964]\s+", p):
            before, after = p[: m.start() + 1], p[m.end() :]
            short = re.search(r"(?<![A-Za-z])[A-Z][A-Za-z]{0,2}\.$", before) and re.match("[a-z0-9]", after)
            if not short:
                ends.append(m.end())
        ends.append(len(p))
        for a, b in zip(ends, ends[1:]):
            if p[a:b].strip():
                out.append(p[a:b].strip())
        return out

    def pack(parts, limit, glue):
        out = []
        for p in parts:
            if out and len(out[-1] + glue + p) <= limit:
                out[-1] = out[-1] + glue + p
            else:
                out = [*out, p]
        return out

    blocks = []
    for p in re.split(r"\n\s*\n", text):
        if p.strip():
            blocks += [p.strip()] if len(p.strip()) <= 620 else pack(cut(p.strip()), 620, " ")
    packed = pack(blocks, 900, "\n")
    out = packed[:1]
    for i in range(1, len(packed)):
        tail = packed[i - 1][-90:].strip()
        at = tail.find(" ")
        tail = tail[at + 1 :] if at > 0 and tail[at + 1 :].strip() else tail
        out.append("…" + tail + " " + packed[i])
    return [c for c in out if len(c) >= 120] or out


def test_chunks_and_sentences_of_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = docs.select("text", passages.chunks(F.col("text")).alias("c")).collect()
    assert len(got) > 100 and sum(len(r.c) for r in got) > len(got)
    for r in got:
        assert r.c == naive_chunks(r.text or "")


def test_sentences_hold_abbreviations(spark):
    assert one(spark, "The BBA LL.B. honours degree. Next one!", passages.sentences) == ["The BBA LL.B. honours degree.", "Next one!"]
    assert one(spark, "See Dr. Rao at No. 5.  Then go? Yes", passages.sentences) == ["See Dr.", "Rao at No. 5.", "Then go?", "Yes"]


def test_spoken_parts(spark):
    said = " ".join(f"word{i} and more," for i in range(60))
    parts = one(spark, said, passages.spoken_parts)
    assert max(map(len, parts)) <= 180 and " ".join(parts).split() == said.split()
    assert [len(p) for p in one(spark, "x" * 400, passages.spoken_parts)] == [180, 180, 40] and one(spark, None, passages.spoken_parts) == []


def naive_vector(features, compact, dims):
    """The published rule, feature by feature."""
    import hashlib

    import numpy as np

    of = lambda s, salt: int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "big") % dims
    counts, signs, out = {}, {}, np.zeros(dims)
    for f in features:
        counts[of(f, 0)] = counts.get(of(f, 0), 0) + 1
        signs[of(f, 0)] = -1.0 if of(f, 7) % 2 else 1.0
    for cell, n in counts.items():
        out[cell] += signs[cell] * (1 + np.log(n))
    for i in range(0, len(compact) - 2, 2):
        cell = of(compact[i : i + 3], 3)
        out[cell] += 0.25 * signs.get(cell, 1.0)
    return out / (np.linalg.norm(out) or 1)


def test_hash_vectors_follow_the_rule(spark):
    import numpy as np

    texts = ["Fees due, fees paid: what is the fee?", "", None, "प्रवेश प्रक्रिया und Größe", "hostel rooms " * 50, "x"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(text.expand(F.col("t")).alias("fs"), text.compact(F.col("t")).alias("c"))
    got = frame.select("fs", "c", batches.hash_embed(F.col("fs"), F.col("c"), 32).alias("v")).collect()
    assert all(np.allclose(r.v, naive_vector(r.fs, r.c, 32), atol=1e-6) for r in got) and not any(got[1].v)
    lone = spark.createDataFrame([(texts[0],)], "t string").select(batches.hash_embed(text.expand(F.col("t")), text.compact(F.col("t")), 32).alias("v")).first().v
    assert np.allclose(lone, got[0].v)  # a row does not depend on its batch


def test_classifiers(spark):
    assert one(spark, "how much is the fee", classify.intent)["label"] == "price"
    assert one(spark, "zzz", classify.intent)["label"] == "other"
    assert one(spark, "I was harassed", classify.topic)["label"] == "sensitive"
    assert one(spark, "  ", classify.topic)["label"] == "on_topic"
    assert one(spark, "no, that is right", classify.confirmation) == "no"
    assert one(spark, "HI-in", classify.normal_language) == "hi-IN"
    assert one(spark, "le chat est dans la maison", classify.language)["label"] == "fr"


def test_slug():
    import pandas as pd

    made = batches.slugs(pd.Series(["École d'été 2024", "!!!", None, "x" * 300])).tolist()
    assert made[0] == "ecole-dete-2024" and len(made[1]) == 12 and len(made[2]) == 12 and made[3] == "x" * 140
