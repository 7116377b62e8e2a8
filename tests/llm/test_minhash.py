"""Near-duplicates by MinHash against all pairs of full sets."""

import random
import re

import numpy as np
import pytest

from callweave.llm import minhash

SCHEMA = "doc_id long, text string"


def naive(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(set(zip(words, words[1:], strict=False)) if len(words) > 1 else set(words))
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (n, _) in enumerate(rows):
        if n is not None:
            least[root(i)] = min(n, least.get(root(i), n))
    return sorted(((n, len(s), least.get(root(i)), n == least.get(root(i))) for i, ((n, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(spark, rows, **extra):
    frame = spark.createDataFrame(rows, SCHEMA)
    for name, value in extra.items():
        frame = frame.withColumn(name, value)
    return sorted((tuple(r) for r in minhash.near_duplicates(frame.repartition(5)).collect()), key=str)


def edited(rng, words, share):
    words = list(words)
    for _ in range(int(share * len(words))):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[], [f"n{rng.randrange(10**6)}"], [words[at], f"m{rng.randrange(10**6)}"]])
    return words


def test_edited_copies_of_all_lengths(spark):
    from pyspark.sql import functions as F

    rng, rows = random.Random(11), []
    for n in [3, 5, 6, 8, 12, 25, 60, 150, 600]:
        for _ in range(3):
            words = [f"w{rng.randrange(10**5)}" for _ in range(n)]
            rows += [(None, " ".join(edited(rng, words, share))) for share in (0, 0, 0.02, 0.04, 0.05, 0.07, 0.08, 0.1, 0.15)]
    rows = [(i, t.upper() if i % 7 == 0 else t) for i, (_, t) in enumerate(rows)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "Éa b"), (907, "éa b"), rows[4], rows[4], (None, "odd out of all"), (None, rows[50][1]), (3, "a second text of three")]
    rows.append((950, " ".join(f"long{i}" for i in range(60_000))))
    assert found(spark, rows, id=F.lit("x"), size=F.lit(1), digest=F.lit(None).cast("string")) == naive(rows)


def test_members_that_link_past_their_centre(spark):
    """0 shares buckets with 1 and 2, links with neither; 1 and 2 link with each other. Short texts share one hot pair."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    far = edited(rng, base, 0.11)
    rows = [(0, " ".join(base)), (1, " ".join(far)), (2, " ".join(edited(rng, far, 0.02)))]
    rows += [(10 + i, f"of the r{i} s{i} t{i} of the u{i % 40}") for i in range(400)]
    rows += [(1000 + i, " ".join(edited(rng, base, 0.09))) for i in range(150)]
    assert found(spark, rows) == naive(rows)


def test_leftover_pairs_of_open_buckets_in_blocks(spark, monkeypatch):
    """Large groups are cut into blocks and still lose no pair."""
    monkeypatch.setattr(minhash, "SIDE", 4)
    rng = np.random.default_rng(1)
    made = lambda n: np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
    base, far, short = made(100), made(100), made(30)
    bits = lambda s: bytearray(minhash.parity(s).tobytes())
    member = [(1, i, i // 3, 100, bits(base)) for i in range(20)] + [(1, 30, 30, 100, bits(far)), (2, 50, 50, 30, bits(short)), (2, 51, 51, 100, bits(base)), (2, 52, 51, 100, bits(base))]
    frame = spark.createDataFrame(member, "group long, id long, label long, size long, bits binary")
    got = {(r.x, r.y) for r in minhash.leftover(frame).collect()}
    assert got == {(i, j) for j in range(20) for i in range(j) if i // 3 != j // 3}


@pytest.mark.parametrize("n", [4, 5, 30, 192, 2000])
def test_densified_signatures_estimate_similarity(n):
    rng = np.random.default_rng(n)
    agree = []
    for _ in range(60):
        pool = np.unique(rng.integers(0, 1 << 62, 2 * n, dtype=np.uint64))
        a, b = np.sort(pool[: len(pool) // 2]), np.sort(pool[len(pool) // 10 : len(pool) // 10 + len(pool) // 2])
        shared = len(np.intersect1d(a, b))
        agree.append((minhash.signature(a) == minhash.signature(b)).mean() - shared / (len(a) + len(b) - shared))
    assert abs(np.mean(agree)) < 0.05


def test_no_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
