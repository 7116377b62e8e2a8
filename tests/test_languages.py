"""Scripts, markers, names, fusion and the memory of a conversation, on Indic, romanised and mixed texts."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as engine
from callweave.functions import languages
from callweave.functions.languages import Identifier, Memory, Rules, profile

WHO = Identifier()
SAMPLES = {
    "devanagari": "नमस्ते", "bengali": "বাংলা", "gurmukhi": "ਪੰਜਾਬੀ", "gujarati": "ગુજરાતી", "odia": "ଓଡ଼ିଆ", "tamil": "தமிழ்", "telugu": "తెలుగు", "kannada": "ಕನ್ನಡ", "malayalam": "മലയാളം", "arabic": "اردو", "latin": "Straße",
}


def test_every_script_in_one_pass(spark):
    assert set(SAMPLES) == set(languages.SCRIPTS)
    for name, said in SAMPLES.items():
        assert profile(said) == {name: 1.0}
    mixed = profile("ab कख 12 — ж")
    assert mixed == {"latin": 2 / 5, "devanagari": 2 / 5} and profile("") == {} and profile("12 !") == {}
    rows = spark.createDataFrame([("ab कख",), (None,)], "t string").select(languages.profiles(F.col("t")).alias("p")).collect()
    assert sum(rows[0].p) == 1.0 and rows[0].p[languages.SCRIPTS.index("latin")] == 0.5 and not any(rows[1].p)


@pytest.mark.parametrize(
    ("said", "language"),
    [
        ("मुझे फीस के बारे में जानकारी चाहिए, क्या है?", "hi-IN"), ("मला फी बद्दल माहिती पाहिजे आहे", "mr-IN"), ("प्रवेश", "mr-IN"), ("mujhe fees batao kya hai", "hi-IN"), ("mala fees sanga aahe", "mr-IN"),
        ("What is the fee of the course?", "en-IN"), ("When do classes start", "en-IN"), ("le prix des cours est dans la lettre", "fr-FR"), ("der preis ist nicht das problem", "de-DE"), ("வணக்கம்", "ta-IN"), ("ਸਤ ਸ੍ਰੀ ਅਕਾਲ", "pa-IN"), ("", "en-IN"),
    ],
)
def test_lexical(said, language):
    assert WHO.lexical(said)[0] == language
    assert (WHO.lexical(said)[1] == 0) == (said == "")


def test_confidence_follows_share_margin_and_evidence():
    scores = WHO.scores("What is the fee")
    assert scores == {"en-IN": 6.0 * (1 + 1.0) + 6.0 + 6.0}
    assert WHO.lexical("What is the fee")[1] == 0.98
    lone = WHO.lexical("प्रवेश")  # two languages share a script: half, no margin, half the evidence
    assert lone == ("mr-IN", round(0.45 * 0.5 + 0.35 * 0.5, 3))


def test_names_and_fusion():
    assert WHO.name("please speak Marathi") == "mr-IN" and WHO.name("मराठीत बोला") == "mr-IN" and WHO.name("a question") is None
    assert WHO.fused("hindi or english please")[0] in ("hi-IN", "en-IN")
    plain, agreed, denied = WHO.fused("What is the fee"), WHO.fused("What is the fee", "en-IN", 0.9), WHO.fused("What is the fee", "hi-IN", 0.2)
    assert plain[0] == agreed[0] == denied[0] == "en-IN" and agreed[1] == 0.99 and denied[1] == round(plain[1] * 0.7, 3)
    assert WHO.fused("", "ta-IN", 0.9)[0] == "ta-IN" and WHO.fused(None) == ("en-IN", 0.0)
    own = Identifier(Rules(names=[("klingon", "tlh")]))
    assert own.name("Klingon!") == "tlh" and own.name("hindi") is None


def test_a_vote_of_no_certainty_alone():
    for said in ("", None, "   ", "12 !", "ж"):
        assert WHO.fused(said, "hi-IN", 0.0) == WHO.fused(said, "hi-IN", -0.5) == ("hi-IN", 0.0)
    assert WHO.fused("What is the fee", "hi-IN", -0.5) == WHO.fused("What is the fee", "hi-IN", 0.0)


def test_lid_fuse_takes_empty_documents(spark, tmp_path):
    said = [(1, "", "fr", "web", 0), (2, "", None, "web", 0), (3, None, "de", "web", 0), (4, "   ", "hi", "web", 0), (5, "What is the fee", "en", "web", 15), (6, "", "fr", "web", -4000)]
    spark.createDataFrame(said, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.language, r.confidence) for r in engine.queries()["lid_fuse"](spark, str(tmp_path)).collect()}
    assert got == {1: ("fr-FR", 0.0), 2: ("en-IN", 0.0), 3: ("de-DE", 0.0), 4: ("hi-IN", 0.0), 5: WHO.fused("What is the fee", "en-IN", 15 / 4000), 6: ("fr-FR", 0.0)}


def test_memory_resists_a_single_turn():
    memory = Memory()
    heard = [("mr-IN", 0.8, False), ("en-IN", 0.9, False), ("mr-IN", 0.9, False), ("en-IN", 0.9, False), ("en-IN", 0.6, False), ("en-IN", 0.9, False), ("en-IN", 0.75, False), ("hi-IN", 0.2, True)]
    assert [memory.hear(*h) for h in heard] == ["mr-IN", "mr-IN", "mr-IN", "mr-IN", "mr-IN", "mr-IN", "en-IN", "hi-IN"]


def test_followed_equals_a_loop(spark):
    said = ["मला फी बद्दल माहिती पाहिजे आहे", "What is the fee of the course", "प्रवेश", "", None, "please speak hindi", "le prix des cours est dans la lettre"]
    rows = [(c, t, said[(c * 3 + t * t) % len(said)]) for c in range(20) for t in range(c + 1)] + [(None, 0, said[0])]
    want = []
    for conv in {r[0] for r in rows}:
        memory = Memory()
        for _, t, s in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1]):
            language, confidence = WHO.fused(s or "")
            want.append((conv, t, language, confidence, memory.hear(language, confidence, WHO.name(s) is not None)))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(5)
    assert sorted(map(tuple, languages.followed(frame).collect()), key=str) == sorted(want, key=str)
    assert languages.followed(frame.limit(0)).count() == 0
