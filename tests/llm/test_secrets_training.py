"""Training of the secret tagger at many windows, and its bounds."""

import numpy as np

from callweave.llm import secrets


def test_training_holds_at_many_windows():
    quiet, loud = np.array([0, 1, 0]) * secrets.WORDS, np.array([0, 150, 1]) * secrets.WORDS
    windows = [(loud, 0, np.array([0, 1, 0])) if i % 2 else (quiet, 0, np.array([0, 0, 0])) for i in range(10_400)]
    tagger = secrets.Tagger().fit(windows, epochs=1)
    assert tagger.viterbi(tagger.scores(loud, 0)).tolist() == [0, 1, 0] and not tagger.viterbi(tagger.scores(quiet, 0)).any()


def test_surplus_windows_of_a_text_go_by_hash():
    tokens = [t for i in range(1000) for t in (f"token=value{i:05d}", *["word"] * 40)]
    kept = secrets.windows_of(" ".join(tokens))
    at = [int(next(t for t in w[0] if t.startswith("token="))[-5:]) for w in kept]
    assert len(kept) == secrets.WINDOWS_PER_DOC and at == sorted(at) and max(at) > 500 and all(any(w[2]) for w in kept)
    assert secrets.windows_of(" ".join(tokens)) == kept


def test_trains_on_bounded_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(secrets.Tagger, "fit", lambda self, windows: seen.append(len(windows)) or self)
    rows = [(1, f"word number {i % 50} and more") for i in range(500)] + [(None, "a text without an id")] * 5
    secrets.train(spark.createDataFrame(rows, "doc_id long, text string"), sample=20)
    assert seen == [20 + secrets.MADE_WINDOWS]
