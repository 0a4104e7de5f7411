"""Language identification and toxicity: held-out quality, odd rows, what is learned from."""

import zlib

import numpy as np
import pytest

from odd_rows import ODD, SF_DIR, docs  # noqa: F401
from stratafold.llm import language_id, toxicity

GERMAN = "der hund und die katze sind nicht auf dem dach sondern in der schule und das ist gut für alle menschen hier"
ENGLISH = "the dog and the cat are not on the roof but in the school and this is good for all of the people here"


def held(n):
    return zlib.crc32(str(n).encode()) % 5 == 0


@pytest.fixture
def bilingual(docs):
    rows = [(n, (GERMAN if n % 2 else ENGLISH)[n % 30 :], "de" if n % 2 else "en") for n in range(60)]
    return rows, docs


def test_languages_on_the_table(spark):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    truth = {r.doc_id: r.lang for r in table.collect()}
    found = language_id.predict(table, language_id.train(table)).collect()
    assert len(found) == len(truth) and all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in found)
    right = [r.lang_pred == truth[r.doc_id] for r in found if r.held_out]
    assert np.mean(right) >= 0.97


def test_languages_of_odd_rows(bilingual):
    rows, docs = bilingual
    filters = language_id.train(docs(rows + [(1000, None, "xx"), (1001, "q", None), (None, "zz", "yy")]))
    assert sorted(filters.languages) == ["de", "en"]
    found = language_id.predict(docs(ODD + [(11, "1234 !!"), (12, "漢字")]), filters).collect()
    by = [(r.doc_id, r.lang_pred) for r in found]
    assert len(by) == len(ODD) + 2 and (11, "und") in by and (9, "und") in by and (7, "und") in by
    assert dict(by)[12] in ("de", "en")
    assert all(r.held_out is False for r in found if r.doc_id is None)


def test_held_out_rows_teach_nothing(docs):
    keys = [n for n in range(200) if held(n)][:8]
    assert language_id.train(docs([(n, GERMAN, "de") for n in keys])).languages == []
    nothing = language_id.predict(docs([(1, GERMAN)]), language_id.train(docs([])))
    assert nothing.first().lang_pred == "und"


def test_slices_give_the_same_ngrams(monkeypatch):
    letters = language_id._letter_table()
    text = "Été  à la--plage, 12 ünïcode " * 7
    whole = np.sort(np.concatenate(list(language_id.ngram_slices(text, letters))))
    for size in (1, 2, 3, 10):
        monkeypatch.setattr(language_id, "_SLICE", size)
        assert np.array_equal(np.sort(np.concatenate(list(language_id.ngram_slices(text, letters)))), whole)


def test_one_look_up_returns_all_languages():
    filters = language_id.LanguageFilters(["a", "b", "c"], [(5, 0), (5, 2), (9, 1)], 1 << 10)
    assert filters.hits(np.array([5], np.uint64)).tolist() == [1, 0, 1]
    many = language_id.LanguageFilters([f"l{n}" for n in range(70)], [(5, 0), (5, 69)], 1 << 10)
    assert np.flatnonzero(many.hits(np.array([5], np.uint64))).tolist() == [0, 69]


def test_toxicity_generalises(docs, spark):
    rng = np.random.default_rng(3)
    mild = [f"w{n}" for n in range(300)]
    rows, marks = [], []
    for n in range(600):
        bad = n % 3 == 0
        words = list(rng.choice(mild, 30)) + (["nasty", "words"] if bad else ["fine"])
        rows.append((n, " ".join(rng.permutation(words))))
        marks.append((n, 1, int(bad)))
    labels = spark.createDataFrame(marks + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(rows + ODD[:2]), labels)
    found = toxicity.score(docs(rows + ODD), model).collect()
    assert len(found) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    truth = {n: t for n, _, t in marks}
    out = [r for r in found if r.held_out and r.doc_id in truth and r.doc_id > 10]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) >= 0.95
    assert len(model[0]) < 3000


def test_toxicity_without_labels(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs([(1, "a b")]), labels)
    assert toxicity.score(docs([(1, "a b"), (2, None)]), model).collect()[0].score == 0.5


def test_ftrl_step_equals_the_formula():
    settings = toxicity.FtrlSettings(bits=3, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    model = toxicity.Ftrl(settings)
    z, n = np.zeros(9), np.zeros(9)
    for at, label in [([1, 8], 1), ([1, 2, 8], 0), ([2, 8], 1)]:
        w = {i: 0.0 if i < 8 and abs(z[i]) <= 0.1 else -(z[i] - np.sign(z[i]) * (0.1 if i < 8 else 0)) / ((1 + n[i] ** 0.5) / 0.5 + 0.2) for i in at}
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in at:
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5
            z[i] += g - s * w[i]
            n[i] += g * g
        model.learn(np.array(at), label)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)
