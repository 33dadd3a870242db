"""Language identification and toxicity."""

import zlib

import numpy as np
import pytest

from turfgrid.llm import language, text, toxicity

SYLLABLES = {"aa": "tion er the and ing st".split(), "bb": "ciónñ ar os que la ez".split(), "cc": "ßig ung ein sch keit ö".split()}
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, held_out string, `_share` int"


def phrase(draw, kind, words):
    return " ".join("".join(draw.choice(SYLLABLES[kind], 3)) for _ in range(words))


@pytest.fixture(scope="module")
def corpus(spark):
    draw = np.random.default_rng(5)
    rows = []
    for i in range(240):
        kind = ("aa", "bb", "cc")[i % 3]
        rows.append((i, phrase(draw, kind, 30), kind, f"s{i % 4}", 0, "x", 1))
    odd = [None, "", " \n 123 !!", "ñ", phrase(draw, "bb", 60_000)]
    rows += [(1000 + i, t, None, None, None, None, None) for i, t in enumerate(odd)]
    rows += [rows[0], (None, rows[1][1], "bb", None, 0, None, None)]
    return spark.createDataFrame(rows, DOCS)


def test_language_of_held_out_documents(corpus):
    found = language.predict(corpus, language.train(corpus)).toPandas()
    assert len(found) == 247 and list(found.columns) == ["doc_id", "held_out", "lang_pred", "score"]
    known = found[found.doc_id < 1000]
    assert (known.held_out == [zlib.crc32(str(int(i)).encode()) % 4 == 2 for i in known.doc_id]).all()
    assert (known.lang_pred == [("aa", "bb", "cc")[int(i) % 3] for i in known.doc_id]).all()
    odd = found[found.doc_id >= 1000].set_index("doc_id")
    assert list(odd.lang_pred[[1000, 1001, 1002]]) == ["und"] * 3 and (odd.score[[1000, 1001, 1002]] == 0).all()
    assert odd.lang_pred[1004] == "bb" and found.score.between(0, 1).all()


def test_language_stage_keeps_what_it_knows(corpus):
    kept = language.identified(corpus, language.train(corpus))
    assert kept.columns == corpus.columns
    gone = {r.doc_id for r in corpus.select("doc_id").collect()} - {r.doc_id for r in kept.select("doc_id").collect()}
    assert {1000, 1001, 1002} <= gone <= {1000, 1001, 1002, 1003}


def test_language_without_rows(corpus):
    empty = corpus.limit(0)
    model = language.train(empty)
    assert language.predict(empty, model).count() == 0
    assert {r.lang_pred for r in language.predict(corpus, model).collect()} == {"und"}
    assert language.identified(corpus, model).count() == 244


def test_kernel_is_the_share_of_common_grams():
    settings = language.Settings(bits=18)
    texts = ["ab cab", "abba cab", "xyz"]
    row, sets = np.zeros(1 << 18, np.uint8), []
    for t in texts:
        language.presence(t, row, settings)
        sets.append(set(np.flatnonzero(row)))
    # by hand: blended n-grams of the letters with one blank between words
    count = len({t[i : i + n] for t in ["ab cab"] for n in range(1, 5) for i in range(len(t) - n + 1)})
    assert len(sets[0]) == count
    model = language.fit([np.array(sorted(s)) for s in sets], ["p", "p", "q"], settings)
    bits = np.array([[c in s for c in model.columns] for s in sets], np.float32)
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    assert np.allclose(model.scores(bits, np.array([len(s) for s in sets])), kernel @ model.coefficients, atol=1e-4)


@pytest.mark.parametrize("kind", ["line", "words"])
def test_pieces_do_not_change_grams_or_words(monkeypatch, kind):
    draw = np.random.default_rng(1)
    word = lambda: "".join(draw.choice(list("abcdefghijklm1.-"), draw.integers(1, 9)))
    t = "Ab cd. efg 12 hij\n" * 50 if kind == "line" else " ".join(word() + str(draw.choice(["", ",", " 7", "\n\n"])) for _ in range(400))
    whole = np.zeros(1 << 18, np.uint8)
    language.presence(t, whole, language.Settings())
    words, terms = text.hashed_words(t, text.spaced), toxicity.terms(t)
    monkeypatch.setattr(text.pieces, "__defaults__", (7,))
    cut = np.zeros(1 << 18, np.uint8)
    language.presence(t, cut, language.Settings())
    assert (whole == cut).all() and (words == text.hashed_words(t, text.spaced)).all() and (terms == toxicity.terms(t)).all()


def test_pairs_are_learned():
    draw, rows, labels = np.random.default_rng(3), [], []
    for i in range(2000):
        one, two = i % 2, i // 2 % 2
        rows.append(np.unique(np.concatenate([draw.integers(100, 3000, 60).astype(np.uint64), np.array([1] * one + [2] * two, np.uint64)])))
        labels.append(one * two)
    model = toxicity.fit(rows[:1500], np.array(labels[:1500]))
    right = [(model.margin(r) > 0) == bool(y) for r, y in zip(rows[1500:], labels[1500:], strict=True)]
    assert np.mean(right) > 0.97
    bare = toxicity.Model(model.terms, model.bias, model.linear, model.factors * 0)
    assert np.mean([(bare.margin(r) > 0) == bool(y) for r, y in zip(rows[1500:], labels[1500:], strict=True)]) < np.mean(right)


def test_pairs_with_a_term_that_is_neutral_alone():
    """Term 1 is as frequent in clean as in toxic rows; only beside term 2, or without it, does it matter."""
    cells = {(1, 2): 95, (2,): 55, (1,): 5, (): 45}
    rows, labels = [], []
    for found, toxic in cells.items():
        rows += [np.array([*found, 9], np.uint64)] * 400
        labels += [1] * (4 * toxic) + [0] * (400 - 4 * toxic)
    # a penalty above the noise of a batch, so that the additive pass has the neutral term at exactly zero
    model = toxicity.fit(rows, np.array(labels), toxicity.Settings(linear_penalty=0.03))
    margin = {found: model.margin(np.array([*found, 9], np.uint64)) for found in cells}
    assert margin[1, 2] > margin[(2,)] + 1 and margin[(1,)] < margin[()] - 1


def test_margin_is_the_sum_over_pairs():
    draw = np.random.default_rng(1)
    model = toxicity.Model(np.arange(5, dtype=np.uint64), 0.5, draw.normal(size=5), draw.normal(size=(5, 3)))
    pairs = sum(model.factors[i] @ model.factors[j] for i in (0, 2, 4) for j in (0, 2, 4) if i < j)
    assert np.isclose(model.margin(np.array([0, 2, 4, 9], np.uint64)), 0.5 + model.linear[[0, 2, 4]].sum() + pairs)


def test_toxic_documents(spark, corpus):
    draw = np.random.default_rng(8)
    rows = []
    for i in range(600):
        words = phrase(draw, "aa", 40).split()
        if i % 4 == 0:
            words[draw.integers(0, 40)] = draw.choice(["vilein", "vileung", "knaves"])
        rows.append((i, " ".join(words), None, None, 0, None, None))
    docs = spark.createDataFrame(rows, DOCS).unionByName(corpus.where("doc_id >= 1000"))
    marked = [(i, 0, int(i % 4 == 0), "y") for i in range(600)] + [(3, 0, None, "z"), (None, 0, 1, "z"), (0, 0, 0, "again"), (99999, 0, 1, "no text")]
    labels = spark.createDataFrame(marked, "doc_id bigint, quality int, toxic int, text string")
    found = toxicity.score(docs, toxicity.train(docs, labels)).toPandas().set_index("doc_id")
    assert len(found) == 605 and found.score.between(0, 1).all() and ((found.score >= 0.5) == (found.predicted == 1)).all()
    held = found[found.held_out & (found.index < 600)]
    assert len(held) > 60 and (held.predicted == [int(i % 4 == 0) for i in held.index]).mean() > 0.97
    none = toxicity.score(docs, toxicity.train(docs, labels.limit(0))).toPandas()
    assert len(none) == 605 and set(none.score) == {0.5}
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0
