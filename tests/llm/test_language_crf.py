import numpy as np
import pyarrow as pa
import pytest

from docketlake.llm import language_crf as crf

SYLLABLES = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ber", "ei"], "cc": ["ción", "lla", "ez", "ño"]}


def make(lang, n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    return crf.train([(lang, make(lang, 60, i)) for lang in SYLLABLES for i in range(30)])


def test_posteriors_match_the_plain_recurrence():
    rng = np.random.default_rng(1)
    scores, move = rng.normal(size=(700, 3)).astype("f4"), rng.normal(size=(3, 3)).astype("f4")
    bounds = np.array([0, 1, 1, 34, 180, 700])
    got = crf.posteriors(scores, bounds, move)
    a = np.exp(move.astype(float))
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        e, state, ahead, behind = np.exp(scores[lo:hi].astype(float)), np.ones(3) / 3, [], [np.ones(3)]
        for x in e:
            state = (state @ a) * x
            state /= state.sum()
            ahead.append(state)
        for x in e[:0:-1]:
            back = a @ (x * behind[-1])
            behind.append(back / back.sum())
        if hi > lo:
            want = np.array(ahead) * np.array(behind[::-1])
            assert np.abs(want / want.sum(1, keepdims=True) - got[lo:hi]).max() < 1e-5


def test_held_out_words_of_code_switched_text(model):
    right = total = 0
    for seed in range(100, 120):
        parts = [(lang, make(lang, 12, seed * 7 + i)) for i, lang in enumerate(["aa", "cc", "bb", "aa"])]
        truth = [lang for lang, text in parts for _ in text.split()]
        words, codes, offsets = crf.split_words(pa.array([" ".join(t for _, t in parts)]))
        tags = crf.posteriors(model.scores(words)[codes], offsets, model.move).argmax(1)
        right += sum(model.langs[t] == y for t, y in zip(tags, truth))
        total += len(truth)
    assert right / total > 0.95


def test_documents(spark, model):
    rows = [(1, make("aa", 50, 900), "x"), (2, make("bb", 10, 901) + "\n" + make("cc", 30, 902), "x"), (3, None, "x"), (4, "", "x"), (5, "12 !! 99", None), (None, make("aa", 5, 903), "x"), (1, make("aa", 50, 900), "x"), (6, make("bb", 30000, 904), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep string")
    got = crf.label_languages(docs, model=model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8
    assert (by[1].lang, by[1].keep, by[1].n_words) == ("aa", True, 50)
    assert [s.lang for s in by[2].segments] == ["bb", "cc"] and by[2].lang == "cc" and by[2].n_switches == 1
    assert sum(s.words for s in by[6].segments) == by[6].n_words == 30000 and by[6].lang == "bb"
    for key in (3, 4, 5):
        assert (by[key].lang, by[key].confidence, by[key].keep, by[key].segments) == (None, 0.0, False, [])
    assert by[None].lang == "aa"
    only = crf.label_languages(docs, languages=("bb",), model=model).where("keep").collect()
    assert [r.doc_id for r in only] == [6]


def test_empty_table_and_no_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert crf.label_languages(docs).collect() == []
    docs = spark.createDataFrame([(1, "ka to mi", None)], "doc_id long, text string, lang string")
    assert crf.label_languages(docs).first().lang == "und"
