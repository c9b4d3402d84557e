from collections import defaultdict

import numpy as np

from docketlake.llm.suffix_dedup import repeated_passages


def words(text):
    return [w for w in (x.strip(".,;:!?\"'()[]{}%*#$&") for x in (text or "").lower().split()) if w]


def brute(docs, n):
    places = defaultdict(set)
    for i, text in docs:
        w = words(text)
        for at in range(len(w) - n + 1):
            places[tuple(w[at : at + n])].add((i, at))
    found = set()
    for held in places.values():
        if len(held) > 1:
            for i, at in held:
                found.update((i, at + k, (i, at) == min(held)) for k in range(n))
    return found


def covered(rows):
    return {(r.doc_id, r.first_word + k, r.is_first) for r in rows for k in range(r.n_words)}


def test_exact_against_brute_force(spark):
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [list(rng.choice(vocabulary, int(rng.integers(8, 60)))) for _ in range(25)]
    docs = []
    for i in range(150):
        text = []
        for _ in range(int(rng.integers(1, 6))):
            text += list(rng.choice(vocabulary, int(rng.integers(0, 40))))
            p = passages[int(rng.integers(len(passages)))]
            lo = int(rng.integers(0, 5))
            text += p[lo : len(p) - int(rng.integers(0, 5))]
        docs.append((i, " ".join(text)))
    docs += [(200, docs[0][1]), (201, docs[0][1]), (300, "same " * 90), (301, "same " * 70 + "end"), (302, "a b " * 60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for n in (12, 20):
        rows = repeated_passages(frame, n).collect()
        want = brute(docs, n)
        assert covered(rows) == want and len(want) > 1000
        spans = sorted((r.doc_id, r.is_first, r.first_word, r.n_words) for r in rows)
        assert all(a[2] + a[3] < b[2] for a, b in zip(spans, spans[1:]) if a[:2] == b[:2])


def test_odd_rows(spark):
    rng = np.random.default_rng(13)
    passage = " ".join(f"p{int(x)}" for x in rng.integers(0, 500, 60))
    long = " ".join(f"q{int(x)}" for x in rng.integers(0, 9000, 40000))
    docs = [(1, "start of it " + passage), (2, passage.upper() + ". More!"), (3, None), (4, ""), (5, "few words"), (None, passage), (6, long + " " + passage), (2, passage.upper() + ". More!")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as place", "true as is_first")
    got = sorted(tuple(r) for r in repeated_passages(frame).collect())
    assert got == [(1, 3, 60, True), (2, 0, 60, False), (6, 40000, 60, False)]
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rows_that_share_a_key(spark):
    rng = np.random.default_rng(14)
    text = [f"p{int(x)}" for x in rng.integers(0, 500, 80)]
    rows = [(1, " ".join(text)), (1, " ".join(["a", "b", *text, "c", "d"])), (1, " ".join(text)), (2, "short")]
    got = sorted((r.first_word, r.n_words, r.is_first) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got in ([(0, 80, True), (2, 80, False)], [(0, 80, False), (2, 80, True)])


def test_a_passage_in_very_many_texts(spark):
    """Copies of one passage, in contexts that are alike and that differ, some of them within one text."""
    rng = np.random.default_rng(15)
    passage = [f"p{int(x)}" for x in rng.integers(0, 900, 70)]
    docs = []
    for i in range(3000):
        before = [f"u{int(x)}" for x in rng.integers(0, 10**6, 5)] if i % 3 == 0 else []
        docs.append((i, " ".join(before + passage + ([f"v{i}"] if i % 5 == 0 else []) + (passage if i % 500 == 0 else []))))
    rows = repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert covered(rows) == brute(docs, 50)
