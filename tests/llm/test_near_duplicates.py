from collections import Counter, defaultdict

import numpy as np

import pytest

from docketlake.llm import near_duplicates as module
from docketlake.llm.near_duplicates import COORDINATES, children, drop_near_duplicates, near_duplicates, roots


def grams(text):
    w = [x for x in (y.strip(".,;:!?\"'()[]{}%*#$&") for y in (text or "").lower().split()) if x]
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def groups(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in pairs:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(11)
    words = [f"word{i}" for i in range(3000)]
    texts = {i: list(rng.choice(words, int(rng.integers(30, 200)))) for i in range(300)}
    for i in range(300, 420):  # copies with some words changed
        text = list(texts[int(rng.integers(0, 300))])
        for at in rng.choice(len(text), max(1, len(text) // 20), replace=False):
            text[at] = rng.choice(words)
        texts[i] = text
    base = list(rng.choice(words, 120))
    for i in range(1000, 1400):  # a large group
        text = list(base)
        for at in rng.choice(len(text), int(rng.integers(0, 5)), replace=False):
            text[at] = rng.choice(words)
        texts[i] = text
    passage = list(rng.choice(words, 12))
    for i in range(0, 300, 2):
        texts[i] += passage  # a shared passage makes no duplicates
    docs = spark.createDataFrame([(i, " ".join(t), 0) for i, t in texts.items()], "doc_id long, text string, kept_doc_id int")
    got = {r.doc_id: r.kept_doc_id for r in near_duplicates(docs, node_limit=50).collect()}
    sets, index, shared = {i: grams(" ".join(t)) for i, t in texts.items()}, defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            index[g].append(i)
    for ids in index.values():
        shared.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    similar = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}
    want = groups([p for p, j in similar.items() if j >= 0.45], texts)
    near = [p for p, j in similar.items() if j >= 0.5]
    together = sum(got.get(a, a) == got.get(b, b) for a, b in near) / len(near)
    assert together >= 0.95
    loose = groups([p for p, j in similar.items() if j >= 0.3], texts)
    assert all(loose[a] == loose[b] for a, b in got.items())
    assert sum(got.get(i, i) != want[i] for i in texts) < 0.05 * len(texts)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 7919}" for i in range(30000))
    rows = [(5, "A b, c d."), (3, "a b c d"), (3, "a b c d"), (7, None), (8, None), (9, ""), (10, " ,, "), (None, "a b c d"), (11, long), (12, long + " end"), (13, "one"), (14, "one"), (15, "two words"), (16, "One!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "'x' as sketch")
    got = sorted((r.doc_id, r.kept_doc_id) for r in near_duplicates(docs).collect())
    assert got == [(5, 3), (12, 11), (14, 13), (16, 13)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_forest():
    from docketlake.llm.near_duplicates import _forest

    assert _forest(6, np.array([5, 3, 1]), np.array([3, 1, 2])).tolist() == [0, 1, 1, 1, 4, 1]
    assert _forest(3, np.array([], int), np.array([], int)).tolist() == [0, 1, 2]


def test_star_larger_than_a_node(spark):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(5000)]
    base = list(rng.choice(words, 200))
    texts = {0: base}
    for i in range(1, 601):  # each resembles the original (about 0.57), few resemble each other (about 0.36)
        text = list(base)
        for at in rng.choice(200, 20, replace=False):
            text[at] = rng.choice(words)
        texts[i] = text
    sets = {i: grams(" ".join(t)) for i, t in texts.items()}
    near = [i for i in range(1, 601) if len(sets[i] & sets[0]) / len(sets[i] | sets[0]) >= 0.5]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.kept_doc_id for r in near_duplicates(docs).collect()}
    assert len(near) > 500
    caught = sum(got.get(i) == 0 for i in near) / len(near)
    assert caught >= 0.97, caught


def test_rows_that_share_a_key(spark):
    x, y = "some words that several of these documents share word for word", "quite another text of which there is but one copy here"
    rows = [(2, x), (7, x), (7, y), (8, y), (8, y), (None, x), (None, x), (9, None), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as kept_row", "'s' as row")
    got = drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(2, x), (7, y), (None, x), (9, None), (9, "")], key=str)
    assert sorted((r.doc_id, r.kept_doc_id) for r in near_duplicates(docs).collect()) == [(7, 2), (8, 7)]
    assert drop_near_duplicates(spark.createDataFrame([], docs.schema)).collect() == []


@pytest.mark.parametrize("similarity", [0.45, 0.5])
def test_recall_of_pairs_at_the_threshold_in_deep_trees(similarity):
    rng, pairs = np.random.default_rng(21), 400
    a = rng.integers(0, 1 << 16, (pairs, COORDINATES)).astype(np.uint16)
    b = np.where(rng.random((pairs, COORDINATES)) < similarity, a, rng.integers(0, 1 << 16, (pairs, COORDINATES)).astype(np.uint16))
    start = roots(8, 0.45)
    pair, node = np.repeat(np.arange(pairs), len(start)), np.tile(start, pairs)
    for depth in range(1, 9):
        growth = 1.0 if depth == 1 else 1.3
        (i, left), (j, right) = (children(node, v[pair], 0.45, growth) for v in (a, b))
        shared = np.intersect1d(left, right)
        at = np.isin(left, shared)
        pair, node = pair[i[at]], left[at]
        assert len(np.unique(pair)) >= 0.9 * pairs, depth
        # as many nodes as are needed to follow every pair that is still met
        order = np.argsort(rng.random(len(pair)))
        keep = order[np.sort(np.unique(pair[order], return_index=True)[1])] if len(pair) > 200_000 else order
        pair, node = pair[keep], node[keep]


def test_nodes_large_at_the_last_level_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(module, "LAST_BLOCK", 25)
    rng = np.random.default_rng(6)
    words = [f"word{i}" for i in range(5000)]
    base, texts = list(rng.choice(words, 100)), {}
    for i in range(150):  # near one another by steps: far ends of the group don't resemble each other
        text = list(base) if i % 2 else list(texts[int(rng.integers(i))] if i else base)
        for at in rng.choice(100, 6, replace=False):
            text[at] = rng.choice(words)
        texts[i] = text
    sets = {i: grams(" ".join(t)) for i, t in texts.items()}
    want = groups([(a, b) for a in texts for b in range(a) if len(sets[a] & sets[b]) >= 0.45 * len(sets[a] | sets[b])], texts)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.kept_doc_id for r in near_duplicates(docs, node_limit=20, max_depth=2).collect()}
    assert sum(got.get(i, i) == want[i] for i in texts) >= 0.97 * len(texts)
