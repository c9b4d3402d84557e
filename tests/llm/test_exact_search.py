import math
from collections import Counter

import numpy as np

from docketlake.llm.exact_search import top_k_search


def brute(docs, queries, k):
    bag = [(i, Counter(w.strip(".,;:!?\"'()[]{}%*#$&") for w in (t or "").lower().split())) for i, t in docs]
    for _, c in bag:
        c.pop("", None)
    n, average = len(bag), sum(sum(c.values()) for _, c in bag) / len(bag)
    df = Counter(w for _, c in bag for w in c)
    found = {}
    for q, text in queries:
        scores = []
        for i, c in bag:
            total = 0
            for w in (text or "").lower().split():
                if w in c:
                    idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    total += math.floor(idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / average)) * 1e6 + 0.5)
            if total and i is not None:
                scores.append((-total, i))
        found[q] = [(i, -s / 1e6) for s, i in sorted(scores)[:k]]
    return found


def test_every_query_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 40)))) for i in range(200)]
    docs += [(3, docs[3][1]), (900, docs[5][1]), (901, None), (902, ""), (None, "w1 w2 w3"), (903, "W1, (w2)! w3. " * 4000)]
    queries = [(i, " ".join(rng.choice(words, 6))) for i in range(30)] + [(50, None), (51, ""), (52, "unknown"), (None, "w1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "2 as rank").repartition(3)
    q = spark.createDataFrame(queries, "doc_id long, text string")
    for block in (1_000_000, 20):
        got = {}
        for r in top_k_search(d, q, 7, block_terms=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, r.score))
        want = {k: v for k, v in brute(docs, queries[:-1], 7).items() if v}
        assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert top_k_search(none, some).collect() == [] and top_k_search(some, none).collect() == []
