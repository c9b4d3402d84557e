from collections import Counter

import numpy as np
import pytest

from docketlake.llm.curriculum import mix_documents, mix_sources


def schedule(spark, rows):
    return spark.createDataFrame(rows, "source string, t double, weight double")


def test_token_shares_follow_the_schedule(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 9))), "a" if i % 4 else "b") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = schedule(spark, [("a", 0.0, 3.0), ("b", 0.0, 1.0), ("a", 0.5, 1.0), ("b", 0.5, 1.0), ("a", 1.0, 1.0), ("b", 1.0, 3.0)])
    got = mix_sources(docs, plan).collect()
    assert {r.doc_id for r in got} == set(range(4000))
    total = sum(r.n_tokens for r in got)
    for lo in np.arange(0, 1, 0.125):
        here = [r for r in got if lo <= r.position < lo + 0.125]
        middle = lo + 0.0625
        want = 0.75 - 0.5 * middle  # of a, in either half of training
        share = sum(r.n_tokens for r in here if r.source == "a") / sum(r.n_tokens for r in here)
        assert share == pytest.approx(want, abs=0.02)
        assert sum(r.n_tokens for r in here) / total == pytest.approx(0.125, abs=0.01)
    epochs = Counter((r.doc_id, r.epoch) for r in got)
    assert max(epochs.values()) == 1 and max(r.epoch for r in got if r.source == "b") >= 1


def test_budget_leaves_documents_out(spark):
    docs = spark.createDataFrame([(i, "x y", "a") for i in range(100)], "doc_id long, text string, source string")
    plan = schedule(spark, [("a", 0.0, 1.0), ("a", 1.0, 1.0)])
    got = mix_sources(docs, plan, token_budget=50).collect()
    assert len(got) == 25 and sorted(r.position for r in got) == pytest.approx([(2 * i + 1) / 50 for i in range(25)])


def test_odd_rows_and_all_columns(spark):
    rows = [(1, "a b", None, "p"), (1, "a b", None, "p"), (2, None, "s", "p"), (3, "", "s", None), (None, "c d e", "s", "p"), (4, "only", None, "p"), (5, None, "void", "p"), (6, "w " * 30000, "s", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, position string")
    got = mix_sources(docs).collect()
    first = Counter(r.doc_id for r in got if r.epoch == 0)
    assert first == {1: 2, 2: 1, 3: 1, None: 1, 4: 1, 6: 1}  # the source without a token is left out
    full = mix_documents(docs)
    assert full.columns == docs.columns
    want = Counter((r.doc_id,) for r in got)
    assert Counter((r.doc_id,) for r in full.collect()) == want
    assert all(tuple(r) in {tuple(x) for x in rows} for r in full.collect())
    none = spark.createDataFrame([], docs.schema)
    assert mix_sources(none).collect() == [] and mix_documents(none).collect() == []


def test_rows_come_in_training_order(spark):
    docs = spark.createDataFrame([(i, "x " * (i % 7 + 1), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    position = [r.position for r in mix_sources(docs).collect()]
    assert position == sorted(position)
