import numpy as np
import pyarrow as pa
import pytest

from docketlake.llm import common
from docketlake.llm.common import block_pairs, distinct_rows, hash_words, keep_rows, row_of, runs, slices, split_words, sum_segments


def test_hash_depends_on_the_word_alone():
    words = ["a", "ab", "", "ba", "é" * 300, "é" * 300 + "x", "z"]
    alone = [int(hash_words(pa.array([w]))[0]) for w in words]
    assert hash_words(pa.array(words)).tolist() == alone and len(set(alone)) == len(words)
    assert hash_words(pa.array([*words[::-1], ""]))[::-1][1:].tolist() == alone


def test_sum_segments_with_empty_ones():
    offsets = np.array([0, 0, 2, 2, 5, 5])
    assert sum_segments(np.arange(5), offsets).tolist() == [0, 1, 0, 9, 0]


def test_split_and_slices():
    texts = ["  B a\tb ", "", "a", "\n"]
    words, codes, offsets = split_words(pa.array(texts))
    assert [words[c].as_py() for c in codes] == ["b", "a", "b", "a"] and offsets.tolist() == [0, 3, 3, 4, 4]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * (5 << 20)] * 4 + [""])], ["text"])
    assert [p.num_rows for p in slices(iter([batch]))] == [1, 1, 1, 2]


@pytest.mark.parametrize("few", [0, 1000])
def test_rows_by_key_and_text(spark, monkeypatch, few):
    monkeypatch.setattr(common, "REPEATED", few)
    rows = [(1, "a", "p"), (2, "b", "p"), (2, "c", "p"), (2, "c", "p"), (None, "c", "p"), (None, "c", "p"), (None, None, "p"), (3, None, "p"), (3, "", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    row = row_of(docs)
    marks = {(r.doc_id, r.text): r.m for r in docs.select("doc_id", "text", row.alias("m")).collect()}
    assert marks[2, "b"] != marks[2, "c"]
    key = lambda found: sorted(((r.doc_id, r.text, r.row) for r in found), key=str)
    wanted = docs.where("doc_id = 2 and text = 'c'").select("doc_id", row.alias("row")).distinct()
    assert key(keep_rows(docs, wanted, "left_anti", row).collect()) == sorted((r for r in rows if r[:2] != (2, "c")), key=str)
    assert key(distinct_rows(docs, row).collect()) == sorted(set(rows), key=str)
    plain = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    assert distinct_rows(plain, row_of(plain)).count() == 2


def test_block_pairs_meet_once(spark):
    rows = spark.createDataFrame([(7, i) for i in range(50)], "key long, at long")
    sizes = spark.createDataFrame([(7, 50)], "key long, n long")
    met = {}
    for r in block_pairs(rows, sizes, "key", ["at"], 15).collect():
        met.setdefault(r.run, []).append((r.side, r.at))
    pairs = [frozenset((a, b)) for held in met.values() for i, (s, a) in enumerate(held) for t, b in held[i + 1 :] if s < 0 or s != t]
    assert len(pairs) == len(set(pairs)) == 50 * 49 // 2


def test_runs_over_batches():
    key = [1, 1, 2, 2, 2, 2, 2, 3, 4, 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i:j], pa.int64())], ["k"]) for i, j in ((0, 3), (3, 3), (3, 5), (5, 7), (7, 9), (9, 10))]
    got = [x["k"].tolist() for x in runs(iter(batches), ("k",), "k")]
    assert sum(got, []) == key and all(a[-1] != b[0] for a, b in zip(got, got[1:]))
