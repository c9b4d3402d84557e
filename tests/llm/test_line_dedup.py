import numpy as np

from docketlake.llm.line_dedup import dedup_lines, repeated_lines


def words(line):
    return {w for w in (x.strip(".,;:!?\"'()[]{}%*#$&") for x in line.lower().split()) if w}


def brute(docs, threshold, least):
    lines = sorted((i, k, words(x)) for i, t in docs if i is not None and t for k, x in enumerate(t.split("\n")) if len(words(x)) >= least)
    found = {}
    for at, (i, k, w) in enumerate(lines):
        for a, b, v in lines[:at]:
            if len(w & v) / len(w | v) >= threshold:
                same = next(((x, y) for x, y, z in lines[:at] if z == w), None)
                found[i, k] = (*same, 1.0) if same else (a, b, len(w & v) / len(w | v))
                break
    return found


def test_exact_against_brute_force(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, 4000), 900)]
    pool = [" ".join(rng.choice(vocabulary, int(rng.integers(1, 30)))) for _ in range(150)]
    docs = []
    for i in range(120):
        lines = []
        for _ in range(int(rng.integers(1, 8))):
            line = str(rng.choice(pool)).split()
            for _ in range(int(rng.integers(0, 3))):
                line[int(rng.integers(len(line)))] = str(rng.choice(vocabulary))
            lines.append(" ".join(line))
        docs.append((i, "\n".join(lines)))
    for threshold in (0.9, 0.7):
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        got = {(r.doc_id, r.line): (r.kept_doc_id, r.kept_line, r.jaccard) for r in repeated_lines(frame, threshold).collect()}
        want = brute(docs, threshold, 1)
        assert set(got) == set(want) and len(want) > 50
        assert all(abs(got[k][2] - want[k][2]) < 1e-9 and got[k][:2] == want[k][:2] for k in want)


def test_hot_tokens_in_blocks(spark, monkeypatch):
    """Lines that share their rarest word, more of them than a block holds, give the same pairs."""
    from docketlake.llm import line_dedup

    rng = np.random.default_rng(3)
    common = [f"c{i}" for i in range(12)]
    docs = [(i, " ".join(["mark", *rng.choice(common, 10), f"x{int(rng.integers(3))}"])) for i in range(250)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "BLOCK", 20)
    got = {(r.doc_id, r.line): (r.kept_doc_id, r.kept_line) for r in repeated_lines(frame, 0.8).collect()}
    want = brute(docs, 0.8, 1)
    assert len(want) > 50 and got == {k: v[:2] for k, v in want.items()}


def test_rows_that_share_a_key(spark):
    rows = [(1, "x common line here"), (5, "x common line here\nunique words of the first"), (5, "totally different words now\nunique words of the first"), (None, "x common line here"), (5, "totally different words now\nunique words of the first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.text for r in dedup_lines(docs, drop_emptied=True).collect()]
    lines = [x for t in got for x in t.split("\n")]
    assert lines.count("x common line here") == 2  # the first, and that of the null key
    assert "totally different words now" in lines
    one = {t for t in got if "unique" in t or "totally" in t}
    assert one <= {"unique words of the first", "totally different words now", rows[2][1]} and sum("unique" in t for t in one) == 1


def test_odd_rows_and_all_columns(spark):
    long = " ".join(f"t{i}" for i in range(20000))
    rows = [
        (1, "One two three!\n\nkept line of words", "p", "x"),
        (2, "one, TWO three\nof it\nof it\n" + long, "p", "x"),
        (3, None, "p", "x"),
        (4, "", None, "x"),
        (None, "One two three!", "p", "x"),
        (5, long + " more\nlast", "p", "x"),
        (6, "new words stand here", "p", "x"),
        (6, "new words stand here", "p", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string, lines string")
    out = dedup_lines(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = [(1, rows[0][1]), (2, "of it\n" + long), (3, None), (4, ""), (None, "One two three!"), (5, "last"), (6, rows[6][1]), (6, rows[6][1])]
    assert got == sorted(want, key=str)
    kept = {r.doc_id for r in dedup_lines(docs, drop_emptied=True).collect()}
    assert kept == {1, 2, 3, 4, 5, 6, None}
    none = spark.createDataFrame([], docs.schema)
    assert dedup_lines(none).collect() == []
