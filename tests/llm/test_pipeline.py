"""Every stage and the whole pipeline against the same rules written out plainly."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline as pipeline
from tests.llm.test_line_dedup import words
from tests.llm.test_near_duplicates import grams, groups
from tests.llm.test_packing import plain

SCHEMA = "doc_id long, text string, lang string, source string, lines string"
CAPACITIES = (512, 1024, 2048, 4096, 8192)


def known_language(rows):
    """Texts with a word of one of the two vocabularies, which is all that these tables hold."""
    return [r for r in rows if any(w.strip("0123456789é") in ("the", "le", "this") for w in (r[1] or "").split())]


def without_lines(rows):
    """By comparison of every line with all earlier ones."""
    order = sorted((r[0], i) for i, r in enumerate(rows) if r[0] is not None)
    seen, out = [], {}
    for _, i in order:
        kept = []
        for line in rows[i][1].split("\n"):
            w = words(line)
            again = w and any(len(w & v) >= 0.9 * len(w | v) for v in seen)
            if w:
                seen.append(w)
            if not again:
                kept.append(line)
        out[i] = kept
    found = []
    for i, r in enumerate(rows):
        if i not in out or len(out[i]) == len(r[1].split("\n")):
            found.append(r)
        elif any(x.split() for x in out[i]):
            found.append((r[0], "\n".join(out[i]), *r[2:]))
    return found


def without_near(rows):
    """By the Jaccard similarity of all pairs."""
    keyed = [(r[0], i) for i, r in enumerate(rows) if r[0] is not None and grams(r[1])]
    sets = {k: grams(rows[k[1]][1]) for k in keyed}
    near = [(a, b) for a in keyed for b in keyed if a < b and len(sets[a] & sets[b]) >= 0.45 * len(sets[a] | sets[b])]
    first = groups(near, keyed)
    return [r for i, r in enumerate(rows) if first.get((r[0], i), (r[0], i)) == (r[0], i)]


def mixed(rows):
    """(row, epoch) in training order: weights go from the supplies' shares to their powers of 0.7, both linear in time."""
    supply, by = defaultdict(int), defaultdict(list)
    for r in rows:
        supply[r[3]] += len(r[1].split())
        by[r[3]].append(r)
    w0, w1 = ({s: n**e / sum(m**e for m in supply.values()) for s, n in supply.items()} for e in (1, 0.7))
    budget = max(n / ((w0[s] + w1[s]) / 2) for s, n in supply.items())
    found = []
    for s, held in by.items():
        held.sort(key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), -1 if r[0] is None else r[0], len(r[1].split())))
        before = 0
        for r in held:
            n = len(r[1].split())
            middle, epoch = before + n / 2, 0
            before += n
            while middle + epoch * supply[s] <= budget * (w0[s] + w1[s]) / 2 * (1 + 1e-12):
                c = (middle + epoch * supply[s]) / budget
                lo, hi = 0.0, 1.0
                for _ in range(100):  # the time at which the source's demand reaches that
                    t = (lo + hi) / 2
                    lo, hi = (t, hi) if w0[s] * t + (w1[s] - w0[s]) * t * t / 2 < c else (lo, t)
                found.append((round(t, 9), -1 if r[0] is None else r[0], epoch, r))
                epoch += 1
    return [(r, e) for _, _, e, r in sorted(found, key=lambda x: x[:3])]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(9)
    vocabulary = {"en": [f"the{i}" for i in range(400)], "fr": [f"le{i}é" for i in range(400)]}
    rows = []
    for i in range(80):
        lang = "en" if i % 2 else "fr"
        lines = [" ".join(rng.choice(vocabulary[lang], 12)) for _ in range(6)]
        if i % 10 == 0:
            lines.append("this very line stands in many documents")
        rows.append((i, "\n".join(lines), lang, f"s{i % 3}", "x"))
    copy, whole = rows[5][1].split(), rows[3][1]
    rows += [(200, whole, "en", "s0", "x"), (201, " ".join(copy[:40] + ["changed"] + copy[40:]), "en", "s1", "x"), (202, None, "en", "s1", "x"), (203, "!! 12", "en", "s1", "x")]
    rows += [(None, "the1 the2 the3 the4 the5", "en", "s2", "x"), (11, "the9 the8 the7 the6", "en", "s1", None), (204, " ".join(f"the{i}" for i in rng.integers(0, 400, 9000)), "en", "s0", "x")]
    return rows


def test_stages_and_run_against_plain_rules(spark, tmp_path, table):
    docs = spark.createDataFrame(table, SCHEMA)
    docs.write.parquet(f"{tmp_path}/sf/documents.parquet")
    kept = []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, "")
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "lines"]
        kept.append([tuple(r) for r in docs.collect()])
    alike = lambda a, b: sorted(a, key=str) == sorted(b, key=str)
    assert alike(kept[0], known_language(table))
    lined = without_lines(known_language(table))
    assert alike(kept[1], lined) and len(lined) < len(kept[0])
    near = without_near(lined)
    assert alike(kept[2], near) and len(near) < len(lined)
    order = mixed(near)
    assert alike(kept[3], [r for r, _ in order]) and len(order) > len(near)
    check_packing(docs.collect(), order)
    again = pipeline.run(spark, f"{tmp_path}/sf").collect()
    check_packing(again, order)


def check_packing(packed, order):
    first = sorted((r for r in packed if r.piece == 0), key=lambda r: r.place)
    assert [(r.doc_id, r.epoch) for r in first] == [(r[0], e) for r, e in order]
    place = {r.place: i for i, r in enumerate(first)}
    got = sorted(packed, key=lambda r: (-r.n_tokens, r.place, r.piece))
    pieces = []
    for i, (r, _) in enumerate(order):
        n = len(r[1].split())
        pieces += [(-min(8192, n - at), i, at // 8192) for at in range(0, n, 8192)]
    pieces.sort()
    assert [(-r.n_tokens, place[r.place], r.piece) for r in got] == pieces
    bins, offsets, sizes = plain([-n for n, *_ in pieces], CAPACITIES)  # all of them are one shard
    name = {}
    for r, b, at in zip(got, bins, offsets):
        assert name.setdefault(b, r.bin_id) == r.bin_id and (r.offset, r.capacity) == (at, sizes[b])
    assert len(set(name.values())) == len(name)
    starts = [min(r.place for r in packed if r.bin_id == b) for b in sorted(name.values())]
    assert starts == sorted(starts)


def test_stages_on_an_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        got = stage(spark, none, "")
        assert got.collect() == [], name
        assert name == "best_fit_packing" or got.columns == none.columns


def test_stages_on_odd_rows(spark):
    long = " ".join(f"the{i % 300}" for i in range(20000))
    rows = [(None, None, None, None, None), (None, "the1 the2 the3", None, None, None), (1, "", "en", "a", "x"), (1, "the1 the2 le3é", "en", "a", "x"), (1, "the1 the2 le3é", "en", "a", "x"), (2, long, "en", "a", "x"), (3, "le1é le2é", "fr", "b", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in pipeline.STAGES:
        got = stage(spark, docs, "").collect()
        assert {r.doc_id for r in got} >= ({2, 3} if name != "line_dedup" else {2}), name
        assert any(r.doc_id is None for r in got), name
