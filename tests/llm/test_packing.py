from collections import defaultdict

import numpy as np

import pytest
from docketlake.llm.packing import bin_cost, file_place, pack, pack_documents
from pyspark.sql import functions as F


def cheapest(length, rest, capacities):
    """The bin to open, by filling a bin of each size with the longest pieces to come that fit."""
    rates = []
    for c in sorted(x for x in capacities if x >= length):
        held = length
        for x in sorted(rest, reverse=True):
            held += x if held + x <= c else 0
        rates.append(((64 + c + 0.25 * c**2 / max(capacities)) / held, c))
    return min(rates)[1]


def plain(lengths, capacities):
    """The same rule without any index."""
    bins, out = [], []
    for i, length in enumerate(lengths):
        fits = [(room, b) for b, (room, _) in enumerate(bins) if room >= length]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append([cheapest(length, lengths[i + 1 :], capacities), 0])
        out.append((b, bins[b][1]))
        bins[b] = [bins[b][0] - length, bins[b][1] + length]
    return [b for b, _ in out], [o for _, o in out], [min(c for c in capacities if c >= used) for _, used in bins]


def test_pack_against_the_plain_rule():
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = sorted((int(x) for x in rng.integers(1, 65, rng.integers(0, 80))), reverse=True)
        assert pack(lengths, (16, 32, 64)) == plain(lengths, (16, 32, 64))


def test_several_capacities_cost_less_than_the_greatest_alone():
    rng = np.random.default_rng(6)
    lengths = sorted((int(x) for x in np.minimum(8192, rng.lognormal(6, 1.2, 3000) + 1)), reverse=True)
    cost = lambda sizes: sum(bin_cost(c, 8192) for c in sizes)
    assert cost(pack(lengths)[2]) < cost(pack(lengths, (8192,))[2])
    assert sum(pack(lengths)[2]) < 1.1 * sum(lengths)


def test_every_token_lies_in_one_place(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "w " * int(rng.integers(1, 90)), 1) for i in range(300)] + [(5, "w w", 1), (None, "a b", 1), (400, None, 1), (401, " \n ", 1), (402, "x " * 20000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, capacity int")
    got = pack_documents(docs, (16, 64, 32), shard_pieces=200).collect()
    assert sum(r.n_tokens for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
    bins, cover = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
        cover[r.doc_id].append((r.first_token, r.n_tokens))
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.n_tokens for r in held])
        assert [r.offset for r in held] == [0, *ends[:-1]] and held[0].used == ends[-1]
        assert held[0].capacity == min(c for c in (16, 32, 64) if c >= ends[-1])
    assert sorted(cover[402]) == [(64 * i, min(64, 20000 - 64 * i)) for i in range(313)]
    assert 400 not in cover and 401 not in cover and len(cover[5]) >= 2


@pytest.mark.parametrize("from_files", [True, False])
def test_shards_follow_the_order(spark, tmp_path, from_files):
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 40)) if i % 3 else None, "t " * int(rng.integers(1, 60))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    if from_files:
        docs.repartitionByRange(6, F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/d")
        docs = spark.read.parquet(f"{tmp_path}/d")
    got = pack_documents(docs, (32, 64), shard_pieces=90, order=file_place(docs)).collect()
    first = sorted((r for r in got if r.piece == 0), key=lambda r: r.place)
    seen, appearances = defaultdict(int), []
    for i, text in rows:
        appearances.append((i, seen[i, text]))
        seen[i, text] += 1
    if from_files:
        assert [(r.doc_id, r.epoch) for r in first] == appearances
    assert sorted(((r.doc_id, r.epoch) for r in first), key=str) == sorted(appearances, key=str)
    shards = defaultdict(list)
    for r in got:
        shards[r.bin_id.rsplit("-", 1)[0]].append((r.place, r.piece))
    held = [shards[s] for s in sorted(shards)]
    assert len(held) >= 500 // 90 and all(max(a) < min(b) for a, b in zip(held, held[1:]))
    starts = {}
    for r in got:
        starts[r.bin_id] = min(starts.get(r.bin_id, r.place), r.place)
    assert [starts[b] for b in sorted(starts)] == sorted(starts.values())


def test_one_key_in_a_third_of_the_rows_is_spread(spark):
    docs = spark.createDataFrame([(None if i % 3 else i, "one two three") for i in range(3000)], "doc_id long, text string")
    got = pack_documents(docs, (16, 64), shard_pieces=500).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.bin_id.rsplit("-", 1)[0]] += 1
    assert len(got) == 3000 and max(sizes.values()) <= 500 and len(sizes) >= 6


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
