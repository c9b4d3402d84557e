"""MinHash near-duplicates by a chosen-path set similarity join.

A document is the set of its word 3-grams, embedded as ``COORDINATES`` minwise values. In each of several independent
trees, every node picks coordinates at random and sends each document to the child named by the coordinate and the
document's value there. At a root 1/threshold coordinates are expected; deeper nodes pick ``growth`` times as many, so that the expected number of
nodes that two documents at the threshold share grows from level to level: recall doesn't fall with depth. Nodes small
enough are compared exhaustively; a larger one first compares all its documents with one of them, the pivot, which leaves
the node, and then branches. A duplicate of the pivot leaves with it only if no other member can be a duplicate of that
document: differing values are a metric, so the numbers that differ from the pivot tell. All others go on branching.
Nodes that are still large at the greatest depth are compared exhaustively too, block by block of their documents, so
none is dropped.

Nodes hold a code of 2 bits of each value. Pairs that its estimate puts three standard errors or more above the
threshold are links, those as far below aren't; pairs between are decided by the Jaccard similarity of their 3-grams
themselves. Of pairs that are surely similar a node gives a spanning forest, so a group of copies costs as many edges as
it has documents.

Documents with the very same set are one point of the join, and groups come out as connected components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import Scratch, block_pairs, distinct, distinct_rows, hash_words, keep_rows, mix, row_of, segment_ids, slices, texts_of
from docketlake.llm.components import connected_components
from docketlake.llm.exact_search import split_terms

COORDINATES = 128
SHINGLE = 3
LAST_BLOCK = 5000
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's word 3-grams (a shorter text has one, of all its words) and where each text's begin."""
    terms, codes, offsets = split_terms(texts)
    word = hash_words(terms)[codes]
    size = np.diff(offsets)
    out = np.where(size >= SHINGLE, size - SHINGLE + 1, np.minimum(size, 1))
    starts = np.concatenate([[0], np.cumsum(out)])
    at = np.repeat(offsets[:-1] - starts[:-1], out) + np.arange(starts[-1])
    last = np.repeat(offsets[1:], out)
    key = np.zeros(len(at), np.uint64)
    padded = np.append(word, np.zeros(SHINGLE, np.uint64))
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.where(at + j < last, padded[at + j], np.uint64(j + 1)))
    return key, starts


def sketch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Minwise values (16 bits of each) and a 128-bit fingerprint of the set; a text without a word has fingerprint 0."""
    key, starts = shingles(texts)
    n = len(starts) - 1
    full = np.flatnonzero(np.diff(starts))
    values, prints = np.zeros((n, COORDINATES), np.uint16), np.zeros((n, 2), np.uint64)
    if not len(full):
        return values, prints
    begin = starts[:-1][full]
    with np.errstate(over="ignore"):
        for j in range(COORDINATES):
            least = np.minimum.reduceat(((key * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32), begin)
            values[full, j] = (least ^ (least >> np.uint32(16))).astype(np.uint16)
        doc = segment_ids(starts)
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key = np.where(first, key, np.uint64(0))
        prints[full, 0] = np.add.reduceat(np.where(first, mix(key), np.uint64(0)), begin) | np.uint64(1)
        prints[full, 1] = np.add.reduceat(np.where(first, mix(key ^ np.uint64(0xA5A5A5A5A5A5A5A5)), np.uint64(0)), begin)
    return values, prints


def children(nodes: np.ndarray, values: np.ndarray, threshold: float, growth: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """For points (a node and minwise values each), the child nodes they go on to: numbers of points, child names.

    Two points at the threshold share ``growth`` children of a node that they share, as expected.
    """
    kinds, which = np.unique(nodes, return_inverse=True)
    draw = mix(kinds[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(COORDINATES, dtype=np.uint64)[None, :])
    chosen = draw < np.uint64(int(2.0**64 * min(0.999, growth / (threshold * COORDINATES))))
    point, coordinate = np.nonzero(chosen[which])
    with np.errstate(over="ignore"):
        name = mix(draw[which[point], coordinate] ^ mix(values[point, coordinate].astype(np.uint64) + np.uint64(1)))
    return point, name


def roots(trees: int, threshold: float) -> np.ndarray:
    """Names of the trees' roots, of those that choose a coordinate at all."""
    found, i = [], 0
    while len(found) < trees:
        i += 1
        name = mix(np.array([i * 1_000_003], np.uint64))
        if len(children(name, np.zeros((1, COORDINATES), np.uint16), threshold)[0]):
            found.append(name[0])
    return np.array(found, np.uint64)


def _values(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def _binary(values: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def _codes(values: np.ndarray) -> np.ndarray:
    """The lowest 2 bits of each value, in 4 integers."""
    low = (values & np.uint16(3)).astype(np.uint64).reshape(-1, 4, 32)
    return (low << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(2, dtype=np.uint64)


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Coordinates in which codes agree."""
    x = a ^ b
    return COORDINATES - np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(1, dtype=np.int64)


NODES = "node long, side int, doc_id long, c0 long, c1 long, c2 long, c3 long"
STEP = "node long, u long, v long, sure boolean"


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least element of each element's component under the links i-j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _compare_runs(batches, least: int, surely: int, limit: int | None):
    """Runs of equal nodes (rows come sorted by node). A run of up to ``limit`` rows gives pairs (u, v), with node null: a
    forest of those that agree in ``surely`` coordinates, and those between its trees that agree in ``least``; a longer run
    gives its documents (node, u), as they come."""
    names = ("node", "side", "doc_id", "c0", "c1", "c2", "c3")
    held = {c: np.zeros(0, np.int64) for c in names}
    passing = None  # the node of a run known to be long

    def rows(node, u, v, sure=False):
        return pa.RecordBatch.from_arrays([node, pa.array(u), v, pa.array(np.full(len(u), sure))], ["node", "u", "v", "sure"])

    def pairs(doc, i, j, sure):
        return rows(pa.nulls(len(i), pa.int64()), np.minimum(doc[i], doc[j]), pa.array(np.maximum(doc[i], doc[j])), sure)

    def whole(x):
        """Pairs of complete runs; members of those that are long."""
        node = x["node"]
        if not len(node):
            return
        begin = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        size = np.diff(np.append(begin, len(node)))
        long = np.repeat(size > (limit or len(node)), size)
        if long.any():
            yield rows(pa.array(node[long]), x["doc_id"][long], pa.nulls(int(long.sum()), pa.int64()))
        node, side, doc = node[~long], x["side"][~long], x["doc_id"][~long]
        code = np.stack([x[c][~long].view(np.uint64) for c in names[3:]], 1)
        alive, k = np.arange(len(node)), 1
        label, open_ = np.arange(len(node)), [np.zeros((2, 0), np.int64)]
        while len(alive):
            alive = alive[alive + k < len(node)]
            alive = alive[node[alive] == node[alive + k]]
            apart = alive[(label[alive] != label[alive + k]) & ((side[alive] < 0) | (side[alive] != side[alive + k]))]
            for i in range(0, len(apart), 1 << 17):
                a = apart[i : i + (1 << 17)]
                agree = _agreeing(code[a], code[a + k])
                near = agree >= least
                a, agree = a[near], agree[near]
                sure = a[agree >= surely]
                if len(sure):
                    label = np.minimum(label, _forest(len(node), np.concatenate([sure, np.arange(len(node))]), np.concatenate([sure + k, label])))
                rest = a[agree < surely]
                open_.append(np.stack([rest, rest + k]))
            k += 1
        tied = np.flatnonzero(label != np.arange(len(node)))
        yield pairs(doc, tied, label[tied], True)
        i, j = np.concatenate(open_, 1)
        left = label[i] != label[j]
        yield pairs(doc, i[left], j[left], False)

    for batch in batches:
        held = {c: np.concatenate([held[c], batch.column(c).to_numpy(zero_copy_only=False)]) for c in names}
        node = held["node"]
        if passing is not None:
            n = int(np.searchsorted(node != passing, True))
            if n:
                yield rows(pa.array(node[:n]), held["doc_id"][:n], pa.nulls(n, pa.int64()))
                held = {c: v[n:] for c, v in held.items()}
                node = held["node"]
        if not len(node):
            continue
        passing = None
        last = int(np.flatnonzero(node == node[-1])[0])
        yield from whole({c: v[:last] for c, v in held.items()})
        held = {c: v[last:] for c, v in held.items()}
        if limit and len(held["node"]) > limit:
            passing = held["node"][0]
            n = len(held["node"])
            yield rows(pa.array(held["node"]), held["doc_id"], pa.nulls(n, pa.int64()))
            held = {c: v[:0] for c, v in held.items()}
    yield from whole(held)


PAIRS_STEP = 20_000


def _decided(batches, column: str, other: str, names: list[str]):
    """Batches of pairs of sketches with the number of values that agree."""
    for batch in batches:
        for i in range(0, batch.num_rows, PAIRS_STEP):
            part = batch.slice(i, PAIRS_STEP)
            agree = (_values(part.column(column)) == _values(part.column(other))).sum(1)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(agree.astype(np.int32))], [*names, "agree"])


def _similar(batches, threshold: float):
    """Pairs whose sets (sorted, each element once) reach the threshold."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            n, keys, size = part.num_rows, [], []
            for c in ("a", "b"):
                lists = part.column(c)
                count = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64)
                keys.append((np.repeat(np.arange(n, dtype=np.uint64), count) << np.uint64(32)) | flat)
                size.append(count)
            both = np.sort(np.concatenate(keys))
            shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=n)
            ok = shared >= threshold * np.maximum(1, size[0] + size[1] - shared) - 1e-9
            yield part.select(["u", "v"]).filter(pa.array(ok))


def _shingle_sets(batches):
    """The distinct 3-grams of each text, by 32 bits of their hashes."""
    for part in slices(batches):
        key, starts = shingles(part.column("text"))
        flat = distinct((segment_ids(starts).astype(np.uint64) << np.uint64(32)) | (key >> np.uint64(32)))
        offsets = np.searchsorted(flat, np.arange(part.num_rows + 1, dtype=np.uint64) << np.uint64(32))
        sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.uint32).view(np.int32)))
        yield pa.RecordBatch.from_arrays([part.column("point"), sets], ["point", "grams"])


def _groups(docs: DataFrame, row, threshold: float, trees: int, node_limit: int, max_depth: int, growth: float, broadcast_bytes: int) -> DataFrame:
    """near_duplicates() with the ``row`` of each document, as row_of() has it."""
    scratch = Scratch(docs.sparkSession)
    start = roots(trees, threshold)
    least = int(np.ceil(threshold * COORDINATES))
    low, high = max(threshold - 0.13, 0.05), min(threshold + 0.16, 0.95)  # about three standard errors
    code_least, code_sure = (int(np.ceil(COORDINATES * (x + (1 - x) / 4))) for x in (low, high))
    full_least, full_sure = (int(np.ceil(COORDINATES * x)) for x in (low, high))

    def embed(batches):
        for part in slices(batches):
            values, prints = sketch(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), *(pa.array(prints[:, i].view(np.int64)) for i in (0, 1)), _binary(values)], ["doc_id", "row", "p0", "p1", "sketch"])

    texts = texts_of(docs, row.alias("row")).where("doc_id is not null")
    points = scratch.save(texts.mapInArrow(embed, "doc_id long, row long, p0 long, p1 long, sketch binary").where("p0 <> 0"), "points")
    # a set is one point, in order of the first document that has it: the least point of a component is its earliest document
    sets = points.groupBy("p0", "p1").agg(F.min(F.struct("doc_id", "row")).alias("k"), F.count("*").alias("n"), F.any_value("sketch").alias("sketch"))
    sets = sets.select("p0", "p1", "k.doc_id", "k.row", "n", "sketch").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "row", "p0")
    sets = scratch.save(sets.withColumn("point", F.monotonically_increasing_id()), "sets")
    sketches = sets.select(F.col("point").alias("doc_id"), "sketch")
    scratch.release()

    def first_level(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                values = _values(part.column("sketch"))
                point, name = children(np.tile(start, part.num_rows), np.repeat(values, len(start), 0), threshold)
                yield _members(part.column("doc_id"), point // len(start), name, _codes(values))

    pool = sketches
    members, edges, doubtful = sketches.mapInArrow(first_level, NODES), [], []
    for depth in range(1, max_depth + 1):
        if depth == max_depth:  # no further branching: what is still large is compared whole, in blocks
            sizes = members.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > LAST_BLOCK)
            sizes = scratch.save(sizes, "last")
            if not sizes.isEmpty():
                blocks = block_pairs(members.drop("side"), sizes, "node", ["doc_id"], LAST_BLOCK).drop("node").withColumnRenamed("run", "node")
                members = members.join(sizes.select(F.col("node").alias("s_node")), F.col("node") == F.col("s_node"), "left_anti").unionByName(blocks)
        limit = node_limit if depth < max_depth else None
        ordered = members.repartition("node").sortWithinPartitions("node")
        step = scratch.save(ordered.mapInArrow(lambda batches, limit=limit: _compare_runs(batches, code_least, code_sure, limit), STEP), f"step{depth}")
        scratch.release()
        doubtful.append(step.where("node is null and not sure").select("u", "v"))
        edges.append(step.where("node is null and sure").select("u", "v"))
        large = step.where("node is not null").select("node", F.col("u").alias("doc_id"))
        if large.isEmpty():
            break
        # only documents of large nodes are asked for from here on, so fewer move at every level
        pool = scratch.save(pool.join(large.select("doc_id").distinct(), "doc_id", "left_semi"), f"pool{depth}")
        turn = F.xxhash64("doc_id", "node")
        pivots = large.groupBy("node").agg(F.min_by("doc_id", F.struct(turn, "doc_id")).alias("doc_id"))
        pivots = pivots.join(pool, "doc_id").select(F.col("node").alias("p_node"), F.col("doc_id").alias("pivot"), F.col("sketch").alias("p_sketch"))
        pivots = scratch.save(pivots, f"pivots{depth}")
        small = pivots.count() * (2 * COORDINATES + 48) <= broadcast_bytes
        star = large.join(pool, "doc_id").join(F.broadcast(pivots) if small else pivots, F.col("node") == F.col("p_node")).select("node", "doc_id", "sketch", "pivot", "p_sketch")
        stars = scratch.save(star.mapInArrow(lambda batches: _decided(batches, "sketch", "p_sketch", ["node", "doc_id", "pivot"]), "node long, doc_id long, pivot long, agree int"), f"stars{depth}")
        scratch.release()
        near = stars.where("doc_id <> pivot").select(F.least("doc_id", "pivot").alias("u"), F.greatest("doc_id", "pivot").alias("v"), "agree")
        edges.append(near.where(f"agree >= {full_sure}").drop("agree"))
        doubtful.append(near.where(f"agree >= {full_least} and agree < {full_sure}").drop("agree"))
        nearest = stars.where(f"agree < {least}").groupBy("node").agg(F.max("agree").alias("nearest"))
        stay = stars.where("doc_id <> pivot").join(nearest, "node").where(f"agree < {least} or agree - nearest <= {COORDINATES - least}").select("node", "doc_id")

        def branch(batches):
            for batch in batches:
                for i in range(0, batch.num_rows, PAIRS_STEP):
                    part = batch.slice(i, PAIRS_STEP)
                    values = _values(part.column("sketch"))
                    point, name = children(part.column("node").to_numpy(zero_copy_only=False).view(np.uint64), values, threshold, growth)
                    yield _members(part.column("doc_id"), point, name, _codes(values))

        members = scratch.save(stay.join(pool, "doc_id").select("node", "doc_id", "sketch").mapInArrow(branch, NODES), f"branch{depth}")

    # of pairs between, the 16 bits of each value leave out what is surely apart and what is surely alike
    pairs = scratch.save(_union(doubtful).distinct(), "pairs")
    scratch.release()
    sides = pairs.join(sketches.toDF("u", "a"), "u").join(sketches.toDF("v", "b"), "v").select("u", "v", "a", "b")
    judged = scratch.save(sides.mapInArrow(lambda batches: _decided(batches, "a", "b", ["u", "v"]), "u long, v long, agree int").where(f"agree >= {full_least}"), "judged")
    edges.append(judged.where(f"agree >= {full_sure}").select("u", "v"))
    open_ = judged.where(f"agree < {full_sure}").select("u", "v")
    ends = open_.select(F.col("u").alias("point")).union(open_.select("v")).distinct()
    asked = scratch.save(sets.join(ends, "point", "left_semi").select(F.col("doc_id").alias("s_doc"), F.col("row").alias("s_row"), "point"), "asked")
    whole = texts.join(asked, (F.col("doc_id") == F.col("s_doc")) & (F.col("row") == F.col("s_row"))).select("point", "text")
    grams = scratch.save(whole.mapInArrow(_shingle_sets, "point long, grams array<int>").dropDuplicates(["point"]), "grams")
    sides = open_.join(grams.toDF("u", "a"), "u").join(grams.toDF("v", "b"), "v").select("u", "v", "a", "b")
    checked = scratch.save(sides.mapInArrow(lambda batches: _similar(batches, threshold), "u long, v long"), "checked")
    scratch.drop("grams", "pairs")
    scratch.release()

    groups = connected_components(_union([*edges, checked]))
    first = sets.select(F.col("point").alias("component"), F.col("doc_id").alias("kept_doc_id"), F.col("row").alias("kept_row"))
    kept = sets.select("p0", "p1", "point", "n").join(groups.withColumnRenamed("node", "point"), "point", "left").where("n > 1 or component is not null").select("p0", "p1", F.coalesce("component", "point").alias("component"))
    found = points.select("doc_id", "row", "p0", "p1").join(kept, ["p0", "p1"]).join(first, "component")
    return found.where((F.col("doc_id") != F.col("kept_doc_id")) | (F.col("row") != F.col("kept_row"))).select("doc_id", "row", "kept_doc_id").distinct()


def near_duplicates(
    docs: DataFrame, threshold: float = 0.45, trees: int = 8, node_limit: int = 200, max_depth: int = 8, growth: float = 1.3, broadcast_bytes: int = 32 << 20
) -> DataFrame:
    """Rows (doc_id, kept_doc_id) for every document that repeats an earlier one: the least doc_id of its group stays.

    Groups are the connected components of pairs with a Jaccard similarity of word 3-grams of ``threshold`` or more; pairs
    that their minwise values put 0.16 or more above it (three standard errors) are taken for such without a look at
    the texts. A pair at the threshold is found with a probability above 0.9 (``trees``, ``growth``), at any depth.
    ``node_limit`` divides small nodes from large ones; beyond ``max_depth`` nodes of any size are compared whole.

    A null, empty or wordless text, or a null key, has no duplicate. Rows that share a doc_id are told apart by their
    texts: a row of the group's own least doc_id may so name its own key. Rows that share both are one document. Other
    columns aren't read. An empty table gives no rows.
    """
    return _groups(docs, row_of(docs), threshold, trees, node_limit, max_depth, growth, broadcast_bytes).select("doc_id", "kept_doc_id").distinct()


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.45, trees: int = 8, node_limit: int = 200, max_depth: int = 8, growth: float = 1.3, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each group of near_duplicates() stays: that of the least doc_id.

    Of rows that share key and text one stays, a null key among them. Other null keys and texts without a word stay.
    Columns may bear any names. An empty table gives no rows.
    """
    row = row_of(docs)
    gone = _groups(docs, row, threshold, trees, node_limit, max_depth, growth, broadcast_bytes)
    return keep_rows(distinct_rows(docs, row), gone, "left_anti", row)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


def _members(doc_ids: pa.Array, point: np.ndarray, name: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(name.view(np.int64)), pa.array(np.full(len(name), -1, np.int32)), doc_ids.take(pa.array(point)), *(pa.array(codes[point, i].view(np.int64)) for i in range(4))], ["node", "side", "doc_id", "c0", "c1", "c2", "c3"]
    )
