"""Variable-capacity best-fit packing of documents into training sequences of several permitted lengths.

Documents are cut into pieces of at most the greatest capacity. Within a shard, pieces are placed in decreasing
length into the open bin that they leave least room in; where none fits, the bin size with the least cost opens; and
at the end every bin shrinks to the least permitted capacity that holds its contents. Only lengths are shuffled. Where documents
come in training order, a shard is a stretch of it.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.common import Scratch
from docketlake.llm.curriculum import TOKENS

CAPACITIES = (512, 1024, 2048, 4096, 8192)
RESULT = "bin_id string, capacity int, used int, doc_id long, piece int, first_token long, n_tokens int, offset int, place long, epoch int"


def bin_cost(capacity: int, greatest: int, overhead: float = 64.0, attention: float = 0.25) -> float:
    """What a sequence of this capacity costs to train on: its tokens, a fixed overhead, and a part that grows with its square."""
    return overhead + capacity + attention * capacity * capacity / greatest


def open_size(length: int, waiting: list[int], capacities: tuple[int, ...], cost=bin_cost) -> int:
    """The capacity to open for a piece of this length: that of least cost per token placed.

    What a bin would hold besides is foreseen from ``waiting``, the lengths still to come in ascending order: as long
    as one fits, the longest that fits is counted as placed.
    """
    best, found = None, capacities[-1]
    for capacity in capacities:
        if capacity < length:
            continue
        room, at, held = capacity - length, len(waiting), length
        while room and at:
            at = min(at, bisect_left(waiting, room + 1))
            if not at:
                break
            at -= 1
            room, held = room - waiting[at], held + waiting[at]
        rate = cost(capacity, capacities[-1]) / held
        if best is None or rate < best:
            best, found = rate, capacity
    return found


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, cost=bin_cost) -> tuple[list[int], list[int], list[int]]:
    """Best-fit of lengths given in decreasing order: each one's bin and offset, and the bins' final capacities."""
    capacities = tuple(sorted(capacities))
    left: list[tuple[int, int]] = []  # (room, bin), ascending
    used: list[int] = []
    bins, offsets = [], []
    waiting = sorted(lengths)
    for length in lengths:
        waiting.pop()
        at = bisect_left(left, (length, -1))
        if at < len(left):
            room, b = left.pop(at)
        else:
            room, b = open_size(length, waiting, capacities, cost), len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += length
        if room > length:
            insort(left, (room - length, b))
    return bins, offsets, [capacities[bisect_left(capacities, u)] for u in used]


def file_place(docs: DataFrame) -> Column:
    """The place of each row in the files that ``docs`` is read from: by number of the file, then row. Without files, the rows as they come."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return F.monotonically_increasing_id()
    name = F.col("_metadata.file_name")
    number = F.coalesce(F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))
    turn = F.coalesce(F.regexp_extract(name, r"-c(\d+)\.", 1).try_cast("long"), F.lit(0).cast("long"))
    return (number * 1000 + turn) * (1 << 36) + F.col("_metadata.row_index")


def _pack_shard(rows: pa.Table, name: str, capacities: tuple[int, ...]) -> pa.RecordBatch:
    get = {c: rows.column(c).to_numpy() for c in ("n_tokens", "place", "piece")}
    order = np.lexsort((get["piece"], get["place"], -get["n_tokens"].astype(np.int64)))
    bins, offsets, sizes = pack(get["n_tokens"][order].tolist(), capacities)
    bins, length = np.array(bins, np.int64), get["n_tokens"][order].astype(np.int64)
    used = np.bincount(bins, length).astype(np.int64)
    # bins are numbered by the first place that they hold
    first = np.full(len(sizes), np.iinfo(np.int64).max)
    np.minimum.at(first, bins, get["place"][order])
    number = np.empty(len(sizes), np.int64)
    number[np.argsort(first, kind="stable")] = np.arange(len(sizes))
    rows = rows.take(pa.array(order)).combine_chunks().to_batches()[0]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([f"{name}-{number[b]:05d}" for b in bins]), pa.array(np.array(sizes, np.int32)[bins]), pa.array(used[bins].astype(np.int32)),
            *(rows.column(c) for c in ("doc_id", "piece", "first_token", "n_tokens")), pa.array(np.array(offsets, np.int32)), rows.column("place"), rows.column("epoch"),
        ],
        [c.split()[0] for c in RESULT.split(", ")],
    )


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shard_pieces: int = 20_000, order: Column | None = None, most_tasks: int = 10_000) -> DataFrame:
    """Pieces of documents in bins: one row per piece, with its bin, the bin's capacity and fill, and where the piece lies in both.

    Lengths are whitespace-separated tokens of the whole text. A document longer than the greatest capacity becomes pieces
    of that size and a rest. Shards of about ``shard_pieces`` pieces are packed one by one; no bin crosses shards.

    With ``order`` (a long for each row of docs, all of them different) shards are stretches of that order and bear
    ascending names, as bins do within one: training goes on in order, but for the exchange of pieces within a shard.
    ``place`` is the order's value and ``epoch`` the number of earlier rows of the same key and text. Without it shards
    are formed by a hash, ``place`` numbers the rows as they are read and ``epoch`` is 0.

    A null, empty or blank text has no piece and no row. Null keys are packed like others. Repeated rows are packed each
    on its own, and so are rows that share a doc_id. Pieces of one length are placed in order of place and piece. Other
    columns aren't read. An empty table gives no rows.
    """
    capacities = tuple(sorted({int(c) for c in capacities}))
    greatest, scratch = capacities[-1], Scratch(docs.sparkSession)
    place, epoch = (F.monotonically_increasing_id() if order is None else order).alias("place"), F.lit(0).alias("epoch")
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(TOKENS).cast("long").alias("tokens"), place, *([] if order is None else [F.xxhash64("text").alias("print")])).where("tokens > 0")
    if order is not None:
        epoch = (F.row_number().over(Window.partitionBy("doc_id", "print").orderBy("place")) - 1).alias("epoch")
    sizes = sizes.select("doc_id", "tokens", "place", epoch)
    cut = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / greatest).cast("long"))))
    first = F.col("piece") * greatest
    cut = cut.select("doc_id", F.col("piece").cast("int").alias("piece"), first.alias("first_token"), F.least(F.lit(greatest), F.col("tokens") - first).cast("int").alias("n_tokens"), "place", "epoch")
    cut = scratch.save(cut, "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))
    turn = ["place", "piece"] if order is not None else [F.xxhash64("place", "piece"), "place", "piece"]

    def place_all(batches):
        held, count, number, task = [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, shard_pieces - count)
                batch = batch.slice(part.num_rows)
                held.append(part)
                count += part.num_rows
                if count == shard_pieces:
                    yield _pack_shard(pa.Table.from_batches(held), f"{task:05d}-{number:06d}", capacities)
                    held, count, number = [], 0, number + 1
        if count:
            yield _pack_shard(pa.Table.from_batches(held), f"{task:05d}-{number:06d}", capacities)

    return cut.repartitionByRange(min(shards, most_tasks), *turn).sortWithinPartitions(*turn).mapInArrow(place_all, RESULT)
