"""Repeated passages by prefix-free parsing and suffix arrays.

A rolling hash over ``WINDOW`` words triggers at about one word in ``MODULUS``; triggers cut every text into phrases
that overlap by the window, alike wherever the same words stand. A phrase that occurs once can't lie within a repeat,
so only occurrences of repeated phrases go on. Around each of these the parse (the words from the phrase on) and the
dictionary (the words back to the phrase before) are sorted: the parse's suffix array with its common prefix lengths, and the same of
the tails read backwards. A corpus suffix is a tail and a parse suffix, and the two arrays combined give the order
of the corpus suffixes that share the phrase and tell which of them share ``min_words`` words. Words are compared by 32 bits of
their hashes, all ``min_words`` of them one by one.

Work is spread by phrase: suffixes that share that many words share the first whole phrase among them, so the global order is
never needed at once. Occurrences with the very same words around them are one row of the arrays, however many there are:
they are counted together before anything is gathered by phrase, and what is found for one holds for all. Stretches with
no whole phrase (about 1 % of ordinary text, and texts of one word repeated) are compared by a fingerprint of all their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.common import Scratch, hash_words, mix, row_of, slices, texts_of
from docketlake.llm.exact_search import split_terms

WINDOW = 4
MODULUS = 8
CHUNK = 40_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(n, 1), base, np.uint64))])


class Parse:
    """Phrases of the texts of a slice. Positions count words over all texts of the slice."""

    def __init__(self, texts: pa.Array, min_words: int):
        self.least = min_words
        terms, codes, self.offsets = split_terms(texts)
        self.word = hash_words(terms)[codes]
        n = len(self.word)
        self.size = np.diff(self.offsets)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        end = self.offsets[1:][self.doc]
        self.up, self.down = _powers(n, BASE), _powers(n, INVERSE)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.word * self.up[:n])])
        at = np.arange(n)
        inside = at + WINDOW <= end
        grams = self.print(at[inside], WINDOW)
        self.triggers = at[inside][grams % np.uint64(MODULUS) == 0]
        # for each place: the first trigger at or after it, and the one after that, where they lie in its text
        first = np.searchsorted(self.triggers, at)
        padded = np.append(self.triggers, [n + min_words] * 2)
        t, after = padded[first], padded[first + 1]
        self.starts = at[at + min_words <= end]  # where a stretch of min_words words begins
        self.first = first[self.starts]
        self.whole = after[self.starts] + WINDOW <= self.starts + min_words
        self.t = t[self.starts]

    def print(self, start: np.ndarray, length) -> np.ndarray:
        """Fingerprints of stretches of words."""
        with np.errstate(over="ignore"):
            return mix((self.sums[start + length] - self.sums[start]) * self.down[start])

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the triggers whose phrase a stretch can hold whole, and the phrases' fingerprints."""
        doc = self.doc[self.triggers]
        here, after = self.triggers[:-1], self.triggers[1:]
        k = np.flatnonzero((doc[:-1] == doc[1:]) & (after + WINDOW - here <= self.least) & (self.size[doc[:-1]] >= self.least))
        return k, self.print(self.triggers[k], self.triggers[k + 1] + WINDOW - self.triggers[k])


def _keys(part: pa.RecordBatch, min_words: int) -> pa.RecordBatch:
    p = Parse(part.column("text"), min_words)
    k, prints = p.phrases()
    bare = p.starts[~p.whole]
    place = np.concatenate([p.triggers[k], bare])
    doc = p.doc[place]
    key = np.concatenate([prints, mix(p.print(bare, min_words) ^ np.uint64(BASE))])
    whole = np.concatenate([np.ones(len(k), bool), np.zeros(len(bare), bool)])
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), *(part.column(c).take(pa.array(doc)) for c in ("doc_id", "row")), pa.array((place - p.offsets[doc]).astype(np.int32)), pa.array(whole)], ["key", "doc_id", "row", "place", "whole"]
    )


CONTEXTS = "phrase long, doc_id long, row long, at int, low int, print long, words binary"


def _contexts(part: pa.RecordBatch, min_words: int) -> pa.RecordBatch:
    """For each repeated phrase, the words around it that stretches of nothing but repeated phrases reach: those from place ``low`` on; the phrase is at ``at``."""
    p = Parse(part.column("text"), min_words)
    k, prints = p.phrases()
    lists = part.column("places")
    held = np.diff(lists.offsets.to_numpy())
    marked = lists.values.slice(lists.offsets[0].as_py(), int(held.sum())).to_numpy(zero_copy_only=False) + np.repeat(p.offsets[:-1], held)
    once = np.ones(len(p.triggers) + 1, np.int64)
    once[np.searchsorted(p.triggers, marked)] = 0
    single = np.concatenate([[0], np.cumsum(once)])
    starts, first = p.starts[p.whole], p.first[p.whole]
    last = np.searchsorted(p.triggers, starts + min_words - WINDOW, "right") - 1  # the trigger at which the last whole phrase ends
    good = single[last] - single[first] == 0
    starts, first = starts[good], first[good]
    use, begin = np.unique(first, return_index=True)
    low = starts[begin]
    high = starts[np.append(begin[1:], len(starts)) - 1] if len(use) else low
    words = (p.word >> np.uint64(32)).astype(np.uint32)
    doc = p.doc[low]
    base = p.offsets[doc]
    data = [words[a : b + min_words].tobytes() for a, b in zip(low, high)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(prints[np.searchsorted(k, use)].view(np.int64)),
            *(part.column(c).take(pa.array(doc)) for c in ("doc_id", "row")),
            pa.array((p.triggers[use] - base).astype(np.int32)),
            pa.array((low - base).astype(np.int32)),
            pa.array(mix(p.print(low, high + min_words - low) ^ (high - low).astype(np.uint64)).view(np.int64)),
            pa.array(data, pa.binary()),
        ],
        ["phrase", "doc_id", "row", "at", "low", "print", "words"],
    )


def _classes(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix array of rows within groups: each row's rank, and the common prefix of each rank with the one before (-1 at a group's start)."""
    order = np.lexsort([*(rows[:, i] for i in range(rows.shape[1] - 1, -1, -1)), group])
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.arange(len(rows))
    same = rows[order[1:]] == rows[order[:-1]]
    common = np.where(same.all(1), rows.shape[1], np.argmin(same, 1)) if rows.shape[1] else np.zeros(len(same), np.int64)
    common = np.where(group[order[1:]] == group[order[:-1]], common, -1)
    return rank, np.concatenate([[-1], common])


RANGES = "context long, start int, stop int, leads boolean"


def _repeats(context: np.ndarray, group: np.ndarray, many: np.ndarray, tail: np.ndarray, words: list[bytes], min_words: int) -> pa.RecordBatch:
    """Of contexts in order of their first places: ranges, counted from the phrase, where the ``min_words`` words from a place on occur
    elsewhere too, from the parse's and the dictionary's suffix arrays; ``leads`` where they occur nowhere before the context's first place.

    ``many`` tells contexts that occur at several places themselves, ``tail`` their number of words before the phrase.
    """
    size = np.array([len(w) // 4 for w in words], np.int64)
    flat = np.frombuffer(b"".join(words), np.uint32)
    begin = np.cumsum(size) - size
    deepest = int(tail.max(initial=0))

    def spread(start: np.ndarray, count: np.ndarray, width: int, step: int) -> np.ndarray:
        k = np.arange(width)
        index = start[:, None] + step * k[None, :]
        return np.where(k[None, :] < count[:, None], flat[np.clip(index, 0, len(flat) - 1)], 0)

    parse, parse_lcp = _classes(spread(begin + tail, size - tail, min_words, 1), group)
    back, back_lcp = _classes(spread(begin + tail - 1, tail, deepest, -1), group)
    found = []
    for a in range(deepest + 1):
        row = np.flatnonzero((tail >= a) & (-a <= size - min_words - tail))
        left = np.cumsum(back_lcp < a)[back[row]]
        right = np.cumsum(parse_lcp < min_words - a)[parse[row]]
        _, index, inverse = np.unique(left * (len(group) + 1) + right, return_index=True, return_inverse=True)
        again = np.bincount(inverse, 1 + many[row])[inverse] > 1
        leads = np.zeros(len(row), bool)
        leads[index] = True
        found.append((row[again], np.full(int(again.sum()), -a), leads[again]))
    row, place, leads = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((place, leads, row))
    row, place, leads = row[order], place[order], leads[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (leads[1:] != leads[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(row)))
    return pa.RecordBatch.from_arrays([pa.array(context[row[first]]), pa.array(place[first].astype(np.int32)), pa.array((place[first] + n - 1 + min_words).astype(np.int32)), pa.array(leads[first])], ["context", "start", "stop", "leads"])


def _shard(batches, min_words: int):
    """Ranges of the contexts of whole phrases; rows come sorted by phrase and first place."""
    parts: list[pa.RecordBatch] = []
    count = 0

    def work(table: pa.Table) -> pa.RecordBatch:
        get = lambda c: table.column(c).to_numpy()
        return _repeats(get("context"), get("phrase"), get("many"), get("tail").astype(np.int64), table.column("words").to_pylist(), min_words)

    for batch in batches:
        parts.append(batch)
        count += batch.num_rows
        if count >= CHUNK:
            held = pa.Table.from_batches(parts)
            phrase = held.column("phrase").to_numpy()
            other = np.flatnonzero(phrase != phrase[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield work(held.slice(0, cut))
                rest = held.slice(cut).combine_chunks()
                parts, count = rest.to_batches(), rest.num_rows
    if count:
        yield work(pa.Table.from_batches(parts))


def repeated_passages(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Rows (doc_id, first_word, n_words, is_first): all passages of at least ``min_words`` words that occur more than once.

    A place counts when the ``min_words`` words from it on occur at another place of any document; passages are the
    unions of such stretches. Words are lower-case, without punctuation around them, and count from 0. ``is_first`` tells
    stretches at the earliest of their places (by doc_id, then place) from those that repeat an earlier one.

    Null, empty or shorter texts and null keys have no rows. Rows that share a doc_id and a text are one document; rows that
    share a doc_id alone are documents of their own, in an order of their own within the key, each with its passages. Other
    columns aren't read. An empty table gives no rows.
    """
    return _passages(docs, min_words, row_of(docs)).drop("row")


def _passages(docs: DataFrame, min_words: int, row: Column) -> DataFrame:
    """repeated_passages() with the ``row`` of each document, as row_of() has it."""
    scratch = Scratch(docs.sparkSession)
    texts = texts_of(docs, row.alias("row")).where("doc_id is not null")
    keys = texts.mapInArrow(lambda batches: (_keys(part, min_words) for part in slices(batches)), "key long, doc_id long, row long, place int, whole boolean")
    keys = scratch.save(keys, "keys")
    place, mark = F.struct("doc_id", "row", "place"), F.xxhash64("doc_id", "row", "place")
    # counted where they lie, then by key: a phrase in a third of all texts is a number here
    twice = keys.where("whole").select("key", mark.alias("mark")).groupBy("key").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo <> hi").select("key")
    whole = scratch.save(keys.where("whole").join(twice, "key", "left_semi").select("doc_id", "row", "place"), "repeated")
    bare = keys.where("not whole")
    firsts = bare.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("key", "first")
    bare = bare.join(firsts, "key").select("doc_id", "row", F.col("place").alias("start"), (F.col("place") + min_words).cast("int").alias("stop"), (F.col("first") == place).alias("is_first"))
    bare = scratch.save(bare, "bare")
    scratch.drop("keys")
    scratch.release()
    marked = whole.groupBy("doc_id", "row").agg(F.collect_set("place").alias("places")).toDF("m_doc", "m_row", "places")
    around = texts.join(marked, (F.col("doc_id") == F.col("m_doc")) & (F.col("row") == F.col("m_row"))).select("doc_id", "row", "text", "places")
    contexts = scratch.save(around.mapInArrow(lambda batches: (_contexts(part, min_words) for part in slices(batches)), CONTEXTS), "contexts")
    scratch.drop("repeated")
    scratch.release()

    place, same = F.struct("doc_id", "row", "at"), ["phrase", "print", "tail"]
    contexts = contexts.withColumn("tail", F.col("at") - F.col("low"))
    alike = contexts.groupBy(*same).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.any_value("words").alias("words"))
    alike = scratch.save(alike.withColumn("context", F.monotonically_increasing_id()).withColumn("many", (F.col("first") != F.col("last")).cast("long")), "alike")
    scratch.release()
    ordered = alike.select("phrase", "first", "context", "many", "tail", "words").repartition("phrase").sortWithinPartitions("phrase", "first").drop("first")
    ranges = scratch.save(ordered.mapInArrow(lambda batches: _shard(batches, min_words), RANGES), "ranges")
    found = ranges.join(alike.select("context", "many", "first", *same), "context")
    shift = lambda c, at: (F.col(at) + F.col(c)).cast("int").alias(c)
    own = found.select("first.doc_id", "first.row", shift("start", "first.at"), shift("stop", "first.at"), F.col("leads").alias("is_first"))
    others = contexts.select("doc_id", "row", "at", *same).join(found.where("many = 1").select(*same, "first", "start", "stop"), same).where(place != F.col("first"))
    others = others.select("doc_id", "row", shift("start", "at"), shift("stop", "at"), F.lit(False).alias("is_first"))
    spread = scratch.save(own.union(others).union(bare), "spread")
    scratch.drop("contexts", "alike", "ranges", "bare")
    scratch.release()

    order = Window.partitionBy("doc_id", "row", "is_first").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    steps = spread.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("passage", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = steps.groupBy("doc_id", "row", "is_first", "passage").agg(F.min("start").alias("first_word"), F.max("stop").alias("stop"))
    return spans.select("doc_id", "row", "first_word", (F.col("stop") - F.col("first_word")).alias("n_words"), "is_first")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(lower(text), '[^ \t\n\r\f\v]+'), lambda w: trim(w, '.,;:!?"''()[]{}%*#$&')), lambda w: w <> '') AS ws FROM documents),
p AS (SELECT doc_id, i - 1 AS place, md5(array_to_string(ws[i:i + 49], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
r AS (SELECT doc_id, place, (doc_id, place) = min((doc_id, place)) OVER (PARTITION BY g) AS is_first FROM p QUALIFY count(*) OVER (PARTITION BY g) > 1),
n AS (SELECT *, CASE WHEN place <= lag(place) OVER (PARTITION BY doc_id, is_first ORDER BY place) + 50 THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, is_first ORDER BY place) AS passage FROM n)
SELECT doc_id, min(place)::INT AS first_word, (max(place) + 50 - min(place))::INT AS n_words, is_first FROM s GROUP BY doc_id, is_first, passage
"""
