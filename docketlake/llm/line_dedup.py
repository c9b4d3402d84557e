"""Removal of repeated lines by an exact set-similarity join.

A line is the set of its words. Tokens are ordered by rarity; lines that share a token of their prefixes are compared
under length, positional and bitmap filters, none of which loses a pair; the survivors' Jaccard similarity is
verified on the words themselves; and a line with an earlier match goes.

Lines with the very same set are one point of the join (the earliest stands for all), so a line in thousands of
copies costs as much as one. Rarity comes from counts over all lines in a table of fixed size, indexed by a hash of the token:
any common order gives exact results, and this one needs no shuffle of the vocabulary. A token that stands in the
prefixes of more lines than a task should compare has them split into blocks, every two of which meet in a run of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import Scratch, block_pairs, distinct, hash_words, mix, row_of, runs, segment_ids, slices, sum_segments, texts_of
from docketlake.llm.exact_search import split_terms

BITS = 18
PAGE = 4096
BLOCK = 20_000
PAIRS = 500_000


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All lines of all texts: the text each belongs to, its number there, and its words' source string."""
    parts = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    doc = segment_ids(offsets)
    return doc, np.arange(len(flat)) - offsets[:-1][doc], flat


def token_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of tokens over all lines, by a hash of BITS bits. What comes to the driver has a fixed size."""

    def count(batches):
        total = np.zeros(1 << BITS, np.int64)
        for part in slices(batches):
            terms, codes, _ = split_terms(part.column("text"))
            if len(terms):
                total += np.bincount((hash_words(terms) >> np.uint64(64 - BITS)).astype(np.int64), np.bincount(codes, minlength=len(terms)), 1 << BITS).astype(np.int64)
        pages = total.reshape(-1, PAGE)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pages))), pa.array([x.tobytes() for x in pages], pa.binary())], ["page", "counts"])

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(x, np.int64) for x in pdf["counts"]), np.zeros(PAGE, np.int64))
        return pd.DataFrame({"page": [key[0]], "counts": [total.tobytes()]})

    found = np.zeros(1 << BITS, np.int64)
    for r in docs.mapInArrow(count, "page long, counts binary").groupBy("page").applyInPandas(add, "page long, counts binary").collect():
        found[r.page * PAGE : (r.page + 1) * PAGE] = np.frombuffer(bytes(r.counts), np.int64)
    return found


LINES = "doc_id long, row long, line int, n int, s0 long, s1 long, b0 long, b1 long, prefix array<long>"


def _line_sets(part: pa.RecordBatch, counts: np.ndarray, threshold: float, min_tokens: int) -> pa.RecordBatch:
    doc, number, flat = _lines(part.column("text"))
    terms, codes, offsets = split_terms(flat)
    hashed = hash_words(terms)
    count = counts[(hashed >> np.uint64(64 - BITS)).astype(np.int64)]
    order = np.lexsort((hashed, count))
    rank = np.empty(len(terms), np.int64)
    rank[order] = np.arange(len(terms))
    width = max(1, len(terms))
    key = distinct(segment_ids(offsets) * width + rank[codes])
    line = key // width
    token = hashed[order[key % width]] if len(key) else np.zeros(0, np.uint64)
    n = np.bincount(line, minlength=len(flat))
    bounds = np.concatenate([[0], np.cumsum(n)])
    bit = mix(token) & np.uint64(127)
    one = np.uint64(1) << (bit & np.uint64(63))
    with np.errstate(over="ignore"):
        sums = [sum_segments(mix(token), bounds), sum_segments(mix(token ^ np.uint64(0x5A5A5A5A5A5A5A5A)), bounds)]
    full = np.flatnonzero(n)
    parity = [np.zeros(len(flat), np.uint64), np.zeros(len(flat), np.uint64)]
    for half in (0, 1):
        if len(full):
            parity[half][full] = np.bitwise_xor.reduceat(np.where((bit >> np.uint64(6)) == half, one, np.uint64(0)), bounds[:-1][full])
    # a line so short that another set can't reach the threshold has no prefix: its equals are found by their set alone
    size = np.where(n / (n + 1) >= threshold, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, 0)
    keep = np.flatnonzero(n >= min_tokens)
    size = size[keep]
    starts = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(bounds[:-1][keep] - starts[:-1], size) + np.arange(starts[-1])
    # the lowest bit of a prefix token tells that it may stand in more than a block of prefixes
    often = (count >= BLOCK).astype(np.uint64)[order[key % width]] if len(key) else np.zeros(0, np.uint64)
    token = (token & ~np.uint64(1)) | often
    prefix = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(token[at].view(np.int64)))
    ids = [part.column(c).take(pa.array(doc[keep])) for c in ("doc_id", "row")]
    return pa.RecordBatch.from_arrays(
        [*ids, pa.array(number[keep].astype(np.int32)), pa.array(n[keep].astype(np.int32)), *(pa.array(x[keep].view(np.int64)) for x in (*sums, *parity)), prefix],
        ["doc_id", "row", "line", "n", "s0", "s1", "b0", "b1", "prefix"],
    )


PLACES = ("a_doc", "a_row", "a_line", "b_doc", "b_row", "b_line")
PAIR = "a_doc long, a_row long, a_line int, b_doc long, b_row long, b_line int"


def _candidates(batches, threshold: float):
    """Pairs of rows of one run (rows come sorted by run and size) that pass the length, positional and bitmap filters."""

    def pairs(x, a, b):
        later = x["line"][a] > x["line"][b]
        for c in ("row", "doc_id"):
            later = (x[c][a] > x[c][b]) | ((x[c][a] == x[c][b]) & later)
        a, b = np.where(later, b, a), np.where(later, a, b)
        return pa.RecordBatch.from_arrays([pa.array(x[c][i]) for i in (a, b) for c in ("doc_id", "row", "line")], list(PLACES))

    for x in runs(batches, ("run", "side", "n", "place", "doc_id", "row", "line", "b0", "b1"), "run"):
        found, held, k = [], 0, 1
        alive = np.arange(len(x["run"]))
        while len(alive):
            alive = alive[alive + k < len(x["run"])]
            j = alive + k
            alive = alive[(x["run"][alive] == x["run"][j]) & (x["n"][alive] >= threshold * x["n"][j] - 1e-9)]
            a, b = alive, alive + k
            apart = (x["side"][a] < 0) | (x["side"][a] != x["side"][b])
            a, b = a[apart], b[apart]
            need = np.ceil(threshold / (1 + threshold) * (x["n"][a] + x["n"][b]) - 1e-9)
            most = np.minimum(x["place"][a], x["place"][b]) + 1 + np.minimum(x["n"][a] - x["place"][a], x["n"][b] - x["place"][b]) - 1
            unlike = sum(np.bitwise_count((x[c][a] ^ x[c][b]).view(np.uint64)).astype(np.int64) for c in ("b0", "b1"))
            ok = (most >= need) & (unlike <= x["n"][a] + x["n"][b] - 2 * need)
            if ok.any():
                found.append((a[ok], b[ok]))
                held += int(ok.sum())
            if held >= PAIRS:
                yield pairs(x, *(np.concatenate([f[i] for f in found]) for i in (0, 1)))
                found, held = [], 0
            k += 1
        if found:
            yield pairs(x, *(np.concatenate([f[i] for f in found]) for i in (0, 1)))


def _token_sets(batches):
    """The distinct words of each line, by their 64-bit hashes."""
    for part in slices(batches, "piece"):
        terms, codes, offsets = split_terms(part.column("piece"))
        width = max(1, len(terms))
        key = distinct(segment_ids(offsets) * width + codes)
        starts = np.searchsorted(key, np.arange(part.num_rows + 1) * width)
        tokens = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(hash_words(terms).view(np.int64)[key % width]) if len(key) else pa.array([], pa.int64()))
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "row", "line")), tokens], ["doc_id", "row", "line", "tokens"])


def _verified(batches, threshold: float):
    """Pairs whose lines' sets of words reach the threshold, compared word by word."""
    for batch in batches:
        n = batch.num_rows
        size = [np.diff(batch.column(c).offsets.to_numpy()) for c in ("a_tokens", "b_tokens")]
        words, code = np.unique(np.concatenate([batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("a_tokens", "b_tokens")]), return_inverse=True)
        key = np.sort(np.concatenate([np.repeat(np.arange(n), x) for x in size]) * max(1, len(words)) + code)
        shared = np.bincount(key[1:][key[1:] == key[:-1]] // max(1, len(words)), minlength=n)
        score = shared / np.maximum(1, size[0] + size[1] - shared)
        ok = pa.array(score >= threshold)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(ok) for c in PLACES), pa.array(score).filter(ok)], [*PLACES, "jaccard"])


def _repeats(docs: DataFrame, threshold: float, min_tokens: int, row) -> DataFrame:
    """repeated_lines() with the ``row`` of each line's document, as row_of() has it."""
    scratch = Scratch(docs.sparkSession)
    texts = texts_of(docs, row.alias("row")).where("doc_id is not null")
    counts = docs.sparkSession.sparkContext.broadcast(token_counts(texts.select("doc_id", "text")))  # of fixed size

    def sets(batches):
        for part in slices(batches):
            yield _line_sets(part, counts.value, threshold, min_tokens)

    lines = scratch.save(texts.mapInArrow(sets, LINES), "lines")
    same, place = ["s0", "s1", "n"], ["doc_id", "row", "line"]
    groups = lines.groupBy(*same).agg(F.min(F.struct(*place)).alias("first"), F.max(F.struct(*place)).alias("last"), F.min(F.struct("b0", "b1", "prefix")).alias("s"))
    groups = scratch.save(groups, "sets")
    many = groups.where("first <> last").select(*same, "first")
    copies = lines.select(*same, *place).join(many, same).where(F.struct(*place) != F.col("first"))
    copies = scratch.save(copies.select(*place, F.col("first.doc_id").alias("kept_doc_id"), F.col("first.line").alias("kept_line"), F.lit(1.0).alias("jaccard")).distinct(), "copies")
    scratch.drop("lines")

    postings = groups.select("n", "first.doc_id", "first.row", "first.line", "s.b0", "s.b1", F.posexplode("s.prefix").alias("place", "token"))
    ordinary = postings.withColumn("run", F.col("token")).withColumn("side", F.lit(-1))
    if counts.value.max() >= BLOCK:
        often = postings.where("token & 1 = 1").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
        often = scratch.save(often, "often")
        if not often.isEmpty():
            ordinary = ordinary.join(often.select(F.col("token").alias("o_token")), F.col("token") == F.col("o_token"), "left_anti").union(block_pairs(postings, often, "token", place, BLOCK))
    ordered = ordinary.drop("token").repartition("run").sortWithinPartitions("run", "n")
    pairs = scratch.save(ordered.mapInArrow(lambda b: _candidates(b, threshold), PAIR).distinct(), "pairs")
    scratch.drop("sets")
    wanted = pairs.select(F.col("a_doc").alias("w_doc"), F.col("a_row").alias("w_row"), F.col("a_line").alias("w_line")).union(pairs.select("b_doc", "b_row", "b_line"))
    wanted = wanted.groupBy("w_doc", "w_row").agg(F.collect_set("w_line").alias("w_lines"))
    mine = (F.col("doc_id") == F.col("w_doc")) & (F.col("row") == F.col("w_row"))
    # texts move here at any size: a small table of wanted lines would be broadcast at some sizes alone
    pieces = texts.join(wanted.hint("merge"), mine).select("doc_id", "row", F.split("text", "\n", -1).alias("parts"), F.explode("w_lines").alias("line"))
    pieces = pieces.select("doc_id", "row", "line", F.expr("try_element_at(parts, cast(line + 1 as int))").alias("piece")).distinct()
    pieces = scratch.save(pieces.mapInArrow(_token_sets, "doc_id long, row long, line int, tokens array<long>"), "pieces")
    sides = pairs
    for side in ("a", "b"):
        keys = [f"{side}_doc", f"{side}_row", f"{side}_line"]
        sides = sides.join(pieces.toDF(*keys, f"{side}_tokens"), keys)
    near = sides.select(*PLACES, "a_tokens", "b_tokens").mapInArrow(lambda b: _verified(b, threshold), PAIR + ", jaccard double")
    best = near.groupBy(F.col("b_doc").alias("doc_id"), F.col("b_row").alias("row"), F.col("b_line").alias("line")).agg(F.min(F.struct("a_doc", "a_row", "a_line", "jaccard")).alias("a"))
    near = scratch.save(best.select(*place, F.col("a.a_doc").alias("kept_doc_id"), F.col("a.a_line").alias("kept_line"), F.col("a.jaccard").alias("jaccard")), "near")
    scratch.drop("pairs", "pieces")
    return copies.union(near)


def repeated_lines(docs: DataFrame, threshold: float = 0.9, min_tokens: int = 1) -> DataFrame:
    """Rows (doc_id, line, kept_doc_id, kept_line, jaccard) of lines to remove, each with an earlier line that it repeats.

    Lines are counted from 0 and come in order of doc_id and number. A line goes if any earlier one, itself removed or
    not, has at least ``threshold`` Jaccard similarity of lower-case words without punctuation around them. A line whose
    set of words occurred before names the first line with that very set, any other the earliest that it resembles. Lines
    of fewer than ``min_tokens`` distinct words are left alone, as are all lines of null texts or null keys.

    Rows that share a doc_id are told apart by their texts, in an order of their own within the key; rows that share both
    are one document, which loses the same lines in each. Other columns aren't read. An empty table gives no rows.
    """
    return _repeats(docs, threshold, min_tokens, row_of(docs)).drop("row")


def dedup_lines(docs: DataFrame, threshold: float = 0.9, min_tokens: int = 1, drop_emptied: bool = False) -> DataFrame:
    """The documents with all their columns, their texts without the lines of repeated_lines().

    Every row stays, a null text or a null key as it is; with ``drop_emptied`` those go that lost lines and have nothing
    left but lines of fewer than ``min_tokens`` words. Of rows that share a doc_id, each loses its own lines alone.
    Columns may bear any names. An empty table gives no rows.
    """
    row = row_of(docs)
    gone = _repeats(docs, threshold, min_tokens, row).groupBy("doc_id", "row").agg(F.collect_set("line").alias("lines")).select(F.struct("doc_id", "row", "lines").alias("__gone"))
    joined = docs.join(gone, (docs["doc_id"].cast("long") == F.col("__gone.doc_id")) & (row == F.col("__gone.row")), "left")
    rest = F.filter(F.split(docs["text"], "\n", -1), lambda x, i: ~F.array_contains(F.col("__gone.lines"), i))
    text = F.when(F.col("__gone").isNull(), docs["text"]).otherwise(F.array_join(rest, "\n"))
    if drop_emptied:
        full = F.exists(rest, lambda x: F.regexp_count(x, F.lit(r"[^ \t\n\r]+")) >= min_tokens)
        joined = joined.where(F.col("__gone").isNull() | full)
    return joined.select(*(text.alias("text") if c == "text" else docs[c] for c in docs.columns))


SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line, list_distinct(list_filter(list_transform(regexp_extract_all(lower(x), '[^ \t\n\r\f\v]+'), lambda w: trim(w, '.,;:!?"''()[]{}%*#$&')), lambda w: w <> '')) AS ws
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), s AS (SELECT list_sort(ws) AS ws, len(ws) AS n, min((doc_id, line)) AS first FROM l WHERE len(ws) >= 1 GROUP BY 1, 2),
copies AS (SELECT doc_id, line, first[1] AS kept_doc_id, first[2] AS kept_line, 1.0::DOUBLE AS jaccard FROM l JOIN s ON list_sort(l.ws) = s.ws WHERE (doc_id, line) <> first),
w AS (SELECT first, n, unnest(ws) AS w FROM s),
f AS (SELECT w, count(*) AS df FROM w GROUP BY w),
p AS (SELECT first, n, w FROM w JOIN f USING (w) QUALIFY row_number() OVER (PARTITION BY first ORDER BY df, w) <= n - ceil(0.9 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.first AS a, b.first AS b FROM p a JOIN p b ON a.w = b.w AND a.first < b.first AND a.n >= 0.9 * b.n - 1e-9 AND b.n >= 0.9 * a.n - 1e-9),
v AS (SELECT c.a, c.b, len(list_intersect(x.ws, y.ws)) AS shared, x.n + y.n AS n FROM c JOIN s x ON x.first = c.a JOIN s y ON y.first = c.b),
near AS (SELECT b, min((a[1], a[2], shared / (n - shared)::DOUBLE)) AS a FROM v WHERE shared / (n - shared)::DOUBLE >= 0.9 GROUP BY b)
SELECT doc_id, line::INT AS line, kept_doc_id, kept_line::INT AS kept_line, jaccard FROM copies
UNION ALL SELECT b[1], b[2]::INT, a[1], a[2]::INT, a[3] FROM near
"""
