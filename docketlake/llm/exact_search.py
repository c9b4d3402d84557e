"""Exact top-k text search, by exhaustive term-at-a-time accumulation.

Documents are scored block by block where they lie. A block's postings for the queries' terms are laid out by
term; each query's weighted terms are scattered into a dense array with a score for every document of the block;
partition selection takes the block's best, a running best is kept per task, and one merge over tasks ends it.
Nothing is skipped, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.common import hash_words, segment_ids, slices, split_words, texts_of

MARKS = ".,;:!?\"'()[]{}%*#$&"
SCALE = 1e6
RESULT = "query_id long, doc_id long, rank int, score double"


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-case words without the punctuation around them: distinct terms, codes, offsets."""
    words, codes, offsets = split_words(texts)
    if not len(words):
        return words, codes, offsets
    encoded = pc.utf8_trim(words, MARKS).dictionary_encode()
    terms, codes = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)[codes]
    empty = pc.index(terms, pa.scalar("", terms.type)).as_py()
    if empty >= 0:
        real = codes != empty
        offsets, codes = np.concatenate([[0], np.cumsum(real)])[offsets], codes[real]
    return terms, codes, offsets


class QueryBlock:
    """Sparse rows of some queries: sorted term hashes and, for each query, its terms' places and weights."""

    def __init__(self, ids: list[int], rows: list[tuple[np.ndarray, np.ndarray]]):
        self.ids = np.array(ids, np.int64)
        self.terms = np.unique(np.concatenate([h for h, _ in rows]))
        self.rows = [(np.searchsorted(self.terms, h), w) for h, w in rows]


def _query_rows(queries: DataFrame) -> DataFrame:
    def rows(batches):
        for part in slices(batches):
            terms, codes, offsets = split_terms(part.column("text"))
            hashed = hash_words(terms).view(np.int64)
            keys, weights = [], []
            for lo, hi in zip(offsets[:-1], offsets[1:]):
                term, count = np.unique(codes[lo:hi], return_counts=True)
                keys.append(hashed[term])
                weights.append(count)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.int64()))], ["query_id", "terms", "weights"])

    return texts_of(queries).mapInArrow(rows, "query_id long, terms array<long>, weights array<long>").where("query_id is not null and size(terms) > 0")


def _blocks(rows: DataFrame, most: int) -> Iterator[QueryBlock]:
    """All queries, in blocks of about ``most`` weighted terms, streamed through the driver one by one."""
    ids, found, held = [], [], 0
    for r in rows.toLocalIterator(prefetchPartitions=True):
        ids.append(r.query_id)
        found.append((np.array(r.terms, np.int64).view(np.uint64), np.array(r.weights, np.int64)))
        held += len(r.terms)
        if held >= most:
            yield QueryBlock(ids, found)
            ids, found, held = [], [], 0
    if ids:
        yield QueryBlock(ids, found)


def _occurrences(part: pa.RecordBatch, block: QueryBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings of a slice in order of term: term, document, frequency; and all documents' lengths."""
    terms, codes, offsets = split_terms(part.column("text"))
    hashed = hash_words(terms)
    at = np.minimum(np.searchsorted(block.terms, hashed), len(block.terms) - 1)
    place = np.where(block.terms[at] == hashed, at, -1)[codes] if len(terms) else np.zeros(0, np.int64)
    asked = np.flatnonzero(place >= 0)
    key, tf = np.unique(place[asked] * part.num_rows + segment_ids(offsets)[asked], return_counts=True)
    return key // part.num_rows, key % part.num_rows, tf, np.diff(offsets)


def top_k_search(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, block_terms: int = 1_000_000) -> DataFrame:
    """The ``k`` best documents for each row of ``queries`` (doc_id as its key, and text) by BM25 over all documents.

    A term's weight in a document is rounded to 1e-6, so that sums don't depend on order; equal scores rank by
    doc_id. Frequencies, lengths and document counts cover all of ``docs``. Queries travel to the tasks in blocks of
    about ``block_terms`` weighted terms, one pass over the documents for each block, so a broadcast is bounded
    however many queries there are.

    A null or empty query, one without a known term, or one with a null key has no rows; a null or empty text is
    never found but counts in averages; a document with a null key counts in averages and is never returned.
    Repeated rows, of either side, count as rows of their own. Other columns aren't read. Empty tables give no rows.
    """
    spark, found = docs.sparkSession, None
    docs = texts_of(docs)
    for block in _blocks(_query_rows(queries), block_terms):
        part = _search(docs, spark.sparkContext.broadcast(block), k, k1, b)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], RESULT) if found is None else found


def _search(docs: DataFrame, shared, k: int, k1: float, b: float) -> DataFrame:
    def count(batches):
        block = shared.value
        df, n, length = np.zeros(len(block.terms), np.int64), 0, 0
        for part in slices(batches):
            term, _, _, size = _occurrences(part, block)
            df += np.bincount(term, minlength=len(df))
            n, length = n + part.num_rows, length + int(size.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2]])), pa.array(np.concatenate([df[some], [n, length]]))], ["term", "n"])

    block = shared.value
    df = np.zeros(len(block.terms))
    n = length = 0
    for r in docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # as many rows as the block has terms
        if r.term >= 0:
            df[r.term] = r.n
        elif r.term == -1:
            n = r.n
        else:
            length = r.n
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    average = length / n if n and length else 1.0

    def score(batches):
        block = shared.value
        best = [np.zeros((0, 2), np.int64)] * len(block.ids)
        for part in slices(batches):
            keyed = part.column("doc_id").is_valid()
            part = part.filter(keyed)
            if not part.num_rows:
                continue
            term, doc, tf, size = _occurrences(part, block)
            weight = idf[term] * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * size[doc] / average))
            weight = np.floor(weight * SCALE + 0.5).astype(np.int64)
            first = np.searchsorted(term, np.arange(len(block.terms) + 1))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            dense = np.zeros(part.num_rows, np.int64)
            for q, (places, times) in enumerate(block.rows):
                dense[:] = 0
                for t, x in zip(places, times):
                    lo, hi = first[t], first[t + 1]
                    dense[doc[lo:hi]] += x * weight[lo:hi]
                # the k-th best of the slice bounds it from below; ties with it stay for the order by doc_id
                least = max(1, np.partition(dense, -k)[-k]) if len(dense) > k else 1
                if len(best[q]) >= k:
                    least = max(least, best[q][-1, 0])
                hit = np.flatnonzero(dense >= least)
                if len(hit):
                    both = np.concatenate([best[q], np.stack([dense[hit], ids[hit]], 1)])
                    best[q] = both[np.lexsort((both[:, 1], -both[:, 0]))[:k]]
        size = [len(x) for x in best]
        every = np.concatenate(best) if best else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(block.ids)), size)), pa.array(every[:, 1]), pa.array(every[:, 0])], ["row", "doc_id", "total"])

    ids = docs.sparkSession.createDataFrame(list(enumerate(block.ids.tolist())), "row long, query_id long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("total"), "doc_id"))
    merged = docs.mapInArrow(score, "row long, doc_id long, total long").withColumn("rank", rank).where(F.col("rank") <= k)
    return merged.join(F.broadcast(ids), "row").select("query_id", "doc_id", "rank", (F.col("total") / SCALE).alias("score"))


SQL = """
WITH d AS (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(lower(text), '[^ \\t\\n\\r\\f\\v]+'), lambda w: trim(w, '.,;:!?"''()[]{}%*#$&')), lambda w: w <> '') AS ws FROM documents
), n AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS average FROM d),
q AS (
  SELECT item_id, w, count(*) AS times FROM (
    SELECT item_id, unnest(list_filter(list_transform(regexp_extract_all(lower(text), '[^ \\t\\n\\r\\f\\v]+'), lambda w: trim(w, '.,;:!?"''()[]{}%*#$&')), lambda w: w <> '')) AS w FROM benchmark) GROUP BY ALL
), tf AS (SELECT doc_id, dl, w, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
weighted AS (
  SELECT doc_id, w, floor(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / average)) * 1000000 + 0.5)::BIGINT AS x
  FROM tf JOIN df USING (w), n
), total AS (SELECT item_id, doc_id, sum(times * x)::BIGINT AS total FROM q JOIN weighted USING (w) GROUP BY ALL HAVING sum(times * x) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY total DESC, doc_id) AS r FROM total)
SELECT item_id AS query_id, doc_id, r::INT AS rank, total / 1000000.0::DOUBLE AS score FROM ranked WHERE r <= 10
"""
