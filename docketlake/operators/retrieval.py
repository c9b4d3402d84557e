"""Paragraph retrieval: postings, BM25, phrases, proximity, dense vectors, rank fusion, evaluation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.scalars import fold_words, words

def paragraphs(docs: DataFrame, sep: str = "\n") -> DataFrame:
    """Non-blank paragraphs numbered within their document: paragraph_id is ``<doc_id>:<n>``."""
    kept = F.filter(F.transform(F.split("text", sep, -1), lambda p: F.trim(p)), lambda p: p != "")
    return docs.select("doc_id", F.posexplode(kept).alias("pos", "text")).select(F.concat_ws(":", F.col("doc_id").cast("string"), (F.col("pos") + 1).cast("string")).alias("paragraph_id"), "doc_id", (F.col("pos") + 1).alias("para_num"), "text")


def postings(units: DataFrame, key: str) -> DataFrame:
    """One row per term of each unit: frequency, positions and the unit's length. A unit's postings are made where it lies; nothing is shuffled."""
    kind = dict(units.dtypes)[key]

    def spread(batches):
        for batch in batches:
            lists = batch.column("w")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            encoded = lists.flatten().dictionary_encode()
            size = np.diff(offsets)
            offsets = np.concatenate([[0], np.cumsum(size)])
            unit = np.repeat(np.arange(len(size)), size)
            code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.arange(len(code)) - offsets[:-1][unit]
            order = np.lexsort((place, code, unit))
            unit, code, place = unit[order], code[order], place[order]
            first = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]) | (code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
            ends = np.append(first, len(code))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(pa.array(unit[first])), encoded.dictionary.take(pa.array(code[first])), pa.array(np.diff(ends)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place.astype(np.int32))), pa.array(size[unit[first]].astype(np.int32)),
                ],
                [key, "term", "tf", "positions", "len"],
            )

    return units.where("text is not null").select(key, words(F.col("text")).alias("w")).mapInArrow(spread, f"{key} {kind}, term string, tf long, positions array<int>, len int")


def bm25(units: DataFrame, key: str, query: list[str] | str, k: int | None = 25, k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
    """Units that hold a query term, best first. Only rows of the query's terms are shuffled; corpus length and count come from one aggregate.

    Ranks are those of sums to 12 places, taken in one order of their parts; scores are shown to ``digits`` places.
    """
    terms = list(dict.fromkeys(fold_words(query if isinstance(query, str) else " ".join(query))))
    counted = units.select(key, words(F.col("text")).alias("w"))
    whole = counted.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("average"))
    hits = counted.select(key, F.size("w").alias("len"), F.filter("w", lambda t: t.isin(terms)).alias("w")).where(F.size("w") > 0)
    hits = hits.select(key, "len", F.explode(F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.size(F.filter("w", lambda x: x == t)).alias("tf")))).alias("h")).select(key, "len", "h.*")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("average")))
    parts = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(whole)).groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("parts"))  # as many parts as the query has terms
    scored = parts.select(key, F.round(F.aggregate("parts", F.lit(0.0), lambda s, x: s + x), 12).alias("score"))
    if k is not None:
        scored = scored.orderBy(F.desc("score"), key).limit(k)
    return scored.withColumn("score", F.round("score", digits))


def marked_snippet(text: Column, terms: list[str], around: int = 12) -> Column:
    """The stretch of ``2 * around`` words and one more about the first word that is one of the terms, which are put in brackets."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    bare = F.transform(parts, lambda w: words(w))
    found = F.transform(bare, lambda ws: F.exists(ws, lambda t: t.isin(terms)))
    at = F.array_position(found, F.lit(True)).cast("int")
    start = F.greatest(at - around, F.lit(1))
    shown = F.transform(F.slice(F.arrays_zip(parts.alias("w"), found.alias("f")), start, at + around - start + 1), lambda x: F.when(x["f"], F.concat(F.lit("["), x["w"], F.lit("]"))).otherwise(x["w"]))
    cut = F.concat(F.when(start > 1, "… ").otherwise(""), F.array_join(shown, " "), F.when(at + around < F.size(parts), " …").otherwise(""))
    return F.when(at > 0, cut)


def search_paragraphs(units: DataFrame, query: str, key: str = "paragraph_id", limit: int = 20, **filters) -> DataFrame:
    """Paragraphs that hold every word of the query and pass the filters, best first: key, text, snippet, score and ``lexical_rank``.

    Frequencies are those of all paragraphs; filters name a column and the value that it must have.
    """
    terms = list(dict.fromkeys(fold_words(query)))
    if not terms:
        raise ValueError("the query has no word")
    have = words(F.col("text"))
    found = units
    for name, value in filters.items():
        if value is not None:
            found = found.where(F.col(name) == value)
    for t in terms:
        found = found.where(F.array_contains(have, t))
    ranked = bm25(units, key, terms, None).join(found, key, "left_semi").orderBy(F.desc("score"), key).limit(limit)
    best = ranked.join(units.select(key, "text"), key).withColumn("snippet", marked_snippet(F.col("text"), terms))
    # at most ``limit`` rows
    return best.withColumn("lexical_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), key)))


def get_paragraphs(units: DataFrame, doc_id, para_num: int | None = None, section: str | None = None, limit: int = 100) -> DataFrame:
    """Paragraphs of a document in order, of one number or section if asked for."""
    found = units.where(F.col("doc_id") == F.lit(doc_id))
    if para_num is not None:
        found = found.where(F.col("para_num") == para_num)
    if section is not None:
        found = found.where(F.col("section") == section)
    return found.orderBy("para_num").limit(limit)


def phrase_search(units: DataFrame, key: str, phrase: str) -> DataFrame:
    joined = F.concat(F.lit(" "), F.array_join(words(F.col("text")), " "), F.lit(" "))
    return units.where(F.contains(joined, F.lit(" " + " ".join(fold_words(phrase)) + " "))).select(key)


def near_search(units: DataFrame, key: str, first: str, second: str, distance: int = 5) -> DataFrame:
    """Units with the two words within ``distance`` places of one another, and the least distance."""
    placed = F.transform(words(F.col("text")), lambda t, i: F.struct(t.alias("t"), i.alias("i")))

    def places(word: str) -> Column:
        return F.transform(F.filter(placed, lambda p: p["t"] == fold_words(word)[0]), lambda p: p["i"])

    a, b = places(first), places(second)
    gaps = F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.abs(x - y)))))
    return units.select(key, gaps.alias("gap")).where(F.col("gap") <= distance)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_vector(v: Column) -> Column:
    """L2-normalised; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def _query_blocks(queries: DataFrame, rows: int):
    """Query ids and unit-length matrices, streamed through the driver in blocks of bounded size."""
    ids, vectors = [], []
    for r in queries.toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])
        if len(ids) == rows:
            yield ids, _unit(np.array(vectors, float))
            ids, vectors = [], []
    if ids:
        yield ids, _unit(np.array(vectors, float))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


#: Scores that a task computes at a time.
CELLS = 1 << 19


class _Best:
    """The best ``k`` scores of each of ``n`` queries, with what ties with the last of them, out of blocks of scores."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.parts, self.size, self.most = k, np.full(n, -np.inf), [], 0, max(1 << 18, 4 * n * k)

    def add(self, scores: np.ndarray, keys: pa.Array) -> None:
        n, k = scores.shape[1], self.k
        if n > k:
            self.least = np.maximum(self.least, np.partition(scores, n - k, axis=1)[:, n - k])
        row, at = np.nonzero(scores >= self.least[:, None] - 1e-11)
        self.parts.append((row, keys.take(pa.array(at)), scores[row, at]))
        self.size += len(row)
        if self.size > self.most:
            self.prune()
            self.most = max(self.most, 2 * self.size)

    def prune(self) -> None:
        row, keys, score = (np.concatenate([p[0] for p in self.parts]), pa.concat_arrays([p[1] for p in self.parts]), np.concatenate([p[2] for p in self.parts]))
        order = np.lexsort((-score, row))
        row, score = row[order], score[order]
        first = np.searchsorted(row, np.arange(len(self.least)))
        ends = np.append(first[1:], len(row))
        full = ends - first >= self.k
        self.least[full] = np.maximum(self.least[full], score[first[full] + self.k - 1])
        kept = score >= self.least[row] - 1e-11
        self.parts, self.size = [(row[kept], keys.take(pa.array(order[kept])), score[kept])], int(kept.sum())

    def kept(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), None, np.zeros(0)
        self.prune()
        return self.parts[0]


def dense_top_k(vectors: DataFrame, queries: DataFrame, key: str, query_key: str, k: int = 25, block_rows: int = 4096) -> DataFrame:
    """Exact cosine neighbours of every query vector: rows (query_id, key, score, rank), equal scores in order of the key.

    Blocks of queries go to the vectors, which are scored by matrix products of CELLS scores at most; each task sends on its best
    ``k`` of every query (and what ties with them), so what is held and shuffled doesn't depend on the vectors' size. Null vectors are left out.
    """
    kinds, spark = dict(vectors.dtypes), vectors.sparkSession
    table = vectors.where("embedding is not null").select(key, "embedding")
    asked = queries.where("embedding is not null").select(query_key, "embedding")
    schema = f"row long, {key} {kinds[key]}, score double"
    found = None
    for ids, matrix in _query_blocks(asked, block_rows):
        shared = spark.sparkContext.broadcast(matrix)

        def score(batches, shared=shared):
            q = shared.value
            best = _Best(len(q), k)
            for batch in batches:
                for i in range(0, batch.num_rows, piece := max(1, CELLS // len(q))):
                    part = batch.slice(i, piece)
                    flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float)
                    best.add(q @ _unit(flat.reshape(part.num_rows, -1)).T, part.column(key))
            row, names_, scores = best.kept()
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(row), names_, pa.array(scores)], ["row", key, "score"])

        names = spark.createDataFrame(list(enumerate(ids)), f"row long, query_id {dict(queries.dtypes)[query_key]}")
        rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), key))
        # equal vectors give sums that differ in the last places, so ranks see 12 of them
        best = table.mapInArrow(score, schema).withColumn("score", F.round("score", 12)).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
        best = best.join(F.broadcast(names), "row").select("query_id", key, (F.round("score", 6) + F.lit(0.0)).alias("score"), "rank")
        found = best if found is None else found.union(best)
    if found is None:
        return table.select(F.lit(None).cast(dict(queries.dtypes)[query_key]).alias("query_id"), key, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)
    return found


def reciprocal_rank_fusion(lists: list[DataFrame], key: str, top_k: int, rrf_k: int = 60, scores: tuple[str, ...] = ("lexical_score", "dense_score"), candidates: int = 10_000) -> DataFrame:
    """Sum of 1 / (rrf_k + rank) over ranked lists (columns key, score); equal sums in order of the key as a string.

    Of each list the best ``candidates`` count, so that ranking holds no more in one task.
    """
    order = lambda s: Window.orderBy(F.desc("score"), F.col(key).cast("string"))
    parts = [x.select(key, F.lit(i).alias("list"), "score", F.row_number().over(order(x)).alias("rank")) for i, x in enumerate(x.orderBy(F.desc("score"), F.col(key).cast("string")).limit(candidates) for x in lists)]
    every = reduce(DataFrame.unionByName, parts)
    fused = every.groupBy(key).agg(
        F.round(F.sum(1 / (F.lit(rrf_k) + F.col("rank"))), 9).alias("rrf_score"), *(F.max(F.when(F.col("list") == i, F.col("score"))).alias(name) for i, name in zip(range(len(lists)), scores))
    )
    return fused.orderBy(F.desc("rrf_score"), F.col(key).cast("string")).limit(top_k)


class HybridRetriever:
    """Lexical, dense or fused search over one table of paragraphs with embeddings."""

    FILTERS = ("section", "language", "itemid", "source_component", "opinion_id", "date_from", "date_to")

    def __init__(self, units: DataFrame, key: str = "paragraph_id", top_k: int = 25, candidate_k: int = 100, rrf_k: int = 60):
        self.units, self.key, self.top_k, self.candidate_k, self.rrf_k = units, key, top_k, max(candidate_k, top_k), rrf_k

    def _filtered(self, filters: dict) -> DataFrame:
        df = self.units
        for name, value in filters.items():
            if name not in self.FILTERS:
                raise ValueError(f"unknown filter: {name}")
            if name == "date_from":
                df = df.where(F.col("kp_date") >= F.lit(value))
            elif name == "date_to":
                df = df.where(F.col("kp_date") <= F.lit(value))
            else:
                df = df.where(F.col(name) == (value.upper() if name == "language" else value))
        return df

    def search(self, query: str | None = None, vector: list[float] | None = None, **filters) -> DataFrame:
        units = self._filtered(filters)
        fused = query is not None and vector is not None
        k = self.candidate_k if fused else self.top_k
        lists = []
        if query is not None:
            lists.append(bm25(units, self.key, query, k))
        if vector is not None:
            one = units.sparkSession.createDataFrame([(0, vector)], "q int, embedding array<double>")
            lists.append(dense_top_k(units.where("embedding is not null"), one, self.key, "q", k).select(self.key, "score"))
        return reciprocal_rank_fusion(lists, self.key, self.top_k, self.rrf_k) if fused else lists[0]


def evaluate(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Recall, reciprocal rank and nDCG at ``k`` (binary) over all queries of ``relevant`` (query_id, item); ``ranked`` has query_id, item, rank."""
    hits = ranked.where(F.col("rank") <= k).join(relevant.select("query_id", "item", F.lit(1).alias("rel")), ["query_id", "item"], "left")
    return _measures(hits, relevant.groupBy("query_id").agg(F.count_distinct("item").alias("n")), k)


def evaluate_labels(ranked: DataFrame, queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """As ``evaluate``, where the items (item, label) of a query's label (query_id, label) are relevant.

    Pairs of query and relevant item, as many as both tables' product, aren't made: relevant items are counted once a label.
    """
    items = items.where("label is not null").select("item", "label").distinct()
    sizes = items.groupBy("label").agg(F.count("*").alias("n"))
    hits = ranked.where(F.col("rank") <= k).join(queries.select("query_id", F.col("label").alias("asked")), "query_id")
    hits = hits.join(items.select("item", "label"), "item", "left").withColumn("rel", F.when(F.col("label") == F.col("asked"), 1))
    return _measures(hits, queries.select("query_id", "label").join(sizes, "label").select("query_id", "n"), k)


def _measures(hits: DataFrame, want: DataFrame, k: int) -> DataFrame:
    """Of the ranked items (query_id, item, rank, rel) and the number ``n`` of each query's relevant ones."""
    got = hits.groupBy("query_id").agg(
        F.count_distinct(F.when(F.col("rel") == 1, F.col("item"))).alias("found"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("rel") == 1, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    per = want.join(got, "query_id", "left").select(
        (F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg")
    )
    return per.agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))
