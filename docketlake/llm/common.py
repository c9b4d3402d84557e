"""Shared pieces of the training-data operators.

Texts cross into Python as Arrow batches and stay Arrow or numpy there: a batch is cut into slices of
bounded bytes, split on whitespace and dictionary-encoded by Arrow, so Python code runs per *distinct*
word of a slice and numpy code per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20


class Scratch:
    """Written tables in the folder that the cluster shares, to cut lineage and to share a result between jobs.

    The folder comes from ``spark.checkpoint.dir`` (or the directory set on the context). Where neither is
    set, a temporary folder is used, in local mode only.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="docketlake-")
            spark.sparkContext.setCheckpointDir(base)
        self.base = f"{base}/tables-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets the driver's JVM notice shuffles that nothing refers to, so that executors delete their files now rather than later."""
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Deletes tables that no later job reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """The key and text of documents (a null text counts as empty), with other columns asked for; nothing else travels."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more
    )


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about SLICE_BYTES of text; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, done + SLICE_BYTES, "right")))
            yield batch.slice(start, end - start)
            start = end


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Whitespace-separated words of each text: distinct words, their codes in reading order, and where each text's begin."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if lower:
        texts = pc.utf8_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    encoded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    codes, words = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        real = codes != empty
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return words, codes, offsets


def word_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all words, one after the other, and where each word's begin."""
    words = words.cast(pa.large_string())
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = words.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8), offsets - offsets[0]


def sum_segments(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each segment; an empty one gives 0."""
    total = np.add.reduceat(np.append(values, np.zeros(1, values.dtype)), offsets[:-1]) if len(offsets) > 1 else np.zeros(0, values.dtype)
    total[offsets[:-1] == offsets[1:]] = 0
    return total


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word, alike in every process: a sum of random numbers by byte and place, scrambled."""
    data, offsets = word_bytes(words)
    size = np.diff(offsets)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    with np.errstate(over="ignore"):
        total = sum_segments(_BY_PLACE[(np.minimum(at, 255) << 8) | data], offsets)
        result = mix(total + mix(size.astype(np.uint64) + np.uint64((seed << 32) + 1)))
    for i in np.flatnonzero(size > 255):
        result[i] = xxhash.xxh3_64_intdigest(data[offsets[i] : offsets[i + 1]].tobytes(), seed)
    return result


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BY_PLACE = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order, by sorting: for long arrays many times as fast as a hash table."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def segment_ids(offsets: np.ndarray) -> np.ndarray:
    """For each element, the number of the segment that holds it."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


REPEATED = 1000


def row_of(docs: DataFrame) -> Column:
    """What tells rows apart that share a doc_id: a hash of the text where the key occurs more than once, else 0.

    Rows that share key and text are one document. The keys that repeat are named in the expression if they are few; if
    not, every text is hashed.
    """
    key = F.col("doc_id").cast("long")
    twice = docs.select(key.alias("doc_id")).where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(REPEATED + 1).collect()
    none, text = F.lit(0).cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    if not twice:
        return none
    return text if len(twice) > REPEATED else F.when(key.isin([r.doc_id for r in twice]), text).otherwise(none)


def keep_rows(docs: DataFrame, wanted: DataFrame, how: str, row: Column) -> DataFrame:
    """Rows of docs whose (doc_id, row_of()) is (left_semi) or isn't (left_anti) in ``wanted`` (doc_id, row), with the columns of docs alone."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    whole = docs.select(F.struct(*(docs[c].alias(n) for c, n in zip(docs.columns, names))).alias("__all"), F.col("doc_id").cast("long").alias("__doc"), row.alias("__row"))
    met = (F.col("__doc") == F.col("__doc_wanted")) & (F.col("__row") == F.col("__row_wanted"))
    found = whole.join(wanted.select(F.col("doc_id").alias("__doc_wanted"), F.col("row").alias("__row_wanted")), met, how)
    return found.select(*(F.col(f"__all.{n}").alias(c) for c, n in zip(docs.columns, names)))


def distinct_rows(docs: DataFrame, row: Column) -> DataFrame:
    """docs with one row of those that share a doc_id (null counts as one) and a text. Only texts that repeat move, and copies meet before they do."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(row).alias("row"), F.col("text").isNull().alias("bare")]
    twice = docs.select(*key).groupBy("doc_id", "row", "bare").count().where("count > 1")
    twice = Scratch(docs.sparkSession).save(twice.select(F.col("doc_id").alias("t_doc"), F.col("row").alias("t_row"), F.col("bare").alias("t_bare")), "twice")
    if twice.isEmpty():
        return docs
    names = [f"c{i}" for i in range(len(docs.columns))]
    whole = docs.select(*key, F.struct(*(docs[c].alias(n) for c, n in zip(docs.columns, names))).alias("__all"))
    met = F.col("doc_id").eqNullSafe(F.col("t_doc")) & (F.col("row") == F.col("t_row")) & (F.col("bare") == F.col("t_bare"))
    once = whole.join(twice, met, "left_anti").select("__all")
    again = whole.join(twice, met, "left_semi").withColumn("whole_text", F.col(f"__all.{names[docs.columns.index('text')]}")).groupBy("doc_id", "row", "bare", "whole_text").agg(F.first("__all").alias("__all")).select("__all")
    return once.union(again).select(*(F.col(f"__all.{n}").alias(c) for c, n in zip(docs.columns, names)))


def block_pairs(rows: DataFrame, sizes: DataFrame, key: str, place: list[str], block: int) -> DataFrame:
    """Rows of groups too large for a task, spread so that every pair of a group meets in one run of about two blocks.

    ``sizes`` (key, n) names the groups. Each row goes to a block of its group and with it to the runs of that block
    with each other one: ``run`` names a run, ``side`` is 0 or 1 for rows that meet those of the other side alone and -1
    in a run of one block.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = rows.join(sizes.select(F.col(key).alias("__key"), blocks.alias("__blocks")), F.col(key) == F.col("__key")).withColumn("__mine", F.pmod(F.xxhash64(*place), F.col("__blocks")).cast("int"))
    spread = mine.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    side = F.when(F.col("__other") == F.col("__mine"), -1).when(F.col("__mine") < F.col("__other"), 0).otherwise(1)
    run = F.xxhash64(key, F.least("__mine", "__other"), F.greatest("__mine", "__other"))
    return spread.withColumn("run", run).withColumn("side", side.cast("int")).select(*rows.columns, "run", "side")


def runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole runs of equal keys, from batches sorted by key. A run over many batches is joined once, when it ends."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        other = np.flatnonzero(x[key] != x[key][-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if held and (cut or held[-1][key][-1] != x[key][0]):
            if cut:
                held.append({c: v[:cut] for c, v in x.items()})
            yield {c: np.concatenate([h[c] for h in held]) for c in names}
            held = []
        elif cut:
            yield {c: v[:cut] for c, v in x.items()}
        held.append({c: v[cut:] for c, v in x.items()})
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in names}
