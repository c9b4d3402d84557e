"""Mixing sources to target weights that change over training.

Each source's weight is a piecewise linear schedule over training time 0 to 1. Its integral is the source's cumulative
token demand; inverting it at a document's place in its source's token order gives the document's position in
training, and a range sort by position gives the training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.common import Scratch

BROADCAST_SOURCES = 50_000
TOKENS = "coalesce(regexp_count(cast(text as string), '[^ \\\\t\\\\n\\\\r]+'), 0)"


def token_counts(docs: DataFrame, payload: bool = False) -> DataFrame:
    """Key, source and number of whitespace-separated tokens of each document, and its order in its source from a hash of the key; with ``payload`` the whole row too, as a struct."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary"))
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    more = [F.struct(*(docs[c] for c in docs.columns)).alias("payload")] if payload else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.expr(TOKENS).cast("long").alias("n_tokens"), key.alias("key"), *more)


def default_schedule(supply: DataFrame, temperature: float = 0.7) -> DataFrame:
    """From each source's share of tokens at the start to shares raised to ``temperature`` at the end."""
    knot = F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t")
    return supply.where("supply > 0").select("source", "supply", knot).select("source", "t", F.when(F.col("t") == 0, F.col("supply").cast("double")).otherwise(F.pow(F.col("supply").cast("double"), F.lit(temperature))).alias("weight"))


def training_positions(rows: DataFrame, counts: DataFrame, schedule: DataFrame | None = None, token_budget: float | None = None, bucket_digits: int = 3) -> DataFrame:
    """Each appearance in training of a row of ``rows``: epoch and position beside its own columns.

    ``rows`` and ``counts`` are both token_counts() of the same documents; sums are taken from ``counts``.

    ``schedule`` has rows (source, t, weight) at the same times, 0 and 1 among them, for every source; weights are
    normalised at each time and interpolated. ``token_budget`` is the length of training in tokens; None takes the
    least that uses every document of every scheduled source. Demand beyond a source's supply repeats it from the start
    (epoch 1, 2, ...), and documents beyond the demand are left out. A document stands at its middle token.

    The running token count in a source is a sum over buckets of the key's hash plus a sum within the bucket, so
    that a source of any size is spread over ``16 ** bucket_digits`` groups.
    """
    counts, rows = (x.withColumn("bucket", F.substring("key", 1, bucket_digits)) for x in (counts, rows))
    buckets = counts.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    supply = counts.groupBy("source").agg(F.sum("n_tokens").alias("supply"))
    knots = default_schedule(supply) if schedule is None else schedule.select("source", F.col("t").cast("double").alias("t"), F.col("weight").cast("double").alias("weight"))
    whole = knots.groupBy("t").agg(F.sum("weight").alias("whole"))
    knots = knots.join(whole, "t").select("source", "t", (F.col("weight") / F.col("whole")).alias("w"))
    by_time = Window.partitionBy("source").orderBy("t")
    parts = knots.select("source", F.col("t").alias("t0"), F.lead("t").over(by_time).alias("t1"), F.col("w").alias("w0"), F.lead("w").over(by_time).alias("w1")).where("t1 is not null")
    parts = parts.withColumn("area", (F.col("w0") + F.col("w1")) / 2 * (F.col("t1") - F.col("t0")))
    parts = parts.withColumn("start", F.coalesce(F.sum("area").over(Window.partitionBy("source").orderBy("t0").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    shares = parts.groupBy("source").agg(F.max(F.col("start") + F.col("area")).alias("share"))
    table = supply.join(shares, "source").where("share > 0")
    if token_budget is None:
        table = table.crossJoin(table.agg(F.max(F.col("supply") / F.col("share")).alias("budget")))
    else:
        table = table.withColumn("budget", F.lit(float(token_budget)))
    table = table.join(parts, "source").groupBy("source", "supply", "share", "budget").agg(F.sort_array(F.collect_list(F.struct("t0", "t1", "w0", "w1", "area", "start"))).alias("parts"))
    # as many rows as there are sources; a join by source would gather the largest source in one task
    table = Scratch(rows.sparkSession).save(table.withColumnRenamed("source", "s_source"), "schedule")
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)

    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(buckets, (F.col("source") == F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    placed = placed.withColumn("middle", F.col("base") + F.sum("n_tokens").over(within) - F.col("n_tokens") / 2)
    placed = placed.join(table, F.col("source") == F.col("s_source"))
    demand = F.col("budget") * F.col("share") * (1 + 1e-12)
    last = F.when(F.col("supply") > 0, F.floor((demand - F.col("middle")) / F.col("supply"))).otherwise(F.lit(-1))
    placed = placed.where(F.col("middle") <= demand).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), last).cast("long"))))
    x = (F.col("middle") + F.col("epoch") * F.col("supply")) / F.col("budget")
    placed = placed.withColumn("x", x)
    part = F.expr("element_at(filter(parts, (p, i) -> p.start <= x or i = 0), -1)")
    placed = placed.withColumn("p", part)
    c = F.greatest(F.col("x") - F.col("p.start"), F.lit(0.0))
    a = (F.col("p.w1") - F.col("p.w0")) / (2 * (F.col("p.t1") - F.col("p.t0")))
    root = F.sqrt(F.greatest(F.col("p.w0") * F.col("p.w0") + 4 * a * c, F.lit(0.0)))
    at = F.when(c == 0, F.lit(0.0)).otherwise(2 * c / (F.col("p.w0") + root))
    return placed.withColumn("position", F.round(F.least(F.col("p.t0") + at, F.lit(1.0)), 9))


def mix_sources(docs: DataFrame, schedule: DataFrame | None = None, token_budget: float | None = None) -> DataFrame:
    """Training positions of the documents' appearances, range-sorted by position; see training_positions().

    Null or empty texts have no tokens: they stand where their neighbours do, and a source without any token is left
    out. A null source counts as the source '', a source without a schedule is left out. Null keys come first within
    their hash bucket. Repeated rows are documents of their own. Other columns aren't read. An empty table gives no rows.
    """
    counts = Scratch(docs.sparkSession).save(token_counts(docs), "counts")
    placed = training_positions(counts, counts, schedule, token_budget)
    return placed.select("doc_id", "source", "n_tokens", "epoch", "position").repartitionByRange("position").sortWithinPartitions("position", "doc_id", "epoch")


def mix_documents(docs: DataFrame, schedule: DataFrame | None = None, token_budget: float | None = None) -> DataFrame:
    """The documents themselves, with all their columns, once for each appearance and range-sorted by position.

    Rows are as defined for mix_sources(). The texts move twice: to their hash bucket and to their place.
    """
    counts = Scratch(docs.sparkSession).save(token_counts(docs), "counts")
    placed = training_positions(token_counts(docs, payload=True), counts, schedule, token_budget)
    return placed.select("payload", "position", "epoch", "doc_id").repartitionByRange("position").sortWithinPartitions("position", "doc_id", "epoch").select("payload.*")


SQL = """
WITH c AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS n_tokens, md5(doc_id::VARCHAR) AS key FROM documents
), s AS (SELECT source, sum(n_tokens)::DOUBLE AS supply FROM c GROUP BY source HAVING sum(n_tokens) > 0),
w AS (SELECT source, supply, supply / sum(supply) OVER () AS w0, pow(supply, 0.7) / sum(pow(supply, 0.7)) OVER () AS w1 FROM s),
g AS (SELECT *, max(supply / ((w0 + w1) / 2)) OVER () AS budget FROM w),
m AS (SELECT c.*, supply, w0, w1, budget, sum(n_tokens) OVER (PARTITION BY source ORDER BY key, doc_id) - n_tokens / 2 AS middle FROM c JOIN g USING (source)),
e AS (
  SELECT *, unnest(range(0, greatest(0, floor((budget * (w0 + w1) / 2 * (1 + 1e-12) - middle) / supply))::BIGINT + 1)) AS epoch
  FROM m WHERE middle <= budget * (w0 + w1) / 2 * (1 + 1e-12)
), x AS (SELECT *, (middle + epoch * supply) / budget AS c, (w1 - w0) / 2 AS a FROM e)
SELECT doc_id, source, n_tokens::BIGINT AS n_tokens, epoch, round(least(CASE WHEN c = 0 THEN 0 ELSE 2 * c / (w0 + sqrt(w0 * w0 + 4 * a * c)) END, 1), 9) AS position FROM x
"""
