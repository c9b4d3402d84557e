"""Deduplication, latest records, upserts, resumption and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each non-empty key; rows without a key all stay."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    empty = F.col(key).isNull() | (F.col(key).cast("string") == "")
    return df.withColumn("__r", rank).where(empty | (F.col("__r") == 1)).drop("__r")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as one grouped maximum (no sort)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def upsert(log: DataFrame, changes: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """A log with changed records replaced at their key's last place and new ones appended; records without a key are appended."""
    w = Window.partitionBy(key)
    last = log.withColumn("__last", F.max(seq).over(w) == F.col(seq))
    new = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[c for c in changes.columns if c != key]), seq).alias("__new"), F.min(seq).alias("__at"))
    joined = last.join(new.drop("__at"), key, "left")
    hit = F.col("__last") & F.col("__new").isNotNull() & F.col(key).isNotNull()
    kept = joined.select(*(F.col(c) if c in (key, seq) else F.when(hit, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in log.columns))
    end = log.agg(F.coalesce(F.max(seq), F.lit(0)).alias("__end"))
    fresh = new.join(log.select(key).distinct(), key, "left_anti").select(key, "__new.*", "__at").withColumn(seq, F.col("__at")).drop("__at")
    added = fresh.select(*log.columns).unionByName(changes.where(F.col(key).isNull()).select(*log.columns))
    return kept.unionByName(added.crossJoin(F.broadcast(end)).withColumn(seq, F.col("__end") + F.col(seq)).drop("__end"))


def unprocessed(items: DataFrame, log: DataFrame, key: str, done: Column | None = None) -> DataFrame:
    """Items without a finished record in the log."""
    return items.join((log if done is None else log.where(done)).select(key).distinct(), key, "left_anti")


def stratified_sample(df: DataFrame, stratum: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """In each stratum its share of ``size``, rounded down but one at least, topped up to ``size`` from the rest; picked by a hash of the key."""
    turn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    counts = df.groupBy(stratum).agg(F.count("*").alias("__n"))
    quota = counts.crossJoin(F.broadcast(counts.agg(F.sum("__n").alias("__all")))).select(F.col(stratum).alias("__s"), F.greatest(F.lit(1), F.floor(F.lit(size) * F.col("__n") / F.col("__all"))).alias("__q"))
    ranked = df.withColumn("__turn", turn).withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy("__turn", key)))
    marked = ranked.join(F.broadcast(quota), F.col(stratum).eqNullSafe(F.col("__s"))).withColumn("__in", F.col("__r") <= F.col("__q"))
    taken = marked.where("__in")
    short = size - taken.count()
    if short > 0:
        taken = taken.unionByName(marked.where("not __in").orderBy("__turn", key).limit(short))
    return taken.select(*df.columns)


def running_budget(df: DataFrame, group: list[str], order: list[str], amount: str, cap: float) -> DataFrame:
    """Running totals in order, and whether each step still lies within the cap."""
    total = F.sum(amount).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", total).withColumn("within", F.col("running") <= cap)


def require_unique(df: DataFrame, key: str) -> None:
    """Raises where two rows share a non-null key."""
    twice = df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()
    if twice:
        raise ValueError(f"{key} isn't unique: {[r[0] for r in twice]}")


def run_totals(records: DataFrame) -> DataFrame:
    """Counts by status and sums of tokens and cost of a result log."""
    return records.agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("error"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"),
    )
