"""Agreement and classification measures over paired labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, gold: str, predicted: str) -> DataFrame:
    return pairs.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(gold).cast("string").alias("gold"), F.col(predicted).cast("string").alias("pred")).agg(F.count("*").alias("n"))


def _margins(pairs: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Per label: gold count, predicted count and agreements, from the small confusion table."""
    table = confusion(pairs, gold, predicted)
    ends = table.select(F.col("gold").alias("label"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"))
    ends = ends.union(table.select("pred", F.lit(0).cast("long"), "n", F.lit(0).cast("long")))
    return ends.groupBy("label").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum("hit").alias("hit"))


def macro_f1(pairs: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Mean F1 over all labels of either side."""
    f1 = 2.0 * F.col("hit") / (F.col("g") + F.col("p"))
    return _margins(pairs, gold, predicted).agg(F.round(F.avg(f1), 6).alias("macro_f1"), F.count("*").alias("labels"))


def kappa(pairs: DataFrame, gold: str, predicted: str, least: int = 5) -> DataFrame:
    """Cohen's kappa, agreement in percent and number of pairs; no row with fewer than ``least`` pairs."""
    m = _margins(pairs, gold, predicted).agg(F.sum("g").alias("n"), F.sum("hit").alias("hit"), F.sum(F.col("g").cast("double") * F.col("p")).alias("chance"))
    observed, expected = F.col("hit") / F.col("n"), F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    value = F.when(expected == 1, F.lit(1.0)).otherwise((observed - expected) / (1 - expected))
    return m.where(F.col("n") >= least).select("n", F.round(100 * observed, 4).alias("agreement_pct"), F.round(value, 6).alias("kappa"))


def nominal_alpha(pairs: DataFrame, gold: str, predicted: str) -> DataFrame:
    """1 - observed / expected disagreement over pooled labels, without small-sample correction."""
    m = _margins(pairs, gold, predicted)
    t = m.agg(F.sum("g").alias("n"), F.sum("hit").alias("hit"), F.sum(F.pow((F.col("g") + F.col("p")).cast("double"), 2.0)).alias("squares"))
    disagreement, expected = 1 - F.col("hit") / F.col("n"), 1 - F.col("squares") / F.pow(2.0 * F.col("n"), F.lit(2.0))
    return t.select("n", F.round(F.when(expected == 0, F.lit(1.0)).otherwise(1 - disagreement / expected), 6).alias("alpha"))


def one_to_one(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Pairs that are each side's unique best: a tie on either side leaves both unpaired."""
    best = lambda k, name: pairs.groupBy(k).agg(F.max(score).alias(name))
    tops = pairs.join(best(left, "__l"), left).join(best(right, "__r"), right).where((F.col(score) == F.col("__l")) & (F.col(score) == F.col("__r")))
    alone = lambda k: tops.groupBy(k).count().where("count = 1").select(k)
    return tops.join(alone(left), left, "left_semi").join(alone(right), right, "left_semi").select(left, right, score)


def quote_evidence(quotes: DataFrame, texts: DataFrame, text: str = "text", quote: str = "quote") -> DataFrame:
    """Quotes with their documents: at the claimed place, or once anywhere (then its place), or not verified."""
    joined = quotes.join(texts, "doc_id")
    times = ((F.length(text) - F.length(F.replace(F.col(text), F.col(quote), F.lit("")))) / F.length(quote)).cast("int")
    exact = F.substr(F.col(text), F.col("start") + 1, F.length(quote)) == F.col(quote)
    status = F.when(exact, "exact").when(times == 1, "relocated").when(times == 0, "missing").otherwise("ambiguous")
    return joined.withColumn("status", status).withColumn("found_at", F.when(exact, F.col("start")).when(times == 1, F.instr(F.col(text), F.col(quote)) - 1)).drop(text)


def find_quotes(texts: DataFrame, quotes: DataFrame, key: str = "doc_id", quote_key: str = "item_id", gram: int = 4) -> DataFrame:
    """Which texts (key, text) hold which quotes (quote_key, quote), character by character: rows (key, quote_key, place, times), places from 0.

    Each quote is looked for by the least hash of its runs of ``gram`` words, without its outer words, which a text may
    print as part of longer ones; texts that have that run too are then compared with the quote. Quotes of fewer words
    are compared with every text that is as long.
    """
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    runs = lambda w, n: F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(*(F.get(w, i - 1 + j) for j in range(gram))))
    q = quotes.where(F.length("quote") > 0).withColumn("__w", split(F.col("quote"))).withColumn("__n", F.size("__w") - 2 - gram + 1)
    long = q.where("__n > 0").withColumn("__w", F.slice("__w", 2, F.size("__w") - 2)).withColumn("__run", F.array_min(runs(F.col("__w"), F.col("__n")))).select(quote_key, "quote", "__run")
    mine = texts.where("text is not null").select(key, split(F.col("text")).alias("__w")).withColumn("__n", F.size("__w") - gram + 1).where("__n > 0")
    # only hashes meet; texts are read again for those that have a quote's run
    hits = mine.select(key, F.explode(F.array_distinct(runs(F.col("__w"), F.col("__n")))).alias("__run")).join(long, "__run").select(key, quote_key, "quote")
    found = hits.join(texts.select(key, "text"), key)
    short = q.where("__n <= 0").select(quote_key, "quote")
    if not short.isEmpty():
        found = found.unionByName(texts.select(key, "text").join(short, F.contains("text", "quote")).select(key, quote_key, "quote", "text"))
    times = ((F.length("text") - F.length(F.replace(F.col("text"), F.col("quote"), F.lit("")))) / F.length("quote")).cast("int")
    return found.withColumn("place", F.instr(F.col("text"), F.col("quote")) - 1).where("place >= 0").select(key, quote_key, "place", times.alias("times"))
