"""Search, browsing and profiles of tables."""

from __future__ import annotations

import csv
import io
import json
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.functions.scalars import snippet


def text_search(texts: DataFrame, query: str, key: str, limit: int | None = None) -> DataFrame:
    """Texts that contain the literal query in any case, with a snippet, in order of the key."""
    found = texts.where(F.contains(F.lower("text"), F.lit(query.lower()))).withColumn("snippet", snippet(F.col("text"), F.lit(query)))
    return found if limit is None else found.orderBy(key).limit(limit)


def party_search(cases: DataFrame, pattern: str, columns: list[str]) -> DataFrame:
    """Rows with a match of the regular expression, in any case, in one of the columns."""
    return cases.where(reduce(lambda a, b: a | b, (F.coalesce(F.col(c).rlike("(?iu)" + pattern), F.lit(False)) for c in columns)))


def citation_search(edges: DataFrame, pattern: str, direction: str) -> DataFrame:
    """Edges whose source (``citing``) or target (``cited-by``) matches."""
    return party_search(edges, pattern, [{"citing": "source", "cited-by": "target"}[direction]])


def filter_rows(df: DataFrame, date_column: str, date_from=None, date_to=None, respondent: str | None = None) -> DataFrame:
    """Inclusive dates (a missing date fails both) and a respondent pattern."""
    if date_from is not None:
        df = df.where(F.col(date_column) >= F.lit(date_from))
    if date_to is not None:
        df = df.where(F.col(date_column) <= F.lit(date_to))
    return df if respondent is None else party_search(df, respondent, ["respondent"])


def enrich(hits: DataFrame, cases: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Hits with columns of their case; hits without one stay."""
    return hits.join(cases.select(key, *columns), key, "left")


def categories(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def medians(df: DataFrame, names: list[str], most: int = 200_000) -> dict[str, float | None]:
    """Exact medians of columns. Scans narrow each column to a range about its middle, by approximate quantiles, until so few
    distinct values lie in it that they can be ranked; what comes to the driver are bounds and ``most`` values at the most."""
    found: dict[str, float | None] = {}
    n = dict(zip(names, df.agg(*(F.count(c) for c in names)).first())) if names else {}
    bounds: dict[str, tuple] = {c: (None, None) for c in names if n[c]}
    found |= {c: None for c in names if not n[c]}
    while bounds:
        inside = {c: (F.lit(True) if lo is None else (F.col(c) >= F.lit(lo)) & (F.col(c) <= F.lit(hi))) for c, (lo, hi) in bounds.items()}
        wanted = {}
        for c, (lo, hi) in bounds.items():
            ranks = ((n[c] - 1) // 2, n[c] // 2)
            wanted[c] = ranks
        below = {c: F.lit(0).cast("long") if lo is None else F.count_if(F.col(c) < F.lit(lo)) for c, (lo, hi) in bounds.items()}
        sides = df.agg(*(F.struct(below[c].alias("below"), F.count_if(inside[c] & F.col(c).isNotNull()).alias("inside"), F.approx_count_distinct(F.when(inside[c], F.col(c))).alias("values")).alias(c) for c in bounds)).first()
        few = [c for c in bounds if sides[c]["values"] <= most // (2 * len(bounds))]
        if few:
            rows = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.when(inside[c], F.col(c)).cast("double").alias("v")) for c in few))).alias("r")).select("r.*").where("v is not null").groupBy("c", "v").count().collect()
            for c in few:
                at, mine = sides[c]["below"], sorted((r.v, r["count"]) for r in rows if r.c == c)
                middle = []
                for v, count in mine:
                    middle += [v for rank in wanted[c] if at <= rank < at + count]
                    at += count
                found[c] = sum(middle) / 2
                bounds.pop(c)
        rest = list(bounds)
        if rest:
            asked = []
            for c in rest:
                m, k = sides[c]["inside"], wanted[c][0] - sides[c]["below"]
                asked.append(F.percentile_approx(F.when(inside[c], F.col(c)), F.array(F.lit(max(0.0, k / m - 0.001)), F.lit(min(1.0, (k + 1) / m + 0.001))), F.lit(10_000)).alias(c))
            for c, (lo, hi) in zip(rest, df.agg(*asked).first()):
                if (lo, hi) == bounds[c]:  # no narrower range: one value fills it
                    found[c] = float(lo)
                    bounds.pop(c)
                else:
                    bounds[c] = (lo, hi)
    return found


def column_stats(df: DataFrame) -> DataFrame:
    """Minimum, maximum, mean and median of every numeric column."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    middle = medians(df, names)
    stats = df.agg(*(F.struct(F.min(c).cast("double").alias("minimum"), F.max(c).cast("double").alias("maximum"), F.round(F.avg(c), 6).alias("mean")).alias(c) for c in names))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("s"), F.round(F.lit(middle[c]).cast("double"), 6).alias("median")) for c in names))
    return stats.select(F.explode(rows).alias("r")).select("r.column", "r.s.*", "r.median")


def column_profile(df: DataFrame, most: int = 100) -> DataFrame:
    """Type, nulls and distinct values of every column; ``listed`` tells whether its values are few enough to list."""
    one = df.agg(*(F.struct(F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(F.col(c).cast("string")).alias("values")).alias(c) for c in df.columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(c).alias("s")) for c, t in df.dtypes))).alias("r")
    return one.select(rows).select("r.column", "r.type", "r.s.*").withColumn("listed", F.col("values") <= most)


def column_samples(df: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` least distinct values of every column, as strings, in order."""
    texts = [F.col(c).cast("string") for c in df.columns]
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), t.alias("value")) for c, t in zip(df.columns, texts)))).alias("r")).select("r.*").where("value is not null").distinct()
    turn = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    return rows.withColumn("__t", turn).where(F.col("__t") <= n).groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("samples"))


def run_search(mode: str, query: str, *, texts: DataFrame | None = None, cases: DataFrame | None = None, edges: DataFrame | None = None, key: str = "itemid", limit: int = 50, date_from=None, date_to=None, respondent: str | None = None) -> DataFrame:
    """Search by ``text``, ``party``, ``citing``, ``cited-by`` or ``list`` (categories of a column), with filters and a limit, in order of the key."""
    if mode == "text":
        found = text_search(texts, query, key)
        found = found if cases is None else enrich(found, cases, key, [c for c in cases.columns if c not in found.columns])
    elif mode == "party":
        found = party_search(cases, query, ["docname", "represented_by"])
    elif mode in ("citing", "cited-by"):
        found, key = citation_search(edges, query, mode), "source"
    elif mode == "list":
        return categories(cases, query).orderBy(F.desc("n"), "value").limit(limit)
    else:
        raise ValueError(f"no such search: {mode}")
    if mode in ("text", "party"):
        found = filter_rows(found, "kp_date", date_from, date_to, respondent)
    return found.orderBy(key).limit(limit)


def format_results(df: DataFrame, columns: list[str], limit: int = 50, fmt: str = "table", widths: dict[str, int] | None = None) -> str:
    """Up to ``limit`` rows of those columns that are there as a text table, CSV or JSON."""
    shown = [c for c in columns if c in df.columns]
    rows = [r.asDict(True) for r in df.select(*shown).limit(limit).collect()]
    if fmt == "json":
        return json.dumps(rows, ensure_ascii=False, default=str)
    if fmt == "csv":
        out = io.StringIO()
        writer = csv.DictWriter(out, shown, lineterminator="\n")
        writer.writeheader()
        writer.writerows(rows)
        return out.getvalue()
    if fmt != "table":
        raise ValueError(f"no such format: {fmt}")
    wide = {c: (widths or {}).get(c, 30) for c in shown}
    line = lambda r: "  ".join(str("" if r[c] is None else r[c]).replace("\n", " ")[: wide[c]].ljust(wide[c]) for c in shown).rstrip()
    return "\n".join([line({c: c for c in shown}), *map(line, rows)]) if rows else "no results"


def preview(df: DataFrame, limit: int = 20, fmt: str = "table") -> str:
    return format_results(df, df.columns, limit, fmt)


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    counts = categories(df.where(F.col(column).isNotNull()), column)
    whole = counts.agg(F.sum("n").alias("whole"))
    return counts.crossJoin(F.broadcast(whole)).select("value", "n", F.round(F.col("n") / F.col("whole"), 6).alias("share")).orderBy(F.desc("n"), "value").limit(n)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n", F.lit(len(df.columns)).alias("columns")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
