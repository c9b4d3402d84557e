"""Dimension tables: execution documents, language versions, keypoints, official lists, rosters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions import scalars as S
from docketlake.sources.scratch import written

BUCKETS = {
    "action_plans": ("acp",), "action_reports": ("acr",), "communications": ("obs", "apo", "gvo", "eo", "ngo", "nhri", "igo", "nto", "oorg", "oo"),
    "committee_documents": ("CMDEC", "CMINF", "CMNOT", "HEXEC"), "resolutions": ("res", "EXECUTION", "MERITS"),
}
CODES = ("CEC", *(c for codes in BUCKETS.values() for c in codes))


def collection_code(packed: Column) -> Column:
    """The first known code of a packed field, else its first piece; NULL gives ''."""
    pieces = F.transform(F.split(F.coalesce(packed, F.lit("")), ";"), lambda p: F.trim(p))
    return F.coalesce(F.get(F.filter(pieces, lambda p: p.isin(*CODES)), F.lit(0)), F.get(pieces, F.lit(0)))


def document_type(title: Column) -> Column:
    """Type of an execution document from its title: the first rule that holds."""
    t = F.lower(title)
    has = lambda *words: t.rlike("|".join(map(re.escape, words)))
    mail = has("communication")
    return (
        F.when(has("action plan", "plan d'action"), "acp")
        .when(has("action report", "bilan d'action", "rapport d'action"), "acr")
        .when(has("decision", "décision") & has("committee", "comité", "cm"), "CMDEC")
        .when(has("resolution", "résolution"), "EXECUTION")
        .when(has("memo", "mémo"), "HEXEC")
        .when(mail & has("ngo", "ong", "non-gouvernement"), "ngo")
        .when(mail & has("national human rights", "nhri", "indh"), "nhri")
        .when(mail & has("applicant", "requérant"), "apo")
        .when(mail & has("government", "authorities", "gouvernement", "autorités"), "gvo")
        .otherwise("unknown")
    )


def execution_cases(cases: DataFrame, documents: DataFrame, key: str = "appno") -> DataFrame:
    """Case rows with their documents in five nested lists, from one grouping of the documents."""
    row = F.struct("document_id", "title", "collection")
    docs = documents.withColumn("collection", collection_code(F.col("collection")))
    lists = [F.array_sort(F.collect_list(F.when(F.col("collection").isin(*codes), row))).alias(name) for name, codes in BUCKETS.items()]
    joined = cases.join(docs.groupBy(key).agg(*lists), key, "left")
    kind = "array<struct<document_id:string,title:string,collection:string>>"
    return joined.select(*cases.columns, *(F.coalesce(F.col(name), F.array().cast(kind)).alias(name) for name in BUCKETS))


def filter_execution(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal to every filter given (state, supervision, is_closed, case_type, master_group_id, collection, language, appno)."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.array_contains("appno", value) if name == "appno" else F.col(name) == value)
    return df


def link_applications(judgments: DataFrame, executions: DataFrame) -> DataFrame:
    """Judgment and execution rows side by side for every application number that either has."""
    spread = lambda df, name: df.select(F.explode(S.normalise_appnos(F.col("appno"))).alias("appno"), F.struct(*df.columns).alias(name))
    return spread(judgments, "judgment").join(spread(executions, "execution"), "appno", "full")


def versions(cases: DataFrame) -> DataFrame:
    """What each record is (judgment, decision, ...) and how it renders it: official text or summary, translation or translated summary."""
    lang, kind, title = F.upper(F.coalesce("language", F.lit(""))), F.upper(F.coalesce("doctype", F.lit(""))), F.lower(F.coalesce("docname", F.lit("")))
    clin = kind.isin("CLIN", "CLINF")
    summary, translation = clin | title.contains("summary"), ~lang.isin("ENG", "FRE") | title.contains("translation")
    document = F.when(clin, "legal_summary").when(kind.contains("JUD"), "judgment").when(kind.contains("DEC"), "decision").when(kind.contains("ADO"), "advisory_opinion").when(kind.contains("RES"), "resolution").otherwise("other")
    rendition = F.when(summary & translation, "translated_summary").when(summary, "official_summary").when(translation, "translation").otherwise("official_text")
    return cases.select("*", document.alias("document_kind"), rendition.alias("rendition_kind"), summary.alias("is_summary"), translation.alias("is_translation"))


def looks_scanned(text: Column, pages: Column, least: int = 120) -> Column:
    """Whether a text layer is absent or unusable: under 20 characters, or under 40 a page of several, when under ``least`` in all."""
    n = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), S.SPACE, ""))
    return F.when(n >= least, False).when(n < 20, True).otherwise(F.coalesce((pages > 1) & (n / pages < 40), F.lit(False)))


def resolve_keypoint(keypoints: DataFrame, query: str) -> DataFrame:
    """Ids (id, label, parent) for a query: a number is itself, an exact label wins, else every label that contains it."""
    if str(query).strip().isdigit():
        return keypoints.sparkSession.createDataFrame([(str(query).strip(),)], "id string")
    q = str(query).strip().lower()
    exact = keypoints.where(F.lower("label") == q)
    return (keypoints.where(F.lower("label").contains(q)) if exact.isEmpty() else exact).select("id")


def search_keypoints(keypoints: DataFrame, text: str) -> DataFrame:
    """Ids and labels that contain the text, in any case; a keypoint without a label is never found."""
    return keypoints.where(F.contains(F.lower("label"), F.lit(text.lower()))).select("id", "label")


def keypoint_labels(rows: DataFrame, keypoints: DataFrame, column: str = "id") -> DataFrame:
    """Rows with the label of the keypoint that a column names, null where it has none."""
    named = keypoints.where("label is not null").select(F.col("id").alias("__id"), F.col("label").alias("keypoint_label"))
    return rows.join(named, F.col(column).cast("string") == F.col("__id"), "left").drop("__id")


def ancestors(keypoints: DataFrame) -> DataFrame:
    """Every keypoint with all keypoints above it, level by level, each a written table; a cycle ends where it would repeat.

    Levels are merged with the table, not sent whole to the driver and all tasks, as would happen every round to files that compress well.
    """
    up = written(keypoints.where("parent is not null").select("id", "parent"))
    step = up.select(F.col("id").alias("__from"), F.col("parent").alias("__next"))
    level = up.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"), F.array("id", "parent").alias("path"))
    found = []
    while True:
        level = written(level)
        found.append(level.select("id", "ancestor", "distance"))
        level = level.join(step.hint("merge"), F.col("ancestor") == F.col("__from")).where(~F.array_contains("path", F.col("__next")))
        level = level.select("id", F.col("__next").alias("ancestor"), (F.col("distance") + 1).alias("distance"), F.concat("path", F.array("__next")).alias("path"))
        if level.isEmpty():
            return reduce(DataFrame.union, found)


def merge_authorities(editions: DataFrame) -> DataFrame:
    """Rows of official lists united by normalised citation: the first edition's row wins, later ones fill its gaps.

    ``editions`` has edition, language, citation, ecli, itemid; ``equivalent`` names the other language's citation where exactly one row
    of each language shares an identifier.
    """
    rows = editions.withColumn("key", S.reference_key("citation"))
    first = lambda c: F.first(c, ignorenulls=True).over(Window.partitionBy("language", "key").orderBy("edition").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    turn = F.row_number().over(Window.partitionBy("language", "key").orderBy("edition"))
    merged = rows.withColumn("ecli", first("ecli")).withColumn("itemid", first("itemid")).withColumn("__t", turn).where("__t = 1").drop("__t", "edition")
    sides = merged.where("ecli is not null").groupBy("ecli").agg(F.count_if(F.col("language") == "eng").alias("e"), F.count_if(F.col("language") == "fra").alias("f"), F.max(F.when(F.col("language") == "eng", F.col("citation"))).alias("eng"), F.max(F.when(F.col("language") == "fra", F.col("citation"))).alias("fra"))
    pairs = sides.where("e = 1 and f = 1").select("ecli", "eng", "fra")
    return merged.join(pairs, "ecli", "left").withColumn("equivalent", F.when(F.col("language") == "eng", F.col("fra")).otherwise(F.col("eng"))).select("language", "citation", "key", "ecli", "itemid", "equivalent")


def match_roster(names: DataFrame, roster: DataFrame) -> DataFrame:
    """Judges (name) with the roster row (name, country, first_year, last_year, ad_hoc) of the same folded name."""
    key = lambda c: F.trim(F.regexp_replace(S.fold(c), "[^a-z]+", " "))
    table = roster.select(key("name").alias("__k"), *(c for c in roster.columns if c != "name")).dropDuplicates(["__k"])
    return names.withColumn("__k", key("name")).join(table, "__k", "left").drop("__k")


def match_external(names: DataFrame, entries: str = "external_sources", name: str = "cited_name") -> DataFrame:
    """Names with the first packed entry of their row that holds every distinctive word (4 letters or more) of the name."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col(name)), F.lit(r"(?U)\p{L}{4,}"), F.lit(0)))
    tokens = F.array_except(tokens, F.array(*(F.lit(w) for w in ("case", "affaire", "contre", "against", "others", "autres", "strasbourg"))))
    listed = F.filter(S.distinct_list(F.col(entries)), lambda e: ~F.lower(e).contains("strasbourg") & F.forall(F.col("__tokens"), lambda w: F.contains(F.lower(e), w)))
    return names.withColumn("__tokens", tokens).withColumn("matched", F.when(F.size("__tokens") > 0, F.get(listed, F.lit(0)))).drop("__tokens")
