"""Spans in texts: overlap joins, exclusive selection, carried references and one-to-one alignment of annotations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.scalars import fold

WEIGHTS = {"source_offsets": 1000, "source_overlap": 750, "exact_span": 500, "span_containment": 250, "normalised_citation": 20, "appno": 5}


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """Pairs of spans of one document that overlap. Both sides are spread over cells of ``width`` characters, so the join is an
    equality; a pair that shares several cells counts in the first."""
    cells = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / width)))
    a = left.withColumn("cell", cells("start", "end"))
    b = right.select(key, F.col("start").alias("r_start"), F.col("end").alias("r_end"), *(F.col(c) for c in right.columns if c not in (key, "start", "end"))).withColumn("cell", cells("r_start", "r_end"))
    meet = (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    return a.join(b, [key, "cell"]).where(meet & (F.col("cell") == F.floor(F.greatest("start", "r_start") / width))).drop("cell")


def select_spans(spans: DataFrame, group: list[str]) -> DataFrame:
    """In each group the spans that stand when taken by start, then strength, then length, each dropping later ones that overlap it."""
    schema = spans.schema

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.assign(__len=pdf["start"] - pdf["end"]).sort_values(["start", "strength", "__len"], ascending=[True, False, True], kind="stable")
        reach, keep = -1, []
        for i, start, end in zip(order.index, order["start"], order["end"]):
            if start >= reach:
                keep.append(i)
                reach = end
        return pdf.loc[keep]

    return spans.groupBy(*group).applyInPandas(lambda pdf: choose(pdf), schema)


def carry_back_references(occurrences: DataFrame, cue: str = r"(?iu)^(?:ibid\.?|loc\.\s*cit\.?|idem)$") -> DataFrame:
    """Back references with the target of the nearest earlier strong or carried occurrence of their block, else of the block before when
    that has one target alone. ``occurrences`` has doc_id, block_idx, start, raw_text, target."""
    marked = occurrences.withColumn("back", F.col("raw_text").rlike(cue))
    prior = F.last(F.when(~F.col("back"), F.col("target")), True).over(Window.partitionBy("doc_id", "block_idx").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    only = marked.where(~F.col("back") & F.col("target").isNotNull()).groupBy("doc_id", (F.col("block_idx") + 1).alias("block_idx")).agg(F.collect_set("target").alias("before"))
    joined = marked.withColumn("prior", prior).join(only, ["doc_id", "block_idx"], "left")
    carried = F.coalesce(F.col("prior"), F.when(F.size("before") == 1, F.col("before")[0]))
    return joined.withColumn("target", F.when(F.col("back"), carried).otherwise(F.col("target"))).withColumn("carried", F.col("back") & carried.isNotNull()).drop("back", "prior", "before")


def _alnum(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def alignment_scores(annotations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Evidence for pairs of one document: annotations (annotation_id, doc_id, start, end, span, citation, appnos) and candidates
    (candidate_id, doc_id, start, end, raw, context, appnos)."""
    a = annotations.select("annotation_id", "doc_id", F.col("start").alias("a0"), F.col("end").alias("a1"), _alnum(F.col("span")).alias("span"), _alnum(F.col("citation")).alias("citation"), F.col("appnos").alias("want"))
    c = candidates.select("candidate_id", "doc_id", F.col("start").alias("c0"), F.col("end").alias("c1"), _alnum(F.col("raw")).alias("raw"), _alnum(F.col("context")).alias("context"), F.col("appnos").alias("have"))
    same = (F.col("a0") == F.col("c0")) & (F.col("a1") == F.col("c1"))
    overlap = F.greatest("a0", "c0") < F.least("a1", "c1")
    filled = lambda x: F.col(x) != ""
    methods = F.array_compact(
        F.array(
            F.when(same, "source_offsets").when(overlap, "source_overlap"),
            F.when(filled("span") & (F.col("raw") == F.col("span")), "exact_span").when(filled("span") & filled("raw") & (F.contains("raw", "span") | F.contains("span", "raw")), "span_containment"),
            F.when(filled("citation") & ((F.col("citation") == F.col("raw")) | F.contains("context", "citation")), "normalised_citation"),
            F.when(F.arrays_overlap("want", "have"), "appno"),
        )
    )
    weight = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    rows = a.join(c, "doc_id").withColumn("methods", methods).where(F.size("methods") > 0)
    score = F.aggregate("methods", F.lit(0), lambda s, m: s + F.element_at(weight, m))
    family = F.when(F.array_contains("methods", "source_offsets") | F.array_contains("methods", "source_overlap"), "strict_source_span").otherwise("normalised_context")
    return rows.select("doc_id", "annotation_id", "candidate_id", score.alias("score"), "methods", family.alias("family"))


def align(scores: DataFrame) -> DataFrame:
    """Each annotation proposes its unique best candidate; of proposals to one candidate the highest score wins, where leaders tie they
    abstain and the next one wins."""
    best = scores.withColumn("__m", F.max("score").over(Window.partitionBy("annotation_id"))).where("score = __m").drop("__m")
    proposals = best.withColumn("__n", F.count("*").over(Window.partitionBy("annotation_id"))).where("__n = 1").drop("__n")
    level = proposals.withColumn("__t", F.count("*").over(Window.partitionBy("candidate_id", "score"))).where("__t = 1").drop("__t")
    return level.withColumn("__r", F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc("score")))).where("__r = 1").drop("__r")
