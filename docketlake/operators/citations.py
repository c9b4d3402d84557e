"""Printed references: parsing, catalogues of targets, conservative resolution, occurrences and pinpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions import scalars as S


def mentions(cases: DataFrame, refs: str = "scl") -> DataFrame:
    """One row per packed reference of each case, in order, with everything the reference itself prints."""
    rows = cases.select("itemid", "ecli", F.posexplode(S.split_list(F.col(refs))).alias("pos", "raw")).withColumn("raw", F.trim(F.regexp_replace("raw", S.SPACE, " ")))
    return rows.select(
        F.col("itemid").alias("source_itemid"), S.node_id(F.col("ecli"), F.col("itemid")).alias("source_node"), F.col("pos").alias("ordinal"), F.col("raw").alias("raw_ref"),
        S.reference_name(F.col("raw")).alias("cited_name"), F.array_distinct(F.regexp_extract_all("raw", F.lit(S.LONG_APPNO), F.lit(1))).alias("appnos"),
        F.upper(F.nullif(F.regexp_extract("raw", r"(?i)\b(ECLI:[A-Z]{2}:[A-Z]+:\d{4}:[0-9A-Z]+)", 1), F.lit(""))).alias("explicit_ecli"),
        F.nullif(F.regexp_extract("raw", r"\b(001-\d+)\b", 1), F.lit("")).alias("explicit_itemid"), S.reference_date(F.col("raw")).alias("target_date"),
        S.phase(F.col("raw")).alias("phase"), S.document_kind(F.col("raw")).alias("kind"), S.reporter(F.col("raw")).alias("reporter"), F.col("raw").contains("[GC]").alias("grand_chamber"),
        F.sha2(F.concat_ws("|", "itemid", F.col("pos").cast("string"), "raw"), 256).alias("mention_id"),
    )


def catalog(cases: DataFrame) -> DataFrame:
    """Keys of every target: (key_type, key, node), from application numbers, ECLI, itemid and normalised title. Keys are added, never replaced."""
    base = cases.select("itemid", S.normalise_ecli(F.col("ecli")).alias("ecli"), S.node_id(F.col("ecli"), F.col("itemid")).alias("node"), S.normalise_appnos(F.col("appno")).alias("appno"), S.normalise_title(F.col("docname")).alias("title"))
    pair = lambda kind, value: F.struct(F.lit(kind).alias("key_type"), value.alias("key"))
    keys = F.concat(F.transform("appno", lambda a: pair("appno", a)), F.array(pair("ecli", F.col("ecli")), pair("itemid", F.col("itemid")), pair("title", F.col("title"))))
    return base.select("node", F.explode(keys).alias("k")).select("k.key_type", "k.key", "node").where("key is not null and key <> ''").distinct()


def display_rows(cases: DataFrame) -> DataFrame:
    """One row per node to show: no placeholder before English before the least itemid."""
    rest = [c for c in cases.columns]
    order = F.struct(F.coalesce("is_placeholder", F.lit(False)), F.coalesce(F.upper("language") != "ENG", F.lit(True)), "itemid")
    return cases.withColumn("node", S.node_id(F.col("ecli"), F.col("itemid"))).groupBy("node").agg(F.min_by(F.struct(*rest), order).alias("r")).select("node", "r.*")


def resolve(found: DataFrame, keys: DataFrame, metadata: DataFrame) -> DataFrame:
    """Mentions with ``status`` and ``target_node``; nothing is guessed.

    Explicit identifiers decide first (conflicting ones are a conflict). Application numbers come next, titles last; candidates
    whose date contradicts a printed one are dropped, and a candidate of the mention's own document never counts. One node left is
    resolved, more are ambiguous, none is unresolved. ``metadata`` has node and kp_date.
    """
    m = found.select("mention_id", "source_node", "explicit_ecli", "explicit_itemid", "appnos", F.nullif(S.normalise_title(F.col("cited_name")), F.lit("")).alias("title"), "target_date")
    pair = lambda level, kind, value: F.struct(F.lit(level).alias("level"), F.lit(kind).alias("key_type"), value.alias("key"))
    wanted = F.concat(F.array(pair(0, "ecli", F.col("explicit_ecli")), pair(0, "itemid", F.col("explicit_itemid")), pair(2, "title", F.col("title"))), F.transform("appnos", lambda a: pair(1, "appno", a)))
    asked = m.select("mention_id", "source_node", "target_date", F.explode(wanted).alias("w")).select("mention_id", "source_node", "target_date", "w.*").where("key is not null")
    dates = metadata.groupBy("node").agg(F.collect_set("kp_date").alias("dates"))
    hits = asked.join(keys, ["key_type", "key"]).where(F.col("node") != F.col("source_node")).join(dates, "node", "left")
    fits = F.col("target_date").isNull() | F.col("dates").isNull() | (F.size("dates") == 0) | F.array_contains("dates", F.col("target_date"))
    levels = hits.where(fits).groupBy("mention_id", "level").agg(F.collect_set("node").alias("nodes"))
    best = levels.groupBy("mention_id").agg(F.min_by(F.struct("level", "nodes"), "level").alias("b"))
    status = F.when(F.col("b").isNull(), "unresolved").when(F.size("b.nodes") == 1, "resolved").when(F.col("b.level") == 0, "conflict").otherwise("ambiguous")
    by = F.get(F.array(F.lit("identifier"), F.lit("appno"), F.lit("title")), F.col("b.level"))
    return found.join(best, "mention_id", "left").withColumn("status", status).withColumn("target_node", F.when(F.col("status") == "resolved", F.col("b.nodes")[0])).withColumn("matched_by", F.when(F.col("status") == "resolved", by)).drop("b")


def resolve_simple(found: DataFrame, cases: DataFrame) -> DataFrame:
    """Resolution by application numbers alone: several documents among them leave the reference unresolved; a record in the source's language is preferred."""
    base = cases.select("itemid", F.upper("language").alias("lang"), S.node_id(F.col("ecli"), F.col("itemid")).alias("node"), F.explode(S.normalise_appnos(F.col("appno"))).alias("appno"))
    source = cases.select(F.col("itemid").alias("source_itemid"), F.upper("language").alias("source_lang"))
    asked = found.select("mention_id", "source_itemid", "source_node", F.explode("appnos").alias("appno")).join(source, "source_itemid", "left")
    hits = asked.join(base, "appno").where((F.col("itemid") != F.col("source_itemid")) & (F.col("node") != F.col("source_node")))
    one = hits.groupBy("mention_id").agg(F.count_distinct("node").alias("n"), F.min("node").alias("node"), F.min_by("itemid", F.struct(F.col("lang") != F.col("source_lang"), "itemid")).alias("itemid"))
    good = F.col("n") == 1
    return found.join(one, "mention_id", "left").withColumn("target_itemid", F.when(good, F.col("itemid"))).withColumn("target_node", F.when(good, F.col("node"))).withColumn("resolved", F.coalesce(good, F.lit(False))).drop("n", "node", "itemid")


def resolution_report(resolved: DataFrame) -> DataFrame:
    """Counts by status and completeness (1 without mentions)."""
    n = F.count("*")
    done = F.count_if(F.col("status") == "resolved")
    return resolved.agg(n.alias("mentions"), done.alias("resolved"), F.count_if(F.col("status") == "ambiguous").alias("ambiguous"), F.count_if(F.col("status") == "conflict").alias("conflicts"), F.round(F.when(n == 0, 1.0).otherwise(done / n), 6).alias("completeness"))


def _named(finder: str):
    return lambda raw: F.struct(F.lit(finder).alias("finder"), raw.alias("raw"))


def occurrences(blocks: DataFrame) -> DataFrame:
    """Places where a block prints an application number, an ECLI or a dated reference, with offsets and the pinpoint after it."""
    finders = [("appno", r"\b\d{1,6}/\d{2,4}\b"), ("ecli", r"\bECLI:[A-Z]{2}:[A-Z]+:\d{4}:[0-9A-Z]+"), ("itemid", r"\b001-\d+\b")]
    parts = F.flatten(F.array(*(F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0))), _named(f)) for f, p in finders)))
    rows = blocks.select("doc_id", "block_idx", "text", "char_start", F.explode(parts).alias("m"))
    pieces = F.split("text", F.concat(F.lit("\\Q"), F.col("m.raw"), F.lit("\\E")), -1)
    at = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda s, x: s + F.length(x)) + (i - 1) * F.length("m.raw"))
    rows = rows.where(F.size(pieces) > 1).select("doc_id", "block_idx", "text", "char_start", "m.finder", "m.raw", F.explode(at).alias("start"))
    after = F.substr(F.col("text"), F.col("start") + F.length("raw") + 1, F.lit(240))
    pin = F.regexp_extract(after, r"(?iu)^[^;\n.]*?(?:§{1,2}|paras?\.?|paragraphs?)\s*([\d–-]+(?:\s*(?:,|and|et)\s*[\d–-]+)*)", 1)
    order = Window.partitionBy("doc_id", "block_idx").orderBy("start", "raw")
    rows = rows.withColumn("next_start", F.lead("start").over(order)).withColumn("pinpoint", F.when(pin != "", F.split(pin, r"\s*(?:,|and|et)\s*")))
    owned = F.col("next_start").isNull() | (F.instr(after, F.element_at("pinpoint", 1)) + F.col("start") + F.length("raw") <= F.col("next_start"))
    return rows.select(
        "doc_id", "block_idx", "finder", F.col("raw").alias("raw_text"), F.col("start").alias("block_start"), (F.col("start") + F.length("raw")).alias("block_end"), (F.col("char_start") + F.col("start")).alias("document_start"),
        F.when(owned, F.col("pinpoint")).alias("target_paragraphs"), S.locus_id(F.col("doc_id"), F.col("block_idx"), F.col("start"), F.col("raw")).alias("locus_id"),
    )


def pinpoint_edges(found: DataFrame, target_blocks: DataFrame) -> DataFrame:
    """Pinpoints of resolved occurrences mapped to paragraphs of their targets: exact, missing or ambiguous.

    ``found`` has locus_id, target_doc and target_paragraphs; a number that several paragraphs bear is ambiguous, and
    paragraphs of separate opinions never count.
    """
    asked = found.select("locus_id", "target_doc", F.explode("target_paragraphs").alias("label")).select("locus_id", "target_doc", "label", F.explode_outer(S.pinpoint_numbers(F.col("label"))).alias("number"))
    have = target_blocks.where("para_num is not null and type <> 'heading' and coalesce(section, '') <> 'separate_opinion'").groupBy(F.col("doc_id").alias("target_doc"), F.col("para_num").cast("int").alias("number")).agg(F.count("*").alias("n"), F.min("para_id").alias("para_id"))
    joined = asked.join(have, ["target_doc", "number"], "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "exact").otherwise("ambiguous")
    return joined.select("locus_id", "target_doc", "label", "number", F.when(F.col("n") == 1, F.col("para_id")).alias("para_id"), status.alias("status"))
