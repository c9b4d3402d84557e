"""Resolution of references to documents with the evidence for and against every candidate; nothing is guessed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions import scalars as S

STATUSES = ("resolved_override", "resolved_identifier", "resolved_authority", "resolved_metadata", "ambiguous_document", "target_not_in_catalog", "unresolved_reference")
MENTION = ("mention_id", "source_node", "source_date", "explicit_ecli", "explicit_itemid", "appnos", "cited_name", "target_date", "kind", "phase", "reporter_key", "grand_chamber", "reference_key")
CANDIDATE = ("node", "itemid", "ecli", "appnos", "docname", "date", "kind", "phase", "reporter_keys", "grand_chamber", "is_placeholder")


def reporter_key(reporter: Column) -> Column:
    """One string for a reporter struct, such as ``echr:2005:IV``; null without a reporter."""
    parts = [F.coalesce(reporter[c].cast("string"), F.lit("")) for c in ("family", "year", "volume", "number", "suffix", "page")]
    return F.when(reporter.isNotNull(), F.regexp_replace(F.concat_ws(":", *parts), ":+$", ""))


def candidates(mentions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pairs (mention_id, node) that share an identifier, an application number, a reporter or a normalised title. Each key is a join
    of its own, so a mention meets only documents that have one of its keys."""
    keyed = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    every = lambda one, many: F.concat(F.array(*(keyed(k, c) for k, c in one)), *(F.transform(F.coalesce(c, F.array().cast("array<string>")), _keyed(k)) for k, c in many))
    title = lambda c: F.nullif(S.normalise_title(c), F.lit(""))
    asked = every([("ecli", S.normalise_ecli(F.col("explicit_ecli"))), ("itemid", F.col("explicit_itemid")), ("title", title(F.col("cited_name"))), ("reporter", F.col("reporter_key"))], [("appno", F.col("appnos"))])
    have = every([("ecli", S.normalise_ecli(F.col("ecli"))), ("itemid", F.col("itemid")), ("title", title(F.col("docname")))], [("appno", F.col("appnos")), ("reporter", F.col("reporter_keys"))])
    m = mentions.select("mention_id", F.explode(asked).alias("k")).select("mention_id", "k.*").where("key is not null")
    c = catalog.select("node", F.explode(have).alias("k")).select("node", "k.*").where("key is not null").distinct()
    return m.join(c, ["kind", "key"]).select("mention_id", "node").distinct()


def _keyed(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key"))


def evaluate(mentions: DataFrame, catalog: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with what speaks for (``positive``) and against (``conflicts``) each, by every rule that applies."""
    m = mentions.select(*(F.col(c).alias(f"m_{c}") if c != "mention_id" else F.col(c) for c in MENTION))
    rows = pairs.join(m, "mention_id").join(catalog.select(*CANDIDATE), "node")
    title, mine = S.normalise_title(F.col("docname")), S.normalise_title(F.col("m_cited_name"))
    rows = rows.withColumn("similarity", F.when(F.coalesce(F.col("m_cited_name"), F.lit("")) == "", F.lit(0.0)).when(title == mine, F.lit(1.0)).otherwise(S.title_similarity(mine, title)))
    known = lambda c: F.col(c).isNotNull() & ~F.col(c).isin("", "unknown")
    has = F.size(F.coalesce("m_appnos", F.array().cast("array<string>"))) > 0
    within = F.size(F.array_except("m_appnos", F.coalesce("appnos", F.array().cast("array<string>")))) == 0
    rules = [
        ("ecli", F.col("m_explicit_ecli").isNotNull(), S.normalise_ecli(F.col("m_explicit_ecli")) == S.normalise_ecli(F.col("ecli"))),
        ("itemid", F.col("m_explicit_itemid").isNotNull(), F.col("m_explicit_itemid") == F.col("itemid")),
        ("application", has, within),
        ("date", F.col("m_target_date").isNotNull(), F.col("m_target_date") == F.col("date")),
        ("reporter", F.col("m_reporter_key").isNotNull(), F.array_contains(F.coalesce("reporter_keys", F.array().cast("array<string>")), F.col("m_reporter_key"))),
        ("kind", known("m_kind"), F.col("m_kind") == F.col("kind")),
        ("phase", known("m_phase"), F.col("m_phase") == F.col("phase")),
        ("grand_chamber", F.col("m_grand_chamber"), F.col("grand_chamber")),
    ]
    holds = lambda ok: F.coalesce(ok, F.lit(False))
    positive = [F.when(holds(asked) & holds(ok), F.lit(name)) for name, asked, ok in rules]
    conflicts = [F.when(holds(asked) & ~holds(ok), F.lit(name)) for name, asked, ok in rules]
    positive.append(F.when(F.col("similarity") >= 0.97, "title").when(F.col("similarity") >= 0.82, "similar_title"))
    conflicts.append(F.when((F.coalesce(F.col("m_cited_name"), F.lit("")) != "") & (F.col("similarity") < 0.82), "title"))
    conflicts += [F.when(holds(F.col("is_placeholder")), "placeholder"), F.when(F.col("date") > F.col("m_source_date"), "later_than_source"), F.when(F.col("node") == F.col("m_source_node"), "own_document")]
    return rows.select("mention_id", "node", "similarity", F.array_compact(F.array(*positive)).alias("positive"), F.array_compact(F.array(*conflicts)).alias("conflicts"))


def accepted(found: DataFrame) -> DataFrame:
    """How a candidate may stand: ``identifier`` with an identifier and none that conflicts, ``metadata`` where nothing speaks against it but
    a phase and either its number with another sign, or its exact title with date or reporter, speaks for it."""
    any_of = lambda c, *names: F.arrays_overlap(c, F.array(*(F.lit(n) for n in names)))
    out = any_of(F.col("conflicts"), "placeholder", "later_than_source", "own_document")
    ident = any_of(F.col("positive"), "ecli", "itemid") & ~any_of(F.col("conflicts"), "ecli", "itemid") & ~out
    plain = F.size(F.array_except("conflicts", F.array(F.lit("phase")))) == 0
    number = F.array_contains("positive", "application") & any_of(F.col("positive"), "title", "similar_title", "date", "reporter", "kind")
    named = F.array_contains("positive", "title") & any_of(F.col("positive"), "date", "reporter")
    return found.withColumn("accepted", F.when(ident, "identifier").when(plain & (number | named), "metadata"))


def authority_targets(mentions: DataFrame, authority: DataFrame) -> DataFrame:
    """Mentions with the official entry (reference_key, target_ecli, target_itemid) of their reference, where all entries of it agree."""
    one = authority.groupBy("reference_key").agg(F.count_distinct("target_ecli", "target_itemid").alias("n"), F.min("target_ecli").alias("a_ecli"), F.min("target_itemid").alias("a_itemid"))
    return mentions.select("mention_id", "reference_key").join(one.where("n <= 1"), "reference_key").select("mention_id", "a_ecli", "a_itemid")


def resolve_references(mentions: DataFrame, catalog: DataFrame, authority: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Every mention with a status of STATUSES, its target, and the evidence.

    ``overrides`` (mention_id or reference_key, node) decide first, those of the mention before those of the reference;
    identifiers next, then official lists, then metadata. Two acceptable documents leave a mention ambiguous, an identifier that
    contradicts another one too; an official entry whose document isn't in the catalogue says so.
    """
    pairs = candidates(mentions, catalog)
    if authority is not None:
        backed = authority_targets(mentions, authority)
        known = catalog.select("node", S.normalise_ecli(F.col("ecli")).alias("k_ecli"), F.col("itemid").alias("k_itemid"))
        by = backed.where("a_ecli is not null").join(known, S.normalise_ecli(F.col("a_ecli")) == F.col("k_ecli")).select("mention_id", "node")
        by = by.union(backed.where("a_itemid is not null").join(known, F.col("a_itemid") == F.col("k_itemid")).select("mention_id", "node")).distinct()
        pairs = pairs.union(by).distinct()
    judged = accepted(evaluate(mentions, catalog, pairs))
    per = judged.groupBy("mention_id").agg(
        F.count("*").alias("candidates"), F.array_sort(F.collect_set(F.when(F.col("accepted") == "identifier", F.col("node")))).alias("ids"), F.array_sort(F.collect_set(F.when(F.col("accepted") == "metadata", F.col("node")))).alias("metas"),
        F.max(F.array_contains("positive", "ecli") | F.array_contains("positive", "itemid")).alias("touched"),
    )
    rows = mentions.select("mention_id", "reference_key").join(per, "mention_id", "left")
    none = F.lit(None).cast("string")
    if authority is not None:
        fine = judged.join(by, ["mention_id", "node"], "left_semi").where(~F.arrays_overlap("conflicts", F.array(F.lit("placeholder"), F.lit("later_than_source"), F.lit("own_document"), F.lit("ecli"), F.lit("itemid"))))
        listed = fine.groupBy("mention_id").agg(F.count_distinct("node").alias("n_listed"), F.min("node").alias("listed"))
        rows = rows.join(listed, "mention_id", "left").join(backed.select("mention_id", F.lit(True).alias("backed")), "mention_id", "left")
    else:
        rows = rows.withColumn("n_listed", F.lit(0)).withColumn("listed", none).withColumn("backed", F.lit(False))
    if overrides is not None:
        own = overrides.where("mention_id is not null").groupBy("mention_id").agg(F.min("node").alias("o1"))
        shared = overrides.where("mention_id is null and reference_key is not null").groupBy("reference_key").agg(F.min("node").alias("o2"))
        rows = rows.join(own, "mention_id", "left").join(shared, "reference_key", "left").withColumn("override", F.coalesce("o1", "o2")).drop("o1", "o2")
    else:
        rows = rows.withColumn("override", none)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    status = (
        F.when(F.col("override").isNotNull(), "resolved_override")
        .when(size("ids") == 1, "resolved_identifier")
        .when((size("ids") > 1) | F.coalesce("touched", F.lit(False)), "ambiguous_document")
        .when(F.col("n_listed") == 1, "resolved_authority")
        .when(size("metas") == 1, "resolved_metadata")
        .when((size("metas") > 1) | (F.col("n_listed") > 1), "ambiguous_document")
        .when(F.coalesce("backed", F.lit(False)), "target_not_in_catalog")
        .otherwise("unresolved_reference")
    )
    rows = rows.withColumn("status", status)
    target = F.when(F.col("status") == "resolved_override", F.col("override")).when(F.col("status") == "resolved_identifier", F.get("ids", F.lit(0))).when(F.col("status") == "resolved_authority", F.col("listed")).when(F.col("status") == "resolved_metadata", F.get("metas", F.lit(0)))
    rows = rows.select("mention_id", "status", target.alias("target_node"), F.coalesce("candidates", F.lit(0)).alias("candidates"))
    proof = judged.select("mention_id", F.col("node").alias("target_node"), "positive", "conflicts")
    return rows.join(proof, ["mention_id", "target_node"], "left")


def report(resolved: DataFrame) -> DataFrame:
    """Mentions by status as one row, with the share that is settled (1 without mentions)."""
    n = F.count("*")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    settled = reduce(lambda a, b: a + b, (F.count_if(F.col("status") == s) for s in (*STATUSES[:4], "target_not_in_catalog")))
    return resolved.agg(n.alias("mentions"), *counts, F.round(F.when(n == 0, 1.0).otherwise(settled / n), 6).alias("completeness"))


def pinpoint_targets(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each pinpoint label of resolved citations (locus_id, target_doc, pinpoints) with the paragraphs of the target that it names.

    ``status``: exact or range where each number is one paragraph, partial where some are missing, ambiguous where one number stands for several, missing,
    and unavailable where the target's text isn't there. ``blocks`` has doc_id, para_num, para_id, type and section; headings and separate
    opinions don't count.
    """
    asked = found.select("locus_id", "target_doc", F.explode("pinpoints").alias("label")).withColumn("numbers", S.pinpoint_numbers(F.col("label")))
    there = blocks.select(F.col("doc_id").alias("target_doc")).distinct().withColumn("there", F.lit(True))
    have = blocks.where("para_num is not null and type <> 'heading' and coalesce(section, '') <> 'separate_opinions'").groupBy(F.col("doc_id").alias("target_doc"), F.col("para_num").cast("int").alias("number")).agg(F.count("*").alias("n"), F.min("para_id").alias("para_id"))
    each = asked.select("locus_id", "target_doc", "label", F.explode_outer("numbers").alias("number")).join(have, ["target_doc", "number"], "left")
    per = each.groupBy("locus_id", "target_doc", "label").agg(F.count("number").alias("wanted"), F.count("n").alias("met"), F.max(F.coalesce("n", F.lit(0))).alias("most"), F.array_sort(F.collect_list(F.when(F.col("n") == 1, F.col("para_id")))).alias("para_ids"))
    per = per.join(there, "target_doc", "left")
    status = F.when(F.col("there").isNull(), "unavailable").when((F.col("wanted") == 0) | (F.col("met") == 0), "missing").when(F.col("most") > 1, "ambiguous").when(F.col("met") < F.col("wanted"), "partial").when(F.col("wanted") > 1, "range").otherwise("exact")
    return per.select("locus_id", "target_doc", "label", status.alias("status"), "para_ids")


def source_invocations(occurrences: DataFrame, footnotes: DataFrame) -> DataFrame:
    """Occurrences in footnotes with the blocks that invoke the footnote, in order; ``footnotes`` has doc_id, footnote_id, block_idx."""
    called = footnotes.groupBy("doc_id", "footnote_id").agg(F.array_sort(F.collect_set("block_idx")).alias("invoked_by"))
    return occurrences.join(called, ["doc_id", "footnote_id"], "left")


def missing_references(resolved: DataFrame) -> DataFrame:
    """References without a target."""
    return resolved.where("target_node is null")


def merge_loci(rows: DataFrame, place: list[str], identity: str, strength: str) -> DataFrame:
    """Of rows at one place with one identity the strongest; places with several identities keep them all, marked as contested."""
    best = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*place, identity).orderBy(F.desc(strength)))).where("__r = 1").drop("__r")
    return best.withColumn("contested", F.count("*").over(Window.partitionBy(*place)) > 1)
