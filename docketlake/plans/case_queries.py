"""Queries of the case-law operators over case tables derived from the driver's customers: each customer is a case that cites another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.functions import scalars as S
from docketlake.operators import blocks as B
from docketlake.operators import citations as C
from docketlake.operators import discovery as D
from docketlake.operators import graph as G
from docketlake.operators import local as L
from docketlake.operators import predicates as P
from docketlake.operators import quality as QM
from docketlake.operators import reconcile as RC
from docketlake.operators import reference_data as RD
from docketlake.operators import resolution as RS
from docketlake.operators import retrieval as RT
from docketlake.operators import segmentation as SG
from docketlake.operators import spans as SP
from docketlake.operators import studies as ST
from docketlake.plans.registry import query


def cases(t) -> DataFrame:
    """Case k cites case j = k // 2 + 1."""
    base = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), F.col("n_name").alias("nation"))
    s = lambda c: F.col(c).cast("string")
    rows = base.select(
        "k", "nation", F.concat(F.lit("001-"), s("k")).alias("itemid"), F.concat(F.lit("ECLI:CE:ECHR:"), (1960 + F.col("k") % 60).cast("string"), F.lit(":"), F.lpad(s("k"), 6, "0")).alias("ecli"),
        F.concat(s("k"), F.lit("/"), (F.col("k") % 90 + 10).cast("string")).alias("appno"), F.concat(F.lit("CASE OF PARTY"), s("k"), F.lit(" v. "), F.col("nation")).alias("docname"),
        F.expr("date_add(DATE '1990-01-01', cast(k as int))").alias("kp_date"), F.when(F.col("k") % 3 == 0, "FRE").otherwise("ENG").alias("language"), F.floor(F.col("k") / 2 + 1).alias("j"),
    )
    cited = rows.select(F.col("k").alias("j"), F.col("nation").alias("j_nation"), F.col("appno").alias("j_appno"), F.col("ecli").alias("j_ecli"), F.col("kp_date").alias("j_date"))
    return rows.join(cited, "j")


CASES = """base AS (SELECT c_custkey AS k, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey),
raw AS (SELECT k, nation, '001-' || k AS itemid, 'ECLI:CE:ECHR:' || (1960 + k % 60) || ':' || lpad(k::VARCHAR, 6, '0') AS ecli, k || '/' || (k % 90 + 10) AS appno, 'CASE OF PARTY' || k || ' v. ' || nation AS docname,
  DATE '1990-01-01' + k::INT AS kp_date, CASE WHEN k % 3 = 0 THEN 'FRE' ELSE 'ENG' END AS language, k // 2 + 1 AS j FROM base),
cases AS (SELECT a.*, b.nation AS j_nation, b.appno AS j_appno, b.ecli AS j_ecli, b.kp_date AS j_date FROM raw a JOIN raw b ON a.j = b.k)"""


def texts(t) -> DataFrame:
    """A text for each case that prints its citations."""
    s = lambda c: F.col(c).cast("string")
    p = (F.col("k") % 40 + 1).cast("string")
    text = F.concat(
        F.lit("The Court refers to Party"), s("j"), F.lit(" v. "), F.col("j_nation"), F.lit(", no. "), F.col("j_appno"), F.lit(", § "), p, F.lit(". See also Party"), s("j"), F.lit(", cited above, §§ "), p, F.lit("-"), (F.col("k") % 40 + 4).cast("string"),
        F.lit("; ibid., § 9.\nApplications nos. "), F.col("appno"), F.lit(" and "), F.col("j_appno"), F.lit("."),
    )
    return cases(t).select(F.col("k").alias("doc_id"), text.alias("text"))


@query(f"""
WITH {CASES}, x AS (SELECT k, k % 40 + 1 AS p, 'Party' || j || ' v. ' || j_nation AS name, 'Party' || j || ' v. ' || j_nation || ', no. ' || j_appno AS a, 'Party' || j || ', cited above' AS b, appno, j_appno FROM cases),
y AS (SELECT *, length('The Court refers to ' || a || ', § ' || p || '. See also ') AS b0 FROM x), z AS (SELECT *, b0 + length(b || ', §§ ' || p || '-' || (p + 3) || '; ') AS c0 FROM y), w AS (SELECT *, c0 + length('ibid., § 9.') + 1 AS d0 FROM z)
SELECT k AS doc_id, 0 AS ordinal, 1::BIGINT AS block_idx, 'named_application' AS method, 20 AS block_start, (20 + length(a))::INT AS block_end, 20 AS document_start, a AS raw_text, name AS cited_name, j_appno AS appnos, p::VARCHAR AS pinpoints, -1 AS antecedent FROM w
UNION ALL SELECT k, 1, 1, 'back_reference', b0::INT, (b0 + length(b))::INT, b0::INT, b, name, j_appno, p || '-' || (p + 3), 0 FROM w
UNION ALL SELECT k, 2, 1, 'carried', c0::INT, (c0 + 5)::INT, c0::INT, 'ibid.', name, j_appno, '9', 0 FROM w
UNION ALL SELECT k, 3, 2, 'application', 13, (13 + length('nos. ' || appno || ' and ' || j_appno))::INT, (d0 + 13)::INT, 'nos. ' || appno || ' and ' || j_appno, NULL, appno || ';' || j_appno, '', -1 FROM w
""")
def citation_discovery(t):
    found = D.discover(texts(t))
    return found.select("doc_id", "ordinal", "block_idx", "method", "block_start", "block_end", "document_start", "raw_text", "cited_name", F.array_join("appnos", ";").alias("appnos"), F.array_join("pinpoints", ";").alias("pinpoints"), F.coalesce("antecedent", F.lit(-1)).alias("antecedent"))


@query(f"WITH {CASES} SELECT 'locus' AS what, sha256(k || '|1|20|' || (20 + length('Party' || j || ' v. ' || j_nation || ', no. ' || j_appno)) || '|Party' || j || ' v. ' || j_nation || ', no. ' || j_appno) AS locus_id, 'unknown' AS phase FROM cases")
def citation_loci(t):
    return D.discover(texts(t)).where("ordinal = 0").select(F.lit("locus").alias("what"), "locus_id", "phase")


@query(f"WITH {CASES} SELECT k AS doc_id, count(*) AS found, 3::BIGINT AS covered, 1::BIGINT AS indeterminate FROM cases WHERE j <> k GROUP BY k UNION ALL SELECT k, 1, 1, 3 FROM cases WHERE false")
def citation_coverage(t):
    c = cases(t)
    listed = c.select(F.col("k").alias("doc_id"), F.concat(F.lit("a"), F.col("k").cast("string")).alias("mention_id"), F.array("j_appno").alias("appnos"), F.lit("none").alias("title"))
    listed = listed.union(c.select("k", F.concat(F.lit("b"), F.col("k").cast("string")), F.array("appno"), F.lit("other")))
    state = D.coverage(D.discover(texts(t)), listed)
    counts = state.groupBy("doc_id").agg(F.count_if(F.col("coverage") == "covered").alias("covered"), F.count_if(F.col("coverage") == "indeterminate").alias("indeterminate"))
    return counts.join(c.where("j <> k").select(F.col("k").alias("doc_id")), "doc_id").select("doc_id", F.lit(1).cast("long").alias("found"), "covered", "indeterminate")


def packed(t) -> DataFrame:
    """Cases with a packed list of three printed references."""
    k, j = F.col("k").cast("string"), F.col("j").cast("string")
    scl = F.concat(F.lit("Party"), j, F.lit(" v. "), F.col("j_nation"), F.lit(" [GC], no. "), F.col("j_appno"), F.lit(", 12 March 1999, ECHR 1999-II ; Klein v. Norway judgment of 5 May 1985, Series A no. "), k, F.lit("-B;; X v. Y (dec.), no. 7/99, "), F.col("j_ecli"))
    return cases(t).withColumn("scl", scl)


@query(f"""
WITH {CASES}, r AS (SELECT k, itemid, ecli, unnest([0, 1, 2]) AS i, unnest(['Party' || j || ' v. ' || j_nation || ' [GC], no. ' || j_appno || ', 12 March 1999, ECHR 1999-II', 'Klein v. Norway judgment of 5 May 1985, Series A no. ' || k || '-B', 'X v. Y (dec.), no. 7/99, ' || j_ecli]) AS raw, j, j_nation, j_appno, j_ecli FROM cases)
SELECT itemid AS source_itemid, 'ecli:' || ecli AS source_node, i AS ordinal, raw AS raw_ref, CASE i WHEN 0 THEN 'Party' || j || ' v. ' || j_nation WHEN 1 THEN 'Klein v. Norway judgment of 5 May 1985' ELSE 'X v. Y' END AS cited_name,
  CASE i WHEN 0 THEN j_appno WHEN 2 THEN '7/99' ELSE '' END AS appnos, CASE i WHEN 2 THEN j_ecli ELSE '' END AS explicit_ecli, CASE i WHEN 0 THEN DATE '1999-03-12' WHEN 1 THEN DATE '1985-05-05' END AS target_date,
  CASE i WHEN 0 THEN 'unknown' WHEN 1 THEN 'merits' ELSE 'admissibility' END AS phase, CASE i WHEN 0 THEN 'unknown' WHEN 1 THEN 'judgment' ELSE 'decision' END AS kind,
  CASE i WHEN 0 THEN 'echr:1999:II' WHEN 1 THEN 'series_a:::' || k || ':B' ELSE '' END AS reporter, i = 0 AS grand_chamber, sha256(itemid || '|' || i || '|' || raw) AS mention_id FROM r
""")
def citation_mentions(t):
    m = C.mentions(packed(t))
    return m.select("source_itemid", "source_node", "ordinal", "raw_ref", "cited_name", F.array_join("appnos", ";").alias("appnos"), F.coalesce("explicit_ecli", F.lit("")).alias("explicit_ecli"), "target_date", "phase", "kind", F.coalesce(RS.reporter_key(F.col("reporter")), F.lit("")).alias("reporter"), "grand_chamber", "mention_id")


def catalog_rows(t) -> DataFrame:
    return cases(t).select(F.concat(F.lit("ecli:"), "ecli").alias("node"), "itemid", "ecli", F.array("appno").alias("appnos"), "docname", F.col("kp_date").alias("date"), F.lit("judgment").alias("kind"), F.lit("merits").alias("phase"), F.array().cast("array<string>").alias("reporter_keys"), F.lit(False).alias("grand_chamber"), F.lit(False).alias("is_placeholder"))


def references(t) -> DataFrame:
    """One reference a case: by number alone, by ECLI, with a wrong date, by name and date, by name and number."""
    kind = F.col("k") % 5
    none = lambda t_: F.lit(None).cast(t_)
    return cases(t).select(
        F.concat(F.lit("m"), F.col("k").cast("string")).alias("mention_id"), F.concat(F.lit("ecli:"), "ecli").alias("source_node"), F.col("kp_date").alias("source_date"), F.when(kind == 1, F.lower("j_ecli")).alias("explicit_ecli"), none("string").alias("explicit_itemid"),
        F.when(kind.isin(0, 2, 4), F.array("j_appno")).otherwise(F.array().cast("array<string>")).alias("appnos"), F.when(kind.isin(2, 3, 4), F.concat(F.lit("Party"), F.col("j").cast("string"), F.lit(" v. "), F.col("j_nation"))).alias("cited_name"),
        F.when(kind == 2, F.date_add("j_date", 1)).when(kind == 3, F.col("j_date")).alias("target_date"), F.lit("unknown").alias("kind"), F.lit("unknown").alias("phase"), none("string").alias("reporter_key"), F.lit(False).alias("grand_chamber"), F.concat(F.lit("key"), F.col("k").cast("string")).alias("reference_key"), "k", "j", "j_ecli",
    )


def _resolved(t) -> DataFrame:
    m = references(t)
    authority = m.where("k % 10 = 0").select("reference_key", F.col("j_ecli").alias("target_ecli"), F.lit(None).cast("string").alias("target_itemid"))
    authority = authority.union(m.where("k % 20 = 5").select("reference_key", F.lit("ECLI:NOWHERE"), F.lit(None).cast("string")))
    overrides = m.where("k % 25 = 7").select("mention_id", F.lit(None).cast("string").alias("reference_key"), F.lit("node:own").alias("node")).union(m.where("k % 25 = 12").select(F.lit(None).cast("string"), "reference_key", F.lit("node:shared")))
    return RS.resolve_references(m, catalog_rows(t), authority, overrides)


RESOLVED = f"""{CASES}, s AS (SELECT *, CASE WHEN k % 25 IN (7, 12) THEN 'resolved_override' WHEN k % 5 = 1 AND j = k THEN 'ambiguous_document' WHEN k % 5 = 1 THEN 'resolved_identifier' WHEN k % 10 = 0 AND j < k THEN 'resolved_authority'
  WHEN k % 5 IN (3, 4) AND j <> k THEN 'resolved_metadata' WHEN k % 20 = 5 OR k = 0 THEN 'target_not_in_catalog' ELSE 'unresolved_reference' END AS status FROM cases),
r AS (SELECT 'm' || k AS mention_id, status, CASE WHEN k % 25 = 7 THEN 'node:own' WHEN k % 25 = 12 THEN 'node:shared' WHEN status LIKE 'resolved%' THEN 'ecli:' || j_ecli END AS target_node, 1::BIGINT AS candidates,
  CASE WHEN status NOT LIKE 'resolved%' OR status = 'resolved_override' THEN '' ELSE CASE k % 5 WHEN 0 THEN 'application' WHEN 1 THEN 'ecli' WHEN 3 THEN 'date,title' ELSE 'application,title' END END AS positive FROM s)"""


@query(f"WITH {RESOLVED} SELECT * FROM r")
def resolution_evidence(t):
    return _resolved(t).select("mention_id", "status", "target_node", "candidates", F.coalesce(F.array_join("positive", ","), F.lit("")).alias("positive"))


@query(f"WITH {RESOLVED} SELECT count(*) AS mentions, {', '.join(f'''count(*) FILTER (WHERE status = '{s}') AS {s}''' for s in RS.STATUSES)}, round(count(*) FILTER (WHERE status LIKE 'resolved%' OR status = 'target_not_in_catalog') / count(*), 6) AS completeness FROM r")
def resolution_report(t):
    return RS.report(_resolved(t))


@query(f"WITH {RESOLVED} SELECT mention_id FROM r WHERE target_node IS NULL")
def missing_references(t):
    return RS.missing_references(_resolved(t)).select("mention_id")


@query(f"WITH {RESOLVED}, e AS (SELECT 'ecli:' || ecli AS source, target_node AS target, mention_id FROM r JOIN cases ON mention_id = 'm' || k WHERE target_node IS NOT NULL) SELECT source, target, count(*) AS citation_count, string_agg(mention_id, ';' ORDER BY mention_id) AS mention_ids FROM e GROUP BY ALL")
def graph_artifacts(t):
    rows = _resolved(t).join(references(t).select("mention_id", "source_node"), "mention_id")
    return G.artifacts(rows).select("source", "target", "citation_count", F.array_join("mention_ids", ";").alias("mention_ids"))


@query(f"WITH {RESOLVED} SELECT count(*) AS total, count(target_node) AS resolved, count(*) - count(target_node) AS unresolved, (SELECT count(*) FROM cases WHERE k % 5 IN (0, 2, 4)) AS with_appno FROM r")
def network_stats(t):
    return G.network_stats(_resolved(t).join(references(t).select("mention_id", "appnos"), "mention_id"))


def _keys(t) -> DataFrame:
    return C.catalog(cases(t).select("itemid", "ecli", F.array("appno").alias("appno"), "docname"))


@query(f"WITH {CASES} SELECT 'appno' AS key_type, appno AS key, 'ecli:' || ecli AS node FROM cases UNION ALL SELECT 'ecli', ecli, 'ecli:' || ecli FROM cases UNION ALL SELECT 'itemid', itemid, 'ecli:' || ecli FROM cases UNION ALL SELECT 'title', 'PARTY' || k || ' ' || replace(nation, '_', ' '), 'ecli:' || ecli FROM cases")
def target_catalog(t):
    return _keys(t)


@query(f"WITH {CASES}, m AS (SELECT *, unnest([0, 1, 2]) AS i FROM cases) SELECT itemid AS source_itemid, i AS ordinal, CASE WHEN i = 1 OR j = k THEN 'unresolved' WHEN i = 0 AND j_date <> DATE '1999-03-12' THEN 'unresolved' ELSE 'resolved' END AS status, CASE WHEN i = 1 OR j = k OR (i = 0 AND j_date <> DATE '1999-03-12') THEN '' ELSE 'ecli:' || j_ecli END AS target_node FROM m")
def resolve_mentions(t):
    dates = cases(t).select(F.concat(F.lit("ecli:"), "ecli").alias("node"), "kp_date")
    return C.resolve(C.mentions(packed(t)), _keys(t), dates).select("source_itemid", "ordinal", "status", F.coalesce("target_node", F.lit("")).alias("target_node"))


@query(f"WITH {CASES}, m AS (SELECT *, unnest([0, 1, 2]) AS i FROM cases) SELECT itemid AS source_itemid, i AS ordinal, i = 0 AND j <> k AS resolved, CASE WHEN i = 0 AND j <> k THEN '001-' || j ELSE '' END AS target_itemid FROM m")
def resolve_by_application(t):
    found = C.resolve_simple(C.mentions(packed(t)).where("not array_contains(appnos, '7/99')").union(C.mentions(packed(t)).where("array_contains(appnos, '7/99')").withColumn("appnos", F.array().cast("array<string>"))), cases(t).select("itemid", "language", "ecli", F.array("appno").alias("appno")))
    return found.select("source_itemid", "ordinal", "resolved", F.coalesce("target_itemid", F.lit("")).alias("target_itemid"))


@query(f"WITH {CASES} SELECT 'ecli:' || ecli AS node, itemid, language FROM cases")
def display_rows(t):
    c = cases(t).select("itemid", "ecli", "language", F.lit(False).alias("is_placeholder"))
    twin = c.withColumn("itemid", F.concat(F.lit("z"), "itemid")).withColumn("language", F.lit("FRE")).withColumn("is_placeholder", F.lit(True))
    return C.display_rows(c.union(twin)).select("node", "itemid", "language")


HEADS = "['PROCEDURE' || chr(10) || '1. Opened.', 'THE FACTS' || chr(10) || '2. Happened.', 'THE LAW' || chr(10) || '3. Weighed.', 'FOR THESE REASONS, THE COURT' || chr(10) || '1. Holds, by six votes to one, so;' || chr(10) || 'and so on.' || chr(10) || '2. Dismisses, unanimously, the rest.' || chr(10) || 'Done in English.', 'DISSENTING OPINION OF JUDGE KRULL, JOINED BY JUDGES ADAM AND BERG' || chr(10) || 'I differ.' || chr(10) || 'Much.']"


def judgments(t) -> DataFrame:
    """A judgment for each case; every seventh has no law part, every eleventh no heading at all."""
    parts = ["PROCEDURE\n1. Opened.", "THE FACTS\n2. Happened.", "THE LAW\n3. Weighed.", "FOR THESE REASONS, THE COURT\n1. Holds, by six votes to one, so;\nand so on.\n2. Dismisses, unanimously, the rest.\nDone in English.", "DISSENTING OPINION OF JUDGE KRULL, JOINED BY JUDGES ADAM AND BERG\nI differ.\nMuch."]
    rows = cases(t).select("k", F.filter(F.array(*(F.when((F.col("k") % 7 != 0) | F.lit(i != 2), F.lit(p)) for i, p in enumerate(parts))), lambda p: p.isNotNull()).alias("p"))
    return rows.select(F.col("k").alias("doc_id"), F.when(F.col("k") % 11 == 0, F.lit("Nothing here.\nAt all.")).otherwise(F.concat(F.lit("Case number "), F.col("k").cast("string"), F.lit("\n"), F.array_join("p", "\n"))).alias("text"))


@query(f"""
WITH {CASES}, h AS (SELECT k, {HEADS} AS p FROM cases WHERE k % 11 <> 0), x AS (SELECT k, p, ['procedure', 'facts', 'the_law', 'operative', 'separate_opinions'][i] AS name, i, p[i] AS part FROM (SELECT k, p, unnest([1, 2, 3, 4, 5]) AS i FROM h) WHERE k % 7 <> 0 OR i <> 3),
y AS (SELECT *, row_number() OVER w - 1 AS ordinal, coalesce(sum(length(part) + 1) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length('Case number ' || k) + 1 AS pos FROM x WINDOW w AS (PARTITION BY k ORDER BY i))
SELECT k AS doc_id, ordinal::INT AS ordinal, name, pos::INT AS char_start, (pos + length(part))::INT AS char_end FROM y
""")
def section_spans(t):
    return SG.section_rows(SG.segment(judgments(t))).select("doc_id", "ordinal", "name", "char_start", "char_end")


@query(f"WITH {CASES}, q AS (SELECT k, k % 7 = 0 AS cut FROM cases) SELECT k AS doc_id, CASE WHEN k % 11 = 0 THEN 'unsegmented' WHEN cut THEN 'partial' ELSE 'complete' END AS status, CASE WHEN k % 11 = 0 THEN 'operative,the_law' WHEN cut THEN 'the_law' ELSE '' END AS missing, CASE WHEN k % 11 = 0 THEN 0.0 WHEN cut THEN round(0.65 * 0.5 + 0.2 * 0.8 + 0.1125 - 0.06, 3) ELSE round(0.65 + 0.2 + 0.1125 - 0.09, 3) END::DOUBLE AS confidence FROM q")
def segmentation_quality(t):
    return SG.segment(judgments(t)).select("doc_id", "status", F.array_join(F.array_sort("missing"), ",").alias("missing"), "confidence")


@query(f"WITH {CASES} SELECT k AS doc_id, CASE WHEN k % 11 = 0 THEN 'front' ELSE s END AS section, CASE WHEN k % 11 = 0 THEN 2 ELSE n END::BIGINT AS blocks FROM cases, (VALUES ('front', 1, false), ('procedure', 2, false), ('facts', 2, false), ('the_law', 2, true), ('operative', 5, false), ('separate_opinions', 3, false)) v(s, n, law) WHERE CASE WHEN k % 11 = 0 THEN s = 'front' ELSE NOT law OR k % 7 <> 0 END")
def labelled_blocks(t):
    docs = judgments(t)
    return SG.label_blocks(B.text_blocks(docs), SG.segment(docs)).groupBy("doc_id", "section").agg(F.count("*").alias("blocks"))


def _sectioned(t) -> DataFrame:
    return B.sections(B.text_blocks(judgments(t)))


@query(f"WITH {CASES} SELECT k AS doc_id, ruling, text, unanimous, f AS votes_for, g AS votes_against FROM cases, (VALUES (1::BIGINT, '1. Holds, by six votes to one, so;' || chr(10) || 'and so on.', false, 'six', 'one'), (2, '2. Dismisses, unanimously, the rest.', true, NULL, NULL)) v(ruling, text, unanimous, f, g) WHERE k % 11 <> 0")
def dispositive_rulings(t):
    return B.dispositive(_sectioned(t)).select("doc_id", "ruling", "text", "unanimous", "votes_for", "votes_against")


@query(f"WITH {CASES} SELECT k AS doc_id, 1::BIGINT AS ordinal, 'DISSENTING OPINION OF JUDGE KRULL, JOINED BY JUDGES ADAM AND BERG' AS title, 'dissenting' AS opinion_type, 'KRULL' AS authors, 'ADAM;BERG' AS joined_by, 'I differ.' || chr(10) || 'Much.' AS text, sha256(k || '|opinion|1|DISSENTING OPINION OF JUDGE KRULL, JOINED BY JUDGES ADAM AND BERG') AS opinion_id FROM cases WHERE k % 11 <> 0")
def separate_opinions(t):
    return B.opinions(_sectioned(t)).select("doc_id", "ordinal", "title", "opinion_type", F.array_join("authors", ";").alias("authors"), F.array_join("joined_by", ";").alias("joined_by"), "text", "opinion_id")


@query(f"WITH {CASES} SELECT 'section:' || k || ':separate_opinion' AS unit_id, 'DISSENTING OPINION OF JUDGE KRULL, JOINED BY JUDGES ADAM AND BERG' || chr(10) || chr(10) || 'I differ.' || chr(10) || chr(10) || 'Much.' AS text FROM cases WHERE k % 11 <> 0")
def section_units(t):
    return ST.unitize(_sectioned(t), "section").where("section = 'separate_opinion'").select("unit_id", "text")


@query(f"WITH {CASES}, p AS (SELECT k, unnest([1, 2]) AS i FROM cases) SELECT 'l' || k AS locus_id, CASE i WHEN 1 THEN '1-3' ELSE '2' END AS label, CASE WHEN k % 11 = 0 THEN 'missing' WHEN i = 1 THEN 'ambiguous' ELSE 'ambiguous' END AS status FROM p")
def pinpoint_status(t):
    found = cases(t).select(F.concat(F.lit("l"), F.col("k").cast("string")).alias("locus_id"), F.col("k").alias("target_doc"), F.array(F.lit("1-3"), F.lit("2")).alias("pinpoints"))
    blocks = B.text_blocks(judgments(t)).withColumn("section", F.lit("the_law"))
    return RS.pinpoint_targets(found, blocks).select("locus_id", "label", "status")


@query(f"WITH {CASES}, p AS (SELECT k, unnest([1, 2, 3]) AS i FROM cases) SELECT 'l' || k AS locus_id, CASE i WHEN 1 THEN '3' WHEN 2 THEN '3-4' ELSE '9' END AS label, i, CASE WHEN k % 11 = 0 OR k % 7 = 0 OR i = 3 THEN 'missing' WHEN i = 1 THEN 'exact' ELSE 'partial' END AS status, CASE WHEN k % 11 = 0 OR k % 7 = 0 OR i = 3 THEN '' ELSE '3' END AS para_ids FROM p")
def pinpoint_paragraphs(t):
    found = cases(t).select(F.concat(F.lit("l"), F.col("k").cast("string")).alias("locus_id"), F.col("k").alias("target_doc"), F.array(F.lit("3"), F.lit("3-4"), F.lit("9")).alias("pinpoints"))
    blocks = B.text_blocks(judgments(t)).withColumn("section", F.lit("the_law"))
    rows = RS.pinpoint_targets(found, blocks)
    return rows.select("locus_id", "label", F.when(F.col("label") == "3", 1).when(F.col("label") == "3-4", 2).otherwise(3).alias("i"), "status", F.array_join("para_ids", ";").alias("para_ids"))


@query(f"WITH {CASES} SELECT k, appno, 'PARTY' || k || ' ' || replace(nation, '_', ' ') AS title, nation AS respondent, k % 2 = 0 AS flag, CASE WHEN k % 2 = 0 THEN kp_date END AS day, 'echr:' || (1960 + k % 60) || ':IV' AS reporter, 'ecli:' || ecli AS node, CASE WHEN k % 3 = 0 THEN 'advisory_opinion' WHEN k % 3 = 1 THEN 'just_satisfaction' ELSE 'revision' END AS phase, CASE WHEN k % 3 = 0 THEN 'advisory' ELSE 'judgment' END AS kind, 'party' || k || ' v. norway, no. 1/99' AS ref_key, [12, 13, 14]::INT[] AS numbers, 'eclair nai' || k AS folded FROM cases")
def scalar_references(t):
    c = cases(t)
    k = F.col("k").cast("string")
    phrase = F.when(F.col("k") % 3 == 0, "Advisory opinion").when(F.col("k") % 3 == 1, "(just satisfaction), judgment").otherwise("(révision)")
    return c.select(
        "k", S.normalise_appnos(F.array(F.concat(F.lit(" "), "appno"), F.col("appno"), F.lit("")))[0].alias("appno"), S.normalise_title(F.col("docname")).alias("title"), S.respondent(F.col("docname")).alias("respondent"),
        S.lenient_boolean(F.when(F.col("k") % 2 == 0, " yes").otherwise("N")).alias("flag"), S.lenient_date(F.when(F.col("k") % 2 == 0, F.concat(F.col("kp_date").cast("string"), F.lit("T00:00:00"))).otherwise(F.lit("1999"))).alias("day"),
        RS.reporter_key(S.reporter(F.concat(F.lit("X v. Y, ECHR "), (1960 + F.col("k") % 60).cast("string"), F.lit("-IV")))).alias("reporter"), S.node_id(F.col("ecli"), F.col("itemid")).alias("node"), S.phase(phrase).alias("phase"), S.document_kind(phrase).alias("kind"),
        S.reference_key(F.concat(F.lit("Party"), k, F.lit("  v. Norway, no. 1/99, §§ 12 and 14."))).alias("ref_key"), S.pinpoint_numbers(F.lit("12-14")).alias("numbers"), S.fold(F.concat(F.lit("Éclair Naï"), k)).alias("folded"),
    )


@query(f"WITH {CASES} SELECT itemid FROM cases WHERE nation = 'FRANCE' AND language = 'ENG' AND kp_date BETWEEN DATE '1991-01-01' AND DATE '2003-12-31' OR itemid IN ('001-3', '001-5') OR contains(' ' || lower(docname) || ' ', ' of party7 v. ') OR appno = '12/22' OR k % 90 = 3")
def typed_predicates(t):
    c = cases(t).select("itemid", "ecli", F.array("appno").alias("appno"), F.array("nation").alias("respondent"), F.array((F.col("k") % 90).cast("string")).alias("articles"), "docname", "kp_date", "language")
    q = (P.Q.respondent("FRANCE") & P.Q.field("languageisocode", "ENG", True) & P.Q.date_range("1991-01-01", "2003-12-31")) | P.one_of("itemid", ["001-3", "001-5"], True) | P.Q.docname("of party7 v") | P.Q.appno("12/22") | P.Q.article(3)
    return P.search(c, q).select("itemid")


@query(f"WITH {CASES} SELECT itemid, kp_date FROM cases WHERE language = 'FRE' ORDER BY kp_date DESC, itemid LIMIT 100 OFFSET 10")
def paged_search(t):
    return P.page(cases(t), P.Q.field("language", "FRE", True), 10, 100, "date-desc").select("itemid", "kp_date")


@query(f"WITH {CASES} SELECT source, target FROM (SELECT itemid AS source, '001-' || j AS target FROM cases) WHERE regexp_matches(target, '(?i)-1[0-3]$') ORDER BY source LIMIT 50")
def cited_by_search(t):
    edges = cases(t).select(F.col("itemid").alias("source"), F.concat(F.lit("001-"), F.col("j").cast("string")).alias("target"))
    return L.run_search("cited-by", "-1[0-3]$", edges=edges)


@query(f"WITH {CASES} SELECT itemid FROM cases WHERE regexp_matches(docname, '(?i)party1\\d v\\.') AND kp_date >= DATE '1990-01-13' ORDER BY itemid LIMIT 50")
def party_search_filtered(t):
    import datetime as dt

    c = cases(t).withColumn("represented_by", F.lit(None).cast("string"))
    return L.run_search("party", r"party1\d v\.", cases=c, date_from=dt.date(1990, 1, 13)).select("itemid")


@query(f"WITH {CASES} SELECT appno, itemid AS judgment, CASE WHEN k % 2 = 0 THEN 'E' || k END AS execution FROM cases")
def linked_applications(t):
    c = cases(t)
    right = c.where("k % 2 = 0").select(F.concat(F.lit("E"), F.col("k").cast("string")).alias("exec_id"), F.array(F.lower("appno"), F.col("appno")).alias("appno"))
    return RD.link_applications(c.select("itemid", F.array("appno").alias("appno")), right).select("appno", "judgment.itemid", "execution.exec_id").toDF("appno", "judgment", "execution")


@query(f"WITH {CASES} SELECT appno, CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END AS plans, CASE WHEN k % 4 = 1 THEN 2 ELSE 0 END AS reports, CASE WHEN k % 4 = 2 THEN 2 ELSE 0 END AS mails, CASE WHEN k % 4 = 3 THEN 2 ELSE 0 END AS decisions FROM cases")
def execution_cases(t):
    c = cases(t).select("appno", "k")
    code = F.get(F.array(*(F.lit(x) for x in ("zz; acp", "acr", "ngo;x", "CMDEC"))), (F.col("k") % 4).cast("int"))
    docs = c.select("appno", F.explode(F.array(F.lit("d1"), F.lit("d2"))).alias("document_id"), F.lit("t").alias("title"), code.alias("collection"))
    sizes = [F.size(x) for x in ("action_plans", "action_reports", "communications", "committee_documents")]
    return RD.execution_cases(c.select("appno"), docs).select("appno", *(s.alias(n) for s, n in zip(sizes, ("plans", "reports", "mails", "decisions"))))


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS label FROM nation WHERE contains(lower(n_name), 'ion_1')")
def keypoint_search(t):
    keypoints = t("nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("label"), F.col("n_regionkey").cast("string").alias("parent"))
    return RD.search_keypoints(keypoints, "Ion_1")


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 5 <> 0 THEN n_name END AS keypoint_label FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def keypoint_names(t):
    keypoints = t("nation").select(F.col("n_nationkey").cast("string").alias("id"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).alias("label"))
    return RD.keypoint_labels(t("supplier"), keypoints, "s_nationkey").select("s_suppkey", "keypoint_label")


@query("SELECT s_suppkey, n_name AS country, 1950 + n_nationkey::INT AS first_year FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def judge_roster(t):
    roster = t("nation").select(F.concat(F.lit("Júdge "), F.translate("n_name", "0123456789_", "abcdefghijk")).alias("name"), F.col("n_name").alias("country"), (1950 + F.col("n_nationkey")).cast("int").alias("first_year"))
    names = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("judge  "), F.lower(F.translate("n_name", "0123456789_", "abcdefghijk"))).alias("name"))
    return RD.match_roster(names, roster).select("s_suppkey", "country", "first_year")


@query(f"WITH {CASES} SELECT k, CASE WHEN k % 2 = 0 THEN 'Convention of ' || nation || ' 1961' END AS matched FROM cases")
def external_sources(t):
    entries = F.concat(F.lit("Strasbourg "), "nation", F.lit(" ; Convention of "), "nation", F.lit(" 1961; Convention of "), "nation")
    name = F.when(F.col("k") % 2 == 0, F.concat(F.lit("the convention of "), "nation")).otherwise(F.lit("treaty of nowhere"))
    return RD.match_external(cases(t).select("k", entries.alias("external_sources"), name.alias("cited_name"))).select("k", "matched")


@query(f"WITH {CASES} SELECT 'a' || k AS annotation_id, 'c' || k AS candidate_id, 1000 + 500 + 20 + 5 AS score, 'strict_source_span' AS family FROM cases")
def annotation_scores(t):
    c, k = cases(t), F.col("k").cast("string")
    a = c.select(F.concat(F.lit("a"), k).alias("annotation_id"), F.col("k").alias("doc_id"), F.lit(10).alias("start"), F.lit(30).alias("end"), F.col("docname").alias("span"), F.col("docname").alias("citation"), F.array("appno").alias("appnos"))
    b = c.select(F.concat(F.lit("c"), k).alias("candidate_id"), F.col("k").alias("doc_id"), F.lit(10).alias("start"), F.lit(30).alias("end"), F.lower("docname").alias("raw"), F.concat(F.lit("see "), "docname").alias("context"), F.array("appno").alias("appnos"))
    return SP.alignment_scores(a, b).select("annotation_id", "candidate_id", "score", "family")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'u' || turn ELSE 'u' || prior END AS target, role <> 'user' AND prior IS NOT NULL AS carried FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM conversations)")
def carried_references(t):
    rows = t("conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("block_idx"), F.col("turn").alias("start"), F.when(F.col("role") == "user", "A v. B").otherwise("ibid.").alias("raw_text"), F.when(F.col("role") == "user", F.concat(F.lit("u"), F.col("turn").cast("string"))).alias("target"))
    return SP.carry_back_references(rows).select(F.col("doc_id").alias("conv_id"), F.col("start").alias("turn"), "target", "carried")


@query(f"WITH {CASES} SELECT 'eng' AS language, docname AS citation, ecli, itemid, CASE WHEN k % 2 = 0 THEN 'AFFAIRE ' || k END AS equivalent FROM cases UNION ALL SELECT 'fra', 'AFFAIRE ' || k, ecli, NULL, docname FROM cases WHERE k % 2 = 0")
def official_lists(t):
    c, none = cases(t), F.lit(None).cast("string")
    first = c.select(F.lit(1).alias("edition"), F.lit("eng").alias("language"), F.col("docname").alias("citation"), F.col("ecli"), none.alias("itemid"))
    second = c.select(F.lit(2), F.lit("eng"), F.concat("docname", F.lit(", § 4")), none, F.col("itemid"))
    french = c.where("k % 2 = 0").select(F.lit(1), F.lit("fra"), F.concat(F.lit("AFFAIRE "), F.col("k").cast("string")), F.col("ecli"), none)
    return RD.merge_authorities(first.union(second).union(french)).select("language", "citation", "ecli", "itemid", "equivalent")


@query(f"WITH {CASES} SELECT k AS doc_id, 'judgment' AS kind, 'yes' AS flag, round((k * 3.0 + k * 15.0) / 1e6 * 0.5, 6) AS usd, sha256('study|' || k || '|draft') AS task FROM cases")
def study_costs(t):
    k = F.col("k").cast("string")
    return cases(t).select(F.col("k").alias("doc_id"), F.lit("judgment").alias("kind"), F.lit("yes").alias("flag"), ST.cost(F.col("k"), F.col("k"), (3.0, 15.0), True).alias("usd"), ST.task_id(F.lit("study"), k, F.lit("draft")).alias("task"))


@query(f"WITH {CASES} SELECT k, CASE WHEN k % 3 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN k % 3 = 0 THEN 'answer' ELSE '' END AS missing FROM cases")
def validated_records(t):
    rows = cases(t).select("k", F.when(F.col("k") % 3 != 0, "x").alias("answer"), F.lit("r").alias("reason"))
    return ST.validated(rows, ["answer", "reason"]).select("k", "status", F.array_join("missing", ",").alias("missing"))


@query(f"WITH {CASES} SELECT itemid, k % 4 = 0 OR k % 9 = 0 AS wanted, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 9 = 0 THEN true ELSE false END AS scanned FROM cases WHERE k % 4 <> 0")
def scanned_texts(t):
    text = F.when(F.col("k") % 9 == 0, F.lit("few words")).otherwise(F.repeat(F.lit("word "), 60))
    return cases(t).where("k % 4 <> 0").select("itemid", (F.col("k") % 9 == 0).alias("wanted"), RD.looks_scanned(text, F.lit(1)).alias("scanned"))


@query(f"WITH {CASES} SELECT k, CASE k % 4 WHEN 0 THEN 'acp' WHEN 1 THEN 'acr' WHEN 2 THEN 'ngo' ELSE 'unknown' END AS type, CASE k % 4 WHEN 0 THEN 'acp' WHEN 1 THEN 'acr' WHEN 2 THEN 'ngo' ELSE 'odd' END AS code FROM cases")
def execution_types(t):
    title = F.get(F.array(*(F.lit(x) for x in ("Action plan of 2011", "Bilan d'action", "Communication from an NGO", "Letter"))), (F.col("k") % 4).cast("int"))
    code = F.get(F.array(*(F.lit(x) for x in ("x; acp", "acr;ngo", " ngo ", "odd; y"))), (F.col("k") % 4).cast("int"))
    return cases(t).select("k", RD.document_type(title).alias("type"), RD.collection_code(code).alias("code"))


@query("SELECT column_name AS \"column\", array_to_string(list_sort(list_distinct(list(v)))[1:3], '|') AS samples FROM (SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS column_name, unnest([n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR]) AS v FROM nation) GROUP BY 1")
def column_samples(t):
    return L.column_samples(t("nation").select("n_nationkey", "n_name", "n_regionkey")).select("column", F.array_join("samples", "|").alias("samples"))


PARAGRAPHS = "p AS (SELECT doc_id, x AS text, doc_id || ':' || row_number() OVER (PARTITION BY doc_id ORDER BY i) AS paragraph_id FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE x <> '')"


@query(rf"""WITH {PARAGRAPHS}, w AS (SELECT paragraph_id, list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM p), n AS (SELECT count(*) AS n, avg(len(w)) AS average FROM w),
h AS (SELECT paragraph_id, len, term, count(*) AS tf FROM (SELECT paragraph_id, len(w) AS len, unnest(w) AS term FROM w) WHERE term IN ('the', 'of') GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM h GROUP BY term),
b AS (SELECT paragraph_id, count(*) AS terms, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / average))), 12) AS score FROM h JOIN d USING (term), n GROUP BY paragraph_id HAVING count(*) = 2)
SELECT paragraph_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, paragraph_id)::INT AS lexical_rank FROM b ORDER BY lexical_rank LIMIT 20""")
def paragraph_search(t):
    return RT.search_paragraphs(RT.paragraphs(t("documents")), "The of").select("paragraph_id", "score", "lexical_rank")


@query("SELECT doc_id, i::INT AS para_num, x AS text FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i, x FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM documents WHERE doc_id = 3) WHERE x <> '') ORDER BY i LIMIT 100")
def paragraphs_of_a_document(t):
    return RT.get_paragraphs(RT.paragraphs(t("documents")), 3).select("doc_id", "para_num", "text")


@query(f"WITH {CASES} SELECT itemid FROM cases WHERE k % 4 = 0")
def rescue_wanted(t):
    rows = cases(t).select("itemid", F.array("appno").alias("appno"), F.lit(None).cast("string").alias("french_itemid"), (F.col("k") % 4 == 0).alias("is_placeholder"), F.lit("some text").alias("text"))
    return RC.rescue_candidates(rows).select("itemid")


@query("WITH m AS (SELECT quality::VARCHAR AS gold, toxic::VARCHAR AS pred, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL) SELECT * FROM m")
def label_confusion(t):
    return QM.confusion(t("labels"), "quality", "toxic")
