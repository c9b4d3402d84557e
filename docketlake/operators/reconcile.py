"""One primary record per document out of records in several languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.scalars import normalise_appnos, normalise_ecli, normalise_title, title_similarity
from docketlake.operators.records import first_per_key

SIMILAR = 0.85


def reconcile(cases: DataFrame, primary: str = "ENG", sibling: str = "FRE", keep_extra: bool = False, backfill: bool = True, order: str = "seq") -> DataFrame:
    """All records with their ``role``: primary, sibling, duplicate or other.

    ``cases`` has itemid, ecli, language, represented_by and ``order``. Records are deduplicated by itemid (the first stays);
    within an ECLI the first record in the primary language leads, later ones are duplicates; the first sibling record with a
    representative (else the first) is the sibling, whose itemid and, with ``backfill``, missing representative the
    primary takes over; without a primary the sibling is promoted. Further siblings are duplicates, or with ``keep_extra``
    others. Records without an ECLI, or in another language, pass as others.
    """
    cases = cases.withColumn("node", normalise_ecli(F.col("ecli")))
    marked = cases.withColumn("__first", F.row_number().over(Window.partitionBy("itemid").orderBy(order)) == 1)
    repeated = marked.where(~F.col("__first") & F.col("itemid").isNotNull() & (F.col("itemid") != ""))
    unique = first_per_key(cases, "itemid", order)
    lang = F.upper("language")
    named = F.col("represented_by").isNotNull() & (F.trim("represented_by") != "")
    turn = Window.partitionBy("node", lang).orderBy(F.when(lang == sibling, F.when(named, 0).otherwise(1)).otherwise(0), order)
    unique = unique.withColumn("__turn", F.row_number().over(turn))
    node = Window.partitionBy("node")
    lead = lambda code, col: F.max(F.when((lang == code) & (F.col("__turn") == 1), F.col(col))).over(node)
    unique = unique.withColumn("__primary", lead(primary, "itemid")).withColumn("__sibling", lead(sibling, "itemid")).withColumn("__rep", lead(sibling, "represented_by"))
    role = (
        F.when(F.col("node").isNull() | ~lang.isin(primary, sibling), "other")
        .when(lang == primary, F.when(F.col("__turn") == 1, "primary").otherwise("duplicate"))
        .when(F.col("__turn") > 1, "other" if keep_extra else "duplicate")
        .when(F.col("__primary").isNull(), "primary")
        .otherwise("sibling")
    )
    unique = unique.withColumn("role", role)
    own = (F.col("role") == "primary") & (lang == primary)
    unique = unique.withColumn("sibling_itemid", F.when(own, F.col("__sibling")))
    if backfill:
        unique = unique.withColumn("represented_by", F.when(own & ~F.coalesce(named, F.lit(False)), F.col("__rep")).otherwise(F.col("represented_by")))
    columns = [*cases.columns, "role", "sibling_itemid"]
    return unique.select(*columns).unionByName(repeated.withColumn("role", F.lit("duplicate")).withColumn("sibling_itemid", F.lit(None).cast("string")).select(*columns))


def cluster_kinds(cases: DataFrame) -> DataFrame:
    """For each ECLI: unique, same_language_duplicate, matched_by_appno_docname or ambiguous."""
    cases = cases.select(normalise_ecli(F.col("ecli")).alias("node"), F.upper(F.coalesce("language", F.lit(""))).alias("lang"), normalise_appnos(F.col("appno")).alias("appnos"), normalise_title(F.col("docname")).alias("title")).where("node is not null")
    groups = cases.groupBy("node").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"), F.count_distinct("appnos").alias("sets"), F.collect_set("title").alias("titles"))
    pairs = groups.where("n > 1 and langs > 1 and sets = 1 and size(titles) > 1").select("node", F.explode("titles").alias("a"), "titles").select("node", "a", F.explode("titles").alias("b")).where("a < b")
    near = pairs.withColumn("s", title_similarity("a", "b")).groupBy("node").agg(F.max("s").alias("similarity"))
    kind = (
        F.when(F.col("n") <= 1, "unique")
        .when(F.col("langs") <= 1, "same_language_duplicate")
        .when((F.col("sets") == 1) & ((F.size("titles") == 1) | (F.coalesce("similarity", F.lit(0.0)) >= SIMILAR)), "matched_by_appno_docname")
        .otherwise("ambiguous")
    )
    return groups.join(near, "node", "left").select("node", "n", kind.alias("kind"))


def rescue_candidates(cases: DataFrame) -> DataFrame:
    """Records to look for in another language: no sibling, application numbers, and a placeholder or no text."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    return cases.where(blank("french_itemid") & ~blank("itemid") & (F.size("appno") > 0) & (F.coalesce("is_placeholder", F.lit(False)) | blank("text")))


def apply_rescue(cases: DataFrame, log: DataFrame) -> DataFrame:
    """Fills missing siblings from the last good record of each document."""
    latest = log.where("status = 'ok'").groupBy("itemid").agg(F.max_by("french_itemid", "seq").alias("__found"))
    return cases.join(latest, "itemid", "left").withColumn("french_itemid", F.coalesce("french_itemid", "__found")).drop("__found")


def hydrate(cases: DataFrame, texts: DataFrame) -> DataFrame:
    """Cases with their own text, else their sibling's, and where it came from."""
    own = texts.select("itemid", F.col("text").alias("__own"), F.col("language").alias("__own_lang"))
    other = texts.select(F.col("itemid").alias("french_itemid"), F.col("text").alias("__other"), F.col("language").alias("__other_lang"))
    joined = cases.join(own, "itemid", "left").join(other, "french_itemid", "left")
    source = F.when(F.col("__own").isNotNull(), F.col("itemid")).when(F.col("__other").isNotNull(), F.col("french_itemid"))
    lang = F.when(F.col("__own").isNotNull(), F.col("__own_lang")).when(F.col("__other").isNotNull(), F.col("__other_lang"))
    return joined.select(*cases.columns, F.coalesce("__own", "__other").alias("text"), source.alias("source_itemid"), lang.alias("source_language"))
