"""Queries of the ten operators and of the pipeline, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketlake.llm import curriculum, exact_search, line_dedup, suffix_dedup, url_filter
from docketlake.llm.language_crf import label_languages
from docketlake.llm.near_duplicates import near_duplicates
from docketlake.llm.packing import pack_documents
from docketlake.llm.pii_bootstrap import find_identifiers
from docketlake.llm.robust_quality import reject_outliers

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_identifiers(_docs(spark, sf_dir))


def op2_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_languages(_docs(spark, sf_dir))


def op3_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_docs(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(_docs(spark, sf_dir))


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_docs(spark, sf_dir))


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix_sources(_docs(spark, sf_dir))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_docs(spark, sf_dir))


def op8_url_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    redirects, allow = url_filter.hops_and_allowed(pages)
    return url_filter.filter_urls(pages, redirects=redirects, allow=allow)


def op9_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_outliers(_docs(spark, sf_dir))


def op10_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumnRenamed("item_id", "doc_id")
    return exact_search.top_k_search(_docs(spark, sf_dir), items)


def queries() -> dict[str, Query]:
    return {
        "op1_pii_bootstrap": op1_pii_bootstrap,
        "op2_language_crf": op2_language_crf,
        "op3_prefix_free_parsing": op3_prefix_free_parsing,
        "op4_line_dedup": op4_line_dedup,
        "op5_chosen_path": op5_chosen_path,
        "op6_curriculum_mix": op6_curriculum_mix,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_url_equivalence": op8_url_equivalence,
        "op9_robust_quality": op9_robust_quality,
        "op10_exact_search": op10_exact_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_prefix_free_parsing": suffix_dedup.SQL, "op4_line_dedup": line_dedup.SQL, "op6_curriculum_mix": curriculum.SQL, "op8_url_equivalence": url_filter.SQL, "op10_exact_search": exact_search.SQL}
