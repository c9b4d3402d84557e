"""Bounded labelling studies: units, tasks, budgets, records, costs; and a registry of extractors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EXTRACTORS: dict[str, Callable] = {}


def register_extractor(name: str, factory: Callable) -> None:
    _EXTRACTORS[name] = factory


def get_extractor(name: str, **options):
    if name not in _EXTRACTORS:
        raise KeyError(f"no extractor {name!r}; there are {sorted(_EXTRACTORS)}")
    return _EXTRACTORS[name](**options)


def extract(units: DataFrame, name: str, schema: str, **options) -> DataFrame:
    """Runs an extractor (an iterator of pandas frames to the same) over units, batch by batch."""
    return units.mapInPandas(get_extractor(name, **options), schema)


def unitize(blocks: DataFrame, unit: str) -> DataFrame:
    """Units of a study (document, section or paragraph) from blocks, with an id and their text in order."""
    keys = {"document": ["doc_id"], "section": ["doc_id", "section"], "paragraph": ["doc_id", "para_id"]}[unit]
    rows = blocks.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block_idx", "text"))).alias("r"))
    return rows.select(F.concat_ws(":", F.lit(unit), *(F.col(k).cast("string") for k in keys)).alias("unit_id"), *keys, F.array_join(F.transform("r", lambda x: x["text"]), "\n\n").alias("text"))


def task_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def plan(units: DataFrame, stages: list[str]) -> DataFrame:
    """Tasks of every unit and stage, and their estimated input tokens (a quarter of the characters)."""
    return units.select("unit_id", F.explode(F.array(*(F.lit(s) for s in stages))).alias("stage"), F.floor(F.length("text") / 4).alias("tokens")).groupBy("stage").agg(F.count("*").alias("tasks"), F.sum("tokens").alias("input_tokens"))


def cost(input_tokens: Column, output_tokens: Column, prices: tuple[float, float], batch: bool = False) -> Column:
    """US dollars at prices per million input and output tokens; half in batches."""
    return F.round((input_tokens * prices[0] + output_tokens * prices[1]) / 1e6 * (0.5 if batch else 1.0), 6)


def response_payload(parsed: Column, path: str = "$.response.text") -> Column:
    """The payload of a JSON response, or why there is none."""
    found = F.get_json_object(parsed, path)
    error = F.coalesce(F.get_json_object(parsed, "$.error.message"), F.when(found.isNull(), "no payload"))
    return F.struct(found.alias("payload"), error.alias("error"))


def validated(records: DataFrame, required: list[str]) -> DataFrame:
    """Records with a status: ok, or error with the names of required fields that are missing."""
    missing = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required)), lambda c: c.isNotNull())
    return records.withColumn("missing", missing).withColumn("status", F.when(F.size("missing") == 0, "ok").otherwise("error"))
