"""Readers, writers and a registry of named tables."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASES = "itemid string, ecli string, appno array<string>, docname string, doctype string, language string, respondent array<string>, articles array<string>, importance string, conclusion string, kp_date date, represented_by string, scl string, is_placeholder boolean, rank double, french_itemid string, seq long"
NAMES = ("cases", "texts", "blocks", "mentions", "resolutions", "occurrences", "nodes", "edges", "paragraphs", "embeddings", "records", "exec_cases", "exec_docs")
READERS = {".parquet": "parquet", ".jsonl": "json", ".json": "json", ".csv": "csv"}


def find_table(folder: str, name: str) -> tuple[str, str] | None:
    """Path and format of a named table in a folder; Parquet comes before other formats."""
    for suffix, fmt in READERS.items():
        path = Path(folder, name + suffix)
        if path.exists():
            return str(path), fmt
    return None


def register_tables(spark: SparkSession, folder: str, names=NAMES) -> list[str]:
    """A temporary view for every named table that is there."""
    found = []
    for name in names:
        if at := find_table(folder, name):
            read_table(spark, at[0], at[1]).createOrReplaceTempView(name)
            found.append(name)
    return found


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None) -> DataFrame:
    fmt = fmt or READERS[Path(path).suffix]
    reader = spark.read.option("header", True).option("escape", '"') if fmt == "csv" else spark.read
    if schema:
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a declared schema; blank and malformed lines are skipped, a missing file is empty."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """A list of wanted documents (itemid, ecli) from JSON lines, CSV or plain lines, without repetitions."""
    suffix = Path(path).suffix
    if suffix in (".json", ".jsonl"):
        rows = spark.read.option("multiLine", suffix == ".json").schema("itemid string, ecli string").json(path)
    elif suffix == ".csv":
        rows = spark.read.option("header", True).csv(path)
        rows = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("itemid", "ecli")))
    else:
        line = F.trim("value")
        is_ecli = F.upper(line).startswith("ECLI:")
        rows = spark.read.text(path).where(line != "").select(F.when(~is_ecli, line).alias("itemid"), F.when(is_ecli, F.upper(line)).alias("ecli"))
    rows = rows.where("itemid is not null or ecli is not null").dropDuplicates(["itemid", "ecli"])
    if rows.isEmpty():
        raise ValueError(f"nothing is selected in {path}")
    return rows


def fetch_by_ids(df: DataFrame, ids: list[str], key: str = "itemid") -> DataFrame:
    """Rows of the given keys, once each, in the order asked for."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(ids))), f"__at long, {key} string")
    return df.join(F.broadcast(wanted) if len(ids) < 100_000 else wanted, key).orderBy("__at").drop("__at")


def rename_coalesced(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Canonical columns from the first present of several spellings."""
    pick = lambda options: [F.col(o) for o in options if o in df.columns] or [F.lit(None).cast("string")]
    return df.select(*(F.coalesce(*pick(options)).alias(name) for name, options in names.items()))


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON strings, for formats without nesting."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    if fmt == "csv":
        flat(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode(mode).format("json" if fmt == "jsonl" else fmt).save(path)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Every file under a folder with its size and SHA-256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def check_inventory(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Files that are missing, changed or not listed."""
    both = manifest.select("path", F.col("sha256").alias("want")).join(actual.select("path", F.col("sha256").alias("have")), "path", "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("have") != F.col("want"), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child rows whose key no parent has."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def write_graph(nodes: DataFrame, links: DataFrame, path: str, fmt: str) -> None:
    """A graph that fits the driver as one JSON, GraphML or CSV-pair file; nodes (id, label) and links (source, target, weight) in order."""
    n = [r.asDict() for r in nodes.select("id", "label").orderBy("id").toLocalIterator()]
    e = [r.asDict() for r in links.select("source", "target", "weight").orderBy("source", "target").toLocalIterator()]
    if fmt == "json":
        Path(path).write_text(json.dumps({"directed": True, "nodes": n, "links": e}, ensure_ascii=False, sort_keys=True, default=str))
    elif fmt == "csv":
        for suffix, rows, names in (("nodes", n, ["id", "label"]), ("links", e, ["source", "target", "weight"])):
            with Path(f"{path}.{suffix}.csv").open("w", newline="") as out:
                writer = csv.DictWriter(out, names)
                writer.writeheader()
                writer.writerows(rows)
    elif fmt == "graphml":
        from xml.sax.saxutils import escape, quoteattr

        lines = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="label" for="node" attr.name="label" attr.type="string"/>', '<key id="weight" for="edge" attr.name="weight" attr.type="double"/>', '<graph edgedefault="directed">']
        lines += [f'<node id={quoteattr(str(x["id"]))}><data key="label">{escape(str(x["label"]))}</data></node>' for x in n]
        lines += [f'<edge source={quoteattr(str(x["source"]))} target={quoteattr(str(x["target"]))}><data key="weight">{x["weight"]}</data></edge>' for x in e]
        Path(path).write_text("\n".join([*lines, "</graph>", "</graphml>"]))
    else:
        raise ValueError(f"no such graph format: {fmt}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of a JSON graph file."""
    whole = spark.read.schema("nodes array<struct<id:string,label:string>>, links array<struct<source:string,target:string,weight:double>>").option("multiLine", True).json(path)
    return whole.select(F.inline("nodes")), whole.select(F.inline("links"))
