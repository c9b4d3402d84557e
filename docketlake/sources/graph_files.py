"""Graph files of any size: lines made by the tasks, in one order, so that the parts of the written folder joined are the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {T.ByteType: "long", T.ShortType: "long", T.IntegerType: "long", T.LongType: "long", T.FloatType: "double", T.DoubleType: "double", T.BooleanType: "boolean"}


def xml_text(value: Column) -> Column:
    """A value as XML has it in quotes: markup escaped, characters that XML forbids left out; lists joined by semicolons."""
    text = F.regexp_replace(value.cast("string"), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def _attributes(df: DataFrame, ids: tuple[str, ...]) -> tuple[list[str], Column]:
    """Declarations of all columns but ``ids``, and their values in a row; a null has none."""
    declared, values = [], []
    fields = [f for f in df.schema.fields if f.name not in ids]
    for i, f in enumerate(fields):
        value = F.array_join(F.col(f.name).cast("array<string>"), ";") if isinstance(f.dataType, T.ArrayType) else F.to_json(f.name) if isinstance(f.dataType, (T.StructType, T.MapType)) else F.col(f.name)
        title = f.name.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
        declared.append(f'<attribute id="{i}" title="{title}" type="{KINDS.get(type(f.dataType), "string")}"/>')
        values.append(F.when(F.col(f.name).isNotNull(), F.concat(F.lit(f'<attvalue for="{i}" value="'), xml_text(value), F.lit('"/>'))))
    joined = F.concat_ws("", *values) if values else F.lit("")
    return declared, F.when(joined != "", F.concat(F.lit("<attvalues>"), joined, F.lit("</attvalues>"))).otherwise("")


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines (section, place, line) of a GEXF 1.3 file of a directed graph.

    Nodes have ``id`` and perhaps ``label``, edges ``source``, ``target`` and perhaps ``weight``; all other columns become
    attributes. Nodes and edges whose names are null are left out.
    """
    spark = nodes.sparkSession
    label = F.coalesce(F.col("label").cast("string"), F.col("id").cast("string")) if "label" in nodes.columns else F.col("id")
    n_kinds, n_values = _attributes(nodes, ("id", "label"))
    e_kinds, e_values = _attributes(edges, ("source", "target", "weight"))
    weight = F.when(F.col("weight").isNotNull(), F.concat(F.lit(' weight="'), F.col("weight").cast("string"), F.lit('"'))).otherwise("") if "weight" in edges.columns else F.lit("")
    n = nodes.where("id is not null").select(F.lit(1).alias("section"), F.col("id").cast("string").alias("place"), F.concat(F.lit('<node id="'), xml_text(F.col("id")), F.lit('" label="'), xml_text(label), F.lit('">'), n_values, F.lit("</node>")).alias("line"))
    pair = F.concat_ws("\t", F.col("source").cast("string"), F.col("target").cast("string"))
    e = edges.where("source is not null and target is not null").select(F.lit(3).alias("section"), pair.alias("place"), F.concat(F.lit('<edge source="'), xml_text(F.col("source")), F.lit('" target="'), xml_text(F.col("target")), F.lit('"'), weight, F.lit(">"), e_values, F.lit("</edge>")).alias("line"))
    kinds = lambda what, found: [f'<attributes class="{what}">', *found, "</attributes>"] if found else []
    frame = [(0, x) for x in ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3">', '<graph defaultedgetype="directed">', *kinds("node", n_kinds), *kinds("edge", e_kinds), "<nodes>"]]
    frame += [(2, "</nodes>"), (2, "<edges>"), (4, "</edges>"), (4, "</graph>"), (4, "</gexf>")]
    rest = spark.createDataFrame([(s, f"{i:06d}", x) for i, (s, x) in enumerate(frame)], "section int, place string, line string")
    return n.union(e).union(rest)


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "error") -> None:
    """A folder of text files whose contents, in order of their names, are one GEXF file."""
    gexf_lines(nodes, edges).orderBy("section", "place", "line").select("line").write.mode(mode).text(path)
