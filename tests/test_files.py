"""Graph files and Markdown."""

import xml.etree.ElementTree as ET
from pathlib import Path

from docketlake.operators.blocks import html_to_markdown, markdown_of
from docketlake.sources.graph_files import write_gexf

NS = "{http://gexf.net/1.3}"


def test_gexf_parts_joined_are_one_file(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 'A & "B" <c>', ["x", "y"], 3, None), ("b", None, None, None, True), (None, "lost", None, 1, None)], "id string, label string, articles array<string>, n int, flag boolean")
    edges = spark.createDataFrame([("a", "b", 2.5, "ref\x01 1"), ("b", "a", None, None), (None, "a", 1.0, "lost")], "source string, target string, weight double, raw_ref string")
    write_gexf(nodes, edges, str(tmp_path / "g"))
    parts = sorted(Path(tmp_path / "g").glob("part-*"))
    root = ET.fromstring("".join(p.read_text() for p in parts))
    found = {n.get("id"): (n.get("label"), {v.get("for"): v.get("value") for v in n.iter(f"{NS}attvalue")}) for n in root.iter(f"{NS}node")}
    assert found == {"a": ('A & "B" <c>', {"0": "x;y", "1": "3"}), "b": ("b", {"2": "true"})}
    links = [(e.get("source"), e.get("target"), e.get("weight"), [v.get("value") for v in e.iter(f"{NS}attvalue")]) for e in root.iter(f"{NS}edge")]
    assert links == [("a", "b", "2.5", ["ref 1"]), ("b", "a", None, [])]
    assert [a.get("type") for a in root.iter(f"{NS}attribute")] == ["string", "long", "boolean", "string"]


def test_gexf_of_an_empty_graph(spark, tmp_path):
    write_gexf(spark.createDataFrame([], "id string"), spark.createDataFrame([], "source string, target string"), str(tmp_path / "g"))
    root = ET.fromstring("".join(p.read_text() for p in sorted(Path(tmp_path / "g").glob("part-*"))))
    assert not list(root.iter(f"{NS}node")) and not list(root.iter(f"{NS}edge"))


def test_markdown_blocks_emphasis_and_links():
    html = "<head><title>no</title><body><h2>The <i>facts</i></h2><p>One <b>bold</b> and <a href='http://x.org/'>link</a>.<ul><li>first<li><strong>second</strong></ul><blockquote>said</blockquote><script>no</script><p>open <b>end"
    assert markdown_of(html) == "## The _facts_\n\nOne **bold** and [link](http://x.org/).\n\n- first\n\n- **second**\n\n> said\n\nopen **end**"


def test_markdown_footnotes():
    html = "<p>Text<a href='#_ftn1'>[1]</a> goes on.</p><div id='_ftn1'><p><a href='#_ftnref1'>[1]</a> A note.</p><p>More of it.</p></div><p>After.</p>"
    assert markdown_of(html) == "Text[^1] goes on.\n\n[^1]: A note.\n\n    More of it.\n\nAfter."


def test_markdown_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "no tag"), (4, "<p></p><b></b>")], "page_id long, html string")
    assert [r.text for r in html_to_markdown(pages).orderBy("page_id").collect()] == ["", "", "no tag", ""]
