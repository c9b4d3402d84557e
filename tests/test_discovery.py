from docketlake.operators import discovery as D
from docketlake.operators import segmentation as G


def test_grammars_and_back_references():
    text = (
        "The Court refers to Alpha Beta v. Germany [GC], no. 12345/05, §§ 12 and 14-16, and to Smith v. the United Kingdom, judgment of 5 March 1990, § 3. See also Alpha Beta, cited above, § 20; ibid., § 21.\n"
        "Case of Klein v. Russia. Request no. P16-2018-001 and ECLI:CE:ECHR:2004:0506JUD001, 001-5678. Applications nos. 1/99 and 22/00. Dudgeon v. Ireland, Commission decision of 3 May 1980, DR 12, p. 34.\n"
        "Dans l'affaire Dupont c. France, n° 12/03, § 4; Dupont, précité, § 5. See A.B. v. Norway, ECHR 2005-IV. However, cited above or not, nothing follows."
    )
    rows = D.find_in_text(text)
    got = [(r[3], r[7], r[8], r[9], r[10], r[11]) for r in rows]
    assert got == [
        ("named_application", "Alpha Beta v. Germany [GC], no. 12345/05", "Alpha Beta v. Germany", ["12345/05"], None, ["12", "14-16"]),
        ("named_judgment", "Smith v. the United Kingdom, judgment of 5 March 1990", "Smith v. the United Kingdom", [], None, ["3"]),
        ("back_reference", "Alpha Beta, cited above", "Alpha Beta v. Germany", ["12345/05"], None, ["20"]),
        ("carried", "ibid.", "Alpha Beta v. Germany", ["12345/05"], None, ["21"]),
        ("named_case", "Case of Klein v. Russia", "Klein v. Russia", [], None, []),
        ("advisory_opinion", "Request no. P16-2018-001", None, [], "P16-2018-001", []),
        ("ecli", "ECLI:CE:ECHR:2004:0506JUD001", None, [], "ECLI:CE:ECHR:2004:0506JUD001", []),
        ("itemid", "001-5678", None, [], "001-5678", []),
        ("application", "nos. 1/99 and 22/00", None, ["1/99", "22/00"], None, []),
        ("commission_decision", "Dudgeon v. Ireland, Commission decision of 3 May 1980", "Dudgeon v. Ireland", [], None, []),
        ("decisions_and_reports", "DR 12, p. 34", None, [], None, []),
        ("named_application", "Dupont c. France, n° 12/03", "Dupont c. France", ["12/03"], None, ["4"]),
        ("back_reference", "Dupont, précité", "Dupont c. France", ["12/03"], None, ["5"]),
        ("named_reporter", "A.B. v. Norway, ECHR 2005-IV", "A.B. v. Norway", [], None, []),
    ]
    assert all(text[r[6] : r[6] + len(r[7])] == r[7] for r in rows)
    assert [r[12] for r in rows if r[3] in ("back_reference", "carried")] == [0, 0, 11]


def test_places_never_overlap_and_odd_texts():
    for text in ("", "\n\n", "no. 1/99", "A v. B v. C, no. 1/99 and no. 2/99, cited above", "ibid. ibid.", "A v. " * 3000):
        rows = D.find_in_text(text)
        ends = [(r[1], r[4], r[5]) for r in rows]
        assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(ends, ends[1:]))


def test_discovery_over_a_table(spark):
    docs = spark.createDataFrame([(1, "See A v. B, no. 1/99, § 7."), (2, None), (3, ""), (None, "no. 5/01")], "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.raw_text, r.pinpoints) for r in D.discover(docs).collect()))
    assert got == [("1", "A v. B, no. 1/99", ["7"]), ("None", "no. 5/01", [])]
    listed = spark.createDataFrame([(1, "m1", ["1/99"], None), (1, "m2", ["3/00"], "Case of A v. B")], "doc_id long, mention_id string, appnos array<string>, title string")
    assert [r.coverage for r in D.coverage(D.discover(docs), listed).orderBy("doc_id").collect()] == ["not_covered", "indeterminate"]


def test_sections_in_canonical_order_without_the_table_of_contents():
    text = "X v. Y\nPROCEDURE\nTHE FACTS\nTHE LAW\nPROCEDURE\n1. It began in a way that takes some words to tell.\nTHE FACTS\n2. It was.\nTHE LAW\n3. Law.\nTHE FACTS\nFOR THESE REASONS, THE COURT\n1. Holds\nDISSENTING OPINION OF JUDGE X\nI differ.\nAPPENDIX\nlist"
    mode, status, sure, sections, missing, toc = G.cut_sections(text)
    assert [s[0] for s in sections] == ["procedure", "facts", "the_law", "operative", "separate_opinions", "appendix"]
    assert (mode, status, missing, toc) == ("judgment", "complete", [], [2, 3, 4]) and 0 < sure <= 1
    assert all(a[2] + 1 == b[1] for a, b in zip(sections, sections[1:])) and text[sections[2][3] :].startswith("THE LAW\n3.")
    assert G.cut_sections("plain text")[1:3] == ("unsegmented", 0.0)
    assert G.cut_sections("THE FACTS\nx\nTHE LAW\ny")[1] == "partial" and G.cut_sections("THE FACTS\nx", "communicated_case")[4] == ["complaints or the_law"]
    assert G.cut_sections("EN FAIT\nx\nEN DROIT\ny\nPAR CES MOTIFS, LA COUR\nz")[1] == "complete"


def test_segment_modes_bench_and_notes(spark):
    rows = [
        (1, "PRESS RELEASE\nTHE LAW\nx", None), (2, "THE LAW\nx\nFOR THESE REASONS\ny", "HEJUD"), (3, None, None), (4, "STATEMENT OF FACTS\nx\nQUESTIONS TO THE PARTIES\ny", None),
        (5, "The Court, sitting as a Chamber composed of:\n Anna Krull, President,\n Bertil Ostman,\n Mr Carl van Neri, judges,\nand Dora Wex, Section Registrar,\nHaving deliberated", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doctype string")
    found = G.segment(docs, doctype="doctype")
    got = {r.doc_id: (r.mode, r.status) for r in found.collect()}
    assert got == {1: ("press_release", "unsegmented"), 2: ("judgment", "complete"), 3: ("judgment", "unsegmented"), 4: ("communicated_case", "complete"), 5: ("judgment", "unsegmented")}
    assert G.section_rows(found).where("doc_id = 2").count() == 2
    bench = G.bench(docs).collect()
    assert [(r.doc_id, r.judges, r.president, r.formation) for r in bench] == [(5, ["Anna Krull", "Bertil Ostman", "Carl van Neri"], "Anna Krull", "chamber")]
    blocks = spark.createDataFrame([(1, 1, "facts", "1", None, ["a"]), (1, 2, "the_law", "2", None, ["a", "b"]), (1, 3, None, None, "a", []), (1, 4, None, None, "b", []), (1, 5, None, None, "c", [])], "doc_id long, block_idx int, section string, para_id string, footnote_id string, footnotes array<string>")
    notes = {r.footnote_id: (r.section, r.invoking_para, r.invocations) for r in G.footnote_context(blocks).collect()}
    assert notes == {"a": (None, None, 2), "b": ("the_law", "2", 1), "c": (None, None, 0)}
