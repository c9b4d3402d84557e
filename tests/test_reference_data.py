import pytest
from pyspark.sql import functions as F

from docketlake.operators import embeddings, reference_data as rd, spans
from docketlake.sources import scratch


def test_execution(spark):
    df = spark.createDataFrame([("CEC;all",), (" acp ; x",), ("odd;x",), (None,)], "c string")
    assert [r[0] for r in df.select(rd.collection_code(F.col("c"))).collect()] == ["CEC", "acp", "odd", ""]
    titles = {"Updated Action Plan": "acp", "Decision of the Committee": "CMDEC", "Communication from an NGO": "ngo", "Communication from the authorities": "gvo", "Memorandum": "HEXEC", "Note": "unknown"}
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r[0] for r in df.select(rd.document_type(F.col("t"))).collect()] == list(titles.values())
    cases = spark.createDataFrame([("1/02", "NOR"), ("3/04", "SWE")], "appno string, state string")
    docs = spark.createDataFrame([("1/02", "d1", "t", "acp;all"), ("1/02", "d2", "t", "ngo"), ("1/02", "d3", "t", "gvo")], "appno string, document_id string, title string, collection string")
    got = {r.appno: r for r in rd.execution_cases(cases, docs).collect()}
    assert [d.document_id for d in got["1/02"].communications] == ["d2", "d3"] and len(got["1/02"].action_plans) == 1 and got["3/04"].resolutions == []
    assert rd.filter_execution(cases, state="NOR", supervision=None).count() == 1


def test_versions_and_scans(spark):
    df = spark.createDataFrame([("ENG", "HEJUD", "A v. B"), ("GER", "HEJUD", "A v. B"), ("ENG", "CLIN", "x"), ("SPA", "CLIN", "x"), ("FRE", "HEDEC", "y")], "language string, doctype string, docname string")
    got = [(r.document_kind, r.rendition_kind) for r in rd.versions(df).collect()]
    assert got == [("judgment", "official_text"), ("judgment", "translation"), ("legal_summary", "official_summary"), ("legal_summary", "translated_summary"), ("decision", "official_text")]
    df = spark.createDataFrame([("x" * 200, 9), ("x" * 10, 1), ("x" * 60, 3), ("x" * 60, 1), (None, None)], "t string, p int")
    assert [r[0] for r in df.select(rd.looks_scanned(F.col("t"), F.col("p"))).collect()] == [False, True, True, False, True]


def test_keypoints(spark):
    kp = spark.createDataFrame([("1", "Fair trial", None), ("2", "Fair hearing", "1"), ("3", "Hearing", "2"), ("4", "Loop", "5"), ("5", "Loop", "4")], "id string, label string, parent string")
    ids = lambda q: sorted(r.id for r in rd.resolve_keypoint(kp, q).collect())
    assert ids("77") == ["77"] and ids("hearing") == ["3"] and ids("fair") == ["1", "2"] and ids("none") == []
    up = {(r.id, r.ancestor): r.distance for r in rd.ancestors(kp).collect()}
    assert up == {("2", "1"): 1, ("3", "2"): 1, ("3", "1"): 2, ("4", "5"): 1, ("5", "4"): 1}


def test_authorities_and_rosters(spark):
    rows = [(1, "eng", "Alpha v. Norland", None, None), (2, "eng", "ALPHA v. Norland", "E1", "001-1"), (1, "fra", "Alpha c. Norland", "E1", None)]
    got = {r.language: r for r in rd.merge_authorities(spark.createDataFrame(rows, "edition int, language string, citation string, ecli string, itemid string")).collect()}
    assert got["eng"].ecli == "E1" and got["eng"].citation == "Alpha v. Norland" and got["eng"].equivalent == "Alpha c. Norland" and got["fra"].equivalent == "Alpha v. Norland"
    roster = spark.createDataFrame([("Élan Müller", "NOR")], "name string, country string")
    assert [r.country for r in rd.match_roster(spark.createDataFrame([("elan MULLER",), ("X",)], "name string"), roster).orderBy("name").collect()] == [None, "NOR"]
    refs = spark.createDataFrame([("Gamma Shipping", "Court of X, Gamma Shipping Ltd; other")], "cited_name string, external_sources string")
    assert rd.match_external(refs).first().matched == "Court of X, Gamma Shipping Ltd"


def test_spans(spark):
    a = spark.createDataFrame([(1, 0, 3000, "a"), (1, 5000, 5001, "b")], "doc_id int, start int, end int, x string")
    b = spark.createDataFrame([(1, 2900, 3100, "p"), (1, 3000, 3005, "q"), (1, 100, 2500, "r"), (2, 0, 9, "s")], "doc_id int, start int, end int, y string")
    assert sorted((r.x, r.y) for r in spans.overlapping(a, b, "doc_id").collect()) == [("a", "p"), ("a", "r")]
    c = spark.createDataFrame([(1, 0, 5, 1), (1, 0, 9, 1), (1, 3, 4, 9), (1, 9, 12, 1)], "doc_id int, start int, end int, strength int")
    assert sorted((r.start, r.end) for r in spans.select_spans(c, ["doc_id"]).collect()) == [(0, 9), (9, 12)]
    o = spark.createDataFrame([(1, 1, 0, "12/99", "T"), (1, 1, 9, "ibid.", None), (1, 2, 0, "Ibid", None), (1, 3, 0, "a", "X"), (1, 3, 5, "b", "Y"), (1, 4, 0, "ibid.", None)], "doc_id int, block_idx int, start int, raw_text string, target string")
    got = [(r.block_idx, r.target) for r in spans.carry_back_references(o).where("carried").orderBy("block_idx").collect()]
    assert got == [(1, "T"), (2, "T")]


def test_alignment(spark):
    ann = spark.createDataFrame([("a1", 1, 0, 10, "Alpha v. B", "Alpha", ["1/02"]), ("a2", 1, 90, 95, "other", "zz", [])], "annotation_id string, doc_id int, start int, end int, span string, citation string, appnos array<string>")
    cand = spark.createDataFrame([("c1", 1, 0, 10, "ALPHA v B", "see alpha", ["1/02"]), ("c2", 1, 300, 310, "Alpha v. B.", "x", [])], "candidate_id string, doc_id int, start int, end int, raw string, context string, appnos array<string>")
    scores = {(r.annotation_id, r.candidate_id): (r.score, r.family) for r in spans.alignment_scores(ann, cand).collect()}
    assert scores == {("a1", "c1"): (1525, "strict_source_span"), ("a1", "c2"): (500, "normalised_context")}
    rows = [("a", "c", 5), ("b", "c", 5), ("d", "c", 3), ("e", "f", 2), ("e", "g", 2)]
    got = spans.align(spark.createDataFrame(rows, "annotation_id string, candidate_id string, score int")).collect()
    assert [(r.annotation_id, r.candidate_id) for r in got] == [("d", "c")]


def test_embeddings(spark):
    units = spark.createDataFrame([("p1", "privacy at home", "law", None), ("p2", "", "law", None), ("p3", None, "facts", None), ("p4", "note", None, "f1")], "paragraph_id string, text string, section string, footnote_id string")
    v = embeddings.build_embeddings(units, "paragraph_id", embeddings.hash_provider(16))
    rows = {r.paragraph_id: r.embedding for r in v.collect()}
    assert set(rows) == {"p1", "p2", "p4"} and sum(x * x for x in rows["p1"]) == pytest.approx(1) and not any(rows["p2"])
    m = embeddings.manifest(v, "paragraph_id", model="hash")
    embeddings.verify(v, "paragraph_id", m)
    with pytest.raises(ValueError, match="rows"):
        embeddings.verify(v.limit(1), "paragraph_id", m)
    assert [r.paragraph_id for r in embeddings.select_units(units, include_footnotes=True).collect()] == ["p4"]


def test_ancestors_are_merged(spark, monkeypatch):
    """No level is sent to the driver and all tasks."""
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return scratch.written(df)

    monkeypatch.setattr(rd, "written", kept)
    rows = rd.ancestors(spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent string")).collect()
    assert sorted((r.id, r.ancestor, r.distance) for r in rows) == [("b", "a", 1), ("c", "a", 2), ("c", "b", 1)]
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)
