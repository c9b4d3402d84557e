import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketlake.operators import blocks, citations, graph, local, quality, reconcile, records, retrieval, studies
from docketlake.operators.predicates import Q, one_of, query_from_url, search, search_query, sort_by
from docketlake.sources import scratch, tables
from docketlake.streaming import logs


def test_predicate_strings():
    q = Q.field("respondent", "NOR") & (Q.text("a") | Q.phrase("b c")) & ~Q.near("x y", 3)
    assert q.render() == 'respondent:"NOR" AND (a OR "b c") AND NOT ("x y"~3)'
    assert len((Q.text("a") & Q.text("b") & Q.text("c")).parts) == 3
    assert search_query() is None and search_query(appno=["1/02", "3/04"]).render() == 'appno:"1/02" OR appno:"3/04"'
    with pytest.raises(TypeError):
        Q.text("a") & "b"


def test_predicate_columns(spark):
    rows = [("1", ["NOR"], dt.date(2001, 1, 1), "alpha beta gamma", "No violation", 0.2), ("2", ["SWE"], dt.date(2002, 1, 1), "beta alpha", "Violation", 0.9), ("3", ["NOR"], None, "gamma", None, 0.9)]
    df = spark.createDataFrame(rows, "itemid string, respondent array<string>, kp_date date, text string, conclusion string, rank double")
    ids = lambda q: sorted(r.itemid for r in search(df, q).collect())
    assert ids(Q.field("respondent", "NOR")) == ["1", "3"]
    assert ids(Q.text("alpha beta")) == ["1", "2"] and ids(Q.phrase("alpha beta")) == ["1"] and ids(Q.near("alpha gamma", 2)) == ["1"] and ids(Q.near("alpha gamma", 1)) == []
    assert ids(Q.field("conclusion", "violation")) == ["1", "2"]
    assert ids(Q.date_range("2001-06-01")) == ["2"] and ids(~Q.date_range("2001-06-01")) == ["1"]
    assert ids(one_of("itemid", ["1", "3"], True) & Q.raw("rank > 0.5")) == ["3"]
    assert [r.itemid for r in sort_by(df, "relevance").collect()] == ["2", "3", "1"]
    with pytest.raises(ValueError, match="no such order"):
        sort_by(df, "sideways")


def test_url_queries():
    hosts = ("search.example.org",)
    assert query_from_url("https://search.example.org/?i=001-5", hosts).render() == 'itemid="001-5"'
    q = query_from_url('https://search.example.org/#{"fulltext":["a"],"respondent":["X","Y"],"kpdate":["2001-01-01T00:00:00","2002-01-01"]}', hosts)
    assert q.render().startswith('a AND (respondent:"X" OR respondent:"Y")')
    with pytest.raises(ValueError):
        query_from_url("https://elsewhere.example.org/?i=1", hosts)


def test_records(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("", 4), ("", 5)], "k string, seq int")
    assert sorted(r.seq for r in records.first_per_key(df, "k", "seq").collect()) == [1, 3, 4, 5]
    log = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 3)], "itemid string, v string, seq long")
    new = spark.createDataFrame([("a", "A", 1), ("c", "C", 2), (None, "N", 3)], "itemid string, v string, seq long")
    got = [(r.itemid, r.v) for r in records.upsert(log, new, "itemid").orderBy("seq").collect()]
    assert got == [("a", "x"), ("a", "A"), ("b", "z"), ("c", "C"), (None, "N")]
    with pytest.raises(ValueError, match="unique"):
        records.require_unique(log, "itemid")
    assert records.run_totals(spark.createDataFrame([("ok", 1, 2, 0.5), ("error", None, None, None)], "status string, input_tokens int, output_tokens int, cost_usd double")).first().asDict() == {"ok": 1, "error": 1, "skipped": 0, "input_tokens": 1, "output_tokens": 2, "cost_usd": 0.5}


def test_reconcile(spark):
    rows = [
        ("e1", "X:1", "ENG", None, 1), ("f1", "x: 1", "FRE", "", 2), ("f2", "X:1", "FRE", "Counsel", 3), ("e1", "X:1", "ENG", "later", 4), ("e2", "X:1", "ENG", "p", 5),
        ("f3", "X:2", "FRE", "q", 6), ("e4", None, "ENG", "r", 7), ("g1", "X:1", "GER", "s", 8),
    ]
    df = spark.createDataFrame(rows, "itemid string, ecli string, language string, represented_by string, seq int")
    got = {(r.itemid, r.seq): (r.role, r.sibling_itemid, r.represented_by) for r in reconcile.reconcile(df).collect()}
    assert got[("e1", 1)] == ("primary", "f2", "Counsel") and got[("f2", 3)][0] == "sibling" and got[("f1", 2)][0] == "duplicate"
    assert got[("e1", 4)][0] == "duplicate" and got[("e2", 5)][0] == "duplicate" and got[("f3", 6)][0] == "primary" and got[("e4", 7)][0] == "other" and got[("g1", 8)][0] == "other"
    kinds = spark.createDataFrame([("A", "ENG", ["1/02"], "Alpha v. Norland"), ("A", "FRE", ["1/02"], "Alpha c. Norland"), ("B", "ENG", ["1/02"], "X"), ("C", "ENG", ["1/02"], "X"), ("C", "ENG", [], "X"), ("D", "ENG", ["1/02"], "Qq"), ("D", "FRE", ["1/02"], "Zz")], "ecli string, language string, appno array<string>, docname string")
    assert {r.node: r.kind for r in reconcile.cluster_kinds(kinds).collect()} == {"A": "matched_by_appno_docname", "B": "unique", "C": "same_language_duplicate", "D": "ambiguous"}


def test_hydrate(spark):
    cases = spark.createDataFrame([("1", "9"), ("2", "9"), ("3", None)], "itemid string, french_itemid string")
    texts = spark.createDataFrame([("1", "own", "ENG"), ("9", "autre", "FRE")], "itemid string, text string, language string")
    got = {r.itemid: (r.text, r.source_itemid, r.source_language) for r in reconcile.hydrate(cases, texts).collect()}
    assert got == {"1": ("own", "1", "ENG"), "2": ("autre", "9", "FRE"), "3": (None, None, None)}


def test_bm25_against_a_plain_formula(spark):
    import math

    texts = {1: "a b b c", 2: "b c", 3: "c c c", 4: "d"}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {r.id: r.score for r in retrieval.bm25(df, "id", ["b", "d"], None).collect()}
    n, average = 4, 10 / 4
    want = {}
    for i, text in texts.items():
        w = text.split()
        s = sum(max(math.log((n - sum(t in x.split() for x in texts.values()) + 0.5) / (sum(t in x.split() for x in texts.values()) + 0.5)), 1e-6) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / average)) for t in ("b", "d") if t in w)
        if s:
            want[i] = round(s, 6)
    assert got == want


def test_fusion_and_retriever(spark):
    a = spark.createDataFrame([("p1", 2.0), ("p2", 1.0)], "paragraph_id string, score double")
    b = spark.createDataFrame([("p2", 0.9), ("p3", 0.8)], "paragraph_id string, score double")
    got = retrieval.reciprocal_rank_fusion([a, b], "paragraph_id", 5).collect()
    assert [r.paragraph_id for r in got] == ["p2", "p1", "p3"] and got[0].rrf_score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    units = spark.createDataFrame([("p1", "privacy of home", "ENG", [1.0, 0.0]), ("p2", "torture", "ENG", [0.0, 1.0]), ("p3", "privacy", "FRE", [1.0, 0.1]), ("p4", "other", "ENG", None)], "paragraph_id string, text string, language string, embedding array<double>")
    r = retrieval.HybridRetriever(units, top_k=2)
    assert [x.paragraph_id for x in r.search(vector=[0.0, 2.0]).collect()] == ["p2", "p3"]
    assert [x.paragraph_id for x in r.search("privacy", [1.0, 0.0], language="eng").collect()] == ["p1", "p2"]
    with pytest.raises(ValueError, match="unknown filter"):
        r.search("privacy", colour="red")


def test_labels_evaluated_without_pairs(spark):
    """As many as the pairs give, for ranks with and without hits and items without a label."""
    items = spark.createDataFrame([(i, None if i == 7 else i % 3) for i in range(12)], "item long, label int")
    queries = spark.createDataFrame([(0, 0), (1, 1), (2, 5), (3, None)], "query_id long, label int")
    ranked = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 3, 3), (1, 7, 1), (1, 5, 2), (1, 4, 3), (2, 5, 1)], "query_id long, item long, rank long")
    pairs = queries.join(items, "label").select("query_id", "item")
    got = retrieval.evaluate_labels(ranked, queries, items, 3)
    assert got.collect() == retrieval.evaluate(ranked, pairs, 3).collect() and got.first().queries == 2


def test_best_of_blocks():
    """The best of a task, with ties, whatever pieces its vectors come in; the rest isn't kept."""
    scores = np.round(np.random.default_rng(1).random((5, 4000)), 3)
    best = retrieval._Best(5, 10)
    best.most = 200
    for i in range(0, 4000, 7):
        best.add(scores[:, i : i + 7], pa.array(range(i, min(i + 7, 4000))))
        assert best.size <= best.most + 35
    row, keys, found = best.kept()
    for q in range(5):
        least = np.sort(scores[q])[-10]
        assert sorted(np.array(keys)[row == q]) == list(np.flatnonzero(scores[q] >= least))
        assert (found[row == q] >= least).all()


def test_html_in_pieces():
    """A batch of any size is parsed a piece at a time."""
    html = [None, "", "x" * 10, "y" * 25, None, "z" * 3] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(120)), pa.array(html)], ["doc_id", "html"])
    parts = list(blocks.pieces([batch, batch.slice(0, 0)], "html", 20))
    assert [v for p in parts for v in p.column("html").to_pylist()] == html and [i for p in parts for i in p.column("doc_id").to_pylist()] == list(range(120))
    assert all(p.num_rows == 1 or sum(len(v or "") for v in p.column("html").to_pylist()) <= 20 for p in parts)


def test_graph(spark):
    edges = spark.createDataFrame([("a", "hub", 1), ("b", "hub", 1), ("c", "hub", 1), ("a", "b", 2)], "source string, target string, citation_count long")
    ranks = {r.node: r["rank"] for r in graph.pagerank(edges, iterations=30).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and max(ranks, key=ranks.get) == "hub"
    assert graph.pagerank(edges.limit(0)).collect() == []
    between = {r.node: r.betweenness for r in graph.betweenness(spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1)], edges.schema), normalised=False).collect()}
    assert between == {"a": 0.0, "b": 2.0, "c": 2.0, "d": 0.0}
    two = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("x", "y", 1)], edges.schema)
    assert {r.node: r.label for r in graph.communities(two).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert graph.compare_edges(edges, edges.where("source = 'a'")).first().asDict() == {"shared": 2, "only_mine": 2, "only_other": 0}


def test_communities_held_and_joined(spark):
    """Arrays and joined tables give the same communities."""
    rng = np.random.default_rng(3)
    pairs = {(f"v{a}", f"v{b}") for a, b in rng.integers(0, 40, (90, 2))}
    edges = spark.createDataFrame([(a, b, 1 + (len(a + b) + i) % 3) for i, (a, b) in enumerate(sorted(pairs))], "source string, target string, citation_count long")
    held = {r.node: r.label for r in graph.communities(edges, most=3).collect()}
    assert held == {r.node: r.label for r in graph.communities(edges, most=3, held_nodes=0).collect()}
    assert list(graph._half_up(np.array([0.0000000005, -0.0000000015, 1.2345678904, 2.5]))) == [1e-9, -2e-9, 1.23456789, 2.5]


def test_pagerank_sends_changes(spark):
    """As the iteration over all nodes gives, with cycles and without."""
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("b", "a", 1), ("d", "b", 3), ("d", "c", 1), ("c", "e", 1)], "source string, target string, citation_count long")
    x = dict.fromkeys("abcde", 1.0)
    for _ in range(200):
        new = dict.fromkeys(x, 1.0)
        for r in edges.collect():
            new[r.target] += 0.85 * x[r.source] * r.citation_count / {"a": 1, "b": 3, "d": 4, "c": 1}[r.source]
        x = new
    got = {r.node: r["rank"] for r in graph.pagerank(edges, weighted=True).collect()}
    assert got == pytest.approx({v: y / sum(x.values()) for v, y in x.items()}, abs=1e-6)
    plain = graph.pagerank(edges.where("source <> 'b' or target <> 'a'"), iterations=2).collect()
    assert sum(r["rank"] for r in plain) == pytest.approx(1)


def test_betweenness_in_blocks(spark):
    """Blocks of sources give the same, and none of their tables is left."""
    edges = spark.createDataFrame([(f"p{i}", f"s{i % 4}", 1) for i in range(12)] + [(f"s{i}", f"n{i % 2}", 1) for i in range(4)] + [("n0", "r", 1), ("n1", "r", 1), ("r", "p0", 1), ("p1", "s2", 1)], "source string, target string, citation_count long")
    before = len(scratch._WRITTEN)
    whole = {r.node: r.betweenness for r in graph.betweenness(edges).collect()}
    assert len(scratch._WRITTEN) - before <= 2
    assert {r.node: r.betweenness for r in graph.betweenness(edges, block_rows=40).collect()} == whole
    want = _brandes([(r.source, r.target) for r in edges.collect()])
    assert whole == pytest.approx(want, abs=1e-8)


def _brandes(pairs):
    nodes = {x for p in pairs for x in p}
    onward = {v: [t for s, t in pairs if s == v] for v in nodes}
    total = dict.fromkeys(nodes, 0.0)
    for root in nodes:
        far, paths, order = {root: 0}, {root: 1}, [root]
        for v in order:
            for t in onward[v]:
                if t not in far:
                    far[t], paths[t] = far[v] + 1, 0
                    order.append(t)
                if far[t] == far[v] + 1:
                    paths[t] += paths[v]
        owed = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            owed[v] = sum(paths[v] / paths[t] * (1 + owed[t]) for t in onward[v] if far[t] == far[v] + 1)
            if v != root:
                total[v] += owed[v]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}


def test_html(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><script>'</p>'</script><h1>Head</h1><p>One<br>two <b>three</b><p><b>Bold &amp; all</b></p><ul><li>x <a href='#n1'>1</a></li></ul></body>"
    rows = blocks.html_blocks(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")).orderBy("block_idx").collect()
    assert [(r.tag, r.text) for r in rows] == [("h1", "Head"), ("p", "One two three"), ("p", "Bold & all"), ("li", "x 1")]
    assert rows[0].heading_level == 1 and rows[2].bold and not rows[1].bold and rows[3].footnotes == ["n1"]
    text = blocks.html_to_text(spark.createDataFrame([(1, page)], "page_id long, html string")).first().text
    assert all(text[r.char_start : r.char_end] == r.text for r in rows)


JUDGMENT = "INTRO\nPROCEDURE\n1. The case began.\nTHE FACTS\n2. It rained.\nmore of it\n2. Again.\nTHE LAW\n3. It is so, see no. 12/99, § 4.\nFOR THESE REASONS, THE COURT\n1. Holds, by six votes to one, so;\nand thus\n2. Dismisses unanimously the rest.\nDone in English.\nDISSENTING OPINION OF JUDGE ALPHA, JOINED BY JUDGE BETA\nI dissent."


def test_text_structure(spark):
    docs = spark.createDataFrame([(7, JUDGMENT)], "doc_id long, text string")
    rows = blocks.sections(blocks.text_blocks(docs))
    got = rows.orderBy("block_idx").collect()
    assert all(JUDGMENT[r.char_start : r.char_end] == r.text for r in got)
    assert [r.section for r in got][:9] == ["front", "procedure", "procedure", "facts", "facts", "facts", "facts", "law", "law"] and got[-1].section == "separate_opinion"
    assert [r.para_id for r in got if r.type == "numbered"][:4] == ["1", "2", "2-2", "3"]
    rulings = blocks.dispositive(rows).orderBy("ruling").collect()
    assert [(r.votes_for, r.votes_against, r.unanimous) for r in rulings] == [("six", "one", False), (None, None, True)] and "and thus" in rulings[0].text
    opinion = blocks.opinions(rows).collect()
    assert len(opinion) == 1 and opinion[0].opinion_type == "dissenting" and opinion[0].text == "I dissent." and opinion[0].authors == ["ALPHA"] and opinion[0].joined_by == ["BETA"]
    found = citations.occurrences(rows).collect()
    assert [(r.raw_text, r.target_paragraphs) for r in found] == [("12/99", ["4"])]
    assert JUDGMENT[found[0].document_start :].startswith("12/99")
    units = {r.unit_id for r in studies.unitize(rows, "section").collect()}
    assert "section:7:law" in units


def test_citations(spark):
    cases = spark.createDataFrame(
        [
            ("1", "X:1", ["1/01"], "Case of Source v. Norland", "ENG", None, None, "Alpha v. Norland, no. 12/99, 3 May 2001; Beta v. Norland, no. 5/05; ECLI:CE:ECHR:2001:9; nobody"),
            ("2", "X:2", ["12/99"], "Case of Alpha v. Norland", "ENG", dt.date(2001, 5, 3), False, None),
            ("2f", "X:2", ["12/99"], "Affaire Alpha c. Norland", "FRE", dt.date(2001, 5, 3), False, None),
            ("3", "X:3", ["5/05"], "Beta v. Norland", "ENG", None, False, None),
            ("4", "X:4", ["5/05"], "Beta v. Norland (no. 2)", "ENG", None, False, None),
            ("5", "ECLI:CE:ECHR:2001:9", [], "Gamma v. Norland", "ENG", None, False, None),
        ],
        "itemid string, ecli string, appno array<string>, docname string, language string, kp_date date, is_placeholder boolean, scl string",
    )
    m = citations.mentions(cases)
    meta = citations.display_rows(cases).select("node", "kp_date")
    got = {r.ordinal: (r.status, r.target_node, r.matched_by) for r in citations.resolve(m, citations.catalog(cases), meta).collect()}
    assert got == {0: ("resolved", "ecli:X:2", "appno"), 1: ("ambiguous", None, None), 2: ("resolved", "ecli:ECLI:CE:ECHR:2001:9", "identifier"), 3: ("unresolved", None, None)}
    simple = {r.ordinal: (r.resolved, r.target_itemid) for r in citations.resolve_simple(m, cases).collect()}
    assert simple[0] == (True, "2") and simple[1] == (False, None)
    report = citations.resolution_report(citations.resolve(m, citations.catalog(cases), meta)).first()
    assert (report.mentions, report.resolved, report.completeness) == (4, 2, 0.5)
    target = spark.createDataFrame([(2, 4, "4", "numbered", "law"), (2, 5, "5", "numbered", "law"), (2, 5, "5-2", "numbered", "law"), (2, 6, "6", "numbered", "separate_opinion")], "doc_id long, para_num long, para_id string, type string, section string")
    found = spark.createDataFrame([("l", 2, ["4-6"])], "locus_id string, target_doc long, target_paragraphs array<string>")
    assert sorted((r.number, r.status) for r in citations.pinpoint_edges(found, target).collect()) == [(4, "exact"), (5, "ambiguous"), (6, "missing")]


def test_quality(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")], "g string, p string")
    assert quality.kappa(pairs, "g", "p").first().kappa == pytest.approx((0.6 - 0.4) / 0.6, abs=1e-6)
    assert quality.macro_f1(pairs, "g", "p").first().macro_f1 == pytest.approx((0.5 + 0.8 + 0) / 3, abs=1e-6)
    assert quality.kappa(pairs.limit(2), "g", "p").collect() == []
    quotes = spark.createDataFrame([(1, "bc", 1), (1, "bc", 9), (1, "a", 5), (1, "zz", 0)], "doc_id int, quote string, start int")
    got = [(r.status, r.found_at) for r in quality.quote_evidence(quotes, spark.createDataFrame([(1, "abca")], "doc_id int, text string")).collect()]
    assert sorted(got, key=str) == sorted([("exact", 1), ("relocated", 1), ("ambiguous", None), ("missing", None)], key=str)


def test_studies(spark):
    studies.register_extractor("upper", lambda: lambda it: (pdf.assign(text=pdf.text.str.upper()) for pdf in it))
    assert studies.extract(spark.createDataFrame([("a",)], "text string"), "upper", "text string").first().text == "A"
    with pytest.raises(KeyError):
        studies.get_extractor("none")
    df = spark.createDataFrame([(1_000_000, 500_000)], "i long, o long")
    assert df.select(studies.cost(F.col("i"), F.col("o"), (2.0, 4.0), batch=True)).first()[0] == 2.0
    bad = studies.validated(spark.createDataFrame([("x", None)], "a string, b string"), ["a", "b"]).first()
    assert (bad.status, bad.missing) == ("error", ["b"])


def test_local(spark):
    df = spark.createDataFrame([("1", dt.date(2001, 1, 1), "NOR"), ("2", None, "SWE")], "itemid string, kp_date date, respondent string")
    assert [r.itemid for r in local.filter_rows(df, "kp_date", date_to="2002-01-01").collect()] == ["1"]
    assert [r.itemid for r in local.filter_rows(df, "kp_date", respondent="^sw").collect()] == ["2"]


def test_tables(spark, tmp_path):
    (tmp_path / "texts.jsonl").write_text('{"itemid": "1", "text": "a"}\n\nbroken\n{"itemid": "2"}\n')
    schema = "itemid string, text string"
    assert sorted(r.itemid for r in tables.read_jsonl(spark, f"{tmp_path}/texts.jsonl", schema).where("itemid is not null").collect()) == ["1", "2"]
    assert tables.read_jsonl(spark, f"{tmp_path}/none.jsonl", schema).count() == 0
    (tmp_path / "pick.txt").write_text("001-1\necli:x:1\n\n001-1\n")
    assert sorted(map(str, ((r.itemid, r.ecli) for r in tables.read_selection(spark, f"{tmp_path}/pick.txt").collect()))) == ["('001-1', None)", "(None, 'ECLI:X:1')"]
    assert tables.register_tables(spark, str(tmp_path)) == ["texts"]
    df = spark.createDataFrame([("1",), ("2",), ("3",)], "itemid string")
    assert [r.itemid for r in tables.fetch_by_ids(df, ["3", "1", "3", "9"]).collect()] == ["3", "1"]
    nodes = spark.createDataFrame([("a", "A & co"), ("b", "B")], "id string, label string")
    links = spark.createDataFrame([("a", "b", 2.0)], "source string, target string, weight double")
    for fmt in ("json", "graphml", "csv"):
        tables.write_graph(nodes, links, f"{tmp_path}/g.{fmt}", fmt)
    n, e = tables.read_graph(spark, f"{tmp_path}/g.json")
    assert n.count() == 2 and e.first().weight == 2.0
    tables.write_table(spark.createDataFrame([(1, ["x", "y"])], "a int, b array<string>"), f"{tmp_path}/out", "csv")
    assert tables.read_table(spark, f"{tmp_path}/out", "csv").first().b == '["x","y"]'
    files = tables.inventory(spark, f"{tmp_path}/out")
    assert tables.check_inventory(files, files).count() == 0 and tables.check_inventory(files, files.limit(0)).count() == files.count()


def test_streams(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    schema = "itemid string, at timestamp, cost_usd double"
    (folder / "1.json").write_text('{"itemid": "a", "at": "2024-01-01T00:00:00", "cost_usd": 1}\n{"itemid": "a", "at": "2024-01-01T00:01:00", "cost_usd": 2}\n')
    run = lambda: logs.append(logs.first_records(logs.read_log(spark, str(folder), schema), ["itemid"], "at"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    run()
    (folder / "2.json").write_text('{"itemid": "a", "at": "2024-01-01T00:02:00", "cost_usd": 3}\n{"itemid": "b", "at": "2024-01-01T00:03:00", "cost_usd": 4}\n')
    run()
    assert sorted(r.itemid for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]
