"""Queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions import scalars as S
from docketlake.operators import blocks as B
from docketlake.operators import graph as G
from docketlake.operators import local as L
from docketlake.operators import predicates as P
from docketlake.operators import quality as QM
from docketlake.operators import records as R
from docketlake.operators import reconcile as RC
from docketlake.operators import retrieval as RT
from docketlake.operators import reference_data as RD
from docketlake.operators import spans as SP
from docketlake.operators import studies as ST
from docketlake.sources.graph_files import gexf_lines
from docketlake.streaming import logs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of the session and a reader of tables under its name."""

    def add(function):
        name = function.__name__
        QUERIES[name] = lambda spark, sf_dir: function(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLES[name] = sql
        return function

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hybrid_retrieval"](spark, sf_dir)


WORDS = r"list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query("""
SELECT doc_id, CASE WHEN p > 0 THEN (CASE WHEN greatest(p - 100, 1) > 1 THEN '…' ELSE '' END) || trim(substr(text, greatest(p - 100, 1), least(p + 9 + 100, length(text) + 1) - greatest(p - 100, 1))) || (CASE WHEN least(p + 109, length(text) + 1) <= length(text) THEN '…' ELSE '' END) END AS snippet
FROM (SELECT doc_id, text, instr(lower(text), 'worthless') AS p FROM documents) WHERE p > 0
""")
def text_search_snippet(t):
    return L.text_search(t("documents"), "Worthless", "doc_id").select("doc_id", "snippet")


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE regexp_matches(c_name, '0{3}1[0-4]\\d$') OR regexp_matches(n_name, '(?i)land$|^fr')")
def party_search_regex(t):
    named = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    wide = L.party_search(named, r"land$|^fr", ["n_name"]).union(L.party_search(named, r"0{3}1[0-4]\d$", ["c_name"])).distinct()
    return wide.select("c_custkey", "c_name", "n_name")


@query("SELECT source AS value, count(*) AS n FROM documents GROUP BY source")
def list_categories(t):
    return L.categories(t("documents"), "source")


@query("SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate <= DATE '1995-06-30' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT o_orderstatus = 'F'")
def boolean_predicates(t):
    orders = t("orders").withColumn("kp_date", F.col("o_orderdate"))
    q = P.Q.date_range("1995-01-01", "1995-06-30") & P.one_of("o_orderpriority", ["1-URGENT", "2-HIGH"], True) & ~P.Q.field("o_orderstatus", "F", True)
    return P.search(orders, q).select("o_orderkey", "o_orderdate", "o_orderpriority")


@query(f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM w)
SELECT doc_id FROM w WHERE (list_contains(w, 'worthless') AND list_contains(w, 'the')) OR contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')
  OR doc_id IN (SELECT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.t = 'idiot' AND b.t = 'the' AND a.i <> b.i AND abs(a.i - b.i) <= 5)
""")
def full_text_predicates(t):
    q = P.Q.text("worthless the") | P.Q.phrase("of the") | P.Q.near("idiot the", 5)
    return P.search(t("documents"), q).select("doc_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def sorted_search(t):
    return P.search(t("orders"), None, "o_totalprice Descending", 50, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT l.doc_id, quality, toxic, lang, source FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id")
def enrich_left_join(t):
    return L.enrich(t("labels"), t("documents"), "doc_id", ["lang", "source"])


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS minimum, max({c})::DOUBLE AS maximum, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")) + ")")
def column_stats(t):
    return L.column_stats(t("lineitem"))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS type, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}::VARCHAR) AS \"values\", count(DISTINCT {c}::VARCHAR) <= 100 AS listed FROM customer" for c, k in (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"))) + ")")
def column_profile(t):
    return L.column_profile(t("customer"))


@query("SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_values(t):
    return L.top_values(t("orders"), "o_orderpriority")


@query("SELECT 'documents' AS \"table\", count(*) AS n, 5 AS columns FROM documents UNION ALL SELECT 'events', count(*), 6 FROM events UNION ALL SELECT 'pages', count(*), 3 FROM pages")
def table_counts(t):
    return L.table_counts({name: t(name) for name in ("documents", "events", "pages")})


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def dedup_first(t):
    return R.first_per_key(t("events"), "user_id", "event_id").select("event_id", "user_id", "event_type", "value")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_by_key(t):
    return R.latest_per_key(t("events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""
WITH log AS (SELECT user_id, event_id AS seq, value FROM events WHERE event_id % 3 <> 0), ch AS (SELECT user_id, event_id AS seq, value FROM events WHERE event_id % 3 = 0),
new AS (SELECT user_id, arg_max(value, seq) AS value, min(seq) AS first_seq FROM ch GROUP BY user_id), last AS (SELECT user_id, max(seq) AS seq FROM log GROUP BY user_id)
SELECT log.user_id, log.seq, CASE WHEN last.seq IS NOT NULL AND new.user_id IS NOT NULL THEN new.value ELSE log.value END AS value FROM log LEFT JOIN last ON last.user_id = log.user_id AND last.seq = log.seq LEFT JOIN new ON new.user_id = log.user_id
UNION ALL SELECT user_id, first_seq + (SELECT max(seq) FROM log), value FROM new WHERE user_id NOT IN (SELECT user_id FROM log)
""")
def upsert_log(t):
    events = t("events").select("user_id", F.col("event_id").alias("seq"), "value")
    return R.upsert(events.where("seq % 3 <> 0"), events.where("seq % 3 = 0"), "user_id")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_anti_join(t):
    return R.unprocessed(t("documents"), t("labels"), "doc_id", F.col("quality") == 1).select("doc_id", "lang", "source")


@query("""
WITH q AS (SELECT lang, greatest(1, floor(200 * count(*) / (SELECT count(*) FROM documents)))::BIGINT AS quota FROM documents GROUP BY lang),
r AS (SELECT doc_id, d.lang, quota, md5('42|' || doc_id) AS turn, row_number() OVER (PARTITION BY d.lang ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents d JOIN q USING (lang)),
s AS (SELECT *, r <= quota AS chosen FROM r), rest AS (SELECT doc_id, lang FROM s WHERE NOT chosen ORDER BY turn, doc_id LIMIT (SELECT greatest(0, 200 - count(*)) FROM s WHERE chosen))
SELECT doc_id, lang FROM s WHERE chosen UNION ALL SELECT doc_id, lang FROM rest
""")
def stratified_sample(t):
    return R.stratified_sample(t("documents").select("doc_id", "lang"), "lang", "doc_id", 200)


@query("SELECT event_id, user_id, round(sum(value) OVER w, 4) AS running, sum(value) OVER w <= 500 AS within FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def budget_running_total(t):
    return R.running_budget(t("events"), ["user_id"], ["ts", "event_id"], "value", 500).select("event_id", "user_id", F.round("running", 4).alias("running"), "within")


CASES = """cases AS (SELECT doc_id::VARCHAR AS itemid, source || '-' || (doc_id % 7) AS ecli, CASE lang WHEN 'en' THEN 'ENG' WHEN 'fr' THEN 'FRE' ELSE upper(lang) END AS language, CASE WHEN n_chars % 2 = 0 THEN 'counsel ' || doc_id END AS represented_by, doc_id AS seq FROM documents)"""


def _cases(t) -> DataFrame:
    lang = F.when(F.col("lang") == "en", "ENG").when(F.col("lang") == "fr", "FRE").otherwise(F.upper("lang"))
    return t("documents").select(
        F.col("doc_id").cast("string").alias("itemid"), F.concat_ws("-", "source", (F.col("doc_id") % 7).cast("string")).alias("ecli"), lang.alias("language"),
        F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("counsel "), F.col("doc_id").cast("string"))).alias("represented_by"), F.col("doc_id").alias("seq"),
    )


@query(f"""
WITH {CASES}, t AS (SELECT *, upper(ecli) AS node, row_number() OVER (PARTITION BY upper(ecli), language ORDER BY CASE WHEN language = 'FRE' AND represented_by IS NULL THEN 1 ELSE 0 END, seq) AS turn FROM cases),
l AS (SELECT *, max(CASE WHEN language = 'ENG' AND turn = 1 THEN itemid END) OVER n AS p, max(CASE WHEN language = 'FRE' AND turn = 1 THEN itemid END) OVER n AS s, max(CASE WHEN language = 'FRE' AND turn = 1 THEN represented_by END) OVER n AS rep FROM t WINDOW n AS (PARTITION BY node)),
r AS (SELECT *, CASE WHEN language NOT IN ('ENG', 'FRE') THEN 'other' WHEN language = 'ENG' THEN CASE WHEN turn = 1 THEN 'primary' ELSE 'duplicate' END WHEN turn > 1 THEN 'duplicate' WHEN p IS NULL THEN 'primary' ELSE 'sibling' END AS role FROM l)
SELECT itemid, role, CASE WHEN role = 'primary' AND language = 'ENG' THEN s END AS sibling_itemid, CASE WHEN role = 'primary' AND language = 'ENG' AND represented_by IS NULL THEN rep ELSE represented_by END AS represented_by FROM r
""")
def reconcile_primary(t):
    return RC.reconcile(_cases(t)).select("itemid", "role", "sibling_itemid", "represented_by")


@query(f"""
WITH {CASES} SELECT upper(ecli) AS node, count(*) AS n, CASE WHEN count(*) <= 1 THEN 'unique' WHEN count(DISTINCT language) <= 1 THEN 'same_language_duplicate' WHEN count(DISTINCT (seq % 7)) = 1 THEN 'matched_by_appno_docname' ELSE 'ambiguous' END AS kind FROM cases GROUP BY 1
""")
def cluster_kinds(t):
    cases = _cases(t).withColumn("appno", F.array((F.col("seq") % 7).cast("string"))).withColumn("docname", F.lit("Case of A v. B"))
    return RC.cluster_kinds(cases)


@query()
def html_to_text(t):
    return B.html_to_text(t("pages"))


@query()
def html_blocks(t):
    return B.html_blocks(t("pages"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
o AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM l),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS block_idx, trim(raw) AS text, base + length(raw) - length(ltrim(raw)) AS start FROM o WHERE trim(raw) <> '')
SELECT doc_id, block_idx, start::INT AS char_start, (start + length(text))::INT AS char_end, md5(text) AS digest, CASE WHEN length(text) <= 120 AND upper(text) = text AND lower(text) <> text THEN 'heading' ELSE 'paragraph' END AS type FROM k
""")
def spine_blocks(t):
    return B.text_blocks(t("documents")).select("doc_id", "block_idx", "char_start", "char_end", F.md5(F.col("text").cast("binary")).alias("digest"), "type")


@query()
def page_markdown(t):
    return B.html_to_markdown(t("pages"))


@query("SELECT doc_id, string_agg(x, chr(10) || chr(10) ORDER BY i) AS text FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE x <> '' GROUP BY doc_id")
def spine_texts(t):
    return B.spine_text(B.text_blocks(t("documents")))


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS asked FROM conversations")
def carry_last_established(t):
    rows = t("conversations").withColumn("own", F.when(F.col("role") == "user", F.col("turn")))
    return B.carry_forward(rows, "conv_id", "turn", "own", "asked").select("conv_id", "turn", F.coalesce("asked", F.lit(-1)).alias("asked"))


@query("SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS until FROM conversations")
def next_boundary(t):
    return B.next_boundary(t("conversations"), "conv_id", "turn", "turn", "until").select("conv_id", "turn", F.coalesce("until", F.lit(-1)).alias("until"))


PARAGRAPHS = "p AS (SELECT doc_id, x AS text, doc_id || ':' || row_number() OVER (PARTITION BY doc_id ORDER BY i) AS paragraph_id FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE x <> '')"


@query(f"""
WITH {PARAGRAPHS}, w AS (SELECT paragraph_id, {WORDS} AS w FROM p), x AS (SELECT paragraph_id, len(w) AS len, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM w)
SELECT paragraph_id, term, count(*) AS tf, max(len)::INT AS len, min(pos)::INT AS first_pos FROM x GROUP BY paragraph_id, term
""")
def postings(t):
    return RT.postings(RT.paragraphs(t("documents")), "paragraph_id").select("paragraph_id", "term", "tf", "len", F.col("positions")[0].alias("first_pos"))


TERMS = ["worthless", "the", "clown", "oneren"]
BM25 = f"""w AS (SELECT paragraph_id, {WORDS} AS w FROM p), n AS (SELECT count(*) AS n, avg(len(w)) AS average FROM w),
h AS (SELECT paragraph_id, len, term, count(*) AS tf FROM (SELECT paragraph_id, len(w) AS len, unnest(w) AS term FROM w) WHERE term IN ('worthless', 'the', 'clown', 'oneren') GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM h GROUP BY term),
b AS (SELECT paragraph_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / average))), 12) AS score FROM h JOIN d USING (term), n GROUP BY paragraph_id)"""


@query(f"WITH {PARAGRAPHS}, {BM25} SELECT paragraph_id, round(score, 6) AS score FROM b")
def bm25_scores(t):
    return RT.bm25(RT.paragraphs(t("documents")), "paragraph_id", TERMS, None)


@query(f"WITH {PARAGRAPHS} SELECT paragraph_id FROM (SELECT paragraph_id, {WORDS} AS w FROM p) WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
def phrase_search(t):
    return RT.phrase_search(RT.paragraphs(t("documents")), "paragraph_id", "of the")


@query(f"""
WITH {PARAGRAPHS}, x AS (SELECT paragraph_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT paragraph_id, {WORDS} AS w FROM p))
SELECT a.paragraph_id, min(abs(a.pos - b.pos))::INT AS gap FROM x a JOIN x b ON a.paragraph_id = b.paragraph_id AND a.term = 'with' AND b.term = 'this' GROUP BY 1 HAVING min(abs(a.pos - b.pos)) <= 5
""")
def near_search(t):
    return RT.near_search(RT.paragraphs(t("documents")), "paragraph_id", "with", "this")


DENSE = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, u.vec_id, u.label, q.label AS q_label, round(list_dot_product(u.v, q.v), 12) AS score FROM u, u q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


def _dense(t):
    vectors = t("embeddings")
    return RT.dense_top_k(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "vec_id", 25)  # the query set asked for: ids divisible by 50, against all rows


@query(f"WITH {DENSE} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 25")
def dense_topk(t):
    return _dense(t)


@query(f"""
WITH {DENSE}, k AS (SELECT * FROM r WHERE rank <= 25), n AS (SELECT q.vec_id AS query_id, count(*) AS n FROM u JOIN u q ON u.label = q.label AND q.vec_id % 50 = 0 GROUP BY 1),
g AS (SELECT query_id, count(*) FILTER (WHERE label = q_label) AS found, min(rank) FILTER (WHERE label = q_label) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE label = q_label), 0) AS dcg FROM k GROUP BY 1),
i AS (SELECT i.query_id, sum(1 / log2(x + 1)) AS ideal FROM (SELECT query_id, unnest(range(1, least(n, 25) + 1)) AS x FROM n) i GROUP BY 1)
SELECT count(*) AS queries, round(avg(coalesce(found, 0) / n), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg FROM n JOIN i USING (query_id) LEFT JOIN g USING (query_id)
""")
def retrieval_eval(t):
    vectors = t("embeddings").select("vec_id", "label")
    mine = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return RT.evaluate_labels(_dense(t).withColumnRenamed("vec_id", "item"), mine, vectors.withColumnRenamed("vec_id", "item"), 25)


@query(f"""
WITH {PARAGRAPHS}, {BM25}, {DENSE}, lex AS (SELECT split_part(paragraph_id, ':', 1)::BIGINT AS vec_id, max(score) AS score FROM b GROUP BY 1),
a AS (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id::VARCHAR) AS r FROM (SELECT * FROM lex ORDER BY score DESC, vec_id LIMIT 100)),
c AS (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id::VARCHAR) AS r FROM (SELECT vec_id, score FROM r WHERE query_id = 0 AND rank <= 100))
SELECT vec_id, round(coalesce(1 / (60 + a.r), 0) + coalesce(1 / (60 + c.r), 0), 9) AS rrf_score, round(a.score, 6) AS lexical_score, round(c.score, 6) AS dense_score FROM a FULL JOIN c USING (vec_id) ORDER BY rrf_score DESC, vec_id::VARCHAR LIMIT 25
""")
def hybrid_retrieval(t):
    scored = RT.bm25(RT.paragraphs(t("documents")), "paragraph_id", TERMS, None, digits=12)
    lexical = scored.groupBy(F.split("paragraph_id", ":")[0].cast("long").alias("vec_id")).agg(F.max("score").alias("score")).orderBy(F.desc("score"), "vec_id").limit(100)
    vectors = t("embeddings")
    dense = RT.dense_top_k(vectors, vectors.where("vec_id = 0"), "vec_id", "vec_id", 100).select("vec_id", "score")
    fused = RT.reciprocal_rank_fusion([lexical, dense], "vec_id", 25)
    return fused.withColumn("lexical_score", F.round("lexical_score", 6))


def _edges(t) -> DataFrame:
    named = t("lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    return G.edges_from(named, "src", "dst")


def _layers(t) -> DataFrame:
    """Parts cite suppliers, suppliers their nation, nations their region."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    up = t("supplier").select(name("s", "s_suppkey").alias("source"), name("n", "s_nationkey").alias("target"))
    top = t("nation").select(name("n", "n_nationkey").alias("source"), name("r", "n_regionkey").alias("target"))
    return _edges(t).union(up.union(top).withColumn("citation_count", F.lit(1).cast("long")))


EDGES = "e AS (SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target, count(*) AS citation_count FROM lineitem GROUP BY ALL)"
LAYERS = "e AS (SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target, count(*) AS citation_count FROM lineitem GROUP BY ALL UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 1 FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation)"


@query(f"WITH {EDGES} SELECT * FROM e")
def edges_aggregated(t):
    return _edges(t)


@query(f"""WITH {EDGES} SELECT section::INT AS section, place, line FROM (
SELECT 1 AS section, node AS place, '<node id="' || node || '" label="' || node || '"></node>' AS line FROM (SELECT source AS node FROM e UNION SELECT target FROM e)
UNION ALL SELECT 3, source || chr(9) || target, '<edge source="' || source || '" target="' || target || '"><attvalues><attvalue for="0" value="' || citation_count || '"/></attvalues></edge>' FROM e)""")
def graph_gexf(t):
    """The lines of nodes and edges, without the frame of the file."""
    edges = _edges(t)
    return gexf_lines(G.nodes_from(edges).withColumnRenamed("node", "id"), edges).where("section in (1, 3)")


@query(f"WITH {EDGES} SELECT source AS node FROM e UNION SELECT target FROM e")
def nodes_from_edges(t):
    return G.nodes_from(_edges(t))


@query(f"""WITH {EDGES}, x AS (SELECT source AS node, 0 AS i, 1 AS o, citation_count AS c FROM e UNION ALL SELECT target, 1, 0, citation_count FROM e)
SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, sum(i * c)::BIGINT AS cited, sum(o * c)::BIGINT AS citing FROM x GROUP BY node""")
def degree_metrics(t):
    return G.degrees(_edges(t))


def _rank_sql(last: str, weighted: bool = False, rounds: int = 5) -> str:
    """More rounds than the graph has layers; ``last`` selects from ``ranks``."""
    w = "citation_count" if weighted else "1"
    steps = ["x0 AS (SELECT node, 1.0::DOUBLE AS x FROM n)"]
    steps += [f"x{i + 1} AS MATERIALIZED (SELECT n.node, 1 + 0.85 * coalesce(sent, 0) AS x FROM n LEFT JOIN (SELECT target, sum(x * p) AS sent FROM l JOIN x{i} ON l.source = x{i}.node GROUP BY target) s ON s.target = n.node)" for i in range(rounds)]
    head = f"WITH {LAYERS}, n AS (SELECT source AS node FROM e UNION SELECT target FROM e), l AS (SELECT source, target, {w} / sum({w}) OVER (PARTITION BY source) AS p FROM e)"
    return f"{head}, {', '.join(steps)}, ranks AS (SELECT node, x / sum(x) OVER () AS rank FROM x{rounds}) {last}"


@query(_rank_sql("SELECT node, round(rank, 9) AS rank FROM ranks"))
def pagerank(t):
    return G.pagerank(_layers(t)).select("node", F.round("rank", 9).alias("rank"))


@query(_rank_sql(", k AS (SELECT node FROM ranks ORDER BY round(rank, 10) DESC, node LIMIT 300) SELECT * FROM e WHERE source IN (SELECT node FROM k) AND target IN (SELECT node FROM k)", True))
def prune_top_nodes(t):
    edges = _layers(t)
    return G.top_nodes(edges, G.pagerank(edges, weighted=True).select("node", F.round("rank", 10).alias("score")), 300)


@query(f"WITH {EDGES}, a AS (SELECT source, target FROM e WHERE citation_count % 2 = 0 OR target < 's5'), b AS (SELECT source, target FROM e WHERE citation_count % 2 = 1 OR target < 's5') SELECT (SELECT count(*) FROM a JOIN b USING (source, target)) AS shared, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_mine, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_other")
def compare_edge_sets(t):
    e = _edges(t)
    return G.compare_edges(e.where("citation_count % 2 = 0 or target < 's5'"), e.where("citation_count % 2 = 1 or target < 's5'"))


@query("""
WITH c AS (SELECT event_type, user_id, count(*) AS occurrences, count(DISTINCT props) AS pinpoints FROM events GROUP BY ALL)
SELECT event_type, user_id, occurrences, pinpoints, round(occurrences / sum(occurrences) OVER (PARTITION BY event_type), 6) AS share, row_number() OVER (PARTITION BY event_type ORDER BY occurrences DESC, user_id) AS place FROM c QUALIFY place <= 5
""")
def network_summary(t):
    return G.network_summary(t("events"), ["event_type"], "user_id", "props", 5)


@query(f"""
WITH {LAYERS}, n AS (SELECT count(*) AS n FROM (SELECT source FROM e UNION SELECT target FROM e)),
d2 AS (SELECT a.source AS s, a.target AS v, b.target AS t FROM e a JOIN e b ON a.target = b.source), c2 AS (SELECT s, t, count(*) AS paths FROM d2 GROUP BY ALL),
d3 AS (SELECT d2.s, d2.v, d2.t AS w, e.target AS t FROM d2 JOIN e ON d2.t = e.source), c3 AS (SELECT s, t, count(*) AS paths FROM d3 GROUP BY ALL),
b AS (SELECT v AS node, 1.0 / paths AS part FROM d2 JOIN c2 USING (s, t) UNION ALL SELECT v, 1.0 / paths FROM d3 JOIN c3 USING (s, t) UNION ALL SELECT w, 1.0 / paths FROM d3 JOIN c3 USING (s, t)),
x AS (SELECT node, sum(part) AS part FROM b GROUP BY node)
SELECT m.node, round(coalesce(part, 0) / ((n - 1.0) * (n - 2)), 9) AS betweenness FROM (SELECT source AS node FROM e UNION SELECT target FROM e) m LEFT JOIN x USING (node), n
""")
def betweenness_centrality(t):
    return G.betweenness(_layers(t))


@query()
def community_labels(t):
    return G.communities(_layers(t))


PAIRS = "SELECT quality::VARCHAR AS g, toxic::VARCHAR AS p FROM labels"


@query(f"WITH x AS ({PAIRS}), l AS (SELECT DISTINCT g AS label FROM x UNION SELECT p FROM x) SELECT round(avg(2.0 * (SELECT count(*) FROM x WHERE g = label AND p = label) / ((SELECT count(*) FROM x WHERE g = label) + (SELECT count(*) FROM x WHERE p = label))), 6) AS macro_f1, count(*) AS labels FROM l")
def macro_f1(t):
    return QM.macro_f1(t("labels"), "quality", "toxic")


@query(f"WITH x AS ({PAIRS}), m AS (SELECT (SELECT count(*) FROM x) AS n, (SELECT count(*) FROM x WHERE g = p) AS hit, (SELECT sum(a * b) FROM (SELECT g, count(*) AS a FROM x GROUP BY g) JOIN (SELECT p, count(*) AS b FROM x GROUP BY p) ON g = p) AS chance) SELECT n, round(100 * hit / n, 4) AS agreement_pct, round((hit / n - chance / (n::DOUBLE * n)) / (1 - chance / (n::DOUBLE * n)), 6) AS kappa FROM m")
def cohen_kappa(t):
    return QM.kappa(t("labels"), "quality", "toxic")


@query(f"WITH x AS ({PAIRS}), y AS (SELECT g AS v FROM x UNION ALL SELECT p FROM x), s AS (SELECT sum(c * c) AS q FROM (SELECT count(*)::DOUBLE AS c FROM y GROUP BY v)) SELECT (SELECT count(*) FROM x) AS n, round(1 - (1 - (SELECT count(*) FROM x WHERE g = p) / (SELECT count(*) FROM x)) / (1 - q / power((SELECT count(*) FROM y), 2)), 6) AS alpha FROM s")
def nominal_alpha(t):
    return QM.nominal_alpha(t("labels"), "quality", "toxic")


@query("""
WITH h AS (SELECT doc_id, item_id, (length(d.text) - length(replace(d.text, q.text, ''))) // length(q.text) AS times, instr(d.text, q.text) AS place FROM documents d JOIN benchmark q ON contains(d.text, q.text))
SELECT doc_id, item_id, CASE WHEN place = 1 THEN 'exact' WHEN times = 1 THEN 'relocated' ELSE 'ambiguous' END AS status, (CASE WHEN place = 1 THEN 0 WHEN times = 1 THEN place - 1 ELSE -1 END)::INT AS found_at FROM h
""")
def evidence_quote_check(t):
    quotes, docs = t("benchmark").select("item_id", F.col("text").alias("quote")), t("documents").select("doc_id", "text")
    claimed = QM.find_quotes(docs, quotes).select("doc_id", "item_id", F.lit(0).alias("start")).join(quotes, "item_id")
    return QM.quote_evidence(claimed, docs).select("doc_id", "item_id", "status", F.coalesce("found_at", F.lit(-1)).cast("int").alias("found_at"))


@query("""
WITH s AS (SELECT l_partkey AS a, l_suppkey AS b, count(*) AS score FROM lineitem GROUP BY ALL), t AS (SELECT *, max(score) OVER (PARTITION BY a) AS ma, max(score) OVER (PARTITION BY b) AS mb FROM s),
u AS (SELECT a, b, score FROM t WHERE score = ma AND score = mb) SELECT a, b, score FROM u QUALIFY count(*) OVER (PARTITION BY a) = 1 AND count(*) OVER (PARTITION BY b) = 1
""")
def one_to_one_alignment(t):
    pairs = t("lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.count("*").alias("score"))
    return QM.one_to_one(pairs, "a", "b", "score")


@query("SELECT event_id, (props ->> '$.k') AS payload, CASE WHEN (props ->> '$.k') IS NULL THEN 'no payload' END AS error FROM events")
def json_payload(t):
    return t("events").select("event_id", ST.response_payload(F.col("props"), "$.k").alias("r")).select("event_id", "r.payload", "r.error")


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS bytes FROM documents")
def manifest_hash(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT stage, count(*) AS tasks, sum(length(text) // 4)::BIGINT AS input_tokens FROM documents, (VALUES ('draft'), ('check')) s(stage) GROUP BY stage")
def study_plan(t):
    return ST.plan(t("documents").select(F.col("doc_id").cast("string").alias("unit_id"), "text"), ["draft", "check"])


@query("SELECT s_suppkey, lower(s_name) AS name, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END AS balance, upper(replace(s_name, ' ', '')) AS code FROM supplier")
def scalar_cleaning(t):
    s = t("supplier")
    packed = F.concat(F.lit(" ; "), "s_name", F.lit(";;"))
    balance = S.lenient_double(F.when(F.col("s_acctbal") < 0, "nan ").otherwise(F.col("s_acctbal").cast("string")))
    return s.select("s_suppkey", F.lower(S.split_list(packed)[0]).alias("name"), F.when(~F.isnan(balance), balance).alias("balance"), S.normalise_ecli(F.col("s_name")).alias("code"))


SPANS = "SELECT l_suppkey AS doc_id, l_orderkey AS a, l_orderkey + l_quantity::INT AS b, l_orderkey * 7 + l_linenumber AS id FROM lineitem"


@query(f"WITH s AS ({SPANS}) SELECT x.doc_id, x.id, y.id AS other FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.a < y.b AND y.a < x.b")
def interval_overlap_join(t):
    start = F.col("l_orderkey")
    spans = t("lineitem").select(F.col("l_suppkey").alias("doc_id"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"), (start * 7 + F.col("l_linenumber")).alias("id"))
    return SP.overlapping(spans, spans.withColumnRenamed("id", "other"), "doc_id").select("doc_id", "id", "other")


@query("""
WITH s AS (SELECT 'a' || l_partkey AS annotation_id, 'c' || l_suppkey AS candidate_id, sum(l_quantity)::INT AS score FROM lineitem GROUP BY ALL),
b AS (SELECT *, max(score) OVER (PARTITION BY annotation_id) AS m FROM s), p AS (SELECT annotation_id, candidate_id, score FROM b WHERE score = m QUALIFY count(*) OVER (PARTITION BY annotation_id) = 1),
l AS (SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY candidate_id, score) = 1)
SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC) = 1
""")
def greedy_alignment(t):
    pairs = t("lineitem").groupBy(F.concat(F.lit("a"), F.col("l_partkey").cast("string")).alias("annotation_id"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("candidate_id"))
    return SP.align(pairs.agg(F.sum("l_quantity").cast("int").alias("score")))


@query("WITH RECURSIVE k AS (SELECT p_partkey AS id, p_partkey // 3 AS parent FROM part WHERE p_partkey // 3 > 0), r AS (SELECT id, parent AS ancestor, 1 AS distance FROM k UNION ALL SELECT r.id, k.parent, distance + 1 FROM r JOIN k ON r.ancestor = k.id) SELECT id::VARCHAR AS id, ancestor::VARCHAR AS ancestor, distance FROM r")
def keypoint_ancestors(t):
    up = F.floor(F.col("p_partkey") / 3)
    return RD.ancestors(t("part").select(F.col("p_partkey").cast("string").alias("id"), "p_name", F.when(up > 0, up.cast("string")).alias("parent")))


@query("""
WITH c AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'ENG' WHEN 'fr' THEN 'FRE' ELSE upper(lang) END AS l, CASE doc_id % 4 WHEN 0 THEN 'HEJUD' WHEN 1 THEN 'HEDEC' WHEN 2 THEN 'CLIN' ELSE 'X' END AS k FROM documents)
SELECT doc_id, CASE k WHEN 'CLIN' THEN 'legal_summary' WHEN 'HEJUD' THEN 'judgment' WHEN 'HEDEC' THEN 'decision' ELSE 'other' END AS document_kind,
  CASE WHEN k = 'CLIN' AND l NOT IN ('ENG', 'FRE') THEN 'translated_summary' WHEN k = 'CLIN' THEN 'official_summary' WHEN l NOT IN ('ENG', 'FRE') THEN 'translation' ELSE 'official_text' END AS rendition_kind FROM c
""")
def version_kinds(t):
    kind = F.get(F.array(*(F.lit(x) for x in ("HEJUD", "HEDEC", "CLIN", "X"))), (F.col("doc_id") % 4).cast("int"))
    lang = F.when(F.col("lang") == "en", "ENG").when(F.col("lang") == "fr", "FRE").otherwise(F.upper("lang"))
    return RD.versions(t("documents").select("doc_id", lang.alias("language"), kind.alias("doctype"), F.lit("A v. B").alias("docname"))).select("doc_id", "document_kind", "rendition_kind")


@query("SELECT date_trunc('day', ts) AS \"start\", date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS records, round(sum(value), 6) AS cost_usd FROM events GROUP BY ALL")
def windowed_log_totals(t):
    rows = t("events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("cost_usd"))
    return logs.windowed_totals(rows, "ts", "1 day", ["event_type"])


@query("SELECT count(*) FILTER (WHERE event_type = 'click') AS ok, count(*) FILTER (WHERE event_type = 'view') AS error, 0::BIGINT AS skipped, sum(user_id)::BIGINT AS input_tokens, sum(event_id)::BIGINT AS output_tokens, round(sum(value), 2) AS cost_usd FROM events")
def pipeline_run_totals(t):
    status = F.when(F.col("event_type") == "click", "ok").when(F.col("event_type") == "view", "error").otherwise("other")
    log = t("events").select(status.alias("status"), F.col("user_id").alias("input_tokens"), F.col("event_id").alias("output_tokens"), F.col("value").alias("cost_usd"))
    return R.run_totals(log).withColumn("cost_usd", F.round("cost_usd", 2))


@query("SELECT d.doc_id::VARCHAR AS itemid, coalesce(own.text, other.text) IS NOT NULL AS has_text, CASE WHEN own.doc_id IS NOT NULL THEN d.doc_id::VARCHAR WHEN other.doc_id IS NOT NULL THEN (d.doc_id // 2)::VARCHAR END AS source_itemid FROM documents d LEFT JOIN documents own ON own.doc_id = d.doc_id AND own.doc_id % 2 = 0 LEFT JOIN documents other ON other.doc_id = d.doc_id // 2 AND other.doc_id % 2 = 0")
def hydrate_texts(t):
    docs = t("documents")
    cases = docs.select(F.col("doc_id").cast("string").alias("itemid"), F.floor(F.col("doc_id") / 2).cast("string").alias("french_itemid"))
    texts = docs.where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("itemid"), "text", F.col("lang").alias("language"))
    return RC.hydrate(cases, texts).select("itemid", F.col("text").isNotNull().alias("has_text"), "source_itemid")


@query("WITH p AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS x FROM documents) SELECT 'paragraph:' || doc_id AS unit_id, count(*) AS paragraphs, sum(length(x))::BIGINT AS chars FROM p WHERE x <> '' GROUP BY doc_id")
def paragraph_units(t):
    rows = RT.paragraphs(t("documents")).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"))
    return rows.select(F.concat_ws(":", F.lit("paragraph"), F.col("doc_id").cast("string")).alias("unit_id"), "paragraphs", "chars")


@query("""
WITH RECURSIVE s AS (SELECT l_suppkey AS doc_id, l_orderkey AS "start", l_orderkey + 20 AS "end", l_linenumber AS strength, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber DESC) AS i FROM lineitem),
r AS (SELECT doc_id, min(i) AS i FROM s GROUP BY doc_id UNION ALL SELECT * FROM (SELECT r.doc_id, min(y.i) AS i FROM r JOIN s x ON x.doc_id = r.doc_id AND x.i = r.i JOIN s y ON y.doc_id = r.doc_id AND y."start" >= x."end" GROUP BY r.doc_id))
SELECT doc_id, "start", "end", strength FROM s JOIN r USING (doc_id, i)
""")
def exclusive_spans(t):
    spans = t("lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + 20).alias("end"), F.col("l_linenumber").alias("strength"))
    return SP.select_spans(spans, ["doc_id"])


@query()
def section_blocks(t):
    return B.sections(B.text_blocks(t("documents"))).groupBy("doc_id", "section").agg(F.count("*").alias("blocks"))



from docketlake.plans import case_queries  # noqa: E402, F401  registers its queries
