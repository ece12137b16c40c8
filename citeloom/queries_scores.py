"""The score, branch, leaf, fruit, novelty and community queries, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import clean, community, graph, roles, scores as S, search, similarity, text, topics
from .queries import _whole, ARTICLES, ORACLES, CLEAN, COMBINED, PAPERS, SAP, TEXTS, _leaf_numbers, _leaves, _topic_communities, combined, mm, query, scores, vectors_sql
from .sources.driver_tables import articles, clean_degrees, clean_edges, clean_numbers, kept, name_of, named, number, number_of, part_papers, stored_edges, table
from .storage import stored

NOW = 2001  # the newest year of the driver's orders; always passed, never today


def sql_color(score: str, scale: tuple[str, str]) -> str:
    parts = []
    for i in (1, 3, 5):
        low, high = int(scale[0][i : i + 2], 16), int(scale[1][i : i + 2], 16)
        parts.append(f"printf('%02X', round_even({low}.0::DOUBLE + {high - low}.0::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, {score})), 0)::INTEGER)")
    return "'#' || " + " || ".join(parts)


@query(f"SELECT p_partkey AS partkey, round({mm('p_retailprice')}, 9) AS scaled FROM part")
def minmax_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.scaled(table(spark, sf_dir, "part"), scaled=F.col("p_retailprice"))
    return out.select(F.col("p_partkey").alias("partkey"), F.round("scaled", 9).alias("scaled"))


@query(f"SELECT p_partkey AS partkey, p_brand AS brand, round({mm('p_retailprice', 'PARTITION BY p_brand')}, 9) AS scaled FROM part")
def minmax_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_brand").alias("brand"), F.round(C.minmax(F.col("p_retailprice"), W.partitionBy("p_brand")), 9).alias("scaled"))


def _cited_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a paper: doc, citations_received (distinct orders), year (a function of its size), brand."""
    cited = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").distinct().groupBy("l_partkey").agg(F.count(F.lit(1)).alias("citations_received"))
    parts = table(spark, sf_dir, "part").join(cited, F.col("p_partkey") == F.col("l_partkey"), "left")
    return parts.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("doc"), F.coalesce("citations_received", F.lit(0)).cast("double").alias("citations_received"), (F.lit(1951) + F.col("p_size")).alias("year"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))


CITED = """WITH RECURSIVE c AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1),
cp AS MATERIALIZED (SELECT 'P' || p_partkey AS doc, coalesce(n, 0)::DOUBLE AS cites, 1951 + p_size AS year, p_brand AS brand, p_retailprice AS price FROM part LEFT JOIN c ON p_partkey = l_partkey)"""


@query(CITED + f""", v AS (SELECT doc, cites / greatest({NOW} - year + 1, 1) AS velocity FROM cp), s AS (SELECT doc, velocity, {mm('ln(1 + velocity)')} AS score FROM v)
SELECT doc, round(velocity, 9) AS citation_velocity, round(score, 9) AS citation_velocity_score, {sql_color('score', C.BROWNS)} AS color FROM s""")
def citation_velocity_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.velocity_color(_cited_parts(spark, sf_dir), NOW)
    return out.select("doc", F.round("citation_velocity", 9).alias("citation_velocity"), F.round("citation_velocity_score", 9).alias("citation_velocity_score"), "color")


@query(CITED + f""", l AS (SELECT *, ln(1 + cites) AS lc FROM cp), f AS (SELECT doc, 0.7::DOUBLE * {mm('lc', 'PARTITION BY brand')} + 0.3::DOUBLE * {mm('lc')} AS f FROM l),
k AS (SELECT doc, f, 0.5::DOUBLE * f + 0.5::DOUBLE * sqrt(f) AS c FROM f), r AS (SELECT doc, f, {mm('c')} AS r FROM k), z AS (SELECT doc, f, 1 + (r > 0.2)::INT + (r > 0.4)::INT + (r > 0.6)::INT + (r > 0.8)::INT AS lv FROM r)
SELECT doc, round(f, 9) AS final_root_size_score, lv AS visual_size_level, [14.0::DOUBLE, 18, 22, 26, 30][lv] AS size FROM z""")
def root_size_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.root_sizes(_cited_parts(spark, sf_dir), "brand")
    return out.select("doc", F.round("final_root_size_score", 9).alias("final_root_size_score"), "visual_size_level", "size")


@query(CITED + f", s AS (SELECT doc, {mm('ln(1 + cites)')} AS s FROM cp) SELECT doc, round(6.0::DOUBLE + sqrt(s) * 19.0::DOUBLE, 9) AS size FROM s")
def trunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.continuous_sizes(_cited_parts(spark, sf_dir)).select("doc", F.round("size", 9).alias("size"))


# --- root clusters: papers grouped by brand ------------------------------------------------------


def _clusters(spark: SparkSession, sf_dir: str, papers: DataFrame) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("doc"), F.col("p_type").alias("cluster"))
    return stored(papers.select("doc").join(brands, "doc"), "clusters")


CLUSTERS = COMBINED + """, cl AS MATERIALIZED (SELECT doc, p_type AS cluster FROM papers JOIN part ON doc = 'P' || p_partkey),
tied AS (SELECT co.a, co.b, combined, x.cluster AS ca, y.cluster AS cb FROM co JOIN cl x ON x.doc = a JOIN cl y ON y.doc = b)"""


@query(CLUSTERS + """, inn AS (SELECT ca AS cluster, avg(combined) AS cohesion FROM tied WHERE ca = cb GROUP BY 1),
ext AS (SELECT cluster, avg(combined) AS e FROM (SELECT ca AS cluster, combined FROM tied WHERE ca <> cb UNION ALL SELECT cb, combined FROM tied WHERE ca <> cb) GROUP BY 1),
so AS MATERIALIZED (SELECT DISTINCT 'O' || l_orderkey AS id, cluster FROM lineitem JOIN cl ON doc = 'P' || l_partkey), sup AS (SELECT id, cluster FROM so UNION SELECT 'C' || o_custkey, cluster FROM orders JOIN so ON id = 'O' || o_orderkey), su AS (SELECT cluster, count(*) AS supported FROM sup GROUP BY 1),
t AS (SELECT (SELECT count(DISTINCT l_orderkey) + count(DISTINCT l_partkey) FROM lineitem) + (SELECT count(DISTINCT s_suppkey) FROM supplier) + (SELECT count(DISTINCT n_nationkey) FROM nation) + (SELECT count(DISTINCT o_custkey) FROM orders) AS total), m AS (SELECT cluster, count(*) AS member_count FROM cl GROUP BY 1),
j AS (SELECT m.cluster, member_count, coalesce(cohesion, 0) AS co, coalesce(e, 0) AS ex, coalesce(supported, 0) AS supported, coalesce(supported, 0)::DOUBLE / total AS support FROM m LEFT JOIN inn USING (cluster) LEFT JOIN ext USING (cluster) LEFT JOIN su USING (cluster) CROSS JOIN t)
SELECT cluster, member_count, round(co, 6) AS cohesion, round(ex, 6) AS external_strength, round(1.0::DOUBLE - ex, 6) AS separation, round(support, 6) AS support, supported, round(0.45::DOUBLE * co + 0.25::DOUBLE * (1.0::DOUBLE - ex) + 0.3::DOUBLE * support, 6) AS strength FROM j""")
def cluster_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers, _, pairs = combined(spark, sf_dir)
    edges = stored_edges(spark, sf_dir)
    influence = graph.reach(edges, papers.select(F.col("doc").alias("id")))
    return S.cluster_metrics(pairs, _clusters(spark, sf_dir, papers), influence, edges.select(F.col("src").alias("id")).distinct())


_STRENGTH_SQL = ORACLES["cluster_strength"]


@query(f"SELECT cluster, member_count, strength FROM ({_STRENGTH_SQL}) WHERE member_count > 1 ORDER BY strength DESC, member_count DESC, cluster LIMIT 3")
def display_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest clusters of two papers or more: those that drawings show."""
    return S.display_clusters(cluster_strength(spark, sf_dir)).select("cluster", "member_count", "strength")


@query(CLUSTERS + f""", bo AS (SELECT a AS doc, combined FROM tied WHERE ca = cb UNION ALL SELECT b, combined FROM tied WHERE ca = cb), ti AS (SELECT doc, sum(combined) AS ties FROM bo GROUP BY 1),
j AS (SELECT cl.cluster, doc, {mm('citations::DOUBLE')} AS ns, count(*) OVER (PARTITION BY cl.cluster) - 1 AS others, coalesce(ties, 0) AS ties FROM papers JOIN cl USING (doc) LEFT JOIN ti USING (doc)),
k AS (SELECT cluster, doc, ns, CASE WHEN others > 0 THEN ties / others ELSE 0 END AS w FROM j)
SELECT cluster, doc, round(ns, 6) AS normalized_sap, round(w, 6) AS within_strength, round(0.6::DOUBLE * ns + 0.4::DOUBLE * w, 6) AS anchor_score FROM k""")
def root_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers, _, pairs = combined(spark, sf_dir)
    return S.root_anchors(papers.withColumnRenamed("citations", "sap"), pairs, _clusters(spark, sf_dir, papers))


# --- branches: every part and customer assigned to the subtopics of the most cited parts ----------

ASSIGN = CLEAN + PAPERS + f""", par AS MATERIALIZED (SELECT doc, p_type AS parent FROM papers JOIN part ON doc = 'P' || p_partkey),
pt AS MATERIALIZED (SELECT 'P' || p_partkey AS doc, p_name AS title, p_type || ' ' || p_brand AS abstract, p_brand AS brand FROM part UNION ALL SELECT 'C' || c_custkey, c_name, c_mktsegment, c_mktsegment FROM customer),
tk AS MATERIALIZED (SELECT doc, {TEXTS} AS tokens FROM pt), adt AS (SELECT doc, tokens FROM tk UNION ALL SELECT 'T:' || parent, flatten(list(tokens)) FROM par JOIN tk USING (doc) GROUP BY parent),
""" + vectors_sql("adt", "av") + """, nm AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM av GROUP BY doc),
tx AS MATERIALIZED (SELECT x.doc AS id, substr(y.doc, 3) AS parent, sum(x.w * y.w) / (any_value(p.norm) * any_value(q.norm)) AS value FROM av x JOIN av y USING (term) JOIN nm p ON p.doc = x.doc JOIN nm q ON q.doc = y.doc WHERE x.doc[1] <> 'T' AND y.doc[1] = 'T' GROUP BY x.doc, y.doc),
rf AS MATERIALIZED (SELECT src AS doc, dst AS m FROM clean WHERE src[1] IN ('P', 'C')), pr AS MATERIALIZED (SELECT DISTINCT parent, m FROM par JOIN rf USING (doc)),
rn AS (SELECT doc, count(*) AS n FROM rf GROUP BY 1), pn AS (SELECT parent, count(*) AS n FROM pr GROUP BY 1),
rv AS MATERIALIZED (SELECT s.doc AS id, s.parent, c / sqrt(rn.n::DOUBLE * pn.n) AS value FROM (SELECT rf.doc, pr.parent, count(*) AS c FROM rf JOIN pr USING (m) GROUP BY ALL) s JOIN rn ON rn.doc = s.doc JOIN pn ON pn.parent = s.parent),
pa AS (SELECT id, parent, min(d) AS d FROM (SELECT doc AS id, parent, 0 AS d FROM par UNION ALL SELECT x.src, parent, 1 FROM par JOIN clean x ON x.dst = doc UNION ALL SELECT y.src, parent, 2 FROM par JOIN clean x ON x.dst = doc JOIN clean y ON y.dst = x.src
  UNION ALL SELECT z.src, parent, 3 FROM par JOIN clean x ON x.dst = doc JOIN clean y ON y.dst = x.src JOIN clean z ON z.dst = y.src) GROUP BY ALL),
al AS (SELECT pt.doc AS id, k.parent, round(coalesce(CASE WHEN d = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / d END, 0), 6) AS proximity, round(coalesce(tx.value, 0), 6) AS text_similarity, round(coalesce(rv.value, 0), 6) AS reference_similarity
  FROM pt CROSS JOIN (SELECT DISTINCT parent FROM par) k LEFT JOIN pa ON pa.id = pt.doc AND pa.parent = k.parent LEFT JOIN tx ON tx.id = pt.doc AND tx.parent = k.parent LEFT JOIN rv ON rv.id = pt.doc AND rv.parent = k.parent),
sr AS (SELECT *, round(0.4::DOUBLE * proximity + 0.35::DOUBLE * text_similarity + 0.25::DOUBLE * reference_similarity, 8) AS score FROM al),
asg AS MATERIALIZED (SELECT * EXCLUDE (n), CASE WHEN score >= 0.25 THEN 'strong' WHEN score >= 0.08 THEN 'moderate' WHEN score > 0 THEN 'weak' ELSE 'unassigned' END AS confidence FROM
  (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, proximity DESC, text_similarity DESC, parent) AS n FROM sr) WHERE n = 1)"""


def _is_paper(node: str) -> Column:
    """Whether a node's number is a part's or a customer's."""
    return F.substring(name_of(node), 1, 1).isin("P", "C")


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made once; member, trend and emergence queries start from it."""

    def make() -> DataFrame:
        papers = articles(spark, sf_dir).filter(F.substring("id", 1, 1).isin("P", "C"))
        kinds = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("doc"), F.col("p_type").alias("parent"))
        members = stored(part_papers(spark, sf_dir).select("doc").join(kinds, "doc"), "parents")
        parents = stored(members.select("parent").distinct(), "parents")
        edges = clean_numbers(spark, sf_dir)
        near = graph.reach(edges, members.select(number_of("doc").alias("id")), max_depth=3)  # from the tens of members back to who cites them
        near = named(near.filter(_is_paper("id")), "seed", "id")
        path = S.path_proximity(near.join(members.select(F.col("doc").alias("seed"), "parent"), "seed").select("id", "parent", "distance"))
        own = text.corpus(papers, "id", "title", "abstract")
        together = own.join(members, "doc").select(F.concat(F.lit("T:"), "parent").alias("doc"), "tokens")
        vectors = stored(text.tfidf(own.unionByName(together)), "vectors")
        unit = vectors.join(text.norms(vectors), "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("u"))
        kind = F.substring("doc", 1, 2)
        x = unit.filter(kind != "T:").select(F.col("doc").alias("id"), "term", "u")
        y = unit.filter(kind == "T:").select(F.expr("substring(doc, 3)").alias("parent"), "term", F.col("u").alias("v"))
        texts = x.join(F.broadcast(y), "term").groupBy("id", "parent").agg(F.sum(F.col("u") * F.col("v")).alias("value"))  # y: the terms of 20 papers
        refs = stored(edges.filter(_is_paper("src")).select(F.col("src").alias("id"), F.col("dst").alias("m")), "refs")
        parent_refs = refs.join(members.select(number_of("doc").alias("id"), "parent"), "id").select("parent", "m").distinct()
        shared = refs.join(parent_refs, "m").groupBy("id", "parent").agg(F.count(F.lit(1)).alias("c"))
        shared = shared.join(refs.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id").join(parent_refs.groupBy("parent").agg(F.count(F.lit(1)).alias("k")), "parent")
        overlap = shared.select(name_of("id").alias("id"), "parent", (F.col("c") / F.sqrt(F.col("n").cast("double") * F.col("k"))).alias("value"))
        return stored(S.assign(papers, parents, path, texts, overlap), "assignments")

    return kept(spark, sf_dir, "assignments", make)


@query(ASSIGN + " SELECT id, parent, proximity, text_similarity, reference_similarity, score, confidence FROM asg")
def branch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignments(spark, sf_dir)


@query(ASSIGN + """ SELECT parent, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(proximity), 6) AS mean_proximity, count(*) FILTER (WHERE confidence = 'strong') AS n_strong, count(*) FILTER (WHERE confidence = 'moderate') AS n_moderate,
count(*) FILTER (WHERE confidence = 'weak') AS n_weak, count(*) FILTER (WHERE confidence = 'unassigned') AS n_unassigned, string_agg(id, '; ' ORDER BY id) AS members FROM asg GROUP BY parent""")
def assignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.assignment_summary(assignments(spark, sf_dir))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments by brand or market segment."""
    return assignments(spark, sf_dir).join(articles(spark, sf_dir).select("id", F.col("journal").alias("grp")), "id")


@query(ASSIGN + """, g AS (SELECT asg.*, brand AS grp FROM asg JOIN pt ON pt.doc = asg.id), p AS (SELECT grp, parent, count(*) AS c, sum(score) AS s FROM g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY c DESC, parent) AS bc, row_number() OVER (PARTITION BY grp ORDER BY round(s, 9) DESC, parent) AS bs FROM p),
f AS (SELECT grp, round(avg((confidence IN ('strong', 'moderate'))::INT), 6) AS firm_share FROM g GROUP BY grp)
SELECT grp, max(parent) FILTER (WHERE bc = 1) AS dominant_parent, max(parent) FILTER (WHERE bs = 1) AS heaviest_parent, round(CASE WHEN sum(s) > 0 THEN max(s) FILTER (WHERE bs = 1) / sum(s) ELSE 0 END, 6) AS concentration,
string_agg(parent || ':' || c, '; ' ORDER BY parent) AS count_distribution, any_value(firm_share) AS firm_share FROM r JOIN f USING (grp) GROUP BY grp""")
def parent_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.parent_distribution(_grouped(spark, sf_dir)).drop("score_distribution")


# --- branches over time: orders by priority ------------------------------------------------------

MEMBERS = f"""WITH RECURSIVE li AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS refs FROM lineitem GROUP BY 1),
mb AS MATERIALIZED (SELECT 'O' || o_orderkey AS id, o_orderpriority AS grp, year(o_orderdate)::INTEGER AS year, o_totalprice AS price, coalesce(refs, 0)::DOUBLE AS refs FROM orders LEFT JOIN li ON o_orderkey = l_orderkey)"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct().groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("refs"))
    o = table(spark, sf_dir, "orders").join(refs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("grp"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("price"), F.coalesce("refs", F.lit(0)).cast("double").alias("refs"))


GROWTH = f""", yc AS (SELECT grp, year, count(*) AS n FROM mb GROUP BY ALL), sp AS (SELECT grp, unnest(range(min(year), greatest(min(year), {NOW}) + 1))::INTEGER AS year FROM yc GROUP BY grp),
de AS (SELECT sp.grp, sp.year, coalesce(n, 0) AS n FROM sp LEFT JOIN yc ON yc.grp = sp.grp AND yc.year = sp.year), lg AS (SELECT grp, n, lag(n) OVER (PARTITION BY grp ORDER BY year) AS p FROM de),
gr AS MATERIALIZED (SELECT grp, coalesce(avg(CASE WHEN p IS NULL THEN NULL WHEN p = 0 THEN n::DOUBLE ELSE (n - p)::DOUBLE / p END), 0) AS g FROM lg GROUP BY grp)"""


@query(MEMBERS + GROWTH + " SELECT grp, round(g, 9) AS growth_rate FROM gr")
def publication_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.growth(_members(spark, sf_dir), NOW).withColumn("growth_rate", F.round("growth_rate", 9))


WINDOWS = f""", wi AS MATERIALIZED (SELECT grp, count(*) AS paper_count, count(*) FILTER (WHERE year >= {NOW - 4}) AS recent_count, count(*) FILTER (WHERE year >= {NOW - 9} AND year < {NOW - 4}) AS previous_count, avg(year) AS mean_year,
  max(year) AS newest_year, min(year) AS oldest_year, count(DISTINCT year) AS active_years FROM mb GROUP BY grp),
w2 AS MATERIALIZED (SELECT *, recent_count::DOUBLE / paper_count AS recent_share, (recent_count - previous_count)::DOUBLE / greatest(previous_count, 1) AS recent_growth, active_years::DOUBLE / (greatest({NOW}, oldest_year) - oldest_year + 1) AS active_share FROM wi)"""


@query(MEMBERS + WINDOWS + " SELECT grp, paper_count, recent_count, previous_count, round(mean_year, 9) AS mean_year, newest_year, oldest_year, active_years, round(recent_share, 9) AS recent_share, round(recent_growth, 9) AS recent_growth, round(active_share, 9) AS active_share FROM w2")
def branch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.windows(_members(spark, sf_dir), NOW)
    return out.withColumns({c: F.round(c, 9) for c in ("mean_year", "recent_share", "recent_growth", "active_share")})


#: Branches: orders by priority, and customers by the priority of their first order, as far as they are in the cleaned graph.
#: bc has what the graph and the assignments say of each branch: cohesion, assignment, citations, structure.
BRANCHES = ASSIGN + ARTICLES + f""", mb AS MATERIALIZED (SELECT x.id, grp, x.year, in_degree AS citations FROM (SELECT 'O' || o_orderkey AS id, o_orderpriority AS grp, year(o_orderdate)::INTEGER AS year FROM orders
  UNION ALL SELECT 'C' || o_custkey, arg_min(o_orderpriority, o_orderkey), max(year(o_orderdate))::INTEGER FROM orders GROUP BY o_custkey) x JOIN deg ON deg.id = x.id),
bd AS MATERIALIZED (SELECT grp, mb.id AS doc, {TEXTS} AS tokens FROM mb JOIN art ON art.id = mb.id), """ + vectors_sql("bd", "bv", "grp") + f""", bn AS (SELECT grp, doc, sqrt(sum(w * w)) AS norm FROM bv GROUP BY grp, doc),
bu AS (SELECT grp, doc, term, w / norm AS u FROM bv JOIN bn USING (grp, doc)), bs AS (SELECT grp, term, sum(u) AS s, sum(u * u) AS q FROM bu GROUP BY grp, term), bt AS (SELECT grp, (sum(s * s) - sum(q)) / 2 AS total FROM bs GROUP BY grp),
sem AS (SELECT grp, round(CASE WHEN count(*) > 1 THEN coalesce(any_value(total), 0) / (count(*) * (count(*) - 1) / 2) ELSE 0 END, 9) AS semantic FROM mb LEFT JOIN bt USING (grp) GROUP BY grp),
ba AS MATERIALIZED (SELECT asg.*, grp FROM asg JOIN mb USING (id)),
bp AS (SELECT grp, parent, round(sum(score), 9) AS s FROM ba GROUP BY ALL), bq AS (SELECT grp, round(CASE WHEN sum(s) > 0 THEN max(s) / sum(s) ELSE 0 END, 6) AS concentration FROM bp GROUP BY grp),
bf AS (SELECT grp, round(avg(score), 9) AS trunk_score, round(avg((confidence IN ('strong', 'moderate'))::INT), 6) AS firm_share FROM ba GROUP BY grp),
be AS (SELECT x.grp, count(*) FILTER (WHERE y.grp = x.grp) AS e FROM clean JOIN mb x ON x.id = src JOIN mb y ON y.id = dst GROUP BY x.grp),
co AS (SELECT x.id AS customer, x.grp, list_distinct(list(y.grp)) AS kinds FROM mb x JOIN clean ON src = x.id JOIN mb y ON y.id = dst GROUP BY ALL),
bl AS (SELECT g.grp, count(*) FILTER (WHERE co.grp <> g.grp AND kinds = [g.grp]) AS lone FROM (SELECT DISTINCT grp FROM mb) g CROSS JOIN co GROUP BY g.grp),
bc AS MATERIALIZED (SELECT grp, count(*) AS n, any_value(semantic) AS semantic, round(avg(citations / greatest({NOW} - year + 1, 1)), 9) AS velocity, sum(citations)::DOUBLE AS citations, avg(greatest(0.0::DOUBLE, 1.0::DOUBLE - greatest({NOW} - year, 0) / 7.0::DOUBLE)) AS recent,
  any_value(trunk_score) AS trunk_score, any_value(firm_share) AS firm_share, any_value(concentration) AS concentration, round(2.0::DOUBLE * coalesce(any_value(e), 0) / (count(*) * (count(*) - 1)), 6) AS density, 2.0::DOUBLE * any_value(lone) AS impact
  FROM mb LEFT JOIN sem USING (grp) LEFT JOIN bf USING (grp) LEFT JOIN bq USING (grp) LEFT JOIN be USING (grp) LEFT JOIN bl USING (grp) GROUP BY grp)"""


def branch_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp, n (the id's number), year, citations of the branches' members in the cleaned graph."""
    o = table(spark, sf_dir, "orders").select(number("O", "o_orderkey").alias("n"), number("C", "o_custkey").alias("customer"), F.col("o_orderpriority").alias("grp"), F.year("o_orderdate").alias("year"), "o_orderkey")
    customers = o.groupBy(F.col("customer").alias("n")).agg(F.min_by("grp", "o_orderkey").alias("grp"), F.max("year").alias("year"))
    rows = o.select("n", "grp", "year").unionByName(customers.select("n", "grp", "year"))
    return rows.join(clean_degrees(spark, sf_dir).select(F.col("id").alias("n"), F.col("in_degree").alias("citations")), "n")


def branch_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per branch what the graph, the texts and the assignments say: the inputs of trend and emergence. Made once."""

    def make() -> DataFrame:
        own, edges = stored(branch_members(spark, sf_dir), "members"), clean_numbers(spark, sf_dir)
        m, numbers = own.withColumn("id", name_of("n")), own.select("grp", F.col("n").alias("id"))
        docs = text.corpus(articles(spark, sf_dir).join(m.select("id"), "id"), "id", "title", "abstract").join(m.select(F.col("id").alias("doc"), "grp"), "doc")
        semantic = text.mean_pairwise(stored(text.tfidf_by_group(docs), "vectors"), docs.select("doc", "grp")).select("grp", F.round("mean_similarity", 9).alias("semantic"))
        own = stored(assignments(spark, sf_dir).join(m.select("id", "grp"), "id"), "assigned")
        parents = S.parent_distribution(own).select("grp", "concentration", "firm_share")
        trunk = own.groupBy("grp").agg(F.round(F.avg("score"), 9).alias("trunk_score"))
        quality = graph.subgraph_quality(edges, numbers).select("grp", "density")
        impact = graph.removal_impacts(edges, numbers).select("grp", (F.greatest(F.lit(0), "component_delta") + F.col("giant_loss")).cast("double").alias("impact"))
        out = m.groupBy("grp").agg(F.round(F.avg(F.col("citations") / C.age(F.col("year"), NOW)), 9).alias("velocity"), F.sum("citations").cast("double").alias("citations"), F.avg(S.recent_activity(F.col("year"), NOW)).alias("recent"))
        for more in (semantic, parents, trunk, quality, impact, S.windows(m, NOW)):
            out = out.join(more, "grp", "left")
        return stored(out, "facts")

    return kept(spark, sf_dir, "facts", make)


@query(BRANCHES + f" SELECT grp, semantic, velocity, citations, round(recent, 9) AS recent, trunk_score, firm_share, concentration, density, impact FROM bc")
def branch_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branch_facts(spark, sf_dir).select("grp", "semantic", "velocity", "citations", F.round("recent", 9).alias("recent"), "trunk_score", "firm_share", "concentration", "density", "impact")


TREND = f""", ts AS (SELECT grp, round(0.3::DOUBLE * {mm('trunk_score')} + 0.25::DOUBLE * {mm('semantic')} + 0.25::DOUBLE * {mm('recent')} + 0.2::DOUBLE * {mm('ln(1 + velocity)')}, 6) AS branch_trend_score FROM bc)"""


@query(BRANCHES + TREND + " SELECT grp, branch_trend_score, row_number() OVER (ORDER BY branch_trend_score DESC, grp)::INTEGER AS branch_trend_rank FROM ts")
def branch_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.trend(branch_facts(spark, sf_dir).withColumn("structural", F.col("trunk_score"))).select("grp", "branch_trend_score", "branch_trend_rank")


NOVEL = """, nrf AS MATERIALIZED (SELECT DISTINCT 'O' || l_orderkey AS src, l_partkey AS dst FROM lineitem), nsz AS (SELECT src, count(*) AS n FROM nrf GROUP BY 1), nyr AS (SELECT 'O' || o_orderkey AS id, year(o_orderdate)::INTEGER AS year, o_orderpriority AS grp FROM orders),
nsh AS (SELECT a.src AS id, b.src AS cand, count(*) AS s FROM nrf a JOIN nrf b ON a.dst = b.dst AND a.src <> b.src JOIN nyr x ON x.id = a.src JOIN nyr y ON y.id = b.src WHERE y.year < x.year AND y.year >= x.year - 10 GROUP BY ALL),
nfo AS (SELECT id, count(*) AS c, avg(s::DOUBLE / (p.n + q.n - s)) AS o FROM nsh JOIN nsz p ON p.src = id JOIN nsz q ON q.src = cand GROUP BY id),
nv AS MATERIALIZED (SELECT nyr.id, grp, year, coalesce(n, 0) AS reference_count, coalesce(c, 0) AS candidate_count, round(o + 1e-12::DOUBLE, 6) AS mean_overlap, round(1 - o + 1e-12::DOUBLE, 6) AS reference_novelty, coalesce(c, 0) >= 3 AS supported FROM nyr LEFT JOIN nsz ON nsz.src = nyr.id LEFT JOIN nfo ON nfo.id = nyr.id)"""
NOVEL_BY_BRANCH = f""", sm AS (SELECT grp, count(*) AS paper_count, count(*) FILTER (WHERE supported AND reference_novelty IS NOT NULL) AS supported_count, round(coalesce(avg(reference_novelty) FILTER (WHERE supported), 0), 6) AS mean_novelty, round(coalesce(median(reference_novelty) FILTER (WHERE supported), 0), 6) AS median_novelty,
 round(coalesce(max(reference_novelty) FILTER (WHERE supported), 0), 6) AS max_novelty, round(coalesce(avg(reference_novelty) FILTER (WHERE supported AND year >= {NOW - 4}), 0), 6) AS recent_mean_novelty, round(coalesce(avg((reference_novelty >= 0.8)::INT) FILTER (WHERE supported), 0), 6) AS high_share FROM nv GROUP BY grp),
sn AS MATERIALIZED (SELECT *, round({mm('recent_mean_novelty')}, 6) AS novelty_score, round(supported_count::DOUBLE / greatest(paper_count, 1), 6) AS support_share FROM sm),
se AS MATERIALIZED (SELECT *, round(novelty_score * support_share, 6) AS effective_score, row_number() OVER (ORDER BY novelty_score DESC, grp)::INTEGER AS novelty_rank FROM sn)"""


@query(BRANCHES + WINDOWS + NOVEL + NOVEL_BY_BRANCH + f""", j AS (SELECT w2.*, semantic, velocity, citations, trunk_score, firm_share, concentration, density, impact, coalesce(effective_score, 0) AS novelty FROM w2 JOIN bc USING (grp) LEFT JOIN se USING (grp)),
d AS (SELECT *, round(0.4::DOUBLE * {mm('recent_share')} + 0.4::DOUBLE * {mm('recent_growth')} + 0.2::DOUBLE * {mm('mean_year')}, 6) AS novelty_growth, round(0.5::DOUBLE * {mm('semantic')} + 0.25::DOUBLE * {mm('density')} + 0.25::DOUBLE * {mm('active_share')}, 6) AS persistence,
  round(0.4::DOUBLE * {mm('ln(1 + velocity)')} + 0.3::DOUBLE * {mm('ln(1 + citations)')} + 0.3::DOUBLE * {mm('trunk_score')}, 6) AS scientific_impact, round(0.4::DOUBLE * {mm('concentration')} + 0.4::DOUBLE * {mm('firm_share')} + 0.2::DOUBLE * {mm('impact')}, 6) AS uncertainty_reduction,
  round({mm('novelty')}, 6) AS reference_novelty_score FROM j),
e AS (SELECT *, round(0.3::DOUBLE * novelty_growth + 0.25::DOUBLE * persistence + 0.2::DOUBLE * scientific_impact + 0.15::DOUBLE * uncertainty_reduction + 0.1::DOUBLE * reference_novelty_score, 6) AS score FROM d)
SELECT grp, novelty_growth, persistence, scientific_impact, uncertainty_reduction, reference_novelty_score, score AS branch_emergence_score, row_number() OVER (ORDER BY score DESC, grp)::INTEGER AS branch_emergence_rank,
CASE WHEN novelty_growth >= 0.65 AND semantic < 0.05 THEN 'active_but_heterogeneous_candidate' WHEN score >= 0.65 AND novelty_growth >= 0.45 AND persistence >= 0.45 AND semantic >= 0.05 AND recent_share >= 0.25 AND recent_growth >= 0 THEN 'emerging_research_direction'
 WHEN recent_share <= 0.20 AND density >= 0.15 AND semantic >= 0.04 THEN 'mature_niche_or_specialized_domain' WHEN novelty_growth >= 0.65 AND persistence < 0.35 THEN 'active_but_heterogeneous_candidate'
 WHEN scientific_impact >= 0.65 AND novelty_growth < 0.45 THEN 'established_structural_trajectory' ELSE 'weak_or_preliminary_candidate' END AS branch_emergence_type FROM e""")
def branch_emergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    novelty = _novelty_by_branch(spark, sf_dir).select("grp", F.col("effective_score").alias("novelty"))
    rows = branch_facts(spark, sf_dir).join(novelty, "grp", "left")
    out = S.emergence(rows, shares=(0.3, 0.25, 0.2, 0.15, 0.1))
    return out.select("grp", "novelty_growth", "persistence", "scientific_impact", "uncertainty_reduction", "reference_novelty_score", "branch_emergence_score", "branch_emergence_rank", "branch_emergence_type")


# --- members: parts by brand, customers by segment ------------------------------------------------

TOPICS = ("steel", "polished", "automobile", "house")


def _topical(text_sql: str, terms) -> str:
    return "(" + " OR ".join(f"contains(lower({text_sql}), '{t}')" for t in terms) + ")"


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ROLES = ASSIGN + ARTICLES + f""", rd AS MATERIALIZED (SELECT journal AS grp, id AS doc, {TEXTS} AS tokens FROM art WHERE id[1] IN ('P', 'C')), """ + vectors_sql("rd", "rv2") + f""", rg AS (SELECT grp, rv2.* FROM rv2 JOIN rd USING (doc)), rc2 AS (SELECT grp, count(DISTINCT doc) AS n FROM rg GROUP BY grp),
ce AS MATERIALIZED (SELECT grp, term, sum(w) / any_value(n) AS cw FROM rg JOIN rc2 USING (grp) GROUP BY grp, term), cn AS (SELECT grp, sqrt(sum(cw * cw)) AS size FROM ce GROUP BY grp),
cs AS (SELECT doc, rg.grp, sum(w * cw) / (sqrt(sum(w * w)) * any_value(size)) AS similarity FROM rg JOIN ce USING (grp, term) JOIN cn USING (grp) GROUP BY doc, rg.grp),
m AS MATERIALIZED (SELECT rd.grp, art.id, art.year, title, abstract, journal, source_title, len(tokens) AS n_tokens, score AS trunk_score, confidence, round(coalesce(similarity, 0), 9) AS similarity, in_degree AS citations_received
  FROM art JOIN rd ON rd.doc = art.id LEFT JOIN cs ON cs.doc = art.id LEFT JOIN asg ON asg.id = art.id LEFT JOIN deg ON deg.id = art.id),
q AS (SELECT *, trim(coalesce(title, ''), {_WS}) = '' OR n_tokens < 4 AS weak, {mm('similarity', 'PARTITION BY grp')} AS sl, coalesce((({NOW} - year) BETWEEN 0 AND 4)::INT::DOUBLE, 0) AS rec, {mm('trunk_score', 'PARTITION BY grp')} AS tl FROM m),
s AS (SELECT *, round(0.5::DOUBLE * sl + 0.3::DOUBLE * rec + 0.2::DOUBLE * tl, 6) AS core FROM q),
ro AS MATERIALIZED (SELECT grp, id, year, citations_received, similarity, core AS branch_core_score, CASE WHEN weak THEN 'weak' WHEN trim(coalesce(abstract, ''), {_WS}) = '' THEN 'title_only' ELSE 'complete' END AS metadata_quality,
 CASE WHEN weak THEN 'missing_metadata' WHEN {_topical("concat_ws(' ', title, journal, source_title)", S.NON_SCHOLARLY_TERMS)} OR {_topical("concat_ws(' ', title, journal, source_title)", S.METHOD_TERMS)} THEN 'background_methodological'
  WHEN {_topical("concat_ws(' ', title, abstract, journal, source_title)", TOPICS)} AND ((core >= 0.55 AND similarity >= 0.03) OR (sl >= 0.5 AND similarity >= 0.03) OR (similarity >= 0.2 AND core >= 0.2) OR (confidence IN ('strong', 'moderate') AND similarity >= 0.03)) THEN 'core' ELSE 'peripheral' END AS branch_member_role FROM s)"""


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members joined with their similarity to the branch, assignment and citations; roles by rule."""

    def make() -> DataFrame:
        rows = articles(spark, sf_dir).filter(F.substring("id", 1, 1).isin("P", "C")).withColumn("grp", F.col("journal"))
        docs = stored(text.corpus(rows, "id", "title", "abstract"), "corpus")
        groups = rows.select(F.col("id").alias("doc"), "grp")
        near = text.centroid_similarity(stored(text.tfidf(docs), "vectors"), groups).select(F.col("doc").alias("id"), F.round("similarity", 9).alias("similarity"))
        given = assignments(spark, sf_dir).select("id", F.col("score").alias("trunk_score"), "confidence")
        rows = rows.join(near, "id", "left").join(given, "id", "left").join(docs.select(F.col("doc").alias("id"), F.size("tokens").alias("token_count")), "id", "left")
        rows = rows.join(named(clean_degrees(spark, sf_dir), "id").select("id", F.col("in_degree").alias("citations_received")), "id", "left")
        return stored(S.member_roles(rows, TOPICS, NOW), "members")

    return kept(spark, sf_dir, "member roles", make)


@query(ROLES + " SELECT grp, id, similarity, branch_core_score, metadata_quality, branch_member_role FROM ro")
def member_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roles(spark, sf_dir).select("grp", "id", "similarity", "branch_core_score", "metadata_quality", "branch_member_role")


@query(ROLES + """, nb AS (SELECT *, 'branch_' || dense_rank() OVER (ORDER BY grp) AS branch FROM ro), po AS (SELECT branch, id, row_number() OVER (ORDER BY regexp_extract(branch, '[0-9]+')::INT, CASE branch_member_role WHEN 'core' THEN 1 WHEN 'peripheral' THEN 2 WHEN 'background_methodological' THEN 3 ELSE 4 END,
 branch_core_score DESC, year DESC NULLS LAST, citations_received DESC NULLS LAST, id)::INTEGER AS display_position, row_number() OVER (PARTITION BY branch ORDER BY branch_core_score DESC, id) AS p FROM nb)
SELECT branch || '_' || lpad(p::VARCHAR, greatest(2, length(p::VARCHAR))::INTEGER, '0') AS pid, id, display_position FROM po""")
def branch_display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member's place on the drawing, and its positional id within its branch."""
    rows = _roles(spark, sf_dir)
    names = rows.select("grp").distinct().withColumn("g", F.row_number().over(W.orderBy("grp")))  # a row for each branch
    rows = rows.join(F.broadcast(names), "grp").withColumn("grp", F.concat(F.lit("branch_"), F.col("g").cast("string")))
    out = S.positional_ids(S.display_order(rows), "branch", F.col("branch_core_score").desc(), "id", group="g")
    return out.select("pid", "id", "display_position")


@query(ROLES + """ SELECT grp, count(*) AS paper_count, count(*) FILTER (WHERE branch_member_role = 'core') AS core_count, count(*) FILTER (WHERE branch_member_role = 'peripheral') AS peripheral_count, count(*) FILTER (WHERE branch_member_role = 'background_methodological') AS background_methodological_count,
count(*) FILTER (WHERE branch_member_role = 'missing_metadata') AS missing_metadata_count, round(avg((branch_member_role = 'core')::INT), 6) AS core_share, round(avg(branch_core_score), 6) AS mean_core_score, coalesce(string_agg(id::VARCHAR, '; ' ORDER BY id) FILTER (WHERE branch_member_role = 'core'), '') AS core_ids FROM ro GROUP BY grp""")
def member_role_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.summarize_roles(_roles(spark, sf_dir))


# --- novelty: orders that share parts ------------------------------------------------------------

def _novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Novelty of every order by its parts, with its priority and year. Made once."""

    def make() -> DataFrame:
        o = table(spark, sf_dir, "orders")
        members = o.select(number("O", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("grp"), F.year("o_orderdate").alias("year"))
        edges = table(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL AND l_partkey IS NOT NULL").select(number("O", "l_orderkey").alias("src"), number("P", "l_partkey").alias("dst")).distinct()
        when = members.select("id", "year")
        refs = stored(S.windowed_references(edges, when), "refs")  # parts have no year
        return stored(named(S.reference_novelty(members, refs, when).join(members, "id"), "id"), "novelty")

    return kept(spark, sf_dir, "novelty", make)


def _novelty_by_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.novelty_summary(_novelty(spark, sf_dir), NOW)


@query(MEMBERS + NOVEL + " SELECT id, reference_count, candidate_count, mean_overlap, reference_novelty, supported FROM nv")
def reference_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _novelty(spark, sf_dir).drop("grp", "year")


@query(MEMBERS + NOVEL + NOVEL_BY_BRANCH + " SELECT grp, paper_count, supported_count, mean_novelty, median_novelty, max_novelty, recent_mean_novelty, high_share, support_share, novelty_score, effective_score, novelty_rank FROM se")
def novelty_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _novelty_by_branch(spark, sf_dir)


# --- fruits and leaves ---------------------------------------------------------------------------

FRUIT = CITED + PAPERS + f""", mp AS (SELECT 'P' || p_partkey AS doc, p_name AS title, p_type || ' ' || p_brand AS abstract FROM part), md AS (SELECT doc, {TEXTS} AS tokens FROM mp), """ + vectors_sql("md", "mv") + f""",
mn AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM mv GROUP BY doc), mu AS MATERIALIZED (SELECT doc, term, w / norm AS u FROM mv JOIN mn USING (doc)),
ms AS (SELECT doc, max(s) AS tr FROM (SELECT x.doc, y.doc AS anchor, sum(x.u * y.u) AS s FROM mu x JOIN mu y USING (term) WHERE y.doc IN (SELECT doc FROM papers) GROUP BY x.doc, y.doc) GROUP BY doc), un AS MATERIALIZED (SELECT DISTINCT 'P' || l_partkey AS a, 'S' || l_suppkey AS b FROM lineitem), f AS (SELECT DISTINCT b AS id FROM un JOIN papers ON papers.doc = a UNION SELECT doc FROM papers),
nb AS (SELECT a AS id, count(*) AS n FROM un WHERE b IN (SELECT id FROM f) GROUP BY 1),
cd AS MATERIALIZED (SELECT cp.doc AS id, year, round_even(price, 0) AS cited_by, cites AS in_degree, coalesce(n, 0) AS nb, CASE WHEN n > 0 THEN 1 END AS dist, EXISTS (SELECT 1 FROM un WHERE un.a = cp.doc) AS in_graph, round(coalesce(tr, 0), 6) AS tr
  FROM cp LEFT JOIN nb ON nb.id = cp.doc LEFT JOIN ms ON ms.doc = cp.doc WHERE cp.doc NOT IN (SELECT doc FROM papers) AND year >= {NOW} - 5),
v AS (SELECT *, cited_by / greatest({NOW} - year + 1, 1) AS ev, greatest(0.0::DOUBLE, {mm('ln(1 + cited_by)')} - {mm('ln(1 + in_degree)')}) AS gap FROM cd),
g AS (SELECT *, {mm('gap')} AS ag, 0.65::DOUBLE * coalesce(1.0::DOUBLE / (1 + dist), 0) + 0.35::DOUBLE * {mm('ln(1 + nb::DOUBLE)')} AS px FROM v),
fr AS MATERIALIZED (SELECT *, round(0.35::DOUBLE * {mm('ln(1 + ev)')} + 0.35::DOUBLE * ag + 0.2::DOUBLE * px + 0.1::DOUBLE * {mm('tr')}, 6) AS fs, CASE WHEN cited_by <= 0 THEN 'recent_no_external_signal' WHEN NOT in_graph THEN 'external_signal_not_matched_in_graph'
  WHEN in_degree <= 1 AND ag >= 0.4 THEN 'external_fruit_underabsorbed' WHEN in_degree >= 5 AND ag <= 0.15 THEN 'already_absorbing_into_tree' ELSE 'fruit_candidate' END AS kind FROM g)"""


def _fruits(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = part_papers(spark, sf_dir)
    edges = stored(stored_edges(spark, sf_dir).filter(F.substring("src", 1, 1) == "P"), "edges")
    field = stored(papers.select(F.col("doc").alias("id")).unionByName(edges.join(papers.select(F.col("doc").alias("src")), "src").select(F.col("dst").alias("id"))).distinct(), "field")
    parts = _cited_parts(spark, sf_dir).withColumnRenamed("doc", "id").filter(F.col("year") >= NOW - 5).join(field, "id", "left_anti")
    rows = parts.join(graph.field_neighbors(edges, field), "id", "left").join(graph.field_distance(edges, field, 1).withColumnRenamed("distance", "dist"), "id", "left")
    rows = rows.join(edges.select(F.col("src").alias("id")).distinct().withColumn("in_graph", F.lit(True)), "id", "left")
    docs = text.corpus(articles(spark, sf_dir).filter(F.substring("id", 1, 1) == "P"), "id", "title", "abstract")
    relevance = text.best_anchor(stored(text.tfidf(docs), "vectors"), docs, papers).select(F.col("doc").alias("id"), F.round("similarity", 6).alias("text_relevance"))
    rows = rows.join(relevance, "id", "left")
    rows = rows.select(
        "id", "year", F.rint("price").alias("cited_by"), F.col("citations_received").alias("in_degree"), F.coalesce("in_graph", F.lit(False)).alias("in_graph"),
        F.col("dist").alias("distance"), F.coalesce("field_neighbors", F.lit(0)).alias("field_neighbors"), F.coalesce("text_relevance", F.lit(0.0)).alias("text_relevance"),
    )
    return S.fruit_scores(rows, NOW).withColumn("fruit_score", F.round("fruit_score", 6))


@query(FRUIT + " SELECT id, round(ev, 9) AS external_velocity, round(ag, 6) AS attention_gap, round(px, 6) AS proximity, fs AS fruit_score, kind AS fruit_signal_type FROM fr")
def fruit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _fruits(spark, sf_dir)
    return out.select("id", F.round("external_velocity", 9).alias("external_velocity"), F.round("attention_gap", 6).alias("attention_gap"), F.round("proximity", 6).alias("proximity"), "fruit_score", "fruit_signal_type")


@query(FRUIT + f""", tp AS (SELECT * FROM fr ORDER BY (kind = 'external_fruit_underabsorbed') DESC, fs DESC, ev DESC, id LIMIT 3), lo AS (SELECT min(ev) AS lo, coalesce((SELECT ev FROM tp ORDER BY ev DESC LIMIT 1 OFFSET 1), max(ev)) AS cap FROM tp),
r AS (SELECT id, fs, CASE WHEN abs(cap - lo) <= 1e-9::DOUBLE * greatest(abs(cap), abs(lo)) THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (ev - lo) / nullif(cap - lo, 0))) END AS s FROM tp CROSS JOIN lo), sc AS (SELECT id, fs, s, {mm('fs')} AS k FROM r)
SELECT id, fs AS fruit_score, round(20.0::DOUBLE + s * 14.0::DOUBLE, 6) AS radius, {sql_color('k', C.FRUIT_REDS)} AS color FROM sc""")
def fruit_top3_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_fruits(_fruits(spark, sf_dir)).select("id", "fruit_score", F.round("radius", 6).alias("radius"), "color")


@query("SELECT year(o_orderdate)::INTEGER AS year, CASE WHEN o_orderstatus = 'F' THEN 'metadata' ELSE 'node_id' END AS year_source, count(*) AS n FROM orders GROUP BY ALL")
def year_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years from metadata where there is any, else from the node id, with where each came from."""
    o = table(spark, sf_dir, "orders")
    node = F.concat(F.lit("ORDER "), F.col("o_orderkey").cast("string"), F.lit("x, "), F.date_format("o_orderdate", "yyyy"), F.lit(", J"))
    rows = S.publication_years(o.select(node.alias("id"), F.when(F.col("o_orderstatus") == "F", F.year("o_orderdate")).alias("year")))
    return rows.groupBy("year", "year_source").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT page_id, try_cast(nullif(regexp_extract(url, '(?:^|[^0-9])(19[0-9]{2}|20[0-9]{2})(?:[^0-9]|$)', 1), '') AS INTEGER) AS year FROM pages")
def year_from_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", C.year_in_digits(F.col("url")).alias("year"))


@query(MEMBERS + f""", k AS (SELECT id, CASE WHEN grp <> '5-LOW' THEN year END AS year FROM mb), a AS (SELECT id, year, max(year) OVER () - year AS age, max(year) OVER () AS nw, min(year) OVER () AS ol FROM k), b AS (SELECT *, greatest(1.0::DOUBLE, nw - 5 - ol) AS sp FROM a)
SELECT id, age::INTEGER AS leaf_age, CASE WHEN year IS NULL THEN 'unknown_year_leaf' WHEN age = 0 THEN 'fresh_frontier_leaf' WHEN age <= 5 THEN 'recent_dark_green_leaf' ELSE 'dormant_leaf' END AS leaf_temporal_class,
CASE WHEN year IS NULL THEN '{C.DORMANT_BROWNS[0]}' WHEN age <= 5 THEN {sql_color('1.0::DOUBLE - age / 5.0::DOUBLE', C.ACTIVE_GREENS)} ELSE {sql_color('(year - ol)::DOUBLE / sp', C.DORMANT_BROWNS)} END AS leaf_color FROM b""")
def temporal_leaf_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _members(spark, sf_dir).select("id", F.when(F.col("grp") != "5-LOW", F.col("year")).alias("year"))
    return S.temporal_leaves(rows).select("id", "leaf_age", "leaf_temporal_class", "leaf_color")


@query(CLEAN + SAP + f""", l AS (SELECT lf.id, year, in_degree FROM lf JOIN deg USING (id) JOIN art USING (id)), s AS (SELECT id, {mm('year::DOUBLE')} AS ys, {mm('ln(1 + in_degree::DOUBLE)')} AS cs FROM l)
SELECT id, round(ys, 9) AS year_score, round(19.0::DOUBLE + cs * 15.0::DOUBLE, 9) AS leaf_length, {sql_color('ys', C.LEAF_GREENS)} AS leaf_color FROM s""")
def leaf_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _leaf_numbers(spark, sf_dir).filter("leaf > 0").select("id")
    rows = named(found.join(clean_degrees(spark, sf_dir), "id"), "id").join(articles(spark, sf_dir).select("id", "year"), "id")
    return S.leaf_metrics(rows).select("id", F.round("year_score", 9).alias("year_score"), F.round("leaf_length", 9).alias("leaf_length"), "leaf_color")


@query("SELECT doc_id, source, row_number() OVER (ORDER BY source, n_chars DESC, doc_id) AS rank FROM documents WHERE lang = 'en' AND contains(translate(concat_ws(' ', source, lang, text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'license')")
def record_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interactive search: a role filter, a substring over all fields joined, and a total order."""
    rows = table(spark, sf_dir, "documents").filter((F.col("lang") == "en") & F.translate(F.concat_ws(" ", "source", "lang", "text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").contains("license"))
    rank = F.row_number().over(W.orderBy("source", F.col("n_chars").desc(), "doc_id"))  # over what the search found
    return rows.select("doc_id", "source", rank.cast("long").alias("rank"))


_KINDS = {"R": "root", "N": "root", "S": "trunk", "P": "branch", "C": "leaf", "O": "fruit"}


def search_index(spark: SparkSession, sf_dir: str) -> search.Index:
    """The index of every article as a record: its kind is the role, its journal the subgroup. Made once."""
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair)), F.substring("id", 1, 1))
    rows = articles(spark, sf_dir).select("id", "title", "journal", "source_title", "year", kind.alias("role"), F.concat(kind, F.lit("s")).alias("role_label"), F.coalesce("journal", F.lit("none")).alias("subgroup"))
    return kept(spark, sf_dir, "search", lambda: search.Index(rows.withColumn("subgroup_label", F.col("subgroup"))))


@query(CLEAN + ARTICLES + f""", r AS (SELECT id, title, journal, source_title, year, CASE id[1] {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items())} END AS role, coalesce(journal, 'none') AS subgroup FROM art),
h AS (SELECT *, lower(array_to_string([id, coalesce(title, ''), role || 's', subgroup, coalesce(journal, ''), coalesce(source_title, ''), '', coalesce(year::VARCHAR, ''), ''], ' ')) AS t FROM r)
SELECT id, role, row_number() OVER (ORDER BY list_position(['root', 'trunk', 'branch', 'leaf', 'fruit'], role), coalesce(year, 0) DESC, id) AS rank FROM h WHERE contains(t, 'uildin') AND role = 'leaf' AND subgroup = 'BUILDING'""")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of all nine fields of every article, with role and subgroup, from the stored index."""
    return search_index(spark, sf_dir).search("UILDIN", "leaf", "BUILDING").select("id", "role", "rank")


# --- branches of given communities: orders and customers by nation ---------------------------------

NATIONS = CLEAN + SAP + """, nn AS MATERIALIZED (SELECT 'C' || c_custkey AS id, c_nationkey AS nation, 'C' || c_custkey AS customer FROM customer UNION ALL SELECT 'O' || o_orderkey, c_nationkey, 'C' || c_custkey FROM orders JOIN customer ON o_custkey = c_custkey),
nm2 AS MATERIALIZED (SELECT nn.* FROM nn JOIN deg USING (id)), ns AS (SELECT nation, row_number() OVER (ORDER BY count(*), min(id))::INTEGER AS branch FROM nm2 GROUP BY nation),
nb2 AS MATERIALIZED (SELECT nm2.*, branch FROM nm2 JOIN ns USING (nation) WHERE branch <= 3),
el AS MATERIALIZED (SELECT nb2.*, art.year FROM nb2 JOIN art USING (id) JOIN sc USING (id) WHERE art.year IS NOT NULL AND root = 0 AND id NOT IN (SELECT id FROM tr)),
se2 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY year DESC, id DESC)::INTEGER AS branch_rank FROM el) WHERE branch_rank <= 15)"""


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, community) of the cleaned graph's customers and their orders, by nation."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("community"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string")).alias("id")
    rows = c.select(name("C", "c_custkey"), "community").unionByName(o.select(name("O", "o_orderkey"), "community"))
    return rows.join(named(clean_degrees(spark, sf_dir).select("id"), "id"), "id", "left_semi")


@query(NATIONS + " SELECT id, branch, branch_rank FROM se2")
def branch_selection_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir)
    return roles.branches(_nations(spark, sf_dir), s, roles.trunk(s), articles(spark, sf_dir))


@query(NATIONS + """, br AS (SELECT id, 'branch_' || branch AS role FROM se2), lb AS (SELECT sc.id, CASE WHEN root > 0 THEN 'root' WHEN tr.id IS NOT NULL THEN 'trunk' WHEN leaf > 0 THEN 'leaf' WHEN br.id IS NOT NULL THEN br.role ELSE '' END AS role FROM sc LEFT JOIN tr ON tr.id = sc.id LEFT JOIN br ON br.id = sc.id)
SELECT id, role FROM lb""")
def role_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node's label: root before trunk before leaf before branch_N."""
    s = scores(spark, sf_dir)
    trunk = roles.trunk(s)
    return roles.label(s, trunk, roles.branches(_nations(spark, sf_dir), s, trunk, articles(spark, sf_dir))).select("id", "role")


@query(NATIONS + f""", ce2 AS (SELECT branch, count(*) AS n, count(DISTINCT customer) AS k FROM nb2 GROUP BY branch), cl2 AS (SELECT branch, max(n) AS largest FROM (SELECT branch, customer, count(*) AS n FROM nb2 GROUP BY ALL) GROUP BY branch),
sk AS (SELECT branch, customer, count(*) AS n, max((id = customer)::INT) AS hub FROM se2 GROUP BY ALL),
sp AS (SELECT branch, sum(n)::BIGINT AS n, sum(CASE WHEN hub = 1 THEN n - 1 ELSE 0 END)::BIGINT AS e, sum(CASE WHEN hub = 1 THEN 1 ELSE n END)::BIGINT AS k, max(CASE WHEN hub = 1 THEN n ELSE 1 END) AS largest FROM sk GROUP BY branch),
sd AS (SELECT branch AS grp, se2.id AS doc, {TEXTS} AS tokens FROM se2 JOIN art USING (id)), """ + vectors_sql("sd", "sv", "grp") + """, sno AS (SELECT grp, doc, sqrt(sum(w * w)) AS norm FROM sv GROUP BY grp, doc), su AS (SELECT grp, term, w / norm AS u FROM sv JOIN sno USING (grp, doc)),
st AS (SELECT grp, (sum(s * s) - sum(q)) / 2 AS total FROM (SELECT grp, term, sum(u) AS s, sum(u * u) AS q FROM su GROUP BY grp, term) GROUP BY grp), ec AS (SELECT branch, count(*) AS n FROM el GROUP BY branch), li AS (SELECT branch, string_agg(id, '; ' ORDER BY branch_rank) AS ids FROM se2 GROUP BY branch)
SELECT 'by_nation' AS algorithm, 'branch_' || branch AS branch_label, 'current' AS selection_strategy, ce2.n AS community_size, ec.n AS eligible_candidate_count, ce2.n - ce2.k AS community_internal_edges, round(2.0::DOUBLE * (ce2.n - ce2.k) / (ce2.n * (ce2.n - 1)), 6) AS community_density,
 ce2.k AS community_connected_components, round(cl2.largest::DOUBLE / ce2.n, 6) AS community_largest_component_fraction, sp.n AS selected_node_count, e AS internal_edges_selected, round(CASE WHEN sp.n > 1 THEN 2.0::DOUBLE * e / (sp.n * (sp.n - 1)) ELSE 0 END, 6) AS density_selected,
 sp.k AS connected_components_selected, round(sp.largest::DOUBLE / sp.n, 6) AS largest_component_fraction, round(CASE WHEN sp.n > 1 THEN coalesce(total, 0) / (sp.n * (sp.n - 1) / 2) ELSE 0 END, 6) AS mean_pairwise_text_similarity, ids AS member_node_ids
FROM ce2 JOIN cl2 USING (branch) JOIN sp USING (branch) JOIN ec USING (branch) JOIN li USING (branch) LEFT JOIN st ON st.grp = branch""")
def branch_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, edges = scores(spark, sf_dir), clean_edges(spark, sf_dir)
    trunk, arts = roles.trunk(s), articles(spark, sf_dir)
    groups = stored(_nations(spark, sf_dir), "communities")
    nodes = stored(roles.smallest_communities(groups), "branches")
    selected = stored(roles.branches(groups, s, trunk, arts), "selected")
    docs = text.corpus(arts.join(selected.select("id"), "id"), "id", "title", "abstract")
    out = community.branch_quality(edges, nodes, selected, roles.eligible(nodes, s, trunk, arts), docs, "by_nation", "current")
    return _whole(out, "community_internal_edges", "internal_edges_selected")


# --- the graphs and clusters of the papers ---------------------------------------------------------


@query(COMBINED + """ SELECT 'text' AS measure, a, b, text AS weight FROM co WHERE text >= 0.15 UNION ALL SELECT 'cocitation', a, b, cocitation FROM co WHERE cocitation >= 0.01 UNION ALL SELECT 'structural', a, b, structural FROM co WHERE structural >= 0.25
UNION ALL SELECT 'combined', a, b, combined FROM co WHERE combined >= 0.12""")
def threshold_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity graph of each measure alone, and of their sum."""
    _, _, pairs = combined(spark, sf_dir)
    parts = [similarity.strong(pairs, m, t).select(F.lit(m).alias("measure"), "a", "b", "weight") for m, t in (("text", 0.15), ("cocitation", 0.01), ("structural", 0.25), ("combined", 0.12))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(COMBINED + " SELECT a, b, text, structural AS \"references\", cocitation AS citers, round(0.4::DOUBLE * text + 0.35::DOUBLE * structural + 0.25::DOUBLE * cocitation, 8) AS combined FROM co")
def trunk_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers, _, pairs = combined(spark, sf_dir)
    parts = {"text": pairs.select("a", "b", "text"), "references": pairs.select("a", "b", "structural"), "citers": pairs.select("a", "b", "cocitation")}
    return similarity.combine(papers, parts, {"text": 0.40, "references": 0.35, "citers": 0.25}, 8)


@query(CLUSTERS + """, cs AS (SELECT cluster, member, count(DISTINCT st.doc) AS c FROM st JOIN cl USING (doc) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY c DESC, member) AS r FROM cs)
SELECT cluster AS community, coalesce(string_agg(member, '; ' ORDER BY r) FILTER (WHERE r <= 3), 'isolated_root') AS label FROM (SELECT DISTINCT cluster FROM cl) LEFT JOIN r USING (cluster) GROUP BY cluster""")
def shared_member_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities named by who cites most of their papers."""
    papers = part_papers(spark, sf_dir)
    sets = similarity.member_sets(stored_edges(spark, sf_dir), papers)
    return similarity.shared_members(sets, _clusters(spark, sf_dir, papers).withColumnRenamed("cluster", "community"))


@query("SELECT c_custkey AS custkey, c_name || ', ' || c_mktsegment AS label FROM customer")
def short_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.concat_ws(" , ", "c_name", "c_mktsegment", F.lit("JOURNAL"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), C.short_label(node).alias("label"))


@query("SELECT o_orderkey AS orderkey, CASE WHEN o_orderstatus = 'F' THEN year(o_orderdate)::DOUBLE END AS year, try_cast(left(o_orderpriority, 1) AS DOUBLE) AS cited_by FROM orders")
def numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's table under other spellings of the columns, its numbers as text."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("orderkey"), F.when(F.col("o_orderstatus") == "F", F.year("o_orderdate").cast("string")).otherwise("n/a").alias(" Year "), F.substring("o_orderpriority", 1, 1).alias("CITED_BY"))
    return clean.numeric(clean.normalize_columns(rows), "year", "cited_by")


# --- communities, topics: no SQL; the tests hold them against bounds and brute force --------------


def _weighted_numbers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of the whole cleaned graph on numbers: a, b, weight, and id. It has no cycle, so no pair of nodes is linked twice."""
    edges = clean_numbers(spark, sf_dir).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(1.0).alias("weight"))
    return edges, clean_degrees(spark, sf_dir).select("id")


def _weighted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same with ids."""
    edges, nodes = _weighted_numbers(spark, sf_dir)
    return named(edges, "a", "b"), named(nodes, "id")


def _communities(spark: SparkSession, sf_dir: str, algorithm: str) -> DataFrame:
    """(id, community) of the whole cleaned graph, found on numbers; made once, and so are the first moves, which both algorithms begin with."""

    def make() -> DataFrame:
        edges, nodes = _weighted_numbers(spark, sf_dir)
        first = kept(spark, sf_dir, "first moves", lambda: community.first_level(edges, nodes))
        found = stored(named(getattr(community, algorithm)(edges, nodes, first=first), "id"), "found")
        names = found.groupBy("community").agg(F.min("id").alias("name"))
        return stored(found.join(names, "community").select("id", F.col("name").alias("community")), algorithm)

    return kept(spark, sf_dir, algorithm, make)


@query()
def louvain_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.smallest_communities(_communities(spark, sf_dir, "louvain"))


@query()
def leiden_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.smallest_communities(_communities(spark, sf_dir, "leiden"))


@query()
def cohesive_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connected papers grown from each branch's best by year and path score."""
    s, edges = scores(spark, sf_dir), clean_edges(spark, sf_dir).withColumnsRenamed({"src": "a", "dst": "b"})  # both ways and distinct only between candidates
    rows = roles.eligible(roles.smallest_communities(_communities(spark, sf_dir, "leiden")), s, roles.trunk(s), articles(spark, sf_dir))
    return community.cohesive(edges, rows.select(F.col("branch").alias("community"), "id", "year", "sap"))


@query()
def algorithm_overlap_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = lambda a: roles.smallest_communities(_communities(spark, sf_dir, a)).select("id", F.concat(F.lit("branch_"), F.col("branch").cast("string")).alias("label"))
    return community.compare(label("louvain"), label("leiden"))


SEGMENTS = NATIONS + """, sg AS (SELECT 'C' || c_custkey AS id, c_mktsegment AS segment FROM customer JOIN deg ON deg.id = 'C' || c_custkey),
sr AS (SELECT segment, row_number() OVER (ORDER BY count(*), min(id)) AS branch FROM sg GROUP BY segment), sl AS (SELECT sg.id, 'branch_' || branch AS label FROM sg JOIN sr USING (segment) WHERE branch <= 3)"""


@query(SEGMENTS + """, nl AS (SELECT id, 'branch_' || branch AS label FROM nb2)
SELECT coalesce(nl.id, sl.id) AS id, coalesce(nl.label, '') AS left_label, coalesce(sl.label, '') AS right_label, coalesce(nl.label, '') = coalesce(sl.label, '') AS same FROM nl FULL JOIN sl ON nl.id = sl.id""")
def given_overlap_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison of two labellings, of given ones: customers and orders by nation, customers by market segment."""
    nodes = named(clean_degrees(spark, sf_dir).select("id"), "id")
    segments = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("community")).join(nodes, "id", "left_semi")
    label = lambda df: roles.smallest_communities(df).select("id", F.concat(F.lit("branch_"), F.col("branch").cast("string")).alias("label"))
    return community.compare(label(_nations(spark, sf_dir)), label(segments))


@query()
def ntf_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the sources' aggregated texts."""
    docs = text.corpus(table(spark, sf_dir, "documents"), "doc_id", "text").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source"), "doc").select(F.col("source").alias("doc"), "tokens")
    return topics.topics(topics.tensor(text.term_counts(docs), docs), iterations=60)
