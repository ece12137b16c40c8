"""The graph, cleaning and text queries over the driver's tables, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import clean, community, experiments, graph, roles, similarity, text
from .sources.driver_tables import articles, clean_degrees, clean_edges, clean_numbers, event_hops, kept, name_of, named, node_range, part_papers, raw_edges, raw_numbers, stored_edges, table, years
from .storage import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return keep


# --- the shared views, in SQL --------------------------------------------------------------------

RAW = """WITH RECURSIVE raw AS MATERIALIZED (
  SELECT DISTINCT 'O' || l_orderkey AS src, 'P' || l_partkey AS dst FROM lineitem
  UNION SELECT DISTINCT 'P' || l_partkey, 'S' || l_suppkey FROM lineitem
  UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
  UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders)"""
#: Orders without lines are the terminal nodes cited once; customers who have no others are apart.
CLEAN = RAW + """, lined AS (SELECT DISTINCT 'O' || l_orderkey AS o FROM lineitem),
clean AS MATERIALIZED (SELECT * FROM raw WHERE src[1] <> 'C' OR dst IN (SELECT o FROM lined)),
ends AS (SELECT src AS id, 0 AS i, 1 AS o FROM clean UNION ALL SELECT dst, 1, 0 FROM clean),
deg AS MATERIALIZED (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM ends GROUP BY id)"""
ARTICLES = """, ny AS (SELECT o_custkey, max(year(o_orderdate)) AS y FROM orders GROUP BY 1),
art AS MATERIALIZED (
  SELECT 'C' || c_custkey AS id, c_name AS title, c_mktsegment AS abstract, c_mktsegment AS journal, NULL::VARCHAR AS source_title, y::INTEGER AS year, greatest(0, round_even(c_acctbal, 0)) AS cited_by
    FROM customer LEFT JOIN ny ON c_custkey = o_custkey
  UNION ALL SELECT 'O' || o_orderkey, o_orderpriority, o_orderstatus, NULL, NULL, year(o_orderdate)::INTEGER, round_even(o_totalprice, 0) FROM orders
  UNION ALL SELECT 'P' || p_partkey, p_name, p_type || ' ' || p_brand, p_brand, NULL, NULL, round_even(p_retailprice, 0) FROM part
  UNION ALL SELECT 'S' || s_suppkey, s_name, NULL, NULL, NULL, NULL, greatest(0, round_even(s_acctbal, 0)) FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, n_name, NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'R' || r_regionkey, r_name, NULL, NULL, NULL, NULL, NULL FROM region)"""
ROOTS = """, rt AS MATERIALIZED (SELECT id, in_degree AS root FROM deg WHERE out_degree = 0 AND in_degree > 0 ORDER BY in_degree DESC, id DESC LIMIT 20)"""
DOWN = ROOTS + """, fd(n, lvl, c, s) AS (SELECT id, 0, 1::HUGEINT, root::HUGEINT FROM rt
  UNION ALL SELECT e.src, fd.lvl + 1, sum(fd.c), sum(fd.s) FROM fd JOIN clean e ON e.dst = fd.n GROUP BY e.src, fd.lvl + 1),
down AS MATERIALIZED (SELECT n AS id, sum(c) AS root_connections, sum(s) AS raw_sap FROM fd GROUP BY n)"""
LEAVES = DOWN + ARTICLES + """, un AS (SELECT deg.id, coalesce(root_connections, 0) AS leaf, year FROM deg LEFT JOIN down ON down.id = deg.id LEFT JOIN art ON art.id = deg.id WHERE in_degree = 0),
dated AS (SELECT * FROM un WHERE leaf >= 3 AND year IS NOT NULL),
lf AS MATERIALIZED (SELECT id, leaf FROM dated WHERE year >= (SELECT max(year) FROM dated) - 7 ORDER BY leaf DESC, id DESC LIMIT 50)"""
SAP = LEAVES + """, fu(n, lvl, c, s) AS (SELECT id, 0, 1::HUGEINT, leaf::HUGEINT FROM lf
  UNION ALL SELECT e.dst, fu.lvl + 1, sum(fu.c), sum(fu.s) FROM fu JOIN clean e ON e.src = fu.n GROUP BY e.dst, fu.lvl + 1),
up AS MATERIALIZED (SELECT n AS id, sum(c) AS leaf_connections, sum(s) AS elaborate_sap FROM fu GROUP BY n),
sap AS MATERIALIZED (SELECT deg.id, coalesce(root, 0) AS root, coalesce(leaf, 0) AS leaf, coalesce(root_connections, 0) AS rc, coalesce(raw_sap, 0) AS rs, coalesce(leaf_connections, 0) AS lc, coalesce(elaborate_sap, 0) AS es
  FROM deg LEFT JOIN down ON down.id = deg.id LEFT JOIN up ON up.id = deg.id LEFT JOIN rt ON rt.id = deg.id LEFT JOIN lf ON lf.id = deg.id),
sc AS MATERIALIZED (SELECT *, lc * rs + rc * es AS sap FROM sap),
tr AS MATERIALIZED (SELECT id, sap AS trunk FROM sc WHERE root = 0 AND leaf = 0 AND sap > 0 ORDER BY sap DESC, id DESC LIMIT 20)"""
HOPS = """WITH RECURSIVE hops AS MATERIALIZED (SELECT * FROM (SELECT user_id || '@' || strftime(ts, '%Y%m%d%H') AS src,
  lead(user_id || '@' || strftime(ts, '%Y%m%d%H')) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"""
PAPERS = """, papers AS MATERIALIZED (SELECT 'P' || l_partkey AS doc, count(DISTINCT l_orderkey) AS citations FROM lineitem GROUP BY l_partkey ORDER BY citations DESC, doc DESC LIMIT 20)"""
STOP = "[" + ", ".join(f"'{w}'" for w in C.STOPWORDS) + "]"


def sql_tokens(text_sql: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text_sql}), '[a-z][a-z]+'), lambda w: len(w) > 2 AND NOT list_contains({STOP}, w))"


def mm(x: str, over: str = "") -> str:
    """Min-max scale in SQL, a constant becoming 1."""
    lo, hi = f"(min({x}) OVER ({over}))", f"(max({x}) OVER ({over}))"
    return f"(CASE WHEN abs({lo} - {hi}) <= 1e-9::DOUBLE * greatest(abs({lo}), abs({hi})) THEN 1.0::DOUBLE ELSE ({x} - {lo})::DOUBLE / ({hi} - {lo}) END)"


#: The text of a paper: title and abstract.
TEXTS = sql_tokens("coalesce(title, '') || ' ' || coalesce(abstract, '')")


def vectors_sql(docs: str, out: str, group: str = "") -> str:
    """CTEs that make TF-IDF vectors ``out`` (doc, term, w) of ``docs`` (doc, tokens), document frequencies within group if given."""
    g, on = (f"{group}, ", f"USING ({group}, ") if group else ("", "USING (")
    total = f"(SELECT {group}, count(DISTINCT doc) AS total FROM {docs} GROUP BY {group})" if group else f"(SELECT count(DISTINCT doc) AS total FROM {docs})"
    tied = f"JOIN {total} t USING ({group})" if group else f"CROSS JOIN {total} t"
    return f"""{out}_c AS MATERIALIZED (SELECT {g}doc, term, count(*) AS n FROM (SELECT {g}doc, unnest(tokens) AS term FROM {docs}) GROUP BY ALL),
{out}_l AS (SELECT {g}doc, sum(n) AS len FROM {out}_c GROUP BY ALL), {out}_f AS (SELECT {g}term, count(*) AS df FROM {out}_c GROUP BY ALL),
{out} AS MATERIALIZED (SELECT {g}doc, term, n::DOUBLE / len * (ln((1.0 + total)::DOUBLE / (1.0 + df)) + 1.0) AS w FROM {out}_c JOIN {out}_l {on}doc) JOIN {out}_f {on}term) {tied})"""


def cosine_sql(vectors: str, out: str) -> str:
    return f"""{out}_n AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM {vectors} GROUP BY doc),
{out} AS MATERIALIZED (SELECT x.doc AS a, y.doc AS b, sum(x.w * y.w) / (any_value(p.norm) * any_value(q.norm)) AS similarity FROM {vectors} x JOIN {vectors} y ON x.term = y.term AND x.doc < y.doc
  JOIN {out}_n p ON p.doc = x.doc JOIN {out}_n q ON q.doc = y.doc GROUP BY x.doc, y.doc)"""


# --- graph building and roles --------------------------------------------------------------------


@query(RAW + " SELECT src, dst FROM raw")
def edge_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_edges(spark, sf_dir)


@query(HOPS + " SELECT DISTINCT src, dst FROM hops WHERE src <> dst")
def self_loop_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.drop_self_loops(graph.build_edges(event_hops(spark, sf_dir), "src", "dst"))


@query(RAW + ", e AS (SELECT src AS id, 0 AS i, 1 AS o FROM raw UNION ALL SELECT dst, 1, 0 FROM raw) SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM e GROUP BY id")
def in_out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(raw_edges(spark, sf_dir))


@query(HOPS.replace("WITH RECURSIVE", "WITH") + """, n AS (SELECT src AS id FROM hops UNION SELECT dst FROM hops), c AS (SELECT split_part(id, '@', 2) AS h, count(*) AS k, min(id) AS low FROM n GROUP BY 1), g AS (SELECT h FROM c ORDER BY k DESC, low LIMIT 1)
SELECT DISTINCT src, dst FROM hops WHERE split_part(src, '@', 2) IN (SELECT h FROM g)""")
def wcc_giant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest of the components of the event graph, which has one for each hour."""
    return graph.giant_component(graph.build_edges(event_hops(spark, sf_dir), "src", "dst"))


@query(HOPS + ", n AS (SELECT src AS id FROM hops UNION SELECT dst FROM hops) SELECT id, min(id) OVER (PARTITION BY split_part(id, '@', 2)) AS component FROM n")
def wcc_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(graph.build_edges(event_hops(spark, sf_dir), "src", "dst"))


@query(RAW + ", d AS (SELECT dst AS id, count(*) AS n FROM raw GROUP BY 1) SELECT src, dst FROM raw WHERE dst NOT IN (SELECT id FROM d WHERE n = 1 AND id NOT IN (SELECT src FROM raw))")
def prune_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.prune_terminal(raw_edges(spark, sf_dir))


@query(HOPS + """, e AS MATERIALIZED (SELECT DISTINCT src, dst FROM hops WHERE src <> dst), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
SELECT src, dst FROM e WHERE (dst, src) NOT IN (SELECT (a, b) FROM r)""")
def scc_edge_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.break_cycles(graph.drop_self_loops(graph.build_edges(event_hops(spark, sf_dir), "src", "dst")))


@query(CLEAN + ROOTS + " SELECT id, root FROM rt")
def root_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(_roots(spark, sf_dir), "id")


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roots, on numbers; made once."""
    make = lambda: stored(roles.roots(clean_numbers(spark, sf_dir), degrees=clean_degrees(spark, sf_dir), name=name_of), "roots")
    return kept(spark, sf_dir, "roots", make)


def _down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths to the roots, on numbers; made once."""
    return kept(spark, sf_dir, "down", lambda: stored(roles.root_connections(clean_numbers(spark, sf_dir), _roots(spark, sf_dir)), "down"))


def _whole(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@query(CLEAN + DOWN + " SELECT id, root_connections::BIGINT AS root_connections, raw_sap::BIGINT AS raw_sap FROM down")
def path_count_to_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(named(_down(spark, sf_dir), "id"), "root_connections", "raw_sap")


def _leaf_numbers(spark: SparkSession, sf_dir: str, max_leaves: int = 50) -> DataFrame:
    """The leaves, on numbers; made once for each limit."""
    make = lambda: stored(roles.leaves(clean_numbers(spark, sf_dir), years(spark, sf_dir), _down(spark, sf_dir), max_leaves, degrees=clean_degrees(spark, sf_dir), name=name_of), "leaves")
    return kept(spark, sf_dir, f"leaves {max_leaves}", make)


def _leaves(spark: SparkSession, sf_dir: str, max_leaves: int = 50) -> DataFrame:
    return named(_leaf_numbers(spark, sf_dir, max_leaves), "id")


@query(CLEAN + LEAVES + " SELECT id, leaf::BIGINT AS leaf FROM lf")
def leaf_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(_leaves(spark, sf_dir), "leaf")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored graph; made once."""
    return named(_score_numbers(spark, sf_dir), "id")


def _score_numbers(spark: SparkSession, sf_dir: str, max_leaves: int = 50) -> DataFrame:
    """The scored graph on numbers; made once for each limit of leaves."""

    def make() -> DataFrame:
        edges, found = clean_numbers(spark, sf_dir), _leaf_numbers(spark, sf_dir, max_leaves)
        return stored(roles.sap_scores(edges, _roots(spark, sf_dir), found, _down(spark, sf_dir), clean_degrees(spark, sf_dir)), "scores")

    return kept(spark, sf_dir, f"scores {max_leaves}", make)


@query(CLEAN + SAP + " SELECT id, root::BIGINT AS root, leaf::BIGINT AS leaf, rc::BIGINT AS root_connections, rs::BIGINT AS raw_sap, lc::BIGINT AS leaf_connections, es::BIGINT AS elaborate_sap, sap::BIGINT AS sap FROM sc")
def sap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(scores(spark, sf_dir), "root", "leaf", "root_connections", "raw_sap", "leaf_connections", "elaborate_sap", "sap")


@query(CLEAN + SAP + " SELECT id, trunk::BIGINT AS trunk FROM tr")
def trunk_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(roles.trunk(scores(spark, sf_dir)), "trunk")


@query(CLEAN + SAP + """, lb AS (SELECT sc.id, CASE WHEN root > 0 THEN 'root' WHEN tr.id IS NOT NULL THEN 'trunk' WHEN leaf > 0 THEN 'leaf' ELSE 'unclassified' END AS role FROM sc LEFT JOIN tr ON tr.id = sc.id)
SELECT role, count(*) AS n FROM lb GROUP BY role""")
def role_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir)
    return roles.role_summary(roles.label(s, roles.trunk(s)))


@query(CLEAN + ARTICLES + " SELECT deg.id, coalesce(title, '') AS title, coalesce(abstract, '') AS abstract, coalesce(journal, '') AS journal, year, art.id IS NOT NULL AS has_article_metadata FROM deg LEFT JOIN art ON art.id = deg.id")
def enrich_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = roles.enrich(named(clean_degrees(spark, sf_dir).select("id"), "id"), articles(spark, sf_dir))
    return out.select("id", "title", "abstract", "journal", "year", "has_article_metadata")


@query(CLEAN + " SELECT id, out_degree FROM deg WHERE in_degree = 0 AND out_degree >= 1")
def leaf_like_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(clean_degrees(spark, sf_dir).filter("in_degree = 0 AND out_degree >= 1").select("id", "out_degree"), "id")


@query(CLEAN + SAP + """, taken AS (SELECT id FROM sc WHERE root > 0 UNION SELECT id FROM tr UNION SELECT id FROM lf),
nw AS (SELECT max(year) AS y FROM art JOIN deg USING (id)),
fr AS (SELECT deg.id, year, out_degree, coalesce(cited_by, 0) AS cited_by FROM deg JOIN art USING (id) CROSS JOIN nw WHERE in_degree = 0 AND out_degree >= 1 AND year >= nw.y - 4 AND id NOT IN (SELECT id FROM taken)
  ORDER BY year DESC, out_degree DESC, cited_by DESC, (length(coalesce(title, '')) + length(coalesce(abstract, '')) > 0) DESC, id LIMIT 50)
SELECT id, 'sap_leaf' AS leaf_type, row_number() OVER (ORDER BY leaf DESC, id DESC)::INTEGER AS leaf_rank FROM lf
UNION ALL SELECT id, 'frontier_leaf', (row_number() OVER (ORDER BY year DESC, out_degree DESC, cited_by DESC, id) + (SELECT count(*) FROM lf))::INTEGER FROM fr""")
def frontier_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir)
    taken = s.filter("root > 0").select("id").unionByName(roles.trunk(s).select("id"))
    out = roles.fill_leaves(s.filter("leaf > 0").select("id", "leaf"), clean_edges(spark, sf_dir), articles(spark, sf_dir), taken, degrees=named(clean_degrees(spark, sf_dir), "id"))
    return out.withColumn("leaf_rank", F.col("leaf_rank").cast("int"))


@query(CLEAN + LEAVES + """, wide AS (SELECT id, leaf, row_number() OVER (ORDER BY leaf DESC, id DESC) AS r FROM dated WHERE year >= (SELECT max(year) FROM dated) - 7),
l AS (SELECT 100 AS max_leaves, w.id, year, r FROM wide w JOIN art USING (id) WHERE r <= 100 UNION ALL SELECT 50, w.id, year, r FROM wide w JOIN art USING (id) WHERE r <= 50)
SELECT max_leaves::INTEGER AS max_leaves, count(*) AS n, avg(year)::DOUBLE AS mean_year, median(year)::DOUBLE AS median_year, max(year)::INTEGER AS newest, count(*) FILTER (WHERE r > 50) AS added FROM l GROUP BY max_leaves""")
def leaf_count_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _leaves(spark, sf_dir, 50).select("id").withColumn("base", F.lit(True))
    rows = _leaves(spark, sf_dir, 50).withColumn("max_leaves", F.lit(50)).unionByName(_leaves(spark, sf_dir, 100).withColumn("max_leaves", F.lit(100)))
    rows = rows.join(base, "id", "left").join(articles(spark, sf_dir).select("id", "year"), "id")
    return rows.groupBy("max_leaves").agg(F.count(F.lit(1)).alias("n"), F.avg("year").alias("mean_year"), F.median("year").alias("median_year"), F.max("year").alias("newest"), F.count_if(F.col("base").isNull()).alias("added"))


@query(CLEAN + LEAVES + """, wide AS (SELECT id, leaf::DOUBLE AS leaf, year, row_number() OVER (ORDER BY leaf DESC, id DESC) AS r FROM dated WHERE year >= (SELECT max(year) FROM dated) - 7),
runs AS (SELECT 'top_50' AS run, * FROM wide WHERE r <= 50 UNION ALL SELECT 'top_100', * FROM wide WHERE r <= 100 UNION ALL SELECT 'added_51_100', * FROM wide WHERE r BETWEEN 51 AND 100)
SELECT run, count(*) AS leaf_count, count(art.id) AS metadata_count, round(count(art.id) / count(*), 4) AS metadata_share, min(runs.year)::INTEGER AS min_year, max(runs.year)::INTEGER AS max_year,
  min(leaf) AS min_leaf_connections, max(leaf) AS max_leaf_connections, median(runs.year)::DOUBLE AS median_year, median(leaf)::DOUBLE AS median_leaf_connections FROM runs LEFT JOIN art USING (id) GROUP BY run""")
def leaf_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.leaf_count_summary(experiments.leaf_counts(clean_edges(spark, sf_dir), articles(spark, sf_dir), run=lambda n: named(_score_numbers(spark, sf_dir, n), "id")))


@query(CLEAN + SAP + """, taken AS (SELECT id FROM sc WHERE root > 0 UNION SELECT id FROM tr UNION SELECT id FROM lf),
fr AS (SELECT deg.id, year, out_degree, row_number() OVER (ORDER BY year DESC, out_degree DESC, coalesce(cited_by, 0) DESC, (length(coalesce(title, '')) + length(coalesce(abstract, '')) > 0) DESC, id) AS r
  FROM deg JOIN art USING (id) WHERE in_degree = 0 AND out_degree >= 1 AND year >= (SELECT max(year) FROM art JOIN deg USING (id)) - 4 AND id NOT IN (SELECT id FROM taken)),
n AS (SELECT count(*) AS n FROM lf), b AS (SELECT fr.* FROM fr, n WHERE r <= 100 - n)
SELECT (SELECT n FROM n) AS sap_leaf_count, (SELECT count(*) FROM b) AS selected_frontier_leaf_count, (SELECT n FROM n) + (SELECT count(*) FROM b) AS combined_leaf_count, (SELECT min(year) FROM b)::INTEGER AS min_year,
  (SELECT max(year) FROM b)::INTEGER AS max_year, (SELECT min(out_degree) FROM b) AS min_out_degree, (SELECT max(out_degree) FROM b) AS max_out_degree, (SELECT count(*) FROM fr) AS frontier_candidate_count, 100 AS target_leaves, 5 AS recent_years""")
def frontier_leaf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir)
    taken = s.filter("root > 0").select("id").unionByName(roles.trunk(s).select("id"))
    return experiments.frontier_summary(*experiments.frontier_leaves(s, clean_edges(spark, sf_dir), articles(spark, sf_dir), taken, degrees=named(clean_degrees(spark, sf_dir), "id")))


# --- traversal -----------------------------------------------------------------------------------


@query(CLEAN + ROOTS + ", r(seed, id, d) AS (SELECT id, id, 0 FROM rt UNION SELECT r.seed, e.src, r.d + 1 FROM r JOIN clean e ON e.dst = r.id) SELECT seed, id, min(d)::INTEGER AS distance FROM r GROUP BY seed, id")
def ancestors_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(graph.reach(clean_numbers(spark, sf_dir), _roots(spark, sf_dir)), "seed", "id")


@query(CLEAN + """, und AS (SELECT src AS a, dst AS b FROM clean UNION SELECT dst, src FROM clean), r(id, d) AS (SELECT id, 0 FROM deg WHERE id[1] IN ('N', 'R') UNION SELECT u.b, r.d + 1 FROM r JOIN und u ON u.a = r.id WHERE r.d < 3)
SELECT id, min(d)::INTEGER AS distance FROM r GROUP BY id""")
def multi_source_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = clean_degrees(spark, sf_dir).select("id").filter(F.substring(name_of("id"), 1, 1).isin("N", "R"))
    return named(graph.field_distance(clean_numbers(spark, sf_dir), field, 3), "id")


@query(CLEAN + LEAVES + PAPERS + """, par AS (SELECT doc, p_brand AS parent FROM papers JOIN part ON doc = 'P' || p_partkey),
r(seed, id, d) AS (SELECT id, id, 0 FROM lf UNION SELECT r.seed, e.dst, r.d + 1 FROM r JOIN clean e ON e.src = r.id WHERE r.d < 3),
m AS (SELECT seed AS id, parent, min(d) AS distance FROM r JOIN par ON par.doc = r.id GROUP BY seed, parent)
SELECT id, parent, distance::INTEGER AS distance, CASE WHEN distance = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / distance END AS proximity FROM m""")
def bounded_path_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import scores as S

    near = named(graph.reach(clean_numbers(spark, sf_dir), _leaf_numbers(spark, sf_dir), max_depth=3, backward=False), "seed", "id")
    parents = part_papers(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("doc"), F.col("p_brand").alias("parent")), "doc")
    return S.path_proximity(near.join(parents.select(F.col("doc").alias("id"), "parent"), "id").select(F.col("seed").alias("id"), "parent", "distance"))


@query(RAW + """, p AS (SELECT s_suppkey, n_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m AS MATERIALIZED (SELECT 'R' || n_regionkey AS grp, 'N' || n_nationkey AS id FROM nation UNION SELECT 'R' || n_regionkey, 'S' || s_suppkey FROM p UNION SELECT 'R' || r_regionkey, 'R' || r_regionkey FROM region),
e AS (SELECT DISTINCT x.grp, least(src, dst) AS a, greatest(src, dst) AS b FROM raw JOIN m x ON x.id = src JOIN m y ON y.id = dst AND y.grp = x.grp WHERE src <> dst),
c AS (SELECT grp, count(*) AS n FROM m GROUP BY grp), k AS (SELECT grp, count(*) AS n_e FROM e GROUP BY grp)
SELECT grp, n AS n_nodes, coalesce(n_e, 0) AS internal_edges, round(CASE WHEN n > 1 THEN 2.0::DOUBLE * coalesce(n_e, 0) / (n * (n - 1)) ELSE 0 END, 6) AS density, 1::BIGINT AS n_components, 1.0::DOUBLE AS largest_fraction FROM c LEFT JOIN k USING (grp)""")
def subgraph_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of each region's nodes (nations, suppliers, itself) as a part of the whole graph."""
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("grp"), "n_nationkey")
    suppliers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("grp", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"))
    own = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("grp"))
    members = suppliers.unionByName(nations.select("grp", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"))).unionByName(own.select("grp", F.col("grp").alias("id")))
    out = graph.subgraph_quality(stored_edges(spark, sf_dir), members.distinct())
    return out.select("grp", "n_nodes", F.col("internal_edges").cast("long").alias("internal_edges"), "density", "n_components", "largest_fraction")


#: Customers, orders, parts and suppliers stay linked; regions and suppliers without a line come loose.
@query(RAW + """, lone AS (SELECT (SELECT count(DISTINCT n_regionkey) FROM nation) + (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)) AS n)
SELECT n::BIGINT AS component_delta, n::BIGINT AS giant_loss FROM lone""")
def removal_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the whole graph loses with its nations."""
    edges = stored(raw_numbers(spark, sf_dir), "raw")
    nations = [F.col(c).between(*node_range("N")) for c in ("src", "dst")]
    return graph.removal_impact(edges, graph.vertices(edges.filter(nations[0] | nations[1])).filter(F.col("id").between(*node_range("N"))))


# --- cleaning ------------------------------------------------------------------------------------

_FIX = {"O1": "O2", "P7": "P9", "C3": "C4"}


@query(RAW + """, f AS (SELECT CASE src WHEN 'O1' THEN 'O2' WHEN 'P7' THEN 'P9' WHEN 'C3' THEN 'C4' ELSE src END AS SR, CASE dst WHEN 'O1' THEN 'O2' WHEN 'P7' THEN 'P9' WHEN 'C3' THEN 'C4' ELSE dst END AS SR_ref FROM raw)
SELECT DISTINCT SR, SR_ref FROM f""")
def id_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_edges(spark, sf_dir)
    padded = e.select(F.concat(F.lit(" \t"), "src").alias("SR"), F.concat("dst", F.lit("\n ")).alias("SR_ref"))
    return clean.correct_citations(padded.unionByName(e.select(F.lit("ANONYMOUS, 1999").alias("SR"), F.col("dst").alias("SR_ref"))), _FIX)


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Article rows with duplicates, and the mapping of their keys: odd customers' rows belong to the even one before."""
    key = F.col("c_custkey")
    name = lambda k: F.concat(F.lit("A"), k.cast("string"))
    rows = table(spark, sf_dir, "customer").select(
        name(key).alias("SR"), F.when(key % 4 != 0, F.col("c_name")).alias("title"), F.when(key % 3 == 0, F.lit(" ")).otherwise(F.col("c_mktsegment")).alias("journal"),
        F.concat(F.lit("10.1/"), (key % 7).cast("string"), F.lit("; 10.2/"), (key % 5).cast("string")).alias("doi"), key.alias("_row"),
    )
    return rows, rows.filter("_row % 2 = 1").select("SR", name((F.floor(F.col("_row") / 2) * 2).cast("long")).alias("canonical"))


RECORDS = """rec AS MATERIALIZED (SELECT 'A' || c_custkey AS SR, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS title, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END AS journal,
  '10.1/' || c_custkey % 7 || '; 10.2/' || c_custkey % 5 AS doi, c_custkey AS r, 'A' || (c_custkey // 2 * 2) AS canon FROM customer),
b AS (SELECT *, CASE WHEN SR = canon THEN 0 ELSE 1 END AS k FROM rec)"""


@query("WITH " + RECORDS + """ SELECT canon AS SR, arg_min(title, (k, r)) FILTER (WHERE trim(coalesce(title, '')) <> '') AS title, arg_min(journal, (k, r)) FILTER (WHERE trim(coalesce(journal, '')) <> '') AS journal FROM b GROUP BY canon""")
def record_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coalesced(spark, sf_dir).select("SR", "title", "journal")


def _coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, mapping = _records(spark, sf_dir)
    return clean.coalesce_records(rows, "SR", "_row", mapping, merged_lists={"doi": None})


@query("WITH " + RECORDS + """, u AS (SELECT canon, k, r, d.i, trim(d.v) AS v FROM b, unnest(list_zip(range(1, len(string_split(doi, ';')) + 1), string_split(doi, ';'))) AS t(d0), LATERAL (SELECT d0[1] AS i, d0[2] AS v) d),
f AS (SELECT canon, v, min((k, r, i)) AS p FROM u GROUP BY canon, v) SELECT canon AS SR, string_agg(v, ';' ORDER BY p) AS doi FROM f GROUP BY canon""")
def doi_ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coalesced(spark, sf_dir).select("SR", "doi")


@query("WITH " + RECORDS + """, kept AS (SELECT * FROM b WHERE doi <> '10.1/3; 10.2/3'), t AS (SELECT canon AS SR, arg_min(title, (k, r)) FILTER (WHERE trim(coalesce(title, '')) <> '') AS title, arg_min(journal, (k, r)) FILTER (WHERE trim(coalesce(journal, '')) <> '') AS journal FROM kept GROUP BY canon)
SELECT SR, CASE WHEN SR = 'A2' THEN 'By hand' ELSE title END AS title, journal FROM t UNION ALL SELECT 'Z1', 'Added', NULL""")
def article_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical ids, a dropped DOI, coalesced records, overrides."""
    rows, mapping = _records(spark, sf_dir)
    by_hand = spark.createDataFrame([("A2", "By hand"), ("Z1", "Added")], "SR string, title string")
    return clean.tidy_articles(rows, "_row", mapping, dropped_dois=("10.1/3; 10.2/3",), overrides=by_hand).select("SR", "title", "journal")


@query("""WITH o AS (SELECT 's' || s_suppkey % 10 || 'x' || s_suppkey AS k, s_name FROM supplier), n AS (SELECT 'X' || s_suppkey AS k, upper(s_name) AS nm FROM supplier WHERE s_acctbal < 0)
SELECT 'X' || s_suppkey AS k, CASE WHEN s_acctbal < 0 THEN upper(s_name) ELSE s_name END AS name, s_nationkey AS nation FROM supplier
UNION ALL SELECT 'Y' || n_nationkey, n_name, NULL FROM nation""")
def manual_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key = F.concat(F.lit("X"), F.col("s_suppkey").cast("string")).alias("k")
    rows = s.select(key, F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    changes = s.filter("s_acctbal < 0").select(key, F.upper("s_name").alias("name"))
    added = table(spark, sf_dir, "nation").select(F.concat(F.lit("Y"), F.col("n_nationkey").cast("string")).alias("k"), F.col("n_name").alias("name"))
    return clean.override(rows, changes.unionByName(added), "k")


@query("SELECT o_custkey AS custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS orderkey, max(o_totalprice) AS price FROM orders GROUP BY o_custkey")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))
    return clean.keep_first(rows, "custkey", F.col("price").desc(), F.col("orderkey"))


@query("SELECT o_orderkey AS orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
def main_article_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.when(F.col("o_orderstatus") == "F", " TRUE ").otherwise("no").alias("ismainarticle"), (F.col("o_orderpriority") == "1-URGENT").alias("ismain_wos"))
    return clean.main_articles(rows).select("orderkey")


# --- text ----------------------------------------------------------------------------------------


def _source_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, as (grp, doc, tokens) with its source as group."""
    return text.corpus(table(spark, sf_dir, "documents"), "doc_id", "text").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("grp")), "doc")


DOCS = f"WITH RECURSIVE dt AS MATERIALIZED (SELECT source AS grp, doc_id AS doc, {sql_tokens("coalesce(text, '')")} AS tokens FROM documents)"


@query(DOCS + ", t AS (SELECT doc, unnest(tokens) AS term FROM dt) SELECT doc, term, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc)::BIGINT AS length FROM t GROUP BY doc, term")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.term_counts(text.corpus(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query(DOCS + ", " + vectors_sql("dt", "v") + " SELECT doc, term, round(w, 9) AS w FROM v")
def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tfidf(text.corpus(table(spark, sf_dir, "documents"), "doc_id", "text")).withColumn("w", F.round("w", 9))


#: One aggregated text per source: the whole documents table as a few parent documents.
PARENTS = DOCS + ", ps AS (SELECT grp AS doc, flatten(list(tokens)) AS tokens FROM dt GROUP BY grp), " + vectors_sql("ps", "v")


def _parents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _source_corpus(spark, sf_dir).select(F.col("grp").alias("doc"), "tokens")
    return docs.select("doc").distinct(), text.tfidf(docs)


@query(PARENTS + ", " + cosine_sql("v", "c") + " SELECT a, b, round(similarity, 6) AS similarity FROM c")
def tfidf_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, vectors = _parents(spark, sf_dir)
    return text.cosine_pairs(stored(vectors, "vectors"), ids).withColumn("similarity", F.round("similarity", 6))


@query(DOCS + ", " + vectors_sql("dt", "v") + """, vg AS (SELECT grp, v.* FROM v JOIN (SELECT DISTINCT doc, grp FROM dt) USING (doc)), n AS (SELECT grp, count(DISTINCT doc) AS n FROM vg GROUP BY grp),
ce AS MATERIALIZED (SELECT grp, term, sum(w) / any_value(n) AS cw FROM vg JOIN n USING (grp) GROUP BY grp, term), cn AS (SELECT grp, sqrt(sum(cw * cw)) AS size FROM ce GROUP BY grp),
s AS (SELECT doc, vg.grp, sum(w * cw) / (sqrt(sum(w * w)) * any_value(size)) AS similarity FROM vg JOIN ce USING (grp, term) JOIN cn USING (grp) GROUP BY doc, vg.grp)
SELECT dt.doc, dt.grp, round(coalesce(similarity, 0), 6) AS similarity FROM dt LEFT JOIN s ON s.doc = dt.doc AND s.grp = dt.grp""")
def branch_centroid_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(_source_corpus(spark, sf_dir), "corpus")
    vectors = stored(text.tfidf(docs.select("doc", "tokens")), "vectors")
    return text.centroid_similarity(vectors, docs.select("doc", "grp")).withColumn("similarity", F.round("similarity", 6))


@query(DOCS + ", " + vectors_sql("dt", "v", "grp") + """, n AS (SELECT grp, doc, sqrt(sum(w * w)) AS norm FROM v GROUP BY grp, doc), u AS (SELECT grp, doc, term, w / norm AS u FROM v JOIN n USING (grp, doc)),
s AS (SELECT grp, term, sum(u) AS s, sum(u * u) AS q FROM u GROUP BY grp, term), t AS (SELECT grp, (sum(s * s) - sum(q)) / 2 AS total FROM s GROUP BY grp), k AS (SELECT grp, count(DISTINCT doc) AS n FROM dt GROUP BY grp)
SELECT grp, n, round(CASE WHEN n > 1 THEN coalesce(total, 0) / (n * (n - 1) / 2) ELSE 0 END, 6) AS mean_similarity FROM k LEFT JOIN t USING (grp)""")
def mean_pairwise_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(_source_corpus(spark, sf_dir), "corpus")
    return text.mean_pairwise(stored(text.tfidf_by_group(docs), "vectors"), docs.select("doc", "grp")).withColumn("mean_similarity", F.round("mean_similarity", 6))


@query(DOCS + """, c AS (SELECT grp, term, count(*) AS n FROM (SELECT grp, unnest(tokens) AS term FROM dt) GROUP BY grp, term), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, term) AS r FROM c)
SELECT grp, string_agg(term, '; ' ORDER BY r) AS top_terms FROM r WHERE r <= 12 GROUP BY grp""")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _source_corpus(spark, sf_dir).select("grp", F.explode("tokens").alias("term")).groupBy("grp", "term").agg(F.count(F.lit(1)).alias("n"))
    return text.top_terms(counts, 12, "n")


@query("WITH RECURSIVE z AS (SELECT 1)" + PAPERS + f""", pt AS (SELECT 'P' || p_partkey AS doc, p_name AS title, p_type || ' ' || p_brand AS abstract FROM part), dt AS (SELECT doc, {TEXTS} AS tokens FROM pt), """ + vectors_sql("dt", "v") + """,
n AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM v GROUP BY doc), u AS MATERIALIZED (SELECT doc, term, w / norm AS u FROM v JOIN n USING (doc)),
s AS (SELECT x.doc, y.doc AS anchor, sum(x.u * y.u) AS s FROM u x JOIN u y USING (term) WHERE y.doc IN (SELECT doc FROM papers) GROUP BY x.doc, y.doc)
SELECT dt.doc, round(coalesce(max(s), 0), 6) AS similarity FROM dt LEFT JOIN s USING (doc) GROUP BY dt.doc""")
def max_anchor_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = articles(spark, sf_dir).filter(F.substring("id", 1, 1) == "P")
    docs = text.corpus(parts, "id", "title", "abstract")
    return text.best_anchor(stored(text.tfidf(docs), "vectors"), docs, part_papers(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


# --- similarity of papers ------------------------------------------------------------------------

CITERS = "WITH RECURSIVE z AS (SELECT 1)" + PAPERS + ", st AS MATERIALIZED (SELECT DISTINCT 'P' || l_partkey AS doc, 'O' || l_orderkey AS member FROM lineitem WHERE 'P' || l_partkey IN (SELECT doc FROM papers))"
REFS = "WITH RECURSIVE z AS (SELECT 1)" + PAPERS + ", st AS MATERIALIZED (SELECT DISTINCT 'P' || l_partkey AS doc, 'S' || l_suppkey AS member FROM lineitem WHERE 'P' || l_partkey IN (SELECT doc FROM papers))"


def overlap_sql(name: str = "ov", papers: str = "papers", sets: str = "st") -> str:
    return f"""{name}_s AS (SELECT p.doc, count(member) AS n FROM {papers} p LEFT JOIN {sets} USING (doc) GROUP BY p.doc),
{name} AS MATERIALIZED (SELECT x.doc AS a, y.doc AS b, (SELECT count(*) FROM {sets} s JOIN {sets} t USING (member) WHERE s.doc = x.doc AND t.doc = y.doc) AS shared, x.n AS size_a, y.n AS size_b FROM {name}_s x JOIN {name}_s y ON x.doc < y.doc)"""


OVERLAP = "SELECT a, b, shared, size_a, size_b, round(coalesce(shared / nullif(sqrt(size_a::DOUBLE * size_b), 0), 0), 6) AS cosine, round(coalesce(shared::DOUBLE / nullif(size_a + size_b - shared, 0), 0), 6) AS jaccard FROM ov"


def _paper_sets(spark: SparkSession, sf_dir: str, cited: bool) -> tuple[DataFrame, DataFrame]:
    papers = part_papers(spark, sf_dir)
    return papers, similarity.member_sets(stored_edges(spark, sf_dir), papers, cited)


@query(CITERS + ", " + overlap_sql() + " " + OVERLAP)
def cocitation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers, sets = _paper_sets(spark, sf_dir, True)
    return similarity.overlap_pairs(stored(sets, "sets"), papers)


@query(REFS + ", " + overlap_sql() + " " + OVERLAP)
def reference_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers, sets = _paper_sets(spark, sf_dir, False)
    return similarity.overlap_pairs(stored(sets, "sets"), papers)


@query(CLEAN + ROOTS + ", r(doc, member) AS (SELECT e.dst, e.src FROM clean e JOIN rt ON rt.id = e.dst UNION SELECT r.doc, e.src FROM r JOIN clean e ON e.dst = r.member), st AS MATERIALIZED (SELECT * FROM r), papers AS (SELECT id AS doc FROM rt), " + overlap_sql() + " " + OVERLAP)
def structural_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _roots(spark, sf_dir)
    sets = named(graph.reach(clean_numbers(spark, sf_dir), found).filter("distance > 0"), "seed").select(F.col("seed").alias("doc"), F.col("id").alias("member"))
    return similarity.overlap_pairs(sets, named(found, "id").select(F.col("id").alias("doc")))


COMBINED = CITERS + ", " + overlap_sql() + f""", rs AS MATERIALIZED (SELECT DISTINCT 'P' || l_partkey AS doc, 'S' || l_suppkey AS member FROM lineitem WHERE 'P' || l_partkey IN (SELECT doc FROM papers)), {overlap_sql("orf", sets="rs")},
pt AS (SELECT 'P' || p_partkey AS doc, p_name AS title, p_type || ' ' || p_brand AS abstract FROM part WHERE 'P' || p_partkey IN (SELECT doc FROM papers)), dt AS (SELECT doc, {TEXTS} AS tokens FROM pt), """ + vectors_sql("dt", "v") + ", " + cosine_sql("v", "c") + """,
cb AS MATERIALIZED (SELECT ov.a, ov.b, round(coalesce(similarity, 0), 6) AS text, round(coalesce(ov.shared / nullif(sqrt(ov.size_a::DOUBLE * ov.size_b), 0), 0), 6) AS cocitation, round(coalesce(orf.shared / nullif(sqrt(orf.size_a::DOUBLE * orf.size_b), 0), 0), 6) AS structural
  FROM ov JOIN orf USING (a, b) LEFT JOIN c USING (a, b)), co AS MATERIALIZED (SELECT *, round(0.45::DOUBLE * text + 0.35::DOUBLE * cocitation + 0.2::DOUBLE * structural, 4) AS combined FROM cb)"""


def combined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Papers, their TF-IDF vectors, and all pairs' text, co-citation and reference similarity with the weighted sum."""
    return kept(spark, sf_dir, "combined", lambda: _combined(spark, sf_dir))


def _combined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    papers, citers = _paper_sets(spark, sf_dir, True)
    refs = similarity.member_sets(stored_edges(spark, sf_dir), papers, False)
    docs = text.corpus(articles(spark, sf_dir).join(papers.select(F.col("doc").alias("id")), "id"), "id", "title", "abstract")
    vectors = stored(text.tfidf(docs), "vectors")
    parts = {
        "text": text.cosine_pairs(vectors).withColumn("similarity", F.round("similarity", 6)),
        "cocitation": similarity.overlap_pairs(stored(citers, "sets"), papers).select("a", "b", "cosine"),
        "structural": similarity.overlap_pairs(stored(refs, "sets"), papers).select("a", "b", "cosine"),
    }
    return papers, vectors, stored(similarity.combine(papers, parts, {"text": 0.45, "cocitation": 0.35, "structural": 0.20}, 4), "combined")


@query(COMBINED + " SELECT a, b, text, cocitation, structural, combined FROM co")
def combined_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combined(spark, sf_dir)[2]


@query("""
WITH n AS (SELECT DISTINCT n_regionkey AS r, s_nationkey AS m FROM supplier JOIN nation ON s_nationkey = n_nationkey), x AS (SELECT r_regionkey AS r FROM region),
pr AS (SELECT DISTINCT n_regionkey AS r, l_partkey AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
sz AS (SELECT r, count(*) AS n FROM pr GROUP BY r), sh AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM pr a JOIN pr b USING (m) GROUP BY ALL),
m AS (SELECT sh.a, sh.b, CASE WHEN sh.a = sh.b THEN 1.0::DOUBLE ELSE round(c::DOUBLE / (p.n + q.n - c), 6) END AS v FROM sh JOIN sz p ON p.r = a JOIN sz q ON q.r = b)
SELECT 'R' || a AS id, max(v) FILTER (WHERE b = 0) AS "R0", max(v) FILTER (WHERE b = 1) AS "R1", max(v) FILTER (WHERE b = 2) AS "R2", max(v) FILTER (WHERE b = 3) AS "R3", max(v) FILTER (WHERE b = 4) AS "R4" FROM m GROUP BY a""")
def similarity_matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    region_of = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("doc"))
    sets = table(spark, sf_dir, "lineitem").join(region_of, F.col("l_suppkey") == F.col("s_suppkey")).select("doc", F.col("l_partkey").alias("member")).distinct()
    papers = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("doc"))
    return similarity.matrix(similarity.overlap_pairs(stored(sets, "sets"), papers), "jaccard", ["R0", "R1", "R2", "R3", "R4"])


def _topic_communities(spark: SparkSession, sf_dir: str, threshold: float = 0.30) -> tuple[DataFrame, DataFrame, DataFrame]:
    papers, vectors, pairs = combined(spark, sf_dir)
    found = community.greedy_modularity(similarity.strong(pairs, "combined", threshold), papers.select(F.col("doc").alias("id")))
    return papers, vectors, found.select(F.col("id").alias("doc"), F.col("community").alias("cluster"))


@query()
def cnm_subtopics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the papers' similarity graph, larger first, with their top terms."""
    papers, vectors, clusters = _topic_communities(spark, sf_dir)
    clusters = stored(clusters, "clusters")
    heaviest = papers.join(clusters, "doc").groupBy("cluster").agg(F.count(F.lit(1)).alias("member_count"), F.max("citations").alias("most"), F.max_by("doc", F.struct("citations", "doc")).alias("representative"))
    ranked = heaviest.withColumn("subtopic", F.concat(F.lit("subtopic_"), F.row_number().over(W.orderBy(F.col("member_count").desc(), F.col("most").desc(), "cluster")).cast("string")))
    terms = text.top_terms(vectors.join(clusters, "doc").groupBy(F.col("cluster").alias("grp"), "term").agg(F.sum("w").alias("w")), 5)
    return ranked.join(terms.withColumnRenamed("grp", "cluster"), "cluster", "left").select("subtopic", "member_count", "representative", F.coalesce("top_terms", F.lit("")).alias("label"))


from . import queries_scores  # noqa: E402, F401  registers the rest
