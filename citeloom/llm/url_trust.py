"""URL filters: listed rules, and link-graph trust and distrust for every host they don't cover.

By DataFrame operations alone. A rule is (verdict, host, path): it fits its host and every
subdomain where the url's path starts with the rule's path; of the rules that fit, the one with
the longest host and path together wins, of equally long ones the first of the list. A rule's path
begins with "/", so it fits no url whose path is empty. A short list is one CASE expression. A list
of more than MAX_INLINE_RULES rules, or one given as a DataFrame, is joined: every distinct (host,
path) is spread over its host's suffixes and its path's prefixes of the lengths that rules have, and
each of those meets its rule by equality, however many rules a host has.

Hosts without a rule's verdict get the method's. Host edges are the distinct pairs of different
hosts in href and src attributes. A host is a trusted seed if rules allow some of its pages and
block none, a blocked seed in the opposite case. Trust is personalised PageRank from the trusted
seeds along the edges, distrust the same from the blocked seeds along the reversed edges (who
links to bad hosts is bad). A host is blocked if its distrust exceeds its trust; every other host
is allowed.

Ranks are whole numbers, each step's shares rounded down, so they don't depend on
the order of summation, and reruns and other engines agree. Every seed, trusted or blocked, starts with UNIT,
however many there are: a link from a seed is worth the same in a small and in a large web, and a
verdict depends on the seeds around the host alone, not on how many the other side has. A host takes the
whole of 9 * 10^8 seeds before its rank passes 64 bits, which raises an error. Iteration stops when no rank changes,
which it must come to: ranks never fall from one round to the next, and together never exceed what the seeds start with.
The SQL goes through SQL_ROUNDS rounds, by when 0.85^n of UNIT has long been less than 1. Skew: pages are reduced to distinct edges and per-host counts before any
exchange can gather a host's pages; joins on host are plain equi-joins, which AQE splits.

Null urls and urls without "://" have an empty host and path, fit no rule and are allowed. Null
html has no links. Repeated pages count once as an edge. Null page_ids and repeated rows are judged
like any other row; other columns, whatever their names, are left out. A rule with a null host, path
or verdict fits nothing. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialize, pick

# Fixed values of the standard list: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UNIT = 10**10
SQL_ROUNDS = 300
DAMPING = 85  # percent of a rank that follows the links
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
MAX_INLINE_RULES = 200


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, null if none does. Rules are a short list: one CASE."""
    text = verdict = None
    for kind, of, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(prefix)
        text = (F if text is None else text).when(fits, F.lit(of + prefix))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(kind))
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def join_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (host, path, ...) with rule and listed (its verdict). rules: verdict, host, path, place (their order), any number of them."""
    rules = rules.filter("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL")
    rules = rules.groupBy(F.col("host").alias("of"), F.col("path").alias("prefix")).agg(F.min("place").alias("place"), F.min_by("verdict", "place").alias("kind"))
    rules = materialize(rules, "rules")
    lengths = rules.agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("lengths"))  # one row, of the lengths that paths have
    both = materialize(pages.select("host", "path").distinct(), "paths")
    parts = F.split("host", r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    tried = both.select("host", "path", F.explode(every).alias("of")).join(rules.select("of").distinct(), "of", "left_semi")
    tried = tried.crossJoin(F.broadcast(lengths)).select("host", "path", "of", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    hits = tried.withColumn("prefix", F.expr("left(path, n)")).join(rules, ["of", "prefix"])
    longest = F.struct((F.length("of") + F.length("prefix")).alias("size"), (-F.col("place")).alias("place"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("of", "prefix").alias("rule"), F.col("kind").alias("listed")), longest).alias("best"))
    return pages.join(best, ["host", "path"], "left").withColumns({"rule": F.col("best.rule"), "listed": F.col("best.listed")}).drop("best")


def links(pages: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) between different hosts. pages: host, html."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("url"))
    dst = F.when(F.col("url").startswith("//"), F.concat(F.lit("x:"), "url")).otherwise(F.col("url"))
    return found.select("src", host_of(dst).alias("dst")).filter("src <> dst AND src <> '' AND dst <> ''").distinct()


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Personalised PageRank in whole numbers, until no rank changes: (host, rank). edges: src, dst. seeds: host."""
    own = materialize(seeds.select("host", F.lit(UNIT * (100 - DAMPING) // 100).cast("long").alias("own")), "seeds")
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    ranks = own.select("host", F.col("own").alias("rank"))
    if edges.isEmpty() or own.isEmpty():
        return ranks
    edges = materialize(edges.join(degree, "src"), "edges")
    last = None
    while True:
        share = F.expr(f"(rank * {DAMPING}) DIV (100 * degree)")
        given = edges.join(ranks.withColumnRenamed("host", "src"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(share).alias("given"))
        new = own.join(given, "host", "full").select("host", (F.coalesce("own", F.lit(0)) + F.coalesce("given", F.lit(0))).cast("long").alias("rank"))
        was = ranks.withColumnRenamed("rank", "was")
        step = materialize(new.filter("rank > 0").join(was, "host", "left"), "ranks")
        if last is not None:
            forget(last)
        last, ranks = step, step.select("host", "rank")
        if step.filter("rank <> coalesce(was, 0)").isEmpty():
            return ranks


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages: page_id, url, html. Returns page_id, host, path, rule, verdict, trust, distrust (ranks; 0 if none).

    rules: (verdict, host, path) triples, or a DataFrame verdict, host, path, place.
    """
    all_pages = pick(pages, page_id="page_id", url="url", html="html")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    named = all_pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    edges = materialize(links(named), "links")
    rows = named.select("page_id", "host", "path")
    if not isinstance(rules, DataFrame) and len(rules) > MAX_INLINE_RULES:
        rules = pages.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rules)], "verdict string, host string, path string, place long")
    if isinstance(rules, DataFrame):
        rows = materialize(join_rules(rows, rules), "ruled")
    else:
        text, verdict = rule_of(F.col("host"), F.col("path"), rules)
        rows = rows.select("*", text.alias("rule"), verdict.alias("listed"))
    counts = rows.groupBy("host").agg(F.count_if(F.col("listed") == "allow").alias("allowed"), F.count_if(F.col("listed") == "block").alias("blocked"))
    counts = materialize(counts, "hosts")
    trusted, blocked = counts.filter("allowed > 0 AND blocked = 0").select("host"), counts.filter("allowed = 0 AND blocked > 0").select("host")
    trust = propagate(edges, trusted).withColumnRenamed("rank", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = propagate(back, blocked).withColumnRenamed("rank", "distrust")
    hosts = trust.join(distrust, "host", "full").select("host", F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))
    hosts = materialize(hosts, "verdicts")
    out = rows.join(hosts, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0)), "distrust": F.coalesce("distrust", F.lit(0))})
    method = F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", method).alias("verdict"), "trust", "distrust")


def op4_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's url."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def oracle_sql(pages: str = "pages") -> str:
    def fits(of: str, prefix: str) -> str:
        return f"(host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '{prefix}')"

    by_length = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in by_length) + " END"
    listed = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in by_length) + " END"
    url = _URL.replace("'", "''")
    link = _LINK.replace("'", "''")
    parts = [
        rf"""pg AS MATERIALIZED (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{url}', 1), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '{url}', 2) AS path, html FROM {pages})""",
        f"ru AS MATERIALIZED (SELECT page_id, host, path, {rule} AS rule, {listed} AS listed FROM pg)",
        f"li AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS url FROM pg)",
        rf"""ed AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, translate(regexp_extract(CASE WHEN starts_with(url, '//') THEN 'x:' || url ELSE url END, '{url}', 1), '{_UPPER}', '{_LOWER}') AS dst FROM li)
  WHERE src <> dst AND src <> '' AND dst <> '')""",
        "co AS MATERIALIZED (SELECT host, count(*) FILTER (WHERE listed = 'allow') AS allowed, count(*) FILTER (WHERE listed = 'block') AS blocked FROM ru GROUP BY host)",
    ]
    own = f"({UNIT * (100 - DAMPING) // 100})::BIGINT"
    for x, where, src, dst in (("t", "allowed > 0 AND blocked = 0", "src", "dst"), ("d", "allowed = 0 AND blocked > 0", "dst", "src")):
        parts += [
            f"{x}s AS MATERIALIZED (SELECT host FROM co WHERE {where})",
            f"{x}e AS MATERIALIZED (SELECT {src} AS src, {dst} AS dst, count(*) OVER (PARTITION BY {src}) AS degree FROM ed)",
            f"{x}0 AS MATERIALIZED (SELECT host, {own} AS own, {own} AS rank FROM {x}s)",
        ]
        parts.append(f"""{x}r(k, host, rank) AS (SELECT 0, host, rank FROM {x}0 UNION ALL
  SELECT k + 1, host, sum(given)::BIGINT FROM (SELECT r.k, e.dst AS host, (r.rank * {DAMPING}) // (100 * e.degree) AS given FROM {x}r r JOIN {x}e e ON r.host = e.src
    UNION ALL SELECT t.k, s.host, s.own FROM (SELECT max(k) AS k FROM {x}r) t JOIN {x}0 s ON t.k IS NOT NULL) WHERE k < {SQL_ROUNDS} GROUP BY k, host),
{x} AS MATERIALIZED (SELECT host, rank FROM {x}r WHERE k = {SQL_ROUNDS} AND rank > 0)""")
    return (
        "WITH RECURSIVE "
        + ",\n".join(parts)
        + """
SELECT page_id, ru.host, path, rule, coalesce(listed, CASE WHEN coalesce(d.rank, 0) > coalesce(t.rank, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(t.rank, 0)::BIGINT AS trust, coalesce(d.rank, 0)::BIGINT AS distrust
FROM ru LEFT JOIN t ON t.host = ru.host LEFT JOIN d ON d.host = ru.host"""
    )


ORACLE_SQL = oracle_sql()
