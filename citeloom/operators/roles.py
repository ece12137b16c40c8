"""Structural roles by path counting: roots, leaves, trunk, branches, and the label each node gets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored
from . import graph


class EmptyRole(TypeError):
    """A role that later ones need has no node."""


Name = Callable[[Column], Column]


def top(df: DataFrame, value: str, k: int, name: Name | None = None) -> DataFrame:
    """The k rows of greatest (value, id). name: what an id stands for in that order, if it is a number."""
    return df.orderBy(F.col(value).desc(), (name or (lambda c: c))(F.col("id")).desc()).limit(k)


def roots(edges: DataFrame, max_roots: int = 20, degrees: DataFrame | None = None, name: Name | None = None) -> DataFrame:
    """Nodes that cite nothing, by how often they are cited: id, root (that count). degrees: those of the edges, if known."""
    sinks = (graph.degrees(edges) if degrees is None else degrees).filter("out_degree = 0 AND in_degree > 0")
    return top(sinks.select("id", F.col("in_degree").alias("root")), "root", max_roots, name)


def root_connections(edges: DataFrame, root_rows: DataFrame) -> DataFrame:
    """Paths to the roots, and the roots' citation counts summed over them: id, root_connections, raw_sap."""
    seeds = root_rows.select("id", F.lit(1).alias("root_connections"), F.col("root").alias("raw_sap"))
    return graph.path_sums(edges, seeds, "root_connections", "raw_sap")


def leaves(edges: DataFrame, years: DataFrame, connections: DataFrame, max_leaves: int | None = 50, min_connections: int = 3, max_age: int = 7, degrees: DataFrame | None = None, name: Name | None = None) -> DataFrame:
    """Uncited nodes with enough paths to roots that are recent enough: id, leaf (the path count).

    years: id, year. Recent means within max_age years of the newest candidate. A node without a
    year is no candidate. If none is left, every uncited node is.
    """
    uncited = (graph.degrees(edges) if degrees is None else degrees).filter("in_degree = 0").select("id")
    every = uncited.join(connections.select("id", F.col("root_connections").alias("leaf")), "id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0).cast(graph.BIG)))
    every = stored(every.join(years.select("id", "year"), "id", "left"), "uncited")
    dated = every.filter((F.col("leaf") >= min_connections) & F.col("year").isNotNull())
    newest = dated.agg(F.max("year")).first()[0]
    fit = every.limit(0) if newest is None else dated.filter(F.col("year") >= newest - max_age)
    found = every if fit.isEmpty() else fit
    found = found.select("id", "leaf")
    return found if max_leaves is None else top(found, "leaf", max_leaves, name)


def sap_scores(edges: DataFrame, root_rows: DataFrame, leaf_rows: DataFrame, down: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Per node: root, leaf, root_connections, raw_sap, leaf_connections, elaborate_sap, sap; missing counts are 0. down: the root_connections, if known; nodes (id): the edges', if known."""
    if root_rows.isEmpty():
        raise EmptyRole("no node cites nothing and is cited")
    leaf_rows = leaf_rows.filter("leaf > 0")
    if leaf_rows.isEmpty():
        raise EmptyRole("no leaf has a path to a root")
    down = root_connections(edges, root_rows) if down is None else down
    seeds = leaf_rows.select("id", F.lit(1).alias("leaf_connections"), F.col("leaf").alias("elaborate_sap"))
    up = graph.path_sums(edges, seeds, "leaf_connections", "elaborate_sap", backward=False)
    zero = F.lit(0).cast(graph.BIG)
    nodes = graph.vertices(edges) if nodes is None else nodes.select("id")
    out = nodes.join(down, "id", "left").join(up, "id", "left").join(root_rows.select("id", "root"), "id", "left").join(leaf_rows.select("id", "leaf"), "id", "left")
    out = out.select("id", *(F.coalesce(F.col(c).cast(graph.BIG), zero).alias(c) for c in ("root", "leaf", "root_connections", "raw_sap", "leaf_connections", "elaborate_sap")))
    sap = F.col("leaf_connections") * F.col("raw_sap") + F.col("root_connections") * F.col("elaborate_sap")
    return out.withColumn("sap", sap.cast(graph.BIG))


def trunk(scores: DataFrame, max_trunk: int = 20) -> DataFrame:
    """Neither roots nor leaves, by sap: id, trunk (the sap)."""
    found = top(scores.filter("root = 0 AND leaf = 0 AND sap > 0").select("id", F.col("sap").alias("trunk")), "trunk", max_trunk)
    if found.isEmpty():
        raise EmptyRole("no node lies between leaves and roots")
    return found


def smallest_communities(communities: DataFrame, count: int = 3) -> DataFrame:
    """The smallest communities (id, community) become branches 1, 2, 3: id, community, branch. Ties: smallest member first."""
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).orderBy("n", "first").limit(count)
    ranked = sizes.withColumn("branch", F.row_number().over(W.orderBy("n", "first"))).select("community", "branch")
    return communities.join(F.broadcast(ranked), "community").select("id", "community", "branch")


def eligible(branch_nodes: DataFrame, scores: DataFrame, trunk_rows: DataFrame, years: DataFrame) -> DataFrame:
    """Of the branches' nodes (id, branch) those that may be selected, with year and sap: neither root nor trunk, and dated; leaves count."""
    rows = branch_nodes.select("id", "branch").join(years.select("id", "year"), "id").filter("year IS NOT NULL").join(scores.select("id", "root", "sap"), "id").filter("root = 0").drop("root")
    return rows.join(trunk_rows.select("id"), "id", "left_anti")


def branches(communities: DataFrame, scores: DataFrame, trunk_rows: DataFrame, years: DataFrame, max_branch_size: int = 15, count: int = 3) -> DataFrame:
    """The newest eligible members of the smallest communities: id, branch, branch_rank."""
    rows = eligible(smallest_communities(communities, count), scores, trunk_rows, years)
    rank = F.row_number().over(W.partitionBy("branch").orderBy(F.col("year").desc(), F.col("id").desc()))
    return rows.withColumn("branch_rank", rank).filter(F.col("branch_rank") <= max_branch_size).select("id", "branch", "branch_rank")


def label(scores: DataFrame, trunk_rows: DataFrame, branch_rows: DataFrame | None = None) -> DataFrame:
    """Adds role to scores: root before trunk before leaf before branch_N, else empty."""
    out = scores.join(trunk_rows.select("id", "trunk"), "id", "left")
    kind = F.when(F.col("root") > 0, "root").when(F.col("trunk").isNotNull(), "trunk").when(F.col("leaf") > 0, "leaf")
    if branch_rows is not None:
        out = out.join(branch_rows.select("id", "branch"), "id", "left")
        kind = kind.when(F.col("branch").isNotNull(), F.concat(F.lit("branch_"), F.col("branch").cast("string")))
    return out.withColumn("role", kind.otherwise("")).drop("trunk", "branch")


def role_summary(labels: DataFrame) -> DataFrame:
    """How many nodes carry each label; none counts as unclassified."""
    name = F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("unclassified"))
    return labels.groupBy(name.alias("role")).agg(F.count(F.lit(1)).alias("n"))


def enrich(nodes: DataFrame, articles: DataFrame) -> DataFrame:
    """nodes (id) with the articles' columns: texts default to empty; has_article_metadata tells whether there is a row."""
    texts = [c for c, kind in articles.dtypes if kind == "string" and c != "id"]
    out = nodes.join(articles.withColumn("has_article_metadata", F.lit(True)), "id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in texts} | {"has_article_metadata": F.coalesce("has_article_metadata", F.lit(False))})


def leaf_like(edges: DataFrame) -> DataFrame:
    """Nodes that cite and are not cited: id, out_degree."""
    return graph.degrees(edges).filter("in_degree = 0 AND out_degree >= 1").select("id", "out_degree")


def frontier(edges: DataFrame, articles: DataFrame, taken: DataFrame, recent_years: int = 5, degrees: DataFrame | None = None) -> tuple[DataFrame, list]:
    """Recent uncited nodes that no role has taken (taken: id), and the order that puts the best first: id, year, out_degree, cited_by, has_text. degrees: those of the edges, if known."""
    degrees = graph.degrees(edges) if degrees is None else degrees
    dated = articles.filter("year IS NOT NULL")
    newest = dated.join(degrees.select("id"), "id", "left_semi").agg(F.max("year")).first()[0]
    free = degrees.filter("in_degree = 0 AND out_degree >= 1").select("id", "out_degree")
    rows = free.join(dated.filter(F.col("year") >= (newest or 0) - recent_years + 1), "id").join(taken.select("id"), "id", "left_anti")
    has_text = (F.length(F.coalesce("title", F.lit(""))) + F.length(F.coalesce("abstract", F.lit("")))) > 0
    rows = rows.select("id", "year", "out_degree", F.coalesce("cited_by", F.lit(0.0)).alias("cited_by"), has_text.alias("has_text"))
    order = [F.col("year").desc(), F.col("out_degree").desc(), F.col("cited_by").desc(), F.col("has_text").desc(), "id"]
    return rows, order


def fill_leaves(leaf_rows: DataFrame, edges: DataFrame, articles: DataFrame, taken: DataFrame, target: int = 100, recent_years: int = 5, degrees: DataFrame | None = None) -> DataFrame:
    """Leaves first, then the best frontier nodes up to target: id, leaf_type, leaf_rank. degrees: those of the edges, if known."""
    own = leaf_rows.select("id", F.row_number().over(W.orderBy(F.col("leaf").desc(), F.col("id").desc())).alias("leaf_rank"), F.lit("sap_leaf").alias("leaf_type"))
    n = leaf_rows.count()
    rows, order = frontier(edges, articles, taken.select("id").unionByName(leaf_rows.select("id")).distinct(), recent_years, degrees)
    more = rows.orderBy(*order).limit(max(0, target - n))
    more = more.select("id", (F.row_number().over(W.orderBy(*order)) + n).alias("leaf_rank"), F.lit("frontier_leaf").alias("leaf_type"))
    return own.unionByName(more).select("id", "leaf_type", "leaf_rank")
