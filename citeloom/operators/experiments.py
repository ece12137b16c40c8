"""Leaf lists under other settings: more leaves than usual, and leaves filled up with recent frontier papers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored
from . import graph, roles


def leaf_run(edges: DataFrame, articles: DataFrame, max_leaves: int, max_roots: int = 20) -> DataFrame:
    """The scored graph if so many leaves may be chosen."""
    root_rows = stored(roles.roots(edges, max_roots), "roots")
    leaf_rows = stored(roles.leaves(edges, articles, roles.root_connections(edges, root_rows), max_leaves), "leaves")
    return stored(roles.sap_scores(edges, root_rows, leaf_rows), "run")


def ranked_leaves(scored: DataFrame, edges: DataFrame, articles: DataFrame, degrees: DataFrame | None = None) -> DataFrame:
    """A run's leaves by leaf count, sap and id: leaf_rank, id, leaf, sap, in_degree, out_degree, and what the articles say of them."""
    rows = stored(scored.filter("leaf > 0").select("id", "leaf", "sap"), "leaves")  # few, so the joins needn't move the rest
    own = rows.select("id")
    ends = degrees if degrees is not None else graph.degrees(edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")).distinct())
    rows, articles = rows.join(ends, "id"), articles.join(own, "id", "left_semi")
    rank = F.row_number().over(W.orderBy(F.col("leaf").desc(), F.col("sap").desc(), F.col("id").desc()))  # a run's leaves, max_leaves at most
    return roles.enrich(rows.withColumn("leaf_rank", rank), articles)


def leaf_counts(edges: DataFrame, articles: DataFrame, few: int = 50, many: int = 100, max_roots: int = 20, run: Callable[[int], DataFrame] | None = None) -> DataFrame:
    """The leaves of a run with ``few``, of one with ``many``, and those that only the second has, told apart by ``run``.

    in_baseline: whether the first run has the leaf, too. run: the scored graph if so many leaves may be chosen, if it is at hand.
    """
    first, second = (stored(ranked_leaves(run(n) if run else leaf_run(edges, articles, n, max_roots), edges, articles), "leaves") for n in (few, many))
    base = first.select("id", F.lit(True).alias("in_baseline"))
    second = second.join(base, "id", "left").withColumn("in_baseline", F.coalesce("in_baseline", F.lit(False)))
    runs = {f"top_{few}": first.withColumn("in_baseline", F.lit(True)), f"top_{many}": second, f"added_{few + 1}_{many}": second.filter("NOT in_baseline")}
    return reduce(DataFrame.unionByName, (rows.withColumn("run", F.lit(name)) for name, rows in runs.items()))


def leaf_count_summary(runs: DataFrame) -> DataFrame:
    """A row for each run that has a leaf: counts, the share with metadata, and how years and leaf counts spread."""
    known = F.count_if("has_article_metadata")
    spread = [f(c).cast(kind or "double").alias(f"{f.__name__}_{name}") for c, name, kind in (("year", "year", "int"), (F.col("leaf").cast("double"), "leaf_connections", None)) for f in (F.min, F.max)]
    middle = [F.median("year").alias("median_year"), F.median(F.col("leaf").cast("double")).alias("median_leaf_connections")]
    size = F.count(F.lit(1))
    return runs.groupBy("run").agg(size.alias("leaf_count"), known.alias("metadata_count"), F.round(known / size, 4).alias("metadata_share"), *spread, *middle)


def frontier_leaves(scored: DataFrame, edges: DataFrame, articles: DataFrame, taken: DataFrame, target: int = 100, recent_years: int = 5, degrees: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A run's leaves, and after them the best frontier papers up to target; and all candidates for that.

    taken (id): who has another role, roots, trunk, branches and top fruits. The leaves have leaf_rank, frontier_rank (null for a leaf
    of the run), leaf_type, leaf, sap, degrees, and what the articles say. degrees: those of the edges, if known.
    """
    degrees = stored(graph.degrees(edges), "degrees") if degrees is None else degrees
    own = stored(ranked_leaves(scored, edges, articles, degrees), "leaves")
    candidates, order = roles.frontier(edges, articles, taken.select("id").unionByName(own.select("id")).distinct(), recent_years, degrees)
    candidates = stored(candidates, "candidates")
    n = own.count()
    best = candidates.orderBy(*order).limit(max(0, target - n)).withColumn("frontier_rank", F.row_number().over(W.orderBy(*order)))
    more = best.select("id", "frontier_rank", (F.col("frontier_rank") + n).alias("leaf_rank")).join(scored.select("id", "leaf", "sap"), "id").join(degrees, "id")
    more = roles.enrich(more, articles).withColumn("leaf_type", F.lit("frontier_leaf"))
    own = own.withColumns({"frontier_rank": F.lit(None).cast("int"), "leaf_type": F.lit("sap_leaf")})
    return own.unionByName(more), candidates


def frontier_summary(leaves: DataFrame, candidates: DataFrame, target: int = 100, recent_years: int = 5) -> DataFrame:
    """One row: how many leaves of each kind there are, how many candidates there were, and what years and degrees the frontier has."""
    new = F.col("leaf_type") == "frontier_leaf"
    of_new = lambda f, c: f(F.when(new, F.col(c)))
    facts = leaves.agg(
        F.count_if(~new).alias("sap_leaf_count"), F.count_if(new).alias("selected_frontier_leaf_count"), F.count(F.lit(1)).alias("combined_leaf_count"),
        of_new(F.min, "year").alias("min_year"), of_new(F.max, "year").alias("max_year"), of_new(F.min, "out_degree").alias("min_out_degree"), of_new(F.max, "out_degree").alias("max_out_degree"),
    )
    given = facts.crossJoin(candidates.agg(F.count(F.lit(1)).alias("frontier_candidate_count")))  # one row each
    return given.withColumns({"target_leaves": F.lit(target), "recent_years": F.lit(recent_years)})
