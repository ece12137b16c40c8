"""Set-overlap similarities, their weighted combination, and the pairs as a matrix."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import weights
from .text import fill_pairs


def member_sets(edges: DataFrame, papers: DataFrame, cited: bool = True) -> DataFrame:
    """(doc, member): who cites each paper, or with cited=False what each cites. papers: doc."""
    key, member = ("dst", "src") if cited else ("src", "dst")
    return edges.select(F.col(key).alias("doc"), F.col(member).alias("member")).join(papers.select("doc"), "doc").distinct()


def overlap_pairs(sets: DataFrame, papers: DataFrame) -> DataFrame:
    """(a, b, shared, size_a, size_b, cosine, jaccard) for all pairs of papers (doc); empty sets give 0."""
    sizes = papers.select("doc").distinct().join(sets.groupBy("doc").agg(F.count(F.lit(1)).alias("size")), "doc", "left").select("doc", F.coalesce("size", F.lit(0)).alias("size"))
    x, y = sets.select(F.col("doc").alias("a"), "member"), sets.select(F.col("doc").alias("b"), "member")
    shared = x.join(y, "member").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("shared"))
    out = fill_pairs(shared, papers, "shared").withColumn("shared", F.col("shared").cast("long"))
    out = out.join(sizes.select(F.col("doc").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("doc").alias("b"), F.col("size").alias("size_b")), "b")
    product, union = F.sqrt(F.col("size_a").cast("double") * F.col("size_b")), F.col("size_a") + F.col("size_b") - F.col("shared")
    cosine = F.coalesce(F.col("shared") / F.nullif(product, F.lit(0.0)), F.lit(0.0))
    jaccard = F.coalesce(F.col("shared") / F.nullif(union, F.lit(0)), F.lit(0.0))
    return out.select("a", "b", "shared", "size_a", "size_b", F.round(cosine, 6).alias("cosine"), F.round(jaccard, 6).alias("jaccard"))


def combine(papers: DataFrame, parts: Mapping[str, DataFrame], shares: Mapping[str, float], digits: int = 6) -> DataFrame:
    """(a, b, each part, combined): weighted sum of pair tables (a, b, value), absent pairs 0, shares scaled to 1."""
    scaled = dict(zip(shares, weights(*shares.values()), strict=True))
    out = fill_pairs(next(iter(parts.values())).select("a", "b").limit(0).withColumn("_z", F.lit(0.0)), papers, "_z").drop("_z")
    for name, pairs in parts.items():
        out = out.join(pairs.select("a", "b", F.col(pairs.columns[2]).alias(name)), ["a", "b"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    total = sum((F.lit(scaled[n]) * F.col(n) for n in parts), F.lit(0.0))
    return out.withColumn("combined", F.round(total, digits))


def strong(pairs: DataFrame, value: str, threshold: float) -> DataFrame:
    """Edges (a, b, weight) of a similarity graph."""
    return pairs.filter(F.col(value) >= threshold).select("a", "b", F.col(value).alias("weight"))


def matrix(pairs: DataFrame, value: str, ids: list[str]) -> DataFrame:
    """A row and a column for each of the ids (a bounded list), 1 on the diagonal."""
    both = pairs.select("a", "b", value).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), value))
    wide = both.groupBy("a").pivot("b", ids).agg(F.first(value))
    return wide.select(F.col("a").alias("id"), *(F.when(F.col("a") == i, F.lit(1.0)).otherwise(F.coalesce(F.col(f"`{i}`"), F.lit(0.0))).alias(i) for i in ids))


def shared_members(sets: DataFrame, communities: DataFrame, n: int = 8, shown: int = 3) -> DataFrame:
    """(community, label): the members most often shared within each community, the first ``shown`` of n; communities: doc, community."""
    from pyspark.sql import Window as W

    counts = sets.join(communities, "doc").groupBy("community", "member").agg(F.count(F.lit(1)).alias("c"))
    ranked = counts.withColumn("r", F.row_number().over(W.partitionBy("community").orderBy(F.col("c").desc(), "member"))).filter(F.col("r") <= min(n, shown))
    named = ranked.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "member"))), lambda x: x["member"]), "; ").alias("label"))
    return communities.select("community").distinct().join(named, "community", "left").select("community", F.coalesce("label", F.lit("isolated_root")).alias("label"))
