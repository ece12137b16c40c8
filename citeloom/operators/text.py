"""Text operators over long tables: token counts, TF-IDF, cosine pairs, centroids, top terms.

A corpus is a table (doc, tokens); its scope is the caller's choice, and document frequencies never
leave it. Vectors are long tables (doc, term, w).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import joined, tokens
from ..storage import spread


def corpus(df: DataFrame, doc: str, *texts: str) -> DataFrame:
    """(doc, tokens) of the given text columns, joined by spaces."""
    rows = spread(df.select(F.col(doc).alias("doc"), F.concat_ws(" ", *(F.coalesce(F.col(t), F.lit("")) for t in texts)).alias("text")))
    return rows.select("doc", tokens(F.col("text")).alias("tokens"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc, term, n, length) with length the document's token count; rows of one doc are one document."""
    counts = docs.select("doc", F.explode("tokens").alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("length", F.sum("n").over(W.partitionBy("doc")))


def tfidf(docs: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(doc, term, w): n/length times ln((1 + N) / (1 + df)) + 1; N counts documents without tokens too."""
    counts = term_counts(docs) if counts is None else counts
    total = docs.select(F.countDistinct("doc").alias("total"))
    frequency = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((1.0 + F.col("total")) / (1.0 + F.col("df"))) + 1.0
    return counts.join(frequency, "term").crossJoin(F.broadcast(total)).select("doc", "term", (F.col("n") / F.col("length") * idf).alias("w"))  # total is one row


def norms(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def cosine_pairs(vectors: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity) for a < b over shared terms; docs (doc, a bounded set) restores the pairs that share none as 0."""
    left, right = vectors.select(F.col("doc").alias("a"), "term", F.col("w").alias("wa")), vectors.select(F.col("doc").alias("b"), "term", F.col("w").alias("wb"))
    dots = left.join(right, "term").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    n = norms(vectors)
    out = dots.join(n.select(F.col("doc").alias("a"), F.col("norm").alias("na")), "a").join(n.select(F.col("doc").alias("b"), F.col("norm").alias("nb")), "b")
    out = out.select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("similarity"))
    return out if docs is None else fill_pairs(out, docs, "similarity")


def fill_pairs(pairs: DataFrame, docs: DataFrame, *values: str) -> DataFrame:
    """All pairs a < b of docs (doc: role papers or groups, tens of them), values 0 where pairs has none."""
    ids = docs.select("doc").distinct()
    every = ids.select(F.col("doc").alias("a")).join(ids.select(F.col("doc").alias("b")), F.col("a") < F.col("b"))
    return every.join(pairs, ["a", "b"], "left").select("a", "b", *(F.coalesce(F.col(v), F.lit(0.0)).alias(v) for v in values))


def mean_pairwise(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean similarity over all pairs of each group's documents, pairs without a shared term included; groups: doc, grp. Vectors hold one group's corpus each: (grp, doc, term, w)."""
    n = vectors.groupBy("grp", "doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = vectors.join(n, ["grp", "doc"]).select("grp", "doc", "term", (F.col("w") / F.col("norm")).alias("u"))
    # the sum over pairs of unit vectors' products, from the sum vector alone: (|S|^2 - sum |u|^2) / 2
    sums = unit.groupBy("grp", "term").agg(F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("q")).groupBy("grp").agg(((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / 2).alias("total"))
    count = groups.groupBy("grp").agg(F.countDistinct("doc").alias("n"))
    mean = F.when(F.col("n") > 1, F.coalesce("total", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1) / 2)).otherwise(0.0)
    return count.join(sums, "grp", "left").select("grp", "n", mean.alias("mean_similarity"))


def tfidf_by_group(docs: DataFrame) -> DataFrame:
    """(grp, doc, term, w) with document frequencies within each group. docs: grp, doc, tokens."""
    counts = docs.select("grp", "doc", F.explode("tokens").alias("term")).groupBy("grp", "doc", "term").agg(F.count(F.lit(1)).alias("n"))
    length = counts.groupBy("grp", "doc").agg(F.sum("n").alias("length"))
    frequency = counts.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("df"))
    total = docs.groupBy("grp").agg(F.countDistinct("doc").alias("total"))
    idf = F.log((1.0 + F.col("total")) / (1.0 + F.col("df"))) + 1.0
    out = counts.join(length, ["grp", "doc"]).join(frequency, ["grp", "term"]).join(total, "grp")
    return out.select("grp", "doc", "term", (F.col("n") / F.col("length") * idf).alias("w"))


def centroids(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, term, w): mean over the group's non-empty documents. groups: doc, grp."""
    rows = vectors.join(groups, "doc")
    n = rows.groupBy("grp").agg(F.countDistinct("doc").alias("n"))
    return rows.groupBy("grp", "term").agg(F.sum("w").alias("s")).join(n, "grp").select("grp", "term", (F.col("s") / F.col("n")).alias("w"))


def centroid_similarity(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc, grp, similarity) of each document to its group's centroid; 0 for a document without tokens."""
    c = centroids(vectors, groups)
    own = vectors.join(groups, "doc")
    dot = own.join(c.withColumnRenamed("w", "cw"), ["grp", "term"]).groupBy("doc", "grp").agg(F.sum(F.col("w") * F.col("cw")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    size = c.groupBy("grp").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    found = dot.join(size, "grp").select("doc", "grp", (F.col("dot") / (F.col("norm") * F.col("size"))).alias("similarity"))
    return groups.join(found, ["doc", "grp"], "left").select("doc", "grp", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def top_terms(weighted: DataFrame, n: int, value: str = "w") -> DataFrame:
    """(grp, top_terms) of weighted (grp, term, value): the n heaviest, ties by term."""
    ranked = weighted.withColumn("rank", F.row_number().over(W.partitionBy("grp").orderBy(F.col(value).desc(), "term"))).filter(F.col("rank") <= n)
    return ranked.groupBy("grp").agg(joined(F.collect_list(F.struct("rank", F.col("term").alias("v")))).alias("top_terms"))


def best_anchor(vectors: DataFrame, candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc, similarity): each candidate's greatest cosine to any anchor, else 0. candidates, anchors: doc."""
    n = norms(vectors)
    unit = vectors.join(n, "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("u"))
    c = unit.join(candidates.select("doc"), "doc")
    a = unit.join(anchors.select("doc"), "doc").select(F.col("doc").alias("anchor"), "term", F.col("u").alias("ua"))
    best = c.join(a, "term").groupBy("doc", "anchor").agg(F.sum(F.col("u") * F.col("ua")).alias("s")).groupBy("doc").agg(F.max("s").alias("similarity"))
    return candidates.select("doc").join(best, "doc", "left").select("doc", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
