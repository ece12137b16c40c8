"""Topics by nonnegative tensor factorisation of documents x terms x entropy bins.

The tensor is never dense: its cells are rows, and the multiplicative updates are sums over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, stored
from .graph import places

FLOOR = 1e-10
#: A tensor of up to so many cells, 32 bytes each, is one task's work.
TASK_CELLS = 1_000_000


def tensor(counts: DataFrame, docs: DataFrame, bins: int = 3, min_df: int = 2, max_df: float = 0.85) -> DataFrame:
    """(doc, term, bin, v): ln(1 + n) times idf of the terms whose document frequency is in bounds.

    A term's bin is its place among the exact quantiles of term entropy; a value on an edge belongs
    to the upper bin. counts: doc, term, n. docs: doc, those without tokens included.
    """
    total = docs.select(F.countDistinct("doc").alias("total"))
    per = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("g")).crossJoin(F.broadcast(total))  # one row
    bound = F.lit(max_df) * F.col("total") if max_df <= 1 else F.lit(max_df)
    per = per.filter((F.col("df") >= min_df) & (F.col("df") <= bound))
    rows = counts.join(per, "term").withColumn("p", F.col("n") / F.col("g"))
    entropy = rows.groupBy("term").agg((-F.sum(F.col("p") * F.log("p")) / F.log(F.first("total").cast("double"))).alias("entropy"))
    if bins > 1:
        edges = entropy.agg(F.percentile("entropy", F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("edges"))
        binned = entropy.crossJoin(F.broadcast(edges)).select("term", F.size(F.filter("edges", lambda e: F.col("entropy") >= e)).alias("bin"))  # one row
    else:
        binned = entropy.select("term", F.lit(0).alias("bin"))
    idf = F.log((1.0 + F.col("total")) / (1.0 + F.col("df"))) + 1.0
    return rows.join(binned, "term").select("doc", "term", "bin", (F.log1p("n") * idf).alias("v"))


def _updated(factor: np.ndarray, numerator: np.ndarray, others: np.ndarray, floor: float) -> np.ndarray:
    return factor * numerator / np.maximum(factor @ others, floor)


def factorize(cells: tuple[np.ndarray, ...], shape: tuple[int, int, int], rank: int, iterations: int, seed: int, floor: float = FLOOR) -> list[np.ndarray]:
    """Nonnegative CP of the cells (i, j, k, v) by multiplicative updates; term columns are scaled to length 1, documents take the scale."""
    rng = np.random.default_rng(seed)
    parts = [rng.random((n, rank)) + 0.1 for n in shape]
    at, v = cells[:3], cells[3]
    for _ in range(iterations):
        for mode in range(3):
            x, y = (m for m in range(3) if m != mode)
            each = v[:, None] * parts[x][at[x]] * parts[y][at[y]]
            numerator = np.stack([np.bincount(at[mode], each[:, r], shape[mode]) for r in range(rank)], axis=1)
            parts[mode] = _updated(parts[mode], numerator, (parts[x].T @ parts[x]) * (parts[y].T @ parts[y]), floor)
        scale = np.maximum(np.linalg.norm(parts[1], axis=0), floor)
        parts[1] /= scale
        parts[0] *= scale
    return parts


def _started(numbers: DataFrame, first: int, rank: int, seed: int) -> DataFrame:
    """numbers with factor columns f0, f1, ...: the draws that ``factorize`` would give row n, which follow the ``first`` ones."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.random.Generator(np.random.PCG64(seed).advance(first + n * rank)).random(rank) + 0.1 for n in batch.column("n").to_pylist()]
            drawn = np.stack(rows) if rows else np.zeros((0, rank))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(drawn[:, r]) for r in range(rank))], [*batch.schema.names, *(f"f{r}" for r in range(rank))])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbers.schema)
    return stored(numbers.mapInArrow(draw, kinds + "".join(f", f{r} double" for r in range(rank))), "factor")


def _gram(factor: DataFrame, rank: int) -> np.ndarray:
    """Inner products of the factor's columns, rank x rank."""
    sums = [F.sum(F.col(f"f{r}") * F.col(f"f{q}")) for r in range(rank) for q in range(rank)]
    return np.array([x or 0.0 for x in factor.agg(*sums).first()]).reshape(rank, rank)


def _raised(factor: DataFrame, key: str, sums: DataFrame, others: np.ndarray, scale: np.ndarray, *more: str) -> DataFrame:
    """One multiplicative update: factor's columns, times scale, by sums' s0, s1, ... over what the other modes' Gram matrix makes of them."""
    rank = len(scale)
    now = [F.col(f"f{r}") * float(scale[r]) for r in range(rank)]
    below = [reduce(lambda a, b: a + b, (now[q] * float(others[q, r]) for q in range(rank))) for r in range(rank)]
    kept = [c for c in factor.columns if not (c[0] == "f" and c[1:].isdigit()) and c not in more]
    new = [(now[r] * F.col(f"s{r}") / F.greatest(below[r], F.lit(FLOOR))).alias(f"f{r}") for r in range(rank)]
    return factor.drop(*more).join(sums, key).select(*kept, *new, *more)


def factorize_rounds(cells: DataFrame, docs: DataFrame, terms: DataFrame, bins: int, rank: int, iterations: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The same factors by DataFrame rounds: docs (doc, n) and terms (term, n) with columns f0, f1, ...

    cells: i, j, k, v. Each mode's sums are a join of the cells with one factor and an aggregation by the other; only Gram
    matrices of rank x rank and the bins' factor, bins x rank, come to the driver. The terms' scale is kept there too and
    goes into the next round's expressions.
    """
    n_docs, n_terms = docs.count(), terms.count()
    by_doc, by_term = _started(docs, 0, rank, seed), _started(terms, n_docs * rank, rank, seed)
    rng = np.random.Generator(np.random.PCG64(seed).advance((n_docs + n_terms) * rank))
    by_bin, scale, gram = rng.random((bins, rank)) + 0.1, np.ones(rank), _gram(by_term, rank)
    for _ in range(iterations):
        of_bin = [F.element_at(F.array(*(F.lit(float(x)) for x in by_bin[:, r])), (F.col("k") + 1).cast("int")) for r in range(rank)]
        terms_now = by_term.select(F.col("n").alias("j"), *(F.col(f"f{r}").alias(f"b{r}") for r in range(rank)))
        sums = cells.join(terms_now, "j").groupBy(F.col("i").alias("n")).agg(*(F.sum(F.col("v") * F.col(f"b{r}") * of_bin[r] / float(scale[r])).alias(f"s{r}") for r in range(rank)))
        was, by_doc = by_doc, stored(_raised(by_doc, "n", sums, gram / np.outer(scale, scale) * (by_bin.T @ by_bin), scale), "factor")
        forget(was)
        doc_gram = _gram(by_doc, rank)
        docs_now = by_doc.select(F.col("n").alias("i"), *(F.col(f"f{r}").alias(f"a{r}") for r in range(rank)))
        part = cells.join(docs_now, "i").groupBy(F.col("j").alias("n"), "k").agg(*(F.sum(F.col("v") * F.col(f"a{r}")).alias(f"m{r}") for r in range(rank)))
        listed = F.collect_list(F.struct("k", *(f"m{r}" for r in range(rank)))).alias("bins")  # one for each bin at most
        sums = part.groupBy("n").agg(*(F.sum(F.col(f"m{r}") * of_bin[r]).alias(f"s{r}") for r in range(rank)), listed)
        was, by_term = by_term, stored(_raised(by_term, "n", sums, doc_gram * (by_bin.T @ by_bin), 1 / scale, "bins"), "factor")
        forget(was)
        gram = _gram(by_term, rank)
        told = by_term.select(F.explode("bins").alias("x"), *(f"f{r}" for r in range(rank))).groupBy("x.k").agg(*(F.sum(F.col(f"x.m{r}") * F.col(f"f{r}")).alias(f"s{r}") for r in range(rank)))
        numerator = np.zeros((bins, rank))
        for row in told.collect():  # a row a bin
            numerator[row.k] = row[1:]
        by_bin = _updated(by_bin, numerator, doc_gram * gram, FLOOR)
        scale = np.maximum(np.sqrt(np.diag(gram)), FLOOR)
    scaled = lambda df, by: df.select(*(c for c in df.columns if c in ("doc", "term", "n")), *((F.col(f"f{r}") * float(by[r])).alias(f"f{r}") for r in range(rank)))
    return scaled(by_doc, scale), scaled(by_term, 1 / scale)


def topics(cells: DataFrame, rank: int = 4, iterations: int = 300, seed: int = 42, bins: int = 3, n_terms: int = 8, task_cells: int = TASK_CELLS) -> DataFrame:
    """doc, topic (from 1), weight (share of the document), dominant, confidence, terms.

    Up to ``task_cells`` cells, counted first, are one task's work, as a broadcast table would be; more go by rounds, to the same factors.
    """
    docs, terms = places(cells, "doc"), places(cells, "term")
    rows = cells.join(docs.withColumnRenamed("n", "i"), "doc").join(terms.withColumnRenamed("n", "j"), "term")
    rows = stored(rows.select("i", "j", F.col("bin").alias("k"), F.col("v").cast("double").alias("v")), "cells")
    names = [f"f{r}" for r in range(rank)]
    if rows.count() > task_cells:
        by_doc, by_term = factorize_rounds(rows, docs, terms, bins, rank, iterations, seed)
    else:
        shape = (docs.count(), terms.count(), bins)

        def run(table: pa.Table) -> pa.Table:
            by = factorize(tuple(table.column(c).to_numpy() for c in ("i", "j", "k", "v")), shape, rank, iterations, seed)
            mode = np.repeat([0, 1], shape[:2])
            both = np.concatenate(by[:2])
            cols = [pa.array(mode, pa.int32()), pa.array(np.concatenate([np.arange(shape[0]), np.arange(shape[1])])), *(pa.array(both[:, r]) for r in range(rank))]
            return pa.table(cols, ["mode", "n", *names])

        both = stored(rows.groupBy(F.lit(0).alias("_g")).applyInArrow(run, "mode int, n long" + "".join(f", {x} double" for x in names)), "factors")
        by_doc, by_term = (both.filter(f"mode = {m}").drop("mode").join(of, "n") for m, of in ((0, docs), (1, terms)))
    total = F.greatest(reduce(lambda a, b: a + b, map(F.col, names)), F.lit(FLOOR))
    shares = by_doc.select("doc", F.array(*(F.col(x) / total for x in names)).alias("shares"))
    best = None
    for r in range(rank):
        top = by_term.orderBy(F.col(names[r]).desc(), "term").limit(n_terms).agg(F.sort_array(F.collect_list(F.struct((-F.col(names[r])).alias("less"), "term"))).alias("top"))
        top = top.select(F.lit(r + 1).alias("topic"), F.array_join(F.transform("top", lambda x: x["term"]), "; ").alias("terms"))
        best = top if best is None else best.unionByName(top)
    confidence = F.array_max("shares")
    out = shares.select("doc", F.posexplode("shares").alias("at", "weight"), confidence.alias("confidence"), (F.array_position("shares", confidence) - 1).alias("main"))
    out = out.select("doc", (F.col("at") + 1).alias("topic"), "weight", (F.col("at") == F.col("main")).alias("dominant"), "confidence")
    return out.join(F.broadcast(best), "topic").select("doc", "topic", "weight", "dominant", "confidence", "terms")  # a row a topic


def topic_pairs(topic_rows: DataFrame) -> DataFrame:
    """(a, b, similarity): cosine of the documents' topic shares."""
    x, y = topic_rows.select(F.col("doc").alias("a"), "topic", F.col("weight").alias("wa")), topic_rows.select(F.col("doc").alias("b"), "topic", F.col("weight").alias("wb"))
    norm = topic_rows.groupBy("doc").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n"))
    dots = x.join(y, "topic").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    out = dots.join(norm.select(F.col("doc").alias("a"), F.col("n").alias("na")), "a").join(norm.select(F.col("doc").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", F.round(F.col("dot") / F.nullif(F.col("na") * F.col("nb"), F.lit(0.0)), 6).alias("similarity"))
