"""Cleaning: id correction, record coalescing, overrides, keep-first, main-article filter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import filled, number, semicolon_parts, trim_ws, truthy


def require_columns(df: DataFrame, *names: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def replaced(c: Column, mapping: Mapping[str, str | None]) -> Column:
    """Exact-match replacement, one pass: the result is not looked up again."""
    if not mapping:
        return c
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return F.coalesce(F.try_element_at(table, c), c)


def correct_citations(citations: DataFrame, mapping: Mapping[str, str], legacy_nan_id: bool = False) -> DataFrame:
    """Distinct (SR, SR_ref), stripped and corrected; blank ids and ids that begin ANONYMOUS go.

    Null ids go; legacy_nan_id makes them the id "nan" instead.
    """
    require_columns(citations, "SR", "SR_ref")

    def fixed(name: str) -> Column:
        c = F.coalesce(F.col(name), F.lit("nan")) if legacy_nan_id else F.col(name)
        return replaced(trim_ws(c), mapping).alias(name)

    out = citations.select(fixed("SR"), fixed("SR_ref"))
    for name in ("SR", "SR_ref"):
        out = out.filter((F.col(name) != "") & ~F.col(name).startswith("ANONYMOUS"))
    return out.distinct()


def keep_first(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key: the first in the order given."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def coalesce_records(
    rows: DataFrame, key: str, order: str, mapping: Mapping[str, str] | DataFrame, preferred: Mapping[str, str] | None = None, merged_lists: Mapping[str, Sequence[str] | None] | None = None, dropped: Column | None = None
) -> DataFrame:
    """One record per canonical key: the base row's values, gaps filled from the others in order.

    Base: the row whose own key is canonical, else the preferred source's, else the first; order is
    a column. mapping: keys and their canonical keys, or a DataFrame key, canonical. Columns named in
    merged_lists become, for the keys listed there (None: all), the ordered distinct union of semicolon
    lists instead.
    """
    own = trim_ws(F.col(key))
    rows = rows.withColumn(key, own).filter(~F.col(key).startswith("ANONYMOUS"))
    if dropped is not None:
        rows = rows.filter(~F.coalesce(dropped, F.lit(False)))
    if isinstance(mapping, DataFrame):
        rows = rows.join(mapping.select(F.col(mapping.columns[0]).alias(key), F.col(mapping.columns[1]).alias("_to")), key, "left").withColumn("_canon", F.coalesce("_to", key)).drop("_to")
    else:
        rows = rows.withColumn("_canon", replaced(F.col(key), mapping))
    source = F.col(key) == F.try_element_at(F.create_map(*(F.lit(x) for p in preferred.items() for x in p)), F.col("_canon")) if preferred else F.lit(False)
    rows = rows.withColumn("_turn", F.when(F.col(key) == F.col("_canon"), 0).when(F.coalesce(source, F.lit(False)), 1).otherwise(2))
    # only the first row of the best kind is the base; the others follow in their own order
    best = W.partitionBy("_canon").orderBy("_turn", order)
    rows = rows.withColumn("_base", F.when(F.row_number().over(best) == 1, 0).otherwise(1))
    columns = [c for c in rows.columns if c not in (key, order, "_canon", "_turn", "_base")]
    place = F.struct("_base", order)
    aggs = []
    for c in columns:
        value = filled(F.col(c))
        first = F.min_by(F.col(c), F.when(value.isNotNull(), place))
        listed = (merged_lists or {}).get(c, ())
        if listed or listed is None:
            parts = F.transform(F.array_sort(F.collect_list(F.struct("_base", order, semicolon_parts(F.col(c)).alias("p")))), lambda x: x["p"])
            union = F.array_join(F.array_distinct(F.flatten(parts)), ";")
            first = union if listed is None else F.when(F.col("_canon").isin(*listed), union).otherwise(first)
        aggs.append(first.alias(c))
    return rows.groupBy("_canon").agg(*aggs).withColumnRenamed("_canon", key)


def tidy_articles(
    rows: DataFrame, order: str, mapping: Mapping[str, str] | DataFrame, preferred: Mapping[str, str] | None = None, multi_doi: Sequence[str] = (), dropped_dois: Sequence[str] = (), overrides: DataFrame | None = None
) -> DataFrame:
    """Article rows (SR, doi, __doi_norm, ...) as one record per canonical SR, rows of a dropped DOI left out, overrides (SR, ...) applied last."""
    doi = [F.lower(trim_ws(F.coalesce(F.col(c), F.lit("")))).isin(*dropped_dois) for c in ("doi", "__doi_norm") if c in rows.columns and dropped_dois]
    gone = None
    for d in doi:
        gone = d if gone is None else gone | d
    lists = {c: tuple(multi_doi) for c in ("doi", "__doi_norm") if c in rows.columns and multi_doi}
    out = coalesce_records(rows.filter("SR IS NOT NULL"), "SR", order, mapping, preferred, lists, gone)
    return out if overrides is None else override(out, overrides, "SR")


def override(rows: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Columns of overrides replace those of rows of the same key where not null; keys not in rows are added."""
    own = [c for c in overrides.columns if c != key]
    named = overrides.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in own)).withColumn("_has", F.lit(True))
    changed = rows.join(named, key, "left").select(*(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in own else F.col(c) for c in rows.columns))
    added = overrides.join(rows.select(key), key, "left_anti")
    return changed.unionByName(added, allowMissingColumns=True)


def normalize_columns(df: DataFrame, names: Sequence[str] = ("SR", "title", "abstract", "year", "journal", "source_title", "doi", "cited_by")) -> DataFrame:
    """Rename columns that differ from the canonical names only in case and white space around; of several the last, as none if the name itself is there."""
    found = {c.strip().lower(): c for c in df.columns}
    return df.withColumnsRenamed({found[n.lower()]: n for n in names if n.lower() in found and n not in df.columns})


def publications(rows: DataFrame, current_year: int, recent_years: int = 5, include_non_main: bool = False) -> DataFrame:
    """Recent articles of a user's table: SR stripped, year and cited_by as numbers, one row for each SR, the most cited (ties: newest, then title).

    Main articles only, where flags tell them. Rows without an SR or a year go; a missing cited_by is 0.
    """
    rows = normalize_columns(rows)
    require_columns(rows, "SR", "year", "cited_by")
    rows = main_articles(rows, include_non_main=include_non_main).filter("SR IS NOT NULL").withColumn("SR", trim_ws(F.col("SR")))
    rows = numeric(rows, "year", "cited_by").withColumn("cited_by", F.coalesce("cited_by", F.lit(0.0)))
    rows = rows.filter(F.col("year") >= current_year - recent_years).withColumn("year", F.col("year").cast("int"))
    title = [F.col("title").asc_nulls_last()] if "title" in rows.columns else []
    return keep_first(rows, "SR", F.col("cited_by").desc(), F.col("year").desc(), *title)


def main_articles(df: DataFrame, flags: Sequence[str] = ("__is_main", "ismainarticle", "ismain_wos", "ismain_scopus"), include_non_main: bool = False) -> DataFrame:
    """Rows that any of the flag columns marks; all rows where there is no flag column."""
    found = [f for f in flags if f in df.columns]
    if include_non_main or not found:
        return df
    keep = F.lit(False)
    for f in found:
        keep = keep | truthy(F.col(f))
    return df.filter(keep)


def numeric(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: number(F.col(n)) for n in names})
