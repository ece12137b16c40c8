"""Readers of citation tables: CSV edges and articles, GEXF graphs, optional tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

from ..functions.columns import number, trim_ws
from ..operators.clean import keep_first, normalize_columns, require_columns
from ..operators.graph import degrees

ARTICLE_COLUMNS = ("SR", "title", "author", "author_full_names", "orcid", "abstract", "year", "journal", "source_title", "country", "doi", "__doi_norm")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column a string, quotes doubled inside quoted fields, line breaks allowed in them."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def citations(spark: SparkSession, path: str, legacy_nan_id: bool = False) -> DataFrame:
    """Distinct (SR, SR_ref), stripped; blank ids go. Null ids go too, or become "nan" on request."""
    rows = read_csv(spark, path)
    require_columns(rows, "SR", "SR_ref")
    fix = lambda c: trim_ws(F.coalesce(F.col(c), F.lit("nan")) if legacy_nan_id else F.col(c)).alias(c)
    return rows.select(fix("SR"), fix("SR_ref")).filter("SR <> '' AND SR_ref <> ''").distinct()


def articles(spark: SparkSession, path: str) -> DataFrame:
    """The article columns, one row per SR (the first of the file), year as a number."""
    rows = read_csv(spark, path).withColumn("_row", F.monotonically_increasing_id())
    require_columns(rows, "SR")
    none = F.lit(None).cast("string")
    picked = rows.select("_row", *(F.col(c) if c in rows.columns else none.alias(c) for c in ARTICLE_COLUMNS))
    picked = picked.withColumn("SR", trim_ws(F.col("SR"))).filter("SR <> ''").withColumn("year", number(F.col("year")).cast("int"))
    return keep_first(picked, "SR", F.col("_row")).drop("_row")


def raw_articles(spark: SparkSession, path: str) -> DataFrame:
    """Every column of the article file, with the rows' order as _row."""
    rows = read_csv(spark, path).withColumn("_row", F.monotonically_increasing_id())
    require_columns(rows, "SR")
    return rows


def nodes_of(article_rows: DataFrame) -> DataFrame:
    """Articles under the names and kinds the graph operators use: id, title, abstract, journal, source_title, year, cited_by; what is missing is null."""
    rows = normalize_columns(article_rows)
    texts = [(F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in ("title", "abstract", "journal", "source_title")]
    value = lambda c: number(F.col(c)) if c in rows.columns else F.lit(None).cast("double")
    return rows.select(F.col("SR").alias("id"), *texts, value("year").cast("int").alias("year"), value("cited_by").alias("cited_by"))


def gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GEXF file: id, label, a map of attributes by title, in_degree and out_degree; src, dst."""
    xml = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    names = xml("attribute", "_id string, _title string").filter("_id IS NOT NULL").select(F.map_from_entries(F.collect_list(F.struct("_id", "_title"))).alias("names"))
    value = T.StructType([T.StructField("_for", T.StringType()), T.StructField("_value", T.StringType())])
    held = T.StructType([T.StructField("attvalue", T.ArrayType(value))])
    schema = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_label", T.StringType()), T.StructField("attvalues", held)])
    nodes = xml("node", schema).crossJoin(F.broadcast(names))  # names is one row
    pairs = F.transform(F.coalesce("attvalues.attvalue", F.array().cast(T.ArrayType(value))), lambda x: F.struct(F.coalesce(F.try_element_at("names", x["_for"]), x["_for"]).alias("k"), x["_value"].alias("v")))
    nodes = nodes.select(F.col("_id").alias("id"), F.coalesce("_label", "_id").alias("label"), F.map_from_entries(pairs).alias("attributes"))
    edges = xml("edge", "_source string, _target string").select(F.col("_source").alias("src"), F.col("_target").alias("dst"))
    ends = degrees(edges.distinct())
    nodes = nodes.join(ends, "id", "left").fillna({"in_degree": 0, "out_degree": 0})
    return nodes, edges


def optional(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """A Parquet table if the path is there, else no rows of the same schema."""
    if path and Path(path).exists():
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def optional_csv(spark: SparkSession, path: str | None, **columns: str) -> DataFrame:
    """Of a CSV file with a header, if it is there, the columns named (new name: old name) as text; else no rows of them."""
    if not path or not Path(path).exists():
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = sorted(set(columns.values()) - set(rows.columns))
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return rows.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def pairs_of(rows: DataFrame) -> DataFrame:
    """rows (a, b, similarity) in whatever order and with repeats: each pair once, the smaller id first; of repeats the greatest similarity."""
    ordered = rows.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("similarity").cast("double").alias("similarity"))
    return ordered.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def article_source(spark: SparkSession, path: str, template: str | None = None, sheet: str = "wos_scopus") -> DataFrame:
    """A user's spreadsheet, if it is there and can be read, in place of the article file."""
    if template and Path(template).exists():
        import pandas as pd

        try:
            return spark.createDataFrame(pd.read_excel(template, sheet_name=sheet, dtype=str))
        except ImportError as missing:
            raise RuntimeError("reading spreadsheets needs a package that is not installed; save the sheet as CSV") from missing
    return read_csv(spark, path)
