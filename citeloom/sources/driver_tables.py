"""Citation tables derived from the star schema: customers cite orders, orders parts, parts suppliers, and so on.

The whole tables take part. Ids carry a letter for their kind, so all nodes share one id space.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph
from ..storage import at_release, forget, stored

_kept: dict[tuple[str, str, str], tuple[tuple, DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(letter: str, column: str, name: str):
    return F.concat(F.lit(letter), F.col(column).cast("string")).alias(name)


#: A node's number: its kind's place in KINDS above KEY_BITS bits of key. Kinds are ranges, and what is cited has the smaller numbers.
KINDS = "RNSPOC"
KEY_BITS = 56


def number(letter: str, column: str) -> Column:
    key = F.col(column).cast("long")
    return F.when(key.isNull() | key.between(0, (1 << KEY_BITS) - 1), key + F.lit(KINDS.index(letter) << KEY_BITS)).otherwise(F.raise_error(F.lit(f"{column} is no key of {KEY_BITS} bits")))


def node_range(letter: str) -> tuple[int, int]:
    """The smallest and the largest number that a node of this kind can have."""
    first = KINDS.index(letter) << KEY_BITS
    return first, first + (1 << KEY_BITS) - 1


def name_of(node: str | Column) -> Column:
    """The id of a node's number."""
    n = F.col(node) if isinstance(node, str) else node
    return F.concat(F.substring(F.lit(KINDS), (F.shiftright(n, KEY_BITS) + 1).cast("int"), F.lit(1)), n.bitwiseAND(F.lit((1 << KEY_BITS) - 1)).cast("string"))


def number_of(node: str) -> Column:
    """The number of a node's id."""
    return F.shiftleft((F.instr(F.lit(KINDS), F.substring(node, 1, 1)) - 1).cast("long"), KEY_BITS) + F.expr(f"substring({node}, 2)").cast("long")


def named(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: name_of(c) for c in columns})


def raw_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_edges on numbers; pairs may repeat."""

    def pairs(name: str, of: str, src: str, to: str, dst: str) -> DataFrame:
        return table(spark, sf_dir, name).filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(number(of, src).alias("src"), number(to, dst).alias("dst"))

    out = pairs("lineitem", "O", "l_orderkey", "P", "l_partkey").unionByName(pairs("lineitem", "P", "l_partkey", "S", "l_suppkey"))
    out = out.unionByName(pairs("supplier", "S", "s_suppkey", "N", "s_nationkey")).unionByName(pairs("nation", "N", "n_nationkey", "R", "n_regionkey"))
    return out.unionByName(pairs("orders", "C", "o_custkey", "O", "o_orderkey"))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (src, dst) of all tables. Pairs are made distinct as numbers, before they get their letters; kinds share no pair."""

    def pairs(name: str, of: str, src: str, to: str, dst: str) -> DataFrame:
        rows = table(spark, sf_dir, name).select(F.col(src).alias("s"), F.col(dst).alias("d")).filter("s IS NOT NULL AND d IS NOT NULL").distinct()
        return rows.select(_id(of, "s", "src"), _id(to, "d", "dst"))

    out = pairs("lineitem", "O", "l_orderkey", "P", "l_partkey").unionByName(pairs("lineitem", "P", "l_partkey", "S", "l_suppkey"))
    out = out.unionByName(pairs("supplier", "S", "s_suppkey", "N", "s_nationkey")).unionByName(pairs("nation", "N", "n_nationkey", "R", "n_regionkey"))
    return out.unionByName(pairs("orders", "C", "o_custkey", "O", "o_orderkey"))


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, made once per session and state of the tables. When a table changes, it is made anew and the old files go."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    state = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))
    key = (spark.sparkContext.applicationId, sf_dir, name)
    was = _kept.get(key)
    if was is None or was[0] != state:
        _kept[key] = (state, make())
        if was is not None and hasattr(was[1], "_stored_at"):
            forget(was[1])
    return _kept[key][1]


def _drop(spark: SparkSession) -> None:
    """Frames whose files go with the session's folder are made anew when they are asked for again."""
    for key in [k for k in _kept if k[0] == spark.sparkContext.applicationId]:
        del _kept[key]


at_release.append(_drop)


def stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_edges, made once, for queries that read them more than once or in part."""
    return kept(spark, sf_dir, "raw", lambda: stored(raw_edges(spark, sf_dir), "raw"))


def clean_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned graph on numbers; every role query starts from its files."""
    return kept(spark, sf_dir, "clean", lambda: graph.clean_graph(raw_numbers(spark, sf_dir), name_of))


def clean_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned graph."""
    return named(clean_numbers(spark, sf_dir), "src", "dst")


def clean_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The degrees of the cleaned graph, on numbers."""
    return kept(spark, sf_dir, "degrees", lambda: stored(graph.degrees(clean_numbers(spark, sf_dir)), "degrees"))


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (a number), year of the nodes that have one."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    newest = table(spark, sf_dir, "customer").join(orders.groupBy("o_custkey").agg(F.max("year").alias("year")), F.col("c_custkey") == F.col("o_custkey"))
    return orders.select(number("O", "o_orderkey").alias("id"), "year").unionByName(newest.select(number("C", "c_custkey").alias("id"), "year")).filter("year IS NOT NULL")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, abstract, journal, source_title, year, cited_by of every node."""
    none = F.lit(None)
    columns = ("title", "abstract", "journal", "source_title")

    def rows(df: DataFrame, letter: str, key: str, title, abstract=none, journal=none, year=none, cited=none) -> DataFrame:
        texts = [c.cast("string").alias(n) for c, n in zip((title, abstract, journal, none), columns, strict=True)]
        return df.select(_id(letter, key, "id"), *texts, year.cast("int").alias("year"), cited.cast("double").alias("cited_by"))

    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders").withColumn("y", F.year("o_orderdate"))
    newest = orders.groupBy("o_custkey").agg(F.max("y").alias("y"))
    customers = t("customer").join(newest, F.col("c_custkey") == F.col("o_custkey"), "left")
    out = rows(customers, "C", "c_custkey", F.col("c_name"), F.col("c_mktsegment"), F.col("c_mktsegment"), F.col("y"), F.greatest(F.lit(0.0), F.rint("c_acctbal")))
    more = (
        rows(orders, "O", "o_orderkey", F.col("o_orderpriority"), F.col("o_orderstatus"), year=F.col("y"), cited=F.rint("o_totalprice")),
        rows(t("part"), "P", "p_partkey", F.col("p_name"), F.concat_ws(" ", "p_type", "p_brand"), F.col("p_brand"), cited=F.rint("p_retailprice")),
        rows(t("supplier"), "S", "s_suppkey", F.col("s_name"), cited=F.greatest(F.lit(0.0), F.rint("s_acctbal"))),
        rows(t("nation"), "N", "n_nationkey", F.col("n_name")),
        rows(t("region"), "R", "r_regionkey", F.col("r_name")),
    )
    for m in more:
        out = out.unionByName(m)
    return out


def event_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): within an hour, from each event's user to the next event's; nodes are user and hour, and may repeat."""
    hour = F.date_trunc("hour", F.col("ts"))
    node = F.concat_ws("@", F.col("user_id").cast("string"), F.date_format(hour, "yyyyMMddHH"))
    nxt = F.lead(node).over(W.partitionBy(hour).orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(node.alias("src"), nxt.alias("dst")).filter("dst IS NOT NULL")


def part_papers(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """The n parts that most orders cite: doc, citations."""
    cited = table(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL AND l_partkey IS NOT NULL").select("l_orderkey", "l_partkey").distinct()
    cited = cited.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("citations")).select(_id("P", "l_partkey", "doc"), "citations")
    return kept(spark, sf_dir, f"papers {n}", lambda: stored(cited.orderBy(F.col("citations").desc(), F.col("doc").desc()).limit(n), "papers"))
