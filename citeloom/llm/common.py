"""What the training-data operators share: column picking, shared storage, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import forget, scratch, stored

__all__ = ["WORD", "bounded_batches", "components", "forget", "materialize", "pick", "scratch", "sent", "table"]

#: Separators between words: the space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Batches sent to Python hold 8 MB at most, so long texts don't pile up in a worker; a lower setting stays."""
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
    found = spark.conf.get(key, None)
    if found is None or not found.isdigit() or not 0 < int(found) <= most:
        spark.conf.set(key, str(most))


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Select columns by position, so extra columns whose names clash do no harm.

    ``wanted`` maps new names to old ones. An exact name wins over one that differs in case;
    of equal names the first counts.
    """
    names = df.columns
    flat = df.toDF(*(f"_c{i}" for i in range(len(names))))

    def place(name: str) -> int:
        if name in names:
            return names.index(name)
        low = [x.lower() for x in names]
        if name.lower() in low:
            return low.index(name.lower())
        raise ValueError(f"column {name!r} is missing; there are {names}")

    return flat.select(*(F.col(f"_c{place(old)}").alias(new) for new, old in wanted.items()))


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs nothing."""
    return stored(df, name, **{"compression": "zstd"} | options)


#: A join's side of up to so many bytes, counted in rows of known width, is sent to all executors; a larger one is shuffled.
SENT_BYTES = 32 << 20


def sent(df: DataFrame, name: str = "side") -> DataFrame:
    """df, stored, as a join's small side where it is small. Its columns must be of fixed width: their bytes times the rows are the bound."""
    df = materialize(df, name)
    return F.broadcast(df) if df.count() * df._jdf.schema().defaultSize() <= SENT_BYTES else df


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Label every vertex of the undirected links (a, b) with the smallest vertex it reaches.

    Min-label propagation with pointer jumping; every round is written to the shared folder.
    Returns (id, label). Stars and short chains, the usual shape of copies, need two or three rounds.
    """
    both = materialize(
        links.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("w"))).distinct(), "edges"
    )
    labels = last = materialize(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("label").alias("near"))
        step = labels.join(heard, "v", "left").select("v", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        to = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        step = materialize(step.join(to, "label", "left").select("v", "was", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        forget(last)
        last, labels = step, step.select("v", "label")
        if step.filter("was <> label").isEmpty():
            return labels.withColumnRenamed("v", "id")
