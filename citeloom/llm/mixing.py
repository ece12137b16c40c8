"""Mixing sources to target weights as a time-varying curriculum, by DataFrame operations alone.

Each source has a share of the training words and a schedule: a piecewise-linear weight over
training time 0 to 1, scaled so that its integral over all time is the source's share. A source's
demand up to time t is the integral of its schedule up to t. Its words, in a fixed pseudo-random
order of its documents and repeated when the target exceeds the source, are consumed by that
demand; inverting the cumulative demand at a document's first word gives the document's training
position. The result is range-sorted by position.

Targets: sources by code point (null last) weigh WEIGHTS in turn and share all words; a source
stops at MAX_REPEATS times its size and the excess is shared by weight among the rest, until none
is above. Each document is taken as many whole times as the target holds its source; the last,
partial pass takes documents in order until the target is met, the last one in part. So a
source's taken words equal its target rounded to a whole number.

Skew: words are counted once and stored as narrow rows. Documents of one source, id and size are
alike to the mix: they are one row with a count before any running sum, so an id that is null or
repeats in a third of all rows is no larger a key than its sizes are many. Running sums are taken
within buckets of the order key, a number of buckets that grows with the table, and over the
buckets' sums; a source that holds most rows is split like any other. Rows are dealt out again in
runs of at most RUN of one key.

Null text has size 0, a long one is counted whole; null source is a source of its own; null doc_ids
count as equal. Rows that repeat are documents of their own. Ties in the order, which only rows of
one doc_id have, go by size; rows equal in both are interchangeable. A document of size 0 takes
nothing and has no position. With no words at all every target is 0. Columns beyond doc_id, text and
source don't matter, whatever their names. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, pick

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Knots (time, relative weight) of the schedules, in turn like WEIGHTS: early, level, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 0.5), (1.0, 2.75)))
ROWS_A_BUCKET = 10_000
RUN = 10_000
PARTS = 1_000_000_000  # positions are whole billionths of the training run


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def segments(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float]]:
    """(start time, length, weight at start and end, cumulative demand at start) of each segment, the integral scaled to 1."""
    if knots[0][0] != 0 or knots[-1][0] != 1 or any(v < 0 for _, v in knots):
        raise ValueError(f"knots must run from 0 to 1 with weights of 0 or more: {knots}")
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total, out, done = sum(area), [], 0.0
    for (a, b), x in zip(zip(knots, knots[1:], strict=False), area, strict=True):
        out.append((a[0], b[0] - a[0], a[1] / total, b[1] / total, done))
        done += x / total
    return out


def inverse_sql(share: str, knots: tuple[tuple[float, float], ...]) -> str:
    """SQL for the time at which a schedule's cumulative demand reaches share (0 to 1)."""
    parts = segments(knots)
    out = ""
    for k, (t, length, v0, v1, done) in enumerate(parts):
        slope = (v1 - v0) / length
        d = lambda x: f"CAST('{x!r}' AS DOUBLE)"
        rest = f"({share} - {d(done)})"
        time = f"{d(t)} + {d(2.0)} * {rest} / ({d(v0)} + sqrt({d(v0 * v0)} + {d(2 * slope)} * {rest}) + {d(1e-300)})"
        out += f" WHEN {share} < {d(parts[k + 1][4])} THEN {time}" if k + 1 < len(parts) else f" ELSE {time} END"
    return f"CASE{out}" if len(parts) > 1 else time


def source_targets(keys: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A row per source: source, turn, n_keys, source_size, target. keys: source, size, n (documents of that size).

    Sorted by how soon they are full, the full sources come first: one is full if its cap over its
    weight is at most what is left for it and those after it, over their weight. Windows here run
    over one row per source.
    """
    per = keys.groupBy("source").agg(F.count(F.lit(1)).alias("n_keys"), F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("turn", turn.cast("int"))
    per = per.withColumn("weight", F.element_at(F.array(*(F.lit(int(w)) for w in weights)), F.col("turn") + 1).cast("long"))
    per = per.withColumn("cap", F.lit(int(max_repeats)) * F.col("source_size")).withColumn("total", F.sum("source_size").over(W.partitionBy()))
    order = [F.col("cap").cast("double") / F.col("weight"), F.col("source").asc_nulls_last()]
    before, onward = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1), W.orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    per = per.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    per = per.withColumn("full", F.col("cap") * F.sum("weight").over(onward) <= F.col("weight") * F.col("left"))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(W.partitionBy()), F.lit(0))
    shared = F.sum(F.when(~F.col("full"), F.col("weight"))).over(W.partitionBy())
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("weight") * rest).cast("double") / shared)
    return per.select("source", "turn", "n_keys", "source_size", target.alias("target"))


def _keys(rows: DataFrame) -> DataFrame:
    """rows: doc_id, source, size. One row for all that are equal, with their number n."""
    return materialize(rows.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")), "keys")


def _decide(keys: DataFrame, weights: tuple[int, ...], max_repeats: int, rows_a_bucket: int) -> DataFrame:
    """keys: doc_id, source, size, n. Adds the source's numbers (turn, source_size, target, goal, whole) and the words before the first of the n."""
    keys = keys.withColumn("draw", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    targets = materialize(source_targets(keys, weights, max_repeats), "targets")
    rows = targets.agg(F.sum("n_keys")).first()[0] or 0
    digits = 2
    while 16**digits * rows_a_bucket < rows:
        digits += 1
    keys = keys.withColumn("bucket", F.substring("draw", 1, digits)).withColumn("held", F.col("size") * F.col("n"))
    per = keys.groupBy("source", "bucket").agg(F.sum("held").alias("all"))
    per = per.withColumn("base", F.sum("all").over(W.partitionBy("source").orderBy("bucket")) - F.col("all"))
    inside = W.partitionBy("source", "bucket").orderBy("draw", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, 0)
    keys = keys.withColumn("own", F.sum("held").over(inside) - F.col("held"))
    per = per.select(F.col("source").alias("s1"), F.col("bucket").alias("b1"), "base")
    keys = keys.join(per, (F.col("bucket") == F.col("b1")) & F.col("source").eqNullSafe(F.col("s1"))).drop("s1", "b1")
    targets = targets.withColumnRenamed("source", "s2")
    keys = keys.join(targets, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    keys = keys.withColumn("before", (F.col("base") + F.col("own")).cast("long"))
    keys = keys.withColumn("goal", F.floor(F.col("target") + F.lit(0.5)).cast("long"))
    whole = F.least(F.lit(int(max_repeats)).cast("long"), F.expr("CASE WHEN source_size > 0 THEN goal DIV source_size ELSE 0 END"))
    return materialize(keys.withColumn("whole", whole), "decided")


def _taken(rows: DataFrame) -> DataFrame:
    """rows of _decide, before being that of each document: adds part (words of the last, partial pass) and taken."""
    part = F.greatest(F.lit(0), F.least(F.col("goal") - F.col("whole") * F.col("source_size") - F.col("before"), F.col("size")))
    rows = rows.withColumn("part", part.cast("long"))
    return rows.withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))


def position(first_word: str, schedules) -> Column:
    """SQL for the training position, in whole billionths, of a word of the row's source in its order of consumption."""
    share = f"(CAST({first_word} AS DOUBLE) / CAST(goal AS DOUBLE))"
    at = " ".join(f"WHEN {k} THEN {inverse_sql(share, knots)}" for k, knots in enumerate(schedules))
    return F.expr(f"CASE WHEN taken > 0 THEN CAST(floor(CAST('{PARTS}' AS DOUBLE) * (CASE turn % {len(schedules)} {at} END)) AS BIGINT) END")


def _in_order(rows: DataFrame, last: str) -> DataFrame:
    order = [F.col("position_ppb").asc_nulls_last(), F.col("doc_id").asc_nulls_first(), F.col(last)]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules=SCHEDULES, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """docs: doc_id, text, source. Returns doc_id, size, source_size, target, taken, position_ppb (of the first copy), in order of position."""
    rows = pick(docs, doc_id="doc_id", text="text", source="source")
    keys = _decide(_keys(rows.select("doc_id", "source", _size().alias("size"))), weights, max_repeats, rows_a_bucket)
    runs = keys.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    if (keys.agg(F.max("n")).first()[0] or 0) > RUN:  # a key's runs go to different tasks
        runs = runs.repartition(F.xxhash64("source", "doc_id", "size", "run"))
    rows = runs.withColumn("place", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("run") * RUN + RUN, "n") - 1)))
    rows = _taken(rows.withColumn("before", F.col("before") + F.col("place") * F.col("size")))
    return _in_order(rows.select("doc_id", "size", "source_size", "target", "taken", position("before", schedules).alias("position_ppb"), "place"), "place").drop("place")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules=SCHEDULES, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """The mix itself, with the columns of docs: a row for every time a document is taken, whole, in order of training position.

    Equal keys' documents are told apart by row number, counted in parts of their rows so that no key is one task's.
    """
    names = docs.columns
    flat = docs.toDF(*(f"_c{i}" for i in range(len(names)))).withColumn("_row", F.monotonically_increasing_id())
    flat = materialize(flat, "documents")  # fixes the row numbers
    named = flat.toDF(*names, "_row")
    rows = pick(named, doc_id="doc_id", text="text", source="source", row="_row").select("row", "doc_id", "source", _size().alias("size"))
    rows = materialize(rows, "sizes")
    keys = _decide(_keys(rows.select("doc_id", "source", "size")), weights, max_repeats, rows_a_bucket)
    keys = keys.withColumns({"k_source": F.col("source"), "k_id": F.col("doc_id"), "k_size": F.col("size")}).drop("source", "doc_id", "size", "draw", "bucket", "held", "base", "own")
    same = F.col("source").eqNullSafe(F.col("k_source")) & F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("size") == F.col("k_size"))
    rows = materialize(rows.join(keys, same).drop("k_source", "k_id", "k_size"), "placed")
    once, more = rows.filter("n = 1").withColumn("place", F.lit(0).cast("long")), rows.filter("n > 1")
    key = ["source", "doc_id", "size", "run"]
    more = materialize(more.withColumn("run", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / RUN))), "repeats")
    held = more.groupBy(*key).agg(F.count(F.lit(1)).alias("held"))
    held = held.withColumn("first", F.sum("held").over(W.partitionBy(*key[:3]).orderBy("run")) - F.col("held")).drop("held")  # a row for each RUN rows
    held = held.select("first", *(F.col(c).alias(f"h_{c}") for c in key))
    more = more.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy("row")) - 1)
    more = more.join(held, F.col("source").eqNullSafe(F.col("h_source")) & F.col("doc_id").eqNullSafe(F.col("h_doc_id")) & (F.col("size") == F.col("h_size")) & (F.col("run") == F.col("h_run")))
    more = more.withColumn("place", (F.col("place") + F.col("first")).cast("long")).drop("run", "first", *(f"h_{c}" for c in key))
    rows = _taken(once.unionByName(more).withColumn("before", F.col("before") + F.col("place") * F.col("size")))
    copies = F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)
    rows = rows.filter("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    rows = rows.select("row", "doc_id", position("(copy * source_size + before)", schedules).alias("position_ppb"))
    out = _in_order(flat.join(rows, flat["_row"] == rows["row"]), "row")
    return out.select(*(f"_c{i}" for i in range(len(names)))).toDF(*names)


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to the standard weights."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql(documents: str = "documents") -> str:
    share = "(before::DOUBLE / goal::DOUBLE)"
    at = " ".join(f"WHEN {k} THEN {inverse_sql(share, knots)}" for k, knots in enumerate(SCHEDULES))
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS draw
  FROM {documents}),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS turn, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s0),
s2 AS (SELECT *, CASE turn WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s1),
s3 AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY cap::DOUBLE / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM s2),
s4 AS (SELECT *, cap * onward <= weight * rest AS is_full FROM s3),
s5 AS (SELECT source, turn, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE
         (weight * (total - coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0)))::DOUBLE / (sum(weight) FILTER (WHERE NOT is_full) OVER ())::DOUBLE END AS target FROM s4),
r AS (SELECT d.doc_id, d.size, s5.turn, s5.source_size, s5.target, floor(s5.target + 0.5::DOUBLE)::BIGINT AS goal,
        (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS before
      FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
w AS (SELECT *, least(3, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END) AS whole FROM r),
t AS (SELECT *, (whole * size + greatest(0, least(goal - whole * source_size - before, size)))::BIGINT AS taken FROM w)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN floor({PARTS}::DOUBLE * (CASE turn % 3 {at} END))::BIGINT END AS position_ppb
FROM t"""


ORACLE_SQL = oracle_sql()
