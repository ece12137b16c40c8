"""Quality rules: base rules, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Every document's words, and pairs of adjacent words, are hashed into BUCKETS features. Two
multinomials are estimated over the features: one of the raw corpus, from every document, and one
of the trusted target, from documents labelled good. A document's score is the mean over its
features of log(p_target / p_raw), so length cancels out. Documents below the threshold are
rejected, each by the same rule.

The trusted target and the threshold are fitted on at most LABELLED labelled documents, those
first by hash of doc_id, one for each id (where an id repeats, the text of the greatest hash);
everything else covers the whole corpus. Half of the sample gives the
target's counts; the other half gives the threshold: the score that loses least, where a share of
good documents rejected weighs GOOD_WEIGHT times as much as a share of bad ones kept; of equal ones
the lowest. Without good labels, or without bad ones to set a threshold against, the method keeps
every document.

Base rules: fewer than MIN_WORDS words, or more than MAX_REPEATED percent of the words in repeated
5-word windows, fail. Null and empty texts have no words and fail. Score of a text without words:
0. Repeated rows are judged alike, ties with the threshold are kept, and texts of any length are read
whole. Null doc_ids are judged but have no label; labels without an id or a quality don't count.
Columns whose names clash are kept as they are. An empty table gives no row. Counts that tasks send on are a row
for each feature at most, whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding
from .bytewords import Block, blocks, mix, repeats, windows
from .common import bounded_batches, materialize, pick

BUCKETS = 1 << 16
LABELLED = 20_000
SMOOTHING = 0.5
GOOD_WEIGHT = 10
MIN_WORDS = 10
MAX_REPEATED = 20
WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every word and every pair of adjacent words."""
    a, b, which = block.words
    hashes = block.hashes(a, b)
    pairs, of = windows(block, hashes, 2)
    inside = of >= 0
    keys = np.concatenate([hashes, mix(pairs[inside])])
    return (keys % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([which, of[inside]])


def measures(block: Block) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    a, b, which = block.words
    n = len(block)
    hashes = block.hashes(a, b)
    points = ((block.data & 0xC0) != 0x80) & ~block.separators
    la, lb, lines_of = block.lines
    inside = np.concatenate([[0], np.cumsum(~block.separators, dtype=np.int64)])
    full = inside[lb] > inside[la]
    _, later = repeats(lines_of[full], block.hashes(la[full], lb[full]))
    keys, of = windows(block, hashes, WINDOW)
    own = np.flatnonzero(of >= 0)
    again, _ = repeats(of[own], keys[own])
    change = np.zeros(len(a) + 1, np.int64)
    hit = own[again]
    np.add.at(change, hit, 1)
    np.add.at(change, hit + WINDOW, -1)
    covered = np.cumsum(change[:-1]) > 0
    return {
        "n_words": np.bincount(which, minlength=n),
        "word_chars": block.per_text(points),
        "n_symbols": block.per_text(_SYMBOL[block.data]),
        "n_dup_lines": np.bincount(lines_of[full][later], minlength=n),
        "n_repeat_words": np.bincount(which[covered], minlength=n),
    }


def feature_counts(texts: DataFrame) -> np.ndarray:
    """How often each feature occurs in all texts (one column). The result has BUCKETS numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding.forget()
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, block in blocks(batch.column(0)):
                total += np.bincount(features(block)[0], minlength=BUCKETS)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["feature", "n"])

    rows = texts.mapInArrow(encoding.tidy(count), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[np.asarray(rows.column("feature"))] = np.asarray(rows.column("n"))
    return out


def scores(block: Block, ratio: np.ndarray) -> np.ndarray:
    feature, which = features(block)
    n = np.bincount(which, minlength=len(block))
    return np.bincount(which, weights=ratio[feature], minlength=len(block)) / np.maximum(n, 1)


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The score from which on texts count as good: losing good ones weighs GOOD_WEIGHT times as much as keeping bad ones."""
    if not len(good) or not len(bad):
        return -np.inf
    cuts = np.unique(np.concatenate([good, bad]))
    right = -GOOD_WEIGHT * np.searchsorted(np.sort(good), cuts) / len(good) + np.searchsorted(np.sort(bad), cuts) / len(bad)
    at = int(np.argmax(right))  # the lowest of equal ones
    return float(cuts[at] if at == 0 else (cuts[at] + cuts[at - 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[np.ndarray, float]:
    """(log ratio of each feature, threshold). docs: doc_id, text. labels: doc_id, quality."""
    raw = feature_counts(docs.select("text"))
    chosen = pick(labels, doc_id="doc_id", quality="quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL").distinct()
    chosen = chosen.withColumn("draw", F.xxhash64("doc_id")).orderBy("draw", "doc_id", "quality").limit(labelled)
    texts = docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("quality", (F.col("draw") % 2 == 0).alias("counts"), "text")

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text: its features and their counts, which a bounded sample bounds."""
        for batch in batches:
            quality, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, block in blocks(batch.column(2)):
                feature, which = features(block)
                order = np.argsort(which, kind="stable")
                feature, edges = feature[order].astype(np.uint32), np.searchsorted(which[order], np.arange(len(block) + 1))
                rows = slice(first, first + len(block))
                raw_ids = [feature[edges[k] : edges[k + 1]].tobytes() for k in range(len(block))]
                yield pa.RecordBatch.from_arrays([pa.array(quality[rows], pa.int32()), pa.array(counts[rows]), pa.array(raw_ids, pa.binary())], ["quality", "counts", "features"])

    target = np.zeros(BUCKETS, np.int64)
    held = materialize(sample.mapInArrow(summarize, "quality int, counts boolean, features binary"), "labelled")
    fitting = held.filter("quality = 1 AND counts").select("features")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x, np.uint32), minlength=BUCKETS)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["feature", "n"])

    rows = fitting.mapInArrow(add, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    target[np.asarray(rows.column("feature"))] = np.asarray(rows.column("n"))
    if not target.sum():
        return np.zeros(BUCKETS), -np.inf
    share = lambda n: (n + SMOOTHING) / (n.sum() + SMOOTHING * BUCKETS)
    ratio = np.log(share(target) / share(raw))
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [float(sent.value[x].mean()) if len(x) else 0.0 for x in (np.frombuffer(x, np.uint32) for x in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["quality", "score"])

    tested = held.filter("NOT counts").select("quality", "features").mapInArrow(score, "quality int, score double").toArrow()
    quality, value = np.asarray(tested.column("quality")), np.asarray(tested.column("score"))
    return ratio, best_threshold(value[quality == 1], value[quality == 0])


def judge(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """docs: doc_id, text and any columns, which are kept. Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    bounded_batches(docs.sparkSession)
    plain = pick(docs, doc_id="doc_id", text="text")
    ratio, threshold = fit(plain, labels, labelled)
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, block in blocks(batch.column(0)):
                m, value = measures(block), scores(block, sent.value)
                failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])
                own = [c.slice(first, len(block)) for c in batch.columns[1:]]
                counts = [pa.array(x.astype(np.int64)) for x in m.values()]
                yield pa.RecordBatch.from_arrays([*own, *counts, pa.array(failed), pa.array(value), pa.array(~failed & (value >= threshold))], [f"c{i}" for i in range(len(own) + 8)])

    names = docs.columns
    flat = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    at = names.index("text") if "text" in names else [x.lower() for x in names].index("text")
    kinds = ", ".join(f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    more = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = flat.select(F.col(f"_c{at}").alias("_text"), *flat.columns).mapInArrow(encoding.tidy(decide), f"{kinds}, {', '.join(f'{x} long' for x in more)}, base_failed boolean, score double, kept boolean")
    return out.toDF(*names, *more, "base_failed", "score", "kept")


def op3_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    out = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
