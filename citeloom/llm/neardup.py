"""Near-duplicate documents by SetSketch registers: band, estimate jointly, verify, link.

A document is the set of its distinct shingles (runs of lower-cased words; with fewer words, the
whole sequence). Its sketch has REGISTERS registers: register i is floor(1 - log_b(h)) for the
smallest of the set's hashes h, exponentially distributed with rate RATE and drawn anew for each
i, cut to 0..LEVELS: maxima over elements, so sketches of unions are register-wise maxima, and
registers of similar sets agree.

1. Documents of one and the same set are one class, stood for by its smallest doc_id.
2. Classes that agree in all BAND registers of a band share a bucket. At a similarity of 0.8 a pair
   misses every one of the 32 buckets with a probability of 3 in a million.
3. Every bucket's members are compared with its hub, the member that shares most buckets with
   others: the document that copies were made from agrees with its copies more than they agree with
   each other. A pair goes on if the similarity that maximises the joint likelihood of its
   registers (how many are greater, smaller and equal) is at least DOUBT, over four standard
   deviations below the bound; then the full sets decide. Each class tries its likeliest hub first,
   others only while it is not in the same component.
4. In buckets whose members are still of several components, members outside the largest one are
   compared with all members of other components: in blocks of at most CHUNK by CHUNK, inside
   tasks, each pair in its first common band only. First the sketches alone say which documents may
   have a partner left; then blocks of those, with their texts, are verified, likeliest first, and
   only links leave the task, one for each document and component. So a pair is passed over only if
   its ends are linked already, and pairs are never listed.
5. Links give components, labelled by the smallest doc_id.

Rows of one hot set are combined before any exchange, hot buckets are joined with their hubs by
joins that AQE splits, and tables live in the shared folder. Null or empty texts have no shingle
and are linked with nothing. Null doc_ids take no part: their component is null and they are kept.
Repeated rows get the same answer. Rows of one doc_id with different texts link whatever any of
them links. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import encoding
from .bytewords import Block, blocks, mix, windows
from .common import bounded_batches, components, materialize, pick

REGISTERS = 160
BAND = 5
BASE = 1.001
RATE = 20.0
LEVELS = (1 << 16) - 2
DOUBT = 0.65
CHUNK = 250
PERCENT = 80
#: Up to so many doc_ids (8 bytes each) are sent to all executors; more are joined by a shuffle.
SENT_IDS = 1_000_000
_rng = np.random.Generator(np.random.PCG64(7))
_XOR = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(block: Block, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    a, b, which = block.words
    hashes = block.hashes(a, b)
    keys, of = windows(block, hashes, n)
    keys, of = keys[of >= 0], of[of >= 0]
    edges = np.searchsorted(of, np.arange(len(block) + 1))
    words = np.searchsorted(which, np.arange(len(block) + 1))
    out = []
    for k in range(len(block)):
        own = keys[edges[k] : edges[k + 1]]
        if not len(own) and words[k + 1] > words[k]:
            own = np.array([words[k + 1] - words[k]], np.uint64)
            for h in hashes[words[k] : words[k + 1]]:
                own = mix(own * np.uint64(0xA24BAED4963EE407) + h)
        out.append(np.unique(own))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """The SetSketch of one set of 64-bit hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        y = (x[i : i + 512, None] ^ _XOR) * _MUL
        y ^= y >> np.uint32(15)
        np.minimum(least, y.min(axis=0), out=least)
    h = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, LEVELS + 1).astype("<u2")


def likely_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """For pairs of sketches (rows) and their sets' sizes: the similarity of greatest likelihood, to 0.02."""
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = REGISTERS - above - below
    u = (na / (na + nb))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 51)[None]
    possible = grid <= np.minimum(u / v, v / u) + 1e-9
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - v * grid), p(v - u * grid)
    rest = np.maximum(1 - more - less, 1e-12)
    value = np.where(possible, above * np.log(more) + below * np.log(less) + same * np.log(rest), -np.inf)
    return grid[0, np.argmax(value, axis=1)]


def sketch(docs: DataFrame, shingle_words: int) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_shingles, key (digest of the set), regs; the last two null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding.forget()
        for batch in batches:
            for first, block in blocks(batch.column(1), lower=True):
                sets = shingle_sets(block, shingle_words)
                seen: dict[bytes, bytes] = {}
                keys: list[bytes | None] = []
                regs: list[bytes | None] = []
                for s in sets:
                    if not len(s):
                        keys.append(None)
                        regs.append(None)
                        continue
                    key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if key not in seen:
                        seen[key] = registers(s).tobytes()
                    keys.append(key)
                    regs.append(seen[key])
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(block)), sizes, pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "key", "regs"])

    return docs.mapInArrow(encoding.tidy(run), "doc_id long, n_shingles long, key binary, regs binary")


def _bands() -> Column:
    width = 2 * BAND
    return F.array(*(F.xxhash64(F.lit(i), F.substring("regs", 1 + width * i, width)) for i in range(REGISTERS // BAND)))


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose sketches make the bound possible, with the estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("ra", "rb"))
            value = likely_similarity(ra, rb, na.astype(float), nb.astype(float))
            keep = pa.array((value >= DOUBT) & (100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)))
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(value)], ["a", "b", "estimate"])
            yield out.filter(keep)

    one = classes.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("regs").alias("ra"))
    two = classes.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("regs").alias("rb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(encoding.tidy(run), "a long, b long, estimate double")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text) whose id is in ids (id, distinct)."""
    ids = materialize(ids, "ids").withColumnRenamed("id", "doc_id")
    return docs.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "doc_id")


def verify(pairs: DataFrame, texts: DataFrame, shingle_words: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets reach the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [[s for _, block in blocks(part.column(c), lower=True) for s in shingle_sets(block, shingle_words)] for c in ("ta", "tb")]
                for k, (x, y) in enumerate(zip(*sets, strict=True)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i + k] = 100 * both >= PERCENT * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(encoding.tidy(run), "a long, b long").distinct()


def links(docs: DataFrame, classes: DataFrame, shingle_words: int) -> DataFrame:
    """Verified links between classes (id, n_shingles, regs) that give the same components as all links do, as (id, label)."""
    spark = docs.sparkSession
    members = classes.select("id", F.posexplode(_bands()).alias("band", "bucket"))
    full = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(members.join(full, "bucket"), "members")
    shared = members.groupBy("id").agg(F.sum("n").alias("shared"))
    hub = members.join(shared, "id").groupBy("bucket").agg(F.max_by(F.struct("id"), F.struct("shared", -F.col("id"))).alias("hub"))
    pairs = members.join(hub, "bucket").select(F.col("hub.id").alias("a"), F.col("id").alias("b")).filter("a <> b").distinct()
    tried = materialize(likely(pairs, classes), "candidates")
    ids = tried.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = materialize(texts_of(docs, ids), "texts")

    first = W.partitionBy("b").orderBy(F.col("estimate").desc(), "a")  # a class has at most a hub for each band
    ranked = tried.withColumn("turn", F.row_number().over(first))
    found = materialize(verify(ranked.filter("turn = 1"), texts, shingle_words), "links")
    labels = components(spark, found)

    later = _apart(ranked.filter("turn > 1").select("a", "b"), labels)
    found = materialize(verify(later, texts, shingle_words).unionByName(found), "links")
    labels = components(spark, found)

    found = materialize(leftover_links(docs, members, classes, labels, shingle_words).unionByName(found), "links")
    return components(spark, found)


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in a sorted stream, whole whatever the batches."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        if not rest.num_rows:
            continue
        new = np.zeros(rest.num_rows - 1, bool)
        for k in keys:
            v = rest.column(k).to_numpy()
            new |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield rest.slice(i, j - i)
        rest = rest.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _open_pairs(group: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """In a block: for each minor row, the rows it may link to, likeliest first, with their estimates; rows as numbers."""
    ids, labels, n = (group.column(c).to_numpy() for c in ("id", "label", "n_shingles"))
    minor, side, major = (group.column(c).to_numpy(zero_copy_only=False) for c in ("minor", "side", "major"))
    regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), "<u2").reshape(-1, REGISTERS)
    band = group.column("band")[0].as_py()
    other = np.flatnonzero(side)
    for i in np.flatnonzero(minor & ~side):
        fits = (labels[other] != labels[i]) & (major[other] | (ids[i] < ids[other])) & (100 * np.minimum(n[i], n[other]) >= PERCENT * np.maximum(n[i], n[other]))
        rows = other[fits]
        if not len(rows):
            continue
        same = (regs[rows] == regs[i]).reshape(len(rows), -1, BAND).all(axis=2)
        rows = rows[same.argmax(axis=1) == band]
        if not len(rows):
            continue
        value = likely_similarity(np.broadcast_to(regs[i], (len(rows), REGISTERS)), regs[rows], np.full(len(rows), float(n[i])), n[rows].astype(float))
        rows, value = rows[value >= DOUBT], value[value >= DOUBT]
        if len(rows):
            order = np.argsort(-value, kind="stable")
            yield i, rows[order], value[order]


def leftover_links(docs: DataFrame, members: DataFrame, classes: DataFrame, labels: DataFrame, shingle_words: int) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different components by now; see step 4."""
    own = members.select("id", "band", "bucket").join(labels, "id", "left").select("bucket", "band", "id", F.coalesce("label", "id").alias("label"))
    held = own.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top")).filter("kinds > 1")
    mixed = mixed.select("bucket", "n", F.col("top.label").alias("top"), (F.col("n") - F.col("top.n")).alias("n_minor"))
    mixed = own.join(mixed, "bucket").withColumn("major", F.col("label") == F.col("top"))
    # two classes alone in a bucket are one pair
    two = mixed.filter("n = 2").groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("b")).select("a", "b").distinct()
    two = materialize(likely(two, classes), "pairs")
    blocks_of = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    many = mixed.filter("n > 2").withColumn("left", blocks_of("n_minor")).withColumn("right", blocks_of("n"))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    minor = many.filter("NOT major").select("bucket", "band", "id", "label", "major", place("left").alias("i"), every("right").alias("j"), F.lit(True).alias("minor"), F.lit(False).alias("side"))
    other = many.select("bucket", "band", "id", "label", "major", every("left").alias("i"), place("right").alias("j"), F.lit(False).alias("minor"), F.lit(True).alias("side"))
    keys = ["bucket", "i", "j"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def in_blocks(rows: DataFrame) -> DataFrame:
        return rows.join(classes.select("id", "n_shingles", "regs"), "id").repartition(parts, *keys).sortWithinPartitions(*keys, "side", "id")

    names = ["bucket", "band", "id", "label", "major", "i", "j", "minor", "side"]

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, *keys):
            hit = np.zeros(group.num_rows, bool)
            for i, rows, _ in _open_pairs(group):
                hit[i] = True
                hit[rows] = True
            if hit.any():
                yield from group.select(names).filter(pa.array(hit)).combine_chunks().to_batches()

    kinds = "bucket long, band int, id long, label long, major boolean, i int, j int, minor boolean, side boolean"
    left = materialize(in_blocks(minor.unionByName(other)).mapInArrow(encoding.tidy(possible), kinds), "possible")
    ids = left.select("id").unionByName(two.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    texts = materialize(texts_of(docs, ids), "texts")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, *keys):
            sets = [s for _, block in blocks(group.column("text"), lower=True) for s in shingle_sets(block, shingle_words)]
            ids, labels, out = group.column("id").to_pylist(), group.column("label").to_pylist(), []
            for i, rows, _ in _open_pairs(group):
                known = set()
                for r in rows:
                    if labels[r] in known:
                        continue
                    both = len(np.intersect1d(sets[i], sets[r], assume_unique=True))
                    if 100 * both >= PERCENT * (len(sets[i]) + len(sets[r]) - both):
                        known.add(labels[r])
                        out.append((ids[i], ids[r]))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    found = in_blocks(left.join(texts.withColumnRenamed("doc_id", "id"), "id")).mapInArrow(encoding.tidy(settle), "a long, b long")
    return found.unionByName(verify(two, texts, shingle_words)).distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs that are not in one component yet."""
    la = labels.select(F.col("id").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    out = pairs.join(la, "a", "left").join(lb, "b", "left")
    return out.filter("coalesce(la, a) <> coalesce(lb, b)").select("a", "b")


def near_duplicates(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_shingles, component_id, kept."""
    bounded_batches(docs.sparkSession)
    docs = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sketches = materialize(sketch(docs, shingle_words), "sketches")
    sets = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(sets.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs")), "classes")
    labels = links(docs, classes.select("id", "n_shingles", "regs"), shingle_words)
    by_key = materialize(classes.select("key", "id").join(labels, "id", "left").select("key", F.coalesce("label", "id").alias("label")), "labels")
    out = sketches.select("doc_id", "n_shingles", "key").join(by_key, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids (doc_id, distinct); columns are kept."""
    ids = materialize(ids.select(F.col("doc_id").alias("_gone")), "gone")
    small = ids.count() <= SENT_IDS
    return docs.join(F.broadcast(ids) if small else ids, docs["doc_id"] == ids["_gone"], "left_anti")


def op6_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over 2-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=2)


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
h AS MATERIALIZED (SELECT doc_id, hash(g) AS g, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS k FROM e JOIN (SELECT g, count(*) AS f FROM e GROUP BY g) USING (g)),
p AS (SELECT doc_id, h.g FROM h JOIN n USING (doc_id) WHERE k <= n.n - ceil(0.8::DOUBLE * n.n) + 1),
c AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id),
j AS (SELECT a, b, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) AS t FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b),
l AS MATERIALIZED (SELECT a, b FROM j WHERE 100 * i >= 80 * (t - i) UNION ALL SELECT b, a FROM j WHERE 100 * i >= 80 * (t - i)),
r AS (WITH RECURSIVE r(doc_id, x) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.x FROM r JOIN l ON l.a = r.doc_id) SELECT doc_id, min(x) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN r USING (doc_id)
"""
