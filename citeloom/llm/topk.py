"""Exact top-k by inner product: pivot-table elimination in bound order, with exact stopping.

Pivots are the origin and up to PIVOTS vectors. The distances of every vector to them are computed
once and stored as its apex: its coordinates in the span of the pivots, which the distances fix,
and its distance from that span. Given all of a query's and a candidate's pivot distances, the
largest lower bound that they allow for the distance of the two is the distance of their apexes (it
is never below |d(q,p) - d(x,p)| for any one pivot p). With <q,x> = (|q|^2 + |x|^2 - d(q,x)^2) / 2
that makes the inner product of the apexes an upper bound of the score. Bounds carry a margin for
rounding.

Table. Vectors are range-sorted by nearest pivot and distance to it, and stored in chunks of about
CHUNK_ROWS rows, at most MAX_CHUNKS in all, made of blocks of BLOCK rows. Every block and chunk has
the box of its apexes, which bounds the scores of all its rows at once.

Search. Each query sorts the chunks by bound and visits them in that order, in rounds of growing
numbers: the best chunk first, then LOOK_AHEAD - 1 more, and so on. After a round its floor is the
k-th score found so far; chunks whose bound is below it are never asked, and a query with none left
is done. Queries travel to chunks as data, PACK of one chunk together, and are dealt over further
tasks where many ask for one chunk, so a task holds one chunk and one pack, however many queries
there are. Within a chunk blocks whose bound is below the floor are skipped, and the rows of the
others are evaluated in the order of their bounds until these fall below the floor.

The pivots are fitted on SAMPLE distinct vectors, first by hash: each is the one farthest from the
span of those before it. Everything else covers every row.

Vectors become whole numbers first: floor(scale * x), x as double. Vectors that are null or hold
null or non-finite components take no part, neither as queries nor as candidates. Vectors of
different lengths compare over the components both have. Repeated rows are separate candidates, but
equal rows (vec_id and vector) are one query; rows of one vec_id and different vectors are a query
each. Only the query's own row is no candidate of it: other rows of its vec_id are, and so are
further copies of it. Ties go to the smaller vec_id.
Null ids take no part. Columns beyond vec_id and embedding don't matter. Scores beyond 64 bits raise
an error. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, pick

PIVOTS = 48
SAMPLE = 4096
BLOCK = 1024
CHUNK_ROWS = 131_072
MAX_CHUNKS = 16_384
LEAST_CHUNKS = 24  # of a small table, so that a search has as many tasks
PACK = 64
PACKS_A_TASK = 64
LOOK_AHEAD = 8
STEP, MOST_STEP = 64, 1024  # candidates a query evaluates between two looks at its bound, at first and at most
SLACK = 1e-5  # of |q| |x|: bounds in 32-bit floats are off by less than 4e-6 of it at 48 pivots
_KINDS = "chunk int, salt int, kind int, no long, ids binary, tags binary, vectors binary, apexes binary, floors binary"


def whole_numbers(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v (array of long) of the vectors that take part."""
    rows = pick(vectors, vec_id="vec_id", v="embedding").filter("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return rows.filter(fine).select("vec_id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, padded with zeros to one width."""
    n = len(column)
    flat, size = np.asarray(column.flatten()), np.asarray(pa.compute.list_value_length(column))
    if n and (size == width).all():
        return flat.reshape(n, width).astype(np.int64)
    out = np.zeros((n, width), np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    for i in range(n):
        out[i, : size[i]] = flat[at[i] : at[i + 1]]
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floats or doubles while every partial sum fits their 24 or 53 bits, else in whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    out = a.astype(object) @ b.astype(object).T
    if max((abs(x) for x in out.flat), default=0) >= 2**63:
        raise OverflowError("a score is beyond 64 bits")
    return out.astype(np.int64)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of sample, each the one farthest from the span of the origin and those before it; fewer where that span holds all."""
    rest, chosen = sample.astype(np.float64), []
    left = (rest * rest).sum(axis=1)
    least = 1e-6 * left.max(initial=0)
    for _ in range(min(count, sample.shape[1])):
        k = int(np.argmax(left)) if len(left) else 0
        if not len(left) or left[k] <= least:
            break
        chosen.append(k)
        axis = rest[k] / np.sqrt(left[k])
        rest = rest - np.outer(rest @ axis, axis)
        left = (rest * rest).sum(axis=1)
    return sample[chosen]


class Pivots:
    """Distances to the pivots, and the apexes that follow from them."""

    def __init__(self, vectors: np.ndarray, wide: bool):
        self.vectors = vectors.astype(np.float64)
        self.kind = np.float64 if wide else np.float32  # of apexes
        self.square = (self.vectors**2).sum(axis=1)
        # coordinates from inner products with the pivots: the inverse of the triangle of an orthogonal basis of them
        triangle = np.linalg.qr(self.vectors.T, mode="r") if len(vectors) else np.zeros((0, 0))
        self.inverse = np.linalg.inv(triangle) if len(vectors) else triangle

    def distances(self, v: np.ndarray) -> np.ndarray:
        """To the origin, then to each pivot."""
        x = v.astype(np.float64)
        square = (x * x).sum(axis=1)
        return np.sqrt(np.maximum(np.concatenate([square[:, None], square[:, None] + self.square - 2 * x @ self.vectors.T], axis=1), 0))

    def apexes(self, distances: np.ndarray) -> np.ndarray:
        """Coordinates in the pivots' span, distance from it, and a share of the norm that makes inner products upper bounds."""
        norm = distances[:, 0]
        inner = (norm[:, None] ** 2 + self.square - distances[:, 1:] ** 2) / 2
        inside = inner @ self.inverse
        # what rounding of the distances can do to the coordinates, and so to what they leave
        off = 1e-14 * (norm**2 + self.square.max(initial=0)) * np.abs(self.inverse).sum()
        rest = np.sqrt(np.maximum(norm**2 - (inside * inside).sum(axis=1), 0) + 2 * norm * off + off * off)
        return np.concatenate([inside, rest[:, None], (np.sqrt(SLACK) * norm + off)[:, None]], axis=1).astype(self.kind)


def _narrow(v: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes, the width in front."""
    most = int(np.abs(v).max(initial=0))
    kind = np.int8 if most < 128 else np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64
    return bytes([np.dtype(kind).itemsize]) + np.ascontiguousarray(v, kind).tobytes()


def _widen(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).reshape(rows, -1)


def box_bound(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest inner product of each query's apex with any apex of each box.

    Summed coordinate by coordinate: a matrix product may round otherwise in another batch, and every round needs the same order.
    """
    out = np.ones((len(queries), len(low)))
    for j in range(queries.shape[1]):
        q = queries[:, j, None].astype(np.float64)
        out += np.where(q > 0, q * high[:, j], q * low[:, j])
    return out


class Chunk:
    """One chunk of candidates in a worker: blocks with their boxes; answers packs of queries."""

    def __init__(self, k: int):
        self.k, self.parts, self.ids, self.vectors, self.row_no, self.exact = k, [], None, None, None, {}
        self.evaluated = 0

    def add(self, ids: np.ndarray, row_no: np.ndarray, vectors: np.ndarray, apexes: np.ndarray) -> None:
        self.parts.append((ids, vectors, apexes, row_no, apexes.min(axis=0), apexes.max(axis=0)))

    def _whole(self) -> None:
        self.ids, self.vectors, self.row_no = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1, 3))
        self.first = np.cumsum([0, *(len(p[0]) for p in self.parts)])
        self.low, self.high = (np.stack([p[i] for p in self.parts]) for i in (4, 5))
        self.most = float(np.abs(self.vectors.astype(np.int64)).max(initial=0))

    def _scorer(self, queries: np.ndarray):
        """A function (query number, rows) to exact scores: in floats or doubles while every partial sum fits their 24 or 53 bits."""
        most = self.most * float(np.abs(queries.astype(np.int64)).max(initial=0)) * max(1, queries.shape[1])
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else None
        if kind is None:
            return lambda q, rows: _scores(queries[q : q + 1], self.vectors[rows])[0]
        if kind not in self.exact:
            self.exact[kind] = self.vectors.astype(kind)
        mine, own = queries.astype(kind), self.exact[kind]
        return lambda q, rows: (own[rows] @ mine[q]).astype(np.int64)

    def search(self, own: np.ndarray, vectors: np.ndarray, apexes: np.ndarray, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the (scores, ids) of its k best rows here that reach its floor. own: the queries' row numbers."""
        nothing = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(own)
        if not self.parts:
            return nothing
        if self.ids is None:
            self._whole()
        open_blocks = np.flatnonzero((box_bound(apexes, self.low, self.high) >= floors[:, None]).any(axis=0))
        if not len(open_blocks):
            return nothing
        upper = np.concatenate([apexes @ self.parts[b][2].T for b in open_blocks], axis=1) + apexes.dtype.type(1)
        rows = np.concatenate([np.arange(self.first[b], self.first[b + 1]) for b in open_blocks])
        score = self._scorer(vectors)
        return [self._best(int(own[q]), q, upper[q], float(floors[q]), rows, score) for q in range(len(own))]

    def _best(self, own: int, number: int, upper: np.ndarray, floor: float, rows: np.ndarray, scorer) -> tuple[np.ndarray, np.ndarray]:
        score, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def evaluate(places: np.ndarray) -> None:
            """Rows in the order of their bounds, until these fall below the floor; in steps that grow."""
            nonlocal score, ids, floor
            bound = upper[places]
            order = np.argsort(-bound, kind="stable")
            places, bound, at, step = places[order], bound[order], 0, STEP
            while at < len(places) and bound[at] >= floor:
                part = rows[places[at : at + step]]
                self.evaluated += len(part)
                found = scorer(number, part)
                keep = np.flatnonzero(found >= floor)
                if len(keep):
                    keep = keep[self.row_no[part[keep]] != own]
                    score, ids = np.concatenate([score, found[keep]]), np.concatenate([ids, self.ids[part[keep]]])
                    order = np.lexsort((ids, -score))[: self.k]
                    score, ids = score[order], ids[order]
                    if len(score) == self.k:
                        floor = max(floor, float(score[-1]))
                at, step = at + step, min(4 * step, MOST_STEP)

        if np.isinf(floor) and len(upper) > 2 * STEP:  # those of the greatest bounds first, for a floor to begin with
            places = np.argpartition(-upper, STEP)
            evaluate(places[:STEP])
            left = places[STEP:]
            evaluate(left[upper[left] >= floor])
        else:
            evaluate(np.flatnonzero(upper >= floor))
        return score, ids


def _rows(kind: int, chunk: int, no: int, ids, tags, vectors, apexes, floors) -> pa.RecordBatch:
    cells = [np.ascontiguousarray(x).tobytes() for x in (ids, tags)] + [_narrow(vectors)] + [np.ascontiguousarray(x).tobytes() for x in (apexes, floors)]
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int32()), pa.array([0], pa.int32()), pa.array([kind], pa.int32()), pa.array([no], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)],
        ["chunk", "salt", "kind", "no", "ids", "tags", "vectors", "apexes", "floors"],
    )


class Index:
    """The stored pivot table of vectors (vec_id, v)."""

    def __init__(self, rows: DataFrame, pivots: int = PIVOTS, chunk_rows: int = CHUNK_ROWS, least_chunks: int = LEAST_CHUNKS, block: int = BLOCK):
        spark = rows.sparkSession
        bounded_batches(spark)
        rows = materialize(rows.select("vec_id", "v"), "vectors")
        n, width, most = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
        self.n, self.width = n, width or 0
        if not n:
            return
        sample = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow().column("v").combine_chunks()
        chosen = choose_pivots(_matrix(sample, self.width), pivots)
        self.pivots = Pivots(chosen, wide=(most or 0) * max(1, self.width) > 1e15)
        sent, width = self.pivots, self.width

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = sent.distances(_matrix(batch.column(1), width))
                to = d[:, 1:] if d.shape[1] > 1 else d
                near = to.argmin(axis=1) if len(d) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(near.astype(np.int32)), pa.array(to[np.arange(len(d)), near])], ["vec_id", "v", "distances", "cell", "near"])

        measured = rows.mapInArrow(measure, "vec_id long, v array<bigint>, distances array<double>, cell int, near double")
        #: vec_id, v, distances, cell (nearest pivot), near (the distance to it), row_no (which tells equal rows apart)
        self.table = materialize(measured.withColumn("row_no", F.monotonically_increasing_id()), "distances")
        self.chunks = min(MAX_CHUNKS, max(-(-n // chunk_rows), min(least_chunks, n)))
        order = ["cell", "near", "vec_id", "v"]
        ranged = self.table.repartitionByRange(self.chunks, *order).sortWithinPartitions(*order).select("vec_id", "v", "distances", "row_no")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Blocks of a partition, which is a chunk; then one row with the chunk's box."""
            from pyspark import TaskContext

            chunk, no, low, high = TaskContext.get().partitionId(), 0, None, None
            for ids, v, apexes, row_no in _blocks(batches, sent, width, block):
                low, high = (apexes.min(axis=0), apexes.max(axis=0)) if low is None else (np.minimum(low, apexes.min(axis=0)), np.maximum(high, apexes.max(axis=0)))
                yield _rows(0, chunk, no, ids, row_no, v, apexes, [])
                no += 1
            if no:
                yield _rows(2, chunk, no, [], [], np.zeros((0, 0), np.int64), np.stack([low, high]), [])

        self.blocks = materialize(ranged.mapInArrow(pack, _KINDS), "pivot-table", **{"parquet.block.size": 16 << 20})
        boxes = self.blocks.filter("kind = 2").select("chunk", "apexes").orderBy("chunk").toArrow()  # a row a chunk, MAX_CHUNKS at most
        edges = np.frombuffer(b"".join(boxes.column("apexes").to_pylist()), self.pivots.kind).reshape(boxes.num_rows, 2, -1)
        self.numbers, self.low, self.high = boxes.column("chunk").to_numpy(), edges[:, 0], edges[:, 1]

    def queries(self, condition) -> DataFrame:
        """vec_id, v, apex, tag (the row number) of the distinct rows that meet the condition, stored in the table's order."""
        pivots, order = self.pivots, ["cell", "near", "vec_id", "tag"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                apexes = pivots.apexes(np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)) if batch.num_rows else ()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a in apexes], pa.binary()), batch.column(3)], ["vec_id", "v", "apex", "tag"])

        rows = self.table.filter(condition).withColumnRenamed("row_no", "tag").dropDuplicates(["vec_id", "v"])
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "v", "distances", "tag")
        return materialize(rows.mapInArrow(run, "vec_id long, v array<bigint>, apex binary, tag long"), "queries")


def _blocks(batches: Iterator[pa.RecordBatch], pivots: Pivots, width: int, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """ids, vectors, apexes and row numbers of runs of ``size`` rows of a stream (vec_id, v, distances, row_no)."""
    held: list[pa.RecordBatch] = []

    def joined(rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows).combine_chunks()
        ids, v, d, row_no = (table.column(i).chunk(0) for i in range(4))
        return np.asarray(ids), _matrix(v, width), pivots.apexes(np.asarray(d.flatten()).reshape(len(ids), -1)), np.asarray(row_no)

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - sum(b.num_rows for b in held))
            at += part.num_rows
            held.append(part)
            if sum(b.num_rows for b in held) == size:
                yield joined(held)
                held = []
    if held:
        yield joined(held)


def ask(index: Index, queries: DataFrame, start: int, end: int) -> DataFrame:
    """Packs of queries for the chunks that stand at places start to end in each query's bound order and may reach its floor.

    queries: vec_id, v, apex, tag, floor (null: none yet).
    """
    kind, width, numbers, low, high = index.pivots.kind, index.width, index.numbers, index.low, index.high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        no = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v, tags = np.asarray(batch.column(0)), _matrix(batch.column(1), width), np.asarray(batch.column(3))
            apexes = np.frombuffer(b"".join(batch.column(2).to_pylist()), kind).reshape(len(ids), -1)
            floors = batch.column(4).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            asks = np.zeros((len(ids), len(numbers)), bool)
            for i in range(0, len(ids), 256):
                rows = slice(i, i + 256)
                bound = box_bound(apexes[rows], low, high)
                place = np.argsort(-bound, axis=1, kind="stable")[:, start:end]
                good = np.take_along_axis(bound, place, axis=1) >= floors[rows, None]
                np.put_along_axis(asks[rows], place, good, axis=1)
            for c in np.flatnonzero(asks.any(axis=0)):
                mine = np.flatnonzero(asks[:, c])
                for i in range(0, len(mine), PACK):
                    q = mine[i : i + PACK]
                    yield _rows(1, int(numbers[c]), no, ids[q], tags[q], v[q], apexes[q], floors[q])
                    no += 1

    return queries.select("vec_id", "v", "apex", "tag", "floor").mapInArrow(run, _KINDS)


def answer(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """query_id, tag, vec_id, score of what packs find; and a row with null ids and the number of evaluations for each pack."""
    tasks = asked.groupBy("chunk").agg(F.ceil(F.count(F.lit(1)) / PACKS_A_TASK).cast("int").alias("salts"))  # a row a chunk
    dealt = asked.join(F.broadcast(tasks), "chunk").withColumn("salt", F.pmod(F.xxhash64("no"), F.col("salts")).cast("int"))
    copies = index.blocks.filter("kind = 0").join(F.broadcast(tasks), "chunk").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    columns = asked.columns
    rows = dealt.select(*columns).unionByName(copies.select(*columns))
    rows = rows.repartition(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk", "salt").sortWithinPartitions("chunk", "salt", "kind", "no")
    kind = index.pivots.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                c, salt, what, _, ids, tags, vectors, apexes, floors = (batch.column(j)[i].as_py() for j in range(9))
                if (c, salt) != now:
                    now, chunk = (c, salt), Chunk(k)
                ids, tags = np.frombuffer(ids, np.int64), np.frombuffer(tags, np.int64)
                v, a = _widen(vectors, len(ids)), np.frombuffer(apexes, kind).reshape(len(ids), -1)
                if what == 0:
                    chunk.add(ids, tags, v, a)
                    continue
                before = chunk.evaluated
                best = chunk.search(tags, v, a, np.frombuffer(floors, np.float64))
                n = [len(s) for s, _ in best]
                none = pa.nulls(1, pa.int64())
                cols = [np.repeat(ids, n), np.repeat(tags, n), np.concatenate([b for _, b in best]), np.concatenate([s for s, _ in best])]
                cols = [pa.concat_arrays([pa.array(x, pa.int64()), y]) for x, y in zip(cols, [none, none, none, pa.array([chunk.evaluated - before], pa.int64())], strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["query_id", "tag", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, tag long, vec_id long, score long")


def search(vectors: DataFrame, is_query, k: int = 20, pivots: int = PIVOTS, told: dict | None = None, **table) -> DataFrame:
    """vectors: vec_id, v. is_query: a condition on vec_id. Returns query_id, rank, vec_id, score.

    told, if given, receives the numbers of pairs, evaluations, pivots and rounds.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index = Index(vectors, pivots, **table)
    if not index.n:
        return empty
    queries = index.queries(is_query)
    each = W.partitionBy("query_id", "tag").orderBy(F.col("score").desc(), "vec_id")
    best, evaluated, start, end, rounds = None, 0, 0, 1, 0
    while start < len(index.numbers):
        if best is None:
            open_queries = queries.withColumn("floor", F.lit(None).cast("double"))
        else:
            floors = best.groupBy(F.col("query_id").alias("vec_id"), "tag").agg(F.when(F.count(F.lit(1)) == k, F.min("score").cast("double")).alias("floor"))
            open_queries = queries.join(floors, ["vec_id", "tag"], "left")
        asked = materialize(ask(index, open_queries, start, end), "asked", **{"parquet.block.size": 16 << 20})
        if asked.isEmpty():  # no query's next chunks reach its floor, so none after them do
            break
        found = answer(index, asked, k)
        if told is not None:
            found = materialize(found, "found")
            evaluated += found.filter("query_id IS NULL").agg(F.sum("score")).first()[0] or 0
        rows = found.filter("query_id IS NOT NULL")
        rows = rows if best is None else rows.unionByName(best)
        best = materialize(rows.withColumn("_n", F.row_number().over(each)).filter(F.col("_n") <= k).drop("_n"), "best")
        rounds, start, end = rounds + 1, end, end * LOOK_AHEAD
    if told is not None:
        told |= {"pairs": queries.count() * index.n, "evaluated": evaluated, "pivots": len(index.pivots.vectors), "rounds": rounds}
    if best is None:
        return empty
    return best.withColumn("rank", F.row_number().over(each)).select("query_id", "rank", "vec_id", "score")


def op10_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every vector whose id is divisible by 20."""
    return search(whole_numbers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.v AS qv, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM (SELECT vec_id, v, min(row_no) AS row_no FROM e WHERE vec_id % 20 = 0 GROUP BY vec_id, v) q JOIN e c ON q.row_no <> c.row_no),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
