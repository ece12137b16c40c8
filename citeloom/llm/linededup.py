r"""Line dedup: lines within one edit of an earlier line go, the earliest stays.

Lines are \n-split, with white space at both ends (characters 9 to 13 and 32) ignored. Every line
that isn't blank takes part. A line is dropped if a line stands earlier, by (doc_id, line number), in
the whole corpus and is within the edit bound of it, counted in insertions, deletions or substitutions
of a code point. The bound is relative to length: one edit for every CHARS_PER_EDIT code points of the
shorter line, MAX_EDITS at most; so what counts as the same line is a share of it, and a line in which one
edit makes another word has no edit to spare. Whether that earlier line is itself dropped doesn't
matter, so the answer depends on no order of work.

Method: a deletion-neighbourhood join. Equal lines become one class, stood for by its earliest.
Two lines within one edit share the hash of their first or of their last q code points, for a q of
about half their length, so only classes that share such a hash emit their neighbourhood: the line itself and all
variants with one code point deleted, as hashed keys. Lines that differ by a substitution share a
variant with the same place deleted; a line that lacks a code point of another equals a variant of
it. The keys are exchanged once, sorted by key and place, and read as a stream: of a key only the
earliest line meets the others, so no pairs of a key's lines are listed, and a key of any size
takes no memory beyond its rows. The pairs found are verified on the texts.

Lines are told apart by a 64-bit hash and their length in code points. Null text is one empty
line. Null doc_ids come after all others. Repeated rows get the same answer: neither is earlier
than the other. Lines are brought back to their documents by doc_id and a hash of the text, so rows
without an id, or of one id, get their own lines alone. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding
from .bytewords import Block, _table, blocks, mix
from .common import SENT_BYTES, bounded_batches, materialize, pick, sent

CHARS_PER_EDIT = 20
MAX_EDITS = 1
#: A line's place, doc_id * LINES + line number, is one number that aggregates in place; null doc_ids come last.
PLACE = "decimal(38,0)"
LINES = 1 << 31
#: Half lengths of lines of LONG code points or more are multiples of GRID, so that neighbouring lengths mostly share one.
GRID = 4
LONG = 64
_KEYS = ("k0", "k1", "k2", "k3")


class Lines:
    """The lines of a block, trimmed: text number, line number, hash, length in code points."""

    def __init__(self, block: Block):
        a, b, self.which = block.lines
        inside = np.flatnonzero(~block.separators)
        i, j = np.searchsorted(inside, a), np.searchsorted(inside, b)
        blank = i == j
        self.a, self.b = a.copy(), a.copy()
        self.a[~blank] = inside[i[~blank]]
        self.b[~blank] = inside[j[~blank] - 1] + 1
        self.points = np.flatnonzero((block.data & 0xC0) != 0x80)
        self.first = np.searchsorted(self.points, self.a)
        self.n = np.searchsorted(self.points, self.b) - self.first
        self.h = block.hashes(self.a, self.b)
        starts = np.flatnonzero(np.append(True, self.which[1:] != self.which[:-1])) if len(a) else np.zeros(0, np.int64)
        self.number = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
        self.block = block

    def at(self, k: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Where the j-th code point of line k begins, or line k ends."""
        ends = j >= self.n[k]
        return np.where(ends, self.b[k], self.points[np.minimum(self.first[k] + j, len(self.points) - 1)])

    def halves(self, k: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Hashes of the first and last q code points of lines k, as (hash, whether there is one).

        q is half the length, rounded down (to a multiple of GRID from LONG on); where a line one shorter has another q,
        there are hashes for that one too. So lines within one edit have a q in common, and the edit
        leaves the first or the last q code points of both alone.
        """
        out = []
        q, shorter = (np.where(x < LONG, x // 2, x // 2 // GRID * GRID) for x in (self.n[k], self.n[k] - 1))
        for size, there in ((q, np.ones(len(k), bool)), (shorter, shorter != q)):
            out.append((mix(self.block.hashes(self.a[k], self.at(k, size)) ^ np.uint64(0x5851F42D4C957F2D)), there))
            out.append((self.block.hashes(self.at(k, self.n[k] - size), self.b[k]), there))
        return out


def variants(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text of a block, all of it and it without each code point: key, place deleted (-1: none), text number."""
    up, down = _table(len(block.data) + 1)
    points = np.flatnonzero((block.data & 0xC0) != 0x80)
    of = np.searchsorted(block.end, points, side="right")
    after = np.append(points[1:], len(block.data))
    a, b, s = block.start[of], block.end[of], block._sums
    after = np.minimum(after, b)
    head = (s[points] - s[a]) * down[a]
    tail = (s[b] - s[after]) * down[after] * up[points - a]
    keys = mix(head + tail + (b - a - (after - points)).astype(np.uint64))
    whole = block.hashes(block.start, block.end)
    first = np.searchsorted(points, block.start)
    place = np.arange(len(points)) - first[of]
    return np.concatenate([whole, keys]), np.concatenate([np.full(len(block), -1), place]), np.concatenate([np.arange(len(block)), of])


def within_one_edit(x: str, y: str) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i + (len(x) == len(y)) :] == y[i + 1 :]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with ``th``, a hash of the text."""
    return docs.withColumn("th", F.xxhash64("text"))


def line_table(docs: DataFrame, chars_per_edit: int) -> DataFrame:
    """docs: doc_id, text, th. One row per line that isn't blank: place, th, h, n, k0 to k3 (hashes of halves, null if none or below chars_per_edit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding.forget()
        for batch in batches:
            for first, block in blocks(batch.column(1)):
                lines = Lines(block)
                k = np.flatnonzero(lines.n >= 1)
                halves = [pa.array(x.view(np.int64), mask=~there | (lines.n[k] < chars_per_edit)) for x, there in lines.halves(k)]
                ids, th = (batch.column(c).take(pa.array(first + lines.which[k])) for c in (0, 2))
                yield pa.RecordBatch.from_arrays([ids, th, pa.array(lines.number[k].astype(np.int32)), _signed(lines.h[k]), pa.array(lines.n[k].astype(np.int32)), *halves], ["doc_id", "th", "line_no", "h", "n", *_KEYS])

    rows = docs.select("doc_id", "text", "th").mapInArrow(encoding.tidy(run), "doc_id long, th long, line_no int, h long, n int, k0 long, k1 long, k2 long, k3 long")
    return rows.select(_place("doc_id", "line_no").alias("place"), "th", "h", "n", *_KEYS)


def _place(doc_id: str, line_no: str) -> Column:
    doc = F.coalesce(F.col(doc_id).cast("decimal(20,0)"), F.lit(str(2**63)).cast("decimal(20,0)"))
    return (doc * F.lit(LINES).cast("decimal(11,0)") + F.col(line_no)).cast(PLACE)


def _doc_and_line(rows: DataFrame, *others: str) -> DataFrame:
    """doc_id and line_no of a place."""
    line = F.pmod("place", F.lit(LINES).cast(PLACE))
    doc = ((F.col("place") - line) / F.lit(LINES).cast("decimal(11,0)")).cast("decimal(20,0)")
    return rows.select(F.when(doc < F.lit(str(2**63)).cast("decimal(20,0)"), doc).cast("long").alias("doc_id"), line.cast("int").alias("line_no"), *others)


def _by_document(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs with the distinct lines of rows (doc_id, th, ...) that belong to each, as array ``of_doc``; null where there is none."""
    rows = materialize(rows.distinct(), "rows")
    listed = rows.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*(c for c in rows.columns if c not in ("doc_id", "th")))).alias("of_doc"))
    listed = listed.withColumnsRenamed({"doc_id": "_of", "th": "_th"})
    small = rows.count() * rows._jdf.schema().defaultSize() <= SENT_BYTES
    return docs.join(F.broadcast(listed) if small else listed, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_of")), "left").drop("_of", "_th")


def close_lines(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """docs: doc_id, text, th. For classes (h, n, place, th, k0 to k3) that have an earlier class within one edit: h, n, near (the earliest such place)."""
    keys = classes.select("h", "n", F.explode(F.array(*_KEYS)).alias("half")).filter("half IS NOT NULL")
    shared = keys.groupBy("half").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("half")
    suspects = keys.join(sent(shared), "half").select("h", "n").distinct()
    suspects = classes.select("h", "n", "place", "th").join(sent(suspects), ["h", "n"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2).to_pylist()
            for first, block in blocks(batch.column(1)):
                lines, out = Lines(block), []
                edges = np.searchsorted(lines.which, np.arange(len(block) + 1))
                for t in range(len(block)):
                    for x in wanted[first + t]:
                        k = edges[t] + x["line_no"]
                        if k < edges[t + 1] and int(lines.h[k].view(np.int64)) == x["h"] and lines.n[k] == x["n"]:
                            out.append((x["h"], x["n"], block.data[lines.a[k] : lines.b[k]].tobytes().decode(), x["place"]))
                h, n, text, place = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int32()), pa.array(text, pa.string()), pa.array(place, pa.decimal128(38, 0))], ["h", "n", "line", "place"])

    texts = _by_document(docs, _doc_and_line(suspects, "th", "h", "n", "place")).filter("of_doc IS NOT NULL").select("doc_id", "text", "of_doc")
    texts = materialize(texts.mapInArrow(fetch, f"h long, n int, line string, place {PLACE}").dropDuplicates(["h", "n"]), "lines")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, block in blocks(batch.column(2)):
                key, cut, of = variants(block)
                rows = pa.array(first + of)
                yield pa.RecordBatch.from_arrays([_signed(key), pa.array(cut.astype(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows)], ["v", "cut", "doc_id", "line_no"])

    order = ["v", "cut", F.col("doc_id").asc_nulls_last(), "line_no"]
    rows = _doc_and_line(texts, "line").mapInArrow(emit, "v long, cut int, doc_id long, line_no int")
    rows = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "v").sortWithinPartitions(*order)
    pairs = rows.mapInArrow(_neighbours, "doc_id long, line_no int, near_doc long, near_line int").distinct()
    pairs = materialize(pairs.select(_place("doc_id", "line_no").alias("place"), _place("near_doc", "near_line").alias("near")), "pairs")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [within_one_edit(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["h", "n", "near"]).filter(pa.array(same, pa.bool_()))

    x = texts.select("place", "h", "n", F.col("line").alias("x"))
    y = texts.select(F.col("place").alias("near"), F.col("line").alias("y"))
    told = pairs.join(x, "place").join(y, "near").select("h", "n", "near", "x", "y").mapInArrow(check, f"h long, n int, near {PLACE}")
    return materialize(told.groupBy("h", "n").agg(F.min("near").alias("near")), "near")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (v, cut, doc_id, line_no), sorted so: each line with the earliest line before it that shares its key and place
    deleted, and whole lines with the variants equal to them, the earlier of both first."""
    rest: pa.Table | None = None

    def pairs(table: pa.Table) -> pa.RecordBatch:
        v, cut, line = (table.column(c).to_numpy() for c in ("v", "cut", "line_no"))
        doc = table.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        n = len(v)
        key = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        run = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (cut[1:] != cut[:-1])))
        head = np.repeat(run, np.diff(np.append(run, n)))
        of_key = np.repeat(key, np.diff(np.append(key, n)))
        own = np.flatnonzero((head != np.arange(n)) & (cut >= 0))
        left, right = [own], [head[own]]
        whole = np.flatnonzero((cut[of_key] < 0) & (cut >= 0))  # variants equal to a whole line
        first = of_key[whole]
        before = (doc[first] < doc[whole]) | (doc[first] == doc[whole]) & (line[first] < line[whole])
        left += [np.where(before, whole, first)]
        right += [np.where(before, first, whole)]
        a, b = (pa.array(np.concatenate(x)) for x in (left, right))
        ids, numbers = table.column("doc_id"), table.column("line_no")
        cols = [ids.take(a), numbers.take(a), ids.take(b), numbers.take(b)]
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in cols], ["doc_id", "line_no", "near_doc", "near_line"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        if not rest.num_rows:
            continue
        v = rest.column("v").to_numpy()
        last = int(np.searchsorted(v, v[-1]))
        if last:
            yield pairs(rest.slice(0, last))
            rest = rest.slice(last)
    if rest is not None and rest.num_rows:
        yield pairs(rest)


def dropped_lines(docs: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, max_edits: int = MAX_EDITS) -> DataFrame:
    """docs: doc_id, text, th. The lines to drop: doc_id, th, line_no, h (a line counts as meant only if its hash is h)."""
    if max_edits not in (0, 1) or chars_per_edit < 1:
        raise ValueError(f"max_edits {max_edits}, chars_per_edit {chars_per_edit}; 0 and 1 edits are supported")
    lines = materialize(line_table(docs, chars_per_edit), "lines")
    classes = lines.groupBy("h", "n").agg(F.min("place").alias("place"), F.min_by("th", "place").alias("th"), F.count(F.lit(1)).alias("c"), *(F.max(k).alias(k) for k in _KEYS))
    classes = materialize(classes, "classes")
    near = close_lines(docs, classes) if max_edits else None
    known = classes.select("h", "n", "place", "c")
    known = known.join(sent(near), ["h", "n"], "left") if near is not None else known.withColumn("near", F.lit(None).cast(PLACE))
    known = known.filter("c > 1 OR near IS NOT NULL").select("h", "n", F.least("place", F.coalesce("near", "place")).alias("earliest"))
    gone = lines.select("place", "th", "h", "n").join(sent(known), ["h", "n"]).filter("earliest < place")
    return _doc_and_line(gone, "th", "h")


def dedup_lines(docs: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, max_edits: int = MAX_EDITS) -> DataFrame:
    """docs: doc_id, text and any columns, which are kept. Text loses its dropped lines; adds n_lines and n_dropped."""
    bounded_batches(docs.sparkSession)
    names = docs.columns
    low = [x.lower() for x in names]
    at = [names.index(x) if x in names else low.index(x) for x in ("doc_id", "text")]
    flat = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    plain = _keyed(flat.select(F.col(f"_c{at[0]}").cast("long").alias("doc_id"), F.col(f"_c{at[1]}").alias("text")))
    drops = dropped_lines(plain, chars_per_edit, max_edits)
    joined = _by_document(flat.withColumns({"doc_id": F.col(f"_c{at[0]}").cast("long"), "th": F.xxhash64(f"_c{at[1]}")}), drops)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drop = batch.column(0), batch.column(1).to_pylist()
            for first, block in blocks(texts):
                _, _, which = block.lines
                n_lines = np.bincount(which, minlength=len(block))
                out = texts.slice(first, len(block)).to_pylist()
                gone = np.zeros(len(block), np.int64)
                if any(drop[first : first + len(block)]):
                    lines = Lines(block)
                    edges = np.searchsorted(which, np.arange(len(block) + 1))
                    for t in range(len(block)):
                        cut = {x["line_no"] for x in drop[first + t] or () if edges[t] + x["line_no"] < edges[t + 1] and int(lines.h[edges[t] + x["line_no"]].view(np.int64)) == x["h"]}
                        if cut:
                            out[t] = "\n".join(x for i, x in enumerate(out[t].split("\n")) if i not in cut)
                            gone[t] = len(cut)
                own = [c.slice(first, len(block)) for c in batch.columns[2:]]
                own[at[1]] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays([*own, pa.array(n_lines.astype(np.int64)), pa.array(gone)], [f"_c{i}" for i in range(len(own) + 2)])

    kinds = ", ".join(f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    out = joined.select(F.col(f"_c{at[1]}").alias("_text"), "of_doc", *flat.columns).mapInArrow(encoding.tidy(rebuild), f"{kinds}, n_lines long, n_dropped long")
    return out.toDF(*names, "n_lines", "n_dropped")


def op8_line_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents: doc_id, n_lines, n_dropped, and the kept text's length and md5."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    out = dedup_lines(docs)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_dropped", F.length(text).cast("long").alias("kept_chars"), F.md5(text.cast("binary")).alias("kept_md5"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS MATERIALIZED (SELECT doc_id, i AS line_no, trim(ls[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
c AS MATERIALIZED (SELECT line, min((doc_id, line_no)) AS place, length(line) AS n FROM l WHERE line <> '' GROUP BY line),
k AS (SELECT line, unnest([left(line, n // 2), left(line, (n + 1) // 2), '<' || right(line, n // 2), '<' || right(line, (n + 1) // 2)]) AS half FROM c WHERE n >= {CHARS_PER_EDIT}),
s AS MATERIALIZED (SELECT line, place, n FROM c WHERE line IN (SELECT line FROM k WHERE half IN (SELECT half FROM k GROUP BY half HAVING count(DISTINCT line) > 1))),
v AS MATERIALIZED (SELECT line, place, r, left(line, r - 1) || substr(line, r + 1) AS v FROM s, unnest(range(1, n + 1)) AS u(r)),
p AS (SELECT x.line, y.place FROM v x JOIN v y ON x.v = y.v AND x.r = y.r UNION ALL SELECT x.line, y.place FROM v x JOIN s y ON x.v = y.line
  UNION ALL SELECT y.line, x.place FROM v x JOIN s y ON x.v = y.line UNION ALL SELECT line, place FROM c),
e AS (SELECT line, min(place) AS place FROM p GROUP BY line),
j AS (SELECT l.doc_id, l.line_no, coalesce(e.place < (l.doc_id, l.line_no), false) AS gone FROM l LEFT JOIN e ON e.line = l.line),
g AS (SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped, list(line_no ORDER BY line_no) FILTER (WHERE NOT gone) AS keep FROM j GROUP BY doc_id),
t AS (SELECT g.doc_id, n_lines, n_dropped, coalesce(array_to_string(list_transform(keep, lambda i: d.ls[i]), chr(10)), '') AS kept FROM g JOIN d USING (doc_id))
SELECT doc_id, n_lines, n_dropped, length(kept)::BIGINT AS kept_chars, md5(kept) AS kept_md5 FROM t
"""
