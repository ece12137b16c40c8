"""Spelling variants: words one edit apart, and for each rarer word the commoner one that it is a form of.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's
form is the near word of largest count (ties: smallest in code-point order), if that count is at
least FACTOR times its own; its root is what following forms leads to.

Method: a positional q-gram inverted index with a count filter. A word of length l has l - q + 1
grams, each with its position. One edit spoils q of them at most, so of two near words, the longer of
length L, at least L - 2q + 1 grams agree: at equal positions if the lengths are equal, else at equal
or next positions (length and position limits). Grams are ordered by how many words hold them, rare
ones first; two words that agree in so many grams agree in one of their first q + 1 (of the first q of the
shorter, if the lengths differ). So the postings of the index are keyed by (gram, position, length), a word is
posted under its q + 1 rarest grams alone, and is looked up under its own lists and those of words one
longer. The words of a list hold an index of all their grams; a lookup merges, in order, the postings
of its grams there (ascending lists, merged by a stable sort, which merges runs), counts how often
each word turns up, and keeps those with L - 2q + 1 or more. What is left is verified.

Nothing depends on a list's length: lists of more than LIST_WORDS words are cut into blocks, each in a
key of its own, which lookups are sent to all of; a task holds one block and a batch of lookups at a
time, and works through them in steps of bounded size. Grams are told apart by 16 bits, so their
counts are a table of fixed size; grams that share a code only add candidates, which the verification
drops.

Nulls and empty texts hold no word, a null doc_id counts as an empty string in the checksum, and
repeated rows count as often as they stand there. Texts of any length are read whole. Columns beyond
doc_id and text don't matter, whatever their names. An empty table gives no row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding
from .bytewords import mix
from .common import bounded_batches, forget, materialize, pick, sent, table

RUN = "[A-Za-zÀ-ÿ]+"
MIN_CHARS = 6
MIN_COUNT = 5
FACTOR = 5
#: One run of a document in about so many loses a code point.
EVERY = 199
Q = 3
LIST_WORDS = 20_000
#: Counts of words are handed on when so many are held; texts are searched in pieces of about PIECE code points.
HELD_WORDS = 200_000
PIECE = 1 << 20
#: Postings that are merged at a time.
STEP = 4 << 20
_GRAMS = 1 << 16


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that end where no letter stands, so no run is cut."""
    letter, at = re.compile("[a-zÀ-ÿ]"), 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and letter.match(text, end):
            end += 1
        yield text[at:end]
        at = end


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """docs (doc_id, text): word, n, for the words of min_chars code points and min_count occurrences or more.

    Runs are lower-cased in A to Z alone. With h the unsigned CRC-32 of ``doc_id:run``, a run loses its
    code point h % length where ``every`` divides h.
    """
    bounded_batches(docs.sparkSession)
    rows = pick(docs, doc_id="doc_id", text="text").filter("text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        find = re.compile("[a-zÀ-ÿ]+").findall

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for doc, raw in zip(batch.column(0).to_pylist(), texts, strict=True):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for piece in _pieces(raw.as_py().lower().decode()):  # bytes know the case of A to Z alone
                    for run, n in Counter(find(piece)).items():
                        h = zlib.crc32(run.encode(), start)
                        if h % every == 0:
                            k = h % len(run)
                            run = run[:k] + run[k + 1 :]
                        if len(run) >= min_chars:
                            held[run] += n
                    if len(held) > HELD_WORDS:
                        yield out()
        yield out()

    rows = rows.mapInArrow(encoding.tidy(count), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class Words:
    """Words of a batch as code points, one after the other, with the codes of their grams."""

    def __init__(self, words: list[str], q: int):
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.n = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.n) - self.n
        ends = self.start + self.n
        size = np.maximum(self.n - q + 1, 0)
        self.of = np.repeat(np.arange(len(words)), size)  # the word of each gram
        self.first = np.cumsum(size) - size
        self.position = np.arange(len(self.of)) - self.first[self.of]
        place = self.start[self.of] + self.position
        code = np.zeros(len(place), np.uint64)
        for k in range(q):
            code = mix(code * np.uint64(0xD6E8FEB86659FD93) + self.points[place + k])
        self.gram = (code >> np.uint64(48)).astype(np.int64)
        self.end = ends


def _key(gram: np.ndarray, position: np.ndarray, length: np.ndarray) -> np.ndarray:
    return gram << 47 | (position & 0x7FFFFF) << 24 | length & 0xFFFFFF


def gram_counts(words: DataFrame, q: int) -> np.ndarray:
    """How many grams of all words have each of the 65,536 codes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_GRAMS, np.int64)
        for batch in batches:
            total += np.bincount(Words(batch.column(0).to_pylist(), q).gram, minlength=_GRAMS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "c"])

    found = words.select("word").mapInArrow(count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")).toArrow()  # 65,536 rows at most
    out = np.zeros(_GRAMS, np.int64)
    out[found.column("gram").to_numpy()] = found.column("c").to_numpy()
    return out


def postings(words: DataFrame, order: np.ndarray, q: int) -> DataFrame:
    """words (word, n): key, role, word, n. Role 0 posts a word under a key; 1 looks it up among words of its length, 2 among those one longer."""
    rank = words.sparkSession.sparkContext.broadcast(order.astype(np.int32))  # 65,536 numbers

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                w = Words(part.column(0).to_pylist(), q)
                by_rank = np.lexsort((w.position, rank.value[w.gram], w.of))
                place = np.arange(len(by_rank)) - w.first[w.of[by_rank]]
                few, fewer = by_rank[place <= q], by_rank[place < q]
                length = w.n[w.of]
                own = _key(w.gram[few], w.position[few], length[few])
                longer = [_key(w.gram[fewer], w.position[fewer] + k, length[fewer] + 1) for k in (0, 1)]
                role = np.repeat([0, 1, 2, 2], [len(few), len(few), len(fewer), len(fewer)]).astype(np.int8)
                of = pa.array(np.concatenate([w.of[few], w.of[few], w.of[fewer], w.of[fewer]]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own, own, *longer])), pa.array(role), part.column(0).take(of), part.column(1).take(of)], ["key", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(post, "key long, role byte, word string, n long")


def _extent(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the ranges [start, start + size), one after the other."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - sizes, sizes) + np.repeat(starts, sizes)


def _agree(w: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of different words (a, b), b as long as a or one longer, are one edit apart."""
    head, tail = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for out, one, two, step in ((head, w.start[a], w.start[b], 1), (tail, w.end[a] - 1, w.end[b] - 1, -1)):
        left, k = np.arange(len(a)), 0
        while len(left := left[w.n[a[left]] > k]):
            left = left[w.points[one[left] + step * k] == w.points[two[left] + step * k]]
            k += 1
            out[left] = k
    same = w.n[a] == w.n[b]
    return np.where(same, (head + tail >= w.n[a] - 1) & (head < w.n[a]), head + tail >= w.n[a])


def near_in_list(group: np.ndarray, role: np.ndarray, words: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (lookup, posted), by row number, of near words of one group; groups ascend."""
    w = Words(words, q)
    posted = role[w.of] == 0
    # the index: postings sorted by (group, gram, position), each an ascending list of rows
    name = lambda rows, shift: group[w.of[rows]] << 40 | w.gram[rows] << 24 | np.minimum(w.position[rows] + shift, 0xFFFFFF)
    here = np.flatnonzero(posted)
    names = name(here, 0)
    by_name = np.argsort(names, kind="stable")
    names, rows = names[by_name], w.of[here[by_name]]
    asked = np.flatnonzero(~posted)
    shifted = asked[role[w.of[asked]] == 2]
    who = np.concatenate([w.of[asked], w.of[shifted]])
    wanted = np.concatenate([name(asked, 0), name(shifted, 1)])
    low = np.searchsorted(names, wanted, side="left")
    size = np.searchsorted(names, wanted, side="right") - low
    full = np.flatnonzero(size)
    full = full[np.argsort(who[full], kind="stable")]
    who, low, size = who[full], low[full], size[full]
    need = np.maximum(w.n + (role == 2) - 2 * q + 1, 1)
    found: list[np.ndarray] = []
    total = np.cumsum(size)
    edge = np.append(np.flatnonzero(np.append(True, who[1:] != who[:-1])), len(who)) if len(who) else np.zeros(1, np.int64)
    at = 0
    while at < len(edge) - 1:
        done = total[edge[at] - 1] if edge[at] else 0
        to = max(at + 1, int(np.searchsorted(total[edge[1:] - 1], done + STEP, side="right")))
        part = slice(edge[at], edge[to])
        pair = np.repeat(who[part], size[part]) * len(words) + rows[_extent(low[part], size[part])]
        pair.sort(kind="stable")
        head = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        times = np.diff(np.append(head, len(pair)))
        a, b = np.divmod(pair[head], len(words))
        keep = (times >= need[a]) & (w.n[b] == w.n[a] + (role[a] == 2))
        a, b = a[keep], b[keep]
        ok = _agree(w, a, b)
        found.append(np.stack([a[ok], b[ok]]))
        at = to
    both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def near_words(words: DataFrame, q: int = Q, list_words: int = LIST_WORDS) -> DataFrame:
    """words (word, n), stored, of 2 * q code points or more: the pairs of near words as a, a_n, b, b_n, each once."""
    rows = materialize(postings(words, gram_counts(words, q), q), "postings")
    size = rows.filter("role = 0").groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > list_words)
    size = size.select("key", F.ceil(F.col("c") / list_words).cast("int").alias("blocks"))  # one row for each list_words postings at most
    rows = rows.join(sent(size), "key", "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("word"), blocks).cast("int"))).otherwise(F.sequence(F.lit(0), blocks - 1))
    rows = rows.select("key", F.explode(own).alias("block"), "role", "word", "n")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "role", "word")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, list_words):
                new = pa.Table.from_batches([batch.slice(at, list_words)])
                held = pa.concat_tables([rest, new]) if rest is not None else new
                key, block, role = (held.column(c).to_numpy() for c in ("key", "block", "role"))
                group = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
                a, b = near_in_list(group, role, held.column("word").to_pylist(), q)
                x, y = held.take(pa.array(a)), held.take(pa.array(b))
                # words of one length look each other up: one of the two finds is enough
                pairs = pa.table([x.column("word"), x.column("n"), y.column("word"), y.column("n")], ["a", "a_n", "b", "b_n"])
                once = (role[a] == 2) | np.array([p < r for p, r in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True)], bool)
                yield from pairs.filter(pa.array(once, pa.bool_())).combine_chunks().to_batches()
                rest = held.filter(pa.array((group == group[-1]) & (role == 0)))  # the list that further lookups may ask

    return rows.mapInArrow(encoding.tidy(look), "a string, a_n long, b string, b_n long").dropDuplicates(["a", "b"])


def variants(words: DataFrame, factor: int = FACTOR, q: int = Q, list_words: int = LIST_WORDS) -> DataFrame:
    """words (word, n), stored: word, form, root, n, n_near, form_n."""
    pairs = near_words(words, q, list_words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    told = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= F.lit(factor) * F.col("n")
    told = told.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    told = materialize(told, "words")
    return told.join(_roots(told.filter("form IS NOT NULL").select("word", "form")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form. Counts grow by each step, so there is no cycle; each round doubles the steps taken."""
    roots = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(roots)
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        roots = step.select("word", "root")
        roots._stored_at = step._stored_at


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents: word, form, root, n, n_near, form_n."""
    return variants(materialize(word_counts(table(spark, sf_dir, "documents")), "counts"))


ORACLE_SQL = f"""
WITH RECURSIVE step(b, i, v) AS (SELECT b, 0, b FROM range(256) AS t(b) UNION ALL SELECT b, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE i < 8),
crc AS MATERIALIZED (SELECT b, v FROM step WHERE i = 8),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
c AS MATERIALIZED (SELECT row_number() OVER () AS id, *, flatten(list_transform(string_split(doc || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)) AS bytes FROM (SELECT doc, run, count(*) AS k FROM r GROUP BY ALL)),
h(id, i, v) AS (SELECT id, 1, 4294967295 FROM c UNION ALL SELECT h.id, i + 1, xor(h.v >> 8, crc.v) FROM h JOIN c ON c.id = h.id JOIN crc ON crc.b = xor(h.v & 255, bytes[i]::BIGINT) WHERE i <= len(bytes)),
f AS (SELECT run, k, xor(v, 4294967295) AS h FROM c JOIN h ON h.id = c.id AND i = len(bytes) + 1),
w AS (SELECT CASE WHEN h % {EVERY} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM f),
t AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
d AS MATERIALIZED (SELECT word, p, left(word, p - 1) || substr(word, p + 1) AS v FROM t, unnest(range(1, length(word) + 1)) AS u(p)),
e AS (SELECT x.word AS a, y.word AS b FROM d x JOIN d y ON x.v = y.v AND x.p = y.p AND x.word <> y.word UNION SELECT d.word, t.word FROM d JOIN t ON t.word = d.v UNION SELECT t.word, d.word FROM d JOIN t ON t.word = d.v),
b AS (SELECT a AS word, count(*)::BIGINT AS n_near, min((-t.n, b)) AS best FROM e JOIN t ON t.word = b GROUP BY a),
o AS MATERIALIZED (SELECT t.word, t.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= {FACTOR} * t.n THEN best[2] END AS form, CASE WHEN -best[1] >= {FACTOR} * t.n THEN -best[1] END AS form_n FROM t LEFT JOIN b USING (word)),
q(word, root, steps) AS (SELECT word, coalesce(form, word), 0 FROM o UNION ALL SELECT q.word, o.form, steps + 1 FROM q JOIN o ON o.word = q.root WHERE o.form IS NOT NULL)
SELECT o.word, form, max_by(root, steps) AS root, n, n_near, form_n::BIGINT AS form_n FROM o JOIN q USING (word) GROUP BY ALL
"""
