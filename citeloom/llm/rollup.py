"""Token counts: a rollup by source, language and tokenizer version, kept by signed deltas.

A change feed has rows (kind, doc_id, source, lang, tokenizer_version, n_tokens, old_tokens):
an insert adds a document and its tokens, a delete takes both away, a revise replaces old_tokens
by n_tokens. Each batch is summed to signed totals per key and committed under its batch id; the
rollup is the sum of all committed batches, so batches can arrive in any order, late, or twice.

Commit. A batch is summed into a folder of its own under ``data``. What commits it is a marker named
by the batch id, published whole by one atomic step that fails if the name is there (a hard link on a
local disk, a rename that never overwrites elsewhere); the marker names the folder. So of any
writers of one batch id exactly one succeeds, the others are told False and their folders go, and a
batch counts once however often it is sent. ``compact`` sums the markers of one listing into a base,
which names exactly those batches and is published the same way under the next number; readers take
the newest base and the markers it doesn't hold. A batch committed meanwhile is in no list of that
base, so it stays open. A writer that dies leaves a folder that no marker names, which counts for
nothing. Everything lives in one folder that all machines share.

Source, language or version may be null and are keys like any other; null counts are 0. Rows that
repeat within a batch count each time. Keys whose documents and tokens both come to 0 vanish. An
empty batch is committed and adds nothing; a store without batches has no row. Columns beyond those
named don't matter, even where their names differ from these in case alone. Texts of any length count
whole, null ones 0. Skew: sums are combined before the exchange, one row per key and task.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding
from .common import WORD, bounded_batches, materialize, pick, scratch

KEYS = ("source", "lang", "tokenizer_version")
_SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in ("data", "batches", "bases"):
            self._fs.mkdirs(self._path(f"{self.path}/{folder}"))

    def _names(self, folder: str) -> list[str]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")))
        return sorted(n for n in names if n[:1] not in "._")

    def _publish(self, folder: str, name: str, data: str) -> bool:
        """Make the marker folder/name, which names a folder of data; False if there is one already. One atomic step."""
        jvm, ready = self.spark._jvm, self._path(f"{self.path}/data/.{uuid.uuid4().hex}")
        out = self._fs.create(ready, False)
        out.write(bytearray(data.encode()))
        out.close()
        ready, final = self._fs.makeQualified(ready), self._fs.makeQualified(self._path(f"{self.path}/{folder}/{name}"))
        try:
            if final.toUri().getScheme() == "file":
                paths = jvm.java.nio.file.Paths
                jvm.java.nio.file.Files.createLink(paths.get(final.toUri()), paths.get(ready.toUri()))
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(ready, final, none)
        except Py4JJavaError as refused:
            if "FileAlreadyExists" not in refused.java_exception.getClass().getName():
                raise
            return False
        finally:
            self._fs.delete(ready, False)
        return True

    def _named(self, folder: str, name: str) -> str:
        """The folder that a marker names."""
        stream = self._fs.open(self._path(f"{self.path}/{folder}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def committed(self) -> list[str]:
        return self._names("batches")

    def _sum(self, changes: DataFrame) -> str:
        """Write a batch's signed sums; the folder's name. Nothing is committed."""
        n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        kind = F.col("kind")
        docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce(kind, F.lit("null")))))
        tokens = F.when(kind == "insert", n).when(kind == "delete", -n).when(kind == "revise", n - old)
        rows = pick(changes, kind="kind", n_tokens="n_tokens", old_tokens="old_tokens", **{k: k for k in KEYS})
        sums = rows.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))
        name = uuid.uuid4().hex
        sums.write.parquet(f"{self.path}/data/{name}")
        return name

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False if one of that id is there already, which then stays as it is."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch_id):
            raise ValueError(f"batch id {batch_id!r}")
        if self._fs.exists(self._path(f"{self.path}/batches/{batch_id}")):  # spares the work; the marker decides
            return False
        data = self._sum(changes)
        if self._publish("batches", batch_id, data):
            return True
        self._fs.delete(self._path(f"{self.path}/data/{data}"), True)
        return False

    def _state(self) -> tuple[int, str | None, list[str], list[str]]:
        """Number and folder of the newest base, the batches it holds, and the open ones; of one listing."""
        batches, bases = self.committed(), self._names("bases")
        if not bases:
            return -1, None, [], batches
        number = max(map(int, bases))
        data = self._named("bases", str(number))
        held = [r.batch for r in self.spark.read.parquet(f"{self.path}/data/{data}/batches").toLocalIterator()]
        return number, data, held, sorted(set(batches) - set(held))

    def _totals(self, base: str | None, open_batches: list[str]) -> DataFrame:
        paths = [f"{self.path}/data/{self._named('batches', b)}" for b in open_batches] + ([f"{self.path}/data/{base}/totals"] if base else [])
        if not paths:
            return self.spark.createDataFrame([], _SCHEMA)
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens."""
        _, base, _, open_batches = self._state()
        return self._totals(base, open_batches)

    def compact(self) -> bool:
        """Write a new base that holds every batch committed so far; False if another writer's base came first."""
        number, base, held, open_batches = self._state()
        data = uuid.uuid4().hex
        self._totals(base, open_batches).write.parquet(f"{self.path}/data/{data}/totals")
        self.spark.createDataFrame([(b,) for b in held + open_batches], "batch string").write.parquet(f"{self.path}/data/{data}/batches")
        if self._publish("bases", str(number + 1), data):
            return True
        self._fs.delete(self._path(f"{self.path}/data/{data}"), True)
        return False


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs: doc_id, source, lang, text. Returns doc_id, source, lang, n_tokens: the ids of the whole text by a tokenizer file."""
    bounded_batches(docs.sparkSession)
    rows = pick(docs, doc_id="doc_id", source="source", lang="lang", text="text").withColumn("text", F.coalesce("text", F.lit("")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding.encoder(tokenizer)
        for batch in batches:
            for first, _, total in coder.encode(batch.column(3)):
                own = [batch.column(c).slice(first, len(total) - 1) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(total).astype(np.int64))], ["doc_id", "source", "lang", "n_tokens"])

    return rows.mapInArrow(encoding.tidy(count), "doc_id long, source string, lang string, n_tokens long")


def change(rows: DataFrame, kind: str, version: str, n, old=None) -> DataFrame:
    """A change feed of one kind and version for rows (doc_id, source, lang, ...); n and old are columns."""
    old = F.lit(None).cast("long") if old is None else old
    return rows.select(F.lit(kind).alias("kind"), "doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), n.alias("n_tokens"), old.alias("old_tokens"))


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep the rollup of all documents through four batches, one of them sent twice.

    load: every document under two tokenizer versions: words_v1 (runs without white space), counted
    first as a quarter of the characters, and bytes_v1 (UTF-8 bytes). exact: words_v1 is revised to
    true counts. empty: documents without words are deleted. recount: bytes_v1 becomes bytes_v2 for
    even-length documents, a delete and an insert. Batch exact arrives twice, and counts once.
    """
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", source="source", lang="lang", text="text")
    docs = docs.select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    rough, words, size = F.expr("length(text) DIV 4").cast("long"), F.regexp_count("text", F.lit(WORD)).cast("long"), F.octet_length("text").cast("long")
    store = TokenRollup(spark, scratch(spark, "rollup"))
    store.commit("load", change(docs, "insert", "words_v1", rough).unionAll(change(docs, "insert", "bytes_v1", size)))
    exact = change(docs, "revise", "words_v1", words, rough)
    store.commit("exact", exact)
    store.commit("exact", exact)
    blank = docs.filter(~F.col("text").rlike(WORD))
    store.compact()
    store.commit("empty", change(blank, "delete", "words_v1", F.lit(0).cast("long")).unionAll(change(blank, "delete", "bytes_v1", size)))
    even = docs.filter((size % 2 == 0) & F.col("text").rlike(WORD))
    store.commit("recount", change(even, "delete", "bytes_v1", size).unionAll(change(even, "insert", "bytes_v2", size)))
    return store.totals()


def token_rollup_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of all documents by two tokenizers' true token counts, through four batches.

    load: every document under byte_bpe, counted first as a quarter of its bytes. rough: those guesses are taken
    back. exact: revised to what the tokenizer gives. move: documents of the language "en" go from byte_bpe to word_bpe, a delete and an insert.
    """
    import public_tokenizers

    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", source="source", lang="lang", text="text")
    size = (F.octet_length(F.coalesce("text", F.lit(""))) / 4).cast("long")
    store = TokenRollup(spark, scratch(spark, "rollup"))
    store.commit("load", change(docs, "insert", "byte_bpe", size))
    store.commit("rough", change(docs, "revise", "byte_bpe", F.lit(0).cast("long"), size))
    counted = materialize(token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")), "counts")
    store.commit("exact", change(counted, "revise", "byte_bpe", F.col("n_tokens")))
    store.compact()
    english = F.col("lang") == "en"
    words = token_counts(docs.filter(english), public_tokenizers.path("word_bpe_49k.json"))
    store.commit("move", change(counted.filter(english), "delete", "byte_bpe", F.col("n_tokens")).unionAll(change(words, "insert", "word_bpe", F.col("n_tokens"))))
    return store.totals()


ORACLE_SQL = r"""
WITH d AS (SELECT source, lang, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words, coalesce(octet_length(encode(text)), 0) AS size FROM documents),
v AS (SELECT source, lang, 'words_v1' AS tokenizer_version, words AS n FROM d WHERE words > 0
  UNION ALL SELECT source, lang, CASE WHEN size % 2 = 0 THEN 'bytes_v2' ELSE 'bytes_v1' END, size FROM d WHERE words > 0)
SELECT source, lang, tokenizer_version, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM v GROUP BY ALL
"""
