"""Token-ID output: length-delimited binary records, with an offset index for shuffled reads.

File format. A shard ``part-NNNNN.rec`` is a run of records, each

    length   8 bytes  little-endian, bytes of the payload
    check    4 bytes  masked CRC-32 of the length's 8 bytes
    payload           8 bytes doc_id (signed; MISSING for null), 1 byte width, then the ids, each
                      of width bytes, unsigned: 2 where every id of the vocabulary fits, else 4
    check    4 bytes  masked CRC-32 of the payload

with masked(c) = ((c >> 15 | c << 17) + 0xA282EAD8) mod 2^32, so that a check over bytes that hold
checks stays sound. ``part-NNNNN.idx`` has per record, in the same order, four little-endian
64-bit integers: offset and size of the record, doc_id, and how many ids the shard holds before
it. Any record can be read alone, in any order.

A shard holds one range of doc_id, ascending, of about SHARD_BYTES of text; shards ascend. Each task writes its own shard under
a temporary name and renames it, so a task that runs again, after an executor was lost, leaves the
same bytes. The files go to the shared folder through pyarrow's file systems.

Null texts are empty and give one id, the end id. Rows with the same doc_id stay separate and
stand side by side, ordered by their texts' hashes, then texts. Null doc_ids come first. Texts of any
length are one record. Columns beyond doc_id and text don't matter, whatever their names. An empty
table gives no record.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding
from .common import bounded_batches, pick, scratch

MISSING = -(1 << 63)
SHARD_BYTES = 256 << 20
_HEAD = "<QI"
_INDEX = "<QQqQ"


def masked(data: bytes | memoryview) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def records(stream, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each record; raises ValueError where a check fails or the file is cut off."""
    while head := stream.read(struct.calcsize(_HEAD)):
        if len(head) < struct.calcsize(_HEAD):
            raise ValueError(f"record at {at}: cut off")
        length, check = struct.unpack(_HEAD, head)
        if masked(head[:8]) != check:
            raise ValueError(f"record at {at}: the length's check fails")
        payload, tail = stream.read(length), stream.read(4)
        if len(payload) < length or len(tail) < 4:
            raise ValueError(f"record at {at}: cut off")
        if struct.unpack("<I", tail)[0] != masked(payload):
            raise ValueError(f"record at {at}: the payload's check fails")
        yield at, payload
        at += struct.calcsize(_HEAD) + length + 4


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of a record's payload."""
    doc, width = struct.unpack_from("<qB", payload)
    ids = np.frombuffer(payload, f"<u{width}", offset=struct.calcsize("<qB")).astype(np.uint32)
    return (None if doc == MISSING else doc), ids


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text) and write them as shards under path. Returns one row per shard: shard, n_docs, n_tokens.

    The result is stored: it has a row for each shard, thousands at most.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = pick(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    if not shards:
        held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // SHARD_BYTES))
    rows = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        shard, coder = context.partitionId(), encoding.encoder(tokenizer)
        store, root = _store(path)
        store.create_dir(root, recursive=True)
        name, own = f"{root}/part-{shard:05d}", f"{root}/.part-{shard:05d}-{context.taskAttemptId()}"
        width = 2 if max(end_id + 1, coder.tokenizer.get_vocab_size()) <= 1 << 16 else 4
        kind = np.dtype(f"<u{width}")
        end = np.array([end_id], kind).tobytes()
        n_docs = n_tokens = at = 0
        with store.open_output_stream(f"{own}.rec") as rec, store.open_output_stream(f"{own}.idx") as idx:
            for batch in batches:
                ids_of = batch.column(0).to_pylist()
                for first, ids, total in coder.encode(batch.column(1)):
                    raw, cut, out, entries = ids.astype(kind).tobytes(), (total * width).tolist(), [], []
                    for k in range(len(cut) - 1):
                        doc = ids_of[first + k]
                        doc = MISSING if doc is None else doc
                        one = frame(struct.pack("<qB", doc, width) + raw[cut[k] : cut[k + 1]] + end)
                        entries.append(struct.pack(_INDEX, at, len(one), doc, n_tokens))
                        out.append(one)
                        at += len(one)
                        n_tokens += (cut[k + 1] - cut[k]) // width + 1
                        n_docs += 1
                    rec.write(b"".join(out))
                    idx.write(b"".join(entries))
        for kind in ("rec", "idx"):
            store.move(f"{own}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], ["shard", "n_docs", "n_tokens"])

    told = rows.mapInArrow(encoding.tidy(write), "shard int, n_docs long, n_tokens long")
    manifest = f"{path}/manifest"
    told.write.mode("overwrite").parquet(manifest)
    return spark.read.schema(told.schema).parquet(manifest)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, all checks done: doc_id, start (ids in all records before it), n_tokens, ids_crc32, shard, offset, ids."""
    shards = spark.read.parquet(f"{path}/manifest").filter("n_docs > 0").orderBy("shard").collect()  # a row per shard
    base = np.cumsum([0, *(r.n_tokens for r in shards)]).tolist()
    todo = [(r.shard, b) for r, b in zip(shards, base, strict=False)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        for batch in batches:
            for shard, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/part-{shard:05d}.rec", buffer_size=1 << 20) as rec:
                    rows, size = [], 0
                    for at, payload in records(rec):
                        doc, ids = parse(payload)
                        rows.append((doc, before, len(ids), zlib.crc32(ids), shard, at, ids.tobytes()))
                        before += len(ids)
                        size += ids.nbytes
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                    yield _batch(rows)

    tasks = spark.createDataFrame(todo, "shard int, before long")
    return tasks.repartition(max(1, len(todo)), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, offset long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.binary()]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def read_one(path: str, shard: int, number: int) -> tuple[int | None, list[int]]:
    """One record by its number in a shard, through the offset index alone."""
    store, root = _store(path)
    with store.open_input_file(f"{root}/part-{shard:05d}.idx") as idx:
        idx.seek(number * struct.calcsize(_INDEX))
        at, size, _, _ = struct.unpack(_INDEX, idx.read(struct.calcsize(_INDEX)))
    with store.open_input_file(f"{root}/part-{shard:05d}.rec") as rec:
        rec.seek(at)
        import io

        _, payload = next(records(io.BytesIO(rec.read(size)), at))
    doc, ids = parse(payload)
    return doc, ids.tolist()


def op2_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, write the records, read them back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = scratch(spark, "records")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_records(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_records(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
