"""Vector best-fit packing of token pieces into training sequences.

A sequence has three capacities: tokens, documents (pieces) and attention cost (the sum of squared
piece lengths). Pieces are placed longest first; each goes to the open sequence that fits it in
every dimension and is left with the smallest weighted norm of its residual capacities, each taken
as a share of its capacity (rule "norm"), or whose residuals have the smallest weighted dot
product with the piece's demands ("dot": residuals that match the demand least are kept for
others). Ties go to the sequence opened first. A piece that fits no open sequence opens one.

All capacities hold in every sequence, whatever that costs. Those for documents and cost that a caller
doesn't name follow from the whole load: DOCS_SLACK and COST_SLACK times what a sequence holds of them on
average, at the fewest sequences that the tokens allow, and at least the share of the longest piece. So they
bind where short or long pieces crowd into one sequence, and are wide enough for nearly as few sequences
as the tokens allow.

Pieces of one group are packed in one task. Groups are dealt by a stored row number, about
GROUP_PIECES pieces each whatever the table's size and whatever repeats in it, so a task's memory is
bounded and at most one or two sequences a group are not full.

Only piece lengths are exchanged; texts never are. A null or empty text still has its end id, a
piece of length 1. Repeated rows and null doc_ids are documents of their own, each with its own
pieces. Texts of any length are encoded whole and cut. Ties in length go by doc_id, piece and
checksum. Other columns, whatever their names, are left out. An empty table gives no row.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding
from .common import bounded_batches, materialize, pick

GROUP_PIECES = 50_000
DOCS_SLACK = 16
COST_SLACK = 4


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Encode docs (doc_id, text) and cut those longer than capacity: doc_id, piece, start, length, ids_crc32[, ids]."""
    bounded_batches(docs.sparkSession)
    rows = pick(docs, doc_id="doc_id", text="text")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding.encoder(tokenizer)
        end = np.array([end_id], np.uint32).tobytes()
        for batch in batches:
            docs_of = batch.column(0).to_pylist()
            for first, ids, total in coder.encode(batch.column(1)):
                raw, at, out = ids.tobytes(), (total * 4).tolist(), []
                for k in range(len(at) - 1):
                    own = raw[at[k] : at[k + 1]] + end
                    for piece, lo in enumerate(range(0, len(own), 4 * capacity)):
                        part = own[lo : lo + 4 * capacity]
                        out.append((docs_of[first + k], piece, lo // 4, len(part) // 4, zlib.crc32(part), part))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return rows.mapInArrow(encoding.tidy(cut), schema)


def best_fit(lengths: list[int], capacity: int, max_docs: int, max_cost: int, weights: tuple[float, float, float], rule: str) -> list[int]:
    """The sequence of each piece; lengths must be in descending order.

    Open sequences are kept by residual tokens, those of one residual ordered by what the other two
    dimensions add to the objective. Residuals are tried from the tightest up, and the search ends
    where the token share alone is no better than the best found.
    """
    wt, wd, wc = weights
    spots: dict[int, list[tuple[float, int]]] = {}
    sizes: list[int] = []  # residual token counts that have open sequences, ascending
    docs: list[int] = []
    cost: list[int] = []
    out = []

    def share(k: int, n: int) -> float:
        if rule == "dot":
            return wd * (docs[k] / max_docs) / max_docs + wc * (cost[k] / max_cost) * (n * n / max_cost)
        return wd * (docs[k] / max_docs) ** 2 + wc * (cost[k] / max_cost) ** 2

    for n in lengths:
        best: tuple[float, int, int] | None = None
        i = bisect_left(sizes, n)
        while i < len(sizes):
            room = sizes[i]
            tokens = wt * (room / capacity) * (n / capacity) if rule == "dot" else wt * ((room - n) / capacity) ** 2
            if best and tokens > best[0]:
                break
            for other, k in spots[room]:
                if best and tokens + other > best[0]:
                    break
                if docs[k] >= 1 and cost[k] >= n * n and (best is None or (tokens + other, k) < best[:2]):
                    best = (tokens + other, k, room)
                    break
            i += 1
        if best is None:
            k, room = len(docs), capacity
            docs.append(max_docs)
            cost.append(max_cost)
        else:
            k, room = best[1], best[2]
            own = spots[room]
            own.remove(next(x for x in own if x[1] == k))
            if not own:
                del spots[room]
                sizes.pop(bisect_left(sizes, room))
        docs[k] -= 1
        cost[k] -= n * n
        room -= n
        out.append(k)
        if room and docs[k] and cost[k]:
            if room not in spots:
                spots[room] = []
                insort(sizes, room)
            insort(spots[room], (share(k, 0) if rule == "norm" else share(k, n), k))
    return out


def pack_pieces(
    pieces: DataFrame, capacity: int = 4096, max_docs: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm", group_pieces: int = GROUP_PIECES
) -> DataFrame:
    """Pack pieces (doc_id, piece, start, length, ids_crc32): adds sequence_id and offset.

    Capacities that are not named follow from the load.
    Raises ValueError for a capacity or a rule that makes no sense, and for a piece that no empty
    sequence can take.
    """
    if rule not in ("norm", "dot") or capacity < 1 or (max_docs is not None and max_docs < 1):
        raise ValueError(f"rule {rule!r}, capacity {capacity}, max_docs {max_docs}")
    rows = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    total, tokens, cost, longest = rows.agg(F.count(F.lit(1)), F.sum("length"), F.sum(F.col("length") * F.col("length")), F.max("length")).first()
    least = max(1, -(-(tokens or 0) // capacity))
    docs = max_docs or max(2, -(-DOCS_SLACK * total // least))
    area = max_cost or max((longest or 0) ** 2, -(-COST_SLACK * (cost or 0) // least))
    groups = max(1, -(-total // group_pieces))
    keyed = rows.withColumn("pack_group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_pylist()
        if lengths and (lengths[0] > capacity or lengths[0] ** 2 > area):
            raise ValueError(f"a piece of {lengths[0]} tokens fits no sequence")
        found = best_fit(lengths, capacity, docs, area, weights, rule)
        seq = np.array(found, np.int64)
        size = np.array(lengths, np.int64)
        order = np.argsort(seq, kind="stable")
        before = np.cumsum(size[order]) - size[order]
        first = np.append(True, seq[order][1:] != seq[order][:-1])
        offset = np.empty(len(seq), np.int64)
        offset[order] = before - before[first][np.cumsum(first) - 1]
        group = table.column("pack_group")[0].as_py()
        ids = pa.array(seq * groups + group)
        return pa.table([*(table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), ids, pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return keyed.groupBy("pack_group").applyInArrow(pack, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, **limits) -> DataFrame:
    """Encode, cut and pack docs; the encoded pieces' lengths are stored once in the shared folder."""
    return pack_pieces(cut_documents(docs, tokenizer, end_id, capacity), capacity, **limits)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
