"""Sharding: a uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows stand in input parts of at most PART_ROWS rows: runs of a stored copy, numbered as they were
written. Shards of exact sizes, at most one row apart, are cut into blocks of about BLOCK_ROWS
slots. For a uniformly random order of all rows, how many of a part's rows fall into each block is
a row of a matrix with the multivariate hypergeometric law, exact in both its margins. Each part is
permuted locally and dealt to the blocks by its row of the matrix, rows are exchanged once, and each
block is permuted again. The result has the law of a global shuffle, while no task ever holds more
than one block or one part's permutation.

The matrix is never built. It is drawn as a binary tree over the parts: a node holds the open slots
of every block for a run of parts, and a draw seeded by that run alone splits them between its two
halves. A task that meets a part's rows walks from the root to that part, some log2(parts) draws of
one number a block. All that is sent to tasks is a key and a row count for each part; the blocks
follow from the total. Populations beyond what the library's sampler takes are drawn by inversion.

Repeated rows are rows like any other; null text counts as no bytes; extra columns, whatever their
names, are kept. An empty table gives no row. Draws depend on the seed, and on the stored rows' order
and numbers alone. The law is "rows".
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick

SHARDS = 24
BLOCK_ROWS = 25_000
SEED = 20_240_501
PART_ROWS = 1 << 18
#: The library draws from populations of fewer than 10**9; larger ones are first split into groups of half that.
LARGE = 10**9


class Blocks:
    """Sizes and places of all blocks: each shard's slots in equal runs, as many for every shard."""

    def __init__(self, total: int, shards: int, block_rows: int):
        self.total, self.shards = total, shards
        self.each = max(1, -(-(-(-total // shards)) // block_rows))  # blocks a shard

    def _rows(self, shard):
        return self.total // self.shards + (shard < self.total % self.shards)

    def sizes(self) -> np.ndarray:
        k = np.arange(self.shards * self.each, dtype=np.int64)
        rows, j = self._rows(k // self.each), k % self.each
        return rows // self.each + (j < rows % self.each)

    def place(self, block: int) -> tuple[int, int]:
        """The shard of a block, and its first slot there."""
        shard, j = divmod(block, self.each)
        rows = int(self._rows(shard))
        return shard, j * (rows // self.each) + min(j, rows % self.each)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws from good + bad, none put back, are good; at any size.

    Beyond the library's bound by inversion: the law's ratios of neighbours give it in full for 12
    standard deviations around its mode, beyond which less than 1e-30 is left.
    """
    if good + bad < LARGE:
        return int(rng.hypergeometric(good, bad, n))
    total, low, high = good + bad, max(0, n - bad), min(n, good)
    spread = np.sqrt(float(n) * (good / total) * (bad / total) * ((total - n) / max(1, total - 1)))
    mode, width = (n + 1) * (good + 1) // (total + 2), int(12 * spread) + 50
    x = np.arange(max(low, mode - width), min(high, mode + width), dtype=np.float64)
    steps = np.log(good - x) + np.log(n - x) - np.log(x + 1) - np.log(float(bad - n) + x + 1)
    log = np.concatenate([[0.0], np.cumsum(steps)])
    share = np.cumsum(np.exp(log - log.max()))
    return max(low, mode - width) + int(np.searchsorted(share, rng.random() * share[-1], side="right"))


def split(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How many of each block's open slots go to n of the rows that are to fill them all."""
    if len(sizes) == 1:
        return np.array([n], np.int64)
    if sizes.sum() < LARGE:
        return rng.multivariate_hypergeometric(sizes, n, method="marginals")
    out, left, rest = [], n, int(sizes.sum())
    group = (np.cumsum(sizes) - 1) // (LARGE // 2)
    for own in np.split(sizes, np.flatnonzero(np.diff(group)) + 1):
        held = int(own.sum())
        rest -= held
        k = hypergeometric(rng, held, rest, left)
        out.append(split(rng, own, k))
        left -= k
    return np.concatenate(out)


def matrix_row(part: int, edges: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """How many rows of a part go to each block. edges: the rows before each part, and all rows."""
    low, high, slots = 0, len(edges) - 1, sizes
    while high - low > 1:
        middle = (low + high) // 2
        mine = split(np.random.Generator(np.random.PCG64([seed, 0, low, high])), slots, int(edges[middle] - edges[low]))
        if part < middle:
            high, slots = middle, mine
        else:
            low, slots = middle, slots - mine
    return slots


def shuffle_rows(rows: DataFrame, shards: int = SHARDS, block_rows: int = BLOCK_ROWS, seed: int = SEED, part_rows: int = PART_ROWS) -> DataFrame:
    """Add shard (int) and slot (long, gapless from 0 in each shard) to rows, whose columns are kept.

    rows is stored once in the shared folder, with the part of each row and its number there.
    """
    names = rows.columns
    flat = [f"_c{i}" for i in range(len(names))]
    numbered = rows.toDF(*flat).withColumn("_id", F.monotonically_increasing_id())
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in the task that writes it
    part = F.shiftright("_id", 33) * F.lit((1 << 33) // part_rows + 1) + F.floor(place / part_rows)
    numbered = numbered.withColumns({"_part": part, "_at": place % part_rows}).drop("_id")
    stored = materialize(numbered, "to-shard")
    counts = stored.groupBy("_part").count().orderBy("_part").toArrow()  # a row for each part_rows rows and each task
    if not counts.num_rows:
        return stored.limit(0).select(*flat, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).toDF(*names, "shard", "slot")
    edges = np.concatenate([[0], np.cumsum(counts.column("count").to_numpy())])
    blocks = Blocks(int(edges[-1]), shards, block_rows)
    sent = rows.sparkSession.sparkContext.broadcast((counts.column("_part").to_numpy(), edges))

    def deal(batches):
        """Each row's place in its part's permutation, and the block that place is dealt to."""
        keys, edges = sent.value
        sizes, last, order, until = blocks.sizes(), None, None, None
        for batch in batches:
            n = batch.num_columns
            part, at = np.searchsorted(keys, batch.column(n - 2).to_numpy()), batch.column(n - 1).to_numpy()
            block, key = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
            for p in np.unique(part).tolist():
                if p != last:
                    last, row = p, matrix_row(p, edges, sizes, seed)
                    order, until = np.random.Generator(np.random.PCG64([seed, 1, p])).permutation(int(row.sum())), np.cumsum(row)
                mine = part == p
                own = order[at[mine]]
                block[mine] = np.searchsorted(until, own, side="right")
                key[mine] = own + (p << 32)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], pa.array(block), pa.array(key)], [*flat, "_block", "_key"])

    def settle(table: pa.Table) -> pa.Table:
        """Permute one block, whose rows first stand in the order of their keys."""
        table = table.take(pa.compute.sort_indices(table.column("_key")))
        b = table.column("_block")[0].as_py()
        shard, first = blocks.place(b)
        slot = np.random.Generator(np.random.PCG64([seed, 2, b])).permutation(table.num_rows) + first
        return pa.table([*(table.column(c) for c in flat), pa.array(np.full(table.num_rows, shard, np.int32)), pa.array(slot)], [*flat, "shard", "slot"])

    kinds = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(flat, rows.schema, strict=True))
    dealt = stored.mapInArrow(deal, f"{kinds}, _block int, _key long")
    return dealt.groupBy("_block").applyInArrow(settle, f"{kinds}, shard int, slot long").toDF(*names, "shard", "slot")


def op9_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deal all documents into 24 shards whose row counts are at most one apart."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    return shuffle_rows(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
