"""Fill-in-middle: texts cut into prefix, middle and suffix, with the middle moved to the end.

Method: run-length class encoding. The class of a code point is the number of bytes that it takes in
UTF-8, so all of one class are equally long. Of each text only its maximal runs of one class are
stored: first byte, cumulative count of code points before it, width. The run that contains a cut is
found by binary search in those counts, and the cut's byte is first + (cut - count) * width. A text of
one script has few runs, however long it is; nothing is stored per code point.

A document's four numbers h1 to h4 are the first four 8-digit groups of the hex SHA-256 of
``seed:doc_id``, so the same document is always cut in the same way, wherever it stands. The prefix
ends after the smaller of h1 % (n + 1) and h2 % (n + 1) code points, the middle after the larger.
Forms: ``plain`` (the text as it is), ``psm`` (P prefix S suffix M middle) and ``spm`` (S suffix P
prefix M middle), with a marker for each part.

A null text is an empty one. Empty texts and texts that hold a marker are plain, so markers stand in an
output exactly where they were put, and ``restored`` gives the text back from output and form alone.
Cuts of the same place (an empty middle), at 0 and at the end are cuts like any others. A null doc_id
counts as an empty string in the hash. Repeated rows get the same answer each. Texts of any length are
cut whole. Columns beyond doc_id and text don't matter, whatever their names. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import Block, blocks
from .common import bounded_batches, pick, table

MARKERS = ("<P>", "<S>", "<M>")
#: Of 100 documents so many are rearranged, and of 100 of those so many as spm.
RATE = 90
SPM = 20
SEED = "1"


class Runs:
    """The maximal runs of code points of one width in a block's texts, as first byte, code points before, width."""

    def __init__(self, block: Block):
        data = block.data
        width = 1 + (data >= 0xC0).astype(np.int8) + (data >= 0xE0) + (data >= 0xF0)
        width[(data & 0xC0) == 0x80] = 0  # not the first byte of a code point
        first = np.flatnonzero(width)
        kind = width[first]
        head = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])) if len(first) else np.zeros(0, np.int64)
        self.at, self.before, self.width = first[head], head, kind[head].astype(np.int64)
        self.base = self.count(block.start)
        self.n = self.count(block.end) - self.base

    def count(self, byte: np.ndarray) -> np.ndarray:
        """How many code points stand before the byte, which begins one or ends the data."""
        if not len(self.at):
            return np.zeros(len(byte), np.int64)
        r = np.maximum(np.searchsorted(self.at, byte, side="right") - 1, 0)
        return self.before[r] + (byte - self.at[r]) // self.width[r]

    def byte(self, text: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """The byte before which ``cut`` code points of the text stand."""
        if not len(self.at):
            return np.zeros(len(text), np.int64)
        place = self.base[text] + cut
        r = np.searchsorted(self.before, place, side="right") - 1
        return self.at[r] + (place - self.before[r]) * self.width[r]


def _checked(markers: tuple[str, str, str]) -> tuple[str, str, str]:
    """Markers of which none can begin inside another or at its end: only then can each be found again."""
    if len(set(markers)) != 3 or not all(markers):
        raise ValueError(f"markers {markers}")
    for x in markers:
        for y in markers:
            if x != y and x in y or any(x.endswith(y[:k]) for k in range(1, len(y) + (x != y))):
                raise ValueError(f"marker {x!r} overlaps {y!r}")
    return markers


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: str = SEED, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """docs (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output; the counts are null for plain texts."""
    p, s, m = _checked(markers)
    bounded_batches(docs.sparkSession)
    rows = pick(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, i, 8), 16, 10).cast("long") for i in (1, 9, 17, 25))
    holds = F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m))
    form = F.when((F.col("text") == "") | holds | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    pb, sb, mb = (x.encode() for x in markers)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column(2).to_pylist()
            h = [batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4)]
            for first, block in blocks(batch.column(1)):
                own, runs, texts = slice(first, first + len(block)), Runs(block), np.arange(len(block))
                one, two = (x[own] % (runs.n + 1) for x in h)
                low, high = np.minimum(one, two), np.maximum(one, two)
                edges = (block.start, runs.byte(texts, low), runs.byte(texts, high), block.end)
                raw, out = block.data.tobytes(), []
                for kind, a, b, c, d in zip(forms[own], *(x.tolist() for x in edges), strict=True):
                    if kind == "plain":
                        out.append(raw[a:d])
                    elif kind == "psm":
                        out.append(b"".join((pb, raw[a:b], sb, raw[c:d], mb, raw[b:c])))
                    else:
                        out.append(b"".join((sb, raw[c:d], pb, raw[a:b], mb, raw[b:c])))
                plain = np.array([x == "plain" for x in forms[own]], bool)
                counts = [pa.array(runs.n), batch.column(2).slice(first, len(block)), pa.array(low, mask=plain), pa.array(high - low, mask=plain)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(block)), *counts, pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text of an output, put together again from its parts."""
    p, s, m = _checked(markers)
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)

    def parts(first: str, second: str) -> tuple[Column, Column]:
        return F.substr(F.substring_index(head, second, 1), F.lit(len(first) + 1)), F.substring_index(head, second, -1)

    prefix, suffix = parts(p, s)
    after, before = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(before, middle, after)).otherwise(output)


def op11_run_length_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged: doc_id, n, form, prefix_chars, middle_chars, and digests of the output and of the text rebuilt from it."""
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = [F.sha2(x.cast("binary"), 256).alias(name) for x, name in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
