"""Shared helpers: documents with nulls, ties, repeats, odd columns; brute-force versions."""

from __future__ import annotations

import re

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def docs(spark, *texts, sources=None):
    rows = [(i, t, "en", (sources[i] if sources else f"s{i % 3}"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Null and empty texts, null keys, repeated rows, a long text, and extra columns whose names clash."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two three four five six", "en", "a", 5), (3, "one two three four five six", "en", "a", 5), (None, "one two three four five six", "en", None, 5), (5, long, "de", "b", 9), (6, " \n\t ", "de", "b", 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("doc_id", "text", "lang", "source", "n_chars", "'x' AS Text", "1 AS DOC_ID", "array(1) AS ids")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(nodes, links):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}
