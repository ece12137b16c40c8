import hashlib
import random

import pyarrow as pa
import pytest
from cases import awkward, docs, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.llm import fim
from citeloom.llm.bytewords import blocks


@given(st.lists(st.lists(st.sampled_from("ab é ßж日本😀\n<>P"), max_size=30).map("".join), min_size=1, max_size=12), st.randoms())
@settings(max_examples=200, deadline=None)
def test_cuts_by_runs_equal_cuts_by_code_points(texts, rng):
    import numpy as np

    ((_, block),) = list(blocks(pa.array(texts)))
    runs = fim.Runs(block)
    assert runs.n.tolist() == [len(t) for t in texts]
    cuts = [rng.randrange(len(t) + 1) for t in texts]
    got = runs.byte(np.arange(len(texts)), np.array(cuts)) - block.start
    assert got.tolist() == [len(t[:c].encode()) for t, c in zip(texts, cuts, strict=True)]


def by_hand(doc, text):
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fim.MARKERS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_against_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    texts = ["".join(rng.choice("abc é日😀\n<P") for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", "<P>", "x<S>", "<<M", "<", "é" * 70_000, "a" * 600_000 + "日"]
    out = fim.fill_in_middle(docs(spark, *texts)).withColumn("again", fim.restored(F.col("output"), F.col("form")))
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert got == {i: (*by_hand(i, t), t or "") for i, t in enumerate(texts)}
    assert {r[1] for r in got.values()} == {"plain", "psm", "spm"}


def test_awkward_rows_and_none(spark):
    rows = fim.fill_in_middle(awkward(spark)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "2", "3", "3", "None", "5", "6"])
    for r in rows:
        text = {1: None, 2: "", 3: "one two three four five six", None: "one two three four five six", 6: " \n\t "}.get(r.doc_id)
        assert r.doc_id == 5 or tuple(r)[1:] == by_hand(r.doc_id, text)
    assert fim.fill_in_middle(empty(spark)).count() == 0


def test_rates_and_markers(spark):
    df = docs(spark, *["some text"] * 50)
    assert {r.form for r in fim.fill_in_middle(df, rate=0).collect()} == {"plain"}
    assert {r.form for r in fim.fill_in_middle(df, rate=100, spm=100).collect()} == {"spm"}
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("ab", "bc", "x"), ("aba", "x", "y"), ("a<P>", "<P>", "x"), ("xx", "yxxy", "z")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(df, markers=bad)
