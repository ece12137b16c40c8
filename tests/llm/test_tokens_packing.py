import array
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from cases import awkward, docs, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from citeloom.llm import encoding, packing, token_records  # noqa: E402
from citeloom.llm.common import scratch  # noqa: E402

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
PIECES = ["a", "B", "é", "ß", "İ", "Σ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "1", "²", "'s", "don't", "!!", "…", "日本", "😀", "́", "<|endoftext|>", "×", ".", "a.", "é,,"]


@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=30))
@settings(max_examples=150, deadline=None)
@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(path, texts):
    coder = encoding.encoder(path)
    for first, ids, total in coder.encode(pa.array(texts)):
        for k in range(len(total) - 1):
            assert ids[total[k] : total[k + 1]].tolist() == coder.tokenizer.encode(texts[first + k], add_special_tokens=False).ids


def test_encoder_with_a_full_memo(monkeypatch):
    monkeypatch.setattr(encoding, "MEMO_PIECES", 3)
    coder = encoding.Encoder(BYTE)
    texts = ["some words here, more words there"] * 3
    ((_, ids, total),) = list(coder.encode(pa.array(texts)))
    assert ids[: total[1]].tolist() == coder.tokenizer.encode(texts[0]).ids and len(coder.memo) <= 3


def test_records_round_trip(spark):
    path = scratch(spark, "records")
    df = awkward(spark)
    token_records.write_records(df, path, BYTE, 2, shards=3)
    rows = token_records.read_records(spark, path).collect()
    assert len(rows) == 7
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        ids = array.array("I", r.ids)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(r.ids)) and ids[-1] == 2
        at += r.n_tokens
        doc, again = token_records.read_one(path, r.shard, sorted(x.offset for x in rows if x.shard == r.shard).index(r.offset))
        assert (doc, again) == (r.doc_id, list(ids))
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ids == [None, 1, 2, 3, 3, 5, 6]


def test_records_of_the_whole_table_against_the_library(spark):
    """start, n_tokens and ids_crc32 of every document of sf0.001, from the library's own ids."""
    rows = {r.doc_id: r for r in token_records.op2_binary_records(spark, "/root/testdata/sf0.001").collect()}
    tokenizer = encoding.encoder(BYTE).tokenizer
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    start = 0
    for doc, text in table:
        ids = array.array("I", [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2])
        assert (rows[doc].start, rows[doc].n_tokens, rows[doc].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(rows) == len(table)


def test_records_detect_damage(spark, tmp_path):
    import io

    good = token_records.frame(b"payload")
    assert [p for _, p in token_records.records(io.BytesIO(good * 2))] == [b"payload"] * 2
    for i in range(len(good)):
        with pytest.raises(ValueError):
            list(token_records.records(io.BytesIO(good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :])))
    with pytest.raises(ValueError):
        list(token_records.records(io.BytesIO(good[:-1])))


def test_records_of_nothing(spark):
    path = scratch(spark, "records")
    token_records.write_records(empty(spark), path, BYTE, 2)
    assert token_records.read_records(spark, path).count() == 0


def bins(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.sequence_id].append((r.offset, r.length))
    for x in out.values():
        x.sort()
        at = 0
        for offset, length in x:
            assert offset == at
            at += length
    return out


def test_packing_against_the_library(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "Gamma,", "é!"]) for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    rows = packing.pack_documents(docs(spark, *texts), WORD, 1, capacity=64).collect()
    tk = encoding.encoder(WORD).tokenizer
    expected = {}
    for d, t in enumerate(texts):
        ids = tk.encode(t, add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), 64):
            part = ids[p : p + 64]
            expected[d, p // 64] = (p, len(part), zlib.crc32(array.array("I", part).tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected
    found = bins(rows)
    assert all(sum(n for _, n in x) <= 64 for x in found.values())
    assert len(found) <= -(-sum(v[1] for v in expected.values()) // 64) * 1.1 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(spark, rule):
    rows = [(i, 0, 0, 1 + i % 9, i) for i in range(200)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack_pieces(pieces, capacity=30, max_docs=4, max_cost=150, rule=rule, group_pieces=70).collect()
    assert len(out) == 200
    for x in bins(out).values():
        assert sum(n for _, n in x) <= 30 and len(x) <= 4 and sum(n * n for _, n in x) <= 150


def pieces_of(spark, lengths):
    return spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")


def load_capacities(lengths, capacity):
    least = -(-sum(lengths) // capacity)
    return -(-packing.DOCS_SLACK * len(lengths) // least), max(max(lengths) ** 2, -(-packing.COST_SLACK * sum(n * n for n in lengths) // least))


def test_capacities_from_the_load_bind(spark, monkeypatch):
    monkeypatch.setattr(packing, "DOCS_SLACK", 2)
    lengths = [600] * 40 + [1] * 4000
    free = bins(packing.pack_pieces(pieces_of(spark, lengths), 1000, max_docs=5000, max_cost=10**6).collect())
    found = bins(packing.pack_pieces(pieces_of(spark, lengths), 1000).collect())
    docs, _ = load_capacities(lengths, 1000)
    assert max(map(len, free.values())) > docs >= max(map(len, found.values()))  # without it more would crowd into one
    assert len(found) == len(free) == 40


def test_no_group_exceeds_a_capacity_of_the_load(spark):
    rng = random.Random(5)
    loads = {"crowd": [999] * 40 + [1] * 3000, "short": [1] * 5000 + [700] * 9, "mixed": [rng.choice([1, 2, 3, 40, 500, 990, 1000]) for _ in range(3000)]}
    for lengths in loads.values():
        docs, cost = load_capacities(lengths, 1000)
        for group in (150, 50_000):
            found = bins(packing.pack_pieces(pieces_of(spark, lengths), 1000, group_pieces=group).collect())
            assert sum(map(len, found.values())) == len(lengths)
            for x in found.values():
                assert sum(n for _, n in x) <= 1000 and len(x) <= docs and sum(n * n for _, n in x) <= cost


def test_equal_rows_are_dealt_over_all_groups(spark):
    rows = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(300).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"))
    out = packing.pack_pieces(rows, group_pieces=2_500).collect()
    assert len(out) == 20_000 and len({r.sequence_id % 8 for r in out}) == 8
    found = bins(out)
    assert all(len(x) <= 13 for x in found.values()) and len(found) <= -(-20_000 // 13) + 8


def test_best_fit_takes_the_tightest_sequence():
    assert packing.best_fit([7, 6, 4, 3], 10, 10, 1000, (1.0, 0.0, 0.0), "norm") == [0, 1, 1, 0]
    with pytest.raises(ValueError):
        packing.pack_pieces(None, rule="none")


def test_packing_of_awkward_rows(spark):
    rows = packing.pack_documents(awkward(spark), WORD, 1).collect()
    assert sorted(str(r.doc_id) for r in rows if r.piece == 0) == sorted(["1", "2", "3", "3", "None", "5", "6"])
    assert {r.length for r in rows if r.doc_id in (1, 2, 6)} == {1}
    assert packing.pack_documents(empty(spark), WORD, 1).count() == 0
