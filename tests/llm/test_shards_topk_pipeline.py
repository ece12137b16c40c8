import random
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import awkward, docs, empty, words
from pyspark.sql import functions as F

from citeloom.llm import sharding, topk


def test_shards_have_exact_sizes(spark):
    rows = spark.range(1003).repartition(5).select(F.col("id").alias("doc_id"))
    out = sharding.shuffle_rows(rows, shards=7, block_rows=30).collect()
    assert sorted(r.doc_id for r in out) == list(range(1003))
    slots = {s: sorted(r.slot for r in out if r.shard == s) for s in range(7)}
    assert all(x == list(range(len(x))) for x in slots.values()) and {len(x) for x in slots.values()} == {143, 144}


def test_matrix_is_hypergeometric():
    blocks = sharding.Blocks(1000, 3, 100)
    sizes = blocks.sizes()
    assert sizes.sum() == 1000 and max(sizes) - min(sizes) <= 2
    assert [blocks.place(b)[0] for b in range(len(sizes))] == [b // blocks.each for b in range(len(sizes))]
    for s in range(3):
        at = 0
        for b in range(s * blocks.each, (s + 1) * blocks.each):
            assert blocks.place(b) == (s, at)
            at += sizes[b]
        assert at in (333, 334)
    counts, edges = [400, 100, 500], np.array([0, 400, 500, 1000])
    got = np.array([[sharding.matrix_row(p, edges, np.array([250, 250, 500]), s) for p in range(3)] for s in range(400)])
    assert (got.sum(axis=1) == [250, 250, 500]).all() and (got.sum(axis=2) == counts).all()
    mean = np.outer(counts, [250, 250, 500]) / 1000
    assert np.abs(got.mean(axis=0) - mean).max() < 2
    n, k, m = 400, 250, 1000
    assert got[:, 0, 0].var() == pytest.approx(n * k / m * (1 - k / m) * (m - n) / (m - 1), rel=0.3)


def test_large_populations_have_the_same_law(monkeypatch):
    rng = np.random.default_rng(4)
    expected = rng.hypergeometric(300, 700, 200, 20_000)
    monkeypatch.setattr(sharding, "LARGE", 400)
    got = np.array([sharding.hypergeometric(rng, 300, 700, 200) for _ in range(20_000)])
    assert got.min() >= 0 and abs(got.mean() - 60) < 0.2 and abs(got.var() / expected.var() - 1) < 0.05
    below = [(got <= x).mean() - (expected <= x).mean() for x in range(40, 80)]
    assert max(map(abs, below)) < 0.02
    drawn = np.array([sharding.split(rng, np.array([100, 150, 350, 400]), 500) for _ in range(500)])
    assert (drawn.sum(axis=1) == 500).all() and np.abs(drawn.mean(axis=0) - [50, 75, 175, 200]).max() < 1.5
    monkeypatch.undo()
    for good, bad, n in ((6 * 10**9, 4 * 10**9, 5 * 10**9), (25_000, 10**12, 10**11), (10**12, 25_000, 10**12)):
        x = [sharding.hypergeometric(rng, good, bad, n) for _ in range(30)]
        mean, spread = n * good / (good + bad), (n * good / (good + bad) * bad / (good + bad) * (good + bad - n) / (good + bad)) ** 0.5
        assert all(max(0, n - bad) <= v <= min(n, good) for v in x) and abs(np.mean(x) - mean) < 5 * spread / 30**0.5 + 1
    sizes = np.full(400, 10**7)
    own = sharding.split(rng, sizes, 10**9)
    assert own.sum() == 10**9 and (own <= sizes).all() and abs(own - 2.5e6).max() < 6 * (2.5e6 * 0.75) ** 0.5


def test_nothing_larger_than_parts_and_blocks_is_sent(spark, monkeypatch):
    sent = []
    context = type(spark.sparkContext)
    true = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: (sent.append(value), true(self, value))[1])
    rows = spark.range(4000).repartition(4).select(F.col("id").alias("doc_id"))
    assert sharding.shuffle_rows(rows, shards=5, block_rows=20, part_rows=64).count() == 4000
    parts, blocks = 64, 200
    assert len(sent) == 1 and all(len(x) <= parts + blocks for x in sent[0])


def brute_force_shuffle(parts, shards, block_rows, seed):
    """Every row's shard and slot, the whole matrix drawn first. parts: lists of rows."""
    total = sum(map(len, parts))
    each = max(1, -(-(-(-total // shards)) // block_rows))
    sizes, starts = [], []
    for s in range(shards):
        rows, at = total // shards + (s < total % shards), 0
        for j in range(each):
            n = rows // each + (j < rows % each)
            sizes.append(n)
            starts.append((s, at))
            at += n

    def draw(low, high, open_slots):
        if high - low == 1:
            return [open_slots]
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([seed, 0, low, high]))
        left = rng.multivariate_hypergeometric(open_slots, sum(map(len, parts[low:middle])), method="marginals")
        return draw(low, middle, left) + draw(middle, high, np.array(open_slots) - left)

    dealt = [[] for _ in sizes]
    for p, (rows, counts) in enumerate(zip(parts, draw(0, len(parts), np.array(sizes)), strict=True)):
        order = np.random.Generator(np.random.PCG64([seed, 1, p])).permutation(len(rows))
        at = {int(x): row for x, row in zip(order, rows, strict=True)}
        k = 0
        for b, n in enumerate(counts):
            dealt[b] += [at[i] for i in range(k, k + n)]
            k += n
    out = {}
    for b, rows in enumerate(dealt):
        assert len(rows) == sizes[b]
        for row, x in zip(rows, np.random.Generator(np.random.PCG64([seed, 2, b])).permutation(len(rows)), strict=True):
            out[row] = (starts[b][0], starts[b][1] + int(x))
    return out


def test_shuffle_against_brute_force(spark):
    rows = spark.range(1003).repartition(5).select(F.col("id").alias("doc_id")).cache()
    held = rows.select("doc_id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")).collect()
    parts = {}
    for r in sorted(held, key=lambda r: r.i):
        parts.setdefault((r.p, (r.i & ((1 << 33) - 1)) // 64), []).append(r.doc_id)
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_rows(rows, shards=7, block_rows=30, part_rows=64, seed=9).collect()}
    assert got == brute_force_shuffle([parts[k] for k in sorted(parts)], 7, 30, 9)


def test_places_are_uniform(spark):
    rows = spark.range(40).coalesce(2).select(F.col("id").alias("doc_id"))
    seen = Counter()
    for seed in range(25):
        seen.update((r.doc_id // 20, r.shard) for r in sharding.shuffle_rows(rows, shards=2, block_rows=5, seed=seed).collect())
    assert all(abs(n - 250) < 60 for n in seen.values())


def test_shards_of_awkward_rows(spark):
    assert sharding.shuffle_rows(awkward(spark).select(F.lit(1).alias("a")), shards=3).count() == 7
    clash = sharding.shuffle_rows(awkward(spark), shards=3)
    assert clash.columns == [*awkward(spark).columns, "shard", "slot"] and clash.count() == 7
    assert sharding.shuffle_rows(empty(spark).select("doc_id")).count() == 0


def best(rows, k, every):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ok.setdefault(i, []).append([int(np.floor(64 * np.float64(x))) for x in v])
    flat = [(i, v) for i, vs in ok.items() for v in vs]
    out = {}
    for at, (q, v) in enumerate(flat):
        if q % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i) for k, (i, w) in enumerate(flat) if k != at))
            out.setdefault(q, []).append([(i, -s) for s, i in scored[:k]])
    return out


@pytest.mark.parametrize("kind", ["random", "clusters", "ties", "large"])
def test_search_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    n, d = 300, 12
    x = rng.normal(size=(n, d))
    if kind == "clusters":
        x = rng.normal(size=(6, d))[rng.integers(0, 6, n)] * 9 + x * 0.05
    if kind == "ties":
        x = rng.integers(-1, 2, (n, d)).astype(float)
    if kind == "large":  # bounds in doubles
        x = rng.normal(size=(n, d)) * 2.0**20
    rows = [(int(i), [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = topk.search(topk.whole_numbers(df), F.col("vec_id") % 20 == 0, k=7, pivots=8, chunk_rows=40, block=16).collect()
    floats = [(i, [np.float32(a) for a in v]) for i, v in rows]
    expected = best(floats, 7, 20)
    for q, lists in expected.items():
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == lists[0]
    assert len(got) == 7 * len(expected)


def test_bounds_hold_and_are_no_looser_than_any_pivot_alone():
    rng = np.random.default_rng(2)
    for x in (rng.integers(-50, 50, (200, 10)), rng.integers(-3, 4, (200, 10)) * [1000, *[1] * 9], np.repeat(rng.integers(-9, 9, (4, 10)), 50, axis=0), np.zeros((5, 10), np.int64)):
        chosen = topk.choose_pivots(x, 6)
        pivots = topk.Pivots(chosen, wide=False)
        d = pivots.distances(x)
        apex = pivots.apexes(d).astype(np.float64)
        true, bound = x @ x.T, apex @ apex.T + 1
        assert (bound >= true).all()
        square = d[:, 0] ** 2
        gap = np.abs(d[:, None] - d[None]).max(axis=2)
        alone = (square[:, None] + square[None] - gap**2) / 2
        assert (bound <= alone + 2 * topk.SLACK * np.outer(d[:, 0], d[:, 0]) + 1 + 1e-3 * (1 + alone.max())).all()


def vectors_of(spark, x):
    return topk.whole_numbers(spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))


@pytest.mark.parametrize("kind,most", [("clusters", 0.05), ("plain", 0.45)])
def test_pivots_spare_evaluations_and_stay_exact(spark, kind, most):
    rng = np.random.default_rng(1)
    n, d = 4000, 64
    x = rng.normal(size=(n, d))
    if kind == "clusters":
        x = (rng.normal(size=(40, d)) * 9)[rng.integers(0, 40, n)] + x
    told = {}
    got = topk.search(vectors_of(spark, x), F.col("vec_id") % 100 == 0, k=10, told=told).collect()
    whole = np.floor(64 * x.astype(np.float32).astype(np.float64)).astype(np.int64)
    for q in range(0, n, 100):
        score = whole @ whole[q]
        order = np.lexsort((np.arange(n), -score))
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == order[order != q][:10].tolist()
    assert told["pairs"] == 40 * n and told["evaluated"] / told["pairs"] < most, told


def test_a_hot_vector_and_repeated_queries(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(-3, 4, (600, 6)).astype(float)
    x[rng.random(600) < 0.4] = x[0]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(20, [float(a) for a in x[20]])] * 3 + [(40, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.search(topk.whole_numbers(df), F.col("vec_id") % 20 == 0, k=7, chunk_rows=50, block=16).collect()
    expected = best(rows, 7, 20)
    for q, lists in expected.items():
        own = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        distinct = sorted({tuple(x) for x in lists})
        assert own == sorted((k + 1, *row) for rows in distinct for k, row in enumerate(rows))


def test_scores_are_exact_at_every_size():
    big = np.array([[2**30, -(2**30)]])
    assert topk._scores(big, big)[0, 0] == 2**61
    assert topk._scores(np.array([[2**27 + 1]]), np.array([[2**27 + 1]]))[0, 0] == (2**27 + 1) ** 2
    with pytest.raises(OverflowError):
        topk._scores(np.array([[2**40]]), np.array([[2**40]]))


def test_search_of_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (1, [3.0]), (2, []), (2, []), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS VEC_ID")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(topk.whole_numbers(df), F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 1, 64 * 192), (0, 2, 2, 0), (0, 3, 2, 0)]
    assert topk.search(topk.whole_numbers(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "market", "trust", *(f"w{i}" for i in range(400))]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    clean = [text(50) + "\n" + text(30) for _ in range(40)]
    junk = [" | ".join("x$$ y%%" for _ in range(40)) for _ in range(10)]
    near = clean[0].replace("\n", " ") + " tail"  # the same words on one line: no line repeats
    copy = clean[1]
    partly = clean[2].split("\n")[0] + "\n" + text(40)
    texts = clean + junk + [near, copy, partly, None, "short"]
    df = docs(spark, *texts)
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(50)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    now, kept = df.selectExpr("*", "1 AS DOC_ID"), {}
    for name, stage in cp.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        stage(spark, now, str(tmp_path)).write.parquet(path)
        now = spark.read.parquet(path)
        assert now.columns == list(cp.COLUMNS)
        kept[name] = {r.doc_id: r for r in now.collect()}
    assert set(kept["quality_rules"]) == {*range(40), 50, 51, 52}
    assert set(kept["line_dedup"]) == {*range(40), 50, 52} and kept["line_dedup"][52].text == partly.split("\n")[1]
    assert kept["line_dedup"][52].n_chars == len(partly.split("\n")[1])
    assert set(kept["near_dedup"]) == {*range(40), 52}
    size = Counter()
    for r in kept["near_dedup"].values():
        size[r.source] += len(words(r.text))
    mixed = Counter()
    for r in now.collect():
        mixed[r.source] += len(words(r.text))
    total = sum(size.values())
    for source, weight in zip(sorted(size), (5, 2, 1), strict=True):
        assert abs(mixed[source] - min(3 * size[source], total * weight / 8)) <= 90
    rows = cp.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in now.collect())
    assert cp.run(spark, str(tmp_path)).count() == len(rows)


def brute_force_pipeline(spark, rows, labels):
    """How often each (doc_id, piece, start, length, checksum) comes out of all five stages. rows: (doc_id, text, source), ids distinct."""
    import hashlib
    from array import array

    import public_tokenizers
    from cases import components
    from test_counts_urls_mix import targets
    from test_dedup_quality import brute_force_judge, within
    from tokenizers import Tokenizer

    rows = sorted(rows)
    kept = brute_force_judge(spark, [(d, t) for d, t, _ in rows], labels)
    docs, seen, by_length = [], set(), {}
    for (d, text, source), (_, good) in zip(rows, kept, strict=True):
        if not good:
            continue
        left, lines = [], (text or "").split("\n")
        for x in lines:
            s = x.strip(" \t\n\x0b\x0c\r")
            near = (y for n in (len(s) - 1, len(s), len(s) + 1) if n >= 20 for y in by_length.get(n, ())) if len(s) >= 20 else ()
            if not s or not (s in seen or any(within(s, y) for y in near)):
                left.append(x)
            if s and s not in seen:
                seen.add(s)
                by_length.setdefault(len(s), []).append(s)
        new = "\n".join(left)
        if len(left) == len(lines) or words(new):
            docs.append((d, text if len(left) == len(lines) else new, source))
    sets = {}
    for d, t, _ in docs:
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(t)]
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids = list(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = components(ids, links)
    docs = [x for x in docs if label[x[0]] == x[0]]
    size = Counter()
    for _, t, s in docs:
        size[s] += len(words(t))
    goal, out = targets(size), Counter()
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for s in size:
        own = sorted((hashlib.md5(str(d).encode()).hexdigest(), d, t) for d, t, x in docs if x == s)
        whole = min(3, int(goal[s] + 0.5) // size[s]) if size[s] else 0
        before = 0
        for _, d, t in own:
            n = len(words(t))
            part = max(0, min(int(goal[s] + 0.5) - whole * size[s] - before, n))
            before += n
            times = whole + (part > 0) if whole * n + part > 0 else 0
            tokens = coder.encode(t or "", add_special_tokens=False).ids + [1]
            for k in range(0, len(tokens), 4096):
                piece = tokens[k : k + 4096]
                out[d, k // 4096, k, len(piece), zlib.crc32(array("I", piece).tobytes())] += times
    return +out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", None])
def test_the_whole_pipeline_against_brute_force(spark, sf, tmp_path):
    import corpus_pipeline as cp
    from test_tokens_packing import bins

    if sf is None:
        sf, rng = str(tmp_path), random.Random(6)
        held = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
        texts = [r.text for r in held[:60]]
        texts += ["\n".join(rng.sample((t or "x").split("\n"), k=1) + [f"some more words {i} that no other text has in it"]) for i, t in enumerate(texts)]
        texts += [" ".join(w if rng.random() > 0.01 else "other" for w in (t or "").split(" ")) for t in texts[:30]] + [None, "", "\n\n", "All rights reserved\n" + "a few words of its own, at least ten of them in all", "All rights reserved\nwords of another text, at least ten of them in a line"]
        df = docs(spark, *texts, sources=[rng.choice(["a", "b", None]) for _ in texts])
        df.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = sorted({(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id is not None and r.quality is not None})
    got = cp.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute_force_pipeline(spark, rows, labels)
    assert all(sum(n for _, n in x) <= 4096 for x in bins(got).values())


def test_pipeline_of_awkward_rows(spark, tmp_path):
    import corpus_pipeline as cp

    awkward(spark).drop("ids").toDF("doc_id", "text", "lang", "source", "n_chars", "more", "id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, 1, 0), (3, None, 0), (3, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} <= {3, 5, None}
    now = awkward(spark)
    for _, stage in cp.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == list(cp.COLUMNS)
        now.collect()


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as cp

    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_queries_at_the_smallest_tables(spark):
    from citeloom.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = queries.queries()["op9_hypergeometric_shards"](spark, sf).collect()
    assert len(rows) == 200 and {r.law for r in rows} == {"rows"}
    ids = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]  # one file, one part
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == brute_force_shuffle([ids], sharding.SHARDS, sharding.BLOCK_ROWS, sharding.SEED)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.size == len((texts[r.doc_id] or "").encode()) + 8 for r in rows)
