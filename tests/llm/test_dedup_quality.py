import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import awkward, components, docs, empty, words

from citeloom.llm import linededup, neardup, quality


def variants_of(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_against_brute_force(spark, n):
    rng = random.Random(n)
    texts = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(60)}" for _ in range(rng.randrange(30, 90))]
        texts += variants_of(rng, base, 8, 9)
    hub = [f"h{i}" for i in range(120)]
    texts += variants_of(rng, hub, 60, 14) + [" ".join(hub)]  # a group that only some members hold together
    texts += [None, "", "Solo", "SOLO", "a b", texts[0].upper() if texts[0] else "", texts[3]]
    got = {r.doc_id: r for r in neardup.near_duplicates(docs(spark, *texts), shingle_words=n).collect()}
    sets = {}
    for i, t in enumerate(texts):
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(t)]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = components(sets, links)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**63, 900, dtype=np.uint64), rng.integers(0, 2**63, 900, dtype=np.uint64)
    b[:800] = a[:800]
    ra, rb = neardup.registers(a), neardup.registers(b)
    assert (np.maximum(ra, rb) == neardup.registers(np.concatenate([a, b]))).all()
    value = neardup.likely_similarity(ra[None], rb[None], np.array([900.0]), np.array([900.0]))[0]
    assert abs(value - 0.8) < 0.12


def test_near_duplicates_of_awkward_rows(spark):
    rows = neardup.near_duplicates(awkward(spark)).collect()
    assert len(rows) == 7
    assert all(r.kept for r in rows) and {r.component_id for r in rows if r.doc_id is None} == {None}
    assert neardup.near_duplicates(empty(spark)).count() == 0


def within(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_lines_against_brute_force(spark):
    rng = random.Random(9)
    base = ["the quick brown fox jumps é over", "another line that is long enough", "ééééééééééééééééééééééééé", "short"]
    lines = []
    for _ in range(150):
        x = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(x))
            kind = rng.randrange(3)
            x[k : k + (kind != 1)] = [] if kind == 0 else [rng.choice("abé")]
        lines.append("".join(x))
    texts = ["\n".join(lines[i : i + 5]) for i in range(0, 150, 5)] + [None, "", "\n\n", "  " + lines[0] + "\t\r\nnew line of sufficient length"]
    got = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, *texts)).collect()}
    seen, expected = [], {}
    for i, t in enumerate(texts):
        keep = []
        for x in (t or "").split("\n"):
            s = x.strip(" \t\n\x0b\x0c\r")
            if not s or not any(s == y or min(len(s), len(y)) >= linededup.CHARS_PER_EDIT and within(s, y) for y in seen):
                keep.append(x)
            if s:
                seen.append(s)
        expected[i] = None if t is None else "\n".join(keep)
    assert {i: r.text for i, r in got.items()} == expected
    assert all(r.n_lines - r.n_dropped == (1 if r.text is None else r.text.count("\n") + 1) or r.n_dropped == r.n_lines for r in got.values())


def test_pipeline_drops_copies_of_short_lines(spark):
    import corpus_pipeline as cp

    texts = ["All rights reserved\none line of this document\nx\n\n", "another line altogether\n All rights reserved\nAll rights reserve\ny\n", "é\nx\né", "All rights reserved"]
    got = {r.doc_id: r.text for r in cp.line_dedup(spark, docs(spark, *texts), "").collect()}
    assert got == {0: texts[0], 1: "another line altogether\nAll rights reserve\ny\n", 2: "é"}


def test_halves_find_every_pair_of_neighbours():
    import pyarrow as pa

    from citeloom.llm.bytewords import blocks

    rng = random.Random(4)
    for _ in range(300):
        x = "".join(rng.choice("abcdé") for _ in range(rng.randrange(20, 44)))
        k = rng.randrange(len(x) + 1)
        y = rng.choice([x[:k] + "z" + x[k:], x[:k] + x[k + 1 :], x[:k] + "z" + x[k + 1 :]])
        ((_, block),) = list(blocks(pa.array([x, y])))
        halves = linededup.Lines(block).halves(np.array([0, 1]))
        own = [{(j % 2, int(h[i])) for j, (h, there) in enumerate(halves) if there[i]} for i in (0, 1)]
        assert own[0] & own[1], (x, y)


def test_lines_of_awkward_rows(spark):
    df = awkward(spark)
    out = linededup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    rows = out.collect()
    assert len(rows) == 7
    nameless = [(None, "the first line of all, long enough\nsame"), (None, "x\nthe first line of all, long enough\nsame\nsame"), (None, "y\nz"), (7, "same\nother words"), (7, "q\nsame")]
    cut = linededup.dedup_lines(spark.createDataFrame(nameless, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in cut) == [("7", "q"), ("7", "same\nother words"), ("None", "the first line of all, long enough"), ("None", "x"), ("None", "y\nz")]
    assert [r["n_dropped"] for r in rows if r[0] == 3] == [0, 0] and [r["n_dropped"] for r in rows if r[0] is None] == [1]
    assert linededup.dedup_lines(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        linededup.dedup_lines(df, max_edits=2)


def base(t):
    t = t or ""
    w = words(t)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def corpus(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["the", "of", "and", "market", "trust", f"w{rng.randrange(50)}"]) for _ in range(60)) for _ in range(80)]
    bad = [" | ".join(f"x{rng.randrange(20)}$$" for _ in range(60)) for _ in range(20)]
    texts = [*good, *bad, None, "", "few words", "a b c d e " * 20, "one line here\none line here\n\n\n" + good[0]]
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    return texts, docs(spark, *texts), labels


def test_quality_against_brute_force(spark):
    texts, df, labels = corpus(spark)
    got = {r.doc_id: r for r in quality.judge(df, labels).collect()}
    for i, t in enumerate(texts):
        e = base(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == e
        assert r.base_failed == (e[0] < 10 or 100 * e[4] > 20 * e[0])
        assert not (r.base_failed and r.kept)
    assert sum(got[i].kept for i in range(80)) >= 79 and not any(got[i].kept for i in range(80, 100))
    assert [(r.doc_id, r.score) for r in quality.judge(df.repartition(7), labels).orderBy("doc_id").collect()] == [(i, got[i].score) for i in sorted(got)]


def brute_force_judge(spark, rows, labels):
    """[(score, kept)] of rows (doc_id, text), by plain counts over all documents. The hash of a word or pair is taken as given."""
    import math

    import pyarrow as pa

    from citeloom.llm.bytewords import blocks

    known = {}

    def feature(*w):
        if w not in known:
            ((_, block),) = list(blocks(pa.array([" ".join(w)])))
            known[w] = int(quality.features(block)[0][-1])
        return known[w]

    def features(t):
        w = words(t)
        return [feature(x) for x in w] + [feature(*x) for x in zip(w, w[1:], strict=False)]

    raw, target = Counter(f for _, t in rows for f in features(t)), Counter()
    draws = {r.doc_id: r.h for r in spark.createDataFrame([(d,) for d, _ in labels], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    chosen = sorted(labels, key=lambda x: (draws[x[0]], x))[: quality.LABELLED]
    texts = dict(rows)
    for d, good in chosen:
        if good and draws[d] % 2 == 0 and d in texts:
            target.update(features(texts[d]))
    totals = [sum(c.values()) for c in (target, raw)]
    ratio = lambda f: math.log((target[f] + quality.SMOOTHING) / (totals[0] + quality.SMOOTHING * quality.BUCKETS) / ((raw[f] + quality.SMOOTHING) / (totals[1] + quality.SMOOTHING * quality.BUCKETS)))
    score = lambda t: (sum(map(ratio, f)) / len(f)) if (f := features(t)) and totals[0] else 0.0
    held = [(score(texts[d]), good) for d, good in chosen if draws[d] % 2 and d in texts]
    good, bad = ([s for s, g in held if g == k] for k in (1, 0))
    threshold = -math.inf
    if totals[0] and good and bad:
        cuts = sorted({s for s, _ in held})
        right = [sum(b < c for b in bad) / len(bad) - quality.GOOD_WEIGHT * sum(g < c for g in good) / len(good) for c in cuts]
        k = max(range(len(cuts)), key=lambda k: (right[k], -k))
        threshold = cuts[0] if k == 0 else (cuts[k] + cuts[k - 1]) / 2
    out = []
    for _, t in rows:
        n, *_, again = base(t)
        out.append((score(t), not (n < 10 or 100 * again > 20 * n) and score(t) >= threshold))
    return out


@pytest.mark.parametrize("sf", [None, "/root/testdata/sf0.001"])
def test_scores_and_verdicts_against_brute_force(spark, sf, tmp_path):
    if sf is None:
        _, df, labels = corpus(spark)
        sf = str(tmp_path)
        df.write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = sorted({(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id is not None and r.quality is not None})
    got = {r.doc_id: r for r in quality.op3_ngram_ratio(spark, sf).collect()}
    assert len(got) == len(rows)
    for (d, t), (score, kept) in zip(rows, brute_force_judge(spark, rows, labels), strict=True):
        assert (got[d].n_words, got[d].word_chars, got[d].n_symbols, got[d].n_dup_lines, got[d].n_repeat_words) == base(t)
        assert got[d].score == pytest.approx(score, abs=1e-9) and got[d].kept == kept, d


def test_a_labelled_id_that_repeats_counts_once(spark):
    texts, df, labels = corpus(spark)
    more = df.unionByName(df.filter("doc_id = 3")).unionByName(df.filter("doc_id = 85"))
    assert quality.judge(more, labels).count() == len(texts) + 2
    plain = [x.select("doc_id", "text") for x in (df, more)]
    assert quality.fit(plain[0], labels)[1] == pytest.approx(quality.fit(plain[1], labels)[1], abs=0.05)


def test_quality_without_labels_keeps_all_that_pass_the_base_rules(spark):
    _, df, labels = corpus(spark)
    assert all(r.kept != r.base_failed for r in quality.judge(df, labels.limit(0)).collect())
    out = quality.judge(awkward(spark), labels)
    assert out.count() == 7 and out.columns[5:8] == ["Text", "DOC_ID", "ids"]
    assert quality.judge(empty(spark), labels).count() == 0


def test_threshold_prefers_good_documents():
    assert quality.best_threshold(np.array([1.0, 2.0, 3.0]), np.array([-2.0, -1.0])) == 0.0
    assert quality.best_threshold(np.array([1.0]), np.array([])) == -np.inf
    assert quality.best_threshold(np.array([0.0, 2.0]), np.array([1.0, 1.0])) == 0.0
