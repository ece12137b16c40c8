import random
import re
import zlib
from collections import Counter

import numpy as np
from cases import awkward, docs, empty

from citeloom.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def told(words, factor=5):
    """words: {word: n}. The rows that variants should give."""
    beside = {a: [b for b in words if near(a, b)] for a in words}
    form = {}
    for a, found in beside.items():
        best = min(found, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= factor * words[a] else None
    out = set()
    for a in words:
        root = a
        while form[root] is not None:
            root = form[root]
        out.add((a, form[a], root, words[a], len(beside[a]), None if form[a] is None else words[form[a]]))
    return out


def edited(rng, word):
    k, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:k] + ("", rng.choice("abyé"), rng.choice("abyé"))[kind] + word[k + (kind != 2) :]


def vocabulary(rng, n):
    words = {}
    bases = ["aaaaaaa", "abababab", "strasse", "élémentaire", "commonword", "aaaaaaaaaaaaaaaa", "ÿÿÿÿÿÿ", "b" * 300]
    while len(words) < n:
        word = rng.choice(bases) if rng.random() < 0.3 or not words else rng.choice(list(words))
        for _ in range(rng.randrange(3)):
            word = edited(rng, word)
        if len(word) >= 6:
            words[word] = rng.choice([5, 6, 25, 30, 125, 700, 3000])
    return words


def test_variants_against_all_pairs(spark, monkeypatch):
    from citeloom.llm.common import materialize

    for seed, size in ((1, 7), (2, 40), (3, 20_000)):  # lists in blocks of 7, of 40, and whole
        words = vocabulary(random.Random(seed), 350)
        monkeypatch.setattr(spelling, "STEP", 50 if seed == 2 else 4 << 20)
        df = materialize(spark.createDataFrame(sorted(words.items()), "word string, n long").repartition(3), "words")
        got = {tuple(r) for r in spelling.variants(df, list_words=size).collect()}
        assert got == told(words)


def test_shared_grams_bound():
    """Two near words agree in as many grams as the count filter asks for, one of them among the rarest of both."""
    rng, q = random.Random(8), spelling.Q
    order = np.array([rng.randrange(50) for _ in range(1 << 16)])
    for _ in range(500):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(6, 14)))
        b = edited(rng, a)
        if a == b or len(b) < 6:
            continue
        a, b = sorted((a, b), key=len)
        w = spelling.Words([a, b], q)
        of = [[(int(g), int(p)) for g, p in zip(w.gram[w.of == i], w.position[w.of == i], strict=True)] for i in (0, 1)]
        shift = (0, 1) if len(a) < len(b) else (0,)
        same = [(x, (x[0], x[1] + s)) for x in of[0] for s in shift if (x[0], x[1] + s) in of[1]]
        assert len(same) >= max(1, len(b) - 2 * q + 1)
        rare = [sorted(x, key=lambda y: (order[y[0]], y)) for x in of]
        assert any(x in rare[0][: q + (len(a) == len(b))] and y in rare[1][: q + 1] for x, y in same)


def counted(texts, every=199):
    out = Counter()
    for doc, text in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 5}


def test_counts_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(spelling, "PIECE", 50)
    monkeypatch.setattr(spelling, "HELD_WORDS", 20)
    texts = [" ".join(rng.choice(["Häuser", "ÉCOLE", "letters", "LETTERS", "×÷×÷×÷", "İstanbul", "naïve1naïvely", "short", "x" * 90, "İßſK"]) for _ in range(rng.randrange(60))) for _ in range(60)] + [None, ""]
    for every in (1, 3, 199):
        got = {r.word: r.n for r in spelling.word_counts(docs(spark, *texts), every=every).collect()}
        assert got == counted(list(enumerate(texts)), every) and got


def test_awkward_rows_and_none(spark):
    from citeloom.llm.common import materialize

    df = awkward(spark)
    df = df.union(df).union(df)
    got = {r.word: r.n for r in spelling.word_counts(df).collect()}
    assert got == counted([(r[0], r[1]) for r in df.collect()]) == {}
    words = spark.createDataFrame([(i % 3, "Overflow overflow OVERFLOW overflov " * 3) for i in range(4)] + [(None, "overflow " * 2)], "doc_id long, text string")
    again = spelling.variants(materialize(spelling.word_counts(words), "counts"))
    assert {tuple(r) for r in again.collect()} == told(counted([tuple(r) for r in words.collect()]))
    assert spelling.variants(materialize(spelling.word_counts(empty(spark)), "counts")).count() == 0
