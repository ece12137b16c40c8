import random
import re

import pytest
from cases import awkward, docs, empty
from pyspark.sql import functions as F

from citeloom.llm import licenses as L

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = (("p", "a b"), ("q", "b a b"))
TEMPLATES = (("t", "[[x]] a <<any 0-2>> b [[c [[d]] <<more 1-2>> e]]"), ("t", "c c <<y 2-2>> c"), ("u", "é"), ("v", "d [[a a]] [[b]] d"))


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ends(items, w, at):
    """All places where some parts can end that begin at word ``at``."""
    if not items:
        return {at}
    x, rest = items[0], items[1:]
    if isinstance(x, str):
        return ends(rest, w, at + 1) if at < len(w) and w[at] == x else set()
    if isinstance(x, tuple):
        return set().union(*(ends(rest, w, at + k) for k in range(x[0], x[1] + 1) if at + k <= len(w)))
    return ends(rest, w, at) | set().union(*(ends(rest, w, k) for k in ends(x, w, at)))


def by_hand(text, phrases=PHRASES, templates=TEMPLATES):
    w, found = words(text), []
    for t, (label, markup) in enumerate((*phrases, *templates)):
        until = 0
        for a in range(len(w)):
            to = ends(L.parts(markup), w, a)
            if to and (t < len(phrases) or a >= until):
                until = max(to)
                found.append((label, t < len(phrases), t, L.mandatory(markup), a, until))
    return len(w), sorted(found)


def rows_of(df, **templates):
    return {r.doc_id: (r.n_words, sorted(tuple(p) for p in r.places)) for r in L.license_places(df, **templates).collect()}


def test_places_against_backtracking(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "A", "b", "c", "d", "x", "e", "é", "other", "aé"]) + rng.choice([" ", "-", "\n", "_"]) for _ in range(rng.randrange(40))) for _ in range(400)] + [None, "", "...", "a", "b", "a " * 30_000]
    got = rows_of(docs(spark, *texts), phrases=PHRASES, templates=TEMPLATES)
    assert got == {i: by_hand(t) for i, t in enumerate(texts)}
    assert {p[2] for _, places in got.values() for p in places} == set(range(6))


def filled(rng, items):
    """A text that the parts accept: optional regions in or out, replaceable ones of any length allowed."""
    out = []
    for x in items:
        if isinstance(x, str):
            out.append(x.upper() if rng.random() < 0.2 else x)
        elif isinstance(x, tuple):
            out += [f"w{rng.randrange(99)}" for _ in range(rng.randint(*x))]
        elif rng.random() < 0.5:
            out += filled(rng, x)
    return out


def test_known_wording_is_found_and_altered_wording_is_not(spark):
    rng = random.Random(1)
    texts, meant = [], []
    for label, markup in L.TEMPLATES:
        for _ in range(4):
            w = filled(rng, L.parts(markup))
            texts.append(rng.choice([" ", "\n * "]).join(w))
            meant.append((label, len(w)))
        first = next(k for k, x in enumerate(w) if x.lower() == next(p for p in L.parts(markup) if isinstance(p, str)))
        texts.append(" ".join([*w[: first + 1], "altered", "altered", "altered", "altered", *w[first + 1 :]]))
        meant.append(None)
    out = L.license_places(docs(spark, *texts))
    got = {r.doc_id: r for r in out.select("*", L.score(F.col("places"), F.col("n_words")).alias("score")).collect()}
    for i, m in enumerate(meant):
        if m:
            assert any(p.label == m[0] and (p.first, p.end) == (0, m[1]) for p in got[i].places), texts[i]
            assert 0 < got[i].score <= 1
    stray = [texts[i] for i, m in enumerate(meant) if m is None and len(L.parts(L.TEMPLATES[i // 5][1])) > 12 and any(p.template == i // 5 + len(L.PHRASES) and p.end - p.first == got[i].n_words for p in got[i].places)]
    assert not stray


def test_awkward_rows_and_none(spark):
    got = L.license_places(awkward(spark)).collect()
    assert sorted((str(r.doc_id), r.n_words, len(r.places)) for r in got) == sorted([("1", 0, 0), ("2", 0, 0), ("3", 6, 0), ("3", 6, 0), ("None", 6, 0), ("5", 30_000, 0), ("6", 0, 0)])
    assert L.license_places(empty(spark)).count() == 0


def test_templates_that_make_no_sense(spark):
    for bad in ("[[a", "a ]]", "<<x 1-2>> a", "[[a]] <<x 0-1>>", "", "[[a]]"):
        with pytest.raises(ValueError):
            L.license_places(empty(spark), templates=(("t", bad),))


def test_memo_is_bounded(monkeypatch):
    import numpy as np

    monkeypatch.setattr(L, "_MEMO", 2)
    machine = L.Automaton((*PHRASES, *TEMPLATES))
    w = words("x a other b c d more e a b c c d d c")
    numbers = np.array([machine.ids.get(x, -1) for x in w])
    got = sorted((t, a, b) for t, a, b in machine.places(numbers, np.full(len(w), len(w))))
    want = sorted((t, a, max(to)) for t, (_, m) in enumerate((*PHRASES, *TEMPLATES)) for a in range(len(w)) if (to := ends(L.parts(m), w, a)))
    assert got == want and len(machine.memo) <= 2
