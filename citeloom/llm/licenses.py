r"""License scans: places of known license wording in texts, by templates with markup.

A template (see ``license_wording``) is compiled into a token automaton: a state before each mandatory
word, steps around optional regions, and steps by any word for as many words as a replaceable region
takes. All templates share one automaton, made deterministic step by step as texts ask for it. It
accepts a run of words exactly if the mandatory wording is there, word for word and in order, with
optional regions whole or absent and replaceable ones of a length within their bounds.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A to Z lower-cased: letters, digits and
whatever isn't ASCII, so case, punctuation, line breaks and comment signs don't matter. A place is a
template, its first word and the word after its last, numbered from 0: from each word the longest run
that a template accepts. Of a template's places that overlap, the first counts (one may begin with an
optional title or after it). A template that is plain words is a phrase, and each place of it counts.

Words are found and numbered by numpy over whole batches; the automaton starts only at words that, with
the word after them, can begin a template, and ends after as many words as a template can have. So the
time is that of reading, besides the places where a license may begin.

A null text is empty and holds no word and no place. Repeated rows get the same answer each. Texts of
any length are read whole. Columns beyond doc_id and text don't matter, whatever their names. An empty
table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import Block, blocks
from .common import bounded_batches, pick, table
from .license_wording import PHRASES, TEMPLATES

Template = tuple[str, str]

_BREAKS = np.zeros(256, bool)
_BREAKS[:128] = True
for _low, _high in ("09", "AZ", "az"):
    _BREAKS[ord(_low) : ord(_high) + 1] = False
_MARK = re.compile(r"\[\[|\]\]|<<[^<>]*?(\d+)-(\d+)>>|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The memo of the deterministic steps is given up when it holds so many sets of states.
_MEMO = 20_000


def parts(markup: str) -> list:
    """A template's parts in order: a word, (low, high) of a replaceable region, or a list of the parts of an optional one."""
    out: list = []
    open_: list[list] = [out]
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in markup)
    for found in _MARK.finditer(lower):
        piece = found.group()
        if piece == "[[":
            open_.append([])
        elif piece == "]]":
            if len(open_) == 1:
                raise ValueError(f"]] without [[ in {markup!r}")
            region = open_.pop()
            open_[-1].append(region)
        elif found.group(1):
            open_[-1].append((int(found.group(1)), int(found.group(2))))
        else:
            open_[-1].append(piece)
    if len(open_) > 1:
        raise ValueError(f"[[ without ]] in {markup!r}")
    return out


def mandatory(markup: str) -> int:
    """How many words a template asks for."""
    return sum(isinstance(x, str) for x in parts(markup))


class Automaton:
    """The token automaton of some templates. Words are numbers; -1 is any word that no template names."""

    def __init__(self, templates: Sequence[Template]):
        self.ids: dict[str, int] = {}
        self.by_word: list[dict[int, list[int]]] = []
        self.by_any: list[list[int]] = []
        self.free: list[list[int]] = []
        self.accept: dict[int, int] = {}
        self.memo: dict[frozenset, dict[int, frozenset]] = {}
        start = self._state()
        for number, (_, markup) in enumerate(templates):
            first = self._state()
            self.free[start].append(first)
            self.accept[self._run(first, parts(markup))] = number
        self.start = self._closed({start})
        if any(self.by_any[s] or s in self.accept for s in self.start):
            raise ValueError("a template has to begin with a word, whatever is left out")
        self._pairs()

    def _state(self) -> int:
        self.by_word.append({})
        self.by_any.append([])
        self.free.append([])
        return len(self.free) - 1

    def _run(self, at: int, items: list) -> int:
        """States for some parts after state ``at``; the last one."""
        for x in items:
            if isinstance(x, str):
                to = self._state()
                self.by_word[at].setdefault(self.ids.setdefault(x, len(self.ids)), []).append(to)
            elif isinstance(x, tuple):
                to, left = self._state(), at
                for k in range(x[1] + 1):
                    if k >= x[0]:
                        self.free[left].append(to)
                    if k < x[1]:
                        following = self._state()
                        self.by_any[left].append(following)
                        left = following
            else:
                to = self._run(at, x)
                self.free[at].append(to)
            at = to
        return at

    def _closed(self, states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def step(self, states: frozenset, word: int) -> frozenset:
        own = self.memo.get(states)
        if own is None:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            own = self.memo[states] = {}
        to = own.get(word)
        if to is None:
            to = own[word] = self._closed({t for s in states for t in (*self.by_word[s].get(word, ()), *self.by_any[s])})
        return to

    def _pairs(self) -> None:
        """Which pairs of a word and the one after it can begin a template; the last two columns are any other word and the text's end."""
        n = len(self.ids)
        self.begins = np.zeros((n + 1, n + 2), bool)
        for word in {w for s in self.start for w in self.by_word[s]}:
            second = self.step(self.start, word)
            if any(self.by_any[s] for s in second) or any(s in self.accept for s in second):
                self.begins[word] = True
            for s in second:
                self.begins[word, list(self.by_word[s])] = True

    def numbers(self, block: Block) -> np.ndarray:
        """The number of each word of a block of lower-cased texts."""
        names = sorted(self.ids)
        raw = [x.encode() for x in names]
        ends = np.cumsum([len(x) for x in raw]) if raw else np.zeros(0, np.int64)
        own = Block(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends)
        known = own.hashes(own.start, own.end)
        order = np.argsort(known)
        ids = np.array([self.ids[x] for x in names])[order]
        known = known[order]
        a, b, _ = block.words
        h = block.hashes(a, b)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[at] == h, ids[at], -1)

    def places(self, words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, first, end) of all runs accepted, longest from each word; ends: where the text of each word ends, in words."""
        n = len(self.ids)
        after = np.append(words[1:], n + 1)
        after[ends - 1 == np.arange(len(words))] = n + 1
        follow = np.where(after < 0, n, after)
        listed = words.tolist()
        for first in np.flatnonzero(self.begins[np.where(words < 0, n, words), follow]).tolist():
            states, last, at = self.start, {}, first
            for at in range(first, int(ends[first])):
                states = self.step(states, listed[at])
                if not states:
                    break
                for s in states & self.accept.keys():
                    last[self.accept[s]] = at + 1
            for template, end in sorted(last.items()):
                yield template, first, end


@cache
def automaton(templates: tuple[Template, ...]) -> Automaton:
    return Automaton(templates)


def license_places(docs: DataFrame, phrases: Sequence[Template] = PHRASES, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """docs (doc_id, text): doc_id, n_words, places; a place has label, phrase (whether it is one), template, words (that it asks for), first, end."""
    bounded_batches(docs.sparkSession)
    every = (*phrases, *templates)
    Automaton(every)  # an error in a template shows here
    asks, phrase = [mandatory(m) for _, m in every], [k < len(phrases) for k in range(len(every))]
    place = pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("template", pa.int32()), ("words", pa.int64()), ("first", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(every)
        for batch in batches:
            for first, block in blocks(batch.column(1), lower=True, breaks=_BREAKS):
                _, _, which = block.words
                edges = np.searchsorted(which, np.arange(len(block) + 1))
                found: list[list[dict]] = [[] for _ in range(len(block))]
                until = [0] * len(every)  # per template, where its last place ends
                for t, a, b in machine.places(machine.numbers(block), edges[1:][which]):
                    if phrase[t] or a >= until[t]:
                        until[t] = b
                        of = int(which[a])
                        start = int(edges[of])
                        found[of].append({"label": every[t][0], "phrase": phrase[t], "template": t, "words": asks[t], "first": a - start, "end": b - start})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(block)), pa.array(np.diff(edges)), pa.array(found, pa.list_(place))], ["doc_id", "n_words", "places"])

    rows = pick(docs, doc_id="doc_id", text="text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, n_words long, places array<struct<label string, phrase boolean, template int, words long, first long, end long>>")


def labels(places: Column) -> Column:
    """The distinct labels of places, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def score(places: Column, n_words: Column) -> Column:
    """How much of a text is license wording: the mandatory words of the templates found, each once, over the text's words; at most 1."""
    found = F.array_distinct(F.transform(places, lambda p: F.struct(p["template"].alias("template"), p["words"].alias("words"))))
    asked = F.aggregate(found, F.lit(0).cast("long"), lambda total, x: total + x["words"])
    return F.when(n_words > 0, F.least(F.lit(1.0), asked / n_words)).otherwise(F.lit(0.0))


def op12_template_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License wording of every document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    out = license_places(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["phrase"])
    starts = F.transform(base, lambda p: p["first"])
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), score(F.col("places"), F.col("n_words")).alias("score"),
    )


def _pattern(items: list) -> str:
    """Parts as a regular expression over words that follow a space each."""
    return "".join(f" {x}" if isinstance(x, str) else f"(?: [^ ]+){{{x[0]},{x[1]}}}" if isinstance(x, tuple) else f"(?:{_pattern(x)})?" for x in items)


def _starts(markup: str) -> str:
    return "list_filter(range(1, len(ws) + 1), lambda i: " + " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(parts(markup))) + ")"


_FOUND = ", ".join(f"CASE WHEN regexp_matches(s, '{_pattern(parts(m))} ') THEN {{'label': '{label}', 'words': {mandatory(m)}}} END" for label, m in (*PHRASES, *TEMPLATES))
_BASE = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (label, _) in enumerate(PHRASES))
_PLACES = ", ".join(f"{_starts(m)} AS p{k}" for k, (_, m) in enumerate(PHRASES))
_ALL = " || ".join(f"p{k}" for k in range(len(PHRASES)))

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
n AS (SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS s FROM d),
f AS (SELECT doc_id, ws, list_filter([{_FOUND}], lambda x: x IS NOT NULL) AS found, {_PLACES} FROM n)
SELECT doc_id, len(ws)::BIGINT AS n_words, len({_ALL})::BIGINT AS n_base, list_min({_ALL})::BIGINT - 1 AS first_word, list_max({_ALL})::BIGINT - 1 AS last_word,
  array_to_string(list_sort(list_distinct(list_filter([{_BASE}], lambda x: x IS NOT NULL))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_transform(found, lambda x: x.label))), ',') AS labels,
  CASE WHEN len(ws) > 0 THEN least(1.0::DOUBLE, coalesce(list_sum(list_transform(found, lambda x: x.words)), 0)::DOUBLE / len(ws)) ELSE 0.0::DOUBLE END AS score FROM f
"""
