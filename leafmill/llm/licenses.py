"""License scans by template markup.

A template is text with markup: ``<<optional>> words <</optional>>`` may be left
out, and ``<<var 0-3>>`` stands for a run of that many other words. Templates
compile to one automaton over words: mandatory and optional words are edges by
word, replaceable words are edges by any word, and a skip edge passes an optional
region. A template is found where a run of words leads to its end, so all its
mandatory wording is there, word for word and in order.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafmill.llm.shared import whole
from leafmill.llm.tokens import portions

#: Phrases whose words mark a license wherever they stand side by side (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices with markup, by label.
TEMPLATES = {
    "gpl-3.0": ["<<optional>>this <<var 1-3>> is<</optional>> licensed under the <<optional>>terms of the<</optional>> gnu general public license "
                "<<optional>>gpl<</optional>> version 3 <<optional>>0<</optional>> <<optional>>or <<optional>>at your option any<</optional>> later <<optional>>version<</optional>><</optional>>"],
    "gpl-notice": ["this <<var 1-4>> is free software you can redistribute it and or modify it under the terms of the gnu general public license "
                   "as published by the free software foundation either version <<var 1-2>> of the license or at your option any later version"],
    "mit": ["<<optional>>this <<var 1-3>> is<</optional>> released under the <<optional>>terms of the<</optional>> mit license",
            "<<optional>>this <<var 1-3>> is<</optional>> licensed under the <<optional>>terms of the<</optional>> mit license"],
    "apache-2.0": ["<<optional>>this <<var 1-3>> is<</optional>> licensed under the <<optional>>terms of the<</optional>> apache license <<optional>>version<</optional>> 2 0",
                   "licensed under the apache license version 2 0 the license you may not use this <<var 1-3>> except in compliance with the license"],
    "cc-by-4.0": ["licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> cc by 4 0 <<optional>>international<</optional>> <<optional>>license<</optional>>"],
    "cc-by-nc-4.0": ["licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> cc by nc 4 0 <<optional>>international<</optional>> <<optional>>license<</optional>>"],
    "cc-by-sa-4.0": ["licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> cc by sa 4 0 <<optional>>international<</optional>> <<optional>>license<</optional>>"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
}

#: Bytes as words see them: A-Z lower-cased, letters, digits and bytes above ASCII kept, all else blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MARK = re.compile(r"<<(/?)(optional|var)(?: (\d+)-(\d+))?>>|([^\s<]+)")
ANY = None


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as bytes."""
    return text.encode().translate(_FOLD).split()


@dataclass
class Template:
    label: str
    size: int       # mandatory words


class Automaton:
    """All templates as one automaton, run as sets of positions; moves are remembered."""

    def __init__(self, templates: dict[str, list[str]]):
        self.templates: list[Template] = []
        self.edges: dict[int, list[tuple[bytes | None, int]]] = defaultdict(list)   # position -> (word or ANY, next)
        self.skips: dict[int, set[int]] = defaultdict(set)
        self.ends: dict[int, int] = {}
        self.starts: set[int] = set()
        self.count = 0
        for label, texts in templates.items():
            for text in texts:
                self._compile(label, text)
        self.moves: dict[tuple[frozenset, bytes], frozenset] = {}
        self.named = {w for edges in self.edges.values() for w, _ in edges if w is not ANY}
        self.start = self._closed(self.starts)
        self.first = {w for p in self.start for w, _ in self.edges.get(p, ())}
        if ANY in self.first:
            raise ValueError("a template must not begin with a replaceable word")

    def _new(self) -> int:
        self.count += 1
        return self.count

    def _compile(self, label: str, text: str) -> None:
        at = self._new()
        self.starts.add(at)
        open_, size = [], 0
        for close, mark, low, high, word in _MARK.findall(text):
            if word:
                for w in words_of(word):
                    then = self._new()
                    self.edges[at].append((w, then))
                    at, size = then, size + (not open_)
            elif mark == "var":
                run = [at, *(self._new() for _ in range(int(high)))]
                for here, then in zip(run, run[1:]):
                    self.edges[here].append((ANY, then))
                for here in run[int(low):-1]:
                    self.skips[here].add(run[-1])
                at = run[-1]
            elif close:
                self.skips[open_.pop()].add(at)
            else:
                open_.append(at)
        self.ends[at] = len(self.templates)
        self.templates.append(Template(label, size))

    def _closed(self, positions: set[int]) -> frozenset:
        found, rest = set(positions), list(positions)
        while rest:
            for to in self.skips.get(rest.pop(), ()):
                if to not in found:
                    found.add(to)
                    rest.append(to)
        return frozenset(found)

    def step(self, state: frozenset, word: bytes) -> frozenset:
        word = word if word in self.named else b""
        key = (state, word)
        if key not in self.moves:
            self.moves[key] = self._closed({to for p in state for w, to in self.edges.get(p, ()) if w is ANY or w == word})
        return self.moves[key]

    def scan(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, last word) of each template's longest run from each start."""
        found = []
        for begin, word in enumerate(words):
            if word not in self.first:
                continue
            state, best = self.start, {}
            for at in range(begin, len(words)):
                state = self.step(state, words[at])
                if not state:
                    break
                for p in state:
                    if p in self.ends:
                        best[self.ends[p]] = at
            found += [(t, begin, end) for t, end in best.items()]
        return found


def _phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    places = []
    for phrase, label in phrases:
        at = -1
        for _ in range(words.count(phrase[0])):
            at = words.index(phrase[0], at + 1)
            if words[at:at + len(phrase)] == phrase:
                places.append((at, label))
    return places


FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first:long,last:long>>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Per row: key, ``n_words``, ``n_base`` places of phrases with ``first_word`` and ``last_word`` (their smallest
    and largest start), ``base_labels``, ``labels`` (the templates' too; both distinct, sorted, comma-joined),
    ``score`` and ``matches`` (label, first and last word of each template found).

    ``score`` is 1 with a template, 0.5 with phrases only, else 0. A NULL text is empty.
    Places that overlap all count. Repeated rows are scanned alike; other columns are not read.
    An empty table gives no rows. Templates are those of ``TEMPLATES`` unless given: eight labels of short notices,
    no whole license texts.
    """
    phrases, templates = phrases or PHRASES, templates or TEMPLATES

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [(words_of(p), label) for p, label in phrases.items()]
        automaton = Automaton(templates)
        # A text without the first word of any phrase or template needs no further look.
        keys = {p[0] for p, _ in wanted} | automaton.first
        for batch in portions(batches):
            out = []
            for value in batch.column("text").to_pylist():
                words = words_of(value)
                if keys.isdisjoint(words):
                    out.append((len(words), 0, None, None, "", "", 0.0, []))
                    continue
                places = _phrase_places(words, wanted)
                matches = [(automaton.templates[t].label, a, b) for t, a, b in automaton.scan(words)]
                base = {label for _, label in places}
                out.append((len(words), len(places), min((a for a, _ in places), default=None), max((a for a, _ in places), default=None),
                            ",".join(sorted(base)), ",".join(sorted(base | {m[0] for m in matches})), 1.0 if matches else 0.5 if places else 0.0,
                            [dict(zip(("label", "first", "last"), m)) for m in matches]))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(zip(*out), types))], ["id", *names])

    rows = docs.select(F.col(key).alias("id"), whole(text).alias("text"))
    return rows.mapInArrow(find, f"id {rows.schema['id'].dataType.simpleString()}, {FOUND}").withColumnRenamed("id", key)
