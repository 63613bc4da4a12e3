"""License scans by template-markup matching.

A template is licence wording with two kinds of markup: ``[[ ... ]]`` encloses wording that may be
left out, ``{{a | b}}`` stands for one of several wordings, and ``{{*n}}`` for up to n free words
(names, years). Each template is compiled into an automaton over words; a text is accepted where all
mandatory wording follows word for word. Base phrases are plain word sequences.

Null texts count as empty; texts without words have no labels, no first and last word and score 0. Texts are
read whole, however long. Of several places that a template fits the first counts, and there the longest;
labels that tie at one place all stand. Repeated rows give repeated results, an empty table an empty one, and
other columns of the input are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

#: The base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Wording of common licences and notices, with markup.
_BSD_OPENING = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[{{1 | a}}]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[{{2 | b}}]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_ADVERTISING = "[[{{3 | c}}]] all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by {{*12}}"
_BSD_NAMES = "[[{{3 | 4 | c | d}}]] neither the name of {{*12}} nor the names of {{its | their}} contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_DISCLAIMER = "this software is provided by {{*12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{*12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
TEMPLATES = (
    ("gpl-3.0-notice", "{{this work | this program | this software | this library | this file}} is licensed under the GNU General Public License [[as published by the Free Software Foundation]] version 3 [[or later]]"),
    ("gpl-redistribution", "is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("apache-2.0-notice", "licensed under the Apache License version 2 0 [[the license]]"),
    ("mit-notice", "{{released | licensed | distributed | available}} under the [[terms of the]] MIT License"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{*12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {{*8}} {{disclaims | disclaim}} all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{*8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-2-clause-text", f"{_BSD_OPENING} {_BSD_DISCLAIMER}"),
    ("bsd-3-clause-text", f"{_BSD_OPENING} {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    ("bsd-4-clause-text", f"{_BSD_OPENING} {_BSD_ADVERTISING} {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    ("cc-by-notice", "licensed under [[a]] {{cc by | creative commons attribution}} [[{{nc | noncommercial}}]] [[{{sa | sharealike | nd | noderivatives}}]] [[{{*1}}]] [[license]] {{1 0 | 2 0 | 2 5 | 3 0 | 4 0}}"),
    ("all-rights-reserved", "copyright [[c]] {{*8}} all rights reserved"),
)

WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD)
_IS_WORD = np.ones(256, bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _IS_WORD[_lo : _hi + 1] = False
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def parse(markup: str) -> list:
    """Markup as a tree: str word, ("opt", seq), ("alt", [seq, ...]) or ("free", n)."""
    tokens = re.findall(r"\[\[|\]\]|\{\{|\}\}|\||\*\d+|[0-9a-z\x80-\U0010ffff]+", markup.lower())

    def sequence(i: int, stop: set) -> tuple[list, int]:
        seq: list = []
        while i < len(tokens) and tokens[i] not in stop:
            t = tokens[i]
            if t == "[[":
                inner, i = sequence(i + 1, {"]]"})
                seq.append(("opt", inner))
            elif t == "{{":
                choices = []
                while True:
                    inner, i = sequence(i + 1, {"|", "}}"})
                    choices.append(inner)
                    if tokens[i] == "}}":
                        break
                seq.append(choices[0][0] if len(choices) == 1 and len(choices[0]) == 1 else ("alt", choices))
            elif t[0] == "*":
                seq.append(("free", int(t[1:])))
            else:
                seq.append(t)
            i += 1
        return seq, i

    return sequence(0, set())[0]


def mandatory(tree: list) -> list[str]:
    return [x for x in tree if isinstance(x, str)]


class Automaton:
    """Non-deterministic automaton over words, made deterministic state by state as texts need it."""

    def __init__(self, markup: str):
        self.moves: list[dict] = []  # state -> word (None: any) -> next states
        self.skips: list[set] = []
        tree = parse(markup)
        start = self._state()
        self.final = self._add(tree, start)
        self.start = self._closure({start})
        self.table: dict = {}
        self.first = {w for s in self.start for w in self.moves[s]}
        #: a word that every accepted text has; empty if there is none
        self.anchor = max(mandatory(tree), key=len, default="").encode()

    def _state(self) -> int:
        self.moves.append({})
        self.skips.append(set())
        return len(self.moves) - 1

    def _add(self, tree: list, at: int) -> int:
        for x in tree:
            if isinstance(x, str):
                nxt = self._state()
                self.moves[at].setdefault(x.encode(), set()).add(nxt)
                at = nxt
            elif x[0] == "opt":
                end = self._add(x[1], at)
                self.skips[at].add(end)
                at = end
            elif x[0] == "alt":
                end = self._state()
                for choice in x[1]:
                    self.skips[self._add(choice, at)].add(end)
                at = end
            else:
                end = self._state()
                self.skips[at].add(end)
                for _ in range(x[1]):
                    nxt = self._state()
                    self.moves[at].setdefault(None, set()).add(nxt)
                    self.skips[nxt].add(end)
                    at = nxt
                at = end
        return at

    def _closure(self, states: set) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)

    def _step(self, state: frozenset, word: bytes) -> frozenset:
        known = {w for s in state for w in self.moves[s]}
        key = (state, word if word in known else None)
        if key not in self.table:
            nxt: set = set()
            for s in state:
                nxt |= self.moves[s].get(None, set()) | (self.moves[s].get(key[1], set()) if key[1] else set())
            self.table[key] = self._closure(nxt)
        return self.table[key]

    def find(self, words: list[bytes]) -> tuple[int, int] | None:
        """(first, past last word) of the first accepted place, the longest there; else None."""
        anywhere = None in self.first
        for i, word in enumerate(words):
            if anywhere or word in self.first:
                state, end, j = self.start, None, i
                while state and j < len(words):
                    state = self._step(state, words[j])
                    j += 1
                    if self.final in state:
                        end = j
                if end is not None:
                    return i, end
        return None


def to_regex(markup: str) -> str:
    """The same language as a regular expression over words that each end with one space."""

    def of(tree: list) -> str:
        out = ""
        for x in tree:
            if isinstance(x, str):
                out += f"{x} "
            elif x[0] == "opt":
                out += f"(?:{of(x[1])})?"
            elif x[0] == "alt":
                out += "(?:" + "|".join(of(c) for c in x[1]) + ")"
            else:
                out += f"(?:[^ ]+ ){{0,{x[1]}}}"
        return out

    return of(parse(markup))


class Scanner:
    """Base phrases and templates over one text."""

    def __init__(self, base=BASE, templates=TEMPLATES):
        self.base = [(p.encode().split(), label) for p, label in base]
        self.automata = [(label, Automaton(markup)) for label, markup in templates]
        self.hints = sorted({max(p, key=len) for p, _ in self.base} | {a.anchor for _, a in self.automata}, key=len)

    def scan(self, text: str | None) -> tuple:
        """(n_words, base places, base labels, all labels, spans of templates by word)."""
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        inside = _IS_WORD[np.frombuffer(data, np.uint8)]
        n_words = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(len(inside) > 0 and inside[0])
        if not any(h in data for h in self.hints):
            return n_words, [], [], [], []
        words = _WORD.findall(data)
        there = set(words)
        places, base_labels, labels, spans = [], set(), set(), []
        for phrase, label in self.base:
            if there.issuperset(phrase):
                first, rest = phrase[0], phrase[1:]
                for i, w in enumerate(words):
                    if w == first and words[i + 1 : i + len(phrase)] == rest:
                        places.append(i)
                        base_labels.add(label)
        for label, automaton in self.automata:
            if (automaton.anchor in there or not automaton.anchor) and (span := automaton.find(words)):
                labels.add(label)
                spans.append((label, *span))
        return n_words, sorted(places), sorted(base_labels), sorted(labels | base_labels), spans


def scan_licenses(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """One row per document: base places and labels, template labels and a score.

    The score is 1 where a template is accepted, 0.5 where only a base phrase stands, else 0.
    """

    def run(batch: pa.RecordBatch) -> dict:
        scanner = Scanner(base, templates)
        out: dict = {k.split()[0]: [] for k in SCHEMA.split(", ")}
        out["doc_id"] = batch.column("doc_id")
        for text in batch.column("text").to_pylist():
            n, places, base_labels, labels, spans = scanner.scan(text)
            out["n_words"].append(n)
            out["n_base"].append(len(places))
            out["first_word"].append(places[0] if places else None)
            out["last_word"].append(places[-1] if places else None)
            out["base_labels"].append(",".join(base_labels))
            out["labels"].append(",".join(labels))
            out["score"].append(1.0 if spans else 0.5 if places else 0.0)
        return out

    return map_batches(docs.select("doc_id", "text"), run, SCHEMA)


def oracle(base=BASE, templates=TEMPLATES) -> str:
    """The same by DuckDB: phrases as list comparisons, templates as regular expressions."""
    hints = ", ".join(sorted({repr(max(p.split(), key=len)) for p, _ in base}))  # a word that each phrase has
    places = " ".join(
        f"WHEN array_to_string(list_slice(w, i, i + {len(p.split()) - 1}), ' ') = '{p}' THEN '{label}'" for p, label in sorted(base, key=lambda x: -len(x[0].split()))
    )
    found = ", ".join(f"CASE WHEN regexp_matches(joined, '(^| ){to_regex(m)}') THEN '{label}' END" for label, m in templates)
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
marked AS (
  SELECT doc_id, w, array_to_string(w, ' ') || ' ' AS joined,
         CASE WHEN list_has_any(w, [{hints}]) THEN
           list_filter(list_transform(range(1, len(w) + 1), lambda i: struct_pack(at := i - 1, label := CASE {places} END)), lambda x: x.label IS NOT NULL)
         ELSE [] END AS hits
  FROM words),
labelled AS (
  SELECT doc_id, w, hits, list_sort(list_distinct(list_transform(hits, lambda x: x.label))) AS base,
         list_filter([{found}], lambda x: x IS NOT NULL) AS more FROM marked)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(hits) AS BIGINT) AS n_base,
       CAST(list_min(list_transform(hits, lambda x: x.at)) AS BIGINT) AS first_word,
       CAST(list_max(list_transform(hits, lambda x: x.at)) AS BIGINT) AS last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base, more))), ','), '') AS labels,
       CASE WHEN len(more) > 0 THEN 1.0 WHEN len(hits) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM labelled"""
