"""License scans: base phrases, and templates whose markup compiles to token automata.

Words are the runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased. A template is
wording with markup: `[[...]]` is optional, `{{name:a-b}}` stands for a to b words of any kind,
`(x|y)` for one of some words. It compiles to an automaton over words without backtracking;
a text is accepted where a run of its words takes the automaton to its end, so the
mandatory wording must match exactly and in order. Labels that end in -clause and those of short
notices stand for that wording alone, the others of long wordings for whole licenses. An automaton runs on
texts that hold all of its mandatory words.

score is 1 - 0.5 ** places of base phrases * 0.25 ** labels by templates: 0 without any.
Null and empty texts have no words, no labels (empty strings) and score 0. Ids may be null or
repeated: one result row for each row. Other columns are not read. An empty table gives an
empty result. Texts are whole, of any length.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Standard wordings of licenses, in this module's markup.
MIT_START = "permission is hereby granted free of charge to any person obtaining a copy of this [[{{thing:1-2}}]] software"
ISC_START = "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"
BSD_START = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice "
    "this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
BSD_END = (
    "this software is provided by {{holder:1-8}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{holder:1-8}} "
    "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability "
    "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
TEMPLATES = {
    "agpl-3.0": "gnu affero general public license [[as published by the free software foundation either]] version 3",
    "apache-2.0": "licensed under [[the terms of]] the apache license [[{{name:1-1}}]] version 2 0",
    "apache-2.0-named": "[[the]] apache license version 2 0",
    "bsd-clause": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-2-clause": BSD_START + BSD_END,
    "bsd-3-clause": BSD_START + "[[3]] neither the name of [[the]] {{holder:1-8}} nor the names of (its|the) [[copyright holders nor the names of its]] contributors may be used to endorse or promote products derived from this software without specific prior written permission " + BSD_END,
    "bsd-named": "(released|licensed|distributed|available) under [[the terms of]] [[the]] [[(new|simplified|revised)]] [[(2|3|4) clause]] bsd [[(2|3|4) clause]] license",
    "cc-by-4.0": "cc by 4 0",
    "cc-by-nc-4.0": "cc by nc 4 0",
    "cc-by-nc-nd-4.0": "cc by nc nd 4 0",
    "cc-by-nc-sa-4.0": "cc by nc sa 4 0",
    "cc-by-nd-4.0": "cc by nd 4 0",
    "cc-by-sa-4.0": "cc by sa 4 0",
    "cc0-1.0": "(cc0|cc 0) [[1 0]] [[universal]]",
    "copyright": "copyright [[c]] {{year:1-1}} {{holder:1-6}} all rights reserved",
    "gpl-2.0": "gnu general public license [[as published by the free software foundation either]] version 2",
    "gpl-3.0": "gnu general public license [[as published by the free software foundation either]] version 3",
    "isc-clause": ISC_START,
    "isc": ISC_START + " provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {{holder:1-6}} (disclaims|disclaim) all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{holder:1-6}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "lgpl": "gnu (lesser|library) general public license",
    "mit": "(released|licensed|distributed|available) under [[the terms of]] the mit license",
    "mit-clause": MIT_START,
    "mit-text": MIT_START + " and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the {{holder:0-6}} authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mpl-2.0": "mozilla public license [[v]] [[version]] 2 0",
    "spdx": "spdx license identifier {{id:1-1}}",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
NAMES = {k: k.removesuffix("-named").removesuffix("-text") for k in TEMPLATES}


def parse(template: str) -> list:
    """Nodes: ("word", w), ("any", least, most), ("one", [[nodes], ...]), ("maybe", [nodes])."""
    tokens = re.findall(r"\[\[|\]\]|\{\{\w+:\d+-\d+\}\}|[()|]|[^\s\[\](){}|]+", template)
    at = 0

    def sequence(ends: tuple[str, ...]) -> list:
        nonlocal at
        out = []
        while at < len(tokens) and tokens[at] not in ends:
            t = tokens[at]
            at += 1
            if t == "[[":
                out.append(("maybe", sequence(("]]",))))
                at += 1
            elif t == "(":
                ways = [sequence(("|", ")"))]
                while tokens[at] == "|":
                    at += 1
                    ways.append(sequence(("|", ")")))
                at += 1
                out.append(("one", ways))
            elif m := re.fullmatch(r"\{\{\w+:(\d+)-(\d+)\}\}", t):
                out.append(("any", int(m[1]), int(m[2])))
            else:
                out.append(("word", t))
        return out

    return sequence(())


def mandatory(nodes: list) -> set[bytes]:
    """Words that all accepted texts hold."""
    out: set[bytes] = set()
    for node in nodes:
        if node[0] == "word":
            out.add(node[1].encode())
        elif node[0] == "one":
            out |= set.intersection(*map(mandatory, node[1]))
    return out


class Automaton:
    """States with word edges, edges for any word, and free edges; the last state accepts."""

    def __init__(self, template: str):
        self.words: list[dict[bytes, list[int]]] = []
        self.any: list[list[int]] = []
        self.free: list[list[int]] = []
        start = self._state()
        self.end = self._build(parse(template), start)
        self.closed = [self._close(s) for s in range(len(self.words))]
        self.start = self.closed[start]
        self.first = {w for s in self.start for w in self.words[s]}
        self.anywhere = any(self.any[s] for s in self.start) or self.end in self.start
        self.mandatory = mandatory(parse(template))

    def _state(self) -> int:
        self.words.append({})
        self.any.append([])
        self.free.append([])
        return len(self.words) - 1

    def _build(self, nodes: list, at: int) -> int:
        for node in nodes:
            to = self._state()
            if node[0] == "word":
                self.words[at].setdefault(node[1].encode(), []).append(to)
            elif node[0] == "any":
                here = at
                for k in range(node[2]):
                    if k >= node[1]:
                        self.free[here].append(to)
                    there = self._state()
                    self.any[here].append(there)
                    here = there
                self.free[here].append(to)
            else:
                for way in node[1] if node[0] == "one" else [node[1]]:
                    self.free[self._build(way, at)].append(to)
                if node[0] == "maybe":
                    self.free[at].append(to)
            at = to
        return at

    def _close(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def accepts_at(self, words: list[bytes], i: int) -> bool:
        states = self.start
        while states:
            if self.end in states:
                return True
            if i >= len(words):
                return False
            reached: set[int] = set()
            for s in states:
                for t in self.words[s].get(words[i], ()):
                    reached |= self.closed[t]
                for t in self.any[s]:
                    reached |= self.closed[t]
            states, i = frozenset(reached), i + 1
        return False


_TABLE = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32 for b in range(256))


def scan(text: str | None, automata: dict[str, Automaton]) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = (text or "").encode("utf-8", "replace").lower().translate(_TABLE).split()
    joined = b" ".join(words)
    starts, base = [], set()
    for phrase, label in BASE.items():
        own = phrase.encode().split()
        if b" ".join(own) in joined:
            found = [i for i, w in enumerate(words) if w == own[0] and words[i : i + len(own)] == own]
            if found:
                starts += found
                base.add(label)
    own_labels, held = set(), set(words)
    for name, automaton in automata.items():
        label = NAMES.get(name, name)
        if label not in own_labels and automaton.mandatory <= held and any((automaton.anywhere or w in automaton.first) and automaton.accepts_at(words, i) for i, w in enumerate(words)):
            own_labels.add(label)
    score = 1 - 0.5 ** len(starts) * 0.25 ** len(own_labels)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | own_labels)), score


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        automata = {k: Automaton(t) for k, t in (templates or TEMPLATES).items()}
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            found = [scan(t, automata) for t in batch.column("text").to_pylist()]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", *names])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {RESULT}").withColumnRenamed("id", id_col)


def pattern(template: str) -> str:
    """The template as a regular expression over words with one space after each; for SQL."""

    def text(nodes: list) -> str:
        out = ""
        for node in nodes:
            if node[0] == "word":
                out += node[1] + " "
            elif node[0] == "any":
                out += "(?:[^ ]+ ){%d,%d}" % node[1:]
            elif node[0] == "one":
                out += "(?:" + "|".join(text(w) for w in node[1]) + ")"
            else:
                out += f"(?:{text(node[1])})?"
        return out

    return " " + text(parse(template))


def oracle() -> str:
    """DuckDB SQL for license_scan over documents."""
    phrases = []
    for phrase, label in BASE.items():
        own = phrase.split()
        test = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(own))
        phrases.append((f"list_filter(range(len(w)), lambda i: {test})", label))
    lists = ", ".join(f"{p} AS s{k}" for k, (p, _) in enumerate(phrases))
    starts = "list_concat(list_concat(s0, s1), s2)"
    base = "list_filter([" + ", ".join(f"CASE WHEN len(s{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(phrases)) + "], lambda x: x IS NOT NULL)"
    by_label: dict[str, list[str]] = {}
    for name, t in TEMPLATES.items():
        by_label.setdefault(NAMES[name], []).append(f"regexp_matches(j, '{pattern(t)}')")
    own = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(tests)} THEN '{label}' END" for label, tests in by_label.items()) + "], lambda x: x IS NOT NULL)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
  SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j, {lists} FROM words
), found AS (
  SELECT doc_id, len(w) AS n, {starts} AS s, {base} AS b, {own} AS o FROM places
)
SELECT doc_id, n::BIGINT AS n_words, len(s)::BIGINT AS n_base, list_min(s)::BIGINT AS first_word, list_max(s)::BIGINT AS last_word,
       array_to_string(list_sort(b), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(b, o))), ',') AS labels,
       1 - pow(0.5, len(s)) * pow(0.25, len(o)) AS score
FROM found"""
