"""Licence notices and licence expressions in texts.

Texts are lower-cased (A-Z) and cut into words of letters, digits and signs beyond ASCII.
The words, one blank between two, run through an Aho-Corasick automaton of notice phrases
and identifier tags, which finds all of them in one pass, overlapping ones too.

* Notice phrases stand for a label.  The base phrases always count.  Of the further ones
  that begin at one word only the longest does ("cc by" inside "cc by sa" does not).
* Behind a tag ("SPDX-License-Identifier:") stands an expression of licence names, ``and``,
  ``or``, ``with`` and brackets.  A shunting-yard parser evaluates as much of it as is well
  formed: its labels are those of its names, and of the value the stricter side counts
  under ``and``, the milder under ``or``, and an exception (``with``) softens.

Labels carry how far they restrict reuse, from 0 to 1; a document's score is that of its
strictest notice or expression, 0 without one.

Cases: null texts are empty (no words, no labels, null first and last word, score 0);
broken expressions count up to the fault; rows that repeat an id stay rows; very long
texts are worked on whole; no rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, folded, ragged, slices, word_bounds

#: Phrases of the contract and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Further notices.
NOTICES = (
    ("mit license", "mit"), ("permission is hereby granted free of charge to any person", "mit"), ("isc license", "isc"),
    ("apache license 2", "apache-2"), ("apache 2 0 license", "apache-2"),
    ("bsd 2 clause", "bsd-2-clause"), ("bsd 3 clause", "bsd-3-clause"), ("bsd license", "bsd"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("gnu general public license", "gpl"), ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"), ("gnu gpl", "gpl"),
    ("gnu lesser general public license", "lgpl"), ("gnu library general public license", "lgpl"),
    ("gnu affero general public license", "agpl"), ("mozilla public license", "mpl"), ("eclipse public license", "epl"),
    ("creative commons attribution", "cc-by"), ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution share alike", "cc-by-sa"), ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution non commercial", "cc-by-nc"), ("creative commons attribution noderivatives", "cc-by-nd"),
    ("cc by", "cc-by"), ("cc by sa", "cc-by-sa"), ("cc by nd", "cc-by-nd"), ("cc by nc sa", "cc-by-nc-sa"),
    ("cc by nc nd", "cc-by-nc-nd"), ("cc0", "cc0"), ("dedicated to the public domain", "public-domain"),
    ("all rights reserved", "all-rights-reserved"))
#: Words of the tags that an expression follows.
TAGS = ("spdx license identifier", "packagelicensedeclared", "packagelicenseconcluded", "license expression")
#: How far a licence restricts reuse, by the start of its label; the longest start that fits counts.
STRICTNESS = {"mit": 0.1, "isc": 0.1, "bsd": 0.1, "zlib": 0.1, "unlicense": 0.0, "0bsd": 0.0, "cc0": 0.0, "public-domain": 0.0,
              "apache": 0.2, "cc-by": 0.2, "mpl": 0.4, "epl": 0.4, "lgpl": 0.5, "cc-by-sa": 0.6, "gpl": 0.7, "agpl": 0.8,
              "cc-by-nc": 0.9, "cc-by-nd": 0.9, "all-rights-reserved": 1.0}
UNKNOWN, EXCEPTION = 0.5, 0.2

_INSIDE = np.ones(256, bool)
_INSIDE[[b for b in range(128) if not chr(b).isalnum()]] = False
_OUTSIDE = ~_INSIDE
_BINDING = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(rb"[ \t]*([()]|[a-z0-9][a-z0-9.+:-]*)")
_LEAD = re.compile(rb"[ \t:=\"'<>]*")


def label_of(name: str) -> str:
    """The label of a licence name: without "only", "or later" and a version's ".0"; without the version for cc licences."""
    name = re.sub(r"(\+|-only|-or-later)$", "", name.strip(".:+-") or name)
    name = re.sub(r"\.0$", "", name)
    return re.sub(r"-\d+(\.\d+)?$", "", name) if name.startswith("cc-") else name


def strictness(label: str) -> float:
    fit = [s for s in STRICTNESS if label == s or label.startswith(s + "-")]
    return STRICTNESS[max(fit, key=len)] if fit else UNKNOWN


def expression(text: bytes, at: int = 0, stop: int | None = None) -> tuple[set[str], float] | None:
    """Labels and value of the longest well-formed expression from ``at`` on, by a stack of values and one of operators."""
    stop = len(text) if stop is None else stop
    values: list[tuple[set[str], float]] = []
    waiting: list[str] = []

    def settle() -> None:
        how, (more, right), (labels, left) = waiting.pop(), values.pop(), values.pop()
        if how == "with":
            joined = {f"{a}-with-{b}" for a in labels for b in more}
            values.append((labels | joined, max(0.0, left - EXCEPTION)))
        else:
            values.append((labels | more, max(left, right) if how == "and" else min(left, right)))
    operand = True
    while m := _TOKEN.match(text, at, stop):
        token = m[1].decode()
        if operand:
            if token == "(":
                waiting.append(token)
            elif token == ")" or token in _BINDING:
                break
            else:
                label = label_of(token)
                values.append(({label}, strictness(label)))
                operand = False
        elif token == ")":
            if "(" not in waiting:
                break
            while waiting[-1] != "(":
                settle()
            waiting.pop()
        elif token in _BINDING:
            while waiting and waiting[-1] != "(" and _BINDING[waiting[-1]] >= _BINDING[token]:
                settle()
            waiting.append(token)
            operand = True
        else:
            break
        at = m.end()
    if operand:                      # a bracket or an operator without what it calls for
        while waiting and waiting[-1] == "(":
            waiting.pop()
        if waiting:
            waiting.pop()
    while waiting:
        if waiting[-1] == "(":
            waiting.pop()
        else:
            settle()
    return values[0] if values else None


def automaton(base, notices, tags):
    """All phrases between blanks; the value of each: blank-led length, kind and label."""
    import ahocorasick
    made: dict[str, list] = {}
    for kind, pairs in (("base", base), ("notice", notices), ("tag", [(t, "") for t in tags])):
        for phrase, label in pairs:
            words = f" {phrase} ".encode().decode("latin-1")
            made.setdefault(words, []).append((kind, label))
    out = ahocorasick.Automaton()
    for words, uses in made.items():
        out.add_word(words, (len(words), uses))
    out.make_automaton()
    return out


def normal_form(raw: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words with a blank before each and behind the last of a text, then a line end; where each word starts in it;
    starts, stops and texts of the words."""
    starts, stops, per_text = word_bounds(raw, offsets, _OUTSIDE)
    sizes = stops - starts
    text = np.repeat(np.arange(len(per_text)), per_text)
    ends = np.cumsum(sizes + 1)
    place = ends - sizes + 2 * text
    out = np.full(int(ends[-1] if len(ends) else 0) + 2 * len(per_text), 32, np.uint8)
    out[ragged(place, sizes)] = raw[ragged(starts, sizes)]
    last = np.cumsum(per_text)
    out[np.concatenate(([0], ends))[last] + 2 * np.arange(len(per_text)) + 1] = 10
    return out.tobytes().decode("latin-1"), place, starts, stops, text


def scan_texts(raw: np.ndarray, offsets: np.ndarray, machine) -> list[tuple]:
    """Of each text: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    raw = folded(raw)
    words, place, _, stops, text = normal_form(raw, offsets)
    count = np.bincount(text, minlength=len(offsets) - 1)
    first_of = np.cumsum(count) - count
    found: dict[int, list] = {}
    longest: dict[int, tuple[int, list[str]]] = {}       # further notices by the word they begin at
    hits = [(end - size + 2, end, size, uses) for end, (size, uses) in machine.iter(words)]
    numbers = np.searchsorted(place, [h[0] for h in hits]).tolist() if hits else []
    data = None
    for word, (_, end, size, uses) in zip(numbers, hits, strict=True):
        mine = found.setdefault(int(text[word]), [[], set(), set(), 0.0])
        for kind, label in uses:
            if kind == "base":
                mine[0].append(word)
                mine[1].add(label)
                mine[3] = max(mine[3], strictness(label))
            elif kind == "notice":
                if size >= longest.get(word, (0,))[0]:
                    longest[word] = (size, [*(longest[word][1] if word in longest and longest[word][0] == size else []), label])
            else:
                data = raw.tobytes() if data is None else data
                t = int(text[word])
                last = int(np.searchsorted(place, end, side="left")) - 1
                at = _LEAD.match(data, int(stops[last]), int(offsets[t + 1])).end()
                value = expression(data, at, int(offsets[t + 1]))
                if value:
                    mine[2] |= value[0]
                    mine[3] = max(mine[3], value[1])
    base_at = {w: s for w, (_, _, s, uses) in zip(numbers, hits, strict=True) if any(k == "base" for k, _ in uses)}
    for word, (size, labels) in longest.items():
        if size >= base_at.get(word, 0):                 # a base phrase from the same word that is longer says more
            mine = found[int(text[word])]
            mine[2] |= set(labels)
            mine[3] = max(mine[3], max(map(strictness, labels)))
    out = []
    for t, n in enumerate(count.tolist()):
        at, base, more, score = found.get(t, ([], set(), set(), 0.0))
        at = [w - int(first_of[t]) for w in at]
        out.append((n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
                    ",".join(sorted(base | more)), score))
    return out


RESULT = (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
          ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()))


def scan(docs: DataFrame, base=BASE, notices=NOTICES, tags=TAGS) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(base, notices, tags)
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            for a, b in slices(offsets):
                rows = scan_texts(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], machine)
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), RESULT, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns],
                                                 ["doc_id", *[n for n, _ in RESULT]])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
