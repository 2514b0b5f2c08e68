"""Plain Python answers to hold the corpus operators against, and awkward documents."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, kept int, _u double"

_PROSE = "The old man went to sea. He caught no fish for many days. Then a great fish came near the boat. It was long and blue. Everybody on the shore was waiting for him. "


def awkward() -> list[tuple]:
    """Nulls in every column, empty and very long texts, repeated rows, ties, odd white space, clashing column names."""
    texts = {
        1: _PROSE + "One line of its own ends this text here.", 2: _PROSE + "Another line ends the second text instead.",
        3: None, 4: "", 5: " \t\n ", 6: "word", 7: "Word", 8: "a\x0bb\x0cc  d e 　 f\n\n'tis don't", 9: "word",
        10: " ".join(f"w{i % 977}x{i // 31}" for i in range(20_000)), 11: "é" * 300 + " ǘß ﬁ <|endoftext|> 😀😀",
        12: "same same same same same same same same", 13: "same same same same same same same same",
        14: "x  y   z   q\x1c\x1d w\x85v"}
    rows = [(k, t, "en", f"s{k % 4}" if k % 5 else None, None if t is None else len(t), "extra", 7, 0.5) for k, t in texts.items()]
    return [*rows, rows[0], (None, "word", None, None, None, None, None, None), (20, texts[2], "en", "s1", 3, "e", 1, 1.0)]


def words(text: str | None) -> list[str]:
    return WORDS.findall(text or "")


def lower_words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").translate(FOLD))


def shingles(text: str | None, k: int) -> frozenset:
    w = lower_words(text)
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(sets: list[frozenset], num: int, den: int) -> list[int]:
    """Smallest row number of each row's component."""
    parent = list(range(len(sets)))

    def top(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in holders[g]).items():
            if den * both >= num * (len(s) + len(sets[j]) - both):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(i)
    return [top(i) for i in range(len(sets))]


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0) -> dict:
    """Shares by weight, the excess over the limits handed on until there is none."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed: dict = {}
    while True:
        left = share * sum(sizes.values()) - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        got = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if got[s] >= most * sizes[s]]
        if not over:
            return fixed | got
        fixed |= {s: most * sizes[s] for s in over}


BLANK = " \t\n\r\f\v"


def sentences(text: str) -> list[str]:
    """Cut behind white space after a full stop, and at line starts."""
    out, start = [], 0
    for i in range(1, len(text)):
        behind = re.search(r"[.!?][ \t\n\r\f\v]{1,8}$", text[max(0, i - 9):i])
        if text[i] not in BLANK and (behind or text[i - 1] == "\n"):
            out.append(text[start:i])
            start = i
    return [*out, text[start:]] if text[start:] else out


def spans(text: str, least: int, long: int) -> list[tuple[int, int, str]]:
    s = [x.strip(BLANK) for x in sentences(text)]
    out = []
    for i in range(len(s)):
        n = 0
        for j in range(i, len(s)):
            n += len(s[j])
            if (j > i and n >= least) or (j == i and n >= long):
                out.append((i, j, "\0".join(s[i:j + 1])))
                break
    return out


def kept_sentences(docs: list[tuple[int, str]], least: int, long: int) -> dict[int, str]:
    """Texts without the sentences of repeated runs; documents in the order of their ids."""
    first, cut = {}, defaultdict(set)
    for doc, text in sorted(docs):
        for i, j, run in spans(text, least, long):
            if first.setdefault(run, (doc, i)) != (doc, i):
                cut[doc] |= set(range(i, j + 1))
    return {doc: "".join(s for i, s in enumerate(sentences(text)) if i not in cut[doc]) for doc, text in docs}
