"""Prefix trie, licence notices and hard negatives against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import plain
import pytest
from hypothesis import given
from hypothesis import strategies as st

from voxloom.llm import op11_trie, op12_licenses, op13_negatives
from voxloom.llm.common import table

# --- prefix trie ---

TURNS = "conv_id long, turn long, role string, text string, node string, depth int, up int"


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(x)] for c, x in turns.items()}
    members = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        members[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    nodes, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, seq in members.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
            if d:
                kids[tuple(seq[:d - 1])].add(tuple(seq[:d]))
        ends[tuple(seq)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, convs in nodes.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not kids[key]
            saved[key[:d]] += (len(convs) - 1) * len(key[-1][1].encode()) if key else 0
    return sorted((min(convs), len(key), min(nodes[key[:-1]]) if key else -1, len(convs), len(kids[key]), leaves[key], saved[key],
                   hashlib.sha256(",".join(map(str, sorted(ends[key]))).encode()).hexdigest()) for key, convs in nodes.items())


def got_trie(frame, height=op11_trie.HEIGHT):
    out = op11_trie.trie_report(frame, height)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in out.dtypes[:-1]} == {"bigint"}
    return sorted(tuple(-1 if x is None else x for x in r) for r in out.collect())


def odd_turns():
    rows = [(0, None, "user", "first"), (0, 1, None, None), (0, 2, "user", "é"), (0, 2, "user", "é"), (0, 2, "a", "b"),
            (1, 5, "user", "first"), (1, None, "", ""), (3, 0, "u", "x"), (None, 1, "u", "lost"), (12, 0, "only", "child"),
            (13, 0, "u", None), (14, 1, "u", ""), (14, 2, "u", "\0"), (21, None, None, None)]
    # Long ones that share long starts, and a text of many bytes.
    rows += [(c, t, "user", f"t{t if t < 40 + c else (c, t)}") for c in range(25, 30) for t in range(75)]
    rows += [(100 + c, 0, "user", "same start") for c in range(60)] + [(200, 0, "u", "long " * 50_000), (205, 0, "u", "long " * 50_000)]
    return rows


@pytest.mark.parametrize("height", [1, 4, 32])
def test_trie_against_brute_force(spark, height):
    rows = odd_turns()
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS).repartition(7)
    assert got_trie(frame, height) == brute_trie(rows)


def test_trie_of_a_table(spark, small):
    turns = table(spark, small, "conversations")
    assert got_trie(turns) == brute_trie([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    assert got_trie(turns.limit(0)) == []


def test_trie_of_turnless_and_busy_parents(spark, monkeypatch):
    turnless = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0][:3]
    rows = [(c, 0, "u", "mine") for c in turnless]
    assert got_trie(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS)) == brute_trie(rows)
    rows = [(5 * c, 0, "u", f"t{c % 300}") for c in range(400)]
    assert got_trie(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS)) == brute_trie(rows)
    monkeypatch.setattr(op11_trie, "RANGE_IDS", 3)
    monkeypatch.setattr(op11_trie, "max", lambda *a: 2, raising=False)      # parents of three children go by broadcast
    assert got_trie(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS)) == brute_trie(rows)


# --- licences ---

_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(text):
    w = _WORD.findall((text or "").translate(plain.FOLD))
    at, labels = [], set()
    for phrase, label in op12_licenses.BASE:
        p = phrase.split()
        hits = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


NOTES = ["Released under the MIT License.", "UNDER THE MIT LICENSE under the mit license", "under the\nmit--license!", "under the mıt license",
         "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0 cc by nc", "cc by nc", "cc by nc" * 3, "xcc by nc", "cc by ncx",
         "This work is licensed under the GNU General Public License, version 3.", "cc by sa", "under the mit license cc by nc nd",
         "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0-only WITH Classpath-exception-2.0\nmore text",
         "spdx-license-identifier: mit or", "spdx-license-identifier:", "spdx-license-identifier: (", "spdx license identifier) mit", None, "",
         " \t", "under the mit", "license", "under the mit license" + " x" * 200_000 + " cc by nc"]


def test_base_licences_against_brute_force(spark, small):
    rows = [*plain.awkward(), *((1000 + i, t, None, None, None, "e", 1, 0.1) for i, t in enumerate(NOTES))]
    for frame in (spark.createDataFrame(rows, plain.DOCS), table(spark, small, "documents")):
        want = sorted(((str(r.doc_id), *map(str, brute_base(r.text))) for r in frame.collect()))
        got = op12_licenses.scan(frame).collect()
        assert sorted((str(r.doc_id), *map(str, r[1:6])) for r in got) == want
        for r in got:
            assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
            assert 0 <= r.score <= 1 and (r.score > 0) <= bool(r.labels) and r.labels.split(",") == sorted(set(r.labels.split(",")))
    assert op12_licenses.scan(frame.limit(0)).count() == 0


def test_own_labels(spark):
    frame = spark.createDataFrame(list(enumerate(NOTES)), "doc_id int, text string")
    got = {NOTES[r.doc_id]: r for r in op12_licenses.scan(frame).collect()}
    assert got[NOTES[10]].labels == "gpl-3" and got["cc by sa"].labels == "cc-by-sa" and got["cc by sa"].base_labels == ""
    assert got[NOTES[12]].labels == "cc-by-nc,cc-by-nc-nd,mit" and got[NOTES[12]].score == 0.9
    assert got[NOTES[13]].labels == "apache-2,gpl-3,gpl-3-with-classpath-exception-2,mit"
    assert got[NOTES[13]].score == pytest.approx(0.5)
    assert got["spdx-license-identifier: mit or"].labels == "mit" and got["spdx-license-identifier: ("].labels == ""
    assert got[None].labels == "" and got[None].score == 0


TERMS = st.recursive(st.sampled_from(["mit", "apache-2.0", "gpl-3.0-only", "mpl-2.0", "odd"]),
                     lambda inner: st.tuples(inner, st.sampled_from(["or", "and"]), inner), max_leaves=12)


def spelled(tree) -> str:
    return tree if isinstance(tree, str) else f"({spelled(tree[0])} {tree[1]} {spelled(tree[2])})"


def value_of(tree):
    if isinstance(tree, str):
        label = op12_licenses.label_of(tree)
        return {label}, op12_licenses.strictness(label)
    (a, x), (b, y) = value_of(tree[0]), value_of(tree[2])
    return a | b, (max if tree[1] == "and" else min)(x, y)


@given(TERMS)
def test_expressions(tree):
    assert op12_licenses.expression(spelled(tree).encode()) == value_of(tree)


@given(st.lists(st.sampled_from(["mit", "gpl-3.0", "or", "and", "with", "(", ")", "\n", "!"]), max_size=12))
def test_broken_expressions_are_no_error(parts):
    got = op12_licenses.expression(" ".join(parts).encode())
    assert got is None or (got[0] and 0 <= got[1] <= 1)


def test_precedence():
    e = op12_licenses.expression
    assert e(b"mit or apache-2.0 and gpl-3.0")[1] == 0.1 and e(b"(mit or apache-2.0) and gpl-3.0")[1] == 0.7
    assert e(b"gpl-3.0 with classpath-exception-2.0 or agpl-3.0") == ({"gpl-3", "gpl-3-with-classpath-exception-2", "agpl-3"}, 0.7 - 0.2)
    assert e(b"mit apache-2.0") == ({"mit"}, 0.1) and e(b"mit or (apache-2.0 and") == ({"mit", "apache-2"}, 0.1)
    assert e(b"or mit") is None and e(b"") is None


# --- hard negatives ---

VECTORS = "vec_id long, embedding array<double>, label int, uid string, v int, rank int"


def brute_negatives(rows, every=50, shift=True):
    kept = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if shift and vec_id is not None and vec_id % 7 == 0 else label
        kept.append((vec_id, [int(np.floor(256.0 * float(x))) for x in v], label))
    out = []
    for i, (a, v, la) in enumerate(kept):
        if a is None or a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=False)), (b is None, b or 0), b, lb) for j, (b, w, lb) in enumerate(kept) if j != i]
        scored.sort(key=lambda s: s[:2])
        for p, _, pid, _ in [s for s in scored if s[3] == la][:5]:
            band = [s for s in scored if s[3] != la and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(a, pid, k + 1, s[2], -p, -s[0]) for k, s in enumerate(band)]
    return sorted(out, key=str)


def test_hard_negatives_against_brute_force(spark, small, monkeypatch):
    vectors = table(spark, small, "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    got = op13_negatives.mine(op13_negatives.shifted_labels(vectors), block_rows=23, group_rows=3)
    assert sorted(map(tuple, got.collect()), key=str) == brute_negatives(rows)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
                          ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert op13_negatives.mine(vectors.limit(0)).count() == 0 and op13_negatives.mine(vectors.where("vec_id % 50 <> 0")).count() == 0


def odd_vectors():
    rng = np.random.default_rng(8)
    near = rng.normal(size=4)
    rows = [(i, (near + rng.normal(size=4) * 0.4).tolist(), int(rng.integers(0, 3))) for i in range(160)]
    rows += [(200, None, 1), (250, [1.0, float("nan")], 1), (300, [1.0, None], 1), (350, [float("inf")], 1), (400, [1.0], None),
             (None, near.tolist(), 1), (500, [], 2), (550, [0.5], 2), (0, rows[0][1], 0), (0, rows[0][1], 1), (600, near.tolist(), 1),
             (601, near.tolist(), 1), (602, near.tolist(), 2), (603, near.tolist(), 2)]
    return rows


@pytest.mark.parametrize("chunk,keep", [(500_000, 64), (7, 0)])
def test_hard_negatives_of_awkward_rows(spark, monkeypatch, chunk, keep):
    monkeypatch.setattr(op13_negatives, "CHUNK", chunk)
    monkeypatch.setattr(op13_negatives, "KEPT_GROUPS", keep)
    rows = odd_vectors()
    frame = spark.createDataFrame([(*r, "u", 1, 2) for r in rows], VECTORS).repartition(5)
    got = op13_negatives.mine(op13_negatives.shifted_labels(frame), block_rows=16, group_rows=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute_negatives(rows)


def broadcast_types(df):
    """Types of the columns of every broadcast in the plan."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        if name == "BroadcastExchangeExec":
            columns = node.output()
            found.append([columns.apply(i).dataType().typeName() for i in range(columns.size())])
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_packed_vectors_are_never_broadcast(spark, monkeypatch):
    frames, cells = [], []
    kept, meet = op13_negatives.stash, op13_negatives._meet

    def seen(df, name="stash"):
        frames.append(df)
        return kept(df, name)

    def met(groups, blocks, found, *args):
        cells.append((groups.count(), blocks.count(), found.count()))
        return meet(groups, blocks, found, *args)
    monkeypatch.setattr(op13_negatives, "stash", seen)
    monkeypatch.setattr(op13_negatives, "_meet", met)
    monkeypatch.setattr(op13_negatives, "KEPT_GROUPS", 2)
    rng = np.random.default_rng(13)
    rows = [(i, rng.normal(size=6).tolist(), int(rng.integers(0, 3))) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    got = op13_negatives.mine(frame, every=20, block_rows=8, group_rows=4)
    frames.append(got)
    assert not [types for df in frames for types in broadcast_types(df) if {"binary", "array"} & set(types)]
    assert len(cells) == 2 and all(0 < found < groups * blocks / 8 for groups, blocks, found in cells)
    assert sorted(map(tuple, got.collect()), key=str) == brute_negatives(rows, every=20, shift=False)


@pytest.mark.parametrize("top", [5, 40_000, 3 * 10 ** 9, 1e150])
def test_packed_components_come_back(top):
    v = np.array([[top, -top, 0.0], [1.0, -1.0, 2.0]])
    data = op13_negatives._narrow(v)
    assert op13_negatives._wide(data, 2, 3).tolist() == v.tolist() and len(data) == 6 * {5: 2, 40_000: 4}.get(top, 8)
    assert op13_negatives._wide(op13_negatives._narrow(v[:, :0]), 2, 0).shape == (2, 0)


@given(st.integers(1, 6), st.integers(1, 9), st.integers(1, 5), st.sampled_from([3, 200, 10 ** 6, 10 ** 9, 10 ** 14]), st.integers(0, 99))
def test_packed_products(n, m, dims, top, seed):
    rng = np.random.default_rng(seed)
    a, c = (rng.integers(-top, top + 1, (k, dims)).astype(float) for k in (n, m))
    want = [[min(max(sum(int(x) * int(y) for x, y in zip(r, s, strict=True)), -2 ** 63), 2 ** 63 - 1) for s in c] for r in a]
    assert op13_negatives.packed_products(a, c).tolist() == want
    assert op13_negatives.packed_products(a + top, c + top).tolist() == op13_negatives._wide_products(a + top, c + top, 160).tolist()
    assert op13_negatives.packed_products(a[:0], c).shape == (0, m)
