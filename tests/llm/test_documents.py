"""Operators on documents against brute force, over awkward rows, empty tables and the small tables."""

import hashlib
import zlib
from collections import Counter
from math import log10

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxloom.llm import op01_spans, op02_mix, op03_ctw, op06_exact, op07_quality, op08_jaccard
from voxloom.llm.common import table
from voxloom.llm.links import components


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(plain.awkward(), plain.DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], plain.DOCS)


@pytest.fixture(scope="module")
def docs(spark, small):
    return table(spark, small, "documents")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- substring deduplication ---

def test_spans_against_brute_force(spark, docs):
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.text for r in op01_spans.remove_repeats(docs).collect()}
    assert got == plain.kept_sentences(texts, op01_spans.LEAST_CHARS, op01_spans.LONG_CHARS)
    changed = {d for d, t in texts if got[d] != t}
    assert {r.doc_id for r in op01_spans.removed_ranges(docs).collect()} == changed and changed


def test_spans_of_awkward_rows(odd, none):
    got = op01_spans.remove_repeats(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    by_id = {r.doc_id: r.text for r in got.collect()}
    assert by_id[1] == plain.awkward()[0][1] and by_id[3] is None and by_id[4] == ""
    assert by_id[2] == "Another line ends the second text instead." and by_id[20] == ""
    assert op01_spans.remove_repeats(none).count() == 0 and op01_spans.removed_ranges(none).count() == 0


def test_spans_inside_one_document(spark):
    part = "This is the first of two sentences that are long enough. This is the second one, and together they make a run. "
    text = part + "Something else stands between them, alone. " + part
    got = op01_spans.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string"), least_chars=80).first().text
    assert got == plain.kept_sentences([(1, text)], 80, 240)[1] and got.count("the first of two") == 1


def runs_from_both_ends(text, least, long):
    s = [x.strip(plain.BLANK) for x in plain.sentences(text)]
    out = {(i, i) for i in range(len(s)) if len(s[i]) >= long}
    for i in range(len(s)):
        out |= set([(i, j) for j in range(i + 1, len(s)) if sum(map(len, s[i:j + 1])) >= least][:1])
        out |= set([(j, i) for j in range(i - 1, -1, -1) if sum(map(len, s[j:i + 1])) >= least][:1])
    return [(i, j, "\0".join(s[i:j + 1])) for i, j in sorted(out)]


@pytest.mark.parametrize("near", [1, 6])
def test_spans_from_both_ends_against_brute_force(spark, docs, monkeypatch, near):
    monkeypatch.setattr(op01_spans, "NEAR", near)
    monkeypatch.setattr(plain, "spans", runs_from_both_ends)
    some = docs.where("n_chars < 6000 and doc_id is not null")
    texts = [(r.doc_id, r.text) for r in some.select("doc_id", "text").collect()]
    got = {r.doc_id: r.text for r in op01_spans.remove_repeats(some, both_ends=True).collect()}
    assert got == plain.kept_sentences(texts, op01_spans.LEAST_CHARS, op01_spans.LONG_CHARS)
    assert any(got[d] != t for d, t in texts)


def test_spans_reach_the_end_of_a_shared_passage(spark):
    long, short = "A" + "b" * 257 + ". ", "C" + "d" * 174 + ". "
    lines = ["First of three is here and it takes some room on the line. ", "Second is a bit more. ", "Third ends the passage, and is not long either, but enough for two. "]
    for passage in (long + short, short + long, long + long.upper(), "".join(lines), "".join(lines[:2]) + short):
        rows = [(i, f"Own start {i}. {passage}Own end {i} of this text.") for i in range(3)]
        got = {r.doc_id: r.text for r in op01_spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), both_ends=True).collect()}
        assert got == {0: rows[0][1]} | {i: f"Own start {i}. Own end {i} of this text." for i in (1, 2)}


# --- mixing ---

def test_mix_targets_against_brute_force(spark, docs):
    got = op02_mix.mix_report(docs).toPandas()
    size = {r.doc_id: len(plain.words(r.text)) for r in docs.collect()}
    assert (got["size"] == got.doc_id.map(size)).all() and len(got) == len(size)
    per = got.groupby("source")["size"].sum().to_dict()
    want = plain.targets(per)
    assert np.allclose(got.target, got.source.map(want)) and (got.source_size == got.source.map(per)).all()
    assert (got.taken == got.copies * got["size"]).all() and (got.taken <= 2 * got["size"]).all()
    longest = got.groupby("source")["size"].max()
    off = (got.groupby("source").taken.sum() - got.groupby("source").target.first()).abs()
    assert (off <= longest / 2 + 1).all()
    again = op02_mix.mix_report(docs.repartition(5), bucket_rows=7).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def pareto(rows, target, most=2.0):
    """Copies by the definition: (key, size, weight, u) of one source."""
    scale = target / sum(s * w for _, s, w, _ in rows)
    out, open_, total = {}, [], 0.0
    for k, s, w, u in rows:
        t = min(most, scale * w)
        out[k] = int(t)
        total += out[k] * s
        if t > out[k]:
            p = t - out[k]
            open_.append((u / (1 - u) / (p / (1 - p)), k, s))
    for _, k, s in sorted(open_):
        if total + s / 2 <= target:
            out[k] += 1
            total += s
    return out, total


@pytest.mark.parametrize("bucket_rows,coarse", [(2000, 1024), (40, 2)])
def test_mix_draws_by_the_definition(spark, monkeypatch, bucket_rows, coarse):
    """Unequal weights: ranks, whole copies and the taken set of each source against a plain loop."""
    monkeypatch.setattr(op02_mix, "COARSE", coarse)
    monkeypatch.setattr(op02_mix, "LOOK", 10 ** 6)
    rows = [(i, " ".join(["w"] * (1 + i % 13)), "ab"[i % 3 > 0], float(i % 5) if i % 11 else None) for i in range(700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, worth double")
    got = op02_mix.mix_report(frame, weights=(2, 1), share=0.4, bucket_rows=bucket_rows, weight="worth").collect()
    u = {r.doc_id: r.u for r in frame.select("doc_id", op02_mix.draw(20).alias("u")).collect()}
    for source in "ab":
        mine = [r for r in got if r.source == source]
        want, total = pareto([(r.doc_id, r.size, max(0.0, rows[r.doc_id][3] or 0.0), u[r.doc_id]) for r in mine], mine[0].target)
        assert {r.doc_id: r.copies for r in mine} == want and sum(r.taken for r in mine) == total
        assert abs(total - mine[0].target) <= 7
    times = Counter(r.doc_id for r in op02_mix.mix(frame, weights=(2, 1), share=0.4, bucket_rows=bucket_rows, weight="worth").collect())
    assert times == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_pareto_inclusion_follows_the_weights(spark):
    rows = spark.range(6000).selectExpr("id AS doc_id", "'one two three' AS text", "'a' AS source", "cast(1 + id % 4 AS double) AS worth")
    got = op02_mix.mix_report(rows, weights=(1,), share=0.4, weight="worth").toPandas()
    share = got.groupby(got.doc_id % 4).copies.mean()
    assert np.abs(share.to_numpy() - 0.4 * np.arange(1, 5) / 2.5).max() < 0.04


def test_mix_repeats_rows_as_reported(docs):
    copies = {r.doc_id: r.copies for r in op02_mix.mix_report(docs).collect() if r.size}
    times = Counter(r.doc_id for r in op02_mix.mix(docs).collect())
    assert {d: n for d, n in copies.items() if n} == {d: n for d, n in times.items() if d in copies}


def test_mix_of_awkward_rows(odd, none):
    got = op02_mix.mix_report(odd)
    assert got.count() == odd.count()
    sizes = Counter()
    for r in plain.awkward():
        sizes[r[3]] += len(plain.words(r[1]))
    want = plain.targets(dict(sizes))
    for r in got.collect():
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
    assert op02_mix.mix(odd).columns == odd.columns
    assert op02_mix.mix_report(none).count() == 0 and op02_mix.mix(none).count() == 0


def test_pareto_inclusion_is_near_its_share(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "concat_ws(' ', array_repeat('w', cast(1 + id % 7 AS int))) AS text",
                                        "if(id % 3 = 0, 'a', 'b') AS source")
    got = op02_mix.mix_report(rows, weights=(1,), share=0.7).toPandas()
    share = got.groupby("size").copies.mean()
    assert (share - got.groupby("source").target.first().sum() / got["size"].sum()).abs().max() < 0.06


# --- context trees ---

def ctw_by_definition(train, text, depth):
    """Log10 probability by the recursion over all contexts, one decision after another."""
    from functools import lru_cache
    from math import exp, lgamma, log, pi
    counts = Counter()
    pad = b"\n" * depth

    def decisions(data):
        line = pad + data
        for i in range(depth, len(line)):
            for bit in range(8):
                node = (1 << bit) | (line[i] >> (8 - bit))
                yield line[i - depth:i], node, (line[i] >> (7 - bit)) & 1
    for data in train:
        for context, node, one in decisions(data):
            for d in range(depth + 1):
                counts[context[depth - d:], node, one] += 1
    seen = {(c, n) for c, n, _ in counts}

    @lru_cache(None)
    def log_e(context, node):
        a, b = counts[context, node, 0], counts[context, node, 1]
        return lgamma(a + .5) + lgamma(b + .5) - log(pi) - lgamma(a + b + 1)

    @lru_cache(None)
    def log_w(context, node):
        if (context, node) not in seen:
            return 0.0
        if len(context) == depth:
            return log_e(context, node)
        below = sum(log_w(bytes([x]) + context, node) for x in range(256) if (bytes([x]) + context, node) in seen)
        a, b = log(.5) + log_e(context, node), log(.5) + below
        return max(a, b) + log(1 + exp(-abs(a - b)))

    def chance(context, node, one, d):
        own = context[depth - d:]
        a, b = counts[own, node, 0], counts[own, node, 1]
        kt = ((b if one else a) + .5) / (a + b + 1)
        if d == depth:
            return kt
        share = exp(log(.5) + log_e(own, node) - log_w(own, node)) if (own, node) in seen else .5
        return share * kt + (1 - share) * chance(context, node, one, d + 1)
    return sum(log10(chance(c, n, one, 0)) for c, n, one in decisions(text))


def normal(text):
    return " ".join(plain.lower_words(text)).encode() + b"\n"


def held(doc_id):
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def test_context_trees_by_definition(spark):
    texts = [(i, t) for i, t in enumerate(["the cat sat", "The  Cat ran", "a dog sat", None, "", "the dog", "zz é 😀", "cat cat cat",
                                           "the cat sat", "ran ran", "a cat", "dog and cat", "the end", "sat the cat"])]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    train = [normal(t) for i, t in texts if not held(i)]
    for depth in (2, 3):
        got = {r.doc_id: r for r in op03_ctw.score(rows, depth=depth, block_docs=4).collect()}
        for i, t in texts:
            assert got[i].score == pytest.approx(ctw_by_definition(train, normal(t), depth), rel=1e-4)
            assert got[i].held_out == held(i)


def test_context_tree_chances_sum_to_one():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 4, 300) << 24 | rng.integers(97, 99, 300) << 16 | rng.integers(97, 99, 300) << 8)
    keys = np.sort(np.concatenate([keys + b for b in range(256)]))
    counts = np.where(rng.random(len(keys)) < .02, rng.integers(1, 9, len(keys)), 0)
    _, chances = op03_ctw.deep(keys, counts, 3, 2)
    total = np.prod(chances, axis=0).reshape(-1, 256).sum(axis=1)
    assert np.allclose(total, 1)


def test_base_scores(docs):
    texts = [(r.doc_id, plain.lower_words(r.text) + [None]) for r in docs.collect()]
    counts = Counter(w for i, t in texts if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in op03_ctw.score(docs).collect()}
    for i, t in texts:
        assert got[i].n_tokens == len(t) and got[i].n_known == sum(counts[w] > 0 for w in t) and got[i].train_tokens == n
        assert got[i].base_score == pytest.approx(sum(log10((counts[w] + .1) / (n + .1 * (v + 1))) for w in t), rel=1e-9)


@pytest.mark.parametrize("depth", [2, 5, 7])
def test_grams_by_definition(depth):
    bodies = [b"the cat", "z\u00e9 \U0001f600".encode(), b"", b"a"]
    raw, start, stop = op03_ctw.stream(bodies, depth)
    want = []
    for body in bodies:
        text = b"\n" * depth + body + b"\n"
        want += [int.from_bytes(text[i - depth:i][::-1] + text[i:i + 1], "big") for i in range(depth, len(text))]
    assert [k % 2 ** 64 for k in op03_ctw.grams(raw, start, stop, depth).tolist()] == want
    assert len(op03_ctw.grams(*op03_ctw.stream([], depth), depth)) == 0


@pytest.mark.parametrize("size,kinds", [(0, 1), (1, 1), (5_000, 40), (5_000, 2 ** 62)])
def test_counts_and_look_ups_of_a_block(size, kinds):
    rng = np.random.default_rng(size)
    keys, train = rng.integers(-kinds, kinds, size), rng.random(size) < .7
    want = dict.fromkeys(keys.tolist(), 0)
    for k, t in zip(keys.tolist(), train.tolist(), strict=True):
        want[k] += t
    distinct, counts = op03_ctw.tallied(keys, train)
    assert distinct.tolist() == sorted(want) and counts.tolist() == [want[k] for k in sorted(want)]
    # A block whose rows lie in two tasks has its keys twice.
    table = op03_ctw.Lookup(np.tile(distinct, 2), np.tile(counts.astype(float), 2))
    assert table.of(keys).tolist() == [want[k] for k in keys.tolist()]
    if size:
        with pytest.raises(KeyError):
            table.of(np.array([distinct[0], 2 ** 63 - 1]))


def test_context_trees_beat_the_base_on_held_out(spark):
    got = op03_ctw.score(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum()


def test_context_trees_of_awkward_rows(odd, none):
    got = op03_ctw.score(odd, block_docs=3)
    assert got.count() == odd.count()
    assert all(r.n_tokens == 1 and r.score < 0 for r in got.where("doc_id in (3, 4, 5)").collect())
    assert op03_ctw.score(none).count() == 0


def test_counts_of_a_block_leave_before_the_next_is_read():
    taken = []

    def batches():
        for n in range(6):      # blocks 0 0, 0 0, 0 1, 1 1, 1 1, 1 2
            taken.append(n)
            yield pa.RecordBatch.from_pydict({"block": [n // 3, (n + 1) // 3], "held_out": [False, n == 1],
                                              "text": ["the cat sat", f"the {'dog' if n % 2 else 'cat'} ran"]})
    got, read = {}, {}
    for batch in op03_ctw._tally(3)(batches()):
        for r in batch.to_pylist():
            assert (key := (r["block"], r["kind"], r["key"])) not in got
            got[key] = r["n"]
            read.setdefault(r["block"], len(taken))
    assert read == {0: 3, 1: 6, 2: 6}
    end = op03_ctw._END_WORD
    assert [got[b, 1, end] for b in range(3)] == [4, 6, 1]


@pytest.mark.parametrize("kinds", [50, 2 ** 62])
def test_parts_of_a_block_are_joined_in_little_room(kinds):
    rng = np.random.default_rng(kinds % 7)
    parts, want = [], Counter()
    for _ in range(60):
        keys, n = np.unique(rng.integers(-kinds, kinds, 5_000), return_counts=True)
        want.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
        op03_ctw.added(parts, (keys, n))
        assert sum(len(k) for k, _ in parts) < 2 * len(parts[0][0])
    op03_ctw.added(parts)
    [(keys, n)] = parts
    assert keys.tolist() == sorted(want) and n.tolist() == [want[k] for k in keys.tolist()]


def test_texts_reach_the_context_trees_some_at_a_time(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit, before = 100_000, spark.conf.get(key, None)
    monkeypatch.setattr(op03_ctw, "BATCH_BYTES", limit)

    def watched(make):
        def made(*args):
            run = make(*args)

            def checked(batches):
                def small():
                    for batch in batches:
                        if batch.nbytes > 2 * limit:
                            raise ValueError(f"{batch.nbytes} bytes at once")
                        yield batch
                return run(small())
            return checked
        return made
    for name in ("_tally", "_scorer"):
        monkeypatch.setattr(op03_ctw, name, watched(getattr(op03_ctw, name)))
    docs = spark.range(60).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 3000) as text").coalesce(1)
    got = {r.doc_id: r.n_tokens for r in op03_ctw.score(docs).collect()}
    assert got == dict.fromkeys(range(60), 3001)
    assert spark.conf.get(key, None) == before


# --- exact deduplication ---

def exact(rows):
    out = []
    for doc_id, text, *_ in rows:
        same = [r[0] for r in rows if (r[1] or "") == (text or "")]
        keep = max((i for i in same if i is not None), default=None)
        out.append((doc_id, keep, len(same), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("files", [None, 1])
def test_exact_copies(odd, none, files):
    got = op06_exact.dedup_report(odd, batch_files=files)
    assert rows_of(got.drop("kept")) == exact(plain.awkward())
    assert got.where("kept").count() == len({r[1] or "" for r in plain.awkward()})
    assert all(r.doc_id == r.keep_id for r in got.where("kept").collect())
    stay = op06_exact.dedup(odd, batch_files=files)
    assert stay.columns == odd.columns and stay.count() == got.where("kept").count()
    assert op06_exact.dedup_report(none).count() == 0 and op06_exact.dedup(none).count() == 0


def test_state_outlives_many_batches(spark, docs):
    got = op06_exact.dedup_report(docs.repartition(6), batch_files=1)
    assert rows_of(got.drop("kept")) == exact([(r.doc_id, r.text) for r in docs.collect()])


def test_equal_digests_of_different_texts_are_told_apart(spark, monkeypatch):
    rows = [(1, "aa"), (2, "ab"), (3, "ab"), (4, "b"), (5, "aa")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F
    monkeypatch.setattr(op06_exact.F, "sha2", lambda text, bits: F.hex(F.substring(text, 1, 1)))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in op06_exact.dedup_report(frame).collect()}
    assert got == {1: (5, 2, False), 5: (5, 2, True), 2: (3, 2, False), 3: (3, 2, True), 4: (4, 1, True)}


# --- quality ---

def test_quality_keeps_the_good(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    kept = {r.doc_id for r in op07_quality.resample(docs, labels).collect()}
    good = [r.doc_id in kept for r in labels.where("quality = 1").collect()]
    bad = [r.doc_id in kept for r in labels.where("quality = 0").collect()]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_quality_of_awkward_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (7, 0, 0), (99, 1, 1), (2, None, None)],
                                   "doc_id long, quality int, toxic int")
    got = op07_quality.resample(odd, labels, keep_share=0.5)
    assert odd.count() // 2 <= got.count() <= odd.count() // 2 + 1
    assert op07_quality.accept(odd, labels, keep_share=1.0).count() == odd.count()
    assert op07_quality.accept(odd, labels).columns == odd.columns
    assert op07_quality.accept(odd, labels.limit(0)).count() == odd.count()
    assert op07_quality.resample(none, labels).count() == 0 and op07_quality.accept(none, labels).count() == 0


def test_quality_stage_has_no_quota(spark):
    """Whatever share of the rows is bad, the clean ones stay and the labelled-bad ones go."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    good, bad = (docs.join(labels.where(f"quality = {q}"), "doc_id", "left_semi") for q in (1, 0))
    more = bad
    for i in range(1, 12):
        more = more.unionByName(bad.withColumn("doc_id", F.col("doc_id") + 1_000_000 * i).withColumn("text", F.concat("text", F.lit(f" x{i}"))))
    for clean, junk in ((good, bad.limit(3)), (good, more)):
        kept = {r.doc_id for r in op07_quality.accept(clean.unionByName(junk), labels).collect()}
        ids = {r.doc_id for r in clean.collect()}
        assert len(kept & ids) >= 0.99 * len(ids) and len(kept - ids) <= 0.01 * junk.count()
    assert op07_quality.accept(good, labels).count() == good.count()


@pytest.mark.parametrize("most", [100_000, 0])
def test_quality_counts_a_text_once(spark, monkeypatch, most):
    """Copies of a clean text change no weight, whichever way the copies are found."""
    monkeypatch.setattr(op07_quality, "BROADCAST_ROWS", most)
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents").dropDuplicates(["text"]), table(spark, sf, "labels")
    good = labels.where("quality = 1")
    clean = docs.join(labels, "doc_id", "left_anti").join(op07_quality.resample(docs, labels).select("doc_id"), "doc_id").orderBy("doc_id").limit(1)
    copies = clean.crossJoin(spark.range(150)).withColumn("doc_id", F.col("id") + 1_000_000).drop("id")
    plain_weights, weights = (
        {r.doc_id: round(r.log_weight, 6) for r in op07_quality.resample(d, labels, keep_share=1.0).collect()}
        for d in (docs, docs.unionByName(copies)))
    assert {d: w for d, w in weights.items() if d < 1_000_000} == plain_weights
    assert {w for d, w in weights.items() if d >= 1_000_000} == {plain_weights[clean.first().doc_id]}
    first = good.join(docs, "doc_id").orderBy("doc_id").select(*docs.columns).limit(1)
    twice = docs.unionByName(first.withColumn("doc_id", F.lit(1_000_000).cast("long")))
    both = labels.unionByName(labels.limit(1).withColumn("doc_id", F.lit(1_000_000).cast("long")).withColumn("quality", F.lit(1).cast(labels.schema["quality"].dataType)))
    again = {r.doc_id: round(r.log_weight, 6) for r in op07_quality.resample(twice, both, keep_share=1.0).collect()}
    assert {d: w for d, w in again.items() if d < 1_000_000} == plain_weights


def test_quality_threshold_by_hand():
    mean = np.array([-2.0, -1.0, 0.0, 0.5])
    assert op07_quality.best_cut(mean, np.array([0, 0, 3, 2]), np.array([4, 1, 0, 0])) == -0.5
    assert op07_quality.best_cut(mean, np.array([1, 0, 3, 2]), np.array([0, 0, 0, 0])) == float("-inf")
    assert op07_quality.best_cut(mean, np.array([5, 0, 0, 0]), np.array([0, 0, 0, 2])) == float("-inf")


@pytest.mark.parametrize("k", [1, 7, 500, 999, 1000])
def test_kth_largest(spark, k):
    keys = spark.range(1000).selectExpr("cast(id * 7919 % 1000 div 3 AS double) * 1.5 - 20 AS key")
    want = sorted((r.key for r in keys.collect()), reverse=True)[k - 1]
    assert op07_quality.kth_largest(keys, k, few=10) == want


def test_gumbel_keys_sample_in_proportion(spark):
    ratio = op07_quality.features(np.frombuffer(b"a a a b", np.uint8), np.array([0, 7]), 1 << 14)[0]
    assert len(ratio) == 7 and ratio[1] == ratio[2]   # a repeat is a mark of its own


# --- near copies ---

def test_near_copies_against_brute_force(docs):
    texts = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    for k, num, den in ((4, 85, 100), (5, 4, 5), (2, 1, 2)):
        sets = [plain.shingles(t, k) for _, t in texts]
        want = {texts[i][0]: (len(sets[i]), texts[g][0]) for i, g in enumerate(plain.groups(sets, num, den))}
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in op08_jaccard.near_report(docs, k, num, den).collect()}
        assert got == want


def links_of(sets: list[frozenset], num: int, den: int) -> list[int]:
    return [sum(den * len(s & o) >= num * len(s | o) for j, o in enumerate(sets) if j != i and s and o) for i, s in enumerate(sets)]


@pytest.mark.parametrize("part,shingles,tile,small,held,fetch", [
    (5, 10 ** 6, 3, 4, 10 ** 6, 10 ** 6), (4096, 150, 512, 2, 1, 0), (7, 500, 2, 48, 300, 10 ** 6)])
def test_large_buckets_and_prefix_groups(spark, monkeypatch, part, shingles, tile, small, held, fetch):
    for name, value in (("PART_ROWS", part), ("PART_SHINGLES", shingles), ("TILE_ROWS", tile), ("SMALL_ROWS", small),
                        ("HELD_SHINGLES", held), ("FETCH_ROWS", fetch)):
        monkeypatch.setattr(op08_jaccard, name, value)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in rng.integers(0, 60, rng.integers(0, 5)):
            w[j] = f"v{rng.integers(0, 6)}"
        rows.append((i, " ".join(w)))
    sets = [plain.shingles(t, 4) for _, t in rows]
    got = {r.doc_id: (r.component_id, r.n_links) for r in op08_jaccard.near_report(
        spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == dict(enumerate(zip(plain.groups(sets, 85, 100), links_of(sets, 85, 100), strict=True)))


def test_output_is_linear_in_a_group(spark):
    """Rows that the verifying tasks give: bounded by members and buckets, whatever the number of pairs."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(200)]
    made = {}
    for m in (100, 200, 400):
        rows = [(i, " ".join(f"z{i}" if k == int(rng.integers(0, 200)) else w for k, w in enumerate(base))) for i in range(m)]
        stored, keep = {}, op08_jaccard.stash

        def count(df, name="stash", stored=stored, keep=keep):
            out = keep(df, name)
            stored[name] = max(stored.get(name, 0), out.count())
            return out
        op08_jaccard.stash = count
        try:
            got = op08_jaccard.near_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        finally:
            op08_jaccard.stash = keep
        sets = [plain.shingles(t, 4) for _, t in rows]
        assert [r.n_links for r in sorted(got, key=lambda r: r.doc_id)] == links_of(sets, 85, 100)
        made[m] = stored["links"]
    assert made[400] < 6 * made[100]


def test_shared_values_of_lists():
    rng = np.random.default_rng(6)
    lists = [np.unique(rng.integers(0, 90, rng.integers(0, 60)).astype(np.uint64)) for _ in range(60)]
    made = op08_jaccard.Lists(np.concatenate(lists), np.array([len(x) for x in lists]))
    i, j = np.repeat(np.arange(60), 60), np.tile(np.arange(60), 60)
    want = [len(np.intersect1d(lists[a], lists[b])) for a, b in zip(i, j, strict=True)]
    assert made.shared(i, j).tolist() == want and made._single(i, j).tolist() == want
    assert made._table(np.arange(60), np.arange(60)).reshape(-1).tolist() == want
    assert op08_jaccard.Lists(np.zeros(0, np.uint64), np.zeros(3, np.int64)).shared(np.array([0]), np.array([2])).tolist() == [0]


def test_links_inside_components_are_counted(spark, docs):
    base = [f"w{i}" for i in range(100)]
    made = [(i, " ".join([*base, *(f"x{i}y{j}" for j in range(i))])) for i in (0, 1, 2, 3, 18)]
    rows = made + [(30, made[1][1]), (31, made[1][1]), (40, "alone here"), (41, None), (42, ""), (43, "")]
    for frame, num in ((spark.createDataFrame(rows, "doc_id long, text string"), 85), (docs, 50)):
        texts = [(r.doc_id, r.text) for r in frame.collect()]
        sets = [plain.shingles(t, 4) for _, t in texts]
        want = {d: sum(100 * len(s & o) >= num * len(s | o) for j, o in enumerate(sets) if j != i and s and o)
                for i, ((d, _), s) in enumerate(zip(texts, sets, strict=True))}
        got = {r.doc_id: r.n_links for r in op08_jaccard.near_report(frame, 4, num, 100).collect()}
        assert got == want and max(want.values()) > 1


def test_near_copies_of_awkward_rows(odd, none):
    rows = plain.awkward()
    got = op08_jaccard.near_report(odd)
    assert sorted(r.n_shingles for r in got.collect()) == sorted(len(plain.shingles(r[1], 4)) for r in rows)
    by_id = {r.doc_id: r.component_id for r in got.collect()}
    assert by_id[7] == 6 and by_id[9] == 6 and by_id[None] == 6 and by_id[13] == 12 and by_id[20] == 2
    assert by_id[3] == 3 and by_id[4] == 4 and by_id[5] == 5
    kept = op08_jaccard.keep_one(odd)
    assert kept.columns == odd.columns and not {7, 9, 13, 20} & {r.doc_id for r in kept.collect()}
    assert sum(r.doc_id == 1 for r in kept.collect()) == 1
    assert op08_jaccard.near_report(none).count() == 0 and op08_jaccard.keep_one(none).count() == 0


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for n in (3, 200, 3000):
        a = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[n // 10:], rng.integers(0, 2 ** 63, n // 8, dtype=np.uint64))))
        width = min(len(op08_jaccard.sketch(a)), len(op08_jaccard.sketch(b))) // 8
        x, y = (op08_jaccard._fold([op08_jaccard.sketch(s)], width)[0] for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("n", [1, 2, 40])
def test_components_of_chains_and_stars(spark, n):
    chain = [(i, i + 1) for i in range(n)] + [(100 + n, 100 + i) for i in range(n)]
    got = {r.id: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100 + i: 100 for i in range(n + 1)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
