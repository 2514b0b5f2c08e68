"""Every stage of the pipeline against brute force on the rows that the stage before kept."""

import base64
import hashlib
from collections import Counter

import plain
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as pipeline
from voxloom.llm import op02_mix, op07_quality, op10_bpe
from voxloom.llm.common import stash, table

KEPT = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, small):
    docs, out = table(spark, small, "documents"), []
    for _, stage in pipeline.STAGES:
        out.append((docs, docs := stash(stage(spark, docs, small), "step")))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_stages_are_named_and_keep_the_columns(steps):
    assert len(pipeline.STAGES) == 5 and all(after.columns == KEPT for _, after in steps[:-1])


def test_quality_stage(spark, small, steps):
    before, after = steps[0]
    labels = table(spark, small, "labels")
    assert ids(after) == ids(op07_quality.resample(before, labels))
    good = {r.doc_id for r in labels.where("quality = 1").collect()} & set(ids(before))
    assert len(good & set(ids(after))) >= 0.95 * len(good) and after.count() < before.count()


def test_exact_stage(steps):
    before, after = steps[1]
    last = {}
    for r in before.collect():
        last[r.text] = max(r.doc_id, last.get(r.text, r.doc_id))
    assert ids(after) == sorted(last.values())


def test_near_stage(steps):
    before, after = steps[2]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    tops = plain.groups([plain.shingles(t, 5) for _, t in rows], 4, 5)
    assert ids(after) == [rows[i][0] for i in sorted(set(tops))]


def test_mix_stage(steps):
    before, after = steps[3]
    copies = {r.doc_id: r.copies if r.size else 1 for r in op02_mix.mix_report(before).collect()}
    assert Counter(ids(after)) == Counter({d: n for d, n in copies.items() if n})


def test_encoding_stage(steps):
    before, after = steps[4]
    with open(op10_bpe.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in before.collect():
        tokens = peer.encode_ordinary(r.text)
        want.append((r.doc_id, len(tokens), hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest(),
                     hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(map(tuple, after.collect())) == sorted(want)


def test_run_gives_the_rows_of_the_last_stage(spark, small, steps):
    assert sorted(map(tuple, pipeline.run(spark, small).collect())) == sorted(map(tuple, steps[-1][1].collect()))
