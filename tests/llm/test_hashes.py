"""Words that differ only in the order of their parts stay apart in every operator that hashes words."""

import base64
import hashlib
import zlib

import numpy as np
import plain
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st

from voxloom.llm import op03_ctw, op04_ids, op08_jaccard, op10_bpe, segments
from voxloom.llm.common import same_stretches, stretch_hashes


def thue(n: int) -> tuple[str, str]:
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


TWINS = [w for n in (1024, 2048, 4096) for w in thue(n)]


@pytest.fixture(scope="module")
def twins(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(TWINS)],
                                 "doc_id int, text string, lang string, source string, n_chars int")


def cut(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(p) for p in parts])
    return np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends


@given(st.lists(st.binary(max_size=80), min_size=1, max_size=40))
def test_equal_bytes_equal_hashes(parts):
    raw, a, b = cut(parts)
    marks = stretch_hashes(raw, a, b).tolist()
    assert len(set(marks)) == len(set(parts)) and len(set(zip(parts, marks, strict=True))) == len(set(parts))
    place = [parts.index(p) for p in parts]
    assert same_stretches(raw, a, b, a[place], b[place]).all()
    back = np.arange(len(parts))[::-1]
    assert same_stretches(raw, a, b, a[back], b[back]).tolist() == [p == q for p, q in zip(parts, parts[::-1], strict=True)]


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(segments, "stretch_hashes", lambda raw, a, b: np.zeros(len(a), np.uint64))
    parts = [b"one", b"two", b"one", b"three", b"two", b""]
    raw, a, b = cut(parts)
    first, place = segments.distinct(raw, a, b)
    assert [parts[first[p]] for p in place] == parts and len(first) == 4


def test_memory_keeps_what_is_used():
    memory = segments.Memory()
    for i in range(50):
        for p, ids in zip((b"kept", b"%d" % i), memory.get([b"kept", b"%d" % i], 6), strict=True):
            assert ids == (b"!!!!" if p == b"kept" and i else None)
            if ids is None:
                memory.new[p] = b"!!!!"
        assert len(memory.new) + len(memory.old) <= 9


def test_words_of_context_trees():
    raw, start, stop = op03_ctw.stream([t.encode() for t in TWINS], 5)
    words, n = op03_ctw.words_of(raw, start, stop)
    assert len(set(words.tolist())) == len(TWINS) + 1 and n.tolist() == [2] * len(TWINS)


def test_ids_of_twins(twins):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [zlib.crc32(np.array([*e.ids, 2], "<u4").tobytes()) for e in t.encode_batch(TWINS, add_special_tokens=False)]
    assert [r.ids_crc32 for r in op04_ids.ids_report(twins).orderBy("doc_id").collect()] == want


def test_byte_pairs_of_twins(twins):
    import tiktoken
    with open(op10_bpe.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in op10_bpe.bpe_report(twins).collect():
        ids = peer.encode_ordinary(TWINS[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(TWINS[r.doc_id].encode()).hexdigest()


def test_own_columns_named_like_results(spark):
    docs = spark.createDataFrame([(1, "a b", "mine", 7)], "doc_id long, text string, ids string, offsets int")
    coded = op10_bpe.encode(docs).first()
    assert (coded.ids_given, coded.offsets_given) == ("mine", 7) and len(coded.ids) == len(coded.offsets) == 2


def test_twins_are_no_near_copies(twins):
    got = op08_jaccard.near_report(twins).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got} == {(i, 1, i, 0) for i in range(len(TWINS))}
    assert plain.groups([plain.shingles(t, 4) for t in TWINS], 85, 100) == list(range(len(TWINS)))
