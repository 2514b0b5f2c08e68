"""Token ids, byte pairs, vectors and urls against the libraries and brute force."""

import base64
import hashlib
import zlib

import numpy as np
import plain
import public_tokenizers
import pytest
from compare import differences, sql_frame

from voxloom.llm import op04_ids, op05_topk, op09_urls, op10_bpe, queries, sql
from voxloom.llm.common import shared_path, table


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(plain.awkward(), plain.DOCS)


# --- Simple-8b ---

@pytest.mark.parametrize("top", [1, 2, 5, 16, 31, 50, 60, 63])
@pytest.mark.parametrize("n", [0, 1, 7, 1024, 1025, 5000])
def test_words_round_trip(n, top):
    rng = np.random.default_rng(n + top)
    ids = rng.integers(0, 2 ** top, n, dtype=np.uint64) >> rng.integers(0, top, n, dtype=np.uint64)
    words, blocks, escapes = op04_ids.pack(ids)
    assert (op04_ids.unpack(words, escapes) == ids).all()
    if n:
        last = (n - 1) // op04_ids.BLOCK_IDS
        assert (op04_ids.unpack_blocks(words, blocks, escapes, [last])[0] == ids[last * op04_ids.BLOCK_IDS:]).all()


def test_words_are_dense():
    assert len(op04_ids.pack(np.zeros(60, np.uint64))[0]) == 1
    assert len(op04_ids.pack(np.full(1020, 3000, np.uint64))[0]) == 204


def library_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_id_files(spark, odd):
    path = shared_path(spark, "ids-test")
    op04_ids.write_ids(odd, path)
    got = op04_ids.read_ids(spark, path).orderBy("start").collect()
    rows = plain.awkward()
    want = {}
    for r, ids in zip(rows, library_ids([r[1] for r in rows]), strict=True):
        want.setdefault(r[0], []).append(ids)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids in want[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    empty = op04_ids.ids_report(odd.limit(0))
    assert empty.count() == 0


def test_id_report(spark, small):
    docs = table(spark, small, "documents")
    rows = docs.orderBy("doc_id").collect()
    ids = library_ids([r.text for r in rows])
    got = op04_ids.ids_report(docs).orderBy("doc_id").toPandas()
    sizes = np.array([len(i) for i in ids])
    assert (got.n_tokens == sizes).all() and (got.start == np.cumsum(sizes) - sizes).all()
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids]


# --- byte pairs ---

@pytest.fixture(scope="module")
def peer():
    import tiktoken
    with open(op10_bpe.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


SPACES = ["a  b", " a", "a ", "  a  ", "a\n\nb", "a \n b", "a\n b", "\n", " \n ", "a\t\tb", "'s 's", "x's  's", " 's", "1 2", "a  1", "!  !",
          "a\u00a0b", "a \u00a0b", "a\u00a0 b", "a  \u00a0  b", "\u3000a", "a\x85b", "a \x1c b", "a\ufeff b", "naïve café 😀 \u200d", "\u0301 a",
          "don't  DON'T", "a\r\nb\r\n\r\nc", "   ", "\x00a\x00 b", "汉字 漢字  仮名", "a" * 500 + "  " + "b" * 500]


def test_byte_pairs_as_the_library(spark, odd, peer):
    rows = plain.awkward() + [(100 + i, t, *["x"] * 2, 1, "e", 1, 1.0) for i, t in enumerate(SPACES)]
    frame = spark.createDataFrame(rows, plain.DOCS)
    want = sorted((str(r[0]), ids) for r, ids in ((r, peer.encode_ordinary(r[1] or "")) for r in rows))
    coded = op10_bpe.encode(frame)
    got = coded.collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    for r in got:
        data, ends = (r.text or "").encode(), [*r.offsets[1:], len((r.text or "").encode())]
        assert [data[a:b] for a, b in zip(r.offsets, ends)] == [peer.decode_single_token_bytes(i) for i in r.ids]
    back = op10_bpe.decode(coded)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r[0]), r[1] or "") for r in rows)
    report = {(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op10_bpe.bpe_report(frame).collect()}
    assert report == {(str(r[0]), len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(),
                       hashlib.sha256((r[1] or "").encode()).hexdigest())
                      for r, i in ((r, peer.encode_ordinary(r[1] or "")) for r in rows)}
    assert op10_bpe.bpe_report(odd.limit(0)).count() == 0 and op10_bpe.encode(odd.limit(0)).count() == 0


def test_characters_cut_between_tokens(spark, peer):
    text = "𓀀𓀁 ꙮ 😀"
    ids = op10_bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    row = ids.first()
    assert any(b"\xef\xbf\xbd" in peer.decode_single_token_bytes(i).decode("utf-8", "replace").encode() for i in row.ids)
    assert op10_bpe.decode(ids).first().text == text


def test_byte_table_is_one_to_one():
    assert len(set(op10_bpe.byte_table())) == 256 and op10_bpe.byte_table()[ord("a")] == "a"


# --- vectors ---

def by_hand(rows, every, k):
    def sound(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)
    kept = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows if sound(v)]
    out = []
    for a, (q, x) in enumerate(kept):
        if q is None or q % every:
            continue
        scored = [(-sum(p * r for p, r in zip(x, y)), c is None, c or 0, c) for b, (c, y) in enumerate(kept) if a != b]
        out += [(q, n + 1, c, -s) for n, (s, _, _, c) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def test_top_products_of_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf"), 1.0]), (204, []), (205, [0.5]),
             (None, [1.0] * 6), (50, rows[50][1]), (50, [2.0] * 6), (300, [9.0] * 6), (301, [9.0] * 6), (302, [9.0] * 6),
             (350, [0.0] * 6), (400, [-1.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for how in ({}, {"block_rows": 16, "group_rows": 3, "head": 2}):
        got = op05_topk.search(frame, **how)
        assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()), key=repr) == by_hand(rows, 50, 5)
    assert op05_topk.search(frame.limit(0)).count() == 0
    assert op05_topk.search(spark.createDataFrame([(50, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")).count() == 1


def test_top_products_of_huge_components(spark):
    rows = [(0, [1e17, 3.0]), (1, [1.0, 2.0]), (2, [2.0, 1e15]), (3, [1e15, 1.0])]
    got = op05_topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).orderBy("rank").collect()
    top = (1 << 63) - 1
    assert [(r.vec_id, r.score) for r in got] == [(1, top), (2, top)]


def test_top_products(spark, small):
    rows = [(r.vec_id, r.embedding) for r in table(spark, small, "embeddings").collect()]
    got = queries.op5_top_products(spark, small)
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(rows, 50, 5)


# --- urls ---

URLS = ["http://a.com", "http://a.com/", "HTTPS://WWW.Example.com/en/x?q#f", "http://example.com/en", "http://example.com/en/",
        "http://xexample.com/en/", "ftp://b.net/es/1", "b.net/es/1", "x://y.net/fr/?/", "://net/es/", "http://net/fr/a#b", None, "",
        "http://user@a.net:80/es/", "http://ÀB.com/é", "http:///en/", "a://b://c.com/", "http://c.com?x://d.net/es/", "http://.com/", "http://com./"]


def by_rule(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host, path = rest[:cut].translate(plain.FOLD), rest[cut:]
    path = path[:min([i for i, c in enumerate(path) if c in "?#"], default=len(path))]
    fit = [(len(h + p), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, 3) for i, u in enumerate(URLS)] + [(0, URLS[0], 1), (None, URLS[2], 2)],
                                  "page_id long, url string, host int")
    rules = [*op09_urls.RULES, ("block", "a.net", "/es"), ("allow", "a.net:80", "/")]
    for used in (op09_urls.RULES, rules, rules + rules):
        got = op09_urls.filter_urls(pages, op09_urls.rule_table(spark, used)).collect()
        assert len(got) == len(URLS) + 2
        for r in got:
            url = URLS[2] if r.page_id is None else URLS[r.page_id]
            assert (r.host, r.path, r.rule, r.verdict) == by_rule(url, used)
    none = op09_urls.filter_urls(pages, op09_urls.rule_table(spark).limit(0))
    assert {r.verdict for r in none.collect()} == {"allow"}
    assert op09_urls.filter_urls(pages.limit(0), op09_urls.rule_table(spark)).count() == 0


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_sql(spark, small, name):
    assert differences(queries.REGISTRY[name](spark, small).toPandas(), sql_frame(small, sql.SQL[name])) == []
