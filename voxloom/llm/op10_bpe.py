"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

The vocabulary comes as ranks of byte strings.  A byte-level model wants characters, so
each byte stands for one printable character (the byte table below), ranks become a
vocabulary of such strings, and every way to split a token into two others becomes a
merge with the token's rank.  Texts are cut by the split pattern; its matches never
reach across a blank and the next word, so distinct pieces are encoded once
(segments.py).  Texts with white space beyond ASCII, where the pattern is subtler, are
encoded whole.

``encode`` also gives the offsets of the tokens in bytes.  A token may hold part of a
character; ``decode`` therefore reverses the byte table over all tokens of a text before
it reads characters, and ``offsets`` count bytes, not characters.

Cases: null texts are empty and have no ids; strings of special tokens are plain text;
repeated rows stay; no rows give no rows.  Ids outside the vocabulary are an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SPACE, buffers, slices
from .segments import Memory, by_text, encode_pieces, four_bytes, per_worker, views

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: White space beyond ASCII in UTF-8, and control characters that some engines count as blank.
_ODD = [chr(c).encode() for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                                  0x202F, 0x205F, 0x3000, 0xFEFF)]


def byte_table() -> list[str]:
    """The character of each byte: itself if printable, else the next one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_ranks(data: bytes) -> list[bytes]:
    """Byte string of each id."""
    pairs = [line.split() for line in data.splitlines() if line.strip()]
    tokens = {int(rank): base64.b64decode(text) for text, rank in pairs}
    return [tokens[i] for i in range(len(tokens))]


def build(tokens: list[bytes], pattern: str = PATTERN):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers
    chars = byte_table()
    names = ["".join(chars[b] for b in t) for t in tokens]
    vocab = {name: i for i, name in enumerate(names)}
    merges = [(name[:k], name[k:]) for name in names for k in range(1, len(name)) if name[:k] in vocab and name[k:] in vocab]
    made = Tokenizer(models.BPE(vocab=vocab, merges=merges, cache_capacity=0, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts that the pattern never matches across: before the last blank ahead of a word, and around white space.

    A run of white space before a word is matched without its last sign; that sign joins
    the word if it is a space, else stands alone.  A run that ends a text stays whole.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    blank = _SPACE[raw]
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    before = np.concatenate(([False], blank[:-1]))
    after = np.concatenate((blank[1:], [False]))
    ahead = blank & ~after & ~last          # the last sign of a run, with a word behind it
    begins = first | (blank & ~before) | ahead
    begins |= ~blank & before & np.concatenate(([0], raw[:-1])).astype(bool) & np.concatenate(([False], raw[:-1] != 32))
    starts = np.flatnonzero(begins)
    per_text = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return starts, np.append(starts[1:], n), per_text


def encode_batch(raw: np.ndarray, offsets: np.ndarray, tokenizer, memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the number of ids of each."""
    def encode(texts: list[bytes]) -> list[bytes]:
        made = tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [four_bytes(e.ids) for e in made]
    data = raw.tobytes()
    starts, stops, per_text = pieces(raw, offsets)
    if any(mark in data for mark in _ODD):
        odd = np.array([any(m in data[a:b] for m in _ODD) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        keep = np.repeat(~odd, per_text)
        at = np.flatnonzero(odd)
        starts, stops = np.concatenate((starts[keep], offsets[at])), np.concatenate((stops[keep], offsets[at + 1]))
        order = np.argsort(starts, kind="stable")
        starts, stops = starts[order], stops[order]
        per_text = np.where(odd, 1, per_text)
    ids, counts = encode_pieces(raw, starts, stops, encode, memory)
    return ids, by_text(counts, per_text)


class Codec:
    """The tokenizer of a rank file, made once in each Python worker from a file that Spark ships."""

    def __init__(self, spark: SparkSession, ranks: str = RANKS):
        with open(ranks, "rb") as f:
            self.digest = hashlib.sha256(data := f.read()).hexdigest()
        self.data = spark.sparkContext.broadcast(data)

    def ready(self):
        def make():
            tokens = read_ranks(self.data.value)
            lengths = np.array([len(t) for t in tokens])
            return build(tokens), b"".join(tokens), np.cumsum(lengths) - lengths, lengths
        return per_worker(("bpe", self.digest), make)


def encode(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Add ids (array of int) and offsets (first byte of each token) to the columns of ``docs``.

    Columns of these names that ``docs`` has already are kept as ids_given and offsets_given.
    """
    codec = Codec(docs.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tokenizer, _, _, lengths), memory = codec.ready()
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            for a, b in slices(offsets):
                ids, counts = encode_batch(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], tokenizer, memory)
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                width = lengths[ids]
                first = np.cumsum(width) - width
                first = first - np.repeat(offsets[a:b] - offsets[a], counts)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (ids, first)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], [*part.schema.names, "ids", "offsets"])
    plain = docs
    for name in ("ids", "offsets"):
        if name in plain.columns:
            plain = plain.withColumnRenamed(name, f"{name}_given")
    return plain.mapInArrow(run, _ddl(plain) + ", ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Replace text by the text of the ids: token bytes put together, then read as UTF-8, bad bytes as U+FFFD."""
    codec = Codec(encoded.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, flat, begin, lengths), _ = codec.ready()
        for batch in batches:
            texts = [None if ids is None else b"".join([flat[begin[i]:begin[i] + lengths[i]] for i in ids])
                     .decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
    return encoded.mapInArrow(run, _ddl(encoded))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def bpe_report(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256, decoded_sha256, from its ids and from the ids decoded."""
    from .common import ragged
    codec = Codec(docs.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tokenizer, flat, begin, lengths), memory = codec.ready()
        table = np.frombuffer(flat, np.uint8)
        names = [str(i) for i in range(len(lengths))]
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            for a, b in slices(offsets):
                got, counts = encode_batch(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], tokenizer, memory)
                width = lengths[got]
                back = table[ragged(begin[got], width)].tobytes()
                ends = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(counts)))]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(a, b - a), "n_tokens": counts.astype(np.int64),
                    "ids_sha256": [hashlib.sha256(",".join([names[i] for i in x.tolist()]).encode()).hexdigest()
                                   for x in views(got, counts)],
                    "decoded_sha256": [hashlib.sha256(back[p:q]).hexdigest()
                                       for p, q in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]})
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
