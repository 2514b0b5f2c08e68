"""Token ids in Simple-8b files.

A 64-bit word holds a 4-bit selector and 60 bits of ids, all of one width: as many as the
widest of them allows.  An id of more than 60 bits leaves an escape, a word of one item
that points into a list of whole ids beside the words.  Every 1024 ids a new block starts
on a word; the word numbers of the blocks are kept, so blocks are packed and unpacked side
by side with NumPy.

Files are Parquet tables of runs of documents: ``part``, ``first`` (ids before the run in
its part), ``doc_ids``, ``n_ids`` per document, ``blocks`` (word number of each block),
``words`` and ``escapes``.  Parts follow one another in the order of doc_id; a part's
base is the sum of the parts before it.

Cases: null texts are empty and have the end id alone; rows that repeat an id follow one
another by hash and text; a null id comes first; no rows give an empty file.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bring, buffers, folded, ragged, shared_path, slices, stash, whole, word_bounds
from .segments import by_text, encode_pieces, four_bytes, per_worker, views

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
BLOCK_IDS = 1024
#: Bytes of text that one row of a file holds.
RUN_BYTES = 700_000
#: Distinct words whose ids a Python worker keeps, about 200 MB.
WORDS_KEPT = 1_000_000
#: Items and bits of a word by selector 1 to 14; selector 15 marks an escape.
WIDTHS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20),
          (2, 30), (1, 60))
ESCAPE = 15
#: Words of letters up to U+00FF: each gives at least one token, so as many ends as words tell where each word ends.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
_COUNTS = np.array([0, *[n for n, _ in WIDTHS], 1], np.int64)
_BITS = np.array([v.bit_length() for v in range(1 << 16)], np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id takes, up to 64."""
    out = _BITS[(ids & np.uint64(0xFFFF)).astype(np.int64)]
    for shift in (16, 32, 48):
        wide = np.flatnonzero(ids >> np.uint64(shift))
        if not len(wide):
            break
        out[wide] = np.maximum(out[wide], _BITS[((ids[wide] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)] + np.uint8(shift)
                               * ((ids[wide] >> np.uint64(shift)) & np.uint64(0xFFFF) > 0))
    return out


def _selectors(widths: np.ndarray, block: int) -> np.ndarray:
    """Of each place the selector of the word that would start there, by the widest of the next 2, 3, … ids of its block."""
    n = len(widths)
    side = np.full((-(-n // block), block + WIDTHS[0][0]), 255, np.uint8)
    full = n // block
    side[:full, :block] = widths[:full * block].reshape(full, block)
    if n % block:
        side[full, :n % block] = widths[full * block:]
    doubled = {1: side}

    def widest(count: int) -> np.ndarray:
        """Maximum over ``count`` ids from each place on; 255 where the block ends before."""
        power = 1 << (count.bit_length() - 1)
        while max(doubled) < power:
            k = max(doubled)
            doubled[2 * k] = np.maximum(doubled[k], np.pad(doubled[k][:, k:], ((0, 0), (0, k)), constant_values=255))
        base, k = doubled[power], count - power
        return np.maximum(base[:, :block], base[:, k:block + k])
    out = np.full((len(side), block), ESCAPE, np.uint8)
    for s in range(len(WIDTHS), 0, -1):              # wide to narrow: the last that fits holds most
        count, bits = WIDTHS[s - 1]
        out[widest(count) <= bits] = s
    return out.reshape(-1)[:n]


def pack(ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, word number of each block, and escaped ids."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
    widths = _widths(ids)
    escaped = widths > 60
    escapes, values = ids[escaped], ids
    if len(escapes):
        values = ids.copy()
        values[escaped] = np.arange(len(escapes), dtype=np.uint64)
    selector = _selectors(widths, block)
    jump = _COUNTS[selector]
    at = np.arange(0, n, block)
    end = np.minimum(at + block, n)
    begins = np.zeros(n, bool)
    while len(at):                                   # one word of every block at a time
        begins[at] = True
        at = at + jump[at]
        live = at < end
        at, end = at[live], end[live]
    starts = np.flatnonzero(begins)
    kind = selector[starts]
    words = kind.astype(np.uint64) << np.uint64(60)
    for s in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == s)
        count, bits = (1, 60) if s == ESCAPE else WIDTHS[s - 1]
        first, word = starts[rows], words[rows]
        for i in range(count):
            word |= values[first + i] << np.uint64(i * bits)
        words[rows] = word
    return words, np.searchsorted(starts, np.arange(0, n, block)).astype(np.int32), escapes


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    kind = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[kind]
    begin = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(kind):
        rows = np.flatnonzero(kind == s)
        if s == ESCAPE:
            out[begin[rows]] = escapes[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        count, bits = WIDTHS[s - 1]
        mask = np.uint64((1 << bits) - 1)
        for i in range(count):
            out[begin[rows] + i] = (words[rows] >> np.uint64(i * bits)) & mask
    return out


def unpack_blocks(words: np.ndarray, blocks: np.ndarray, escapes: np.ndarray, wanted: list[int]) -> list[np.ndarray]:
    """The ids of some blocks alone, found by their word numbers."""
    ends = np.append(blocks[1:], len(words))
    return [unpack(words[blocks[b]:ends[b]], escapes) for b in wanted]


class Words:
    """A tokenizer that never joins across white space, made once in each Python worker from a file that Spark ships."""

    def __init__(self, spark: SparkSession, path: str = TOKENIZER):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.digest = hashlib.sha256(text.encode()).hexdigest()
        self.text = spark.sparkContext.broadcast(text)

    def ready(self):
        def make():
            from tokenizers import Tokenizer
            made = Tokenizer.from_str(self.text.value)
            ends = np.zeros(max(made.get_vocab().values()) + 1, bool)
            ends[[i for t, i in made.get_vocab().items() if t.endswith("</w>")]] = True
            return made, ends, [t.content.encode() for t in made.get_added_tokens_decoder().values()]
        return per_worker(("words", self.digest), make)

    def encode_batch(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (tokenizer, ends, special), memory = self.ready()

        def each(texts: list[bytes]) -> list[list[int]]:
            return [e.ids for e in tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

        def encode(texts: list[bytes]) -> list[bytes]:
            """Words of letters in one go, told apart by the marks of word ends; others on their own."""
            plain = [i for i, t in enumerate(texts) if t.isalpha() or _LETTERS(t)]
            out: list = [None] * len(texts)
            if plain:
                ids = np.array(each([b" ".join([texts[i] for i in plain])])[0], np.uint32)
                cut = np.flatnonzero(ends[ids]) + 1
                if len(cut) == len(plain) and cut[-1] == len(ids):
                    data, cut = ids.tobytes(), [0, *(4 * cut).tolist()]
                    for i, a, b in zip(plain, cut[:-1], cut[1:], strict=True):
                        out[i] = data[a:b]
            rest = [i for i, ids in enumerate(out) if ids is None]
            for i, ids in zip(rest, each([texts[i] for i in rest]), strict=True):
                out[i] = four_bytes(ids)
            return out
        starts, stops, per_text = word_bounds(raw, offsets)
        low = folded(raw).tobytes()
        # The tokenizer lowers all letters and cuts between letters and signs; so do we, for fewer distinct pieces.
        # Not where a dot above could make the capital dotted I, whose small letter is two characters.
        if not any(mark in low for mark in (*[m.lower() for m in special], "\u0307".encode())):
            raw = folded(raw)
            letter = (raw >= 97) & (raw <= 122)
            sign = (raw > 32) & (raw < 127) & ~letter & ~((raw >= 48) & (raw <= 57))
            border = np.flatnonzero((letter[:-1] & sign[1:]) | (sign[:-1] & (raw[:-1] != 39) & letter[1:])) + 1
            border = border[np.searchsorted(offsets, border, side="left") == np.searchsorted(offsets, border, side="right")]
            starts, stops = np.sort(np.concatenate((starts, border))), np.sort(np.concatenate((stops, border)))
            per_text = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
        ids, counts = encode_pieces(raw, starts, stops, encode, memory, WORDS_KEPT)
        return ids, by_text(counts, per_text)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The end id after the ids of each text."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    begin = np.cumsum(counts + 1) - (counts + 1)
    out[ragged(begin, counts)] = ids
    return out, counts + 1


FILE_SCHEMA = ("part int, first long, doc_ids array<long>, n_ids array<int>, blocks array<int>, words binary, "
               "escapes binary")


def write_ids(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Encode all texts in ascending doc_id order and write the files to ``path``."""
    words_of = Words(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), 0
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            for a, b in slices(offsets, RUN_BYTES):
                ids, counts = with_end(*words_of.encode_batch(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]), end_id)
                words, blocks, escapes = pack(ids)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int32()), "first": [first],
                    "doc_ids": pa.array([batch.column("doc_id").slice(a, b - a).to_pylist()], pa.list_(pa.int64())),
                    "n_ids": pa.array([counts.tolist()], pa.list_(pa.int32())),
                    "blocks": pa.array([blocks.tolist()], pa.list_(pa.int32())),
                    "words": [words.tobytes()], "escapes": [escapes.tobytes()]})
                first += len(ids)
    mark = F.xxhash64("text")
    ordered = (docs.select(F.col("doc_id").cast("long"), whole("text").alias("text")).withColumn("_mark", mark)
               .repartitionByRange("doc_id", "_mark").sortWithinPartitions("doc_id", "_mark", "text").select("doc_id", "text"))
    ordered.mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sums = files.groupBy("part").agg(F.sum(F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # a row a part
    bases = stash(sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stream = unpack(np.frombuffer(row["words"], np.uint64), np.frombuffer(row["escapes"], np.uint64))
                stream = stream.astype("<u4") if (stream >> np.uint64(32) == 0).all() else stream
                counts = np.array(row["n_ids"], np.int64)
                own = list(views(stream, counts))
                out = {"doc_id": pa.array(row["doc_ids"], pa.int64()),
                       "start": row["base"] + row["first"] + np.cumsum(counts) - counts, "n_tokens": counts,
                       "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())}
                if ids:
                    out["ids"] = pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    return bring(files, bases, ["part"]).mapInArrow(run, schema)


def ids_report(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write the files to the shared folder and read every document back: doc_id, start, n_tokens, ids_crc32."""
    path = shared_path(docs.sparkSession, "ids")
    write_ids(docs, path, tokenizer)
    return read_ids(docs.sparkSession, path, ids=False)
