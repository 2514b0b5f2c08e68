"""Encoding by distinct pieces: texts are cut where the tokenizer never joins across, each
distinct piece is encoded once by the ``tokenizers`` library, and the ids are laid out by
NumPy.  Both byte-pair encoders use it; the cuts differ.
"""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .common import LONG_BYTES, ragged, same_stretches, stretch_hashes

#: Distinct pieces whose ids a Python worker keeps, half of them in the newer of two generations.
MEMORY = 300_000

class Memory:
    """Ids (four bytes each) of pieces by their bytes, in two generations: what is used again moves to the newer one, the older is dropped."""

    def __init__(self):
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def get(self, pieces: list[bytes], most: int) -> list[bytes | None]:
        if 2 * len(self.new) > most:
            self.old, self.new = self.new, {}
        found = list(map(self.new.get, pieces))
        if self.old:
            for i in [i for i, ids in enumerate(found) if ids is None]:
                ids = self.old.get(pieces[i])
                if ids is not None:
                    found[i] = self.new[pieces[i]] = ids
        return found


def per_worker(key: tuple, make: Callable[[], object]) -> tuple[object, Memory]:
    """A tokenizer and its memory of pieces, made once in each Python worker.

    Helpers come anew with every task, their globals too; what is to outlive a task is kept in the process.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    home = sys.modules.setdefault("voxloom_worker", types.ModuleType("voxloom_worker"))
    held = home.__dict__.setdefault("held", {})
    if key not in held:
        held[key] = (make(), Memory())
    return held[key]


def distinct(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct stretch, and the number of each stretch's distinct one.

    Hashes bring equal stretches together; their bytes are then compared, and those of
    other bytes than the first of their hash are told apart by the bytes themselves.
    """
    place = pa.array(stretch_hashes(raw, starts, stops)).dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.flatnonzero(place > np.concatenate(([-1], np.maximum.accumulate(place)[:-1])))
    odd = np.flatnonzero(~same_stretches(raw, starts, stops, starts[first[place]], stops[first[place]]))
    if len(odd):
        own: dict[bytes, int] = {}
        extra = []
        for i in odd.tolist():
            piece = raw[starts[i]:stops[i]].tobytes()
            if piece not in own:
                own[piece] = len(first) + len(extra)
                extra.append(i)
            place[i] = own[piece]
        first = np.concatenate((first, extra))
    return first, place


def four_bytes(ids: list[int]) -> bytes:
    return np.array(ids, np.uint32).tobytes()


def encode_pieces(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, encode: Callable[[list[bytes]], list[bytes]],
                  memory: Memory, most: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after another, and the number of ids of each piece; ``encode`` gives four bytes an id."""
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    first, place = distinct(raw, starts, stops)
    data = raw.tobytes()
    found = [data[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
    known = memory.get(found, most)
    new = [i for i, ids in enumerate(known) if ids is None]
    for a in range(0, len(new), 8192):
        part = new[a:a + 8192]
        for i, ids in zip(part, encode([found[i] for i in part]), strict=True):
            known[i] = ids
            if len(found[i]) <= LONG_BYTES:
                memory.new[found[i]] = ids
    sizes = np.fromiter(map(len, known), np.int64, len(known)) >> 2
    flat = np.frombuffer(b"".join(known), np.uint32)
    begin = np.cumsum(sizes) - sizes
    counts = sizes[place]
    return flat[ragged(begin[place], counts)], counts


def by_text(counts: np.ndarray, pieces_of: np.ndarray) -> np.ndarray:
    """Ids of each text, from the ids of each piece and the pieces of each text."""
    total = np.concatenate(([0], np.cumsum(counts)))
    ends = np.cumsum(pieces_of)
    return total[ends] - total[ends - pieces_of]


def views(ids: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    for n in lengths.tolist():
        yield ids[at:at + n]
        at += n
