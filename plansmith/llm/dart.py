"""DartMinHash signatures of weighted shingle sets, over batches of texts.

The j-th occurrence of a shingle is a unit region of its own, so a signature compares multisets.  Darts reach a region at
the arrival times of a Poisson process that the region's hash alone decides; each dart has a coordinate.  A text takes the
darts up to a time that gives about k (ln k + 4) of them, whatever its weight, and keeps the earliest for each coordinate;
where a coordinate has none, the text's time is doubled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence

import numpy as np

from .text import U, Words, mix, shingles

SIZE = 160
ROWS = 5


def regions(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each occurrence of each shingle, and its row."""
    h, at = shingles(w.hashes(), w.first, width)
    doc = np.searchsorted(w.first, at, "right") - 1
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    seen = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return mix(h + U(0xD1B54A32D192ED03) * seen.astype(np.uint64)), doc


def thrown(e: np.ndarray, doc: np.ndarray, n: int, until: np.ndarray, k: int, rank: np.ndarray, dart: np.ndarray) -> None:
    """Throw the darts of regions e up to each row's time; rank, dart: the earliest so far of (row, coordinate), flat."""
    time = np.zeros(len(e))
    live = np.arange(len(e))
    turn = 0
    while len(live):
        turn += 1
        own = mix(e[live] + U(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((own >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)
        near = time < until[doc[live]]
        live, time, own = live[near], time[near], mix(own[near] ^ U(0xA0761D6478BD642F))
        place = doc[live] * k + (own % U(k)).astype(np.int64)
        np.minimum.at(rank, place, time)
        first = rank[place] == time
        dart[place[first]] = own[first]


def signatures(w: Words, width: int, k: int = SIZE) -> np.ndarray:
    """Rows of k darts; a row without words has zeros."""
    e, doc = regions(w, width)
    n = w.n_docs
    weight = np.bincount(doc, minlength=n)
    rank, dart = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    until = k * (math.log(k) + 4) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        some = todo[doc]
        thrown(e[some], doc[some], n, until, k, rank, dart)
        todo &= np.isinf(rank.reshape(n, k)).any(axis=1)
        until[todo] *= 2
        again = np.repeat(todo, k)
        rank[again], dart[again] = np.inf, U(0)
    return dart.reshape(n, k)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of `rows` coordinates."""
    n, k = sig.shape
    out = np.empty((n, k // rows), np.uint64)
    for b in range(k // rows):
        h = np.full(n, U((b + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        for j in range(rows):
            h = mix(h ^ sig[:, b * rows + j]) + U(j)
        out[:, b] = mix(h)
    return out


def keys(w: Words, column: Mapping[int, bytes | None] | Sequence[bytes | None]) -> list[bytes]:
    """16 bytes a row that equal word sequences share; rows without words go by their bytes."""
    h = w.hashes()
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(w.first[:-1], w.counts).astype(np.uint64)
    out = np.empty((w.n_docs, 2), np.uint64)
    for k, salt in enumerate((0x2545F4914F6CDD1D, 0x94D049BB133111EB)):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(mix(h + U(salt)) + place * U(0x9E3779B97F4A7C15)), dtype=np.uint64)])
        out[:, k] = mix(run[w.first[1:]] - run[w.first[:-1]] + w.counts.astype(np.uint64) * U(salt))
    got = [x.tobytes() for x in out]
    for d in np.flatnonzero(w.counts == 0):
        got[d] = hashlib.blake2b(column[d] or b"", digest_size=16, person=b"nowords").digest()
    return got
