"""Vectorised views of Arrow text columns: words, hashes and shingles without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
GOLD, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
UPPER = bytes(range(65, 91))
#: A-Z to lower case, the rest as it is.
LOWER = bytes(range(256)).translate(bytes.maketrans(UPPER, UPPER.lower()))
SPACES = frozenset([0x20, *range(0x09, 0x0E)])
#: Lower case; everything but [0-9a-z] and bytes over 0x7F becomes a space.
PLAIN = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 0x20 for b in LOWER)
#: Lower case; ASCII white space becomes a space.
WHITE = bytes(0x20 if b in SPACES else b for b in LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U(30))
    x = x * MIX1
    x ^= x >> U(27)
    x *= MIX2
    x ^= x >> U(31)
    return x


def raw(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n or column.buffers()[2] is None:
        return b"", np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes()
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut between rows into pieces of about `most` bytes of text: working memory follows one piece, or one text if that is longer."""
    text = batch.column(batch.schema.get_field_index(column))
    size = np.cumsum(np.diff(raw(text)[1]) + 64)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right"))
        to = max(to, at + 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of a text column.

    buf: the translated bytes, padded; start, end: each word's bytes; doc: each word's row;
    first: the first word of each row, with one more entry at the end; hash: 64 bits a word.
    """

    def __init__(self, column: pa.Array, table: bytes = PLAIN):
        data, self.offsets = raw(column)
        self.n_docs = len(self.offsets) - 1
        self.source, self.data = data, data.translate(table)
        self.buf = buf = np.frombuffer(self.data + b" " * 16, np.uint8)
        n = len(data)
        word = np.empty(n + 2, bool)
        word[0] = word[-1] = False
        np.not_equal(buf[:n], 0x20, out=word[1:-1])
        change = word[1:] != word[:-1]
        inner = self.offsets[1:-1]
        cut = np.unique(inner[(inner > 0) & (inner < n)])
        split = cut[word[cut] & word[cut + 1]]  # words of two rows that touch
        edges = np.flatnonzero(change)
        if len(split):
            edges = np.sort(np.concatenate([edges, split, split]), kind="stable")
        self.start, self.end = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.offsets).astype(np.int64)
        self.first[-1] = len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    def hashes(self) -> np.ndarray:
        """A hash of each word's bytes and length, the same in every process."""
        lanes = np.lib.stride_tricks.as_strided(self.buf[:8].view(np.uint64), shape=(len(self.buf) - 7,), strides=(1,))
        size = self.end - self.start
        keep = np.concatenate([[U(0xFFFFFFFFFFFFFFFF)], np.array([(1 << (8 * k)) - 1 for k in range(1, 8)], np.uint64)])
        low = np.minimum(size, 8)
        h = lanes[self.start] & keep[low % 8]
        h = mix(h + U(0x51ED270B) * size.astype(np.uint64))
        at, live = 8, np.flatnonzero(size > 8)
        while len(live):
            left = np.minimum(size[live] - at, 8)
            lane = lanes[self.start[live] + at] & keep[left % 8]
            h[live] = mix((h[live] ^ lane) * GOLD + U(at))
            at += 8
            live = live[size[live] > at]
        return h

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]


def shingles(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words and the index of each one's first word; a row of fewer words, but not none, has one of all its words."""
    n = len(h)
    if not n:
        return h, np.empty(0, np.int64)
    counts = np.diff(first)
    whole = np.repeat(first[1:], counts) - np.arange(n) >= width
    at = np.flatnonzero(whole)
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out = out * U(0x9E3779B97F4A7C15) + h[at + k]
    out = mix(out + U(width))
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        own = np.empty(len(short), np.uint64)
        for j, d in enumerate(short):
            x = 0
            for v in h[first[d] : first[d + 1]].tolist():
                x = (x * 0x9E3779B97F4A7C15 + v) & 0xFFFFFFFFFFFFFFFF
            own[j] = x
        own = mix(own + counts[short].astype(np.uint64))
        at = np.concatenate([at, first[short]])
        order = np.argsort(at, kind="stable")
        out, at = np.concatenate([out, own])[order], at[order]
    return out, at
