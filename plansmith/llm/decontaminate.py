"""Operator 4: benchmark decontamination by a prefix-filtered set join.

Each benchmark item is cut into windows of WINDOW words; a window is a set of shingles.  Containment has to be whole, so one
shingle is the necessary prefix: the rarest, by its count over all documents.  Documents' shingles are joined with the
prefixes; a candidate has to start and end inside the document (the positional and length bounds), and then its words are
compared one by one.

The benchmark side is sent to the workers only in slices of a checked size; a larger benchmark takes several slices, which
one plan applies in turn, so nothing is left out.

Cases: a null text or one without words has no hits; an item without words has no window; an item of fewer than WINDOW words
is one window; equal windows of several items count for each of them; a null item_id counts as the empty text; texts of
any length are read whole; repeated rows give repeated results; an empty table gives no rows; columns named like the results give way.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle
from .text import PLAIN, Words, shingles, slices

WINDOW = 10
SHINGLE = 5
#: Bytes of benchmark text in a slice.
SLICE = 16 << 20


@dataclass
class Windows:
    """Distinct windows: their words, the items that hold them, and each one's shingles with offsets."""

    words: list[tuple[bytes, ...]]
    items: list[list[str]]
    shingles: list[np.ndarray]
    widths: list[int]


def windows(rows: list[tuple[str, str]], size: int, width: int) -> Windows:
    own: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in rows:
        w = text.encode().translate(PLAIN).split()
        for k in range(max(1, len(w) - size + 1) if w else 0):
            own[tuple(w[k : k + size])].add(item)
    words = list(own)
    hashes, widths = [], []
    for w in words:
        by = Words(pa.array([b" ".join(w)], pa.binary()))
        widths.append(min(width, len(w)))
        hashes.append(shingles(by.hashes(), by.first, widths[-1])[0])
    return Windows(words, [sorted(own[w]) for w in words], hashes, widths)


def lookup(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and a bitmap that turns most others away; its size follows the keys."""
    bits = max(12, int(len(keys) * 16).bit_length())
    seen = np.zeros(1 << bits, bool)
    seen[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.sort(keys), seen


def matches(h: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Places in h of the hashes that are keys."""
    keys, seen = table
    if not len(keys):
        return np.empty(0, np.int64)
    shift = np.uint64(64 - (len(seen).bit_length() - 1))
    some = np.flatnonzero(seen[(h >> shift).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, h[some]), len(keys) - 1)
    return some[keys[at] == h[some]]


def rarity(docs: DataFrame, own: Windows, text_col: str) -> dict[int, int]:
    """How often each benchmark shingle stands in the documents; counted where the texts are, summed by Spark."""
    keys = np.unique(np.concatenate(own.shingles))
    table, widths = lookup(keys), sorted(set(own.widths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for b in slices(batch, text_col):
                w = Words(b.column(0))
                h = w.hashes()
                for width in widths:
                    s = shingles(h, w.first, width)[0]
                    found.append(s[matches(s, table)])
            key, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    rows = docs.select(text_col).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect()  # no more than the slice has shingles
    return {r["key"]: r["n"] for r in rows}


class Join:
    """The prefixes of a slice of windows, for the workers."""

    def __init__(self, own: Windows, count: dict[int, int]):
        self.words, self.items = own.words, own.items
        prefix, offset = [], []
        for s in own.shingles:
            n = [count.get(x, 0) for x in s.view(np.int64).tolist()]
            k = min(range(len(s)), key=lambda i: (n[i], i))
            prefix.append(s[k])
            offset.append(k)
        prefix = np.array(prefix, np.uint64)
        order = np.argsort(prefix, kind="stable")
        self.window, self.prefix, self.offset = order, prefix[order], np.array(offset, np.int64)[order]
        self.size = np.array([len(w) for w in own.words], np.int64)
        self.widths = sorted(set(own.widths))
        self.keys, self.seen = lookup(self.prefix)
        self.first = np.searchsorted(self.prefix, self.prefix)
        # Hashes of all words of all windows, to compare candidates at once.
        flat = Words(pa.array([b" ".join(w) for w in own.words], pa.binary()))
        self.flat, self.at = flat.hashes(), flat.first
        # Windows of an item that occur nowhere (no prefix in any document) stay out of the join by themselves.

    def __call__(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and the document words where they start."""
        found_w, found_at = [], []
        for width in self.widths:
            s, at = shingles(h, w.first, width)
            place = matches(s, (self.keys, self.seen))
            if not len(place):
                continue
            low, high = np.searchsorted(self.prefix, s[place], "left"), np.searchsorted(self.prefix, s[place], "right")
            n = high - low
            k = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(at[place], n) - self.offset[k]
            doc = np.repeat(np.searchsorted(w.first, at[place], "right") - 1, n)
            window = self.window[k]
            inside = (start >= w.first[doc]) & (start + self.size[window] <= w.first[doc + 1])
            window, start = window[inside], start[inside]
            for j in range(int(self.size.max(initial=0))):
                more = j < self.size[window]
                same = np.ones(len(window), bool)
                same[more] = h[start[more] + j] == self.flat[self.at[window[more]] + j]
                window, start = window[same], start[same]
            found_w.append(window)
            found_at.append(start)
        if not found_w:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pair = np.unique(np.stack([np.concatenate(found_at), np.concatenate(found_w)], 1), axis=0)
        sure = [tuple(w.data[w.start[a] : w.end[a + self.size[k] - 1]].split()) == self.words[k] for a, k in pair.tolist()]
        pair = pair[np.array(sure, bool)] if len(pair) else pair.reshape(0, 2)
        return pair[:, 1], pair[:, 0]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, width: int = SHINGLE, slice_bytes: int = SLICE, text_col: str = "text") -> DataFrame:
    """All columns of docs, n_words, the hit spans (starts, ends: words from 0) and the items whose windows occur."""
    taken = {"n_words", "starts", "ends", "items"} & set(docs.columns)
    docs = docs.drop(*taken)
    clean = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = clean.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n_slices = max(1, -(-int(total) // slice_bytes))
    out = docs.withColumns({"n_words": F.lit(None).cast("bigint"), "starts": F.array().cast("array<bigint>"), "ends": F.array().cast("array<bigint>"), "items": F.array().cast("array<string>")})
    schema = out.schema
    for k in range(n_slices):
        some = clean if n_slices == 1 else clean.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_slices)) == k)
        own = windows([(r[0], r[1]) for r in some.collect()], window, width)
        join = Join(own, rarity(docs, own, text_col)) if own.words else None
        sent = docs.sparkSession.sparkContext.broadcast(join)
        before, out = out, out.mapInArrow(worker(sent, text_col), schema)
        if k < n_slices - 1:  # one slice at a time in the workers' memory
            out = settle(out, "hits")
            sent.unpersist()
            if k:
                forget(docs.sparkSession, before)
    return out


def worker(sent, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = sent.value
        for batch in batches:
            for b in slices(batch, text_col):
                column = {n: b.schema.get_field_index(n) for n in ("n_words", "starts", "ends", "items", text_col)}
                w = Words(b.column(column[text_col]))
                starts, ends, items = (b.column(column[n]).to_pylist() for n in ("starts", "ends", "items"))
                if join is not None:
                    h = w.hashes()
                    window, at = join(w, h)
                    doc = np.searchsorted(w.first, at, "right") - 1
                    spans, names = defaultdict(list), defaultdict(set)
                    for d, k, a in zip(doc.tolist(), window.tolist(), (at - w.first[doc]).tolist(), strict=True):
                        spans[d].append((a, a + int(join.size[k])))
                        names[d].update(join.items[k])
                    for d in spans:
                        both = merged(spans[d] + list(zip(starts[d], ends[d], strict=True)))
                        starts[d], ends[d] = [a for a, _ in both], [e for _, e in both]
                        items[d] = sorted(names[d].union(items[d]))
                new = {"n_words": pa.array(w.counts, pa.int64()), "starts": pa.array(starts, pa.list_(pa.int64())), "ends": pa.array(ends, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new.get(f.name, b.column(i)) for i, f in enumerate(b.schema)], [f.name for f in b.schema])

    return run


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words, hit words, items and their digest for every document."""
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("bigint"), lambda a, x: a + x)
    found = hits(docs.select("doc_id", "text"), benchmark, window)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))
