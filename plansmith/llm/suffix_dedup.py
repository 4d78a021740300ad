"""Operator 10: exact removal of byte strings that an earlier document holds, by prefix doubling over sampled positions.

Sorting all byte positions by rank pairs moves 16 bytes and more a position and round.  Here positions are first sampled by
their own bytes: every LENGTH-byte string picks the GRAM bytes in it with the smallest hash as its anchor, so equal strings
pick equal anchors.  Ranking by anchors is the first round; positions whose anchor is unique among documents drop out.  Spark
deals the strings around the others by anchor, with equal surroundings joined before the shuffle, and in each bucket rank
pairs at growing offsets are sorted and ranked anew, until a rank is alone or means LENGTH equal bytes.  The smallest document of each rank decides what goes.

Anchors that occur in several documents go to the workers as a bitmap of BITS bits an anchor and TABLE bytes at most.  It only
saves traffic: where it fills up, more anchors that are alone are dealt, and drop out in their buckets.

Cases: a null or empty text, or one of fewer than LENGTH bytes, loses nothing; a null doc_id is larger than all others and
not smaller than another null; rows of equal doc_id take nothing from each other; a text repeated in a later document goes
whole; texts of any length are read whole, in pieces that overlap.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, parts, settle, tidied
from .text import GOLD, MIX2, U, mix, raw, slices

LENGTH = 50
GRAM = 16
#: Bytes of the filter of repeated anchors, at most, and its bits for each of them.
TABLE, BITS = 128 << 20, 32
#: Anchors in a block, and runs in one.
BLOCK, RUNS = 1 << 19, 1 << 16
#: Bytes of text that are sampled at once: some 60 bytes of arrays go to each.
STEP = 1 << 20
#: Windows that are ranked at once.
RANKED = 1 << 17
#: Longer texts are cut in pieces of so many windows.
PIECE = 1 << 20
LAST = 2**63 - 1


class Runs:
    """Runs of LENGTH-byte windows of a row that have one anchor: row, first and last window start (bytes within the row), anchor hash, and the anchor's place in the first window."""

    def __init__(self, data: bytes, offsets: np.ndarray, length: int = LENGTH):
        wide = length - GRAM + 1
        out = []
        for start, stop, row, base in self.pieces(offsets, length):
            n = stop - start
            buf = np.frombuffer(data, np.uint8, n, start)
            buf = np.concatenate([buf, np.zeros(16, np.uint8)])
            lanes = np.lib.stride_tricks.as_strided(buf[:8].view(np.uint64), shape=(n + 9,), strides=(1,))
            h = mix(mix(lanes[:n]) * GOLD + lanes[8 : n + 8] * MIX2)
            low = (h >> U(24) << U(24)) | np.arange(n, dtype=np.uint64)  # ties go to the left
            span = 1
            while 2 * span <= wide:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            if span < wide:
                low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
            at = (low & U(0xFFFFFF)).astype(np.int64)[: n - length + 1]
            if len(row) > 1:  # windows over two rows
                cut = row[1:]
                bad = np.zeros(len(at) + 1, np.int64)
                np.add.at(bad, np.minimum(np.maximum(cut - length + 1, 0), len(at)), 1)
                np.add.at(bad, np.minimum(cut, len(at)), -1)
                at[np.cumsum(bad)[:-1] > 0] = -1
            edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
            first, last = edge[:-1], edge[1:] - 1
            good = at[first] >= 0
            first, last = first[good], last[good]
            doc = np.searchsorted(row, first, "right") - 1
            # An equal anchor on both sides of a row's end cannot be: its place differs.
            out.append((doc + base[0], first - row[doc] + base[1], last - row[doc] + base[1], h[at[first]], at[first] - first))
        got = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 5
        self.doc, self.first, self.last, self.offset = got[0], got[1], got[2], got[4]
        self.anchor = mix(got[3].astype(np.uint64))  # the smallest hash of many is small: mixed again, so that buckets are even

    @staticmethod
    def pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, tuple[int, int]]]:
        """Byte ranges to read at once: rows together while they are short, long rows in overlapping pieces."""
        n, k = len(offsets) - 1, 0
        while k < n:
            if offsets[k + 1] - offsets[k] > PIECE:
                for at in range(0, int(offsets[k + 1] - offsets[k]), PIECE):
                    a, b = int(offsets[k]) + at, min(int(offsets[k + 1]), int(offsets[k]) + at + PIECE + length - 1)
                    if b - a >= length:
                        yield a, b, np.zeros(1, np.int64), (k, at)
                k += 1
                continue
            to = k + 1
            while to < n and offsets[to + 1] - offsets[to] <= PIECE and offsets[to + 1] - offsets[k] <= PIECE:
                to += 1
            if offsets[to] - offsets[k] >= length:
                yield int(offsets[k]), int(offsets[to]), offsets[k:to] - offsets[k], (k, 0)
            k = to


def bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)


def repeated(docs: DataFrame, n: int, length: int) -> DataFrame:
    """bucket, anchors: 48 bits of each anchor that more than one document may hold, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, doc = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            h = h[first]
            cut = np.searchsorted(bucket(h, n), np.arange(n + 1))
            some = np.flatnonzero(np.diff(cut))
            six = (h >> U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([six[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary()), pa.array([np.packbits(several[cut[k] : cut[k + 1]]).tobytes() for k in some], pa.binary())], ["bucket", "anchors", "several"])

        for batch in batches:
            for b in slices(batch, "text", STEP):
                r = Runs(*raw(b.column(1)), length)
                if len(r.anchor):
                    own = b.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
                    held.append((r.anchor, own[r.doc]))
                    size += len(r.anchor)
                if size >= BLOCK:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for k, x, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                six = np.frombuffer(x, np.uint8).reshape(-1, 6)
                wide = np.zeros((len(six), 8), np.uint8)
                wide[:, :6] = six
                held.setdefault(k, []).append((wide.view("<u8").ravel(), np.unpackbits(np.frombuffer(s, np.uint8), count=len(six)).astype(bool)))
        for k, x in held.items():
            h, several = (np.concatenate([y[i] for y in x]) for i in (0, 1))
            order = np.argsort(h, kind="stable")
            h, several = h[order], several[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            keep = (np.diff(np.append(first, len(h))) > 1) | np.logical_or.reduceat(several, first)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([h[first][keep].astype("<u8").tobytes()], pa.binary())], ["bucket", "anchors"])

    dealt = docs.select("doc_id", "text").mapInArrow(tidied(run), "bucket bigint, anchors binary, several binary").repartitionById(n, F.col("bucket").cast("int"))
    return settle(dealt.mapInArrow(tidied(gathered), "bucket bigint, anchors binary"), "anchors")


def bitmap_of(anchors: DataFrame, most: int = TABLE) -> np.ndarray:
    """Bits of the repeated anchors by the top bits of their hashes: a power of two of at most `most` bytes."""
    n = anchors.agg(F.coalesce(F.sum(F.octet_length("anchors")), F.lit(0)).alias("n")).first()["n"] // 8
    power = max(3, min((max(most, 1) * 8).bit_length() - 1, (max(n, 1) * BITS - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                at = (np.frombuffer(x, "<u8") >> U(48 - power)).astype(np.int64)
                if len(at):
                    low = int(at[0]) >> 3
                    bits = np.zeros(((int(at[-1]) >> 3) - low + 1) * 8, bool)
                    bits[at - low * 8] = True
                    yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], ["low", "bits"])

    out = np.zeros(1 << (power - 3), np.uint8)
    for r in anchors.select("anchors").mapInArrow(run, "low bigint, bits binary").toLocalIterator():
        bits = np.frombuffer(zlib.decompress(bytes(r["bits"])), np.uint8)
        out[r["low"] : r["low"] + len(bits)] |= bits
    return out


def surroundings(docs: DataFrame, n: int, length: int, sent) -> DataFrame:
    """For every bucket of every block: the distinct strings that runs with repeated anchors cover, with their smallest document, and the runs themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        shift = U(64 - (8 * len(table)).bit_length() + 1)
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            text, own, h, anchor, offset, first = ([y for x in held for y in x[0]], *(np.concatenate([x[i] for x in held]) for i in range(1, 6)))
            b = bucket(anchor, n)
            order = np.lexsort((own, b))
            cut = np.searchsorted(b[order], np.arange(n + 1))
            rows = []
            # One name for the whole block: what its documents lose in different buckets meets again under it.
            block = int(np.frombuffer(hashlib.blake2b(own.tobytes() + h.tobytes() + first.tobytes(), digest_size=8).digest(), np.int64)[0])
            for k in np.flatnonzero(np.diff(cut)):
                mine = order[cut[k] : cut[k + 1]]
                seen: dict[bytes, int] = {}
                kind = np.array([seen.setdefault(text[i], len(seen)) for i in mine.tolist()], np.int64)
                low = np.full(len(seen), LAST)
                np.minimum.at(low, kind, own[mine])
                place = np.zeros(len(seen), np.uint8)
                place[kind] = offset[mine]
                rows.append((int(k), block, b"".join(seen), np.array([len(x) for x in seen], "<u2").tobytes(), place.tobytes(), low.tobytes(), kind.astype("<u4").tobytes(), own[mine].tobytes(), h[mine].tobytes(), first[mine].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 2 + (pa.binary(),) * 8, strict=True)], ["bucket", "block", "text", "size", "place", "low", "kind", "own", "h", "first"])

        for batch in batches:
            for b in slices(batch, "text", STEP):
                data, offsets = raw(b.column(2))
                r = Runs(data, offsets, length)
                x = (r.anchor >> shift).astype(np.int64)
                some = np.flatnonzero(table[x >> 3] >> (7 - (x & 7)).astype(np.uint8) & 1)
                if not len(some):
                    continue
                doc = r.doc[some]
                start, stop = offsets[doc] + r.first[some], offsets[doc] + r.last[some] + length
                own, h = b.column(0).fill_null(LAST).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
                held.append(([data[i:j] for i, j in zip(start.tolist(), stop.tolist(), strict=True)], own[doc], h[doc], r.anchor[some], r.offset[some], r.first[some]))
                size += len(some)
                if size >= RUNS:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return docs.select("doc_id", "h", "text").mapInArrow(tidied(run), "bucket bigint, block bigint, " + ", ".join(f"{c} binary" for c in ("text", "size", "place", "low", "kind", "own", "h", "first")))


def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """New ranks of rank pairs, by sorting them."""
    return np.unique(a.astype(np.uint64) * U(int(b.max(initial=0)) + 1) + b.astype(np.uint64), return_inverse=True)[1]


def smallest(texts: list[bytes], low: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each text, one after another, the smallest document of its string; and where each text's windows start.

    A text alone with its anchor needs no ranks."""
    size = np.array([len(t) for t in texts], np.int64)
    windows = size - length + 1
    start = np.cumsum(windows) - windows
    out = np.repeat(low, windows)
    gram = np.array([hash(t[p : p + GRAM]) for t, p in zip(texts, place.tolist(), strict=True)], np.int64)
    _, back, count = np.unique(gram, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count[back] > 1)
    shared = shared[np.argsort(back[shared], kind="stable")]
    group, many = back[shared], np.cumsum(windows[shared])
    at = 0
    while at < len(shared):  # whole anchors, some at a time
        stop = int(np.searchsorted(many, (many[at - 1] if at else 0) + RANKED, "right"))
        stop = int(np.searchsorted(group, group[max(stop - 1, at)], "right"))
        own = shared[at:stop]
        flat = b"".join([texts[i] for i in own.tolist()])
        first, w, p = np.cumsum(size[own]) - size[own], windows[own], place[own].astype(np.int64)
        at = stop
        # A window's anchor and the anchor's place in it follow from its string, so only windows that agree in both can be
        # equal: they are ranked place by place, and memory follows the texts of these anchors.
        for d in range(int(p.max()) + 1):
            inner = p - d
            some = np.flatnonzero((inner >= 0) & (inner < w))
            if len(some) > 1:
                ranked(flat, first[some] + inner[some], start[own[some]] + inner[some], group_of(back[own[some]]), out, length)
    return out, start


def group_of(x: np.ndarray) -> np.ndarray:
    """Sorted numbers to 0, 1, ..."""
    return np.cumsum(np.concatenate([[0], x[1:] != x[:-1]]))


def ranked(flat: bytes, begin: np.ndarray, to: np.ndarray, group: np.ndarray, out: np.ndarray, length: int) -> None:
    """Lower out[to] to the smallest document of each window's string, by prefix doubling.

    The eight bytes at a place are its first rank.  Ranks of 2k bytes come from the rank pairs at places k apart, sorted; the
    last pair, of the largest k, overlaps so far that it ends with the window.  A window whose first rank is its own drops out."""
    buf = np.frombuffer(flat, np.uint8)
    lanes = np.lib.stride_tricks.as_strided(buf[:8].view(np.uint64), shape=(len(flat) - 7,), strides=(1,))
    reach = 8
    while 2 * reach < length:
        reach *= 2
    at = {reach: [0, length - reach]}  # where in a window ranks of so many bytes are needed
    while reach > 8:
        reach //= 2
        at[reach] = sorted({x + y for x in at[2 * reach] for y in (0, reach)})
    rank = np.stack([lanes[begin + x] for x in at[8]], 1)  # a row a window
    alive = np.bincount(group)[group] > 1
    while True:
        begin, to, group, rank = begin[alive], to[alive], group[alive], rank[alive]
        if not len(begin):
            return
        places = {x: k for k, x in enumerate(at[reach])}
        if 2 * reach >= length:
            break
        names = np.unique(rank, return_inverse=True)[1].reshape(rank.shape)
        rank = pairs(*(np.stack([names[:, places[x + y]] for x in at[2 * reach]], 1).ravel() for y in (0, reach))).reshape(len(begin), -1)
        reach *= 2
        first = pairs(group, rank[:, at[reach].index(0)])
        alive = np.bincount(first)[first] > 1
    names = np.unique(rank, return_inverse=True)[1].reshape(rank.shape)
    last = pairs(group, pairs(names[:, 0], names[:, -1]))
    best = np.full(int(last.max()) + 1, LAST)
    np.minimum.at(best, last, out[to])
    out[to] = best[last]


def settled(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's blocks to the spans that its runs lose: doc_id, hash, start and end, in one block a block."""
        held: dict[int, list] = {}
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(r[0], []).append(r[1:])
        for rows in held.values():
            seen: dict[bytes, int] = {}
            local, lows, places = [], [], []
            for _, text, size, place, low, *_ in rows:
                ends = np.cumsum(np.frombuffer(size, "<u2").astype(np.int64)).tolist()
                local.append(np.array([seen.setdefault(text[i:j], len(seen)) for i, j in zip([0, *ends[:-1]], ends, strict=True)], np.int64))
                lows.append(np.frombuffer(low, np.int64))
                places.append(np.frombuffer(place, np.uint8))
            every = np.concatenate(local)
            low = np.full(len(seen), LAST)
            np.minimum.at(low, every, np.concatenate(lows))
            place = np.zeros(len(seen), np.uint8)
            place[every] = np.concatenate(places)
            rows[:] = [(*r[5:], r[0]) for r in rows]  # the blocks' strings have been taken over
            texts = list(seen)
            del seen
            best, start = smallest(texts, low, place, length)
            del texts
            windows = np.diff(np.append(start, len(best)))
            for r, to in zip(rows, local, strict=True):
                kind, own, h, first = to[np.frombuffer(r[0], "<u4")], np.frombuffer(r[1], np.int64), np.frombuffer(r[2], np.int64), np.frombuffer(r[3], "<u4").astype(np.int64)
                w = windows[kind]
                inner = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
                gone = best[np.repeat(start[kind], w) + inner] < np.repeat(own, w)
                at = np.cumsum(w) - w
                # Windows of a run lie so close that the first and the last that go cover all between.
                low_ = np.minimum.reduceat(np.where(gone, inner, length), at)
                high = np.maximum.reduceat(np.where(gone, inner, -1), at)
                some = high >= 0
                if some.any():
                    x = np.stack([own[some], h[some], first[some] + low_[some], first[some] + high[some] + length], 1)
                    yield pa.RecordBatch.from_arrays([pa.array([r[4]], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["block", "spans"])

    return run


def joined(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc, hash, start, end) to maximal runs."""
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    new_doc = np.ones(len(spans), bool)
    new_doc[1:] = (spans[1:, :2] != spans[:-1, :2]).any(axis=1)
    # A running maximum of ends within a row: rows are lifted apart so that one pass does.
    lift = np.cumsum(new_doc) * (int(spans[:, 3].max()) + 1)
    top = np.maximum.accumulate(spans[:, 3] + lift)
    new = new_doc.copy()
    new[1:] |= spans[1:, 2] + lift[1:] > top[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(spans)) - 1
    return spans[first, 0], spans[first, 1], spans[first, 2], (top - lift)[last]


def spans(docs: DataFrame, length: int = LENGTH, table: int = TABLE, n_parts: int | None = None) -> DataFrame:
    """doc_id, h (xxhash64 of the text), starts and ends of what each row loses; rows that lose nothing are not there."""
    spark = docs.sparkSession
    n = n_parts or 8 * parts(spark)  # small buckets: a frequent anchor comes on top
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    anchors = repeated(docs, n, length)
    sent = spark.sparkContext.broadcast(bitmap_of(anchors, table))
    forget(spark, anchors)
    dealt = surroundings(docs, n, length, sent).repartitionById(n, F.col("bucket").cast("int"))
    lost = settle(dealt.mapInArrow(tidied(settled(length)), "block bigint, spans binary"), "lost").repartition(n, "block")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for k, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(k, []).append(x)
        for x in held.values():
            doc, h, start, end = joined(np.frombuffer(b"".join(x), np.int64).reshape(-1, 4))
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]))
            cut = np.append(first, len(doc))
            lists = lambda y: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(y, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(doc[first], pa.int64(), mask=doc[first] == LAST), pa.array(h[first], pa.int64()), lists(start), lists(end)], ["doc_id", "h", "starts", "ends"])

    return lost.mapInArrow(tidied(rows_of), "doc_id bigint, h bigint, starts array<bigint>, ends array<bigint>")


def free(names: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores until they clash with none of `names`."""
    out = []
    for w in wanted:
        while w in names:
            w += "_"
        out.append(w)
    return out


def with_spans(docs: DataFrame, length: int = LENGTH, table: int = TABLE) -> tuple[DataFrame, str, str]:
    """All columns of docs and the spans (null for none) that each row loses; then the names of the columns of starts and ends, which clash with none of docs."""
    id_, h_, starts, ends = free([c.lower() for c in docs.columns], "id_", "h_", "starts_", "ends_")
    cut = spans(docs, length, table).groupBy(F.col("doc_id").alias(id_), F.col("h").alias(h_)).agg(F.flatten(F.collect_list("starts")).alias(starts), F.flatten(F.collect_list("ends")).alias(ends))
    cut = settle(cut, "spans")
    return docs.join(cut, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col(h_)), "left").drop(id_, h_), starts, ends


def kept(text: bytes, starts: list[int] | None, ends: list[int] | None) -> tuple[bytes, int, int]:
    """What is left, the bytes removed and the runs."""
    if not starts:
        return text, 0, 0
    out, at, runs, gone = [], 0, 0, 0
    stop = -1
    for a, b in sorted(zip(starts, ends, strict=True)):
        if a > stop:
            runs += 1
        a = max(a, at)
        if b > a:
            out.append(text[at:a])
            gone, at = gone + b - a, b
        stop = max(stop, b)
    out.append(text[at:])
    return b"".join(out), gone, runs


def report(docs: DataFrame, length: int = LENGTH, table: int = TABLE) -> DataFrame:
    """Bytes, removed bytes, removed runs and the digest of what is left, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", STEP):
                at = {c: b.column(k) for k, c in enumerate(b.schema.names)}
                texts = [t or b"" for t in at["text"].cast(pa.binary()).to_pylist()]
                got = [kept(t, s, e) for t, s, e in zip(texts, at[starts].to_pylist(), at[ends].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([at["doc_id"], *(pa.array(x, pa.int64()) for x in ([len(t) for t in texts], [g for _, g, _ in got], [r for _, _, r in got])), pa.array([hashlib.sha256(x).hexdigest() for x, _, _ in got], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found, starts, ends = with_spans(docs.select("doc_id", "text"), length, table)
    return found.select("doc_id", "text", starts, ends).mapInArrow(tidied(run), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
