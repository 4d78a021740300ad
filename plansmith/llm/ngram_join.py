"""Operator 11: n-gram Jaccard join by rare-first prefixes.

A document's set holds its distinct shingles of WIDTH words; documents of equal sets are one class.  Shingles are ordered by
how many texts hold them, rare ones first.  Two sets can reach the threshold only if their prefixes share a shingle, so
classes meet in the buckets of their prefixes' shingles.

Counting.  A block of texts sends each bucket of hashes its own shingles, as gaps, and gets back those that stand elsewhere
too, with the level of their count.  Others can meet nothing: they only lengthen a set, in front of its order.  Shingles
that one of SHARE of all are (and over LEAST of them) are found beforehand and known to all workers, so no bucket gathers
them; they come last in the order.  A class of which less than the threshold's share stands elsewhere drops out at once.

Joining.  Buckets of equal members are one.  Each bucket has a leader, the member that meets most others, and everyone is
held against it; then, where a bucket's members are still in several components, those outside the largest are held against
all others.  A bucket is dealt in chunks against chunks, never as pairs of its members.  A pair has to pass the length
filter, the positional filter at its first common prefix shingle, and the suffix filter, and is verified once, on both sets:
with a leader, or in the bucket of that first shingle.  Only links that join components come back.

Shingles are told apart by 48 bits within a pair, classes by 128 bits.

Cases: null, empty and white-space texts have no shingle and are linked with nothing, not even each other; fewer words than
WIDTH are one shingle; component_id is the smallest doc_id that links reach, its own included; a null doc_id is never that,
unless all of the component are null; repeated rows stay rows; texts of any length are read whole; an empty table gives no
rows; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, parts, settle, tidied
from .components import components
from .near_dedup import blobs, named
from .text import WHITE, U, Words, mix, shingles, slices

WIDTH = 4
#: The threshold in hundredths.
PERCENT = 85
#: Bits of a shingle's hash; the level of its count stands above them, so that sets in order are sorted numbers.
BITS = 48
#: The level of frequent shingles; all others are lower, so they come last.
FREQUENT = 127
#: Bytes of text of a block, and its documents at most (two bytes tell them apart).
BLOCK, DOCS = 8 << 20, 1 << 16
#: Shingles of a bucket, about.
BUCKET = 1 << 20
#: A shingle is frequent if it is one of SHARE of all, and stands in LEAST texts.
SHARE, LEAST = 200_000, 4096
#: Members and bytes of a chunk.
CHUNK, CHUNK_BYTES = 512, 4 << 20


def needed(n, percent: int = PERCENT):
    """The least overlap of a set of n shingles with one that it is linked with."""
    return -(-percent * n // 100)


def sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    w = Words(column, WHITE)
    h, at = shingles(w.hashes(), w.first, width)
    doc = np.searchsorted(w.first, at, "right") - 1
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.searchsorted(doc[keep], np.arange(w.n_docs + 1))


def keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bytes a set, whatever its order: two sums of remixed hashes."""
    out = np.zeros((len(first) - 1, 2), U)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for k, salt in enumerate((0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)):
            out[some, k] = mix(np.add.reduceat(mix(h ^ U(salt)), first[some]) + np.diff(first)[some].astype(U))
    return out


def members(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """kind 0: doc_id, key and n of every document; kind 1: a shingle (doc_id) and its texts (n) in a block, where they are several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, size = [], 0
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                h, first = sets(b.column(1), width)
                n = np.diff(first)
                key = blobs(keys(h, first).ravel(), np.arange(b.num_rows + 1) * 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int8)), b.column(0), key, pa.array(n.astype(np.int64))], ["kind", "doc_id", "key", "n"])
                many.append(h >> U(64 - BITS))
                size += len(h)
                if size >= BUCKET:
                    yield counted(many)
                    many, size = [], 0
        if size:
            yield counted(many)

    def counted(many: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(many), return_counts=True)
        some = n >= 3
        return pa.RecordBatch.from_arrays([pa.array(np.ones(some.sum(), np.int8)), pa.array(h[some].astype(np.int64)), pa.nulls(int(some.sum()), pa.binary()), pa.array(n[some])], ["kind", "doc_id", "key", "n"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidied(run), "kind tinyint, doc_id bigint, key binary, n bigint")


def frequent(own: DataFrame, total: int) -> np.ndarray:
    """Shingles that stand in over LEAST texts and are at least one of SHARE of all, by half of that as blocks count; so there are under 2 * SHARE."""
    most = max(LEAST, total // SHARE)
    rows = own.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")).where(F.col("n") >= most // 2).select("doc_id").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).astype(U))


def gaps(token: np.ndarray) -> bytes:
    """Sorted numbers, as gaps of four bytes where they fit."""
    gap = np.diff(token, prepend=token[:1])
    if len(token) and int(gap.max()) < 1 << 32:
        return b"\x01" + token[:1].tobytes() + gap.astype("<u4").tobytes()
    return b"\x00" + token.tobytes()


def ungapped(data: bytes) -> np.ndarray:
    if data[:1] == b"\x00":
        return np.frombuffer(data, U, offset=1)
    return np.frombuffer(data, U, 1, 1) + np.cumsum(np.frombuffer(data, "<u4", offset=9), dtype=U)


def level(n: np.ndarray) -> np.ndarray:
    """Three steps for each doubling of a count."""
    return np.minimum(1 + (np.log2(n) * 3).astype(np.int64), FREQUENT - 1)


MESSAGE = "to bigint, block bigint, docs binary, tokens binary, keys binary, sizes binary"


def messages(docs: DataFrame, n_buckets: int, hot: np.ndarray, width: int) -> DataFrame:
    """What a block sends the buckets: its shingles and the documents that hold them; and one row with its sets' keys and sizes and the frequent shingles, which only passes through."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def block(name: int, got: list) -> Iterator[pa.RecordBatch]:
        h, doc, key, n = (np.concatenate(x) for x in zip(*got, strict=True))
        _, only = np.unique(key.view("S16").ravel(), return_index=True)  # a set once
        keep = np.zeros(len(key), bool)
        keep[only] = True
        keep &= n > 0
        number = np.cumsum(keep) - 1
        if not keep.any():
            return
        h, doc = h[keep[doc]], number[doc[keep[doc]]]
        order = np.argsort(h, kind="stable")
        token, doc = h[order], doc[order].astype("<u2")
        hot = sent.value
        known = hot[np.minimum(np.searchsorted(hot, token), len(hot) - 1)] == token if len(hot) else np.zeros(len(token), bool)
        rows = [(int(mix(np.array([name], U))[0] % U(n_buckets)), name, doc[known].tobytes(), token[known].tobytes(), key[keep].tobytes(), n[keep].astype("<i8").tobytes())]
        token, doc = token[~known], doc[~known]
        cut = np.searchsorted(token, np.arange(n_buckets + 1, dtype=U) * U((1 << BITS) // n_buckets + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[k], cut[k + 1]
            rows.append((k, name, doc[a:b].tobytes(), gaps(token[a:b]), None, None))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], ["to", "block", "docs", "tokens", "keys", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, got, size, rows = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            for long in slices(batch, "text", 1 << 20):
                for at in range(0, long.num_rows, DOCS // 2):
                    b = long.slice(at, DOCS // 2)
                    if size >= BLOCK or rows + b.num_rows > DOCS:
                        yield from block(name, got)
                        name, got, size, rows = name + 1, [], 0, 0
                    h, first = sets(b.column(0), width)
                    n = np.diff(first)
                    got.append((h >> U(64 - BITS), np.repeat(np.arange(len(n)) + rows, n), keys(h, first), n))
                    size, rows = size + b.nbytes, rows + b.num_rows
        if got:
            yield from block(name, got)

    return docs.select("text").where("text IS NOT NULL").mapInArrow(tidied(run), MESSAGE)


def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's shingles that stand in several places, with their level, sent back to the blocks."""
    rows, token = [], []
    for b in batches:
        for r in b.to_pylist():
            if r["keys"] is not None:
                yield pa.RecordBatch.from_pylist([{**r, "tokens": (np.frombuffer(r["tokens"], U) | U(FREQUENT << BITS)).tobytes()}], b.schema)
            else:
                rows.append((r["to"], r["block"], np.frombuffer(r["docs"], "<u2")))
                token.append(ungapped(r["tokens"]))
    if not rows:
        return
    size = np.cumsum([0, *(len(t) for t in token)])
    token = np.concatenate(token)
    order = np.argsort(token)
    new = np.ones(len(token), bool)
    new[1:] = token[order[1:]] != token[order[:-1]]
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(token)))
    lv = np.zeros(len(token), np.int64)
    lv[order] = np.repeat(np.where(n > 1, level(n), 0), n)
    del order, new
    for (to, block, doc), a, b in zip(rows, size[:-1].tolist(), size[1:].tolist(), strict=True):
        some = np.flatnonzero(lv[a:b])
        if len(some):
            out = token[a:b][some] | (lv[a:b][some].astype(U) << U(BITS))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((to, pa.int64()), (block, pa.int64()), (doc[some].tobytes(), pa.binary()), (out.tobytes(), pa.binary()), (None, pa.binary()), (None, pa.binary()))], ["to", "block", "docs", "tokens", "keys", "sizes"])


def ordered(percent: int):
    """A block's classes of which enough stands elsewhere: key, n and the shared shingles in order."""

    def run(t: pa.Table) -> pa.Table:
        head = t.filter(pc.is_valid(t["keys"])).to_pylist()[0]
        key, n = np.frombuffer(head["keys"], "S16"), np.frombuffer(head["sizes"], "<i8")
        doc = np.concatenate([np.frombuffer(x, "<u2") for x in t["docs"].to_pylist()])
        item = np.concatenate([np.frombuffer(x, U) for x in t["tokens"].to_pylist()])
        shared = np.bincount(doc, minlength=len(n))
        keep = (shared >= needed(n, percent)) & (shared > 0)
        some = keep[doc]
        doc, item = doc[some], item[some]
        order = np.lexsort((item, doc))
        first = np.searchsorted(doc[order], np.append(np.flatnonzero(keep), len(n)))
        names = blobs(key[keep].view(U), np.arange(keep.sum() + 1) * 2)
        return pa.table({"key": names, "n": pa.array(n[keep]), "items": blobs(item[order], first)})

    return run


def candidates(docs: DataFrame, own: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """cid, key, n, items and size of the classes that may have a link."""
    total = own.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    n_buckets = max(parts(docs.sparkSession), int(total) // BUCKET + 1)
    dealt = messages(docs, n_buckets, frequent(own, int(total)), width).repartitionById(n_buckets, F.col("to").cast("int"))
    found = dealt.mapInArrow(tidied(answers), MESSAGE).groupBy("block").applyInArrow(ordered(percent), "key binary, n bigint, items binary")
    one = found.groupBy("key").agg(F.first("n").alias("n"), F.first("items").alias("items"))
    return settle(one.withColumns({"cid": F.monotonically_increasing_id(), "size": F.octet_length("items").cast("bigint") + 64}), "sets")


def prefixes(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(token, cid): the shared shingles in each class's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                own = [prefix(np.frombuffer(x, U), n, percent) for x, n in zip(part.column(2).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), [len(x) for x in own]))], ["token", "cid"])

    return classes.select("cid", "n", "items").mapInArrow(tidied(run), "token bigint, cid bigint")


def prefix(items: np.ndarray, n: int, percent: int) -> np.ndarray:
    """The part of the prefix that others hold too; the shingles that none else has come before it."""
    return items[: max(0, n - needed(n, percent) + 1 - (n - len(items)))]


class Meeting:
    """A chunk of a bucket's members and a chunk of those that they are held against."""

    def __init__(self, t: pa.Table, percent: int):
        self.percent = percent
        self.cid, self.n = t["cid"].to_numpy(), t["n"].to_numpy()
        self.of = np.unique(t["label"].to_numpy(), return_inverse=True)[1]
        alone = t["alone"].to_numpy().astype(bool)
        self.members, self.others = np.flatnonzero(~alone), np.flatnonzero(alone)
        self.items = [np.frombuffer(x, U) for x in t["items"].to_pylist()]
        self.prefix = [prefix(x, int(n), percent) for x, n in zip(self.items, self.n, strict=True)]
        self.size = np.array([len(x) for x in self.items])
        self.token = t["token"][0].as_py()  # null while a leader is met
        self.leader = t["leader"][0].as_py()

    def common(self, i: int, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of `to` that share a prefix shingle with i, and the places of the first one in both sets."""
        own, length = self.prefix[i], np.array([len(self.prefix[j]) for j in to.tolist()])
        to, length = to[length > 0], length[length > 0]
        if not len(to) or not len(own):
            return to[:0], to[:0], to[:0]
        flat = np.concatenate([self.prefix[j] for j in to.tolist()])
        start = np.cumsum(length) - length
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        place = np.where(own[at] == flat, np.arange(len(flat)), len(flat))
        first = np.minimum.reduceat(place, start)
        some = np.flatnonzero(first < len(flat))
        return to[some], at[first[some]], first[some] - start[some]

    def linked(self, i: int, to: np.ndarray) -> np.ndarray:
        """Those of `to` that reach the threshold with i."""
        n, m = int(self.n[i]), self.n[to]
        to = to[100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)]  # length
        to, p, q = self.common(i, to)
        if self.token is not None:
            here = self.items[i][p].view(np.int64) == self.token
            to, p, q = to[here], p[here], q[here]
        least = -(-self.percent * (n + self.n[to]) // (100 + self.percent))
        left = 1 + np.minimum(self.size[i] - p - 1, self.size[to] - q - 1)
        some = left >= least  # positions
        out = []
        for j, a, b, c in zip(to[some].tolist(), p[some].tolist(), q[some].tolist(), least[some].tolist(), strict=True):
            x, y = self.items[i][a + 1 :], self.items[j][b + 1 :]
            pivot = y[len(y) // 4 :: max(1, len(y) // 4)][:3]
            cut = np.diff(np.searchsorted(x, pivot), prepend=0, append=len(x)) - np.diff(np.searchsorted(y, pivot), prepend=0, append=len(y))
            if np.abs(cut).sum() > len(x) + len(y) - 2 * (c - 1):  # suffixes
                continue
            at = np.searchsorted(y, x)
            same = 1 + int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 1
            if same >= c:
                out.append(j)
        return np.array(out, np.int64)

    def links(self) -> list[tuple[int, int]]:
        out = []
        held = set(self.cid[self.others].tolist())
        twice = np.array([c in held for c in self.cid[self.members].tolist()], bool)  # pairs of two of the others come up twice
        for i in self.others.tolist():
            to = self.members[(self.of[self.members] != self.of[i]) & ~(twice & (self.cid[self.members] < self.cid[i]))]
            if self.token is not None:  # the leader has met everyone
                to = to[(self.cid[to] != self.leader) & (self.cid[i] != self.leader)]
            for j in self.linked(i, to).tolist():
                if self.of[i] != self.of[j]:
                    out.append((int(self.cid[i]), int(self.cid[j])))
                    self.of[self.of == self.of[j]] = self.of[i]
        return out


def held(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among rows (bucket, cid, label, alone, token, leader): those alone are held against all rows of their bucket under other labels, chunk against chunk."""
    rows = rows.join(classes.select("cid", "size"), "cid")

    def chunks(size: Column, n: Column) -> Column:
        return F.greatest(F.ceil(size / CHUNK_BYTES), F.ceil(n / CHUNK), F.lit(1)).cast("bigint")

    alone = F.col("alone").cast("bigint")
    many = settle(rows.groupBy("bucket").agg(chunks(F.sum("size"), F.count("*")).alias("m"), chunks(F.sum(F.col("size") * alone), F.sum(alone)).alias("o")), "chunks")  # a table of its own, so that the join may split a hot bucket
    place = lambda what, n: F.pmod(F.xxhash64("cid", F.lit(what)), F.col(n))
    zero = F.lit(0).cast("bigint")
    to = F.transform(F.sequence(zero, F.col("o") - 1), lambda x: F.struct(place("m", "m").alias("m"), x.alias("o"), F.lit(False).alias("alone")))
    by = F.transform(F.sequence(zero, F.col("m") - 1), lambda x: F.struct(x.alias("m"), place("o", "o").alias("o"), F.lit(True).alias("alone")))
    dealt = rows.join(many, "bucket").select("bucket", "cid", "label", "token", "leader", F.explode(F.when(F.col("alone"), F.concat(to, by)).otherwise(to)).alias("x")).select("bucket", "cid", "label", "token", "leader", "x.*")
    dealt = dealt.join(classes.select("cid", "n", "items"), "cid")

    def run(t: pa.Table) -> pa.Table:
        got = Meeting(t.combine_chunks(), percent).links()
        return pa.table({"a": pa.array([a for a, _ in got], pa.int64()), "b": pa.array([b for _, b in got], pa.int64())})

    return settle(dealt.groupBy("bucket", "m", "o").applyInArrow(run, "a bigint, b bigint"), "links")


def buckets(classes: DataFrame, percent: int) -> DataFrame:
    """(token, cid, n): buckets of several members, of those with equal members the one that comes first in the order."""
    rows = settle(prefixes(classes, percent), "prefixes")
    mark = F.sum(F.xxhash64("cid").cast("decimal(20,0)"))
    many = rows.groupBy("token").agg(F.count("*").alias("n"), mark.alias("mark"), F.min("cid").alias("low"), F.max("cid").alias("high")).where("n > 1")
    one = many.groupBy("n", "mark", "low", "high").agg(F.min("token").alias("token"))
    return settle(rows.join(one.select("token", "n"), "token"), "buckets")


def links(classes: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """(node, root) of the classes that are linked."""
    rows = buckets(classes, percent)
    hub = rows.groupBy("cid").agg(F.sum("n").alias("hub"))
    lead = settle(rows.join(hub, "cid").groupBy("token").agg(F.max(F.struct("hub", "cid")).alias("x")).select("token", F.col("x.cid").alias("leader")), "leaders")
    none = F.lit(None).cast("bigint")
    meet = rows.join(lead, "token").select(F.col("leader").alias("bucket"), "cid").distinct()
    meet = meet.select("bucket", "cid", F.col("cid").alias("label"), (F.col("cid") == F.col("bucket")).alias("alone"), none.alias("token"), none.alias("leader"))
    first = held(settle(meet, "meet"), classes, percent)
    label = settle(components(first), "labels")

    own = named(rows.where("n > 2").join(lead, "token"), label)
    share = own.groupBy("token", "label").agg(F.count("*").alias("c"))
    most = share.groupBy("token").agg(F.max(F.struct("c", "label")).alias("x"), F.count("*").alias("kinds")).where("kinds > 1").select("token", F.col("x.label").alias("most"))
    own = settle(own.join(most, "token").select(F.col("token").alias("bucket"), "cid", "label", (F.col("label") != F.col("most")).alias("alone"), "token", "leader"), "open")
    more = held(own, classes, percent)
    out = settle(components(first.union(more)), "labels")
    forget(classes.sparkSession, rows, lead, own)
    return out


def linked(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    own = settle(members(docs, width), "members")
    classes = candidates(docs, own, width, percent)
    label = links(classes, percent)
    root = classes.select("key", "cid").join(label, F.col("cid") == F.col("node")).select("key", "root")
    rows = own.where("kind = 0").select("doc_id", "key", "n")
    # A class without links is a component of its own; ids are reduced to a minimum before they are shuffled.
    least = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("low"))
    names = least.join(root, "key", "left")
    top = names.where("root IS NOT NULL").groupBy("root").agg(F.min("low").alias("top"))
    names = settle(names.join(top, "root", "left").select("key", F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("top")).alias("component_id")), "names")
    full = rows.where("n > 0").join(names, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
