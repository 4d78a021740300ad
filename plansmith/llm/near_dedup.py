"""Operator 8: MinHash near-dedup with DartMinHash signatures and a banded join.

Texts of equal words are one class from the start, found by a key that is grouped before it is shuffled.  Classes have
signatures and a number; classes that share a band meet in a bucket.  Buckets never emit pairs of their members.  First, each
bucket has a leader, the member that meets most others, and everyone is held against it; links join components.  Then, in
buckets of three and more whose members are still in several components, the members outside the largest component are held
against all others.  Both comparisons deal a bucket by bytes: its members in chunks against chunks of those they are held
against, so a task holds two chunks at most, and returns links that join components, never pairs.

A signature only rules pairs out, far below the threshold; all others are decided on the shingles of both texts.  So no pair
that shares a band and may reach the threshold goes unchecked, unless its texts are joined already.

Cases: null and empty texts and texts without words are alike only where they are equal; a text of fewer than five words
is one shingle; a document's class id is the smallest doc_id of its group; a null doc_id is never that, unless the group
has no other; repeated rows stay rows, in one class; texts of any length are read whole; an empty table gives no rows; only
doc_id, text and the columns of `keep` are read, so others may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dart
from .common import forget, settle, tidied
from .components import components
from .text import Words, slices

WIDTH = 5
THRESHOLD = 0.8
#: How far under the threshold a signature rules a pair out: over 4.7 of its standard deviations there, one in a million pairs at the threshold.
MARGIN = 0.15
#: Bits of the filter that picks texts whose shingles are wanted; its size is fixed, so at worst it picks more.
FILTER = 1 << 26
#: Rounds in which buckets have a leader; they only save work for the comparison that follows.
ROUNDS = 1
#: Members, and bytes of their signatures and shingles, of one chunk.
CHUNK, CHUNK_BYTES = 512, 4 << 20
#: Bytes of text that are read at once.
STEP = 1 << 20


def pick() -> Column:
    """A number that the rows of a text can be found by: its doc_id, or a hash of the text where that is null."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text"))


def worded(w: Words, column: pa.Array) -> pa.Array:
    """The key of each row; only texts without words are looked at as Python objects."""
    none = np.flatnonzero(w.counts == 0)
    texts = dict(zip(none.tolist(), column.take(pa.array(none)).cast(pa.binary()).to_pylist(), strict=True))
    return pa.array(dart.keys(w, texts), pa.binary())


def blobs(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Parts of an array as binary values, without an object for each."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * data.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def prints(docs: DataFrame, width: int = WIDTH, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, pick, key, signature (16 bits a coordinate; null without words) and the columns `keep` of every document."""
    own = docs.select("doc_id", "text", pick().alias("pick"), *keep)
    kinds = "".join(f", {c} {own.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", STEP):
                w = Words(b.column(1))
                short = (dart.signatures(w, width) >> np.uint64(48)).astype("<u2")
                sig = np.flatnonzero(w.counts)
                place = np.full(b.num_rows, -1)
                place[sig] = np.arange(len(sig))
                sigs = blobs(short[sig].ravel(), np.arange(len(sig) + 1) * short.shape[1]).take(pa.array(place, mask=place < 0))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), worded(w, b.column(1)), sigs, *b.columns[3:]], ["doc_id", "pick", "key", "sig", *keep])

    return own.mapInArrow(tidied(run), "doc_id bigint, pick bigint, key binary, sig binary" + kinds)


def signatures_of(column: pa.Array) -> np.ndarray:
    """Rows of signatures without a copy of each."""
    data = column.cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    return np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u2").reshape(len(data), -1)


def banded(classes: DataFrame) -> DataFrame:
    """band and cid: a row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                band = dart.bands(signatures_of(part.column(1)).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(band.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), band.shape[1]))], ["band", "cid"])

    return classes.where("sig IS NOT NULL").select("cid", "sig").mapInArrow(tidied(run), "band bigint, cid bigint")


def shingled(need: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """cid, size, sig and items (the sorted shingles as bytes) of the classes (cid, key, pick, sig) in need."""
    place = F.pmod(F.xxhash64("pick"), F.lit(FILTER))
    bitmap = need.groupBy(F.bitmap_bucket_number(place + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bits"))
    rows = bitmap.collect()  # FILTER bits at most
    size = len(rows[0]["bits"]) if rows else 0
    bits = np.zeros(-(-FILTER // (8 * size)) * size if size else 0, np.uint8)
    for r in rows:
        bits[(r["k"] - 1) * size : r["k"] * size] = np.frombuffer(bytes(r["bits"]), np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sent.value
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((seen[at >> 3] >> (at & 7) & 1).astype(bool)) if len(seen) else pa.array(np.zeros(len(at), bool)))
            for b in slices(batch, "text", STEP):
                w = Words(b.column(1))
                e, doc = dart.regions(w, width)
                order = np.lexsort((e, doc))
                yield pa.RecordBatch.from_arrays([b.column(0), worded(w, b.column(1)), blobs(e[order], np.searchsorted(doc[order], np.arange(w.n_docs + 1)))], ["pick", "key", "items"])

    found = docs.select(pick().alias("pick"), "text").withColumn("at", F.pmod(F.xxhash64("pick"), F.lit(FILTER))).mapInArrow(tidied(sets), "pick bigint, key binary, items binary")
    # Rows that repeat a text under one number give it once: cid is the class's own, so one of them is enough.
    found = found.join(need, ["pick", "key"]).select("cid", "sig", "items").dropDuplicates(["cid"])
    return settle(found.withColumn("size", (F.octet_length("sig") + F.octet_length("items")).cast("bigint")), "texts")


class Meeting:
    """A chunk of a bucket's members and a chunk of those that they are held against."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        self.cid = t["cid"].to_numpy()
        self.sig = signatures_of(t["sig"].chunk(0) if t["sig"].num_chunks else pa.array([], pa.binary()))
        self.of = np.unique(t["label"].to_numpy(), return_inverse=True)[1]
        alone = t["alone"].to_numpy(zero_copy_only=False).astype(bool)
        self.members, self.others = np.flatnonzero(~alone), np.flatnonzero(alone)
        self.sets = [np.frombuffer(x, np.uint64) for x in t["items"].to_pylist()]
        self.bucket = t["bucket"][0].as_py()

    def same(self, i: int, to: np.ndarray) -> np.ndarray:
        """How many shingles i shares with each of `to`."""
        own, size = self.sets[i], np.array([len(self.sets[j]) for j in to.tolist()])
        items = np.concatenate([self.sets[j] for j in to.tolist()])
        hit = own[np.minimum(np.searchsorted(own, items), len(own) - 1)] == items
        return np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)

    def links(self, threshold: float, bands: bool) -> list[tuple[int, int]]:
        """Links that join components; bands: leave pairs that share an earlier bucket to that one."""
        out = []
        before = None
        if bands:
            band = dart.bands(self.sig.astype(np.uint64)).view(np.int64)
            before = band[:, : int(np.flatnonzero((band == self.bucket).all(axis=0))[0])]
        held = set(self.cid[self.others].tolist())
        twice = np.array([c in held for c in self.cid[self.members].tolist()], bool)  # pairs of two of the others come up twice
        n = np.array([len(x) for x in self.sets])
        for i in self.others.tolist():
            to = self.members[(self.of[self.members] != self.of[i]) & ~(twice & (self.cid[self.members] < self.cid[i]))]
            to = to[(self.sig[to] == self.sig[i]).mean(axis=1) >= threshold - MARGIN - 1e-9] if len(to) else to
            if before is not None and len(to):
                to = to[~(before[to] == before[i]).any(axis=1)]
            if not len(to):
                continue
            same = self.same(i, to)
            for j in to[same >= threshold * (n[i] + n[to] - same) - 1e-9].tolist():
                if self.of[i] != self.of[j]:
                    out.append((int(self.cid[i]), int(self.cid[j])))
                    self.of[self.of == self.of[j]] = self.of[i]
        return out


def held(rows: DataFrame, texts: DataFrame, threshold: float, bands: bool) -> DataFrame:
    """Links (a, b) among rows (bucket, cid, label, alone): the rows that are alone are held against all rows of their bucket under other labels."""
    rows = rows.join(texts.select("cid", "size"), "cid")

    def chunks(size: Column, n: Column) -> Column:
        return F.greatest(F.ceil(size / CHUNK_BYTES), F.ceil(n / CHUNK), F.lit(1)).cast("bigint")

    alone = F.col("alone").cast("bigint")
    many = rows.groupBy("bucket").agg(chunks(F.sum("size"), F.count("*")).alias("m"), chunks(F.sum(F.col("size") * alone), F.sum(alone)).alias("o"))
    place = lambda what, n: F.pmod(F.xxhash64("cid", F.lit(what)), F.col(n))
    to = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("o") - 1), lambda x: F.struct(place("m", "m").alias("m"), x.alias("o"), F.lit(False).alias("alone")))
    by = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1), lambda x: F.struct(x.alias("m"), place("o", "o").alias("o"), F.lit(True).alias("alone")))
    many = settle(many, "chunks")  # a table of its own, so that the join may split a hot bucket
    dealt = rows.join(many, "bucket").select("bucket", "cid", "label", F.explode(F.when(F.col("alone"), F.concat(to, by)).otherwise(to)).alias("x")).select("bucket", "cid", "label", "x.*")
    dealt = dealt.join(texts.select("cid", "sig", "items"), "cid")

    def run(t: pa.Table) -> pa.Table:
        found = Meeting(t).links(threshold, bands)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return settle(dealt.groupBy("bucket", "m", "o").applyInArrow(run, "a bigint, b bigint"), "links")


def named(rows: DataFrame, label: DataFrame | None) -> DataFrame:
    """rows (cid, ...) with the component that each is in so far."""
    if label is None:
        return rows.withColumn("label", F.col("cid"))
    return rows.join(label, rows.cid == label.node, "left").withColumn("label", F.coalesce("root", "cid")).drop("node", "root")


def groups(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, found: Counter | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the group) and class_size of every row; with columns to keep, those and root, which names the group even where ids repeat."""
    spark = docs.sparkSession
    found = found if found is not None else Counter()
    own = settle(prints(docs, width, keep), "prints")
    classes = own.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("pick").alias("pick"), F.count("*").alias("n"), F.first("sig").alias("sig"))
    classes = settle(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    members = settle(own.select("doc_id", "key", *keep), "members")
    forget(spark, own)

    rows = banded(classes)
    shared = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    rows = settle(rows.join(shared, "band"), "bands")  # of classes that meet another
    texts = shingled(classes.join(rows.select("cid").distinct(), "cid", "left_semi").select("cid", "key", "pick", "sig"), docs, width)

    hub = rows.groupBy("cid").agg(F.sum("n").alias("hub"))
    label, links = None, None
    for k in range(ROUNDS):
        # In the first round the leader is the member that meets most others, as the text does that the others were made from.
        order = F.xxhash64("cid", F.lit(k)) if k else F.col("hub")
        lead = rows.join(hub, "cid").groupBy("band").agg(F.max(F.struct(order.alias("o"), "cid")).alias("x")).select("band", F.col("x.cid").alias("bucket"))
        meet = rows.join(lead, "band").select("bucket", "cid").distinct()
        meet = settle(named(meet, label).withColumn("alone", F.col("cid") == F.col("bucket")), "meet")
        new = held(meet, texts, threshold, False)
        n = new.count()
        found.update({"rounds": 1, "led": n})
        if not n and label is not None:
            break
        links = new if links is None else links.union(new)
        label = settle(components(links), "labels")

    own = named(rows.where("n > 2").select(F.col("band").alias("bucket"), "cid"), label)
    share = own.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    most = share.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("x"), F.count("*").alias("kinds")).where("kinds > 1").select("bucket", F.col("x.label").alias("most"))
    own = settle(own.join(most, "bucket").select("bucket", "cid", "label", (F.col("label") != F.col("most")).alias("alone")), "open")
    more = held(own, texts, threshold, True)
    found.update({"rest": more.count()})
    if found["rest"]:
        label = settle(components(links.union(more)), "labels")
    root = classes.select("cid", "key", "rep", "n").join(label, classes.cid == label.node, "left").select("key", "rep", "n", F.coalesce("root", "cid").alias("root"))
    group = root.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("n").alias("class_size"))
    names = settle(root.join(group, "root").select("key", "root", "class_id", "class_size"), "names")
    forget(spark, classes, rows, texts, own)
    return members.join(names, "key").select("doc_id", "class_id", "class_size", *(["root", *keep] if keep else []))
