"""Operator 13: ranked lexical search over a tiered index.

The index is dealt by documents.  A block holds the postings of some documents in tiers: what a posting adds to a score, its
term's weight times its impact, decides its tier, so tier 0 has the rare terms and the strong places of others.  Each tier
is read by itself.  For every term a block notes the residual bound, the most that a posting of a lower tier adds.

A search reads tier 0 for all items.  A document's score lies between what was found and that plus the residual bounds of
the terms not found; the limit of an item is the least of the best `top` lower ends anywhere.  An item is proved where every
document that may reach the limit is known exactly; the others fall through to the next tier, where only documents
that may reach the limit so far come back.  The last tier knows all scores, so the result is exact.

Statistics cover all documents.  The items go to the workers in slices of checked size; a larger benchmark takes several.
Terms are told apart by 64 bits of hash.

Cases: null and empty texts have no terms and neither count nor appear; an item without known terms gets no rows; a repeated
item or document is ranked as often as it stands there; equal scores go by doc_id, a null one last; texts of any length are
read whole; empty tables give no rows; only ids and texts are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, settle, tidied
from .text import PLAIN, Words, slices

TOP = 50
#: A posting is in the first tier whose share of the largest possible contribution it reaches; the last takes the rest.
CUTS = (1 / 8, 1 / 32)
#: Bytes of text of a block, and of item text of a slice.
BLOCK, SLICE = 8 << 20, 4 << 20
FIELDS, KINDS = ("term", "first", "doc", "impact", "rest"), ("<i4", "<i4", "<i4", "<i4", "<i8")


@dataclass
class Items:
    """Items of a slice: ids, sorted hashes of their terms, and each item's terms as places among those."""

    ids: list
    terms: np.ndarray
    of: list[np.ndarray]


def items_of(rows: list) -> Items:
    w = Words(pa.array([r["text"] for r in rows], pa.string()))
    terms, place = np.unique(w.hashes(), return_inverse=True)
    return Items([r["item_id"] for r in rows], terms, [np.unique(place[w.first[i] : w.first[i + 1]]) for i in range(len(rows))])


def found(w: Words, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term (its place in `terms`) and occurrences of every term in every text."""
    h = w.hashes()
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    own = np.flatnonzero(terms[at] == h)
    both, tf = np.unique(w.doc[own] * len(terms) + at[own], return_counts=True)
    return both // len(terms), both % len(terms), tf


def statistics(docs: DataFrame, terms: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms with repeats, and the documents that hold each of `terms`."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        df, n, total = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for b in slices(batch, "text"):
                w = Words(b.column(0))
                n += int((w.counts > 0).sum())
                total += len(w.start)
                df += np.bincount(found(w, terms)[1], minlength=len(terms))
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], own])), pa.array(np.concatenate([[n, total], df[own]]))], ["term", "n"])

    rows = docs.select("text").mapInArrow(tidied(run), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()  # the slice's terms
    by = {r["term"]: r["n"] for r in rows}
    df = np.zeros(len(terms), np.int64)
    for t, n in by.items():
        if t >= 0:
            df[t] = n
    return by.get(-2, 0), by.get(-1, 0), df


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) if x else 0 for x in df], np.int64)


def impacts(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    m = 50 + (50 * length * n) // total
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def columns(tier: int) -> list[str]:
    return [f"{n}{tier}" for n in FIELDS]


def index(docs: DataFrame, terms: np.ndarray, w: np.ndarray, n: int, total: int, cuts: tuple[float, ...] = CUTS, block: int = BLOCK) -> DataFrame:
    """A row a block: ids of its documents, and for each tier t, in columns of their own so that a tier is read by itself,

    term<t>: the terms that the tier or a lower one has; doc<t>, impact<t>: the postings of term[k] from first<t>[k] on;
    rest<t>: by term, the most that lower tiers add."""
    sent = docs.sparkSession.sparkContext.broadcast((terms, w))
    limits = [c * 1_000_000 * int(w.max(initial=0)) for c in cuts]
    names = [c for t in range(len(limits) + 1) for c in columns(t)]

    def row(ids: list, parts: list) -> pa.RecordBatch:
        doc, term, impact = (np.concatenate(x) for x in zip(*parts, strict=True))
        gain = sent.value[1][term] * impact
        tier = np.searchsorted(-np.array(limits), -gain, "left")
        order = np.lexsort((doc, term, tier))
        doc, term, impact, gain, tier = (x[order] for x in (doc, term, impact, gain, tier))
        out = []
        for t in range(len(limits) + 1):
            a, b = np.searchsorted(tier, [t, t + 1])
            rest = np.zeros(len(terms), np.int64)
            np.maximum.at(rest, term[b:], gain[b:])
            own = np.unique(term[a:])
            first = np.searchsorted(term[a:b], np.append(own, len(terms)))
            out += [x.astype(kind).tobytes() for x, kind in zip((own, first, doc[a:b], impact[a:b], rest[own]), KINDS, strict=True)]
        every = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, pa.int64()))
        return pa.RecordBatch.from_arrays([every, *(pa.array([x], pa.binary()) for x in out)], ["ids", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value[0]
        ids, parts, size = [], [], 0
        for batch in batches:
            for b in slices(batch, "text", min(block, 4 << 20)):
                x = Words(b.column(1))
                doc, term, tf = found(x, terms)
                parts.append((doc + len(ids), term, impacts(tf, x.counts[doc], n, total)))
                ids += b.column(0).to_pylist()
                size += len(x.data)
                if size >= block:
                    yield row(ids, parts)
                    ids, parts, size = [], [], 0
        if parts:
            yield row(ids, parts)

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text IS NOT NULL")
    return own.mapInArrow(tidied(run), "ids array<bigint>" + "".join(f", {c} binary" for c in names))


class Tiers:
    """Some tiers of a block, for scoring."""

    def __init__(self, row: dict, tiers: int):
        self.ids = row["ids"].values
        self.tiers = [{n: np.frombuffer(row[c].as_buffer(), kind) for n, c, kind in zip(FIELDS, columns(t), KINDS, strict=True)} for t in range(tiers)]
        rank = np.argsort(np.array([2**63 - 1 if x is None else x for x in self.ids.to_pylist()], np.int64), kind="stable")
        self.rank = np.empty(len(rank), np.int64)  # by id, null last
        self.rank[rank] = np.arange(len(rank))

    def score(self, terms: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of all documents' scores for the terms of an item."""
        low = np.zeros(len(self.ids), np.int64)
        last = self.tiers[-1]
        at = np.searchsorted(last["term"], terms)
        at_in = np.minimum(at, max(len(last["term"]) - 1, 0))
        known = last["term"][at_in] == terms if len(last["term"]) else np.zeros(len(terms), bool)
        rest = np.where(known, last["rest"][at_in] if len(last["rest"]) else 0, 0)
        high = np.full(len(low), rest.sum())
        for t in self.tiers:
            for term, r in zip(terms.tolist(), rest.tolist(), strict=True):
                k = int(np.searchsorted(t["term"], term))
                if k < len(t["term"]) and t["term"][k] == term:
                    a, b = t["first"][k], t["first"][k + 1]
                    gain = w[term] * t["impact"][a:b].astype(np.int64)
                    low[t["doc"][a:b]] += gain
                    high[t["doc"][a:b]] += gain - r  # found here, so in no lower tier
        return low, high


def scored(blocks: DataFrame, tiers: int, items: Items, w: np.ndarray, limit: dict[int, int], top: int) -> DataFrame:
    """(item, doc_id, low, open) by the first `tiers` tiers: of each block the `top` documents with the best lower ends, among those that may reach the limit; in a row of its own, `open` tells how far a document that is not known exactly may get."""
    sent = blocks.sparkSession.sparkContext.broadcast((w, [(i, items.of[i], v) for i, v in sorted(limit.items())]))

    def answers(block: Tiers) -> pa.RecordBatch:
        w, asked = sent.value
        item, ids, lows, ends = [], [], [], []
        for i, terms, v in asked:
            low, high = block.score(terms, w)
            own = np.flatnonzero((high >= v) & (high > 0))
            if not len(own):
                continue
            own = own[np.lexsort((block.rank[own], -low[own]))]
            best = own[:top][low[own[:top]] > 0]
            item += [i] * (len(best) + 1)
            ids += [*best.tolist(), None]
            lows += [*low[best].tolist(), None]
            ends += [*[None] * len(best), int(high[own[high[own] > low[own]]].max(initial=0))]
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), block.ids.take(pa.array(ids, pa.int64())), pa.array(lows, pa.int64()), pa.array(ends, pa.int64())], ["item", "doc_id", "low", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield answers(Tiers({n: b.column(i)[k] for i, n in enumerate(b.schema.names)}, tiers))

    return blocks.select("ids", *(c for t in range(tiers) for c in columns(t))).mapInArrow(tidied(run), "item bigint, doc_id bigint, low bigint, open bigint")


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, cuts: tuple[float, ...] = CUTS, block: int = BLOCK, slice_bytes: int = SLICE, told: list | None = None) -> DataFrame:
    """item_id, rank, doc_id and score of the `top` best documents of every item; told gets the items left open after each tier."""
    spark = docs.sparkSession
    asked = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total_bytes = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    n_slices = max(1, -(-int(total_bytes) // slice_bytes))
    out = []
    for s in range(n_slices):
        some = asked if n_slices == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_slices)) == s)
        out += one_slice(docs, items_of(some.collect()), top, cuts, block, told)  # slice_bytes of text
    if not out:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    result = out[0]
    for df in out[1:]:
        result = result.union(df)
    return result


def one_slice(docs: DataFrame, items: Items, top: int, cuts: tuple[float, ...], block: int, told: list | None) -> list[DataFrame]:
    spark = docs.sparkSession
    if not len(items.terms):
        return []
    n, total, df = statistics(docs, items.terms)
    if not total:
        return []
    w = weights(n, df)
    whole = settle(index(docs, items.terms, w, n, total, cuts, block), "tiers")
    limit = dict.fromkeys(range(len(items.ids)), 0)
    names = spark.createDataFrame([(i, x) for i, x in enumerate(items.ids)], "item bigint, item_id bigint")
    by = Window.partitionBy("item").orderBy(F.desc("low"), F.asc_nulls_last("doc_id"))
    done = []
    for tier in range(len(cuts) + 1):
        rows = settle(scored(whole, tier + 1, items, w, limit, top), "scores")
        best = rows.where("low IS NOT NULL").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
        ends = best.groupBy("item").agg(F.count("*").alias("n"), F.min("low").alias("low"))
        rest = rows.groupBy("item").agg(F.max("open").alias("open"))
        state = {r["item"]: r for r in rest.join(ends, "item", "left").collect()}  # a row an item
        left = {}
        for i, r in state.items():
            v = r["low"] if r["n"] == top else 1
            if r["open"] and r["open"] >= v:
                left[i] = max(limit[i], v or 1)
        proved = [i for i in limit if i not in left]
        if told is not None:
            told.append(len(left))
        sure = spark.createDataFrame([(i,) for i in proved], "item bigint")
        done.append(best.join(F.broadcast(sure), "item").join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.col("low").alias("score")))
        limit = left
        if not left:
            break
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    out = settle(out, "ranked")
    forget(spark, whole)
    return [out]
