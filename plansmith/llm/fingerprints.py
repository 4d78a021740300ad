"""Operator 5: document fingerprints by one-permutation MinHash.

Each shingle is hashed once and falls in one of BINS bins, which keeps its smallest hash.  An empty bin takes the value of
the first full bin on a probe sequence of its own, fixed for all texts (optimal densification); the sequence visits every
bin, so it ends.  BITS low bits of each bin are stored, and likeness takes out their chance agreement.

Cases: a null or empty text, or one without words, has the fingerprint of nothing, which is like itself (1) and unlike all
else (0); a text of fewer than five words is one shingle; a null doc_id comes after all others in descending order; rows of
equal ids follow in text order; a single row is its own next document; texts of any length are read whole; an empty table
gives no rows; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts
from .text import U, Words, mix, shingles

WIDTH = 5
BINS = 256
BITS = 4
#: Bytes of text that one step holds, but for longer single texts.
STEP = 4 << 20


def probes(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and odd stride of each bin's probe sequence: with a power of two of bins, it visits them all."""
    rng = np.random.Generator(np.random.PCG64(20_240_229))
    return rng.integers(0, bins, bins), rng.integers(0, bins // 2, bins) * 2 + 1


def fingerprints(w: Words, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> list[bytes | None]:
    """Packed low-order bits of each row's bins; None without words."""
    h, at = shingles(w.hashes(), w.first, width)
    doc = np.searchsorted(w.first, at, "right") - 1
    shift = U(64 - (bins.bit_length() - 1))
    low = np.full(w.n_docs * bins, U(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(low, doc * bins + (h >> shift).astype(np.int64), h << U(bins.bit_length() - 1))
    low = low.reshape(w.n_docs, bins)
    full = low != U(0xFFFFFFFFFFFFFFFF)
    rows = np.flatnonzero(full.any(axis=1) & ~full.all(axis=1))
    at, stride = probes(bins)
    value, have = low[rows], full[rows]
    done = have.copy()
    for _ in range(bins):
        if not len(rows):
            break
        new = ~done & have[:, at]
        value = np.where(new, value[:, at], value)
        done |= new
        at = (at + stride) % bins
        if (over := done.all(axis=1)).any():
            low[rows[over]] = value[over]
            left = ~over
            rows, value, have, done = rows[left], value[left], have[left], done[left]
    some = full.any(axis=1)
    # Copies of one value in several bins get bits of their own, so chance agreement stays independent from bin to bin.
    kept = mix(low + np.arange(1, bins + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) & U((1 << bits) - 1)
    flat = ((kept[:, :, None] >> np.arange(bits, dtype=np.uint64)) & U(1)).astype(np.uint8).reshape(w.n_docs, -1)
    packed = np.packbits(flat, axis=1)
    return [x.tobytes() if s else None for x, s in zip(packed, some, strict=True)]


def likeness(a: bytes | None, b: bytes | None, bits: int = BITS) -> float:
    """An estimate of the Jaccard similarity, from 0 to 1: agreement less what chance gives."""
    if a is None or b is None:
        return float(a is b)
    x = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(-1, bits)
    same, chance = float((~x.any(axis=1)).mean()), 2.0**-bits
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def shown(fingerprint: bytes | None) -> str:
    return "" if fingerprint is None else fingerprint.hex()


def follow(docs: DataFrame, n_parts: int | None = None) -> DataFrame:
    """Rows dealt by ranges of descending doc_id into (part, halo, doc_id, text): each part is followed by the first row of the next one, its halo.

    The bounds are quantiles of the ids alone; the driver holds one id a part.
    """
    spark = docs.sparkSession
    n = n_parts or parts(spark)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = own.select("doc_id").where("doc_id IS NOT NULL")
    cuts = sorted(set(ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n)), reverse=True) if n > 1 else []
    cuts = [int(c) for c in cuts]
    # The part of an id: how many cuts are above it.
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.lit(len(cuts)) - rank_in(F.col("doc_id"), sorted(cuts)))
    own = own.withColumn("part", part.cast("int"))
    tops = own.select("part", "doc_id").groupBy("part").agg(F.max("doc_id").alias("top"), F.count("*").alias("n")).collect()
    order = sorted(r["part"] for r in tops)
    top = {r["part"]: r["top"] for r in tops}
    if not order:
        return own.select("part", F.lit(False).alias("halo"), "doc_id", "text")
    before = {p: order[k - 1] for k, p in enumerate(order)}  # the first part comes after the last
    known = [top[p] for p in order if top[p] is not None]
    halo = own.where(F.col("doc_id").isin(known)).groupBy("part", "doc_id").agg(F.min("text").alias("text"))
    if None in top.values():
        halo = halo.union(own.where("doc_id IS NULL").join(F.broadcast(spark.createDataFrame([(p,) for p in order if top[p] is None], "part int")), "part", "left_semi").groupBy("part", "doc_id").agg(F.min("text").alias("text")).select("part", "doc_id", "text"))
    to = F.element_at(F.create_map(*[F.lit(x) for p in order for x in (p, before[p])]), F.col("part"))
    return own.select("part", F.lit(False).alias("halo"), "doc_id", "text").union(halo.select(to.alias("part"), F.lit(True).alias("halo"), "doc_id", "text"))


def rank_in(c, cuts: list[int]):
    """How many of the sorted cuts are at or under c, by halving."""
    if not cuts:
        return F.lit(0)
    k = len(cuts) // 2
    return F.when(c >= cuts[k], F.lit(k + 1) + rank_in(c, cuts[k + 1 :])).otherwise(rank_in(c, cuts[:k]))


def edited(text: str, after: str) -> str:
    """The last half of the code points replaced by as many of the next text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare(docs: DataFrame, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of every text, its edited text, and its likeness to that and to the next document."""
    n = parts(docs.sparkSession)
    dealt = follow(docs, n).repartitionById(n, "part").sortWithinPartitions("part", "halo", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of one part; the last waits for its next
        size = 0

        def made(rows: list[tuple]) -> pa.RecordBatch:
            """rows: all but the last have their next after them."""
            texts = [r[3] for r in rows]
            new = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
            print_ = fingerprints(Words(pa.array(texts, pa.large_string())), width, bins, bits)
            new_print = fingerprints(Words(pa.array(new, pa.large_string())), width, bins, bits)
            out = list(zip(print_[:-1], print_[1:], new_print, strict=True))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[2] for r in rows[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
                    pa.array([shown(a) for a, _, _ in out]), pa.array([shown(c) for _, _, c in out]), pa.array([likeness(a, c, bits) for a, _, c in out], pa.float64()), pa.array([likeness(a, b, bits) for a, b, _ in out], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0]:  # another part; the last row held was a halo
                    if len(held) > 1:
                        yield made(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                if size > STEP and len(held) > 1:
                    yield made(held)
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield made(held)

    return dealt.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
