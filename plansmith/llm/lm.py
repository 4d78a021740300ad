"""Operator 1: language-model scores from a log-frequency Bloom filter.

Counts of words and of word pairs, taken over all training documents, are quantised to levels of a logarithmic scale.  The
filter holds (n-gram, 1), (n-gram, 2), ... up to its level, so the level of an n-gram is found by membership probes until one
fails.  The model interpolates the pair's and the word's estimates with a weight for each level of the first word's count,
chosen by leaving each training token out once.  Beside it, exact word counts give the base score.

Counting: each worker sorts and sums the n-gram hashes of its batches, and sends every bucket of hashes one block, so a
frequent n-gram costs a block one entry.  A bucket makes its own part of the filter and of the count table.  Both go to the
workers by broadcast while they fit TABLE bytes; larger ones are cut into shards of whole buckets, each applied to every
document in a pass of its own, carrying what has been found for each token.

Cases: a null or empty text is its end token alone; a null doc_id hashes as the empty text; without training documents all
counts are 0 and every token has the base's floor; repeated rows train and score as often as they stand; texts of any length
are read whole; an empty table gives no rows; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, parts, remainder, settle
from .text import GOLD, U, WHITE, Words, mix, slices

#: Levels a doubling of the count.
STEPS = 2
#: Bits of the filter for each of its entries, and the bits an entry sets.
BITS = 10
PROBES = 4
#: Bytes of filter and counts that are broadcast at once.
TABLE = 256 << 20
#: Tokens that a block sums up.
BLOCK = 1 << 20
END = U(0x6A09E667F3BCC909)
WORD = U(0xBB67AE8584CAA73B)
STEP = U(0x3C6EF372FE94F82B)
WEIGHTS = np.array([0.0, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.97])
LEVELS = 64 * STEPS


def level(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(STEPS * np.log2(count) + 1e-9).astype(np.int64)


#: The count that a level stands for: the geometric middle of the whole numbers it covers; 0 for none.
def middle(k: int) -> float:
    low = math.ceil(2 ** ((k - 1) / STEPS) - 1e-9)
    high = max(low, math.ceil(2 ** (k / STEPS) - 1e-9) - 1)
    return math.sqrt(low * high)


VALUE = np.array([0.0, *(middle(k) for k in range(1, LEVELS + 1))])


class Tokens:
    """Hashes of all tokens of a column, ends included, and of the pairs with the token before; a text begins after an end."""

    def __init__(self, column: pa.Array):
        w = Words(column, WHITE)
        self.counts = w.counts + 1
        ends = np.cumsum(self.counts) - 1
        self.word = np.full(int(self.counts.sum()), END)
        inner = np.ones(len(self.word), bool)
        inner[ends] = False
        self.word[inner] = w.hashes()
        before = np.concatenate([[END], self.word[:-1]])[: len(self.word)]
        before[np.concatenate([[0], ends[:-1] + 1])[: len(ends)]] = END
        self.pair = mix(before * GOLD + mix(self.word ^ STEP))
        self.first = np.concatenate([[0], ends + 1])


def bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)


def entries(gram: np.ndarray, k: np.ndarray | int) -> np.ndarray:
    return mix(gram + STEP * np.asarray(k, np.uint64))


def places(e: np.ndarray, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit word of each entry in a filter of `size` words, and its bits there."""
    bits = np.zeros(len(e), np.uint64)
    for k in range(PROBES):
        bits |= U(1) << (e >> U(6 * k) & U(63))
    return ((e >> U(32)) * np.asarray(size, np.uint64) >> U(32)).astype(np.int64), bits


def counted(docs: DataFrame, n: int) -> DataFrame:
    """kind (0: words, 1: pairs), bucket, hashes and counts, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                key, count = np.unique(np.concatenate([x[kind] for x in held]), return_counts=True)
                cut = np.searchsorted(bucket(key, n), np.arange(n + 1))
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind), pa.int64()), pa.array(some, pa.int64()), pa.array([key[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary()), pa.array([count[cut[k] : cut[k + 1]].astype(np.uint32).tobytes() for k in some], pa.binary())], ["kind", "bucket", "keys", "counts"])

        for batch in batches:
            for b in slices(batch, "text"):
                t = Tokens(b.column(0))
                held.append((t.word, t.pair))
                size += len(t.word)
                if size >= BLOCK:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return docs.select("text").mapInArrow(run, "kind bigint, bucket bigint, keys binary, counts binary")


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a bucket to its count table (kind 0) and its part of the filter (kind 2)."""
    held: dict[int, dict[int, list]] = {}
    for b in batches:
        for kind, own, keys, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held.setdefault(own, {0: [], 1: []})[kind].append((np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint32)))
    for own, by in held.items():
        out, rows = [], []
        for kind in (0, 1):
            if not by[kind]:
                continue
            keys, counts = (np.concatenate([x[i] for x in by[kind]]) for i in (0, 1))
            by[kind] = []
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order].astype(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, counts = keys[first], np.add.reduceat(counts, first)
            lv = level(counts.astype(float))
            gram = keys ^ WORD if kind == 0 else keys
            k = np.arange(int(lv.sum())) - np.repeat(np.cumsum(lv) - lv, lv) + 1
            out.append(entries(np.repeat(gram, lv), k))
            if kind == 0:
                wide = int(counts.max()) >> 32 > 0
                rows.append((0, own, len(keys), int(counts.sum()), 8 if wide else 4, keys.tobytes() + counts.astype(np.uint64 if wide else np.uint32).tobytes()))
        e = np.concatenate(out)
        size = max(1, -(-len(e) * BITS // 64))
        at, bits = places(e, size)
        order = np.argsort(at, kind="stable")
        at, bits = at[order], bits[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        words = np.zeros(size, np.uint64)
        words[at[first]] = np.bitwise_or.reduceat(bits, first)
        rows.append((2, own, len(e), 0, 8, words.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 5 + (pa.binary(),), strict=True)], ["kind", "bucket", "n", "total", "width", "payload"])


class Shard:
    """The counts and the filter of some buckets, as flat arrays that are filled bucket by bucket.

    sizes: (bucket, kind, n, width, bytes) of each row to come."""

    def __init__(self, rows: Iterator, n_buckets: int, sizes: list[tuple[int, int, int, int, int]]):
        self.n, self.own = n_buckets, np.zeros(n_buckets, bool)
        self.size, kinds = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)
        wide = any(width == 8 for _, kind, _, width, _ in sizes if kind == 0)
        for b, kind, n, _, size in sizes:
            self.own[b] = True
            if kind == 2:
                self.size[b] = size // 8
            else:
                kinds[b] = n
        self.start, first = np.cumsum(self.size) - self.size, np.cumsum(kinds) - kinds
        self.words, self.keys = np.zeros(int(self.size.sum()), np.uint64), np.zeros(int(kinds.sum()), np.uint64)
        self.counts = np.zeros(len(self.keys), np.uint64 if wide else np.uint32)
        for r in rows:
            b, x = r["bucket"], bytes(r["payload"])
            if r["kind"] == 2:
                self.words[self.start[b] : self.start[b] + self.size[b]] = np.frombuffer(x, np.uint64)
            else:
                at = slice(first[b], first[b] + kinds[b])
                self.keys[at] = np.frombuffer(x, np.uint64, r["n"])
                self.counts[at] = np.frombuffer(x, np.uint64 if r["width"] == 8 else np.uint32, r["n"], 8 * r["n"])

    def exact(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h), np.uint64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.counts[at], 0).astype(np.uint64)

    def levels(self, h: np.ndarray, salt: np.uint64) -> np.ndarray:
        """Probes of level after level until one fails."""
        out = np.zeros(len(h), np.uint8)
        b = bucket(h, self.n)
        size, start, gram = self.size[b], self.start[b], h ^ salt
        live = np.flatnonzero(size > 0)
        for k in range(1, LEVELS + 1):
            if not len(live):
                break
            at, bits = places(entries(gram[live], k), size[live])
            live = live[(self.words[start[live] + at] & bits) == bits]
            out[live] = k
        return out

    def __call__(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: its exact count, its level and its pair's, 0 where another shard has them."""
        own, back = np.unique(t.word, return_inverse=True)
        mine = self.own[bucket(own, self.n)]
        count, lv = np.zeros(len(own), np.uint64), np.zeros(len(own), np.uint8)
        count[mine], lv[mine] = self.exact(own[mine]), self.levels(own[mine], WORD)
        pair = np.zeros(len(t.pair), np.uint8)
        mine = np.flatnonzero(self.own[bucket(t.pair, self.n)])
        pair[mine] = self.levels(t.pair[mine], U(0))
        return count[back], lv[back], pair


class Model:
    """Totals, shards (broadcast) and the weights of pairs by the level of the word before."""

    def __init__(self, n_tokens: int, n_kinds: int, shards: list, weights: np.ndarray | None = None):
        self.n, self.v, self.shards = n_tokens, n_kinds, shards
        self.weights = weights if weights is not None else np.full(LEVELS + 1, 0.5)
        self.floor = self.n + 0.1 * (self.v + 1)


def before(t: Tokens, lv: np.ndarray, end: int) -> np.ndarray:
    """The level of the token before each one."""
    out = np.concatenate([[end], lv[:-1]])
    out[t.first[:-1]] = end
    return out


def sums(t: Tokens, x: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, t.first[:-1]) if len(t.first) > 1 else np.empty(0)


def applied(docs: DataFrame, shards: list, keep: list[str], finish, schema: str) -> DataFrame:
    """Every shard in turn over (keep, text); finish(batch, tokens, counts, levels, pair levels) makes the last one's rows.

    What shards before the last one find is written in between, so a worker holds one shard at a time."""
    columns = [*keep, "text"]
    out = docs.select(*columns)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    for k, sent in enumerate(shards):
        last = k == len(shards) - 1
        before, out = out, out.mapInArrow(stage(sent, k > 0, finish if last else None, len(columns)), schema if last else f"{kinds}, carried_ binary")
        if not last:
            out = settle(out, "carried")
            sent.unpersist()
            if k:
                forget(docs.sparkSession, before)
    return out


def stage(sent, carries: bool, finish, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = sent.value
        for batch in batches:
            for b in slices(batch, "text"):
                t = Tokens(b.column(width - 1))
                count, lv, pair = shard(t)
                if carries:
                    old = np.frombuffer(b"".join(b.column(width).to_pylist()), np.dtype([("c", "<u8"), ("l", "u1"), ("p", "u1")]))
                    count, lv, pair = count + old["c"], np.maximum(lv, old["l"]), np.maximum(pair, old["p"])
                if finish is not None:
                    yield finish(b, t, count, lv, pair)
                else:
                    now = np.empty(len(count), np.dtype([("c", "<u8"), ("l", "u1"), ("p", "u1")]))
                    now["c"], now["l"], now["p"] = count, lv, pair
                    yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array([now[i:j].tobytes() for i, j in zip(t.first[:-1], t.first[1:], strict=True)], pa.binary())], [*b.schema.names[:width], "carried_"])

    return run


def train(docs: DataFrame, n_buckets: int | None = None, table: int = TABLE) -> Model:
    """Count all training documents, build the filter, and choose the weights."""
    spark = docs.sparkSession
    n = n_buckets or 2 * parts(spark)
    built = settle(counted(docs, n).repartitionById(n, F.col("bucket").cast("int")).mapInArrow(summed, "kind bigint, bucket bigint, n bigint, total bigint, width bigint, payload binary"), "lm")
    sizes = built.select("bucket", "kind", "n", "total", "width", F.octet_length("payload").alias("bytes")).orderBy("bucket", "kind").collect()  # two rows a bucket
    shards: list[list] = [[]]
    size = 0
    for b in sorted({r["bucket"] for r in sizes}):
        own = [r for r in sizes if r["bucket"] == b]
        more = sum(r["bytes"] for r in own)
        if size and size + more > table:
            shards.append([])
            size = 0
        shards[-1] += own
        size += more
    sent = []
    for own in shards:
        part = built if len(shards) == 1 else built.where(F.col("bucket").isin([r["bucket"] for r in own]))
        sent.append(spark.sparkContext.broadcast(Shard(part.toLocalIterator(), n, [(r["bucket"], r["kind"], r["n"], r["width"], r["bytes"]) for r in own])))  # at most `table` bytes
    model = Model(sum(r["total"] for r in sizes), sum(r["n"] for r in sizes if r["kind"] == 0), sent)
    model.weights = weights(docs, model)
    return model


def weights(docs: DataFrame, model: Model) -> np.ndarray:
    """For each level of the word before, the weight under which training tokens, each left out of its counts, are likeliest."""
    floor, end = model.floor, end_level(docs)

    def finish(b: pa.RecordBatch, t: Tokens, count: np.ndarray, lv: np.ndarray, pair: np.ndarray) -> pa.RecordBatch:
        old = before(t, lv, end)
        p = np.where(pair > 1, np.minimum(np.maximum(VALUE[pair] - 1, 0) / np.maximum(VALUE[old] - 1, 1), 1.0), 0.0)
        q = (np.maximum(VALUE[lv] - 1, 0) + 0.1) / floor
        got = np.stack([np.bincount(old, np.log(w * p + (1 - w) * q), LEVELS + 1) for w in WEIGHTS], 1)
        some = np.flatnonzero(np.bincount(old, minlength=LEVELS + 1))
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(list(got[some]), pa.list_(pa.float64()))], ["level", "likely"])

    got = applied(docs, model.shards, [], finish, "level bigint, likely array<double>")
    rows = got.groupBy("level").agg(*(F.sum(F.col("likely")[k]).alias(f"w{k}") for k in range(len(WEIGHTS)))).collect()
    out = np.zeros(LEVELS + 1)
    for r in rows:
        out[r["level"]] = WEIGHTS[int(np.argmax([r[f"w{k}"] for k in range(len(WEIGHTS))]))]
    return out


def end_level(docs: DataFrame) -> int:
    n = docs.count()
    return int(level(np.array([float(n)]))[0]) if n else 0


def scores(docs: DataFrame, model: Model, end: int, keep: list[str]) -> DataFrame:
    """keep, n_tokens, n_known, train_tokens, base_score and score of every row."""
    floor, weight, n, kinds = model.floor, model.weights, model.n, ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def finish(b: pa.RecordBatch, t: Tokens, count: np.ndarray, lv: np.ndarray, pair: np.ndarray) -> pa.RecordBatch:
        old = before(t, lv, end)
        base = sums(t, np.log10((count.astype(float) + 0.1) / floor))
        w = weight[old]
        p = w * np.minimum(VALUE[pair] / np.maximum(VALUE[old], 1), 1.0) + (1 - w) * (VALUE[lv] + 0.1) / floor
        known = sums(t, (count > 0).astype(np.int64)).astype(np.int64)
        return pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(t.counts, pa.int64()), pa.array(known), pa.array(np.full(b.num_rows, n), pa.int64()), pa.array(base), pa.array(sums(t, np.log10(p)))], [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return applied(docs, model.shards, keep, finish, f"{kinds}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def held_out_scores(docs: DataFrame, mod: int = 10, table: int = TABLE) -> DataFrame:
    """Train on the rows whose crc32(doc_id) mod `mod` is not 0, and score all."""
    training = docs.where(remainder("doc_id", mod) != 0)
    model = train(training, table=table)
    out = scores(docs.select("doc_id", "text"), model, end_level(training), ["doc_id"])
    return out.select("doc_id", (remainder("doc_id", mod) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
