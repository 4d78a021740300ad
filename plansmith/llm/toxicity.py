"""Operator 7: toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The trees and the lexicon are learned from at most `bound` labelled rows, those with the smallest hash of their id; every
text is then scored whole.  Labels, language, source and id are never features.

Cases: a null or empty text has all-zero features and is scored like any other; null labels are left out, and a document
with several labels takes the largest; without two classes to learn from, every score is the share of toxic labels (0
without any); repeated rows give repeated scores; an empty table gives no rows; texts of any length are read whole; columns that are not kept are not passed on, nor those named like the results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, settle, tidied
from .text import PLAIN, Words, slices

#: Rows that the classifier learns from, at most.
BOUND = 20_000
#: A start for the lexicon; the rest is learned.
SEED = ("idiot", "stupid", "moron", "loser", "trash", "scum", "worthless", "pathetic", "disgusting", "dumb", "fool", "jerk", "hate", "ugly")
YOU = ("you", "your", "youre", "u", "ur", "yourself", "du", "dich", "dir", "dein", "tu", "te", "toi", "vous", "usted", "ustedes")
NEAR = 5
#: Letters of a stem.
STEM = 5
NAMES = ("words", "letters", "lex_hits", "lex_share", "lex_weight", "lex_weight_share", "lex_most", "lex_kinds", "stem_hits", "stem_share", "stem_weight", "stem_most", "seed_share", "near_you", "you_share", "capitals", "shouted", "marks", "exclaim", "symbols", "runs", "odd_words", "digits")
CLASS = np.zeros(256, np.uint8)
CLASS[65:91], CLASS[97:123], CLASS[128:], CLASS[48:58] = 1, 2, 2, 3
CLASS[[33, 63]] = 4
CLASS[[ord(c) for c in ".,;:'\"()-"]] = 5
CLASS[[ord(c) for c in "*#$%&@_^~+=<>|\\/"]] = 6


@dataclass(frozen=True)
class Lexicon:
    """Weights of words and of stems (the first STEM bytes of longer words)."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


def hashed(words: list[str]) -> np.ndarray:
    return Words(pa.array(words, pa.string()), PLAIN).hashes() if words else np.empty(0, np.uint64)


class Features:
    def __init__(self, lexicon: Lexicon):
        def table(weights: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
            h = hashed(list(weights))
            order = np.argsort(h)
            return h[order], np.array(list(weights.values()), float)[order]

        self.lex, self.stem = table(lexicon.words), table(lexicon.stems)
        self.seed, self.you = np.sort(hashed(list(SEED))), np.sort(hashed(list(YOU)))

    @staticmethod
    def found(h: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are keys, and their places."""
        if not len(keys):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return keys[at] == h, at

    def __call__(self, column: pa.Array) -> np.ndarray:
        w = Words(column, PLAIN)
        n, h, doc, size = w.n_docs, w.hashes(), w.doc, w.end - w.start
        x = np.zeros((n, len(NAMES)))
        words = np.maximum(w.counts, 1)
        add = lambda mask, weight=None: np.bincount(doc[mask], None if weight is None else weight[mask], n)

        def most(mask: np.ndarray, weight: np.ndarray) -> np.ndarray:
            out = np.zeros(n)
            np.maximum.at(out, doc[mask], weight[mask])
            return out

        lex, at = self.found(h, self.lex[0])
        weight = self.lex[1][at] if len(self.lex[1]) else np.zeros(len(h))
        end = w.end.copy()
        w.end = np.minimum(w.end, w.start + STEM)
        s = w.hashes()
        w.end = end
        stem, at2 = self.found(s, self.stem[0])
        stem &= size > STEM
        stem_weight = self.stem[1][at2] if len(self.stem[1]) else np.zeros(len(h))
        seed, you = self.found(h, self.seed)[0], self.found(h, self.you)[0]
        kinds = np.unique(doc[lex] * (len(self.lex[0]) + 1) + at[lex]) // (len(self.lex[0]) + 1)
        # The nearest second person, looking both ways within the row.
        place = np.flatnonzero(you)
        insult = np.flatnonzero(lex | seed)
        near = np.zeros(len(insult), bool)
        if len(place):
            for side in (0, -1):
                k = np.clip(np.searchsorted(place, insult) + side, 0, len(place) - 1)
                near |= (np.abs(place[k] - insult) <= NEAR) & (doc[place[k]] == doc[insult])
        raw = np.frombuffer(w.source + b" ", np.uint8)
        kind = CLASS[raw]
        # Bytes of each class, runs of a mark, and the marks inside words.
        count = np.zeros((n, 7))
        edges = w.offsets
        for d in range(n):
            count[d] = np.bincount(kind[edges[d] : edges[d + 1]], minlength=7)
        row = lambda places: np.searchsorted(edges, places, "right") - 1
        mark = (kind[:-1] == 4) | (kind[:-1] == 6)
        run = np.flatnonzero(mark[1:] & mark[:-1]) if len(mark) > 1 else np.empty(0, np.int64)
        letter = (kind == 1) | (kind == 2)
        inside = np.flatnonzero(letter[:-2] & ((kind[1:-1] == 6) | (kind[1:-1] == 3)) & letter[2:]) if len(kind) > 2 else np.empty(0, np.int64)
        upper = np.concatenate([[0], np.cumsum(kind == 1)])
        shout = (size > 2) & (upper[w.end] - upper[w.start] == size)
        bytes_ = np.maximum(count.sum(1), 1)
        letters = np.maximum(count[:, 1] + count[:, 2], 1)
        hits, stems = add(lex), add(stem)
        columns = (
            np.log1p(w.counts), np.log1p(letters), np.log1p(hits), hits / words, np.log1p(np.maximum(add(lex, weight), 0)), add(lex, weight) / words, most(lex, weight), np.bincount(kinds, minlength=n)[:n],
            np.log1p(stems), stems / words, np.log1p(np.maximum(add(stem, stem_weight), 0)), most(stem, stem_weight), add(seed) / words, np.bincount(doc[insult[near]], minlength=n), add(you) / words,
            count[:, 1] / letters, add(shout) / words, count[:, 5] / bytes_, count[:, 4] / bytes_, count[:, 6] / bytes_, np.bincount(row(run), minlength=n)[:n] / bytes_, np.bincount(row(inside), minlength=n)[:n] / words, count[:, 3] / bytes_,
        )
        for k, c in enumerate(columns):
            x[:, k] = c
        x[w.counts == 0] = 0
        return x


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: upper ends of the blocks and their means."""
    order = np.argsort(score, kind="stable")
    xs, first = np.unique(score[order], return_index=True)
    ys, ws = np.add.reduceat(y[order].astype(float), first), np.diff(np.append(first, len(score))).astype(float)
    blocks: list[list[float]] = []
    for x, s, n in zip(xs, ys, ws, strict=True):
        blocks.append([x, s, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            x2, s2, n2 = blocks.pop()
            blocks[-1] = [x2, blocks[-1][1] + s2, blocks[-1][2] + n2]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Trees:
    """Boosted trees on the logistic loss, grown level by level over histograms of binned features."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 32, least: float = 5.0, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.prior = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)], 1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        rows, features = x.shape
        self.cuts = [np.unique(np.quantile(u if len(u := np.unique(x[:, k])) <= self.bins else x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(features)]
        b = self.binned(x)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.prior = math.log(p / (1 - p))
        f = np.full(rows, self.prior)
        for _ in range(self.n):
            q = 1 / (1 + np.exp(-f))
            g, w = q - y, np.maximum(q * (1 - q), 1e-6)
            nodes = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
            node = np.zeros(rows, np.int64)
            for level in range(self.depth + 1):
                base, width = 2**level - 1, 2**level
                own = node - base
                live = (own >= 0) & (own < width)
                gs, ws = np.bincount(own[live], g[live], width), np.bincount(own[live], w[live], width)
                value[base : base + width] = -self.rate * gs / (ws + self.ridge)
                if level == self.depth:
                    break
                gain, best = np.full(width, 1e-3), np.full((width, 2), -1)
                score = gs**2 / (ws + self.ridge)
                for k in range(features):
                    key = own[live] * self.bins + b[live, k]
                    gl = np.bincount(key, g[live], width * self.bins).reshape(width, -1).cumsum(1)[:, :-1]
                    wl = np.bincount(key, w[live], width * self.bins).reshape(width, -1).cumsum(1)[:, :-1]
                    gr, wr = gs[:, None] - gl, ws[:, None] - wl
                    got = gl**2 / (wl + self.ridge) + gr**2 / (wr + self.ridge) - score[:, None]
                    got[(wl < self.least * 0.1) | (wr < self.least * 0.1)] = 0
                    at = got.argmax(1)
                    top = got[np.arange(width), at]
                    better = top > gain
                    gain[better], best[better] = top[better], np.stack([np.full(width, k), at], 1)[better]
                feature[base : base + width], cut[base : base + width] = best[:, 0], best[:, 1]
                parted = live & (best[np.clip(own, 0, width - 1), 0] >= 0)
                i = node[parted]
                node[parted] = 2 * i + 1 + (b[parted, feature[i]] > cut[i])
            f += value[node]
            self.trees.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f = self.binned(x), np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                k = feature[node]
                inner = k >= 0
                node = np.where(inner, 2 * node + 1 + (b[rows, np.maximum(k, 0)] > cut[node]), node)
            f += value[node]
        return f


@dataclass
class Model:
    lexicon: Lexicon
    share: float
    trees: Trees | None = None
    ends: np.ndarray | None = None
    means: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        m = self.trees.margin(x)
        level = self.means[np.minimum(np.searchsorted(self.ends, m, "left"), len(self.ends) - 1)]
        return np.clip(0.99 * level + 0.01 / (1 + np.exp(-m)), 0, 1)  # a little of the margin parts equal levels


#: Bytes of text whose features are taken at once.
STEP = 1 << 20


def train(x: np.ndarray, y: np.ndarray, lexicon: Lexicon, folds: int = 4) -> Model:
    share = float(y.mean()) if len(y) else 0.0
    if not len(y) or y.min() == y.max() or len(y) < 2 * folds:
        return Model(lexicon, share)
    fold = np.arange(len(y)) % folds
    out = np.zeros(len(y))
    for k in range(folds):
        out[fold == k] = Trees().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    ends, means = isotonic(out, y)
    return Model(lexicon, share, Trees().fit(x, y), ends, means)


def learn_lexicon(sample: DataFrame, least: int = 4, significance: float = 24.0) -> Lexicon:
    """Words and stems whose documents are toxic far more often than chance (G-test), with their log-odds as weights."""
    total = sample.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    if not total["n"] or not total["t"] or total["t"] == total["n"]:
        return Lexicon()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, t = Counter(), Counter()
            for text, toxic in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = set((text or b"").translate(PLAIN).split())
                own = [(0, w) for w in words] + [(1, s) for s in {w[:STEM] for w in words if len(w) > STEM}]
                n.update(own)
                if toxic:
                    t.update(own)
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int64()), pa.array([w for _, w in keys], pa.binary()), pa.array([n[k] for k in keys], pa.int64()), pa.array([t[k] for k in keys], pa.int64())], ["kind", "word", "n", "t"])

    counts = sample.select("text", "toxic").mapInArrow(tidied(run), "kind bigint, word binary, n bigint, t bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where(F.col("t") >= least)
    share = total["t"] / total["n"]
    clean = F.col("n") - F.col("t")
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    g = 2 * (term(F.col("t"), F.col("n") * share) + term(clean, F.col("n") * (1 - share)))
    odds = F.log((F.col("t") + 0.5) / (total["t"] + 1.0)) - F.log((clean + 0.5) / (total["n"] - total["t"] + 1.0))
    rows = counts.select("kind", "word", g.alias("g"), odds.alias("odds")).where((F.col("g") >= significance) & (F.col("odds") > 0)).orderBy(F.desc("g"), "kind", "word").collect()  # `least` rows each: the bounded sample bounds them
    text = lambda r: bytes(r["word"]).decode("utf-8", "ignore")
    return Lexicon({text(r): r["odds"] for r in rows if r["kind"] == 0}, {text(r): r["odds"] for r in rows if r["kind"] == 1})


def learn(docs: DataFrame, labels: DataFrame, bound: int = BOUND, mod: int = 4, held: int = 2) -> Model:
    """Fit on at most `bound` labelled documents whose crc32(doc_id) mod `mod` is not `held`."""
    own = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", mod) != held)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("bigint")).alias("toxic"))
    rows = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).collect()  # bounded, and so is its broadcast
    spark = docs.sparkSession
    small = spark.createDataFrame([(r[0], r[1]) for r in rows], own.schema)
    # One row a doc_id, so that repeated ids keep to the bound: the one whose text has the smallest hash.
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(small), "doc_id")
    sample = settle(found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"), F.first("toxic").alias("toxic")).select("doc_id", "x.text", "toxic"), "toxic")
    lexicon = learn_lexicon(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lexicon)
        for batch in batches:
            for b in slices(batch, "text", STEP):
                x = features(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    got = sample.select("doc_id", "text", "toxic").mapInArrow(tidied(run), "doc_id bigint, toxic bigint, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # `bound` rows at most
    x = np.array([r["x"] for r in got]).reshape(len(got), len(NAMES))
    return train(x, np.array([r["toxic"] for r in got], float), lexicon)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """The score and the decision of every row, with the columns of `keep`."""
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in ("score", "predicted")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    columns = [*keep, *(["text"] if "text" not in keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.lexicon)
        for batch in batches:
            for b in slices(batch, "text", STEP):
                s = model.score(features(b.column(columns.index("text"))))
                own = [b.column(k) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.select(*columns).mapInArrow(tidied(run), f"{schema}, score double, predicted int")
