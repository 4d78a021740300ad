"""The n-gram join, the kd-tree clustering and the tiered search against brute force, with every odd case."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plansmith.llm import kmeans, ngram_join, search

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = "doc_id bigint, text string, token string, cid int, key string, n int, root int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3) for i, t in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    """Variants of templates of all sizes near the threshold, common passages, and odd texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 6)))
    line = " ".join(word() for _ in range(12))
    out = []
    for size in (5, 9, 30, 60, 61, 200, 900):
        base = [word() for _ in range(size)]
        for _ in range(9):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, size // 22))):
                own[rng.randrange(size)] = word()
            out.append(" ".join(own[rng.randrange(2) :]))
    out += [line + " " + " ".join(word() for _ in range(rng.randrange(3, 9))) for _ in range(25)]
    out += [" ".join(word() for _ in range(40)) for _ in range(20)]
    out += [None, None, "", " \t\n", "one", "one", "One two", "one two three", "one two three four", "one\x0btwo\x1fthree four", "a b c d a b c d a b c d", "z" * 40_000, out[0].upper(), out[30] + "\n", " ".join(word() for _ in range(20_000))]
    rows = list(enumerate(out))
    return rows + [(None, out[3]), (None, "quite alone in the world it is"), (7, out[20]), (7, out[20]), rows[12]]


def plain_sets(rows, width):
    out = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER))
        out.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    return out


def plain_join(rows, width=4, percent=85):
    sets = plain_sets(rows, width)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((str(i), len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows))


def joined(df, **how):
    return sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.linked(df, **how).collect())


@pytest.mark.parametrize("tight", [False, True])
def test_join_is_the_brute_force(spark, rows, monkeypatch, tight):
    if tight:  # many blocks, buckets and chunks, and shingles that are frequent
        for name, value in {"BLOCK": 3000, "BUCKET": 500, "CHUNK": 3, "CHUNK_BYTES": 2000, "SHARE": 50, "LEAST": 8}.items():
            monkeypatch.setattr(ngram_join, name, value)
    assert joined(frame(spark, rows)) == plain_join(rows)


@pytest.mark.parametrize(("percent", "width"), [(60, 2), (97, 3), (100, 1)])
def test_join_at_other_thresholds(spark, rows, percent, width):
    some = rows[30:140]
    assert joined(frame(spark, some), percent=percent, width=width) == plain_join(some, width, percent)


def test_join_of_nothing_and_of_one_group(spark):
    assert joined(frame(spark, [])) == []
    same = [(k, " ".join(f"w{j}" if j != k % 40 else f"v{k}" for j in range(300))) for k in range(150)]  # 8 of 297 shingles differ
    assert {c for _, _, c in joined(frame(spark, same, 8))} == {0}


def test_verification_meets_each_pair_once(spark, rows, monkeypatch):
    """Within a task: counts of the pairs that reach the last step, by both phases."""
    import pyarrow as pa

    sets = [np.sort(np.array([int(hashlib.md5(repr(x).encode()).hexdigest()[:12], 16) & (1 << 40) - 1 for x in s], np.uint64)) for s in plain_sets(rows[:63], 4)]
    sets = [s for s in sets if len(s)]
    tokens = {t for s in sets for t in ngram_join.prefix(s, len(s), 85).tolist()}
    met = Counter()
    for token in sorted(tokens):
        own = [k for k, s in enumerate(sets) if token in ngram_join.prefix(s, len(s), 85).tolist()]
        t = pa.table({"cid": own * 2, "n": [len(sets[k]) for k in own] * 2, "label": own * 2, "alone": [True] * len(own) + [False] * len(own), "items": [sets[k].tobytes() for k in own] * 2, "token": [token] * 2 * len(own), "leader": pa.array([None] * 2 * len(own), pa.int64())})
        m = ngram_join.Meeting(t, 85)
        for i in m.others.tolist():
            for j in m.linked(i, m.members[m.cid[m.members] > m.cid[i]]).tolist():
                met[int(m.cid[i]), int(m.cid[j])] += 1
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * (same := len(np.intersect1d(sets[a], sets[b]))) >= 85 * (len(sets[a]) + len(sets[b]) - same)}
    assert set(met) == want and set(met.values()) <= {1}


# Clustering

def plain_clusters(rows, dims, k, rounds, scale=1024, salt="3:"):
    v = [(i, [math.floor(scale * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    name = lambda i: hashlib.sha256(f"{salt}{'' if i is None else i}".encode()).hexdigest()
    c = [e for _, e in sorted(v, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda e: min(range(len(c)), key=lambda j: (far(e, c[j]), j))
    for _ in range(rounds):
        by = {}
        for _, e in v:
            by.setdefault(near(e), []).append(e)
        c = [[sum(x) // len(by[j]) for x in zip(*by[j], strict=True)] if j in by else old for j, old in enumerate(c)]
    own = [(i, near(e), far(e, c[near(e)])) for i, e in v]
    inertia = Counter()
    for _, j, d in own:
        inertia[j] += d
    return sorted((str(i), j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in own)


def clustered(spark, rows, parts=3, **how):
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id bigint, embedding array<float>, cluster int, v string").repartition(parts)
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in kmeans.cluster(df, **how).collect())


def test_clusters_are_the_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=64) + 3 * (k % 5)).astype(np.float32).tolist()) for k in range(150)]
    rows += [(200, None), (201, [1.0] * 63), (202, [1.0] * 63 + [None]), (203, [float("nan")] * 64), (204, [float("inf")] + [0.0] * 63), (205, []), (None, rows[4][1]), (3, rows[9][1]), rows[5], rows[5]]
    monkeypatch.setattr(kmeans, "BLOCK", 37)
    monkeypatch.setattr(kmeans, "LEAF", 3)
    assert clustered(spark, rows) == plain_clusters(rows, 64, 8, 10)


def test_clusters_with_ties_and_few_vectors(spark):
    rng = np.random.default_rng(3)
    grid = [(k, [float(x) for x in rng.integers(0, 3, 2)]) for k in range(120)]  # many ties, equal centroids, empty clusters
    assert clustered(spark, grid, dims=2, scale=1) == plain_clusters(grid, 2, 8, 10, 1)
    assert clustered(spark, grid, dims=2, scale=1, k=20, rounds=3) == plain_clusters(grid, 2, 20, 3, 1)
    assert clustered(spark, grid[:3], dims=2) == plain_clusters(grid[:3], 2, 8, 10)
    assert clustered(spark, [(1, None)]) == [] and clustered(spark, grid[:0]) == []
    same = [(k, [0.5, -0.5]) for k in range(50)]
    assert clustered(spark, same, dims=2) == plain_clusters(same, 2, 8, 10)
    with pytest.raises(Exception, match="do not fit a long"):
        clustered(spark, [(1, [1e9, 0.0])], dims=2)


def test_trees_prune_without_a_change(monkeypatch):
    monkeypatch.setattr(kmeans, "LEAF", 4)
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(-40, 40, (300, 3)), rng.integers(-2, 2, (300, 3)) + 900])
    c = np.array([[0, 0, 0], [900, 900, 900], [0, 0, 0], [450, 450, 450], [-900, 0, 0]])
    tree = kmeans.Tree(v)
    n, s, label = kmeans.assigned(tree, v, c)
    want = kmeans.distances(v, c).argmin(axis=1)
    assert (label == want).all() and n.tolist() == np.bincount(want, minlength=5).tolist() and all((s[j] == v[want == j].sum(axis=0)).all() for j in range(5))
    whole = [k for k, left in kmeans.filtered(tree, c) if left.sum() == 1 and tree.count[k] > 4]
    assert whole  # nodes that were assigned at once


# Search

def plain_search(docs, items, top):
    terms = lambda t: [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))]
    own = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(w for _, c in own for w in c)
    out = []
    for item, t in items:
        scores = []
        for i, c in own:
            m = 50 + 50 * sum(c.values()) * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(t)) if c[w])
            if s > 0:
                scores.append((-s, 2**63 if i is None else i, i))
        out += [(str(item), r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    pool = [f"t{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(k, " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 60)))) for k in range(250)]
    docs += [(300, None), (301, ""), (302, "?!"), (None, docs[4][1]), (None, docs[4][1] + " t1"), (4, docs[4][1]), (5, docs[9][1].upper()), (303, " ".join(rng.choice(pool) for _ in range(30_000))), (304, "naïve-T1;T2 ЖЖ жж"), (305, "t2")]
    items = [(k, " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))) for k in range(25)]
    return docs, items + [(50, None), (51, ""), (52, "nowhere"), (None, "t1 t2 t2"), (3, items[3][1]), (3, "naïve ЖЖ")]


@pytest.mark.parametrize("how", [{}, {"block": 2000, "top": 7}, {"cuts": (), "top": 3}, {"cuts": (0.5, 0.2, 0.1, 0.01), "slice_bytes": 900, "block": 5000, "top": 1}])
def test_search_is_the_brute_force(spark, corpus, how):
    docs, items = corpus
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, score int, ids string").repartition(3)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, rank int")
    told = []
    got = sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in search.search(d, b, told=told, **how).collect()), key=str)
    assert got == plain_search(docs, items, how.get("top", 50))
    assert told[-1] == 0


def test_search_proves_items_in_high_tiers(spark):
    docs = [(k, "common words everywhere " + (f"rare{k % 3} " * 5 if k < 9 else "")) for k in range(400)]
    d, told = spark.createDataFrame(docs, "doc_id bigint, text string"), []
    b = spark.createDataFrame([(0, "rare1"), (1, "rare1 common")], "item_id bigint, text string")
    got = search.search(d, b, top=3, told=told).collect()
    assert [(r.item_id, r.doc_id) for r in sorted(got)] == [(i, k) for i in (0, 1) for k in (1, 4, 7)]
    assert told[0] < 2  # the rare term's documents are known after tier 0


def test_search_of_nothing(spark):
    d, b = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert search.search(d, b).count() == search.search(one, b).count() == search.search(d, one.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert search.search(d.union(spark.createDataFrame([(1, None)], d.schema)), one.withColumnRenamed("doc_id", "item_id")).where(F.col("score") > 0).count() == 0
