"""Spelling variants, nearest neighbours and hard negatives against brute force, and their odd rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.llm import hard_negatives as H
from docsieve.llm import nearest as A
from docsieve.llm.spelling import near_words, spelling_variants, vocabulary

# Spelling variants.


def one_edit(w: str, letters: str) -> set[str]:
    cut = {w[:i] + w[i + 1 :] for i in range(len(w))}
    put = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    return (cut | put | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}) - {w}


def variants(counts: dict[str, int], ratio: int = 10) -> dict:
    letters = "".join(sorted({c for w in counts for c in w}))
    near = {w: one_edit(w, letters) & counts.keys() for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def words(spark, counts):
    return spark.createDataFrame([*counts.items()], "word string, n long")


@pytest.mark.parametrize("crowd", [2, 64])
def test_variants_equal_brute_force(spark, crowd):
    rnd = random.Random(5)
    counts = {}
    for _ in range(300):
        w = "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 9)))
        counts[w] = rnd.choice([1, 2, 15, 30, 400])
    counts |= {"aaaaaaa": 3, "aaaaaaaa": 50, "aaaaaaaaa": 600, "x": 1, "xy": 10, "yx": 100, "prefix" + "q" * 500: 2, "prefix" + "q" * 501: 30}
    counts |= {f"common{c}{d}": 5 for c in "abcdefgh" for d in "abcdefgh"}
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants(words(spark, counts), crowd=crowd).collect()}
    want = variants(counts)
    assert got == want
    assert sum(f is not None for f, *_ in got.values()) > 30
    assert any(f and r != f for f, r, *_ in got.values())


def test_a_half_that_all_words_share_costs_no_square(spark):
    # 3,000 words in one key; rests are cut again until only pairs meet
    rnd = random.Random(1)
    counts = {"abcdefgh" + "".join(rnd.choice("ijklmnop") for _ in range(8)): 1 for _ in range(3000)}
    pairs = {(r["a"], r["b"]) for r in near_words(words(spark, counts)).select("a", "b").collect()}
    assert {frozenset(p) for p in pairs} == {frozenset((w, x)) for w in counts for x in one_edit(w, "ijklmnop") & counts.keys()}


def test_vocabulary_equals_a_plain_count(spark):
    texts = ["Ünïversal UNIVERSAL universal universal", "Montaña×montaña montañas, short ABCDEFG abcdefg", None, "", "12345 \n", "letters" * 3000, " ".join(f"example{c}" for c in "abcdefghijklmnop") * 9]
    rows = [(i % 50, texts[i % len(texts)], "n") for i in range(200)] + [(None, "without identity " * 40, "n")]
    got = {r["word"]: r["n"] for r in vocabulary(spark.createDataFrame(rows, "doc_id long, text string, n string")).collect()}
    want = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert "Ünïversal" in "".join(got) or "Ünïversal" in got


def test_no_words(spark):
    assert spelling_variants(vocabulary(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    assert spelling_variants(words(spark, {"lonely": 4})).collect()[0].asDict() == {"word": "lonely", "form": None, "root": "lonely", "n": 4, "n_near": 0, "form_n": None}


# Vectors.

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def clustered(n=1500, dim=12, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((9, dim))
    v = (centres[rng.integers(0, 9, n)] + 0.3 * rng.standard_normal((n, dim))).astype(np.float32)
    v[100:400] = v[100]  # copies
    v[400:700] = v[400] + 1e-3 * rng.standard_normal((300, dim)).astype(np.float32)  # near copies
    return v


def odd_rows(dim):
    nan, inf = float("nan"), float("inf")
    return [(9001, None, 1, ""), (9002, [], 1, ""), (9003, [0.0] * dim, 1, ""), (9004, [nan] * dim, 1, ""), (9005, [inf] + [1.0] * (dim - 1), 1, ""), (9006, [None] + [1.0] * (dim - 1), 1, ""), (None, [1.0] * dim, 1, "")]


def neighbours(v, ids, asked, k):
    out = {}
    for i in asked:
        d = np.sqrt(((v.astype(np.float64) - v[i].astype(np.float64)) ** 2).sum(axis=1))
        d[i] = np.inf
        out[ids[i]] = [(ids[j], d[j]) for j in np.lexsort((ids, d))[:k] if d[j] < np.inf]
    return out


@pytest.mark.parametrize(("sample", "leaf"), [(1 << 14, 64), (200, 8)])
def test_nearest_neighbours_recall(spark, sample, leaf):
    v = clustered()
    ids = np.arange(len(v))[::-1].copy()
    rows = [(int(i), x.tolist(), 1, "") for i, x in zip(ids, v)]
    # a row that is repeated, an id with a second vector, and vectors of another length
    rows += [rows[7], *odd_rows(12), (8002, [1.0, 2.0], 1, ""), (8003, [1.0, 2.5], 1, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = A.nearest_neighbours(df, F.col("id") % 20 == 0, sample=sample, leaf=leaf, trials=64).collect()
    want = neighbours(v, ids, np.flatnonzero(ids % 20 == 0), 10)
    of = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        of.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    pair = [of.pop(i, None) for i in (8002, 8003, 9000)]
    assert set(of) == set(want)
    for q, found in of.items():
        assert len(found) == 10 and q not in [i for i, _ in found]
        at = {ids[j]: float(s) for j, s in enumerate(np.sqrt(((v.astype(float) - v[len(v) - 1 - q].astype(float)) ** 2).sum(axis=1)))}
        assert all(s == at[i] for i, s in found)
        assert found == sorted(found, key=lambda x: (x[1], x[0]))
    assert np.mean([len({i for i, _ in of[q]} & {i for i, _ in want[q]}) for q in want]) / 10 >= 0.9
    assert pair == [None, None, None]


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, ""), (1, [0.0, 1.0], 1, ""), (20, [1.0, 0.0], 1, ""), (40, [1.0, 1.0, 1.0], 1, "")], SCHEMA)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in A.nearest_neighbours(df, F.col("id") % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 20, 0.0), (0, 2, 1, 2**0.5), (20, 1, 0, 0.0), (20, 2, 1, 2**0.5)]
    assert A.nearest_neighbours(df.where("false"), F.col("id") % 20 == 0).count() == 0
    assert A.nearest_neighbours(df, F.col("id") < 0).count() == 0


def test_a_queue_over_all_trees_is_in_order_and_complete():
    v = np.random.default_rng(2).standard_normal((500, 6))
    trees = [A.Tree.load(A.Tree.fit(v, 20, i).dump(), 6) for i in range(3)]
    found = A.walk(trees, [(0.0, i) for i in range(3)], v[3], 10**6)
    assert [p for *_, p in found] == sorted(p for *_, p in found)
    assert len({f[:2] for f in found}) == len(found) == sum(len(t.t) + 1 for t in trees)
    # the first leaves are those that the row itself went to
    assert {f[:2] for f in found[:3]} == {(i, int(t.route(v[3:4])[0])) for i, t in enumerate(trees)}
    assert A.walk(trees, [(0.0, i) for i in range(3)], v[3], 7) == found[:7]
    same = A.Tree.fit(np.ones((50, 6)), 20, 1)
    assert len(same.t) == 0 and not same.route(v).any()


def test_leaves_looked_at_are_the_first_of_the_queue():
    v = np.random.default_rng(7).standard_normal((600, 5))
    trees = [A.Tree.fit(v, 20, i) for i in range(3)]
    shares = [np.bincount(t.route(v), minlength=len(t.t) + 1) / len(v) for t in trees]
    every = A.walk(trees, [(0.0, i) for i in range(3)], v[3], 10**6)
    for share in (0.0, 0.2, 1.1, 2.95):
        far = A.Queue(trees, shares, v[3]).priority(share)
        assert {(i, leaf) for i, t in enumerate(trees) for leaf, p in t.priorities(v[3:4], np.zeros(1)) if p[0] <= far + 1e-12} == {x[:2] for x in every if x[2] <= far + 1e-12}
        assert sum(shares[i][leaf] for i, leaf, p in every if p <= far) >= share - 1e-9
        back = A.Queue(trees, shares, v[3]).shares(np.array([far]))[0]
        assert back <= share + 1e-9 and A.Queue(trees, shares, v[3]).priority(back) == pytest.approx(far)
    assert A.Queue(trees, shares, v[3]).priority(3.5) == np.inf
    # leaves that are split again hold all members once
    bits = A.entries(trees, v, np.full(len(v), np.inf))
    held = [m for i, m, asking, _ in A.reached(trees, v, 4, 2, v, np.full(len(v), np.inf), bits) if i == 1 and len(asking) == len(v)]
    assert sorted(np.concatenate(held)) == list(range(len(v))) and max(map(len, held)) <= 8


def test_vectors_are_stored_once_and_not_for_each_tree_or_query(spark, monkeypatch):
    # evenly laid vectors, so that a query looks at many leaves
    v = np.random.default_rng(3).standard_normal((6000, 24)).astype(np.float32)
    sizes, plain = [], A.stored

    def stored(df):
        out = plain(df)
        sizes.append(sum(Path(urlparse(f).path).stat().st_size for f in out.inputFiles()))
        return out

    monkeypatch.setattr(A, "stored", stored)
    df = spark.createDataFrame([(i, x.tolist(), 1, "") for i, x in enumerate(v)], SCHEMA)
    assert A.nearest_neighbours(df, F.col("id") % 100 == 0).count() == 600
    assert sum(sizes) < 3 * v.nbytes


def test_all_rows_come_where_there_are_no_more_than_asked_for(spark):
    v = np.random.default_rng(5).standard_normal((90, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = A.nearest_neighbours(df, F.col("id") % 45 == 0, k=100, leaf=8, trees=2, recall=0.5)
    assert {(r["query_id"], r["n"]) for r in got.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).collect()} == {(0, 89), (45, 89)}


def mined(rows, positives=5, negatives=5, low=80, high=100):
    rows = [(i, label, np.floor(256 * np.array(x, np.float64)).astype(np.int64)) for i, x, label in rows]
    out = []
    for a, label, q in rows:
        if a % 20:
            continue
        scores = sorted((-int(x @ q), i, k) for i, k, x in rows if i != a)
        for s, p, k in [t for t in scores if t[2] == label][:positives]:
            ok = [t for t in scores if t[2] != label and -low * s <= -100 * t[0] <= -high * s][:negatives]
            out += [(a, p, j + 1, i, -s, -t) for j, (t, i, _) in enumerate(ok)]
    return sorted(out)


@pytest.mark.parametrize(("block", "first"), [(1024, 4096), (16, 64)])
def test_hard_negatives_equal_brute_force(spark, block, first):
    v = clustered(900, 6, 8)
    rng = np.random.default_rng(1)
    label = rng.integers(0, 4, len(v))
    label[100:300] = 1
    plain = [(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, label))] + [(9003, [0.0] * 6, 2)]
    rows = [(*r, "") for r in plain] + [r for r in odd_rows(6) if r[0] not in (9003, 9002)] + [(9100, [1.0] * 6, None, ""), (9020, [1.0, 2.0], 1, ""), (9040, [1e9] * 6, 1, "")]
    df = spark.createDataFrame([*rows, rows[20], rows[3]], SCHEMA).repartition(5)
    got = H.hard_negatives(df, F.col("id") % 20 == 0, block=block, first=first).collect()
    assert sorted(tuple(r) for r in got) == mined(plain)
    assert len(got) > 500


def test_no_negatives(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, ""), (1, [1.0, 0.0], 1, ""), (2, [-1.0, 0.0], 2, "")], SCHEMA)
    anchors = F.col("id") % 100 == 0
    assert H.hard_negatives(df, anchors).count() == 0  # the other label scores too low
    assert H.hard_negatives(df.where("label = 1"), anchors).count() == 0
    assert H.hard_negatives(df.where("false"), anchors).count() == 0
    assert [tuple(r) for r in H.hard_negatives(df.union(df.selectExpr("7L", "embedding", "3", "rank").limit(1)), anchors).collect()] == [(0, 1, 1, 7, 65536, 65536)]
