"""The fit of the quality model and the components of near vectors against plain versions."""

from __future__ import annotations

import numpy as np

from docsieve.llm import embedding_dedup as M
from docsieve.llm import quality as quality_model

from .test_similarity import components


def plain_scores(x, y):
    """Boosted tables by sums over the rows of every cut, one after the other; scores of the rows learned from."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, quality_model.BINS + 1)[1:-1])) for i in range(width)]
    bins = [np.array([sum(v >= e for e in edges[i]) for v in x[:, i]]) for i in range(width)]
    coarse = [b * quality_model.PAIR_BINS // (len(e) + 1) for b, e in zip(bins, edges)]
    p = (y.sum() + 1) / (n + 2)
    z = np.full(n, np.log(p / (1 - p)))
    slopes = lambda: (y - 1 / (1 + np.exp(-z)), (q := 1 / (1 + np.exp(-z))) * (1 - q))

    def worth(rows, g, h, ridge):
        return g[rows].sum() ** 2 / (h[rows].sum() + ridge)

    def tree(b, size, g, h):
        parts = [(0, size)]
        while len(parts) < 4:
            best, cut = 1e-9, None
            for lo, hi in parts:
                for m in range(lo + 1, hi):
                    left, right = (b >= lo) & (b < m), (b >= m) & (b < hi)
                    if min(h[left].sum(), h[right].sum()) < 0.5:
                        continue
                    gain = worth(left, g, h, 1.0) + worth(right, g, h, 1.0) - worth(left | right, g, h, 1.0)
                    if gain > best:
                        best, cut = gain, (lo, m, hi)
            if cut is None:
                break
            parts.remove((cut[0], cut[2]))
            parts = sorted([*parts, cut[:2], cut[1:]])
        out = np.zeros(n)
        for lo, hi in parts:
            rows = (b >= lo) & (b < hi)
            out[rows] = g[rows].sum() / (h[rows].sum() + 1.0)
        return out

    def quarters(a, b, g, h):
        best, out = 0.0, np.zeros(n)
        for i in range(quality_model.PAIR_BINS - 1):
            for j in range(quality_model.PAIR_BINS - 1):
                four = [(a <= i) & (b <= j), (a <= i) & (b > j), (a > i) & (b <= j), (a > i) & (b > j)]
                gain = sum(worth(r, g, h, 5.0) for r in four) - worth(np.ones(n, bool), g, h, 5.0)
                if gain > best + 1e-12:
                    best, out = gain, sum(np.where(r, g[r].sum() / (h[r].sum() + 5.0), 0) for r in four)
        return best, out

    for _ in range(quality_model.ROUNDS):
        for i in range(width):
            z = z + quality_model.RATE * tree(bins[i], len(edges[i]) + 1, *slopes())
    g, h = slopes()
    ranked = sorted(((quarters(coarse[i], coarse[j], g, h)[0], i, j) for i in range(width) for j in range(i)), reverse=True)[: quality_model.PAIRS]
    for _ in range(quality_model.PAIR_ROUNDS):
        for _, i, j in ranked:
            z = z + quality_model.RATE * quarters(coarse[i], coarse[j], *slopes())[1]
    return 1 / (1 + np.exp(-z)), {(i, j) for _, i, j in ranked}


def test_the_fit_equals_plain_sums(monkeypatch):
    for name, value in (("ROUNDS", 3), ("PAIR_ROUNDS", 2), ("PAIRS", 3), ("BINS", 10), ("PAIR_BINS", 5)):
        monkeypatch.setattr(quality_model, name, value)
    rng = np.random.default_rng(11)
    x = rng.standard_normal((90, len(quality_model.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3) | (x[:, 2] > 1)).astype(float)
    want, pairs = plain_scores(x, y)
    model = quality_model.fit(x, y)
    assert {(i, j) for i, j, _ in model.pairs} == pairs
    assert np.abs(model.score(x) - want).max() < 1e-9 and want.std() > 0.02


def test_links_and_components_just_over_the_threshold(spark):
    """No false link, nearly all true ones, and the components of just the links that are there."""
    rng = np.random.default_rng(5)
    data = []
    for c in range(60):
        centre = rng.standard_normal(64)
        for _ in range(12):
            data.append((len(data), [float(v) for v in centre + rng.uniform(0.2, 0.34) * rng.standard_normal(64)], c % 4))
    ids = [i for i, _, _ in data]
    unit = np.array([v for _, v, _ in data])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    labels = np.array([k for _, _, k in data])
    pair = (unit @ unit.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(pair, False)
    near = (np.abs(unit @ unit.T - 0.93) < 0.02) & (labels[:, None] == labels)
    assert pair.sum() > 1000 and near.sum() > 1000
    got = {r["id"]: r for r in M.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()}
    links = np.array([got[i]["n_links"] for i in ids])
    assert set(got) == set(ids) and (links <= pair.sum(axis=1)).all() and links.sum() >= 0.99 * pair.sum()
    want = components(ids, list(zip(*np.nonzero(pair))))
    # a lost link may part a component, and nothing may join two
    assert all(want[got[i]["component_id"]] == want[i] for i in ids) and all(got[i]["component_id"] <= i for i in ids)
    whole = {c for c in set(want.values()) if all(links[i] == pair[i].sum() for i in ids if want[i] == c)}
    assert len(whole) >= 0.9 * len(set(want.values())) and all(got[i]["component_id"] == want[i] for i in ids if want[i] in whole)
