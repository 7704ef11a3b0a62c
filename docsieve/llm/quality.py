"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: round after round, each feature gets one shallow tree on its bins,
fitted to what the others leave, and adds it to its lookup table; then the pairs of
features whose rectangles explain most of the rest get tables of their own. A score
is the sum of table entries at a text's bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import col, small_batches, with_row
from ._text import NON_SPACE, batches, slices, word_hashes, word_spans

#: Bound of the labelled sample, in rows.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 12, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15

FEATURES = (
    "log_bytes", "upper", "lower", "digit", "stop", "mark", "bar", "symbol", "bracket", "wide", "newline",
    "word_length", "log_words", "distinct_words", "top_word", "repeated_next", "line_length", "distinct_lines", "alone_symbols", "words_per_stop",
)

_CLASS = np.zeros(256, np.int64)
for _i, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), b".", b",;:!?'\"-", b"|", b"#$%&*@^~+=_`", b"()[]{}<>/\\", range(128, 256), b"\n"), 1):
    _CLASS[list(_set)] = _i


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; all are finite, and an empty text has zeros."""
    docs = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(docs), size)
    kinds = np.bincount(doc * 11 + _CLASS[data], minlength=docs * 11).reshape(docs, 11) if len(data) else np.zeros((docs, 11))
    n = np.maximum(size, 1)
    starts, ends, first = word_spans(data, off, NON_SPACE)
    words = np.diff(first)
    w = np.maximum(words, 1)
    h = word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(docs), words)
    distinct, top = _distinct(owner, h, docs)
    again = np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=docs) if len(h) > 1 else np.zeros(docs)
    lines = np.ones(256, bool)
    lines[10] = False
    ls, le, lf = word_spans(data, off, lines)
    count = np.maximum(np.diff(lf), 1)
    line_owner = np.repeat(np.arange(docs), np.diff(lf))
    distinct_lines, _ = _distinct(line_owner, word_hashes(data, ls, le) if len(ls) else np.zeros(0, np.uint64), docs)
    odd = np.isin(_CLASS[data[starts]], (6, 7)) & (ends - starts == 1) if len(starts) else np.zeros(0, bool)
    alone = np.bincount(owner[odd], minlength=docs)
    k = kinds[:, 1:] / n[:, None]
    return np.column_stack([
        np.log1p(size), *(k[:, i] for i in range(10)), np.bincount(owner, ends - starts, docs) / w, np.log1p(words),
        distinct / w, top / w, again / w, np.log1p(size / count), distinct_lines / count, alone / w, np.log1p(words / (kinds[:, 4] + 1)),
    ])


def _distinct(owner: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document, and the count of its most frequent one."""
    if not len(h):
        return np.zeros(docs), np.zeros(docs)
    o = np.argsort(h)
    o = o[np.argsort(owner[o].astype(np.uint16 if docs < 1 << 16 else np.int64), kind="stable")]
    a, x = owner[o], h[o]
    head = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (a[1:] != a[:-1]))))
    length = np.diff(np.append(head, len(x)))
    top = np.zeros(docs)
    np.maximum.at(top, a[head], length)
    return np.bincount(a[head], minlength=docs).astype(float), top


@dataclass
class Model:
    """Bin edges and lookup tables."""

    edges: list[np.ndarray]
    bias: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)]).astype(np.int64)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.bias)
        for i, t in enumerate(self.tables):
            out += t[b[:, i]]
        for i, j, t in self.pairs:
            out += t[_coarse(b[:, i], self.edges[i]), _coarse(b[:, j], self.edges[j])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _coarse(b: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return b * PAIR_BINS // (len(edges) + 1)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Values of a tree of up to ``leaves`` leaves over ordered bins, split where the gain is largest."""
    gc, hc = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    worth = lambda a, b: (gc[b] - gc[a]) ** 2 / (hc[b] - hc[a] + 1.0)
    cuts = [0, len(g)]
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:]):
            m = np.arange(a + 1, b)
            if len(m):
                gain = worth(a, m) + worth(m, b) - worth(a, b)
                gain[(hc[m] - hc[a] < 0.5) | (hc[b] - hc[m] < 0.5)] = 0
                i = int(np.argmax(gain))
                best = max(best, (float(gain[i]), int(m[i])), key=lambda z: z[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    return np.concatenate([np.full(b - a, (gc[b] - gc[a]) / (hc[b] - hc[a] + 1.0)) for a, b in zip(cuts[:-1], cuts[1:])])


def _rectangles(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a grid in four, and the gain of it."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros_like(g)
    for i in range(len(g) - 1):
        for j in range(g.shape[1] - 1):
            q = [(gs[i, j], hs[i, j]), (gs[i, -1] - gs[i, j], hs[i, -1] - hs[i, j]), (gs[-1, j] - gs[i, j], hs[-1, j] - hs[i, j])]
            q.append((gs[-1, -1] - sum(x[0] for x in q), hs[-1, -1] - sum(x[1] for x in q)))
            gain = sum(a * a / (b + 5.0) for a, b in q) - gs[-1, -1] ** 2 / (hs[-1, -1] + 5.0)
            if gain > best:
                best = gain
                v = [a / (b + 5.0) for a, b in q]
                out = np.empty_like(g)
                out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosts one table after the other on (features, 0/1 labels); without both labels the score is constant."""
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for i in range(len(FEATURES))]
    p = (y.sum() + 1) / (len(y) + 2)
    model = Model(edges, float(np.log(p / (1 - p))), [np.zeros(len(e) + 1) for e in edges])
    if len(y) < 2 or y.min() == y.max():
        return model
    b = model.bins(x)
    z = np.full(len(y), model.bias)
    for _ in range(ROUNDS):
        for i, t in enumerate(model.tables):
            q = _sigmoid(z)
            step = RATE * _tree(np.bincount(b[:, i], y - q, len(t)), np.bincount(b[:, i], q * (1 - q), len(t)))
            t += step
            z += step[b[:, i]]
    coarse = [_coarse(b[:, i], e) for i, e in enumerate(edges)]
    grid = lambda i, j, v: np.bincount(coarse[i] * PAIR_BINS + coarse[j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    q = _sigmoid(z)
    gains = sorted(((_rectangles(grid(i, j, y - q), grid(i, j, q * (1 - q)))[0], i, j) for i in range(len(edges)) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            q = _sigmoid(z)
            step = RATE * _rectangles(grid(i, j, y - q), grid(i, j, q * (1 - q)))[1]
            t += step
            z += step[coarse[i], coarse[j]]
    return model


def _over(df: DataFrame, name: str, schema: str, make) -> DataFrame:
    small_batches(df.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            for at, data, off in slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(off) - 1), make(features(data, off))], names=["row", name])

    return df.select("row", "text").mapInArrow(run, with_row(df, f"{name} {schema}"))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from at most ``sample_rows`` labelled rows, taken in the order of the hashes of their ids.

    Labels that are null or neither 0 nor 1 teach nothing, and neither do ids that are
    null or in one of the tables only. An id with several labels or texts counts with
    each pair of them, within the bound. Without rows the score is constant. A very long
    text is one row like any other.
    """
    picked = labels.where(col(label_col).isin(0, 1) & col(id_col).isNotNull()).select(col(id_col).alias("id"), col(label_col).cast("int").alias("y")).distinct().orderBy(F.xxhash64("id"), "y").limit(sample_rows)
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(picked), "id").select(F.struct("id", "y").alias("row"), "text")
    # ids that repeat among the documents must not take more rows to the driver
    got = _over(rows, "x", "array<double>", lambda x: pa.array(list(x), pa.list_(pa.float64()))).select("row.id", "row.y", "x").orderBy(F.xxhash64("id"), "id", "y", "x").limit(sample_rows).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy(float))


def score_quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """One row per input row: ``row`` (a struct of all input columns) and ``score`` (0 to 1, higher: better).

    A null text is scored as an empty one, and a very long one whole. The model has a
    fixed size and is sent once. Repeated rows, null ids and clashing column names change
    nothing; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(text_col).alias("text"))
    return _over(packed, "score", "double", lambda x: pa.array(sent.value.score(x), pa.float64()))
