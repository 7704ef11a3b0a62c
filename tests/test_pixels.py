"""Photo metrics move as they should, and words become lines."""

from __future__ import annotations

import numpy as np

from docsieve.operators import pixels, words


def photo(seed=0, h=300, w=400):
    return np.random.default_rng(seed).integers(40, 200, (h, w, 3)).astype(np.uint8)


def blur(image):
    p = np.pad(image.astype(float), ((2, 2), (2, 2), (0, 0)), mode="edge")
    return np.mean([p[a : a + image.shape[0], b : b + image.shape[1]] for a in range(5) for b in range(5)], axis=0).astype(np.uint8)


def test_metrics_are_monotone():
    a = photo()
    assert pixels.metrics(blur(a))["nitidez"] < pixels.metrics(a)["nitidez"]
    assert pixels.metrics(a // 4)["brillo_bajo"] < pixels.metrics(a)["brillo_bajo"] and pixels.metrics(a // 8)["oscuros"] > 0.9
    white = a.copy()
    white[50:120, 60:160] = 255
    assert abs(pixels.glare(white) - 70 * 100 / (300 * 400)) < 1e-9 and pixels.glare(a) == 0
    assert pixels.metrics(white)["quemados"] > 0.05 and pixels.metrics(a)["lado_min_px"] == 300


def test_blobs():
    m = np.array([[1, 1, 0, 0, 1], [0, 0, 1, 0, 1], [0, 0, 0, 0, 0], [1, 0, 0, 1, 0]], bool)
    assert sorted(pixels.blobs(m).tolist())[-2:] == [2, 3] and pixels.blobs(np.zeros((3, 3), bool)).tolist() == []


def test_width_keeps_the_mean():
    g = photo()[..., 0].astype(float)
    assert abs(pixels.to_width(g, 100).mean() - g.mean()) < 0.5 and pixels.to_width(g, 800).shape == (600, 800)


def test_measured(spark):
    a = photo(h=40, w=60)
    df = spark.createDataFrame([("p", 40, 60, 3, a.tobytes()), ("q", -1, -1, -1, b"")], "photo_id string, height int, width int, nChannels int, data binary")
    rows = pixels.measured(df).collect()
    assert {r["photo_id"] for r in rows} == {"p"} and {r["metric"] for r in rows} >= {"nitidez", "reflejo", "contraste"}


def test_words(spark):
    w = [("d", 1, 1, 1, 1, 1, "uno", 0, 0, 30, 10, 90.0), ("d", 1, 1, 1, 1, 2, "dos", 35, 0, 30, 10, 70.0), ("d", 1, 1, 1, 1, 3, "lejos", 200, 2, 30, 10, 50.0), ("d", 1, 1, 1, 1, 4, " ", 240, 0, 5, 10, 95.0), ("d", 1, 1, 1, 2, 1, "no", 0, 20, 5, 10, -1.0)]
    got = sorted((r["part"], r["text"], r["x"], r["w"], r["conf"]) for r in words.lines_of_words(spark.createDataFrame(w, "doc_id string, page int, block int, par int, line int, word_no int, text string, left int, top int, width int, height int, conf double")).collect())
    assert got == [(0, "uno dos", 0, 65, 0.8), (1, "lejos", 200, 30, 0.5)]
