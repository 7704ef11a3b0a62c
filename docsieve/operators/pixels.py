"""Photo metrics from pixels, for quality.levels(). They follow the usual definitions; resampling differs from image
libraries, so values agree in order and size, not to the last digit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .._ship import ship

#: Widths to which a photo or a zone is brought before its sharpness is measured.
WIDTH = {"global": 1000, "mrz": 900, "documento": 1000}
BURNT, DARK, WHITE, COLOURLESS, LEAST_BLOB = 250, 30, 250, 30, 0.0005


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of a BGR image."""
    return image[..., :3] @ np.array([0.114, 0.587, 0.299]) if image.ndim == 3 else image.astype(float)


def to_width(g: np.ndarray, width: int) -> np.ndarray:
    """Means of areas when it gets smaller, linear when it gets larger."""
    h, w = g.shape
    height = max(1, round(h * width / w))

    def along(a: np.ndarray, n: int) -> np.ndarray:
        m = len(a)
        edge = np.linspace(0, m, n + 1)
        if n >= m:
            at = np.clip((edge[:-1] + edge[1:]) / 2 - 0.5, 0, m - 1)
            lo = np.minimum(at.astype(int), max(m - 2, 0))
            part = (at - lo)[:, None]
            return a[lo] * (1 - part) + a[np.minimum(lo + 1, m - 1)] * part
        c = np.concatenate([np.zeros((1, a.shape[1])), np.cumsum(a, axis=0)])
        lo = np.minimum(edge.astype(int), m - 1)
        whole = c[lo] + a[lo] * (edge - lo)[:, None]
        return np.diff(whole, axis=0) / np.diff(edge)[:, None]

    return along(along(g, height).T, width).T


def sharpness(g: np.ndarray, width: int) -> float:
    """Variance of the Laplacian at a fixed width."""
    g = np.pad(to_width(g.astype(float), width), 1, mode="reflect" if min(g.shape) > 1 else "edge")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def blobs(mask: np.ndarray) -> np.ndarray:
    """Areas of 8-connected regions, by joining runs of neighbouring rows."""
    pad = np.pad(mask.astype(np.int8), ((0, 0), (1, 1)))
    row, start = np.nonzero(np.diff(pad, axis=1) == 1)
    _, end = np.nonzero(np.diff(pad, axis=1) == -1)
    root = np.arange(len(row))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    for r in range(1, mask.shape[0]):
        i, j = first[r - 1], first[r]
        while i < first[r] and j < first[r + 1]:
            if start[i] <= end[j] and start[j] <= end[i]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    return np.bincount([find(i) for i in range(len(row))], end - start).astype(int) if len(row) else np.zeros(0, int)


def glare(image: np.ndarray) -> float:
    """The largest white spot without colour, as a share of the area; spots under LEAST_BLOB do not count."""
    if image.ndim == 2:
        image = np.repeat(image[..., None], 3, axis=2)
    top, low = image[..., :3].max(axis=2).astype(int), image[..., :3].min(axis=2).astype(int)
    mask = np.pad((top >= WHITE) & ((top - low) * 255 <= COLOURLESS * np.maximum(top, 1)), 1, constant_values=True)
    shifts = lambda m, f: f.reduce([m[a : m.shape[0] - 2 + a, b : m.shape[1] - 2 + b] for a in range(3) for b in range(3)])
    eroded = shifts(mask, np.logical_and)
    opened = shifts(np.pad(eroded, 1), np.logical_or)
    area = blobs(opened)
    area = area[area >= opened.size * LEAST_BLOB]
    return float(area.max() / opened.size) if len(area) else 0.0


def metrics(image: np.ndarray, zone: str = "global", line_height: float | None = None) -> dict[str, float]:
    g = np.rint(grey(image))
    m = {"nitidez": sharpness(g, WIDTH[zone]), "brillo_bajo": g.mean(), "brillo_alto": g.mean(), "quemados": (g > BURNT).mean(), "contraste": g.std(), "reflejo": glare(image)}
    if zone != "mrz":
        m |= {"oscuros": (g < DARK).mean(), "lado_min_px": min(g.shape)}
    if zone == "documento":
        # white paper is no glare, and telling the two apart needs the sheet's own ground
        del m["reflejo"]
        if line_height is not None:
            m["altura_letra_px"] = round(line_height, 1)
    elif zone == "mrz" and line_height is not None:
        m["altura_linea_px"] = line_height / 3
    return {k: round(float(v), 4) for k, v in m.items()}


def measured(images: DataFrame, zone: str = "global") -> DataFrame:
    """(photo_id, zone, metric, value) of images as Spark's image source has them: photo_id, height, width, nChannels, data.

    An image that could not be decoded (height below 1) gives no rows. One image is in memory at a time.
    """
    ship(images.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for photo, h, w, c, data in f.itertuples(index=False):
                if h is None or h < 1 or w < 1:
                    continue
                image = np.frombuffer(data, np.uint8).reshape(h, w, c)
                yield pd.DataFrame([(photo, zone, k, v) for k, v in metrics(image if c > 1 else image[..., 0], zone).items()], columns=["photo_id", "zone", "metric", "value"])

    return images.select("photo_id", "height", "width", "nChannels", "data").mapInPandas(run, "photo_id string, zone string, metric string, value double")
