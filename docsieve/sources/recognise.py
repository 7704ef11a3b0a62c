"""The boundary to text recognisers: pages in, positioned lines out, errors as rows.

A recogniser gets an iterator of pandas frames (doc_id, page, content) and yields
frames in LINES; it loads its models once per worker. None is shipped but a fake one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .._ship import ship

LINES = "doc_id string, line_no int, page int, text string, x double, y double, w double, h double, origin string, conf double, alt string, error string"
Recogniser = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

REGISTRY: dict[str, Recogniser] = {}


def register(name: str, recogniser: Recogniser) -> None:
    REGISTRY[name] = recogniser


def plain_text(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads content as UTF-8 text, a line of the page for each of its lines; for tests."""
    for f in frames:
        out = []
        for doc, page, content in f.itertuples(index=False):
            try:
                lines = bytes(content).decode().split("\n")
                out += [(doc, i, page, t, 0.1, 0.02 * (i + 1), 0.8, 0.012, "ocr:plain", 1.0, None, None) for i, t in enumerate(lines)]
            except Exception as e:  # one bad page is a row, never a failed job
                out.append((doc, 0, page, None, None, None, None, None, "ocr:plain", None, None, type(e).__name__))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LINES.split(", ")])


register("plain", plain_text)


def recognise(pages: DataFrame, name: str) -> DataFrame:
    """Lines of (doc_id, page, content) by a registered recogniser."""
    ship(pages.sparkSession)
    return pages.select("doc_id", "page", "content").mapInPandas(REGISTRY[name], LINES)
