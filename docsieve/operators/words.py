"""Lines out of the words that recognisers return, and out of the pieces of a text layer."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .._ship import ship

#: A gap of more than so many heights starts another column.
GAP = 2.5
#: Pieces of a row less than so many heights apart are one line, in a text layer and among loose words.
NEAR = 1.5
#: Heights of pixels in which loose lines count as level.
LEVEL = 15


def lines_of_words(words: DataFrame) -> DataFrame:
    """(doc_id, page, block, par, line, part, text, x, y, w, h, conf): words of a line in their order, split at wide gaps.

    words: doc_id, page, block, par, line, word_no, text, left, top, width, height, conf (0 to 100).
    Blank words and those without confidence go. A lag and a running sum number the parts.
    """
    keys = ("doc_id", "page", "block", "par", "line")
    w = Window.partitionBy(*keys).orderBy("word_no")
    good = words.where((F.trim("text") != "") & (F.col("conf") >= 0))
    gap = F.col("left") - F.lag(F.col("left") + F.col("width")).over(w) > GAP * F.greatest(F.lag("height").over(w), F.lit(1))
    parted = good.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("part", F.sum("_new").over(w))
    got = parted.groupBy(*keys, "part").agg(
        F.array_sort(F.collect_list(F.struct("word_no", F.trim("text").alias("text")))).alias("t"), F.min("left").alias("x"), F.min("top").alias("y"),
        F.max(F.col("left") + F.col("width")).alias("x2"), F.max(F.col("top") + F.col("height")).alias("y2"), F.bround(F.avg("conf") / 100, 3).alias("conf"),
    )
    return got.select(*keys, "part", F.array_join(F.transform("t", lambda s: s["text"]), " ").alias("text"), "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"), "conf")


def box_order(lines: DataFrame) -> DataFrame:
    """Adds ``place`` to (doc_id, x, y, h, …) in pixels: by tens of the centre's height, half to even, then from the left."""
    w = Window.partitionBy("doc_id").orderBy(F.bround((F.col("y") + F.col("h") / 2) / 10), "x")
    return lines.withColumn("place", F.row_number().over(w))


def merged_segments(segments: DataFrame) -> DataFrame:
    """(doc_id, page, part, text, x0, y0, x1, y1): pieces of a text layer, in points from the bottom left, put together in their rows.

    segments: doc_id, page, text, x0, y0, x1, y1. A page is one row with an array of its
    pieces; the fold carries the line that is being put together.
    """
    d = segments.where(F.trim("text") != "").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct((-F.bround((F.col("y0") + F.col("y1")) / 2)).alias("k"), "x0", "y0", "x1", "y1", F.trim("text").alias("text")))).alias("s"))
    line = "struct<text:string,x0:double,y0:double,x1:double,y1:double>"

    def step(a: Column, z: Column) -> Column:
        u, tall = F.element_at(a, -1), F.greatest(z["y1"] - z["y0"], F.lit(1.0))
        gap = z["x0"] - u["x1"]
        joins = (F.size(a) > 0) & (F.abs((u["y0"] + u["y1"]) / 2 - (z["y0"] + z["y1"]) / 2) < 0.5 * F.greatest(tall, u["y1"] - u["y0"])) & (gap >= 0) & (gap < NEAR * tall)
        one = lambda text, x0, y0, x1, y1: F.struct(text.alias("text"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))
        longer = one(F.concat(u["text"], F.lit(" "), z["text"]), u["x0"], F.least(u["y0"], z["y0"]), z["x1"], F.greatest(u["y1"], z["y1"]))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(longer))).otherwise(F.array_append(a, one(z["text"], z["x0"], z["y0"], z["x1"], z["y1"])))

    merged = F.aggregate("s", F.array().cast(f"array<{line}>"), lambda a, z: F.when(F.size(a) == 0, F.array(F.struct(z["text"].alias("text"), *[z[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]))).otherwise(step(a, z)))
    return d.select("doc_id", "page", F.posexplode(merged).alias("part", "l")).select("doc_id", "page", "part", "l.*")


#: Words of a page up to which its lines are looked through one by one.
FEW = 48


def _first_fit(boxes: list[tuple], x: float, y: float, h: float) -> int:
    """The first line that a word stands right behind; -1 without one."""
    for i, (lx, ly, lw, lh) in enumerate(boxes):
        tall, gap = max(lh, h), x - lx - lw
        if abs(y + h / 2 - ly - lh / 2) < tall * 0.5 and 0 <= gap < tall * NEAR:
            return i
    return -1


def _first_fit_of_many(boxes: np.ndarray, x: float, y: float, h: float) -> int:
    tall, gap = np.maximum(boxes[:, 3], h), x - boxes[:, 0] - boxes[:, 2]
    fits = np.flatnonzero((np.abs(y + h / 2 - boxes[:, 1] - boxes[:, 3] / 2) < tall * 0.5) & (gap >= 0) & (gap < tall * NEAR))
    return int(fits[0]) if len(fits) else -1


def _from_the_top(boxes: list[tuple]) -> list[int]:
    levels = [(y + h / 2) / LEVEL for _, y, _, h in boxes]
    if not all(map(math.isfinite, levels)) or any(math.isnan(b[0]) for b in boxes):
        return np.lexsort(([b[0] for b in boxes], np.rint(levels))).tolist()
    return sorted(range(len(boxes)), key=lambda i: (round(levels[i]), boxes[i][0]))


def _mean(a: list[float]) -> float:
    if len(a) > 7:
        return float(np.mean(a))
    # added one by one, as numpy does up to there; sum() would carry what is rounded
    total = 0.0
    for v in a:
        total += v
    return total / len(a)


def sparse_lines(words: DataFrame) -> DataFrame:
    """(doc_id, page, place, text, x, y, w, h, conf): loose words, each put on the first line it stands right behind.

    words: doc_id, page, text, x, y, w, h in pixels, conf. Words are taken from the top; a
    page, which has some thousand words at most, is put together at once.
    """
    ship(words.sparkSession)

    def page(found: list[dict]) -> list[tuple]:
        texts, boxes, confs = [], [], []
        # arrays pay only on pages of many words
        table = np.zeros((len(found), 4)) if len(found) > FEW else None
        for f in sorted(found, key=lambda f: (f["y"] + f["h"] / 2, f["x"], f["text"])):
            x, y, w, h = f["x"], f["y"], f["w"], f["h"]
            i = _first_fit(boxes, x, y, h) if table is None else _first_fit_of_many(table[: len(boxes)], x, y, h)
            if i < 0:
                i = len(boxes)
                texts.append(f["text"]), confs.append([f["conf"]]), boxes.append((x, y, w, h))
            else:
                lx, ly, lw, lh = boxes[i]
                texts[i] += " " + f["text"]
                confs[i].append(f["conf"])
                boxes[i] = lx, min(ly, y), max(lx + lw, x + w) - lx, max(ly + lh, y + h) - min(ly, y)
            if table is not None:
                table[i] = boxes[i]
        order = _from_the_top(boxes) if table is None else np.lexsort((table[: len(boxes), 0], np.rint((table[: len(boxes), 1] + table[: len(boxes), 3] / 2) / LEVEL)))
        return [(n + 1, texts[i], *boxes[i], _mean(confs[i])) for n, i in enumerate(order)]

    columns = ["place", "text", "x", "y", "w", "h", "conf"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, p, *line) for d, p, found in f.itertuples(index=False) for line in page(list(found))]
            yield pd.DataFrame(rows, columns=["doc_id", "page", *columns])

    good = words.where((F.trim("text") != "") & (F.col("conf") >= 0)).select("doc_id", F.col("page").cast("int").alias("page"), F.trim("text").alias("text"), *[F.col(c).cast("double").alias(c) for c in "xywh"], F.col("conf").cast("double").alias("conf"))
    pages = good.groupBy("doc_id", "page").agg(F.collect_list(F.struct("text", "x", "y", "w", "h", "conf")).alias("found"))
    return pages.mapInPandas(run, f"doc_id {good.schema['doc_id'].dataType.simpleString()}, page int, place int, text string, x double, y double, w double, h double, conf double")
