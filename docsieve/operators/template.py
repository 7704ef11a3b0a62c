"""Where the fields of a card lie: learned boxes, and the fit of a photo to them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._ship import ship

#: Width over height of a card.
RATIO = 85.6 / 54


def learn(boxes: DataFrame) -> DataFrame:
    """(key, x, y, w, h, n): running means in the order of ``seq``, rounded to 4 places at each step, as they are stored.

    Boxes that are not inside the unit square or have no area are left out.
    """
    inside = F.col("x").between(0, 1) & F.col("y").between(0, 1) & (F.col("w") > 0) & (F.col("w") <= 1) & (F.col("h") > 0) & (F.col("h") <= 1)
    got = boxes.where(inside & F.col("key").isNotNull()).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "w", "h"))).alias("b"))
    start = F.struct(*[F.lit(0.0).alias(c) for c in "xywh"], F.lit(0).alias("n"))
    step = lambda s, v: F.struct(*[F.bround((s[c] * s["n"] + v[c]) / (s["n"] + 1), 4).alias(c) for c in "xywh"], (s["n"] + 1).alias("n"))
    return got.select("key", F.aggregate("b", start, step).alias("m")).select("key", "m.x", "m.y", "m.w", "m.h", F.col("m.n").cast("long").alias("n"))


def as_stored(log: DataFrame, version: int | None = None) -> DataFrame:
    """(key, x, y, w, h, n) of a template as of a version: its log up to there, folded in order.

    log: key, seq, deleted, x, y, w, h. It is only appended to. A row either adds a learned
    box or deletes its key (``deleted``), or with a null key the whole template; what was
    learned before is forgotten, and what is learned later starts anew. The version is the
    last ``seq`` that counts, null for all; of equal numbers deletions come first. Each row
    is compared with the last deletion of its key only, so nothing but the log is kept.
    """
    known = log if version is None else log.where(F.col("seq") <= version)
    gone = known.where("deleted")
    whole = gone.where("key is null").agg(F.max("seq").alias("all_gone"))
    own = gone.where("key is not null").groupBy("key").agg(F.max("seq").alias("own_gone"))
    d = known.where("not deleted and key is not null").join(own, "key", "left").crossJoin(F.broadcast(whole))
    after = F.coalesce(F.greatest("own_gone", "all_gone"), F.lit(-(2**63)))
    return learn(d.where(F.col("seq") >= after).select("key", "seq", *"xywh"))


def append_log(path: str, rows: DataFrame) -> None:
    """Appends learned boxes and deletions to the log of a template; older rows are never rewritten, so older versions can be read."""
    rows.select("key", F.col("seq").cast("long").alias("seq"), F.col("deleted").cast("boolean").alias("deleted"), *[F.col(c).cast("double").alias(c) for c in "xywh"]).write.mode("append").parquet(path)


def anchor_fit(points: DataFrame) -> DataFrame:
    """(photo_id, n, s, bx, by): least squares of px = s R x + bx and py = s y + by over the fields of a photo.

    Null without three fields, without a spread of 0.1, or for a scale of 50 or less.
    A plain aggregation: sums of each task go to one row per photo.
    """
    rx = F.col("x_card") * RATIO
    sxx = F.var_pop(rx) + F.var_pop("y_card")
    s = F.try_divide(F.covar_pop(rx, "x_px") + F.covar_pop("y_card", "y_px"), sxx)
    spread = F.greatest(F.max("x_card") - F.min("x_card"), F.max("y_card") - F.min("y_card"))
    got = points.groupBy("photo_id").agg(F.count("*").alias("n"), s.alias("s"), spread.alias("spread"), F.avg(rx).alias("mx"), F.avg("y_card").alias("my"), F.avg("x_px").alias("px"), F.avg("y_px").alias("py"))
    ok = (F.col("n") >= 3) & (F.col("spread") >= 0.1) & (F.col("s") > 50)
    keep = lambda c: F.when(ok, c)
    return got.select("photo_id", "n", keep(F.col("s")).alias("s"), keep(F.col("px") - F.col("s") * F.col("mx")).alias("bx"), keep(F.col("py") - F.col("s") * F.col("my")).alias("by"))


def fit_error(measured: DataFrame, template: DataFrame) -> DataFrame:
    """(photo_id, error, error_turned, turned): mean distance of box centres, as they are and turned by 180 degrees."""
    m = measured.alias("m").join(F.broadcast(template.select("key", *[F.col(c).alias(f"t{c}") for c in "xywh"])), "key")
    cx, cy, tx, ty = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.col("tx") + F.col("tw") / 2, F.col("ty") + F.col("th") / 2
    got = m.groupBy("photo_id").agg(F.avg(F.hypot(cx - tx, cy - ty)).alias("error"), F.avg(F.hypot(1 - cx - tx, 1 - cy - ty)).alias("error_turned"))
    return got.withColumn("turned", F.col("error_turned") < F.col("error"))


def zone_boxes(template: DataFrame, *of: str) -> DataFrame:
    """Each box with its margins: more to the right for names, which may be longer than the learned one."""
    right = F.when(F.col("key").isin("nombre", "apellidos"), 0.30).otherwise(0.03)
    x0, y0 = F.greatest(F.lit(0.0), F.col("x") - 0.015), F.greatest(F.lit(0.0), F.col("y") - 0.012)
    x1, y1 = F.least(F.lit(1.0), F.col("x") + F.col("w") + right), F.least(F.lit(1.0), F.col("y") + F.col("h") + 0.012)
    return template.select(*of, "key", x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


#: Labels above a field of free text, the first that is known.
LABEL_OF = {"apellidos": ("apellidos", "primer_apellido"), "nombre": ("nombre",)}


def name_zones(template: DataFrame, *of: str) -> DataFrame:
    """Zones of names from their printed label to the next label below it in its column, whatever the learned photo held.

    template: key, x, y, w, h, with labels as ``etiqueta.<name>``, and columns ``of`` that
    tell templates apart. Names without their label have no row here. A template has a
    few dozen rows, so it is one array.
    """
    boxes = template.groupBy(*of).agg(F.collect_list(F.struct("key", *"xywh")).alias("b"))
    named = lambda k: F.get(F.filter("b", lambda o: o["key"] == k), F.lit(0))
    own = lambda names: F.coalesce(*[named(f"etiqueta.{n}") for n in names])
    d = boxes.select(*of, "b", F.explode(F.array(*[F.struct(named(k).alias("v"), own(names).alias("l")) for k, names in LABEL_OF.items()])).alias("z")).where("z.v is not null and z.l is not null")
    v, lab = (lambda c: F.col("z.v")[c]), (lambda c: F.col("z.l")[c])
    under = lambda o: o["key"].startswith("etiqueta.") & (o["y"] > lab("y") + lab("h") * 1.5) & (o["x"] < lab("x") + F.greatest(lab("w"), F.lit(0.25))) & (o["x"] + o["w"] > lab("x") - 0.02)
    d = d.withColumn("next", F.array_min(F.transform(F.filter("b", under), lambda o: o["y"])))
    x0, y0 = F.greatest(F.lit(0.0), F.least(lab("x"), v("x")) - 0.015), lab("y") + lab("h") * 0.9
    y1 = F.when(F.col("next").isNull(), v("y") + v("h") + 0.012).otherwise(F.greatest(F.col("next") - 0.004, y0 + v("h")))
    x1 = F.least(F.lit(1.0), F.greatest(v("x") + v("w"), lab("x") + lab("w")) + 0.30)
    return d.select(*of, v("key").alias("key"), x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (F.least(F.lit(1.0), y1) - y0).alias("h"))


def homography(corners: np.ndarray) -> np.ndarray:
    """The 3 x 3 map of four corners (from the top left, clockwise) to the unit square; NaN if they are in a line."""
    target = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    rows, right = [], []
    for (x, y), (u, v) in zip(corners, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    try:
        return np.append(np.linalg.solve(np.array(rows), np.array(right)), 1).reshape(3, 3)
    except np.linalg.LinAlgError:
        return np.full((3, 3), np.nan)


def straightened(boxes: DataFrame) -> DataFrame:
    """(photo_id, key, x, y, w, h): boxes in pixels as fractions of a card seen in perspective.

    boxes: photo_id, key, x, y, w, h, corners (array of eight numbers). The bounds of the
    four mapped corners of a box count; corners that are in a line give nulls.
    """
    ship(boxes.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for photo, key, x, y, w, h, corners in f.itertuples(index=False):
                p = homography(np.array(corners, float).reshape(4, 2)) @ np.array([[x, x + w, x + w, x], [y, y, y + h, y + h], [1, 1, 1, 1]], float)
                u, v = p[0] / p[2], p[1] / p[2]
                ok = bool(np.isfinite(u).all())
                out.append((photo, key, *((u.min(), v.min(), np.ptp(u), np.ptp(v)) if ok else (None,) * 4)))
            yield pd.DataFrame(out, columns=["photo_id", "key", "x", "y", "w", "h"])

    return boxes.select("photo_id", "key", "x", "y", "w", "h", "corners").mapInPandas(run, "photo_id string, key string, x double, y double, w double, h double")
