"""Sharding by histogram sort.

Rows are ordered by (hash of the text, hash of the id, row number). Splitters are
found without moving a row: each round counts, for every open boundary, the exact
bytes and rows below a grid of probes inside its range; a boundary closes at the
probe nearest to its target once that is within tolerance, else its range shrinks
to one grid cell. Only counts reach the driver (``GRID`` per open boundary). Then
the rows are exchanged once, into parts several times finer than the shards, and
numbered inside the parts; the histogram already holds the rows below each part.

Groups of equal texts have one hash and so stay together, unless a group alone is
larger than the tolerance: then its boundary is refined inside the group, and no
hot text ends in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import col, small_batches, stored
from ._text import batches

#: Probes for each open boundary and round.
GRID = 4096
_TOP = 1 << 64
_FLIP = np.uint64(1 << 63)


class _Open:
    """A range of one of the three sort columns that still holds boundaries, with the exact totals below it."""

    def __init__(self, level: int, fixed: tuple[int, ...], lo: int, hi: int, below: tuple[int, int]):
        self.level, self.fixed, self.lo, self.hi, self.below = level, fixed, lo, hi, below
        self.shift = max(0, (hi - lo - 1).bit_length() - GRID.bit_length() + 1)
        self.targets: list[int] = []

    def edge(self, x: int) -> tuple[int, int, int]:
        return (*self.fixed, x, 0, 0)[:3]


def _unsigned(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).view(np.uint64) ^ _FLIP


def _histogram(base: DataFrame, opened: list[_Open]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bins, bytes and rows of every open range: summed per batch, then once more over all tasks."""
    plan = [(o.level, o.fixed, o.lo, o.hi, o.shift) for o in opened]

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            cols = [_unsigned(b.column(i)) for i in range(3)]
            size = b.column(3).to_numpy(zero_copy_only=False)
            out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
            for r, (level, fixed, lo, hi, shift) in enumerate(plan):
                v = cols[level]
                ok = (v >= np.uint64(lo)) & (v <= np.uint64(hi - 1))
                for c, x in zip(cols, fixed):
                    ok &= c == np.uint64(x)
                if not ok.any():
                    continue
                bins, at = np.unique((v[ok] - np.uint64(lo)) >> np.uint64(shift), return_inverse=True)
                out.append((r, bins.astype(np.int64), np.bincount(at, size[ok]).astype(np.int64), np.bincount(at)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.full(len(x[1]), x[0], np.int32) for x in out])), *(pa.array(np.concatenate([x[i] for x in out])) for i in (1, 2, 3))],
                    names=["r", "bin", "bytes", "rows"],
                )

    sums = base.select("k", "t", "rid", "weight").mapInArrow(count, "r int, bin long, bytes long, rows long").groupBy("r", "bin").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).toPandas()
    return {r: (g["bin"].to_numpy(), g["bytes"].to_numpy(), g["rows"].to_numpy()) for r, g in sums.sort_values("bin").groupby("r")}


def _splitters(base: DataFrame, parts: int, fine: int, tolerance: float) -> tuple[list[tuple[int, int, int]], list[int]]:
    """parts-1 ascending boundaries and the rows below each; those of shards, each ``fine``-th, are held to ``tolerance`` of a shard."""
    first = _Open(0, (), 0, _TOP, (0, 0))
    opened, total, found = [first], None, {}
    first.targets = list(range(1, parts))
    while opened:
        hist = _histogram(base, opened)
        if total is None:
            total = int(hist[0][1].sum()) if hist else 0
            if not total:
                return [(0, 0, 0)] * (parts - 1), [0] * (parts - 1)
        following: dict[tuple, _Open] = {}
        for r, o in enumerate(opened):
            bins, weight, rows = hist[r]
            w = np.concatenate(([0], np.cumsum(weight))) + o.below[0]
            n = np.concatenate(([0], np.cumsum(rows))) + o.below[1]
            for j in o.targets:
                goal = total * j / parts
                cell = min(int(np.searchsorted(w[1:], goal, "left")), len(bins) - 1)
                near = cell + int(abs(w[cell + 1] - goal) < abs(w[cell] - goal))
                lo = o.lo + (int(bins[cell]) << o.shift)
                hi = min(lo + (1 << o.shift), o.hi)
                slack = tolerance * total * fine / parts if j % fine == 0 else 0.25 * total / parts
                if abs(w[near] - goal) <= slack or rows[cell] <= 1 or (o.level == 2 and o.shift == 0):
                    # the probe below the first row of a cell, or above the last one of the range
                    x = o.lo + (int(bins[near]) << o.shift) if near < len(bins) else hi
                    edge = o.edge(x) if x < _TOP else (_TOP - 1, _TOP - 1, _TOP - 1)
                    found[j] = (edge, int(n[near]))
                    continue
                level, fixed = (o.level, o.fixed) if o.shift else (o.level + 1, (*o.fixed, lo))
                a, z = (lo, hi) if o.shift else (0, _TOP)
                following.setdefault((level, fixed, a), _Open(level, fixed, a, z, (int(w[cell]), int(n[cell])))).targets.append(j)
        opened = list(following.values())
    order = sorted(found)
    return [found[j][0] for j in order], [found[j][1] for j in order]


def _part(splitters: list[tuple[int, int, int]]):
    """Adds the number of splitters at or below each row, by binary search on the first column and then inside equal values."""
    cut = np.array(splitters, dtype=object)
    ks = cut[:, 0].astype(np.uint64)
    # splitters that lie inside one hash value are compared on the other columns
    inner = [(i, np.uint64(a), np.uint64(b), np.uint64(c)) for i, (a, b, c) in enumerate(splitters) if b or c]

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            k, t, rid = (_unsigned(b.column(i)) for i in range(3))
            part = np.searchsorted(ks, k, "right")
            for _, a, x, y in inner:
                same = k == a
                part -= same & ((t < x) | ((t == x) & (rid < y)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32))], names=[*b.schema.names, "part"])

    return add


def shard_rows(docs: DataFrame, shards: int = 8, law: str = "bytes", tolerance: float = 0.005, fine: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals rows into shards; returns one row per input row.

    law ``bytes``: shard sizes within ``tolerance`` of equal, or as near as whole
    rows allow; ``rows``: counts at most one apart; ``key``: the id and the number
    of shards decide (highest random weight), and a further shard only takes rows
    into itself. Columns: ``id``, ``size`` (UTF-8 bytes of the text, plus 1),
    ``text_crc32``, ``law``, ``shard``, ``slot`` (gapless in the shard, from 0) and
    ``grown_shard``. A null text has size 1 and the checksum of an empty one; a
    null id and repeated rows are dealt like any others; no rows give no rows.
    Other columns of the input are not read.
    """
    if law not in ("bytes", "rows", "key"):
        raise ValueError(f"unknown law {law!r}")
    small_batches(docs.sparkSession)
    text = F.coalesce(col(text_col), F.lit(""))
    base = stored(
        docs.select(
            F.xxhash64(text).alias("k"), F.xxhash64(F.lit(1), col(id_col)).alias("t"), F.monotonically_increasing_id().alias("rid"),
            (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), col(id_col).alias("id"),
        )
    )
    parts = shards * fine
    if law == "key":
        weight = lambda n: F.array_max(F.array(*[F.struct(F.xxhash64(F.lit(s), F.col("id")).alias("w"), F.lit(s).alias("s")) for s in range(n)]))["s"]
        dealt = base.withColumn("shard", weight(shards)).withColumn("grown_shard", weight(shards + 1)).withColumn("part", F.col("shard") * fine + F.pmod(F.xxhash64("k", "t", "rid"), F.lit(fine)).cast("int"))
        counts = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}
        below = np.concatenate(([0], np.cumsum([counts.get(p, 0) for p in range(parts)])))[:-1].tolist()
    else:
        weighed = base.withColumn("weight", F.col("size") if law == "bytes" else F.lit(1).cast("long"))
        splitters, rows_below = _splitters(weighed, parts, fine, tolerance if law == "bytes" else 0.0)
        schema = "k long, t long, rid long, size long, text_crc32 long, id " + base.schema["id"].dataType.simpleString() + ", part int"
        dealt = base.mapInArrow(_part(splitters), schema).withColumn("shard", F.floor(F.col("part") / fine).cast("int")).withColumn("grown_shard", F.lit(None).cast("int"))
        below = [0, *rows_below]
    # rows of the shard that lie in earlier parts: a table of shards x fine numbers
    start = F.array(*[F.lit(int(below[p] - below[p - p % fine])) for p in range(parts)])
    place = F.row_number().over(Window.partitionBy("part").orderBy("k", "t", "rid"))
    return dealt.select("id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.element_at(start, F.col("part") + 1) + place - 1).alias("slot"), "grown_shard")
