"""Deals the members of hot keys over tasks, so that each pair still to be compared meets in one of them.

Members of a key may carry a group, whose members need not be compared with each other.
Groups are cut in blocks, and blocks meet in pairs unless they are of one group. So a
key whose members nearly all are of one group costs about one comparison for each
member and each one outside the group, and not one for each pair.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stored

#: Blocks of a group, at most; only the numbering of blocks depends on it.
_SPAN = 1 << 32


def hot_keys(rows: DataFrame, key: str, size: int) -> DataFrame | None:
    """(key, members) of the keys of more than ``size`` rows, stored; None if there are none."""
    hot = stored(rows.groupBy(key).agg(F.count("*").alias("members")).where(F.col("members") > size))
    return hot if hot.limit(1).count() else None


def dealt(rows: DataFrame, key: str, who: str, size: int, hot: DataFrame | None, group: str = "grp") -> DataFrame:
    """Adds ``own``, ``bi`` and ``bj``: the block of a member, and a pair of blocks in which it is compared.

    ``group`` is 0 for members that are compared with all others. Keys that are not hot
    are one block. The plan of a hot key lists its blocks, one for each ``size`` members.
    """
    zero = F.lit(0).cast("long")
    if hot is None:
        return rows.select("*", zero.alias("own"), zero.alias("bi"), zero.alias("bj"))
    groups = rows.join(F.broadcast(hot) if hot.count() < 100_000 else hot, key, "left_semi").groupBy(key, group).agg(F.count("*").alias("n"))
    plan = stored(groups.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(group).alias("g"), F.ceil(F.col("n") / size).cast("int").alias("n")))).alias("plan")))
    at = F.array_position(F.transform("plan", lambda p: p["g"]), F.col(group)) - 1
    own = at * F.lit(_SPAN) + F.pmod(F.xxhash64(F.lit(11), F.col(who)), F.get("plan", at.cast("int"))["n"])
    every = F.flatten(F.transform("plan", lambda p, j: F.when((p["g"] != F.col(group)) | (p["g"] == 0), F.transform(F.sequence(F.lit(0), p["n"] - 1), lambda i: j.cast("long") * F.lit(_SPAN) + i)).otherwise(F.array().cast("array<bigint>"))))
    out = rows.join(plan, key, "left").withColumn("own", F.when(F.col("plan").isNull(), zero).otherwise(own))
    out = out.withColumn("other", F.explode(F.when(F.col("plan").isNull(), F.array(zero)).otherwise(every)))
    return out.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("plan", "other")


def meets(own: np.ndarray, group: np.ndarray, crossing: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) a task is to compare: of different blocks where two meet, and not of one group."""
    return (~crossing[a] | (own[a] != own[b])) & ((group[a] == 0) | (group[a] != group[b]))
