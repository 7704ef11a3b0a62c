"""Hard negatives by one-dimensional distance keys: exact top-k of inner products over a sorted table.

A vector gets one component more, so that all have the same norm; then the largest
inner product with an anchor is the smallest distance to it. Each vector is stored
under its nearest pivot, sorted by (pivot, distance), in blocks of consecutive keys.
By the triangle inequality, what lies within a radius of an anchor has keys in one
interval for each pivot. Intervals widen from round to round, and a block that they
reach is compared once with the anchors that reach it. An anchor is done when the
best it has found cannot be beaten beyond its radius; the result is exact.

Negatives of a positive lie in an annulus round the anchor, from the positive's own
distance outwards: blocks wholly inside or outside of it are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import col, discard, small_batches, stored
from ._text import batches
from ._vectors import best, binary, distinct_vectors, finite, lengths, matrix, rows_of

#: Rows from which pivots are fitted, and pivots.
SAMPLE, PIVOTS = 4096, 64
#: Vectors of a block at least, and blocks at most (but for those cut at the ends of pivots and parts); the directory of blocks is broadcast.
BLOCK, BLOCKS = 1024, 1 << 16
#: Vectors that an anchor looks at in its first round, and how the number grows.
FIRST, WIDER = 4096, 16
#: Anchors that meet a block at once, on average.
ANCHORS = 512
_NEED = "array<struct<need:int,hi:long,lo:long>>"


def _augmented(v: np.ndarray, most: int) -> np.ndarray:
    return np.column_stack([v, np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0))])


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((v - p) ** 2).sum(axis=1) for p in pivots], axis=1))


def _pivots(classes: DataFrame, dim: int, most: int) -> np.ndarray:
    """Centres of a sample of at most ``SAMPLE`` vectors, taken by hash."""
    rows = classes.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(min(SAMPLE, (64 << 20) // (8 * max(dim, 1)))).collect()
    v = _augmented(np.array([r[0] for r in rows], np.float64).reshape(len(rows), dim), most)
    centres = v[np.unique(np.linspace(0, len(v) - 1, PIVOTS).astype(int))]
    for _ in range(5):
        near = _distances(v, centres).argmin(axis=1)
        centres = np.stack([v[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(len(centres))])
    return centres


def _blocks(classes: DataFrame, dim: int, most: int, pivots: np.ndarray, size: int) -> DataFrame:
    """(block, pivot, lo, hi, n, labels, vecs, ids): the sorted table, cut at ``size`` vectors and where the pivot changes."""

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            v = matrix(b.column(1), dim)
            d = _distances(_augmented(v, most), pivots)
            yield pa.RecordBatch.from_arrays([pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1)), b.column(0), binary(v.astype("<i4")), b.column(2)], names=["pivot", "dist", "label", "vec", "ids"])

    def packed(rows: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(rows)
        d = t.column("dist").to_numpy()
        cells = [[int(t.column("pivot")[0].as_py())], [d[0]], [d[-1]], [t.num_rows], [t.column("label").to_numpy().tobytes()], [b"".join(t.column("vec").to_pylist())], [t.column("ids").to_pylist()]]
        kinds = (pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=["pivot", "lo", "hi", "n", "labels", "vecs", "ids"])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches(it):
            t = pa.Table.from_batches([b])
            p = t.column("pivot").to_numpy()
            i = 0
            while i < len(p):
                n = sum(x.num_rows for x in held)
                if n and (n >= size or held[0].column("pivot")[0].as_py() != p[i]):
                    yield packed(held)
                    held, n = [], 0
                j = min(i + size - n, int(np.searchsorted(p, p[i], "right")))
                held.append(t.slice(i, j - i))
                i = j
        if held:
            yield packed(held)

    keys = classes.select("label", "vec", "ids").mapInArrow(keyed, "pivot int, dist double, label long, vec binary, ids array<long>")
    blocks = keys.repartitionByRange("pivot", "dist", "vec").sortWithinPartitions("pivot", "dist").mapInArrow(cut, "pivot int, lo double, hi double, n int, labels binary, vecs binary, ids array<array<long>>")
    return stored(blocks.withColumn("block", F.monotonically_increasing_id()))


def _searched(anchors: DataFrame, blocks: DataFrame, dim: int, most: int, pivots: np.ndarray, k: int, same: bool, first: int) -> DataFrame:
    """(key, need, score, id): the first ``k`` of each need of anchors (key, id, label, vec, needs), stored.

    A need asks for rows of the anchor's label, but not of its id (``same``), or of
    another label, whose scores are ``lo`` to ``hi``.
    """
    spark = anchors.sparkSession
    directory = blocks.select("block", "pivot", "lo", "hi", "n").toPandas()
    shared = spark.sparkContext.broadcast((pivots, *(directory[c].to_numpy() for c in ("block", "pivot", "lo", "hi", "n"))))
    slack = 1e-7 * max(1.0, math.sqrt(most))

    def visits(budget: int):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, block, pivot, lo, hi, n = shared.value
            for b in batches(it):
                v = rows_of(b.column(1).to_pylist(), dim, "<i4").astype(np.float64)
                at = _distances(np.column_stack([v, np.zeros(len(v))]), p)
                norm = (v * v).sum(axis=1)
                far = lambda i, score: math.sqrt(max(norm[i] + most - 2 * score, 0.0))
                for i, (needs, worst, radius) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist())):
                    d = at[i][pivot]
                    low, high = np.maximum(np.maximum(d - hi, lo - d), 0) - slack, d + hi + slack
                    inner = min(far(i, x["hi"]) for x in needs)
                    found = dict(worst)
                    outer = max(far(i, max(x["lo"], found.get(x["need"], x["lo"]))) for x in needs)
                    ok = np.flatnonzero((low > radius) & (low <= outer) & (high >= inner))
                    ok = ok[np.argsort(low[ok], kind="stable")]
                    rows = np.cumsum(n[ok])
                    end = int(np.searchsorted(rows, budget)) + 1
                    reached = float(low[ok[end - 1]]) if end < len(ok) else math.inf
                    ok = ok[low[ok] <= reached]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([block[ok], [-1]])), pa.array(np.full(len(ok) + 1, b.column(0)[i].as_py())), pa.array(np.full(len(ok) + 1, reached))],
                        names=["block", "key", "radius"],
                    )

        return run

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            for labels, vecs, ids, members in zip(*(b.column(j).to_pylist() for j in range(4))):
                labels = np.frombuffer(labels, np.int64)
                x = np.frombuffer(vecs, "<i4").astype(np.float64).reshape(len(labels), dim)
                q = rows_of([m["vec"] for m in members], dim, "<i4").astype(np.float64)
                # whole numbers below 2**53: exact in any order
                scores = (q @ x.T).astype(np.int64)
                out: list[tuple] = []
                for m, s in zip(members, scores):
                    mine = (labels == m["label"]) == same
                    for need in m["needs"]:
                        ok = np.flatnonzero(mine & (s >= need["lo"]) & (s <= need["hi"]))
                        if len(ok) > k + same:
                            # the own id may take one place
                            ok = ok[s[ok] >= np.partition(s[ok], len(ok) - k - same)[len(ok) - k - same]]
                        some = sorted((-int(s[j]), i) for j in ok for i in ids[j] if not same or i != m["id"])
                        out += [(m["key"], need["need"], -t, i) for t, i in some[:k]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["key", "need", "score", "id"])

    state = anchors.select("key", "vec", "label", "needs", F.create_map().cast("map<int,long>").alias("worst"), F.lit(-math.inf).alias("radius"))
    known, size = None, first
    while True:
        active = state.where(F.col("radius") < math.inf)
        count = active.count()
        if not count:
            return known
        seen = stored(active.mapInArrow(visits(size), "block long, key long, radius double"))
        chunk = F.pmod(F.xxhash64("key"), F.lit(-(-count // ANCHORS)))
        member = F.struct("key", "id", "label", "vec", "needs").alias("m")
        # anchors are grouped by block before they meet its vectors, so these go along once for many anchors
        groups = seen.where("block >= 0").select("block", "key").join(anchors, "key").groupBy("block", chunk.alias("chunk")).agg(F.collect_list(member).alias("members"))
        found = groups.join(blocks, "block").select("labels", "vecs", "ids", "members").mapInArrow(scored, "key long, need int, score long, id long")
        order = [F.col("score").desc(), F.col("id")]
        known_before, known = known, stored(best(found if known is None else found.unionAll(known), ["key", "need"], order, k).drop("rank"))
        worst = known.groupBy("key", "need").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("need", "low"))).alias("worst"))
        after = seen.where("block < 0").select("key", "radius")
        before, state = state, stored(active.drop("worst", "radius").join(after, "key").join(worst, "key", "left").select("key", "vec", "label", "needs", F.coalesce("worst", F.create_map().cast("map<int,long>")).alias("worst"), "radius"))
        discard(before, known_before, seen)
        size *= WIDER


def hard_negatives(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5,
    least: int = 80, most: int = 100, scale: int = 256, block: int = BLOCK, first: int = FIRST,
) -> DataFrame:
    """Negatives that score nearly as high as a positive, for rows where ``anchor``, a condition on ``id``, holds.

    Components become floor(scale * x); a score is the inner product of two rows, and
    equal scores go by the smaller id. An anchor's positives are the first
    ``positives`` other rows of its label. For each, the first ``negatives`` rows of
    another label with ``least`` to ``most`` hundredths of its score are returned:
    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A row whose id, label or vector is null, or whose vector holds null or non-finite
    components, takes no part, nor does one whose norm after scaling is 2**26.5 or more,
    as its scores would not be exact. Zero and empty vectors take part. Vectors of
    different lengths never meet. Rows that repeat an id, label and vector count once.
    An empty table gives no rows; columns other than the three are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(col(id_col).cast("long").alias("id"), F.xxhash64(col(label_col)).alias("label"), col(vec_col).cast("array<double>").alias("vec"), col(label_col).isNotNull().alias("labelled"))
    rows = rows.where(F.col("id").isNotNull() & F.col("labelled") & finite("vec"))
    small = F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * scale).cast("double"), 2.0)) < float(2**53)
    rows = rows.where(small).select("id", "label", F.transform("vec", lambda x: F.floor(x * scale).cast("int")).alias("vec"))
    everything = distinct_vectors(rows, max(positives + 1, negatives), ("label",))
    chosen = stored(rows.where(anchor).distinct().withColumn("key", F.monotonically_increasing_id()))
    out = None
    for dim in lengths(everything):
        classes, own = everything.where(F.size("vec") == dim), chosen.where(F.size("vec") == dim)
        part = _mined(classes, own, dim, positives, negatives, least, most, block, first)
        out = part if out is None else out.unionAll(part)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def _mined(classes: DataFrame, own: DataFrame, dim: int, positives: int, negatives: int, least: int, most: int, block: int, first: int) -> DataFrame:
    square = F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    facts = classes.agg(F.max(square).alias("norm"), F.count("*").alias("n")).first()
    norm = facts["norm"]
    pivots = _pivots(classes, dim, norm)
    blocks = _blocks(classes, dim, norm, pivots, max(block, -(-facts["n"] // BLOCKS)))

    def as_bytes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], binary(matrix(b.column(3), dim).astype("<i4"))], names=["key", "id", "label", "vec"])

    anchors = stored(own.select("key", "id", "label", "vec").mapInArrow(as_bytes, "key long, id long, label long, vec binary"))
    any_score = F.expr(f"array(named_struct('need', 0, 'hi', {2**53}L, 'lo', -{2**53}L))").cast(_NEED)
    liked = _searched(anchors.withColumn("needs", any_score), blocks, dim, norm, pivots, positives, True, first)
    empty = anchors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if liked is None:
        return empty
    # scores of positives, each once: rows of equal score ask for the same negatives
    asked = liked.where(least * F.col("score") <= most * F.col("score")).select("key", "score").distinct()
    whole = lambda s: F.call_function("div", s, F.lit(100))
    need = F.transform(F.sort_array(F.collect_list("score")), lambda s, j: F.struct(j.alias("need"), whole(s * most).alias("hi"), whole(s * least + 99).alias("lo")))
    needs = stored(asked.groupBy("key").agg(F.sort_array(F.collect_list("score")).alias("scores"), need.cast(_NEED).alias("needs")))
    mined = _searched(anchors.join(needs.select("key", "needs"), "key"), blocks, dim, norm, pivots, negatives, False, first)
    if mined is None:
        return empty
    order = [F.col("score").desc(), F.col("id")]
    ranked = best(mined, ["key", "need"], order, negatives)
    at = needs.select("key", F.posexplode("scores").alias("need", "positive_score"))
    ranked = ranked.join(at, ["key", "need"]).select("key", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = liked.select("key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = pairs.join(ranked, ["key", "positive_score"]).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
