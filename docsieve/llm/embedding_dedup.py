"""Near-duplicate embeddings: sign hashing on random hyperplanes, exact cosine, components.

Equal vectors are one class from the start. A class goes to one bucket in each table,
first without its vector: only its sign codes go along. In a bucket, a pair is looked
at in the first table that brings it together, and is a candidate if few enough signs
of all tables differ. Vectors are fetched only for members with candidates, and these
are compared in double precision. Only sums and spanning stars leave a bucket, never
its pairs.

In a bucket beyond ``BLOCK`` members of the first table, those within half the angle
of the threshold of one of them are a core: by the triangle inequality of angles they
all link with each other, so they are counted and not compared. What remains is dealt
in pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._deal import dealt, hot_keys, meets
from ._graph import connected_components
from ._store import col, discard, small_batches, stored
from ._text import batches, mix
from .ngram_join import _binary, _heads, runs

BLOCK = 1024
#: Members that a bucket holds on average, and the share of pairs just at the threshold that may be missed.
PER_BUCKET = 4
MISSED = 0.004
#: Standard deviations of differing signs that a pair just at the threshold is allowed.
SPREAD = 4.5


def plan_tables(classes: int, threshold: float) -> tuple[int, int]:
    """(bits, tables): bits grow with the logarithm of the classes of a label, tables follow from the threshold."""
    bits = max(8, min(30, round(math.log2(max(2, classes) / PER_BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log(1 - agree))


def _most_differing(bits: int, tables: int, threshold: float) -> float:
    n, p = bits * tables, math.acos(threshold) / math.pi
    return n * p + SPREAD * math.sqrt(n * p * (1 - p))


def _codes(v: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The sign code of each row in each table."""
    planes = np.random.default_rng(90210).standard_normal((v.shape[1], bits * tables))
    signs = (v @ planes > 0).reshape(len(v), tables, bits)
    return (signs @ (1 << np.arange(bits, dtype=np.int64))).astype("<u2" if bits <= 16 else "<u4")


def _matrix(x: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows, scaled by powers of two so that no norm overflows or vanishes."""
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    v = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _members(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(bucket, tab, cls, grp, codes): a row for each class and table."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            dims = b.column(3).value_lengths().to_numpy()
            for dim in np.unique(dims):
                part = b.take(pa.array(np.flatnonzero(dims == dim)))
                n = part.num_rows
                codes = _codes(_matrix(part.column(3)), bits, tables)
                table = np.arange(tables, dtype=np.uint64)
                bucket = mix(part.column(0).to_numpy().view(np.uint64)[:, None] + mix((codes.astype(np.uint64) << np.uint64(16)) + table))
                again = np.repeat(codes, tables, axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.ravel().view(np.int64)), pa.array(np.tile(table.astype(np.int32), n)), pa.array(np.repeat(part.column(1).to_numpy(), tables)), pa.array(np.repeat(part.column(2).to_numpy(), tables)), _binary(np.arange(n * tables + 1) * tables, again.ravel())],
                    names=["bucket", "tab", "cls", "grp", "codes"],
                )

    return classes.select("space", "cls", "grp", "vec").mapInArrow(run, "bucket long, tab int, cls long, grp long, codes binary")


class _Run:
    """Sorted members of buckets, and the candidate pairs among them."""

    def __init__(self, t: pa.Table, limit: float, wide: bool):
        self.tab, self.own, self.grp = (t.column(n).to_numpy() for n in ("tab", "own", "grp"))
        self.crossing = t.column("bi").to_numpy() != t.column("bj").to_numpy()
        heads = _heads(t, 3)
        self.run = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
        self.codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), "<u4" if wide else "<u2").reshape(t.num_rows, -1)
        self.limit = limit

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for d in range(1, len(self.run)):
            a = np.flatnonzero(self.run[:-d] == self.run[d:])
            if not len(a):
                return
            b = a + d
            ok = meets(self.own, self.grp, self.crossing, a, b)
            a, b = a[ok], b[ok]
            x = self.codes[a] ^ self.codes[b]
            equal = x == 0
            own = np.arange(len(a)), self.tab[a]
            ok = equal[own] & (equal.argmax(axis=1) == self.tab[a]) & (np.bitwise_count(x).sum(axis=1) <= self.limit)
            yield a[ok], b[ok]


def _candidates(members: DataFrame, limit: float, wide: bool) -> DataFrame:
    """The members that have a candidate in their bucket."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(it, 3):
            keep = np.zeros(t.num_rows, bool)
            for a, b in _Run(t, limit, wide).pairs():
                keep[a] = keep[b] = True
            yield from t.filter(pa.array(keep)).to_batches()

    rows = members.select("bucket", "bi", "bj", "tab", "cls", "own", "grp", "codes")
    schema = "bucket long, bi long, bj long, tab int, cls long, own long, grp long, codes binary"
    return rows.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj", "cls").mapInArrow(run, schema)


def _compare(members: DataFrame, threshold: float, limit: float, wide: bool) -> DataFrame:
    """(cls, links, low) for each bucket: vectors linked, counted once over all tables, and the root of the links found here."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(it, 3):
            cls, size = t.column("cls").to_numpy(), t.column("size").to_numpy()
            lengths = np.concatenate([c.value_lengths().to_numpy() for c in t.column("vec").chunks])
            if len(set(lengths.tolist())) > 1:
                # buckets of one length are whole in each part
                parts = [t.filter(pa.array(lengths == n)) for n in np.unique(lengths)]
            else:
                parts = [t]
            for p in parts:
                cls, size = p.column("cls").to_numpy(), p.column("size").to_numpy()
                v = _matrix(p.column("vec"))
                norm = np.sqrt((v * v).sum(axis=1))
                links, root, found = np.zeros(len(cls), np.int64), np.arange(len(cls)), []
                for a, b in _Run(p, limit, wide).pairs():
                    ok = np.einsum("ij,ij->i", v[a], v[b]) / (norm[a] * norm[b]) >= threshold
                    a, b = a[ok], b[ok]
                    np.add.at(links, a, size[b])
                    np.add.at(links, b, size[a])
                    found.append((a, b))
                a, b = (np.concatenate([f[i] for f in found] + [np.zeros(0, np.int64)]) for i in (0, 1))
                while True:
                    low = root.copy()
                    np.minimum.at(low, a, root[b])
                    np.minimum.at(low, b, root[a])
                    low = np.minimum(low, low[low])
                    if (low == root).all():
                        break
                    root = low
                keep = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(cls[keep]), pa.array(links[keep]), pa.array(cls[root][keep])], names=["cls", "links", "low"])

    rows = members.select("bucket", "bi", "bj", "tab", "cls", "own", "grp", "codes", "size", "vec")
    return rows.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj", "cls").mapInArrow(run, "cls long, links long, low long")


def _cores(classes: DataFrame, members: DataFrame, hot: DataFrame, threshold: float) -> DataFrame:
    """(cls, core): members of hot buckets of the first table that all link with each other."""
    of = members.where("tab = 0").select("bucket", "cls").join(hot.select("bucket"), "bucket", "left_semi").join(classes.select("cls", "vec"), "cls")
    pivots = stored(of.groupBy("bucket").agg(F.min_by("vec", F.xxhash64(F.lit(5), "cls")).alias("pivot")))
    least = math.sqrt((1 + threshold) / 2) + 1e-12

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            near = [float((_unit(_matrix(b.column(2).slice(i, 1))) @ _unit(_matrix(b.column(3).slice(i, 1))).T)[0, 0]) >= least for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in b.columns[:2]], names=["core", "cls"])

    return stored(of.join(pivots, "bucket").select("bucket", "cls", "vec", "pivot").mapInArrow(run, "core long, cls long").where("core <> 0"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """Links vectors of equal label whose cosine is ``threshold`` or more, as far as a table brings them together.

    One row per input row: ``id``, ``n_links`` (other vectors linked directly),
    ``component_id`` (the smallest id that links reach) and ``kept`` (id =
    component_id). A vector that is null, empty, zero or holds null or non-finite
    components links with nothing, as does one without label or id; vectors of
    different lengths never link, and neither does magnitude matter. Rows that share an
    id count each. All links found hold exactly, those right at the threshold included;
    at least ``1 - MISSED`` of the pairs just at the threshold, and more of the nearer
    ones, are expected to be found. Equal vectors always link. An empty table gives no
    rows; columns other than the three are not read, whatever their names.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kind = vectors.select(col(vec_col)).schema[0].dataType
    kind = "array<float>" if isinstance(getattr(kind, "elementType", None), T.FloatType) else "array<double>"
    rows = vectors.select(col(id_col).cast("long").alias("id"), col(vec_col).cast(kind).alias("vec"), col(label_col).alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & F.forall("vec", finite) & F.exists("vec", lambda x: x != 0), F.lit(False))
    marked = stored(rows.select("id", "label", "vec", good.alias("good"), F.xxhash64("vec").alias("ha"), F.xxhash64(F.lit(3), "vec").alias("hb")))
    classes = marked.where("good").groupBy("label", "ha", "hb").agg(F.min(F.struct("id", "vec")).alias("x"), F.count("*").alias("size"))
    space = F.xxhash64("label", F.size("x.vec")).alias("space")
    classes = stored(classes.select("label", "ha", "hb", F.col("x.id").alias("first_id"), "size", F.col("x.vec").alias("vec"), space, F.lit(0).cast("long").alias("grp")).withColumn("cls", F.monotonically_increasing_id()))
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = plan_tables(most, threshold)
    limit, wide = _most_differing(bits, tables, threshold), bits > 16
    members = _members(classes, bits, tables)
    hot = hot_keys(members.select("bucket"), "bucket", BLOCK)
    known = None
    if hot is not None:
        cores = _cores(classes, members, hot, threshold)
        in_core = cores.join(classes.select("cls", "size"), "cls")
        whole = stored(in_core.groupBy("core").agg(F.sum("size").alias("all"), F.min("cls").alias("low")))
        known = in_core.join(whole, "core").select("cls", (F.col("all") - F.col("size")).alias("links"), "low")
        grouped = classes.drop("grp").join(cores, "cls", "left").withColumn("grp", F.coalesce("core", F.lit(0).cast("long"))).drop("core")
        members = _members(stored(grouped), bits, tables)
    near = _candidates(dealt(members, "bucket", "cls", BLOCK, hot), limit, wide)
    found = _compare(near.join(classes.select("cls", "size", "vec"), "cls"), threshold, limit, wide)
    found = stored(found if known is None else found.unionAll(known))
    degree = stored(found.groupBy("cls").agg(F.sum("links").alias("links")))
    component = stored(connected_components(found.select(F.col("cls").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "cls"))
    # classes have names of their own, as rows that share an id may hold different vectors
    named = component.join(classes.select("cls", "first_id"), "cls").groupBy("component").agg(F.min("first_id").alias("component_id"))
    names = component.join(named, "component").select("cls", "component_id")
    # stored, so that adaptive execution can split the rows of a much repeated vector
    facts = stored(classes.select("label", "ha", "hb", "cls", "size", "first_id").join(degree, "cls", "left").join(names, "cls", "left"))
    discard(found, degree, component)
    joined = marked.where("good").select("id", "label", "ha", "hb").join(facts, ["label", "ha", "hb"])
    linked = joined.select("id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"))
    alone = marked.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("id") == F.col("component_id"))
