"""Exact n-gram Jaccard join in a metric space.

Jaccard distance d = 1 - |x & y| / |x | y| is a metric, but texts that have nothing
in common are all at distance 1, where a Voronoi cell of any document holds all of
them and the windows copy everything everywhere. So the space is cut in three steps,
and only the last one measures distances between documents:

1. Rings round the empty set, the first pivot. |x| is the distance to it in the
   metric |x ^ y|, and a link bounds it: |x ^ y| <= (1 - t) / t * min(|x|, |y|). A
   document stands in the ring of its size, and a boundary document also in the next
   smaller one, if the triangle inequality lets a link reach there.
2. In a ring, shingles are dealt by hash into more parts than a link has differences.
   A link leaves a part untouched that is not empty. The projections on a part are
   pivots whose cells hold what projects on them exactly, so no cell needs a window.
   Members of a cell are then compared by one byte for each of their parts: a link
   has at least as many equal parts as there are parts less differences. What passes
   is kept as a spanning forest, whose trees are the regions.
3. A region is joined by pivots among its documents: each goes to the nearer pivot
   and, within a window of 2 (1 - t), to the other one too; cells are joined by
   recursion. Pairs that windows, sizes or known links do not settle are compared
   exactly. Large regions are cut in cells by distributed pivots. Members that link
   with a pivot are joined by it and not compared with each other, so a region or a
   cell of a great many near copies costs one comparison for each and a pivot; what
   is left is dealt in pairs of blocks, and no group is ever held by one task.

A document is compared as its set, and equal sets are one class all along. A set that
fills no more parts than a link may touch also stands in one cell with all such sets of
its ring. So a link leaves a filled part untouched, or both sets are in that cell: links
are missed only if 64-bit hashes collide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._deal import dealt, hot_keys, meets
from ._graph import connected_components
from ._store import col, discard, release, small_batches, stored
from ._text import NON_SPACE, batches, mix, shingles, slices, word_hashes, word_spans

#: Members that one task compares at once; larger cells and regions are dealt in blocks of so many.
CELL_BLOCK = 1024
REGION_BLOCK = 256
#: Pivots of a large region, and how often such regions are cut before they are dealt in blocks.
PIVOTS = 16
DEPTH = 3


@dataclass(frozen=True)
class Link:
    """Two sets link if ``den`` * intersection >= ``num`` * union."""

    num: int
    den: int

    def differences(self, n):
        """Most elements that differ between a set of n elements and a linked one that is not smaller."""
        return (self.den - self.num) * n // self.num

    def least(self, n):
        """Size of the smallest set that links with one of n elements."""
        return (self.num * n + self.den - 1) // self.den

    def holds(self, common, n, m):
        return self.den * common >= self.num * (n + m - common)

    @property
    def radius(self) -> float:
        return 1.0 - self.num / self.den


def ring_bounds() -> np.ndarray:
    """Smallest sizes of the rings: each is half as large again as the one before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out)


RINGS = ring_bounds()


def parts_of(ring: np.ndarray, link: Link) -> np.ndarray:
    """Parts in a ring: more than a link can touch, with some to spare for empty ones; none if linked sets are equal."""
    d = most_differences(ring, link)
    return np.where(d == 0, 0, d + d // 8 + np.where(d < 3, 44, 14))


def most_differences(ring: np.ndarray, link: Link) -> np.ndarray:
    """Most elements that differ between linked sets, the smaller of which is in a ring."""
    return link.differences(RINGS[ring + 1] - 1)


def _sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(data, off, NON_SPACE)
    return shingles(word_hashes(data, starts, ends), first, k)


def _fingerprints(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set: two sums of mixed elements."""
    n = np.diff(off)
    out = []
    for salt in (0x1D8E4E27C47D124F, 0x6A09E667F3BCC909):
        c = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(salt)), out=c[1:])
        out.append(mix(c[off[1:]] - c[off[:-1]] + n.astype(np.uint64)))
    return out[0], out[1]


def _projections(h: np.ndarray, off: np.ndarray, link: Link) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For own ring and, where a window reaches it, the next smaller: (documents, ring, first part of each, part values; 0 is empty)."""
    n = np.diff(off)
    own = np.searchsorted(RINGS, n, "right") - 1
    low = np.searchsorted(RINGS, link.least(n), "right") - 1
    for ring, docs in ((own, np.flatnonzero(n > 0)), (low, np.flatnonzero((n > 0) & (low < own)))):
        b = parts_of(ring[docs], link)
        docs, b = docs[b > 0], b[b > 0]
        at = np.concatenate(([0], np.cumsum(b)))
        count = n[docs]
        element = np.repeat(off[docs] - np.cumsum(count) + count, count) + np.arange(count.sum())
        x = h[element]
        part = np.repeat(at[:-1], count) + ((x >> np.uint64(32)) * np.repeat(b, count).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        value = np.zeros(at[-1], np.uint64)
        np.add.at(value, part, mix(x + np.uint64(0x2545F4914F6CDD1D)))
        place = (np.arange(at[-1]) - np.repeat(at[:-1], b)).astype(np.uint64)
        key = mix(value + mix(place * np.uint64(1024) + np.repeat(ring[docs], b).astype(np.uint64))) | np.uint64(1)
        yield docs, ring[docs], at, np.where(value == 0, np.uint64(0), key)


def _over_texts(docs: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Runs make(ids, data, offsets, state) over slices of (id, text); state lasts as long as the task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for b in batches(it):
            for at, data, off in slices(b.column(1)):
                yield from make(b.column(0).slice(at, len(off) - 1), data, off, state)

    return docs.select("id", "text").mapInArrow(run, schema)


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    width = data.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _profiles(docs: DataFrame, k: int, link: Link) -> DataFrame:
    """(id, n, fa, fb, ring, home, marks) of each document and ring; an empty set has ring -1."""

    def make(ids, data, off, state):
        h, so = _sets(data, off, k)
        n = np.diff(so)
        fa, fb = (x.view(np.int64) for x in _fingerprints(h, so))
        done = np.zeros(len(n), bool)
        for home, (d, ring, at, value) in zip((True, False), _projections(h, so, link)):
            marks = np.where(value == 0, 0, (value >> np.uint64(33)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
            done[d] |= home
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), pa.array(n[d]), pa.array(fa[d]), pa.array(fb[d]), pa.array(ring.astype(np.int32)), pa.array(np.full(len(d), home)), _binary(at, marks)], names=["id", "n", "fa", "fb", "ring", "home", "marks"])
        d = np.flatnonzero(~done)
        if len(d):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), pa.array(n[d]), pa.array(fa[d]), pa.array(fb[d]), pa.array(np.full(len(d), -1, np.int32)), pa.array(np.full(len(d), True)), pa.array([b""] * len(d), pa.binary())], names=["id", "n", "fa", "fb", "ring", "home", "marks"])

    return _over_texts(docs, make, "id long, n long, fa long, fb long, ring int, home boolean, marks binary")


def _cells(docs: DataFrame, k: int, link: Link) -> DataFrame:
    """(cell, salt, id): the projections of each distinct set of a task; the low six bits of a cell are its ring.

    The third and later rows of a cell in a slice of texts have a salt: the first two
    tell already that the cell is shared, so a hot cell need not be seen by one task.
    """

    def make(ids, data, off, state):
        h, so = _sets(data, off, k)
        fa, fb = _fingerprints(h, so)
        seen, hot = state.setdefault("seen", set()), state.setdefault("hot", np.zeros(0, np.uint64))
        if len(seen) > 100_000:
            seen.clear()
        new = np.zeros(len(fa), bool)
        for i, f in enumerate(zip(fa.tolist(), fb.tolist())):
            if f not in seen:
                seen.add(f)
                new[i] = True
        own = ids.to_numpy(zero_copy_only=False)
        for d, ring, at, value in _projections(h, so, link):
            if not len(d):
                continue
            b = np.diff(at)
            filled = np.add.reduceat(value != 0, at[:-1])
            use = (value != 0) & np.repeat(new[d], b)
            few = new[d] & (filled <= most_differences(ring, link))
            cell = np.concatenate((value[use], mix(ring[few].astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))))
            cell = (cell & ~np.uint64(63)) | np.concatenate((np.repeat(ring, b)[use], ring[few])).astype(np.uint64)
            who = np.concatenate((np.repeat(own[d], b)[use], own[d][few]))
            salt = np.zeros(len(cell), np.int32)
            of, at_first, place, count = np.unique(cell, return_index=True, return_inverse=True, return_counts=True)
            again = np.flatnonzero(count > 2)
            if len(again) or len(hot):
                known = np.isin(cell, hot)
                many = np.isin(place, again) & ~known
                later = np.flatnonzero(many)
                later = later[np.argsort(place[later], kind="stable")]
                first = np.searchsorted(place[later], again, "left")
                first = first[first < len(later)]
                pass_on = np.ones(len(later), bool)
                pass_on[first] = False
                pass_on[np.minimum(first + 1, len(later) - 1)] = False
                known[later[pass_on]] = True
                salt[known] = 1 + (mix(who[known].view(np.uint64)) & np.uint64(0xFFFF)).astype(np.int32)
                hot = np.union1d(hot, of[again]) if len(hot) < 1_000_000 else of[again]
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(salt), pa.array(who)], names=["cell", "salt", "id"])
        state["hot"] = hot

    return _over_texts(docs.where("id is not null"), make, "cell long, salt int, id long")


def _shared(rows: DataFrame) -> DataFrame:
    """(cell, id) of cells that hold two rows or more: a pass over sorted rows that looks at neighbours; salted rows are known."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, matched = None, False
        for b in batches(it):
            cell, salt, who = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if held is not None:
                cell, salt, who = np.append(held[0], cell), np.append(held[1], salt), np.append(held[2], who)
            same = cell[1:] == cell[:-1]
            keep = salt > 0
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= matched
            held, matched = (cell[-1], salt[-1], who[-1]), bool(keep[-1])
            out = keep[:-1]
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(cell[:-1][out]), pa.array(who[:-1][out])], names=["cell", "id"])
        if held is not None and matched:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[2]])], names=["cell", "id"])

    return rows.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "id").mapInArrow(run, "cell long, id long")


def runs(it: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables in which every run of rows with equal first ``keys`` columns is whole; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches(it):
        last = [b.column(i)[b.num_rows - 1].as_py() for i in range(keys)]
        cut = b.num_rows
        same = np.ones(b.num_rows, bool)
        for i in range(keys):
            same &= b.column(i).to_numpy(zero_copy_only=False) == last[i]
        cut = int(np.argmax(same))
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        elif held and [held[-1].column(i)[0].as_py() for i in range(keys)] != last:
            yield pa.Table.from_batches(held)
            held = [b]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _heads(t: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for i in range(keys):
        x = t.column(i).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def _near(n: np.ndarray, m: np.ndarray, i: int, others: np.ndarray, link: Link) -> np.ndarray:
    """Which others may link with i, by sizes and by marks of which equal ones can be told."""
    equal = ((m[others] == m[i]) & (m[i] != 0)).sum(axis=1)
    filled = np.maximum((m[i] != 0).sum(), (m[others] != 0).sum(axis=1))
    small, large = np.minimum(n[i], n[others]), np.maximum(n[i], n[others])
    return (equal >= filled - link.differences(small)) & (small >= link.least(large))


def _cell_groups(cells: DataFrame, marks: DataFrame, hot: DataFrame, link: Link) -> DataFrame:
    """(cell, cls, pivot): members of hot cells that may link with a pivot of their cell."""
    of = cells.join(hot.select("cell"), "cell", "left_semi")
    pivots = of.groupBy("cell", "ring").agg(F.min_by("cls", F.xxhash64(F.lit(5), "cls")).alias("cls")).join(marks, ["cls", "ring"])
    pivots = stored(pivots.select("cell", F.col("cls").alias("pivot"), F.col("n").alias("pn"), F.col("marks").alias("pm")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            ok = np.zeros(b.num_rows, bool)
            n, pn = b.column(3).to_numpy(), b.column(4).to_numpy()
            for i, (x, y) in enumerate(zip(b.column(5).to_pylist(), b.column(6).to_pylist())):
                ok[i] = _near(np.array([n[i], pn[i]]), np.stack([np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)]), 0, np.array([1]), link)[0]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in b.columns[:3]], names=["cell", "cls", "pivot"])

    rows = of.join(pivots, "cell").join(marks, ["cls", "ring"]).select("cell", "cls", "pivot", "n", "pn", "marks", "pm")
    return stored(rows.mapInArrow(run, "cell long, cls long, pivot long"))


def _forest(cells: DataFrame, marks: DataFrame, link: Link) -> DataFrame:
    """(a, b): spanning forests of the pairs in each cell whose sizes and marks allow a link.

    cells: cell, cls, ring; marks: cls, ring, n, marks.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(it, 3):
            heads = _heads(t, 3)
            who, n, own, grp = (t.column(i).to_numpy() for i in range(3, 7))
            crossing = t.column(1).to_numpy() != t.column(2).to_numpy()
            marks = [np.frombuffer(x, np.uint8) for x in t.column(7).to_pylist()]
            a, b = [], []
            for lo, hi in zip(heads[:-1].tolist(), heads[1:].tolist()):
                if hi - lo < 2:
                    continue
                m, size = np.stack(marks[lo:hi]), n[lo:hi]
                ok = np.zeros((hi - lo, hi - lo), bool)
                for i in range(hi - lo - 1):
                    rest = np.arange(i + 1, hi - lo)
                    if grp[lo] or grp[hi - 1] or crossing[lo]:
                        rest = rest[meets(own[lo:hi], grp[lo:hi], crossing[lo:hi], np.full(len(rest), i), rest)]
                    if len(rest):
                        ok[i, rest] = _near(size, m, i, rest, link)
                ok |= ok.T
                left = np.ones(hi - lo, bool)
                for i in range(hi - lo):
                    if not left[i]:
                        continue
                    left[i] = False
                    reach = np.array([i])
                    tree = []
                    while len(reach):
                        reach = np.flatnonzero(ok[reach].any(axis=0) & left)
                        left[reach] = False
                        tree.append(reach)
                    found = np.concatenate(tree)
                    a.append(np.full(len(found), who[lo + i]))
                    b.append(who[lo + found])
            if a and sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    hot = hot_keys(cells, "cell", CELL_BLOCK)
    rows, known = cells.withColumn("grp", F.lit(0).cast("long")), None
    if hot is not None:
        groups = _cell_groups(cells, marks, hot, link)
        known = groups.where("cls <> pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b"))
        rows = cells.join(groups.select("cell", "cls", F.lit(1).cast("long").alias("grp")), ["cell", "cls"], "left").withColumn("grp", F.coalesce("grp", F.lit(0).cast("long")))
    # members come sorted by group, so the ends of a cell tell whether it has any
    out = dealt(rows, "cell", "cls", CELL_BLOCK, hot).join(marks, ["cls", "ring"]).select("cell", "bi", "bj", "cls", "n", "own", "grp", "marks")
    out = out.repartition("cell", "bi", "bj").sortWithinPartitions("cell", "bi", "bj", "grp", "cls").mapInArrow(run, "a long, b long")
    return (out if known is None else out.unionAll(known)).distinct()


class _Region:
    """Sets of a region in memory, and their components so far; members of one group are known to be of one."""

    def __init__(self, sets: list[np.ndarray], link: Link, grp: np.ndarray | None = None):
        self.link, self.r = link, link.radius
        #: Distances that were computed.
        self.measured = 0
        self.n = np.array([len(s) for s in sets])
        _, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.off = np.concatenate(([0], np.cumsum(self.n)))
        self.flag = np.zeros(int(self.flat.max()) + 1, np.int32)
        self.root = np.arange(len(sets))
        if grp is not None and grp.any():
            _, first, of = np.unique(grp, return_index=True, return_inverse=True)
            self.root = np.where(grp == 0, self.root, first[of])
        self.known = self.root == np.arange(len(sets))

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        own = self.flat[self.off[i] : self.off[i + 1]]
        self.flag[own] = 1
        n = self.n[others]
        at = np.repeat(self.off[others] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out = np.add.reduceat(self.flag[self.flat[at]], np.cumsum(n) - n) if len(others) else np.zeros(0, np.int64)
        self.flag[own] = 0
        return out

    def join(self, i: int, others: np.ndarray) -> np.ndarray:
        """Links i with what it links with; the distances to all others."""
        c = self.common(i, others)
        self.measured += len(others)
        linked = others[self.link.holds(c, self.n[i], self.n[others])]
        if len(linked):
            roots = np.unique(np.append(self.root[linked], self.root[i]))
            self.root[np.isin(self.root, roots)] = roots[0]
        return 1.0 - c / (self.n[i] + self.n[others] - c)

    def solve(self, m: np.ndarray) -> None:
        """Joins the members m: by two pivots and their windows if they cut m, else one by one."""
        if len(m) > 24:
            p = m[0]
            d0 = self.join(p, m)
            q = m[int(np.argmax(d0))]
            d1 = self.join(q, m)
            window = 2 * self.r + 1e-9
            near, far = m[d0 - d1 <= window], m[d1 - d0 <= window]
            if max(len(near), len(far)) <= 0.8 * len(m):
                self.solve(near)
                self.solve(far)
                return
        else:
            d0 = np.zeros(len(m))
        for x in range(len(m) - 1):
            i, rest, d = m[x], m[x + 1 :], d0[x + 1 :]
            small, large = np.minimum(self.n[i], self.n[rest]), np.maximum(self.n[i], self.n[rest])
            open_ = (self.root[rest] != self.root[i]) & (np.abs(d - d0[x]) <= self.r + 1e-9) & (small >= self.link.least(large))
            if open_.any():
                self.join(i, rest[open_])


def _solved(rows: DataFrame, link: Link) -> DataFrame:
    """(a, b): stars of the components in each (region, bi, bj), without what groups tell already."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(it, 3):
            heads = _heads(t, 3)
            who, grp = t.column(3).to_numpy(), t.column(4).to_numpy()
            sets = t.column(5)
            a, b = [], []
            for lo, hi in zip(heads[:-1].tolist(), heads[1:].tolist()):
                if hi - lo < 2:
                    continue
                g = _Region([np.frombuffer(x.as_buffer(), np.uint64) for x in sets.slice(lo, hi - lo)], link, grp[lo:hi])
                g.solve(np.arange(hi - lo))
                star = np.flatnonzero(g.known & (g.root != np.arange(hi - lo)))
                a.append(who[lo + g.root[star]])
                b.append(who[lo + star])
            if a and sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return rows.select("region", "bi", "bj", "cls", "grp", "elements").repartition("region", "bi", "bj").sortWithinPartitions("region", "bi", "bj", "cls").mapInArrow(run, "a long, b long")


def _measured(rows: DataFrame, link: Link) -> DataFrame:
    """Adds to members of large regions ``near``, the pivots whose cells or windows they are in, and ``linked``, a bit for each pivot they link with."""
    order = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64(F.lit(5), F.col("cls"))))
    pivots = rows.withColumn("place", order).where(F.col("place") <= PIVOTS)
    pivots = stored(pivots.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("place", "cls", "elements"))).alias("pivots")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            near, linked = [], []
            for own, pivots in zip(b.column(3), b.column(4)):
                own = np.frombuffer(own.as_buffer(), np.uint64)
                d, bits = [], 0
                for j, p in enumerate(pivots):
                    x = np.frombuffer(p["elements"].as_buffer(), np.uint64)
                    c = len(np.intersect1d(own, x, assume_unique=True))
                    d.append(1.0 - c / (len(own) + len(x) - c))
                    bits |= bool(link.holds(c, len(own), len(x))) << j
                near.append(np.flatnonzero(np.array(d) - min(d) <= 2 * link.radius + 1e-9).astype(np.int32))
                linked.append(bits)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(near, pa.list_(pa.int32())), pa.array(linked, pa.int32()), pa.array([[p["cls"].as_py() for p in x] for x in b.column(4)], pa.list_(pa.int64()))], names=["region", "cls", "grp", "elements", "near", "linked", "pivots"])

    return rows.join(pivots, "region").select("region", "cls", "grp", "elements", "pivots").mapInArrow(run, "region long, cls long, grp long, elements binary, near array<int>, linked int, pivots array<bigint>")


def _pivot_groups(measured: DataFrame, depth: int) -> DataFrame:
    """(region, linked, found): the group of members with these bits; pivots that a member links with are one group."""
    sets = measured.where("linked > 0").groupBy("region").agg(F.collect_set("linked").alias("sets"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            for region, sets in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                merged: list[int] = []
                for x in sets:
                    for y in [m for m in merged if m & x]:
                        merged.remove(y)
                        x |= y
                    merged.append(x)
                group = [next(m for m in merged if m & x) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array([region] * len(sets)), pa.array(sets, pa.int32()), pa.array([1 + depth * (1 << PIVOTS) + g for g in group])], names=["region", "linked", "found"])

    return stored(sets.mapInArrow(run, "region long, linked int, found long"))


def _links(members: DataFrame, link: Link) -> DataFrame:
    """(a, b) of linked classes whose components are those of all links; members: region, cls, elements."""
    found: list[DataFrame] = []
    members = members.withColumn("grp", F.lit(0).cast("long"))
    for depth in range(DEPTH + 1):
        hot = hot_keys(members, "region", 2 * REGION_BLOCK)
        if hot is None:
            found.append(_solved(dealt(members, "region", "cls", REGION_BLOCK, None), link))
            break
        found.append(_solved(dealt(members.join(hot.select("region"), "region", "left_anti"), "region", "cls", REGION_BLOCK, None), link))
        large = members.join(hot.select("region"), "region", "left_semi")
        measured = stored(_measured(large, link))
        # what links with a pivot is joined by it, and needs no comparison with what else does
        by_pivot = measured.withColumn("pivot", F.explode(F.filter("pivots", lambda p, j: F.getbit(F.col("linked"), j) == 1)))
        found.append(by_pivot.where("pivot <> cls").select(F.col("pivot").alias("a"), F.col("cls").alias("b")))
        grouped = measured.join(_pivot_groups(measured, depth), ["region", "linked"], "left").withColumn("grp", F.coalesce("found", "grp"))
        before = hot.agg(F.sum("members")).first()[0]
        # pivots that copy most members to most cells cut nothing
        if depth == DEPTH or measured.agg(F.sum(F.size("near"))).first()[0] > 3 * before:
            rest = stored(grouped.select("region", "cls", "grp", "elements"))
            found.append(_solved(dealt(rest, "region", "cls", REGION_BLOCK, hot), link))
            break
        members = stored(grouped.select("region", "cls", "grp", "elements", F.explode("near").alias("cell")).select(F.xxhash64("region", "cell").alias("region"), "cls", "grp", "elements"))
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Components of documents whose k-word shingle sets have a Jaccard similarity of num/den or more, 2/3 at least.

    One row per input row: ``id``, ``n_shingles`` and ``component_id``, the smallest id
    that links reach, itself included. Words are runs of anything but ASCII white space,
    A-Z lowered. A text of fewer than k words is one shingle; a text that is null, empty
    or without words has none and links with nothing. A very long text is compared whole.
    Rows that share an id are one document with the links of all of its texts. A row with
    a null id keeps a null component. No rows give no rows; columns other than the two
    are not read, whatever their names. The id is an integer.
    """
    if 3 * num < 2 * den:
        raise ValueError("links of less than 2/3 reach beyond the next ring")
    link = Link(num, den)
    small_batches(docs.sparkSession)
    source = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    profile = stored(_profiles(source, k, link))
    # an empty set is a class of its own document
    keys = ["fa", "fb", "n", "alone"]
    own = profile.where("id is not null").withColumn("alone", F.when(F.col("n") == 0, F.col("id")).otherwise(0))
    of_ring = lambda home: F.max(F.when(F.col("home") == home, F.struct("ring", "marks"))).alias("own" if home else "low")
    classes = stored(own.groupBy(*keys).agg(F.min("id").alias("first_id"), of_ring(True), of_ring(False)).withColumn("cls", F.monotonically_increasing_id()))
    # the smaller side is stored, so adaptive execution can split the copies of a hot text
    of = stored(own.where("home").join(classes.select(*keys, "cls", "first_id"), keys).select("id", "n", "cls", "first_id"))
    marks = classes.select("cls", "n", F.explode(F.array("own", "low")).alias("x")).select("cls", "n", "x.ring", "x.marks").where("ring >= 0")
    shared = stored(_shared(_cells(source, k, link)))
    release(docs.sparkSession)
    cells = stored(shared.join(of.select("id", "cls").distinct(), "id").select("cell", "cls", F.col("cell").bitwiseAND(63).cast("int").alias("ring")).distinct())
    discard(shared)
    edges = stored(_forest(cells, marks, link))
    discard(cells)
    regions = connected_components(edges)
    release(docs.sparkSession)

    def make(ids, data, off, state):
        h, so = _sets(data, off, k)
        fa, fb = (x.view(np.int64) for x in _fingerprints(h, so))
        yield pa.RecordBatch.from_arrays([ids, pa.array(fa), pa.array(fb), pa.array(np.diff(so)), _binary(so, h)], names=["id", "fa", "fb", "n", "elements"])

    regions = stored(regions.select(F.col("node").alias("cls"), F.col("component").alias("region")).join(classes.select("cls", "fa", "fb", "n", "first_id"), "cls"))
    sets = _over_texts(source.join(regions.select(F.col("first_id").alias("id")), "id", "left_semi"), make, "id long, fa long, fb long, n long, elements binary")
    members = stored(sets.join(regions, ["fa", "fb", "n"]).where("id = first_id").groupBy("region", "cls").agg(F.first("elements").alias("elements")))
    release(docs.sparkSession)
    links = stored(_links(members, link))
    discard(edges, regions, members)
    # the classes of an id with several texts are one
    several = stored(of.groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a < z").select("id", "a"))
    component = stored(connected_components(links.unionAll(several.join(of.select("id", F.col("cls").alias("b")), "id").where("a <> b").select("a", "b"))).withColumnRenamed("node", "cls"))
    named = component.join(classes.select("cls", "first_id"), "cls").groupBy("component").agg(F.min("first_id").alias("component_id"))
    names = stored(component.join(named, "component").select("cls", "component_id"))
    discard(links, several, component)
    linked = of.join(names, "cls", "left").select("id", "n", F.coalesce("component_id", "first_id").alias("component_id"))
    nameless = profile.where("home and id is null").select("id", "n", F.lit(None).cast("long").alias("component_id"))
    return linked.unionAll(nameless).withColumnRenamed("n", "n_shingles")
