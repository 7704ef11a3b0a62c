"""Benchmark decontamination over a distributed positional inverted index.

The index is split by documents: a segment holds the postings of some documents,
term by term, positions as deltas, and is one row of a stored table. A block of
phrases goes to every segment. There a phrase starts from the postings of its
rarest term in the whole corpus, shifted by the term's offset, and is intersected
with the shifted postings of its next rarer terms; what is left are occurrences.
Texts and postings are never exchanged; only counts of terms and found spans are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import col, small_batches, stored
from ._text import ALNUM, batches, slices, word_hashes, word_spans

#: UTF-8 bytes of phrase texts that are looked up at once; more are looked up block by block.
BLOCK_BYTES = 4 << 20

_SEGMENT = "seg long, rows array<struct<id:{id},n:bigint>>, first binary, terms binary, counts binary, ends binary, postings binary"


def _pack(positions: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions of one term after the other as deltas of 7 bits a byte, the last byte of each with its high bit; and where each term ends."""
    heads = np.cumsum(counts) - counts
    delta = np.diff(positions, prepend=0).astype(np.int64)
    delta[heads] = positions[heads]
    width = 1 + sum((delta >> (7 * i) > 0).astype(np.int64) for i in range(1, 6))
    end = np.cumsum(width)
    out = np.zeros(end[-1] if len(end) else 0, np.uint8)
    for i in range(6):
        some = width > i
        out[end[some] - 1 - i] = (delta[some] >> (7 * i)) & 127
    out[end - 1] |= 128
    return out, end[heads + counts - 1] if len(counts) else np.zeros(0, np.int64)


def _lists(seg: dict, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The positions of the wanted terms of a segment, one list after the other; other lists are not read."""
    data, ends = np.frombuffer(seg["postings"], np.uint8), np.frombuffer(seg["ends"], "<u4").astype(np.int64)
    begins = np.concatenate(([0], ends[:-1]))[wanted]
    n = ends[wanted] - begins
    b = data[np.repeat(begins - np.cumsum(n) + n, n) + np.arange(n.sum())].astype(np.int64)
    last = np.flatnonzero(b >= 128)
    # the 7 bits of a byte stand above those of the bytes after it
    first = np.concatenate(([0], last[:-1] + 1))
    shift = 7 * (np.repeat(last, last - first + 1) - np.arange(len(b)))
    delta = np.add.reduceat((b & 127) << shift, first)
    heads = np.cumsum(counts[wanted]) - counts[wanted]
    total = np.cumsum(delta)
    return total - np.repeat(total[heads] - delta[heads], counts[wanted])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: np.ndarray = ALNUM) -> DataFrame:
    """Stores the postings of all words of all texts; each row is a segment, in which a term's list is read by itself.

    ``rows`` are the ids and word counts of a segment's texts. Null and empty texts have no
    words, null and repeated ids are rows of their own, and an empty table is an empty index.
    """
    small_batches(docs.sparkSession)
    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            for at, data, off in slices(b.column(1)):
                starts, ends, first = word_spans(data, off, table)
                h = word_hashes(data, starts, ends)
                order = np.argsort(h, kind="stable")
                h = h[order]
                heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
                n = len(off) - 1
                rows = pa.StructArray.from_arrays([b.column(0).slice(at, n), pa.array(np.diff(first), pa.int64())], names=["id", "n"])
                one = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows)]
                counts = np.diff(np.append(heads, len(h)))
                packed, ends = _pack(order, counts)
                one += [pa.array([x], pa.binary()) for x in (first.astype("<i8").tobytes(), h[heads].tobytes(), counts.astype("<u4").tobytes(), ends.astype("<u4").tobytes(), packed.tobytes())]
                yield pa.RecordBatch.from_arrays(one, names=["rows", "first", "terms", "counts", "ends", "postings"])

    source = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    made = source.mapInArrow(run, _SEGMENT.format(id=kind).removeprefix("seg long, "))
    return stored(made.select(F.monotonically_increasing_id().alias("seg"), "*"))


def _phrases(items: list[tuple[str | None, str]], window: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct phrases as (terms, lengths), and their owners as (offsets, items): every window of ``window`` words, or a shorter item as one."""
    terms, owner = [np.zeros((0, window + 1), np.uint64)], [np.zeros(0, np.int64)]
    for i, (_, text) in enumerate(items):
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _ = word_spans(data, np.array([0, len(data)]), table)
        h = word_hashes(data, starts, ends)
        if not len(h):
            continue
        m = min(window, len(h))
        w = np.lib.stride_tricks.sliding_window_view(h, m)
        # the length stands first, so that it is part of what is compared
        terms.append(np.pad(w, ((0, 0), (1, window - m))))
        terms[-1][:, 0] = m
        owner.append(np.full(len(w), i))
    rows, who = np.concatenate(terms), np.concatenate(owner)
    distinct, of = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
    pairs = np.unique(np.column_stack((of.ravel(), who)), axis=0) if len(rows) else np.zeros((0, 2), np.int64)
    return distinct[:, 1:], distinct[:, 0].astype(np.int64), np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]


def _occurrences(seg: dict, terms: np.ndarray, lengths: np.ndarray, order: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, document, first word, end) of all occurrences in a segment.

    An occurrence has a beginning, from which every term stands within ``slop`` words of
    its place, all in one document. Of a term's places the nearest counts, the earlier of
    two; the words from the least of them to the largest are found. All beginnings that
    the places of a phrase's rarest term allow are tried, so that the result does not
    depend on which term that is.
    """
    own, none = np.frombuffer(seg["terms"], np.uint64), np.zeros(0, np.int64)
    counts, edge = np.frombuffer(seg["counts"], "<u4").astype(np.int64), np.frombuffer(seg["first"], "<i8")
    if not len(own) or not len(terms):
        return none, none, none, none
    place = np.minimum(np.searchsorted(own, terms), len(own) - 1)
    used = np.arange(terms.shape[1]) < lengths[:, None]
    live = np.flatnonzero(((own[place] == terms) | ~used).all(axis=1))
    if not len(live):
        return none, none, none, none
    wanted = np.unique(place[live][used[live]])
    positions = _lists(seg, counts, wanted)
    place = np.searchsorted(wanted, place)
    counts = counts[wanted]
    heads = np.cumsum(counts) - counts
    key = np.repeat(np.arange(len(wanted)), counts) << 40 | positions
    rare = order[live, 0]
    term = place[live, rare]
    n = counts[term]
    phrase = np.repeat(live, n)
    at = positions[np.repeat(heads[term] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    doc = np.searchsorted(edge, at, "right") - 1
    begin = at - np.repeat(rare, n)
    if not slop:
        # every term stands in its place, so its key is known
        for j in range(1, terms.shape[1]):
            at = order[phrase, j]
            want = (place[phrase, at] << 40) + begin + at
            ok = (key[np.minimum(np.searchsorted(key, want), len(key) - 1)] == want) | (j >= lengths[phrase])
            phrase, doc, begin = phrase[ok], doc[ok], begin[ok]
        ok = (begin >= edge[doc]) & (begin + lengths[phrase] <= edge[doc + 1])
        return phrase[ok], doc[ok], begin[ok], (begin + lengths[phrase])[ok]
    each = np.arange(-slop, slop + 1)
    phrase, doc, begin = np.unique(np.stack([np.repeat(phrase, len(each)), np.repeat(doc, len(each)), (begin[:, None] + each).ravel()]), axis=1)
    low, high = np.full(len(begin), np.iinfo(np.int64).max), np.full(len(begin), -1)
    for j in range(terms.shape[1]):
        more = j < lengths[phrase]
        term, want = place[phrase, order[phrase, j]], begin + order[phrase, j]
        right = np.searchsorted(key, (term << 40) + want)

        def away(i: np.ndarray, term=term, want=want) -> tuple[np.ndarray, np.ndarray]:
            """How far the i-th place is off, and the place; beyond the slop if it is another term's or document's."""
            k = key[np.clip(i, 0, len(key) - 1)]
            p = k & ((1 << 40) - 1)
            far = np.abs(p - want)
            return np.where((i >= 0) & (i < len(key)) & (k >> 40 == term) & (p >= edge[doc]) & (p < edge[doc + 1]), far, slop + 1), p

        (a, left), (b, then) = away(right - 1), away(right)
        found, ok = np.where(a <= b, left, then), (np.minimum(a, b) <= slop) | ~more
        low, high = np.where(more, np.minimum(low, found), low)[ok], np.where(more, np.maximum(high, found), high)[ok]
        phrase, doc, begin = phrase[ok], doc[ok], begin[ok]
    return phrase, doc, low, high + 1


def find_phrases(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 10, slop: int = 0, table: np.ndarray = ALNUM) -> DataFrame:
    """Spans of words where windows of the items occur: (seg, row, item, start, end), end exclusive.

    With ``slop`` above 0 a window also matches where each term lies within so many
    words of its place, in the same document. Overlapping occurrences of an item's
    windows in a document are one span. Items that are null or without words match
    nothing, equal rows of items count once, and an empty index or no items give no
    rows. A phrase that several items hold, or one holds often, is looked up once. Items
    are read in blocks of ``BLOCK_BYTES``; each block is one more pass over the index,
    and all that a task holds of the items.
    """
    spark = index.sparkSession
    small_batches(spark)
    texts = items.select(col(id_col).cast("string").alias("item"), F.coalesce(col(text_col), F.lit("")).alias("text")).distinct()
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    known = _term_counts(index)
    out = None
    for b in range(blocks):
        block = [(r["item"], r["text"]) for r in texts.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()]
        terms, lengths, cut, owner = _phrases(block, window, table)
        vocab = np.unique(terms)
        listed = spark.createDataFrame([(int(x),) for x in vocab.view(np.int64)], "term long")
        seen = {r["term"]: r["n"] for r in known.join(F.broadcast(listed), "term").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        freq = np.array([seen.get(int(x), 0) for x in vocab.view(np.int64)], np.int64)
        count = freq[np.searchsorted(vocab, terms)] if len(vocab) else np.zeros(terms.shape, np.int64)
        count[np.arange(window) >= lengths[:, None]] = np.iinfo(np.int64).max
        keep = (count > 0).all(axis=1)
        terms, lengths, order = terms[keep], lengths[keep], np.argsort(count[keep], axis=1, kind="stable")
        sent = spark.sparkContext.broadcast((terms, lengths, cut[:-1][keep], np.diff(cut)[keep], owner, order, [x[0] for x in block]))

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            terms, lengths, cut, owners, owner, order, names = sent.value
            for batch in batches(it):
                for seg in batch.to_pylist():
                    phrase, doc, start, end = _occurrences(seg, terms, lengths, order, slop)
                    if not len(phrase):
                        continue
                    first = np.frombuffer(seg["first"], "<i8")
                    # each occurrence counts for all items that hold the phrase
                    n = owners[phrase]
                    item = owner[np.repeat(cut[phrase] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    doc, start, end = np.repeat(doc, n), np.repeat(start, n), np.repeat(end, n)
                    o = np.lexsort((start, item, doc))
                    doc, item, start, end = doc[o], item[o], start[o], end[o]
                    same = np.zeros(len(doc), bool)
                    same[1:] = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1])
                    # the furthest end so far, in each run of a document and an item
                    run = np.cumsum(~same)
                    end = np.maximum.accumulate(run * (1 << 42) + end) - run * (1 << 42)
                    new = ~same
                    new[1:] |= start[1:] > end[:-1]
                    heads = np.flatnonzero(new)
                    last = np.append(heads[1:], len(doc)) - 1
                    begin = first[doc[heads]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(heads), seg["seg"])), pa.array(doc[heads].astype(np.int32)), pa.array([names[i] for i in item[heads]], pa.string()), pa.array(start[heads] - begin), pa.array(end[last] - begin)],
                        names=["seg", "row", "item", "start", "end"],
                    )

        found = index.select("seg", "first", "terms", "counts", "ends", "postings").mapInArrow(run, "seg long, row int, item string, start long, end long")
        out = found if out is None else out.unionAll(found)
    return out


def _term_counts(index: DataFrame) -> DataFrame:
    """(term, n) of each segment."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, np.int64)), pa.array(np.frombuffer(c, "<u4").astype(np.int64))], names=["term", "n"])

    return index.select("terms", "counts").mapInArrow(run, "term long, n long")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, slop: int = 0) -> DataFrame:
    """How far each text holds passages of the items.

    One row per input row: ``id``, ``n_words``, ``n_hit`` (words inside any occurrence
    of a window), ``items`` (ids as strings, sorted, each once) and ``contaminated``.
    An item of fewer words than ``window`` is one window. Null and empty texts have no
    words, a very long text is searched whole; a null item id makes hits but is not
    listed. Repeated rows and rows with equal or null ids are judged each on its own. Other
    columns are not read. No documents give no rows, and no items no hits.
    """
    index = build_index(docs, id_col, text_col)
    spans = find_phrases(index, items, item_id_col, item_text_col, window, slop)
    before = F.max("end").over(Window.partitionBy("seg", "row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    hits = (
        spans.withColumn("fresh", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.col("start")))))
        .groupBy("seg", "row").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    )
    rows = index.select("seg", F.posexplode("rows").alias("row", "x"))
    return rows.join(hits, ["seg", "row"], "left").select(
        "x.id", F.col("x.n").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
