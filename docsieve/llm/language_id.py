"""Language identification by compression.

For each language a zstandard raw-content dictionary of labelled texts is made; a
text is encoded with every dictionary, in blocks, and the language whose dictionary
gives the fewest bytes wins. A narrow margin to the second one rejects the text.
Texts are reduced to lower-case words first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import col, small_batches, with_row
from ._text import batches

#: Bound of the labelled sample: distinct texts of a language.
SAMPLE_TEXTS = 512
#: A text is encoded in blocks of so many bytes, so that its own words do not crowd out the dictionary.
BLOCK = 4096
LEVEL = 6
#: Rejected if the second-best size is not larger by this share of the best.
MARGIN = 0.002

_WORDS = re.compile(r"[^\W\d_]+")


def normal(text: str) -> str:
    """Lower-case words between single blanks."""
    return f" {' '.join(_WORDS.findall(text.lower()))} "


def held_in(id_col: str, modulus: int = 4, held_out: int = 2) -> Column:
    """Rows to learn from: crc32 of the id as text does not leave the remainder that is held out."""
    return F.coalesce(_remainder(id_col, modulus) != held_out, F.lit(False))


def is_held_out(id_col: str, modulus: int = 4, held_out: int = 2) -> Column:
    """Rows whose remainder is the one that is held out; a null id has no remainder, so it is neither held out nor learned from."""
    return F.coalesce(_remainder(id_col, modulus) == held_out, F.lit(False))


def _remainder(id_col: str, modulus: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def fit_languages(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS) -> dict[str, bytes]:
    """A dictionary for each label: ``sample_texts`` of its distinct texts, those of the smallest hashes, whole and in that order.

    Rows without text or label teach nothing, and copies of a text teach as much as one
    of them; a label of fewer texts has all of them. What reaches the driver is bounded
    by the number of labels and that of texts of each. An empty table teaches no label.
    """
    texts = labelled.where(col(lang_col).isNotNull() & (F.length(col(text_col)) > 0)).select(col(lang_col).cast("string").alias("lang"), F.xxhash64(col(text_col)).alias("h"), col(text_col).alias("text"))
    # bits of a hash above the smallest one: counts of distinct texts by them tell how many bits hold a whole sample
    bits = F.length(F.bin(F.col("h").bitwiseXOR(F.lit(-(2**63)))))
    count: dict[str, dict[int, int]] = {}
    for r in texts.select("lang", "h").distinct().groupBy("lang", bits.alias("bits")).agg(F.count("*").alias("n")).collect():
        count.setdefault(r["lang"], {})[r["bits"]] = r["n"]
    if not count:
        return {}
    limit = {}
    for lang, own in count.items():
        below = 0
        for limit[lang] in sorted(own):
            below += own[limit[lang]]
            if below >= sample_texts:
                break
    most = F.create_map(*[F.lit(x) for item in limit.items() for x in item])[F.col("lang")]
    rows = texts.where(bits <= most).groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked: dict[str, list[bytes]] = {}
    for r in rows.withColumn("n", order).where(F.col("n") <= sample_texts).orderBy("lang", "n").toLocalIterator():
        picked.setdefault(r["lang"], []).append(normal(r["text"]).encode())
    return {lang: data for lang, parts in picked.items() if len(data := b"".join(parts)) >= 8}


class Sizer:
    """Encoded sizes of a text under each language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.zip = [self._compressor(dictionaries[x]) for x in self.langs]

    @staticmethod
    def _compressor(data: bytes):
        import zstandard as z

        d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
        # parameters for the whole dictionary, so that all of it can be referred to
        p = z.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(data), source_size=BLOCK, write_content_size=False, write_checksum=False, write_dict_id=False)
        d.precompute_compress(compression_params=p)
        return z.ZstdCompressor(dict_data=d, compression_params=p)

    def sizes(self, text: str) -> np.ndarray:
        data = normal(text).encode()
        return np.array([sum(len(c.compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK)) for c in self.zip], float)

    def decide(self, text: str) -> tuple[str, float, float]:
        """(label, score, relative margin); ties go to the first label in order."""
        sizes = self.sizes(text)
        best = int(np.argmin(sizes))
        # half a bit of evidence for each byte that is saved
        return self.langs[best], float(1.0 / np.exp2(-0.5 * np.minimum(200, sizes - sizes[best])).sum()), _margin(sizes)


def _margin(sizes: np.ndarray) -> float:
    """How much larger the second-best size is, as a share of the best; 1 for a single label."""
    if len(sizes) < 2:
        return 1.0
    a, b = np.partition(sizes, 1)[:2]
    return float((b - a) / a)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """One row per input row: ``row`` (a struct of all input columns), ``lang_pred``, ``score`` (0 to 1) and ``rejected``.

    A text that is null or has no letter is ``und`` with score 0 and is rejected, as is
    any text if nothing was learned. A text is also rejected if its margin is under
    ``margin``; its best label stands all the same. A very long text is encoded whole,
    in blocks. Ties between labels go to the first in order, and are rejected. Repeated
    rows, null ids and clashing column names change nothing; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(dictionaries)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sizer(sent.value)
        for b in batches(it):
            lang, score, out = [], [], []
            for x in b.column(1):
                t = x.as_py()
                if not t or not s.langs or not (t.isalpha() or any(map(str.isalpha, t))):
                    lang.append("und"), score.append(0.0), out.append(True)
                    continue
                best, p, gap = s.decide(t)
                lang.append(best), score.append(p), out.append(gap < margin)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], names=["row", "lang_pred", "score", "rejected"])

    packed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(text_col).alias("text"))
    return packed.mapInArrow(run, with_row(packed, "lang_pred string, score double, rejected boolean"))
