"""Spelling variants: words of a corpus that lie one edit apart, joined by halves of words.

A word is cut in two halves. One edit leaves one of them as it is, so two words of
equal length share a half in its place; and a word with one code point more holds the
first half of the shorter one at its beginning or the second one at its end, one place
further on. Words meet in a join on such halves, and each pair is verified.

A half that very many words share would bring all of them together. There the rest of
these words, of which it is known that it holds the edit, is cut in halves again, down
to single code points. At the end only true pairs share a key, so no key costs the
square of its words, and no pair is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import col, discard, stored

#: Runs of these are words.
LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of one key, beyond which their rests are cut again.
CROWD = 64


def _lowered(run: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` is quicker, and does the same where no other capital stands."""
    return F.when(run.rlike("[À-Þ]"), F.translate(run, _UPPER, _LOWER)).otherwise(F.lower(run))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_n: int = 2, slips: int = 31) -> DataFrame:
    """(word, n): words of ``least_length`` code points or more that occur ``least_n`` times or more.

    A word is a maximal run of Latin letters, A-Z lowered. Where ``slips`` divides the
    crc32 of ``<id>:<run>``, one code point of the run is left out, as a slip of a
    writer: the one whose place is the remainder of the crc32 by the length. Null and
    empty texts have no words, a null id counts as empty, and repeated rows count each.
    Other columns are not read.
    """
    run = F.explode(F.regexp_extract_all(col(text_col), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run")
    rows = docs.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"), run).select("id", _lowered(F.col("run")).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    slip = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % slips == 0, slip).otherwise(F.col("run")).alias("word")
    return rows.select(word).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _halves(entries: DataFrame) -> DataFrame:
    """The entries with the rest of their words cut once more: one of two halves goes to the key, the other is the new rest.

    ``rest`` is the length of the rest in the shorter word of a pair; that of a word
    that is ``longer`` has one code point more. A longer word whose rest is two code
    points loses either of them.
    """
    half = F.floor(F.col("rest") / 2).cast("int")
    piece = lambda start, n: F.substr("word", start + 1, n)
    entry = lambda part, text, start, rest: F.struct(F.xxhash64("key", F.lit(part), text).alias("key"), start.alias("start"), rest.alias("rest"))
    start, shift = F.col("start"), F.col("longer")
    left = entry(0, piece(start, half), start + half, F.col("rest") - half)
    right = entry(1, piece(start + half + shift, F.col("rest") - half), start, half)
    whole = entry(2, F.lit(""), start, F.col("rest"))
    last = entry(2, piece(start, F.lit(1)), start, F.lit(0))
    after = entry(2, piece(start + 1, F.lit(1)), start, F.lit(0))
    parts = F.when(F.col("rest") > 1, F.array(left, right)).when(F.col("equal"), F.array(whole)).when(F.col("longer") == 1, F.array_distinct(F.array(last, after))).otherwise(F.array(last))
    return entries.withColumn("e", F.explode(parts)).select("word", "n", "longer", "equal", "e.key", "e.start", "e.rest")


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, na, b, nb): every pair of different words that one inserted, deleted or replaced code point parts, once.

    ``words`` holds (word, n), each word once, of one code point or more.
    """
    length = F.length("word")
    root = lambda equal, longer: F.struct(F.lit(equal).alias("equal"), F.lit(longer).alias("longer"), (length - longer).alias("rest"))
    roots = words.withColumn("r", F.explode(F.array(root(True, 0), root(False, 0), root(False, 1)))).select("word", "n", "r.*")
    entries = stored(_halves(roots.where("rest > 0").withColumn("key", F.xxhash64("equal", "rest")).withColumn("start", F.lit(0))))
    pairs = None
    while True:
        # a rest of one code point in words of equal length, or of none: all of a key are pairs
        open_ = entries.where(F.col("rest") > F.when(F.col("equal"), 1).otherwise(0))
        hot = stored(open_.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > crowd).select("key"))
        more = hot.limit(1).count() > 0
        met = entries.join(hot, "key", "left_anti") if more else entries
        a, b = (met.select("key", *(F.col(c).alias(c + s) for c in ("word", "n", "longer", "equal"))) for s in ("_a", "_b"))
        apart = F.when(F.col("equal_a"), F.col("word_a") < F.col("word_b")).otherwise((F.col("longer_a") == 0) & (F.col("longer_b") == 1))
        found = a.join(b, "key").where((F.col("equal_a") == F.col("equal_b")) & apart & (F.levenshtein("word_a", "word_b", 1) == 1))
        found = stored(found.select(F.col("word_a").alias("a"), F.col("n_a").alias("na"), F.col("word_b").alias("b"), F.col("n_b").alias("nb")).distinct())
        pairs = found if pairs is None else pairs.unionAll(found)
        if not more:
            discard(entries, hot)
            return pairs.distinct()
        old, entries = entries, stored(_halves(entries.join(hot, "key", "left_semi")))
        discard(old, hot)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), following forms by doubling; a form has ten times the count, so paths are short."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(at)
        if not step.where("moved").limit(1).count():
            return step.select("word", "root")
        at = step


def spelling_variants(words: DataFrame, ratio: int = 10, crowd: int = CROWD) -> DataFrame:
    """One row per word of (word, n): ``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n``.

    ``n_near`` counts the words one edit away. ``form`` is the one of largest n (ties:
    the first in code-point order) if its n is ``ratio`` times the word's or more, else
    null, and ``form_n`` its n. ``root`` is reached from the word by following forms;
    a word without form is its own. An empty table gives no rows.
    """
    words = stored(words.select("word", "n"))
    pairs = stored(near_words(words, crowd))
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("own"), F.col("b").alias("other"), F.col("nb").alias("m")).unionAll(pairs.select("b", "nb", "a", "na"))
    best = both.groupBy("word").agg(F.first("own").alias("own"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("own")
    best = stored(best.select("word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    discard(pairs)
    roots = _roots(best.where("form is not null"))
    out = words.join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
