"""Words that are alike to labels, found without comparing every word with every label.

Two texts are alike if their matching blocks hold a share of both. A text that is alike
to a name differs from it by a bounded number of letters left out or put in; so of that
many pieces of the name and one more, one stands in the text as it is, hardly moved.
The pieces are an index that texts meet in an equi join; only pairs that share a piece
are measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let


def blocks_ratio(a: Column, b: Column) -> Column:
    """Twice the letters of matching blocks over the letters of both texts: the longest common block, then what lies left and right of it.

    Of equally long blocks the first of ``a`` counts, and there the first of ``b``. Equal texts
    give 1, two empty ones too; popular letters of long texts count as all others.
    """
    empty = F.array().cast("array<struct<al:int,an:int,bl:int,bn:int>>")

    def region(al, an, bl, bn) -> Column:
        part = F.struct(al.cast("int").alias("al"), an.cast("int").alias("an"), bl.cast("int").alias("bl"), bn.cast("int").alias("bn"))
        return F.when((an > 0) & (bn > 0), F.array(part)).otherwise(empty)

    def measured(x: Column, y: Column) -> Column:
        # how long a block of x can begin at each place: a block in y has all of its beginnings in y
        reach = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.size(F.filter(F.sequence(F.lit(1), F.length(x) - i + 1), lambda n: F.contains(y, F.substring(x, i, n)))))
        longest = lambda r: let(F.array_max(r), lambda n: F.struct(n.alias("n"), F.array_position(r, n).cast("int").alias("i")))
        return let(let(reach, longest), lambda m: F.struct(m["n"].alias("n"), (m["i"] - 1).alias("i"), (F.call_function("locate", F.substring(x, m["i"], m["n"]), y) - 1).alias("j")))

    def step(s: Column, _: Column) -> Column:
        def cut(t: Column) -> Column:
            block = measured(F.substring(a, t["al"] + 1, t["an"]), F.substring(b, t["bl"] + 1, t["bn"]))
            rest = F.slice(s["todo"], 1, F.size(s["todo"]) - 1)

            def parts(m: Column) -> Column:
                left = region(t["al"], m["i"], t["bl"], m["j"])
                right = region(t["al"] + m["i"] + m["n"], t["an"] - m["i"] - m["n"], t["bl"] + m["j"] + m["n"], t["bn"] - m["j"] - m["n"])
                return F.struct(F.when(m["n"] > 0, F.concat(rest, left, right)).otherwise(rest).alias("todo"), (s["hits"] + m["n"]).cast("int").alias("hits"))

            return let(block, parts)

        return F.when(F.size(s["todo"]) > 0, let(F.element_at(s["todo"], -1), cut)).otherwise(s)

    la, lb = F.length(a), F.length(b)
    start = F.struct(region(F.lit(0), la, F.lit(0), lb).alias("todo"), F.lit(0).alias("hits"))
    # each region gives a block or ends, and there are no more blocks than letters
    rounds = F.sequence(F.lit(1), 2 * F.least(la, lb) + 1)
    return F.when(a == b, F.lit(1.0)).otherwise(F.aggregate(rounds, start, step, lambda s: 2.0 * s["hits"] / (la + lb)))


def odds(a: Column | int, b: Column | int, least: float):
    """Letters that two alike texts of these lengths may leave out or put in."""
    return (1 - least) * (a + b) + 1e-9


def alike(a: Column, b: Column, least: float) -> Column:
    """Is the ratio ``least`` or more? Texts too far apart by edits are not measured; null or empty texts are alike to nothing."""
    spare = F.floor(odds(F.length(a), F.length(b), least)).cast("int")
    # an edit is one letter left out, put in, or both
    near = (F.abs(F.length(a) - F.length(b)) <= spare) & (F.levenshtein(a, b) <= spare)
    return F.coalesce((a != "") & (b != "") & F.when(near, blocks_ratio(a, b) >= least).otherwise(False), F.lit(False))


def pieces(name: str, least: float) -> list[tuple[str, int, int]]:
    """(piece, place, spare) of a name: one more than letters may differ in the longest text that is still alike."""
    spare = int(odds(len(name), int(len(name) * (2 - least) / least), least))
    n = spare + 1
    cuts = [len(name) * i // n for i in range(n + 1)]
    return [(name[i:j], i, spare) for i, j in zip(cuts, cuts[1:]) if j > i]


def index(spark: SparkSession, names: list[str], least: float) -> DataFrame:
    """(piece, place, spare, name, words): the pieces of names, which are given with single blanks between their words."""
    rows = [(p, at, spare, name, name.count(" ") + 1) for name in dict.fromkeys(names) for p, at, spare in pieces(name, least)]
    return spark.createDataFrame(rows, "piece string, place int, spare int, name string, words int")


def alike_names(texts: DataFrame, names: list[str], least: float) -> DataFrame:
    """(text, name) of texts alike to a name of as many words; texts: ``text``, each once, with single blanks."""
    table = index(texts.sparkSession, names, least)
    widths = sorted({len(p) for name in names for p, *_ in pieces(name, least)})
    gram = lambda n: F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.struct(F.substring("text", i, F.lit(n)).alias("piece"), (i - 1).alias("at")))
    grams = F.concat(*[F.when(F.length("text") >= n, gram(n)).otherwise(F.array().cast("array<struct<piece:string,at:int>>")) for n in widths])
    held = texts.select("text", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).alias("n"), F.explode_outer(F.array_distinct(grams)).alias("g")).select("text", "n", "g.*")
    met = held.join(table, "piece").where((F.col("n") == F.col("words")) & (F.abs(F.col("at") - F.col("place")) <= F.col("spare")))
    return met.select("text", "name").distinct().where(alike(F.col("text"), F.col("name"), least))
