"""Front and back of a card against each other and against what a person declares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import first, let, name_form, row_form

FIELDS = ("dni", "fecha_nacimiento", "apellidos", "nombre", "fecha_caducidad")
NAMES = ("apellidos", "nombre")
#: Least similarity of names that counts as a misreading rather than another name.
LEAST_SIMILARITY = 0.70
LINE = 30


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, of names as the zone spells them; 1 if both are empty."""
    return _similar(name_form(a), name_form(b))


def _similar(a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def similarity_any_order(a: Column, b: Column) -> Column:
    """The better of the similarity as written and with the words sorted."""
    in_order = lambda t: F.array_join(F.array_sort(F.split(t, " ")), " ")
    return let(F.array(name_form(a), name_form(b)), lambda n: F.greatest(_similar(n[0], n[1]), _similar(in_order(n[0]), in_order(n[1]))))


def line_full(surnames: Column, given: Column) -> Column:
    """The name line of the zone has no room left, so that names may be cut off."""
    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    return n(surnames) + 2 + n(given) >= LINE


def compare(field: Column, front: Column, back: Column, full: Column) -> Column:
    """coincide, parecido, distinto, or falta if a side is not read."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    plain = lambda c: F.upper(F.replace(c, F.lit(" "), F.lit("")))
    tight = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    names = let(
        F.array(name_form(front), name_form(back)),
        lambda n: F.when((tight(n[0]) == tight(n[1])) | (full & F.startswith(tight(n[0]), tight(n[1]))), "coincide").when(_similar(n[0], n[1]) >= LEAST_SIMILARITY, "parecido").otherwise("distinto"),
    )
    return F.when(empty(front) | empty(back), "falta").when(field.isin(*NAMES), names).otherwise(F.when(plain(front) == plain(back), "coincide").otherwise("distinto"))


def match_fields(front: DataFrame, back: DataFrame) -> DataFrame:
    """One row per person and field: what is chosen of the front's candidates, its state, and the other candidates.

    front: person_id, field, value, source, ord; back: person_id, field, value, full.
    A candidate that coincides wins, then one that is alike, then the most frequent;
    ties go to the first in order. A field of the back without candidates is ``falta``.
    """
    c = front.where(F.coalesce(F.col("value"), F.lit("")) != "")
    joined = c.join(back.select("person_id", "field", F.col("value").alias("back"), "full"), ["person_id", "field"])
    joined = joined.withColumn("state", compare(F.col("field"), F.col("value"), F.col("back"), F.col("full")))
    key = F.when(F.col("field").isin(*NAMES), name_form(F.col("value"))).otherwise(F.upper(F.replace("value", F.lit(" "), F.lit(""))))
    same = Window.partitionBy("person_id", "field", "key")
    ranked = joined.withColumn("key", key).withColumns({"freq": F.count("*").over(same), "seen": F.min("ord").over(same)})
    rank = F.when(F.col("state") == "coincide", 0).when(F.col("state") == "parecido", 1).otherwise(2)
    # among the rest the most frequent key counts, the earliest seen on ties, and its first candidate
    order = F.struct(rank.alias("r"), F.when(rank == 2, -F.col("freq")).otherwise(0).alias("f"), F.when(rank == 2, F.col("seen")).otherwise(0).alias("s"), F.col("ord").alias("o"))
    best = ranked.groupBy("person_id", "field").agg(F.min_by(F.struct("value", "source", "state"), order).alias("best"), F.array_sort(F.collect_set("value")).alias("all"))
    out = back.select("person_id", "field", F.col("value").alias("back")).join(best, ["person_id", "field"], "left")
    return out.select(
        "person_id", "field", F.col("best.value").alias("front"), F.col("best.source").alias("source"), F.col("back").alias("back"),
        F.coalesce("best.state", F.lit("falta")).alias("state"), F.array_except(F.coalesce("all", F.array().cast("array<string>")), F.array("best.value")).alias("others"),
    )


def declared_match(df: DataFrame, declared: str, dni: str, name: str, back_name: str, front_name: str, back_dni: str, front_dni: str) -> DataFrame:
    """Adds a struct: the declared number against what is read, and the declared full name against the better of both sides."""
    c = lambda n: F.col(n)
    number = F.upper(F.regexp_replace(F.coalesce(c(dni), F.lit("")), "[ -]", ""))
    read = F.coalesce(F.when(c(back_dni) != "", c(back_dni)), c(front_dni))
    number_state = F.when(number == "", None).when(read.isNull(), "falta").when(read == number, "coincide").otherwise("distinto")
    usable = lambda n: F.coalesce(c(n), F.lit("")) != ""
    sim = lambda n: F.when(usable(n), similarity_any_order(c(name), c(n)))
    out = df.withColumns({"_sb": sim(back_name), "_sf": sim(front_name)})
    best = F.greatest("_sb", "_sf")
    wanted = F.trim(F.coalesce(c(name), F.lit(""))) != ""
    state = F.when(~wanted, None).when(best.isNull(), "falta").when(best == 1, "coincide").when(best >= LEAST_SIMILARITY, "parecido").otherwise("distinto")
    first_best = F.when(F.col("_sb") >= F.coalesce("_sf", F.lit(-1.0)), c(back_name)).otherwise(c(front_name))
    return out.withColumn(declared, F.struct(number_state.alias("dni_state"), state.alias("name_state"), F.when(wanted, first_best).alias("name_read"), F.when(wanted, F.bround(best, 3)).alias("similarity"))).drop("_sb", "_sf")


def decide(fields: DataFrame, zone_valid: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(person_id, result, decision, detail) from match_fields, (person_id, valid) and (person_id, item, state) of declared data.

    rechazar if anything differs; revisar without a valid zone or with something unread; else aprobar.
    """
    place = F.create_map(*[x for i, f in enumerate(FIELDS) for x in (F.lit(f), F.lit(i))])
    rows = fields.select("person_id", "field", "state", place[F.col("field")].alias("ord"), F.lit(True).alias("card"))
    if declared is not None:
        rows = rows.unionByName(declared.where("state is not null").select("person_id", F.concat("item", F.lit(" declarado")).alias("field"), "state", F.when(F.col("item") == "dni", 10).otherwise(11).alias("ord"), F.lit(False).alias("card")))
    got = rows.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("ord", "field", "state"))).alias("s"), F.bool_or(F.col("card") & (F.col("state") == "distinto")).alias("bad"), F.bool_and(F.col("state").eqNullSafe("coincide") | ~F.col("card")).alias("good"))
    named = lambda state: F.array_join(F.transform(F.filter("s", lambda x: x["state"] == state), lambda x: x["field"]), ", ")
    has = lambda state: F.exists("s", lambda x: x["state"] == state)
    got = got.join(zone_valid, "person_id", "left")
    return got.select(
        "person_id", F.when(F.col("bad"), "no_cuadra").when(F.col("good"), "cuadra").otherwise("revisar").alias("result"),
        F.when(has("distinto"), "rechazar").when(~F.coalesce("valid", F.lit(False)) | has("falta"), "revisar").otherwise("aprobar").alias("decision"),
        F.when(has("distinto"), named("distinto")).when(~F.coalesce("valid", F.lit(False)), "mrz").when(has("falta"), named("falta")).otherwise(named("parecido")).alias("detail"),
    )


def spelled_alike(a: Column, b: Column) -> Column:
    """Equal down to accents and signs."""
    return row_form(a) == row_form(b)


__all__ = ["FIELDS", "NAMES", "compare", "decide", "declared_match", "first", "line_full", "match_fields", "similarity", "similarity_any_order", "spelled_alike"]
