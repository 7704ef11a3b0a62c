"""Accuracy reports over batches: cards by photo and engine, documents by field."""

from __future__ import annotations

import fnmatch
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from .._ship import ship
from ..functions.text import report_form, truth_form

CARD_FIELDS = ("dni", "num_soporte", "fecha_nacimiento", "fecha_caducidad", "sexo", "apellidos", "nombre")
#: Fields that check digits cover fully, and those that they cover in part or not at all.
PROTECTED = ("dni", "soporte_digitos", "fecha_nacimiento", "fecha_caducidad")
UNPROTECTED = ("sexo", "apellidos", "nombre", "soporte_letras")
VERDICTS = ("apta", "riesgo", "rechazar")
#: Literal signs of a glob, at its beginning or end, by which files meet it.
GLOB_PART = 16


def share(part: Column, whole: Column) -> Column:
    """Per cent; null over nothing."""
    return F.try_divide(100.0 * part, whole)


def glob_pattern(glob: str) -> str:
    """A file glob as a regular expression that Java reads too."""
    return "^" + re.sub(r"\(\?s:(.*)\)\\[Zz]$", r"(?s:\1)$", fnmatch.translate(glob)).replace(r"\Z", "$").removeprefix("^")


def glob_parts(glob: str) -> tuple[str, str, str]:
    """(literal prefix, literal suffix, pattern) of a file glob: what stands before its first and after its last wildcard."""
    first = re.search(r"[*?\[]", glob)
    prefix = glob[: first.start()] if first else glob
    # a bracket may hold wildcards, and only one that is closed is one
    last = max((m.end() for m in re.finditer(r"\*|\?|\[!?\]?[^\]]*\]|\[", glob)), default=0)
    return prefix, glob[last:], glob_pattern(glob)


@F.pandas_udf(StructType([StructField(c, StringType()) for c in ("prefix", "suffix", "pattern")]))
def _parts_of(globs: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([glob_parts(g) for g in globs], columns=["prefix", "suffix", "pattern"])


def truth_lookup(files: DataFrame, truth: DataFrame, part: int = GLOB_PART) -> DataFrame:
    """The truth of each file: by its path or name, else by the first glob that fits; files without one have nulls.

    files: path; truth: ord, key, and anything else. Exact keys join by hash. A glob goes
    by its literal beginning or end, whichever is longer, up to ``part`` signs; a path and
    a name have as many beginnings and ends of so many signs, so they meet globs in an
    equi join and try the patterns of those only. Globs without any literal sign at
    either end stand under the empty key, which every file has.
    """
    ship(files.sparkSession)
    name = F.element_at(F.split("path", "/"), -1)
    own = F.explode(F.array_distinct(F.array("path", name)))
    exact = files.select("path", own.alias("key")).join(truth, "key").groupBy("path").agg(F.min_by(F.struct(*truth.columns), "ord").alias("t"))
    globs = truth.where(F.col("key").rlike(r"[*?\[]")).select("ord", _parts_of("key").alias("p")).select("ord", "p.*")
    ahead = F.length("prefix") >= F.length("suffix")
    key = F.when(ahead, F.substring("prefix", 1, part)).otherwise(F.right("suffix", F.lit(part)))
    globs = globs.select("ord", "pattern", F.when(key == "", "any").when(ahead, "begins").otherwise("ends").alias("how"), key.alias("part"))
    rest = files.join(exact.select("path"), "path", "left_anti").select("path", own.alias("text"))
    # only beginnings and ends of lengths that globs have
    used = [(r["how"], r["n"]) for r in globs.select("how", F.length("part").alias("n")).distinct().collect()]
    cut = {"any": lambda n: F.lit(""), "begins": lambda n: F.substring("text", 1, n), "ends": lambda n: F.right("text", F.lit(n))}
    sides = [F.when(F.length("text") >= n, F.struct(F.lit(how).alias("how"), cut[how](n).alias("part"))) for how, n in used] or [F.lit(None).cast("struct<how:string,part:string>")]
    ways = rest.select("path", "text", F.explode(F.filter(F.array(*sides), lambda s: s.isNotNull())).alias("w")).select("path", "text", "w.*")
    hit = ways.join(globs, ["how", "part"]).where(F.regexp_like("text", "pattern")).groupBy("path").agg(F.min("ord").alias("ord"))
    by_glob = hit.join(truth, "ord").select("path", F.struct(*truth.columns).alias("t"))
    return files.join(exact.unionByName(by_glob), "path", "left").select("path", F.col("t.ord").alias("ord"), F.col("t.key").alias("key"))


def compare_fields(rows: DataFrame, cut: str = "cut") -> DataFrame:
    """Adds ``ok`` to (…, field, read, truth, cut): equal as words or dates; names may be cut off where ``cut`` says so.

    Rows without truth go. Support numbers give rows of their digits and letters too.
    """
    t, r = truth_form(F.col("truth"), F.col("field")), truth_form(F.col("read"), F.col("field"))
    d = rows.withColumns({"_t": t, "_r": r}).where("_t <> ''")
    tight = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    cut_off = F.col(cut) & F.col("field").isin("apellidos", "nombre") & (F.col("_r") != "") & F.startswith(tight("_t"), tight("_r"))
    whole = F.struct(F.col("field").alias("f"), ((F.col("_r") == F.col("_t")) | cut_off).alias("ok"))
    part = lambda name, a, n: F.struct(F.lit(name).alias("f"), (F.substring(tight("_t"), a, n) == F.substring(tight("_r"), a, n)).alias("ok"))
    all_ = F.when((F.col("field") == "num_soporte") & (F.length(tight("_t")) == 9), F.array(whole, part("soporte_digitos", 4, 99), part("soporte_letras", 1, 3))).otherwise(F.array(whole))
    keep = [c for c in rows.columns if c not in ("field",)]
    return d.select(*keep, F.explode_outer(all_).alias("_x")).select(*keep, F.col("_x.f").alias("field"), F.col("_x.ok").alias("ok"))


def result_rows(readings: DataFrame, compared: DataFrame) -> DataFrame:
    """One row per photo and engine: (photo_id, engine, valid, ms, fields_ok, failed, valid_wrong, valid_unprotected_wrong).

    readings: photo_id, engine, valid, ms; compared: photo_id, engine, field, ok as
    compare_fields() gives them. ``fields_ok`` counts the fields of a card, "right/compared",
    and ``failed`` names the wrong ones in their order. A wrong field that check digits cover
    is what must not be in a valid reading; wrong ones that they do not cover are told apart.
    Without truth these columns are null.
    """
    order = F.array_position(F.array(*map(F.lit, CARD_FIELDS)), F.col("field"))
    own, bad = F.col("field").isin(*CARD_FIELDS), ~F.col("ok")
    per = compared.groupBy("photo_id", "engine").agg(
        F.count_if(own & F.col("ok")).alias("right"), F.count_if(own).alias("compared"), F.array_sort(F.collect_list(F.when(own & bad, F.struct(order.alias("n"), F.col("field").alias("f"))))).alias("w"),
        F.max(bad & F.col("field").isin(*PROTECTED)).alias("p"), F.max(bad & F.col("field").isin(*UNPROTECTED)).alias("u"),
    )
    return readings.join(per, ["photo_id", "engine"], "left").select(
        "photo_id", "engine", "valid", "ms", F.concat(F.col("right").cast("string"), F.lit("/"), F.col("compared").cast("string")).alias("fields_ok"), F.transform("w", lambda x: x["f"]).alias("failed"),
        *[F.when(F.col(c).isNotNull(), F.col("valid") & F.col(c)).alias(n) for c, n in (("p", "valid_wrong"), ("u", "valid_unprotected_wrong"))],
    )


def engine_summary(rows: DataFrame) -> DataFrame:
    """Per engine: photos, % valid, mean ms, % with all fields right, valid ones with a wrong protected or unprotected field.

    rows: engine, valid, ms, has_truth, failed (array of fields).
    """
    wrong = lambda names: F.count_if(F.col("has_truth") & F.col("valid") & F.arrays_overlap("failed", F.array(*map(F.lit, names))))
    return rows.groupBy("engine").agg(
        F.count("*").alias("photos"), share(F.count_if("valid"), F.count("*")).alias("pct_valid"), F.avg("ms").alias("mean_ms"),
        share(F.count_if(F.col("has_truth") & (F.size("failed") == 0)), F.count_if("has_truth")).alias("pct_all_right"), wrong(PROTECTED).alias("valid_wrong"), wrong(UNPROTECTED).alias("valid_unprotected_wrong"),
    )


def field_accuracy(rows: DataFrame, fields: tuple[str, ...] = CARD_FIELDS) -> DataFrame:
    """% right per field and engine. Only listed failures count, over all photos with truth: a field without truth is a hit."""
    counted = rows.where("has_truth").groupBy("engine").agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("failed", f)).alias(f) for f in fields])
    return counted.unpivot(["engine", "n"], list(fields), "field", "failed").select("engine", "field", share(F.col("n") - F.col("failed"), F.col("n")).alias("pct"))


def filter_scenario(rows: DataFrame) -> DataFrame:
    """Per engine: % of photos that the quality filter rejects, and % valid among those that pass."""
    passes = F.col("verdict") != "rechazar"
    return rows.groupBy("engine").agg(share(F.count_if(~passes), F.count("*")).alias("pct_rejected"), share(F.count_if(passes & F.col("valid")), F.count_if(passes)).alias("pct_valid_passing"))


def retry_curve(rows: DataFrame, most: int = 10) -> DataFrame:
    """(engine, policy, k, pct): groups solved within k photos in the order of their names.

    Policy A skips photos that the filter rejects, B tries all; both count the photo.
    Each group's solving photo is one number, so the curve is a cumulative count.
    """
    place = F.row_number().over(Window.partitionBy("engine", "group_id").orderBy("file"))
    solved = rows.where("group_id is not null").withColumn("n", place).groupBy("engine", "group_id").agg(
        F.min(F.when(F.col("valid") & (F.col("verdict") != "rechazar"), F.col("n"))).alias("A"), F.min(F.when(F.col("valid"), F.col("n"))).alias("B")
    )
    long_ = solved.unpivot(["engine", "group_id"], ["A", "B"], "policy", "solved_at")
    at = long_.groupBy("engine", "policy").agg(F.count("*").alias("groups"), *[F.count_if(F.col("solved_at") <= i).alias(f"k{i}") for i in range(1, most + 1)])
    return at.unpivot(["engine", "policy", "groups"], [f"k{i}" for i in range(1, most + 1)], "k", "n").select("engine", "policy", F.substring("k", 2, 9).cast("int").alias("k"), share(F.col("n"), F.col("groups")).alias("pct"))


def quality_by_validity(rows: DataFrame, engines: list[str]) -> DataFrame:
    """(verdict, photos, one column per engine): % of valid zones; verdicts without photos are left out."""
    got = rows.groupBy("verdict").pivot("engine", engines).agg(share(F.count_if("valid"), F.count(F.lit(1))))
    return rows.groupBy("verdict").agg(F.count_distinct("file").alias("photos")).join(got, "verdict")


def batch_report(rows: DataFrame, most: int = 10) -> DataFrame:
    """(report, engine, verdict, name, k, value): engine_summary, field_accuracy, filter_scenario, retry_curve and quality_by_validity from one scan.

    rows: file, group_id, engine, verdict, valid, ms, has_truth, failed. Each row counts for
    its engine and verdict, its file and its group at once. These are exchanged as sums of
    each task, with the photos of a group, and then once more as sums of the reports. Values
    that have no photos to go by are left out.
    """
    none = F.lit(None).cast("string")
    unit = lambda kind, a, b, c: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), c.cast("string").alias("c"))
    engine, verdict = F.col("engine"), F.col("verdict")
    passes, truth = verdict != "rechazar", F.col("has_truth")
    wrong = lambda names: truth & F.col("valid") & F.arrays_overlap("failed", F.array(*map(F.lit, names)))
    counted = {
        "n": F.lit(True), "valid": F.col("valid"), "rejected": ~passes, "passing": passes, "passing_valid": passes & F.col("valid"), "truth": truth, "all_right": truth & (F.size("failed") == 0),
        "wrong": wrong(PROTECTED), "unprotected_wrong": wrong(UNPROTECTED), **{f"f_{f}": truth & F.array_contains("failed", f) for f in CARD_FIELDS},
    }
    is_group, is_sum = F.col("u.kind") == "group", F.col("u.kind") == "engine"
    units = F.array(unit("engine", engine, verdict, none), unit("file", none, verdict, F.col("file")), F.when(F.col("group_id").isNotNull(), unit("group", engine, none, F.col("group_id"))))
    d = rows.select("*", F.explode(F.filter(units, lambda x: x.isNotNull())).alias("u"))
    sums = [F.count_if(is_sum & c).alias(k) for k, c in counted.items()]
    photos = F.array_sort(F.collect_list(F.when(is_group, F.struct("file", "valid", passes.alias("passes")))))
    d = d.groupBy("u.kind", "u.a", "u.b", "u.c").agg(*sums, F.sum(F.when(is_sum, F.col("ms"))).alias("ms"), photos.alias("photos"))
    # the photo that solves a group, by either policy
    at = lambda test: F.array_position(F.transform("photos", test), True)
    d = d.withColumns({"at_A": at(lambda p: p["valid"] & p["passes"]), "at_B": at(lambda p: p["valid"])})
    both = F.when(F.col("kind") == "engine", F.array(none, F.col("b"))).otherwise(F.array(F.col("b")))
    solved = {f"{p}{k}": F.count_if((F.col("kind") == "group") & F.col(f"at_{p}").between(1, k)) for p in "AB" for k in range(1, most + 1)}
    d = d.select("*", F.explode(both).alias("of")).groupBy("kind", "a", "of").agg(F.count("*").alias("units"), *[F.sum(k).alias(k) for k in [*counted, "ms"]], *[c.alias(k) for k, c in solved.items()])
    value = lambda report, name, v, k=None: F.struct(F.lit(report).alias("report"), (name if isinstance(name, Column) else F.lit(name)).alias("name"), F.lit(k).cast("int").alias("k"), v.cast("double").alias("value"))
    c = F.col
    of_engine = [
        value("engine_summary", "photos", c("n")), value("engine_summary", "pct_valid", share(c("valid"), c("n"))), value("engine_summary", "mean_ms", F.try_divide(c("ms"), c("n"))), value("engine_summary", "pct_all_right", share(c("all_right"), c("truth"))),
        value("engine_summary", "valid_wrong", c("wrong")), value("engine_summary", "valid_unprotected_wrong", c("unprotected_wrong")), *[value("field_accuracy", f, share(c("truth") - c(f"f_{f}"), c("truth"))) for f in CARD_FIELDS],
        value("filter_scenario", "pct_rejected", share(c("rejected"), c("n"))), value("filter_scenario", "pct_valid_passing", share(c("passing_valid"), c("passing"))),
    ]
    of_group = [value("retry_curve", p, share(c(f"{p}{k}"), c("units")), k) for p in "AB" for k in range(1, most + 1)]
    report = (
        F.when((c("kind") == "engine") & c("of").isNull(), F.array(*of_engine)).when(c("kind") == "engine", F.array(value("quality_by_validity", "pct_valid", share(c("valid"), c("n")))))
        .when(c("kind") == "file", F.array(value("quality_by_validity", "photos", c("units")))).otherwise(F.array(*of_group))
    )
    return d.select("a", "of", F.explode(report).alias("r")).where("r.value is not null").select("r.report", F.col("a").alias("engine"), F.col("of").alias("verdict"), "r.name", "r.k", "r.value")


def status_matrix(docs: DataFrame) -> DataFrame:
    """(kind, origin, n, one column per status)."""
    states = ("COMPLETA", "INCOMPLETA", "ILEGIBLE", "OTRO_DOCUMENTO")
    return docs.groupBy("kind", "origin").agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in states])


def field_outcomes(truth: DataFrame, fields: DataFrame, status: DataFrame) -> DataFrame:
    """Adds ``outcome`` to (doc_id, kind, field, truth): bien, falta, mal, or mal_aceptado in a document that counts as complete.

    fields: doc_id, field, value; status: doc_id, status. Rows without truth go.
    """
    d = truth.where("truth is not null and truth <> ''").join(fields, ["doc_id", "field"], "left").join(status, "doc_id", "left")
    outcome = F.when(F.col("value").isNull(), "falta").when(report_form(F.col("value")) == report_form(F.col("truth")), "bien").when(F.col("status") == "COMPLETA", "mal_aceptado").otherwise("mal")
    return d.select("doc_id", "kind", "field", outcome.alias("outcome"))


def latency(docs: DataFrame) -> DataFrame:
    """(origin, n, median, p95): the mean of the middle two for an even count; p95 at the place round(0.95 (n - 1)), half to even.

    Times are counted before they are put in order, so an origin is as many rows as it has different times.
    """
    w = Window.partitionBy("origin").orderBy("ms")
    times = docs.groupBy("origin", "ms").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy("origin")))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("ms")))
    n = F.col("n")
    got = times.groupBy("origin", "n").agg(at(F.floor((n - 1) / 2)).alias("low"), at(F.floor(n / 2)).alias("high"), at(F.bround(0.95 * (n - 1))).alias("p95"))
    return got.select("origin", "n", ((F.col("low") + F.col("high")) / 2).cast("double").alias("median"), F.col("p95").cast("double").alias("p95"))


def accepted_wrong(outcomes: DataFrame) -> DataFrame:
    """What must be empty: wrong values in documents that count as complete."""
    return outcomes.where("outcome = 'mal_aceptado'")
