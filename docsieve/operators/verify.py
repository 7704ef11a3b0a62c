"""The decision on a card: verified, to be repeated, or for an administrator. It keeps no state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first, id_form

ATTEMPTS = 2
CHECKS = ("dni_front_back", "dni_back_declared", "dni_front_declared", "support_front_back")


def chosen(zone_value: Column, candidates: Column, front_text: Column) -> Column:
    """The zone's value where the front has it as a candidate or in its text; else the first candidate."""
    seen = F.array_contains(candidates, zone_value) | F.contains(front_text, zone_value)
    return F.when(F.coalesce(seen, F.lit(False)), zone_value).otherwise(first(candidates))


def verify(df: DataFrame) -> DataFrame:
    """Adds ``checks``, ``status``, ``reason``, ``instructions`` and ``expired``.

    df: zone_valid, zone_dni, zone_support, expiry (date), dnis and supports (arrays),
    front_text, front_bad and back_bad (bad quality), front_warnings and back_warnings
    (arrays), declared, attempt, as_of (date). A check is null if a side is missing.
    """
    d = df.withColumns({
        "_zd": F.when(F.col("zone_valid"), F.col("zone_dni")), "_zs": F.when(F.col("zone_valid"), F.col("zone_support")),
        "_de": F.when(id_form(F.col("declared")) != "", id_form(F.col("declared"))),
    })
    d = d.withColumns({"_fd": chosen(F.col("_zd"), F.col("dnis"), F.col("front_text")), "_fs": chosen(F.col("_zs"), F.col("supports"), F.col("front_text"))})
    pairs = (("_fd", "_zd"), ("_zd", "_de"), ("_fd", "_de"), ("_fs", "_zs"))
    d = d.withColumn("checks", F.struct(
        F.coalesce("zone_valid", F.lit(False)).alias("zone_valid"), F.col("_fd").isNotNull().alias("dni_front_read"), F.col("_fs").isNotNull().alias("support_front_read"),
        *[(F.col(a) == F.col(b)).alias(n) for n, (a, b) in zip(CHECKS, pairs)],
    ))
    each = F.array(*[F.col(f"checks.{n}") for n in CHECKS])
    back_failed = ~F.col("checks.zone_valid")
    front_failed = (F.size(F.coalesce("dnis", F.array().cast("array<string>"))) == 0) | (F.size(F.coalesce("supports", F.array().cast("array<string>"))) == 0)
    bad = (back_failed & F.col("back_bad")) | (front_failed & F.col("front_bad"))
    differs, agrees = F.exists(each, lambda x: x.eqNullSafe(F.lit(False))), F.forall(each, lambda x: x.eqNullSafe(F.lit(True)))
    d = d.withColumn("reason", (
        F.when(differs, "DATOS_NO_COINCIDEN").when(agrees, "OK").when(~back_failed & ~front_failed, "DATOS_NO_COINCIDEN")
        .when(bad & (F.col("attempt") < ATTEMPTS), "MALA_CALIDAD").when(bad, "INTENTOS_AGOTADOS").otherwise("LECTURA_FALLIDA")
    ))
    d = d.withColumn("status", F.when(F.col("reason") == "OK", "VERIFICADO").when(F.col("reason") == "MALA_CALIDAD", "REPETIR").otherwise("REVISION_ADMIN"))
    said = lambda failed, warnings, side: F.when(failed, F.transform(F.when(F.size(warnings) > 0, F.col(warnings)).otherwise(F.array(F.lit("No se ha podido leer bien."))), lambda w: F.concat(F.lit(f"{side}: "), w))).otherwise(F.array().cast("array<string>"))
    told = F.concat(said(back_failed, "back_warnings", "Reverso"), said(front_failed, "front_warnings", "Anverso"))
    d = d.withColumns({"instructions": F.when(F.col("status") == "REPETIR", told).otherwise(F.array().cast("array<string>")), "expired": F.coalesce(F.col("zone_valid") & (F.col("expiry") < F.col("as_of")), F.lit(False))})
    return d.drop("_zd", "_zs", "_de", "_fd", "_fs")
