"""Queries over scalar operators: identifiers, zones, text forms, dates, amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, ids, text, zone
from . import fixtures as X


def _as_of():
    return F.lit(X.AS_OF).cast("date")


def nif_validate(spark: SparkSession, d: str) -> DataFrame:
    return X.view(spark, d, X.NIF, "customer").select("k", "nif", ids.person_id_ok(F.col("nif")).alias("ok"), ids.dni_letter(F.substring("nif", 1, 8)).alias("letter"))


NIF_VALIDATE = f"""
WITH f AS ({X.NIF}), c AS (SELECT k, nif, cast(substr(nif, 1, 8) AS bigint) % 23 AS r FROM f),
l AS (SELECT unnest(string_split('T,R,W,A,G,M,Y,F,P,D,X,B,N,J,Z,S,Q,V,H,L,C,K,E', ',')) AS letter, generate_subscripts(string_split('T,R,W,A,G,M,Y,F,P,D,X,B,N,J,Z,S,Q,V,H,L,C,K,E', ','), 1) - 1 AS r)
SELECT k, nif, letter = right(nif, 1) AS ok, letter FROM c JOIN l USING (r)
"""


def nie_validate(spark: SparkSession, d: str) -> DataFrame:
    return X.view(spark, d, X.NIE, "supplier").select("k", "nie", ids.person_id_ok(F.col("nie")).alias("ok"))


NIE_VALIDATE = f"""
WITH f AS ({X.NIE})
SELECT k, nie, substr('TRWAGMYFPDXBNJZSQVHLCKE', cast((ascii(nie) - 88) * 10000000 + cast(substr(nie, 2, 7) AS bigint) AS bigint) % 23 + 1, 1) = right(nie, 1) AS ok FROM f
"""


def cif_validate(spark: SparkSession, d: str) -> DataFrame:
    return X.view(spark, d, X.CIF, "customer").select("k", "cif", ids.company_id_ok(F.col("cif")).alias("ok"))


CIF_VALIDATE = f"""
WITH f AS ({X.CIF}), p AS (SELECT k, cif, unnest(range(2, 9)) AS i FROM f),
v AS (SELECT k, cif, i, cast(substr(cif, i, 1) AS int) AS n FROM p),
s AS (SELECT k, cif, sum(CASE WHEN i % 2 = 1 THEN n ELSE n * 2 // 10 + n * 2 % 10 END) AS total FROM v GROUP BY k, cif),
c AS (SELECT k, cif, cast((10 - total % 10) % 10 AS int) AS control FROM s)
SELECT k, cif, CASE WHEN left(cif, 1) IN ('A','B','E','H') THEN right(cif, 1) = cast(control AS varchar)
  WHEN left(cif, 1) IN ('K','P','Q','S') THEN right(cif, 1) = substr('JABCDEFGHI', control + 1, 1)
  ELSE right(cif, 1) IN (cast(control AS varchar), substr('JABCDEFGHI', control + 1, 1)) END AS ok FROM c
"""

#: Letters as words, NIF dotted and hyphened by the key; two per text.
_TWO = f"""
WITH f AS ({X.NIF})
SELECT a.k AS k, 'con DNI ' || CASE a.k % 3 WHEN 0 THEN a.nif WHEN 1 THEN substr(a.nif, 1, 2) || '.' || substr(a.nif, 3, 3) || '.' || substr(a.nif, 6, 3) || '-' || substr(a.nif, 9, 1)
       ELSE substr(a.nif, 1, 8) || ' ' || substr(a.nif, 9, 1) END || ' y ' || a.nif AS t, a.nif AS nif
FROM f a
"""


def nif_extract(spark: SparkSession, d: str) -> DataFrame:
    f = X.view(spark, d, _TWO, "customer")
    found = ids.person_ids(F.col("t"))
    return f.select("k", F.size(found).cast("long").alias("n"), F.coalesce(text.first(found), F.lit("")).alias("first_id"))


NIF_EXTRACT = f"""
WITH f AS ({X.NIF}), c AS (SELECT k, nif, substr('TRWAGMYFPDXBNJZSQVHLCKE', cast(substr(nif, 1, 8) AS bigint) % 23 + 1, 1) = right(nif, 1) AS ok FROM f)
SELECT k, cast(CASE WHEN ok THEN 1 ELSE 0 END AS bigint) AS n, CASE WHEN ok THEN nif ELSE '' END AS first_id FROM c
"""


def dni_letter_repair(spark: SparkSession, d: str) -> DataFrame:
    """The last letter replaced by the digit 0, as readers do with D: only a D comes back."""
    f = X.view(spark, d, X.IDENTITY, "customer").select("k", F.concat(F.substring("dni", 1, 8), F.lit("0")).alias("t"))
    return f.select("k", "t", F.coalesce(text.first(ids.person_ids(F.col("t"), True)), F.lit("")).alias("repaired"))


DNI_LETTER_REPAIR = f"""
WITH f AS ({X.IDENTITY})
SELECT k, substr(dni, 1, 8) || '0' AS t, CASE WHEN cast(substr(dni, 1, 8) AS bigint) % 23 = 9 THEN substr(dni, 1, 8) || 'D' ELSE '' END AS repaired FROM f
"""


def _zones(spark: SparkSession, d: str) -> DataFrame:
    f = X.view(spark, d, X.IDENTITY, "customer")
    z = zone.build_zone(F.col("support"), F.col("dni"), F.col("birth"), F.col("sex"), F.col("expiry"), F.translate("surnames", "Ñ", "N"), F.col("given"))
    return f.select("*", z.alias("z")).select("k", "kind", "dni", "support", "birth", "expiry", "z.*")


def _corrupted(spark: SparkSession, d: str) -> DataFrame:
    """Kinds: 1 zero of the DNI as O, 2 one sign more, 3 junk in front, 4 a wrong digit, 5 D as 0, 6 a digit in the name, 7 another country."""
    z = _zones(spark, d)
    a, b, k = F.col("l1"), F.col("l2"), F.col("kind")
    l1 = (
        F.when(k == 1, F.concat(F.substring(a, 1, 15), F.translate(F.substring(a, 16, 8), "0", "O"), F.substring(a, 24, 7)))
        .when(k == 2, F.concat(F.substring(a, 1, 10), F.lit("7"), F.substring(a, 11, 20)))
        .when(k == 3, F.concat(F.lit("I"), a))
        .when(k == 5, F.concat(F.substring(a, 1, 23), F.translate(F.substring(a, 24, 1), "D", "0"), F.substring(a, 25, 6)))
        .when(k == 7, F.concat(F.lit("IDEXP"), F.substring(a, 6, 25)))
        .otherwise(a)
    )
    l2 = F.when(k == 4, F.concat(F.substring(b, 1, 3), ((F.substring(b, 4, 1).cast("int") + 1) % 10).cast("string"), F.substring(b, 5, 26))).otherwise(b)
    l3 = F.when(k == 6, F.regexp_replace("l3", "O", "0")).otherwise(F.col("l3"))
    return z.select("k", "kind", "dni", "support", "birth", "expiry", F.array(F.lit("ESPAÑA"), l1, l2, l3).alias("candidates"))


def mrz_check_digits(spark: SparkSession, d: str) -> DataFrame:
    f = X.view(spark, d, X.IDENTITY, "customer")
    return f.select("k", *[zone.check_digit(F.col(c), w).alias(f"{c}_digit") for c, w in (("support", 9), ("birth", 6), ("expiry", 6))])


MRZ_CHECK_DIGITS = f"""
WITH f AS ({X.IDENTITY}), p AS (SELECT k, unnest(['support', 'birth', 'expiry']) AS name, unnest([support, birth, expiry]) AS v FROM f),
c AS (SELECT k, name, v, unnest(range(1, length(v) + 1)) AS i FROM p),
s AS (SELECT k, name, cast(sum((strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(v, i, 1)) - 1) * CASE i % 3 WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 1 END) % 10 AS varchar) AS digit FROM c GROUP BY k, name)
SELECT k, max(digit) FILTER (WHERE name = 'support') AS support_digit, max(digit) FILTER (WHERE name = 'birth') AS birth_digit, max(digit) FILTER (WHERE name = 'expiry') AS expiry_digit FROM s GROUP BY k
"""


def mrz_parse_valid(spark: SparkSession, d: str) -> DataFrame:
    z = zone.parse_zone(_zones(spark, d).select("k", "l1", "l2", "l3"), "l1", "l2", "l3", _as_of())
    return z.select("k", *[f"zone.{c}" for c in ("kind", "country", "support", "dni", "birth_date", "sex", "expiry_date", "nationality", "surnames", "given_names", "valid")])


MRZ_PARSE_VALID = f"""
WITH f AS ({X.IDENTITY})
SELECT k, 'ID' AS kind, 'ESP' AS country, support, dni,
  substr(birth, 5, 2) || '/' || substr(birth, 3, 2) || '/' || CASE WHEN cast(substr(birth, 1, 2) AS int) <= 26 THEN '20' ELSE '19' END || substr(birth, 1, 2) AS birth_date, sex,
  substr(expiry, 5, 2) || '/' || substr(expiry, 3, 2) || '/20' || substr(expiry, 1, 2) AS expiry_date, 'ESP' AS nationality,
  replace(surnames, 'Ñ', 'N') AS surnames, given AS given_names, true AS valid FROM f
"""


def mrz_unique_correction(spark: SparkSession, d: str) -> DataFrame:
    """Zones read from corrupted lines; what is valid equals the truth, or nothing is said."""
    c = _corrupted(spark, d)
    z = zone.read_zones(c, "k", "candidates", _as_of())
    return c.join(z, "k").select("k", "kind", F.col("zone.valid").alias("valid"), "ambiguous", F.when(F.col("zone.valid"), F.col("zone.dni")).alias("dni"))


def mrz_corruption_report(spark: SparkSession, d: str) -> DataFrame:
    """For each kind of corruption: zones, valid ones, and valid ones whose protected fields differ from the truth."""
    c = _corrupted(spark, d)
    z = zone.read_zones(c, "k", "candidates", _as_of())
    wrong = (F.col("zone.dni") != F.col("dni")) | (F.substring("zone.support", 4, 6) != F.substring("support", 4, 6)) | (F.substring("zone.birth_date", 1, 2) != F.substring("birth", 5, 2))
    return c.join(z, "k").groupBy("kind").agg(
        F.count("*").alias("zones"), F.count_if(F.col("zone.valid")).alias("valid"), F.count_if(F.col("zone.valid") & wrong).alias("accepted_wrong"), F.count_if("ambiguous").alias("ambiguous")
    )


_DOCS = "SELECT doc_id AS k, text AS t FROM documents"


def text_normalise_es(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return X.view(spark, d, _DOCS, "documents").select("k", F.md5(text.fold(t)).alias("folded"), F.md5(text.row_form(t)).alias("row_form"), F.md5(text.compact(t)).alias("compact"))


_FOLD = "replace(strip_accents(replace(upper(replace({c}, 'ß', 'SS')), 'Ñ', chr(1))), chr(1), 'Ñ')"
TEXT_NORMALISE_ES = f"""
SELECT doc_id AS k, md5({_FOLD.format(c='text')}) AS folded, md5(trim(regexp_replace({_FOLD.format(c='text')}, '[\\s\\x0B]+', ' ', 'g'))) AS row_form,
  md5(regexp_replace(upper(replace(text, 'ß', 'SS')), '[\\s\\x0B.\\-]', '', 'g')) AS compact FROM documents
"""


def text_to_mrz_form(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return X.view(spark, d, _DOCS, "documents").select("k", F.md5(text.name_form(t)).alias("name_form"), F.md5(text.zone_form(t)).alias("zone_form"), F.md5(text.id_form(t)).alias("id_form"))


_UP = "upper(replace(text, 'ß', 'SS'))"
TEXT_TO_MRZ_FORM = f"""
SELECT doc_id AS k, md5(trim(regexp_replace(replace({_FOLD.format(c='text')}, 'Ñ', 'N'), '[^A-Z]+', ' ', 'g'))) AS name_form,
  md5(regexp_replace(translate({_UP}, '«‹([{{¢', '<<<<<<'), '[^A-Z0-9<]', '', 'g')) AS zone_form, md5(regexp_replace({_UP}, '[^0-9A-Z]', '', 'g')) AS id_form FROM documents
"""


def text_legibility(spark: SparkSession, d: str) -> DataFrame:
    q = text.legibility(F.col("t"))
    return X.view(spark, d, _DOCS, "documents").select("k", q["good"].alias("good"), F.bround(q["ratio"], 6).alias("ratio"), text.is_digital(F.col("t")).alias("digital"))


TEXT_LEGIBILITY = """
WITH q AS (SELECT doc_id AS k, length(regexp_replace(text, '[^\\p{L}\\p{N}.,;:\\-/()ºª€%''"]', '', 'g')) AS good, length(regexp_replace(text, '[\\s\\x0B]', '', 'g')) AS visible FROM documents)
SELECT k, good, round_even(CASE WHEN visible > 0 THEN good / visible ELSE 0 END, 6) AS ratio, good >= 40 AND CASE WHEN visible > 0 THEN good / visible ELSE 0 END >= 0.6 AS digital FROM q
"""


def text_unglue(spark: SparkSession, d: str) -> DataFrame:
    f = X.view(spark, d, X.IDENTITY, "customer").select("k", F.concat(F.lit("con"), F.lit("DNI"), "dni", F.lit(",de"), (F.col("k") % 100 + 1900).cast("string")).alias("t"))
    return f.select("k", text.unglue(F.col("t")).alias("t"))


TEXT_UNGLUE = f"""WITH f AS ({X.IDENTITY}) SELECT k, 'con DNI ' || dni || ', de ' || cast(k % 100 + 1900 AS varchar) AS t FROM f"""


def dates_extract(spark: SparkSession, d: str) -> DataFrame:
    f = X.view(spark, d, X.DATED, "orders").select("k", dates.dates_found(F.col("t"), _as_of()).alias("x"))
    return f.select("k", F.size("x").cast("long").alias("n"), text.first(F.col("x"))["pos"].cast("long").alias("pos"), text.first(F.col("x"))["date"].cast("string").alias("first_date"))


DATES_EXTRACT = f"""
WITH f AS ({X.DATED}), o AS (SELECT o_orderkey AS k, cast(o_orderdate AS date) AS day, year(o_orderdate) AS y FROM orders),
r AS (SELECT k, t, day, CASE WHEN k % 4 = 3 THEN try_cast(cast(CASE WHEN y % 100 <= 27 THEN 2000 ELSE 1900 END + y % 100 AS varchar) || '-' || lpad(cast(1 + k % 9 AS varchar), 2, '0') || '-31' AS date) END AS odd FROM f JOIN o USING (k))
SELECT k, cast(CASE WHEN odd IS NOT NULL THEN 2 ELSE 1 END AS bigint) AS n,
  cast(CASE k % 4 WHEN 0 THEN 7 WHEN 1 THEN 10 WHEN 2 THEN 8 ELSE CASE WHEN odd IS NOT NULL THEN 3 ELSE 17 END END AS bigint) AS pos, cast(coalesce(odd, day) AS varchar) AS first_date FROM r
"""


def dates_century(spark: SparkSession, d: str) -> DataFrame:
    f = X.view(spark, d, X.IDENTITY, "customer").select("k", (F.col("k") % 100).cast("int").alias("yy"))
    return f.select("k", dates.full_year(F.col("yy"), _as_of()).cast("long").alias("document_year"), dates.full_year(F.col("yy"), _as_of(), 0).cast("long").alias("zone_year"))


DATES_CENTURY = "SELECT c_custkey AS k, cast(if(c_custkey % 100 < 28, 2000, 1900) + c_custkey % 100 AS bigint) AS document_year, cast(if(c_custkey % 100 < 27, 2000, 1900) + c_custkey % 100 AS bigint) AS zone_year FROM customer"

_AMOUNT = """
SELECT o_orderkey AS k, cast(floor(o_totalprice) as bigint) AS euros, cast(o_orderkey % 100 as bigint) AS cents FROM orders
"""


def amounts_extract(spark: SparkSession, d: str) -> DataFrame:
    f = X.view(spark, d, _AMOUNT, "orders")
    shown = F.translate(F.format_number("euros", 0), ",", ".")
    t = F.concat(F.lit("Límite: "), shown, F.when(F.col("k") % 2 == 0, F.concat(F.lit(","), F.lpad(F.col("cents").cast("string"), 2, "0"), F.lit(" €"))).otherwise(F.lit(" euros")), F.lit(" y 15 EUR"))
    a = dates.amounts(t)
    return f.select("k", F.size(a).cast("long").alias("n"), F.array_max(a).alias("largest"))


AMOUNTS_EXTRACT = f"WITH f AS ({_AMOUNT}) SELECT k, cast(2 AS bigint) AS n, greatest(15.0, cast(cast(euros AS varchar) || '.' || CASE WHEN k % 2 = 0 THEN lpad(cast(cents AS varchar), 2, '0') ELSE '0' END AS double)) AS largest FROM f"


def months_validity(spark: SparkSession, d: str) -> DataFrame:
    f = X.view(spark, d, "SELECT o_orderkey AS k, cast(o_orderdate as date) AS since FROM orders", "orders")
    word = F.element_at(F.array(*map(F.lit, ("UN", "TRES", "SEIS", "DOCE", "18", "VEINTICUATRO", ""))), (F.col("k") % 7 + 1).cast("int"))
    m = dates.stated_months(F.when(word == "", F.lit("CERTIFICA")).otherwise(F.concat(F.lit("CON VALIDEZ DE "), word, F.lit(" MESES"))))
    return f.select("k", m["months"].cast("long").alias("months"), m["stated"].alias("stated"), dates.add_months(F.col("since"), m["months"]).cast("string").alias("until"))


MONTHS_VALIDITY = """
WITH m AS (SELECT o_orderkey AS k, cast(o_orderdate AS date) AS since, list_extract([1, 3, 6, 12, 18, 24, 6], cast(o_orderkey % 7 + 1 AS int)) AS months FROM orders)
SELECT k, cast(months AS bigint) AS months, k % 7 <> 6 AS stated, cast(cast(since + to_months(cast(months AS int)) AS date) AS varchar) AS until FROM m
"""


def validity_window(spark: SparkSession, d: str) -> DataFrame:
    f = X.view(spark, d, "SELECT o_orderkey AS k, cast(o_orderdate as date) AS day FROM orders", "orders")
    since = F.when(F.col("k") % 3 != 0, F.col("day"))
    until = F.when(F.col("k") % 5 != 0, F.add_months("day", (F.col("k") % 600).cast("int")))
    return f.select("k", dates.in_force(since, until, _as_of()).alias("in_force"))


VALIDITY_WINDOW = f"""
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE date '{X.AS_OF}' BETWEEN CASE WHEN o_orderkey % 3 = 0 THEN date '0001-01-01' ELSE cast(o_orderdate AS date) END
  AND cast(cast(o_orderdate AS date) + to_months(cast(o_orderkey % 600 AS int)) AS date) END AS in_force FROM orders
"""

QUERIES = (
    nif_validate, nie_validate, cif_validate, nif_extract, dni_letter_repair, mrz_check_digits, mrz_parse_valid, mrz_unique_correction, mrz_corruption_report,
    text_normalise_es, text_to_mrz_form, text_legibility, text_unglue, dates_extract, dates_century, amounts_extract, months_validity, validity_window,
)
ORACLES = {
    "nif_validate": NIF_VALIDATE, "nie_validate": NIE_VALIDATE, "cif_validate": CIF_VALIDATE, "nif_extract": NIF_EXTRACT, "dni_letter_repair": DNI_LETTER_REPAIR,
    "mrz_check_digits": MRZ_CHECK_DIGITS, "mrz_parse_valid": MRZ_PARSE_VALID, "text_normalise_es": TEXT_NORMALISE_ES, "text_to_mrz_form": TEXT_TO_MRZ_FORM,
    "text_legibility": TEXT_LEGIBILITY, "text_unglue": TEXT_UNGLUE, "dates_extract": DATES_EXTRACT, "dates_century": DATES_CENTURY, "amounts_extract": AMOUNTS_EXTRACT,
    "months_validity": MONTHS_VALIDITY, "validity_window": VALIDITY_WINDOW,
}
