"""Queries over card fronts, zones of three lines, identifiers, provenance, choices between readings, templates and file bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, ids, zone
from ..operators import authenticity, cascade, front, layout, lookup, provenance, quality, readings, reports, template, traced, verify, words
from ..sources import files
from . import extract_queries as E
from . import fixtures as X
from .extract_queries import documents
from .scalar_queries import _zones


def _as_of():
    return F.lit(X.AS_OF).cast("date")


# Zones.

_SIGNS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digit(v: str) -> str:
    """A check digit in the oracle's SQL."""
    return f"cast(list_sum(list_transform(range(1, length({v}) + 1), lambda i: greatest(strpos('{_SIGNS}', substr({v}, i, 1)) - 1, 0) * CASE i % 3 WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 1 END)) % 10 AS varchar)"


_FILL = "repeat('<', 11)"
ZONES_SQL = f"""
f AS ({X.IDENTITY}), a AS (SELECT *, rpad('IDESP' || support || {_digit("support")} || dni, 30, '<') AS l1, birth || {_digit("birth")} AS b, expiry || {_digit("expiry")} AS e, rpad(replace(replace(surnames, 'Ñ', 'N'), ' ', '<') || '<<' || replace(given, ' ', '<'), 30, '<') AS l3 FROM f),
y AS (SELECT *, substr(l1, 6, 25) || b || e || {_FILL} AS body FROM a), z AS (SELECT *, b || sex || e || 'ESP' || {_FILL} || {_digit("body")} AS l2 FROM y)
"""


def zone_lines_chosen(spark: SparkSession, d: str) -> DataFrame:
    """The zone among other lines of a card: an address above, a line that is too short, and signs read as fillers."""
    z = _zones(spark, d)
    noise = F.array(F.lit("C. MAYOR 12 1 A"), F.lit("MADRID"), F.concat(F.lit("x "), F.translate("l1", "<", "«")), F.col("l2"), F.lower("l3"), F.lit("EQUIPO 28A"))
    c = z.select("k", zone.choose_lines(noise).alias("c"))
    cut = zone.fit(zone.anchor(F.col("c.l1")))
    return c.select("k", cut.alias("l1"), "c.l2", "c.l3", zone.structure_score(cut, F.col("c.l2"), F.col("c.l3")).cast("long").alias("score"))


ZONE_LINES_CHOSEN = f"WITH {ZONES_SQL} SELECT k, l1, l2, l3, cast(11 AS bigint) AS score FROM z"


def zone_versions(spark: SparkSession, d: str) -> DataFrame:
    """How many ways a line can lose a sign: none if it fits, else one for each different result, and the line as it is."""
    line = F.when(F.col("k") % 3 == 0, F.concat("l1", F.lit("<"))).when(F.col("k") % 3 == 1, F.concat(F.lit("Q"), "l1")).otherwise(F.col("l1"))
    return _zones(spark, d).select("k", F.size(zone.versions(line)).cast("long").alias("n"))


ZONE_VERSIONS = f"""
WITH {ZONES_SQL}, v AS (SELECT k, CASE k % 3 WHEN 0 THEN l1 || '<' WHEN 1 THEN 'Q' || l1 ELSE l1 END AS line FROM z)
SELECT k, cast(CASE WHEN length(line) <= 30 THEN 1 ELSE 1 + len(list_distinct(list_transform(range(1, length(line) + 1), lambda i: substr(line, 1, i - 1) || substr(line, i + 1)))) END AS bigint) AS n FROM v
"""


def zone_variants(spark: SparkSession, d: str) -> DataFrame:
    """All swaps of look-alikes in a support number; too many of them are not tried."""
    return _zones(spark, d).select("k", F.size(F.array_distinct(zone.variants(F.col("support"), 9))).cast("long").alias("n"))


ZONE_VARIANTS = f"""
WITH f AS (SELECT k, length(regexp_replace(support, '[^OQDUILTZSGB012568]', '', 'g')) AS n FROM ({X.IDENTITY}) i)
SELECT k, cast(CASE WHEN n BETWEEN 1 AND 6 THEN (1 << n) - 1 ELSE 0 END AS bigint) AS n FROM f
"""


def zone_mended(spark: SparkSession, d: str) -> DataFrame:
    """A support number with its only look-alike misread comes back if its check digit then fits; others stay as they are."""
    number = F.concat(F.lit("AXC"), F.translate(F.substring("support", 4, 6), "012568", "334779"))
    z = _zones(spark, d).withColumn("number", F.concat(F.substring(number, 1, 8), F.lit("5")))
    read = F.when(F.col("k") % 2 == 0, F.concat(F.substring("number", 1, 8), F.lit("S"))).otherwise(F.col("number"))
    z = z.withColumn("digit", F.when(F.col("k") % 5 == 0, F.lit("X")).otherwise(zone.check_digit(F.col("number"), 9)))
    return z.select("k", "number", zone.mend_by_check(read, F.col("digit"), 9).alias("mended"))


ZONE_MENDED = f"""
WITH n AS (SELECT k, 'AXC' || substr(translate(substr(support, 4, 6), '012568', '334779'), 1, 5) || '5' AS number FROM ({X.IDENTITY}) i)
SELECT k, number, CASE WHEN k % 2 = 0 AND k % 5 = 0 THEN substr(number, 1, 8) || 'S' ELSE number END AS mended FROM n
"""

# Fronts.

_FRONT = f"""
SELECT k AS doc_id, n AS line_no, replace(replace(replace(replace(replace(replace(replace(t, '@A1', split_part(surnames, ' ', 1)), '@A2', split_part(surnames, ' ', 2)), '@NAME', given), '@DNI', translate(substr(dni, 1, 1), '012568', 'OIZSGB') || substr(dni, 2)), '@SUP', 'A' || substr(support, 2)), '@SEX', sex), '@B', substr(birth, 5, 2) || ' ' || substr(birth, 3, 2) || ' 19' || substr(birth, 1, 2)) AS text,
  cast(x as double) AS x, cast(y as double) AS y, cast(w as double) AS w, cast(20 as double) AS h
FROM ({X.IDENTITY}) i, (VALUES (0, 'ESPAÑA DOCUMENTO NACIONAL DE IDENTIDAD', 10, 10, 600), (1, 'APELLID0S', 200, 60, 110), (2, '@A1', 200, 82, 150), (3, '@A2', 200, 104, 150), (4, 'NOMBRE', 200, 150, 80), (5, '@NAME', 200, 174, 150),
  (6, 'SEXO @SEX', 200, 220, 90), (7, 'NACIONALIDAD', 420, 220, 130), (8, 'ESP', 420, 244, 50), (9, 'NACIMIENTO', 200, 290, 120), (10, '@B', 200, 314, 120), (11, 'EMISION', 420, 290, 90), (12, '03 04 2022', 420, 314, 120), (13, 'VALIDEZ', 620, 290, 90), (14, '03 04 2032', 620, 314, 120),
  (15, 'NUM SOPORTE', 200, 360, 120), (16, '@SUP', 200, 384, 120), (17, 'CAN', 420, 360, 50), (18, '123456', 420, 384, 80), (19, 'DNI @DNI', 10, 440, 200)) v(n, t, x, y, w)
WHERE (n NOT IN (9, 11, 13) OR k % 3 <> 0) AND (n <> 19 OR k % 4 <> 0) AND (n <> 3 OR k % 5 <> 0)
"""
_FIELDS_SQL = """
CASE WHEN k % 4 <> 0 THEN dni END AS dni, 'A' || substr(support, 2) AS num_soporte, CASE WHEN k % 5 = 0 THEN split_part(surnames, ' ', 1) ELSE surnames END AS apellidos, given AS nombre, sex AS sexo, 'ESP' AS nacionalidad,
substr(birth, 5, 2) || '/' || substr(birth, 3, 2) || '/19' || substr(birth, 1, 2) AS fecha_nacimiento, '03/04/2022' AS fecha_expedicion, '03/04/2032' AS fecha_caducidad, '123456' AS can
"""


def _fronts(spark: SparkSession, d: str) -> DataFrame:
    return front.read_fronts(X.view(spark, d, _FRONT, "customer"), _as_of())


def front_fields(spark: SparkSession, d: str) -> DataFrame:
    """Ten fields of fronts: a misread label, surnames in two lines, values beside and below, and dates that lack their labels."""
    r = _fronts(spark, d)
    return r.select(F.col("doc_id").alias("k"), *front.FIELDS, "dni_ok", F.col("found").cast("long").alias("found"), front.front_like(F.col("labels"), F.col("dni_ok")).alias("front_like"))


FRONT_FIELDS = f"WITH i AS ({X.IDENTITY}) SELECT k, {_FIELDS_SQL}, k % 4 <> 0 AS dni_ok, cast(CASE WHEN k % 4 <> 0 THEN 10 ELSE 9 END AS bigint) AS found, true AS front_like FROM i"


def front_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The box round the surnames: one line or two."""
    b = F.element_at(F.col("boxes"), "apellidos")
    return _fronts(spark, d).select(F.col("doc_id").alias("k"), b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h"))


FRONT_BOXES = "SELECT c_custkey AS k, 200.0::double AS x, 82.0::double AS y, 150.0::double AS w, CASE WHEN c_custkey % 5 = 0 THEN 20.0 ELSE 42.0 END::double AS h FROM customer"


#: Names of labels, one for each kind of damage by the key: none, an O as zero, a letter left out, one put in, two changed, two left out, glued in front.
_NAMES = "APELLIDOS,PRIMER APELLIDO,NOMBRE,IZENA,SEXO,NACIONALIDAD,FECHA DE NACIMIENTO,NACIMIENTO,NUM SOPORTE,EUSKARRI,VALIDEZ,VALIDO HASTA,BALIOZTASUNA,EXPEDICION,CAN,DOCUMENTO NACIONAL,CALLE MAYOR"
_DAMAGED = f"""
SELECT *, CASE kind WHEN 0 THEN name WHEN 1 THEN replace(name, 'O', '0') WHEN 2 THEN substr(name, 1, p) || substr(name, p + 2) WHEN 3 THEN substr(name, 1, p) || 'X' || substr(name, p + 1)
  WHEN 4 THEN substr(name, 1, p) || 'QQ' || substr(name, p + 3) WHEN 5 THEN substr(name, 1, p) || substr(name, p + 3) ELSE 'XX' || replace(name, ' ', '') || 'YY' END AS text
FROM (SELECT k, kind, name, cast(1 + k % (length(name) - 1) as int) AS p FROM (SELECT c_custkey AS k, cast(floor(c_custkey / 17.0) as int) % 7 AS kind, split_part('{_NAMES}', ',', cast(c_custkey % 17 as int) + 1) AS name FROM customer) a) b
"""


def front_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of lines that are damaged by their keys, in several languages; no Python runs."""
    lines = X.view(spark, d, _DAMAGED, "customer").withColumn("line_no", F.lit(0))
    return front.labelled_lines(lines).select("k", "text", F.array_join(F.array_sort("labels"), ",").alias("labels"))


_BLOCK = "list_sort(flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(list_filter(range(1, length(x) - i + 2), lambda n: contains(y, substr(x, i, n))), lambda n: {'n': n, 'i': -i}))), 'DESC')[1]"
FRONT_LABELS = f"""
WITH RECURSIVE f AS ({_DAMAGED}), names(label, name) AS (VALUES {", ".join(f"('{k}', '{n}')" for k, names in front.LABELS.items() for n in names)}),
t AS (SELECT text, list_filter(string_split(regexp_replace(text, '[^0-9A-ZÑ]', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM (SELECT DISTINCT text FROM f) u),
win AS (SELECT DISTINCT text, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win FROM t, (VALUES (1), (2), (3)) v(n) WHERE len(w) >= n),
pairs AS (SELECT DISTINCT win AS x, name AS y FROM win JOIN names ON n = length(name) - length(replace(name, ' ', '')) + 1 AND length(name) > 4 AND levenshtein(win, name) <= 0.16 * (length(win) + length(name)) + 1e-9),
r AS (
  SELECT x AS a, y AS b, x, y FROM pairs
  UNION ALL SELECT a, b, s.x, s.y FROM (
    SELECT a, b, unnest([{{'x': substr(x, 1, i - 1), 'y': substr(y, 1, j - 1)}}, {{'x': substr(x, i + n), 'y': substr(y, j + n)}}]) AS s
    FROM (SELECT a, b, x, y, m.n AS n, -m.i AS i, strpos(y, substr(x, -m.i, m.n)) AS j FROM (SELECT *, {_BLOCK} AS m FROM r) c WHERE m IS NOT NULL) e) g WHERE s.x <> '' AND s.y <> ''),
near AS (SELECT a, b FROM (SELECT a, b, sum({_BLOCK}.n) AS hits FROM r GROUP BY a, b) h WHERE 2.0 * hits / (length(a) + length(b)) >= 0.84),
got AS (
  SELECT text, label FROM win JOIN near ON win = a JOIN names ON name = b
  UNION SELECT text, label FROM win JOIN names ON win = name
  UNION SELECT text, label FROM t JOIN names ON length(name) >= 6 AND contains(array_to_string(w, ''), replace(name, ' ', '')))
SELECT k, f.text, coalesce(labels, '') AS labels FROM f LEFT JOIN (SELECT text, string_agg(label, ',' ORDER BY label) AS labels FROM got GROUP BY text) g ON f.text = g.text
"""


def zone_values(spark: SparkSession, d: str) -> DataFrame:
    """Texts read in the zones of a card, with words of labels that got into them."""
    sql = f"SELECT k AS photo_id, key, replace(replace(replace(replace(t, '@SUR', surnames), '@DNI', dni), '@SUP', support), '@SEX', sex) AS text FROM ({X.IDENTITY}) i, (VALUES ('dni', 'DNI @DNI'), ('num_soporte', 'SOPORTE @SUP'), ('apellidos', 'APELLIDOS @SUR'), ('sexo', 'SEXO @SEX'), ('fecha_nacimiento', 'O3 04 198I'), ('can', 'CAN 123456'), ('nacionalidad', 'NACIONALIDAD ESP')) v(key, t)"
    return front.read_zones_of(X.view(spark, d, sql, "customer")).select(F.col("photo_id").alias("k"), "dni_ok", F.explode("fields").alias("field", "value"))


ZONE_VALUES = f"""
WITH i AS ({X.IDENTITY})
SELECT k, true AS dni_ok, field, CASE field WHEN 'dni' THEN dni WHEN 'num_soporte' THEN support WHEN 'apellidos' THEN surnames WHEN 'sexo' THEN sex WHEN 'fecha_nacimiento' THEN '03/04/1981' WHEN 'can' THEN '123456' ELSE 'ESP' END AS value
FROM i, (VALUES ('dni'), ('num_soporte'), ('apellidos'), ('sexo'), ('fecha_nacimiento'), ('can'), ('nacionalidad')) v(field)
"""


def _back_readers() -> list:
    """Two engines over a photo as it is and straightened; what each of them reads well, and finds at all, goes by the key."""
    def reader(turn: int, well: int, blind: int):
        def read(photos: DataFrame) -> DataFrame:
            k, l2 = F.col("photo_id"), F.col("l2")
            wrong = F.concat(F.substring(l2, 1, 3), ((F.substring(l2, 4, 1).cast("int") + 1) % 10).cast("string"), F.substring(l2, 5, 26))
            got = photos.where(k % blind != turn).withColumn("l2", F.when(k % well == 0, l2).otherwise(wrong))
            # the first attempt of an engine loses the last line
            tries = F.array(F.struct(F.lit(1).alias("attempt"), F.array("l1", "l2").alias("candidates")), F.struct(F.lit(2).alias("attempt"), F.array("l1", "l2", "l3").alias("candidates")))
            return got.select("photo_id", F.inline(tries))

        return read

    named = (("a", 3, 13), ("a straightened", 4, 11), ("b", 5, 9), ("b straightened", 7, 8))
    return [(name, reader(i, well, blind)) for i, (name, well, blind) in enumerate(named)]


def back_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Zones by engine and variant in turn: who reads a card, how many were asked, and what the best reading holds."""
    photos = _zones(spark, d).select(F.col("k").alias("photo_id"), "l1", "l2", "l3")
    r = cascade.read_backs(photos, _back_readers(), _as_of())
    return r.select(F.col("photo_id").alias("k"), "valid", F.col("checks").cast("long").alias("checks"), "reader", "readings", F.col("zone.dni").alias("dni"))


_TURNS = [(0, "a", 3, 13), (1, "a straightened", 4, 11), (2, "b", 5, 9), (3, "b straightened", 7, 8)]
BACK_CASCADE = f"""
WITH i AS ({X.IDENTITY}), r AS (SELECT k, dni, birth, turn, reader, k % well = 0 AS valid FROM i, (VALUES {", ".join(f"({t}, '{n}', {w}, {b})" for t, n, w, b in _TURNS)}) v(turn, reader, well, blind) WHERE k % blind <> turn),
b AS (SELECT *, 6 + CASE WHEN valid THEN 3 WHEN substr(birth, 3, 1) || cast((cast(substr(birth, 4, 1) AS int) + 1) % 10 AS varchar) BETWEEN '01' AND '12' THEN 1 ELSE 0 END AS checks FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY NOT valid, turn) = 1)
SELECT k, coalesce(valid, false) AS valid, cast(checks AS bigint) AS checks, reader, cast(CASE WHEN valid THEN turn + 1 ELSE 4 END AS bigint) AS readings, b.dni FROM i LEFT JOIN b USING (k)
"""


def _front_readers(lines: DataFrame, texts: DataFrame) -> list:
    """Two engines by labels, then the zones of a template; they lose the number of every fourth, eighth and twenty-fourth card."""
    pick = lambda of, keep: lambda photos: of.join(photos.select("photo_id"), "photo_id", "left_semi").where(keep)
    without = lambda n: (F.col("line_no") != 19) | (F.col("photo_id") % n != 0)
    zones = pick(texts, (F.col("key") != "dni") | (F.col("photo_id") % 24 != 0))
    return [("a", cascade.front_lines(pick(lines, without(4)), _as_of())), ("b", cascade.front_lines(pick(lines, without(8)), _as_of())), ("zones", cascade.front_zones(zones))]


def front_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Fronts by labels with two engines, then by place: candidates, whether the card is complete, and how many readings it took."""
    lines = X.view(spark, d, _FRONT.replace("(n <> 19 OR k % 4 <> 0) AND ", ""), "customer").withColumnRenamed("doc_id", "photo_id")
    texts = X.view(spark, d, f"SELECT k AS photo_id, key, replace(replace(t, '@DNI', dni), '@SUP', 'A' || substr(support, 2)) AS text FROM ({X.IDENTITY}) i, (VALUES ('dni', 'DNI @DNI'), ('num_soporte', 'SOPORTE @SUP')) v(key, t)", "customer")
    photos = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("photo_id"))
    r = cascade.read_fronts(photos, _front_readers(lines, texts))
    return r.select(F.col("photo_id").alias("k"), F.array_join("dnis", ",").alias("dnis"), F.array_join("supports", ",").alias("supports"), "complete", "readings")


FRONT_CASCADE = f"""
WITH i AS ({X.IDENTITY}) SELECT k, CASE WHEN k % 24 <> 0 THEN dni ELSE '' END AS dnis, 'A' || substr(support, 2) AS supports, k % 24 <> 0 AS complete, cast(CASE WHEN k % 4 <> 0 THEN 1 WHEN k % 8 = 0 THEN 3 ELSE 2 END AS bigint) AS readings FROM i
"""


def card_answer(spark: SparkSession, d: str) -> DataFrame:
    """A card from its lines to its status: fronts of two engines in turn, the zone of its back, and what is declared.

    The first engine loses every fourth number, and then only these cards go to the second
    one; every seventh zone has a wrong digit, and every eleventh card is declared with another number.
    """
    full = X.view(spark, d, _FRONT.replace("(n <> 19 OR k % 4 <> 0) AND ", ""), "customer").withColumnRenamed("doc_id", "photo_id")
    photos = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("photo_id"))
    pick = lambda keep: cascade.front_lines(lambda left: full.join(left, "photo_id", "left_semi").where(keep), _as_of())
    fronts = cascade.read_fronts(photos, [("a", pick("line_no <> 19 OR photo_id % 4 <> 0")), ("b", pick("true"))])
    # a support number of look-alikes only could be taken for a person's number
    i = X.view(spark, d, X.IDENTITY, "customer").withColumn("support", F.concat(F.lit("A"), F.substring("support", 2, 8)))
    built = zone.build_zone(F.col("support"), F.col("dni"), F.col("birth"), F.col("sex"), F.col("expiry"), F.translate("surnames", "Ñ", "N"), F.col("given"))
    b = F.col("l2")
    wrong = F.concat(F.substring(b, 1, 3), ((F.substring(b, 4, 1).cast("int") + 1) % 10).cast("string"), F.substring(b, 5, 26))
    z = i.select("*", built.alias("z")).select("k", "dni", "z.*").withColumn("l2", F.when(F.col("k") % 7 == 0, wrong).otherwise(b)).withColumn("c", F.array("l1", "l2", "l3"))
    read = zone.read_zones(z, "k", "c", _as_of()).withColumnRenamed("k", "photo_id")
    declared = z.select(F.col("k").alias("photo_id"), F.when(F.col("k") % 11 == 0, "00000000T").otherwise(F.col("dni")).alias("declared"))
    case = fronts.join(read, "photo_id").join(declared, "photo_id")
    none = F.array().cast("array<string>")
    v = verify.verify(case.select(
        F.col("photo_id").alias("k"), F.coalesce("zone.valid", F.lit(False)).alias("zone_valid"), F.col("zone.dni").alias("zone_dni"), F.col("zone.support").alias("zone_support"), "dnis", "supports", F.col("text").alias("front_text"),
        F.lit(False).alias("front_bad"), (F.col("photo_id") % 2 == 0).alias("back_bad"), none.alias("front_warnings"), none.alias("back_warnings"), "declared", F.lit(1).alias("attempt"), F.to_date("zone.expiry_date", "dd/MM/yyyy").alias("expiry"), _as_of().alias("as_of"),
    ))
    return v.select("k", F.array_join("dnis", ",").alias("dnis"), "status", "reason")


CARD_ANSWER = f"""
WITH i AS ({X.IDENTITY}), r AS (SELECT k, dni, CASE WHEN k % 11 = 0 AND dni <> '00000000T' THEN 'DATOS_NO_COINCIDEN' WHEN k % 7 <> 0 THEN 'OK' WHEN k % 2 = 0 THEN 'MALA_CALIDAD' ELSE 'LECTURA_FALLIDA' END AS reason FROM i)
SELECT k, dni AS dnis, CASE reason WHEN 'OK' THEN 'VERIFICADO' WHEN 'MALA_CALIDAD' THEN 'REPETIR' ELSE 'REVISION_ADMIN' END AS status, reason FROM r
"""

# Identifiers and labels.


def card_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a front that are glued to words or hold look-alikes, a support number, card dates, and either kind of id beside a label."""
    f = X.view(spark, d, E.PARTY, "customer").select("k", "dni", "cif", "k7")
    n = ids.card_number(F.concat(F.lit("DNI"), F.translate(F.substring("dni", 1, 2), "01", "OI"), F.substring("dni", 3, 7)))
    return f.select(
        "k", n["dni"].alias("number"), n["ok"].alias("ok"), ids.support_number(F.lit("IDESP BAA123456")).alias("support"), F.array_join(dates.card_dates(F.concat(F.lit("01022020 y 31.02.2021 y "), F.lpad((F.col("k") % 28 + 1).cast("string"), 2, "0"), F.lit("/05-2022"))), ",").alias("dates"),
        F.array_join(ids.company_ids(F.concat(F.lit("CIF "), "cif", F.lit(" y B00000000."))), ",").alias("companies"), F.array_join(ids.company_ids(F.concat(F.lit("8"), F.substring("cif", 2, 8)), True), ",").alias("repaired"),
        ids.id_of(F.when(F.col("k") % 2 == 0, F.col("cif")).otherwise(F.col("dni"))).alias("id"), ids.any_id_ok(F.when(F.col("k") % 3 == 0, F.lit("")).otherwise(F.col("cif"))).cast("string").alias("valid"),
    )


CARD_IDENTIFIERS = f"""
WITH p AS ({E.PARTY}) SELECT k, dni AS number, true AS ok, 'BAA123456' AS support, '01/02/2020,' || lpad(cast(k % 28 + 1 AS varchar), 2, '0') || '/05/2022' AS dates, cif || CASE WHEN cif <> 'B00000000' THEN ',B00000000' ELSE '' END AS companies, cif AS repaired,
  CASE WHEN k % 2 = 0 THEN cif ELSE dni END AS id, CASE WHEN k % 3 <> 0 THEN 'true' END AS valid FROM p
"""


def label_tests(spark: SparkSession, d: str) -> DataFrame:
    """Form labels, glued ones too, against values; company names against bare labels and misread ends; names."""
    t = "SELECT c_custkey AS k, split_part('CIF:|RAZÓN SOCIAL|NOMBREYAPELLIDOS|FECHA DE NACIMIENTO|CALLE MAYOR|NIF / NIE:|OBRAS GARCIA SL|OBRAS GARCIA S|LUIS GARCIA DE LA TORRE|DATOS EMPRESA', '|', cast(c_custkey % 10 as int) + 1) AS t FROM customer"
    f = X.view(spark, d, t, "customer")
    return f.select("k", lookup.is_label(F.col("t")).alias("label"), lookup.company_like(F.col("t")).alias("company"), lookup.clean_name(F.col("t")).isNotNull().alias("name"))


LABEL_TESTS = "SELECT c_custkey AS k, c_custkey % 10 IN (0, 1, 2, 3, 5) AS label, c_custkey % 10 IN (4, 6, 8, 9) AS company, c_custkey % 10 IN (4, 7, 8) AS name FROM customer"

# Where values come from.


def field_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Confidence, page, box and origin of fields as they stand in their lines."""
    docs = documents(spark, d, "apertura_centro_trabajo")
    p = provenance.placed_fields(docs, E.extract.extract(docs, "apertura_centro_trabajo", _as_of(), keep=("lines", "rows")), _as_of())
    return p.select("doc_id", "field", "confidence", F.col("page").cast("long").alias("page"), "x", "y", "w", "h", "origin")


FIELD_PROVENANCE = """
SELECT c_custkey AS doc_id, field, 1.0::double AS confidence, cast(1 AS bigint) AS page, 0.1::double AS x, y::double AS y, w::double AS w, 0.012::double AS h, 'capa_texto' AS origin
FROM customer, (VALUES ('razon_social', 0.10, 0.6), ('identificador', 0.15, 0.3), ('direccion_obra', 0.20, 0.8), ('fecha', 0.25, 0.6)) v(field, y, w)
"""


#: Documents whose values also stand in an earlier row, from the second to the eighth part of the page by the key.
_REPEATED = [
    ("COMUNICACIÓN DE APERTURA DEL CENTRO", 10, 5, 60), ("Ref. @FIRM - @CIF - CALLE MAYOR @DAY, MADRID - @DAY/05/2026", 10, 8, 90), ("Razón social: @FIRM", 10, 20, 60, "k % 2 = 0"), ("Razón social:", 10, 20, 20, "k % 2 = 1"), ("@FIRM", 40, 20, 40, "k % 2 = 1"),
    ("CIF:", 10, 30, 20, "k % 3 = 0"), ("@CIF", 10, 32, 30, "k % 3 = 0"), ("CIF: @CIF", 10, 35, 30, "k % 3 <> 0"), ("Dirección de la obra: CALLE MAYOR @DAY, MADRID", 10, 50, 80), ("Fecha de inicio: @DAY/05/2026", 10, 60, 60, "k % 4 <> 0"), ("Fecha de inicio:", 10, 60, 30, "k % 4 = 0"), ("@DAY/05/2026", 10, 64, 60, "k % 4 = 0"),
]


def field_places(spark: SparkSession, d: str) -> DataFrame:
    """Places of values that stand twice: the one that the rule has read, beside or below its label, and not the first."""
    docs = layout.documents(X.view(spark, d, E.lines_sql("apertura_centro_trabajo", _REPEATED), "customer"))
    p = traced.traced_fields(docs, "apertura_centro_trabajo", _as_of())
    return p.select("doc_id", "field", "value", F.bround("x", 6).alias("x"), F.bround("y", 6).alias("y"), F.bround("w", 6).alias("w"))


FIELD_PLACES = f"""
WITH p AS ({E.PARTY}) SELECT k AS doc_id, field, CASE field WHEN 'razon_social' THEN firm WHEN 'identificador' THEN cif WHEN 'direccion_obra' THEN 'CALLE MAYOR ' || day || ', MADRID' ELSE '2026-05-' || day END AS value,
  CASE WHEN field = 'razon_social' AND k % 2 = 1 THEN 0.4 ELSE 0.1 END::double AS x, CASE field WHEN 'razon_social' THEN 0.2 WHEN 'identificador' THEN CASE WHEN k % 3 = 0 THEN 0.32 ELSE 0.35 END WHEN 'direccion_obra' THEN 0.5 ELSE CASE WHEN k % 4 = 0 THEN 0.64 ELSE 0.6 END END::double AS y,
  CASE field WHEN 'razon_social' THEN CASE WHEN k % 2 = 0 THEN 0.6 ELSE 0.4 END WHEN 'identificador' THEN 0.3 WHEN 'direccion_obra' THEN 0.8 ELSE 0.6 END::double AS w
FROM p, (VALUES ('razon_social'), ('identificador'), ('direccion_obra'), ('fecha')) v(field)
"""


def lines_of_spans(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of rows in the running text, and the lines that a span over two rows touches."""
    docs = documents(spark, d, "apertura_centro_trabajo")
    starts = provenance.row_starts(F.col("rows"))
    at = provenance.lines_at(F.col("lines"), F.col("rows"), F.get(starts, F.lit(1)) + 2, F.get(starts, F.lit(2)) + 3)
    found = provenance.all_matches(F.col("lines"), F.col("rows"), r"\bCALLE|\bCIF", 0)
    return docs.select("doc_id", F.array_join(F.transform(starts, lambda s: s.cast("string")), ",").alias("starts"), F.array_join(F.transform(at, lambda ln: ln["line_no"].cast("string")), ",").alias("touched"), F.array_join(F.transform(found, lambda m: F.concat_ws(":", m["value"], F.get(m["lines"], F.lit(0))["line_no"].cast("string"))), ",").alias("matches"))


LINES_OF_SPANS = f"""
WITH p AS ({E.PARTY}) SELECT k AS doc_id, '0,36,' || cast(36 + 15 + length(firm) AS varchar) || ',' || cast(36 + 15 + length(firm) + 15 AS varchar) || ',' || cast(36 + 15 + length(firm) + 15 + 45 AS varchar) AS starts, '1,2' AS touched, 'CIF:2,CALLE:3' AS matches FROM p
"""

# Reports.

_PHOTO = f"""
SELECT k, engine, dni, support, surnames, given, sex, (k + CASE engine WHEN 'a' THEN 0 ELSE 1 END) % 4 <> 0 AS valid, 100 + k % 50 AS ms, k % 9 <> 0 AS has_truth,
  CASE WHEN k % 5 = 0 THEN '00000000T' ELSE dni END AS read_dni, CASE WHEN k % 6 = 0 THEN 'XXX' || substr(support, 4, 6) ELSE support END AS read_support, CASE WHEN k % 7 = 0 THEN substr(surnames, 1, 5) ELSE surnames END AS read_surnames, k % 14 = 0 AS cut
FROM ({X.IDENTITY}) i, (VALUES ('a'), ('b')) v(engine)
"""
_READ = {"dni": ("read_dni", "dni"), "num_soporte": ("read_support", "support"), "apellidos": ("read_surnames", "surnames"), "nombre": ("given", "given"), "sexo": ("sex", "sex")}


def result_row(spark: SparkSession, d: str) -> DataFrame:
    """A row for each photo and engine: what is valid, how many fields are right, which are not, and whether check digits let a wrong one through."""
    f = X.view(spark, d, _PHOTO, "customer").withColumn("photo_id", F.col("k").cast("string"))
    long_ = f.select("photo_id", "engine", "cut", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(r).alias("read"), F.when(F.col("has_truth"), F.col(t)).otherwise("").alias("truth")) for n, (r, t) in _READ.items()])).alias("x")).select("photo_id", "engine", "cut", "x.*")
    r = reports.result_rows(f.select("photo_id", "engine", "valid", "ms"), reports.compare_fields(long_))
    return r.select(F.col("photo_id").cast("long").alias("k"), "engine", "valid", F.col("ms").cast("long").alias("ms"), "fields_ok", F.array_join("failed", ",").alias("failed"), F.col("valid_wrong").cast("string").alias("valid_wrong"), F.col("valid_unprotected_wrong").cast("string").alias("valid_unprotected_wrong"))


RESULT_ROW = f"""
WITH f AS ({_PHOTO}), c AS (SELECT *, dni = read_dni AS dni_ok, support = read_support AS sup_ok, substr(support, 4, 6) = substr(read_support, 4, 6) AS digits_ok, substr(support, 1, 3) = substr(read_support, 1, 3) AS letters_ok, surnames = read_surnames OR cut AS sur_ok FROM f)
SELECT k, engine, valid, cast(ms AS bigint) AS ms, CASE WHEN has_truth THEN cast(2 + dni_ok::int + sup_ok::int + sur_ok::int AS varchar) || '/5' END AS fields_ok,
  CASE WHEN has_truth THEN array_to_string(list_filter([CASE WHEN NOT dni_ok THEN 'dni' END, CASE WHEN NOT sup_ok THEN 'num_soporte' END, CASE WHEN NOT sur_ok THEN 'apellidos' END], lambda x: x IS NOT NULL), ',') END AS failed,
  cast(CASE WHEN has_truth THEN valid AND NOT (dni_ok AND digits_ok) END AS varchar) AS valid_wrong, cast(CASE WHEN has_truth THEN valid AND NOT (sur_ok AND letters_ok) END AS varchar) AS valid_unprotected_wrong FROM c
"""

# Choices between readings.


def best_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Of the lines of an order as attempts: valid ones, then most checks, then the first."""
    sql = "SELECT l_orderkey AS photo_id, 'a' AS engine, l_linenumber * 100000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS attempt, l_partkey % 5 = 0 AS valid, l_suppkey % 7 AS checks FROM lineitem"
    return readings.best_attempt(X.view(spark, d, sql, "lineitem")).select("photo_id", "attempt", "valid", F.col("checks").cast("long").alias("checks"))


BEST_ATTEMPTS = """
WITH a AS (SELECT l_orderkey AS photo_id, l_linenumber * 100000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS attempt, l_partkey % 5 = 0 AS valid, l_suppkey % 7 AS checks FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY valid DESC, checks DESC, attempt) AS n FROM a) SELECT photo_id, attempt, valid, cast(checks AS bigint) AS checks FROM r WHERE n = 1
"""


def page_enough(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose first reading is enough; lines are in the order in which the files hold them."""
    text = F.when(F.col("l_partkey") % 4 != 0, "abcde").otherwise("abc")
    conf = (F.col("l_suppkey") % 11).cast("double") / 10
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), text.alias("text"), conf.alias("conf"), place.alias("line_no"))
    return readings.enough(lines).select("doc_id", F.coalesce("enough", F.lit(False)).alias("enough"))


PAGE_ENOUGH = "SELECT l_orderkey AS doc_id, coalesce(count(*) FILTER (WHERE l_partkey % 4 <> 0) >= 5 AND avg(cast(l_suppkey % 11 AS double) / 10) FILTER (WHERE l_partkey % 4 <> 0) >= 0.6, false) AS enough FROM lineitem GROUP BY l_orderkey"


def card_side(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("k"), readings.side(k % 3 == 0, k % 2 == 0, k % 4 == 0).alias("side"))


CARD_SIDE = "SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'reverso' WHEN c_custkey % 3 = 0 THEN 'anverso' WHEN c_custkey % 2 = 0 THEN 'reverso' ELSE 'desconocido' END AS side FROM customer"


def word_lines(spark: SparkSession, d: str) -> DataFrame:
    """Words of an order's lines as one line of text, split where a gap is wide."""
    sql = """
SELECT l_orderkey AS doc_id, 1 AS page, 1 AS block, 1 AS par, 1 AS line, n AS word_no, 'w' || cast(n as string) AS text, n * 60 + CASE WHEN n > 3 THEN 100 ELSE 0 END AS left, 10 AS top, 50 AS width, 20 AS height, CASE WHEN l_orderkey % 3 = 0 AND n = 2 THEN -1 ELSE 80 END AS conf
FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n FROM lineitem) t
"""
    got = words.lines_of_words(X.view(spark, d, sql, "lineitem"))
    return got.select("doc_id", F.col("part").cast("long").alias("part"), "text", F.col("x").cast("long").alias("x"), F.col("w").cast("long").alias("w"), F.col("conf").cast("double").alias("conf"))


WORD_LINES = """
WITH n AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n FROM lineitem),
w AS (SELECT *, n * 60 + CASE WHEN n > 3 THEN 100 ELSE 0 END AS x FROM n WHERE NOT (doc_id % 3 = 0 AND n = 2)), p AS (SELECT *, (doc_id % 3 = 0 AND n >= 3)::int + (n > 3)::int AS part FROM w)
SELECT doc_id, cast(part AS bigint) AS part, string_agg('w' || n, ' ' ORDER BY n) AS text, cast(min(x) AS bigint) AS x, cast(max(x) + 50 - min(x) AS bigint) AS w, 0.8::double AS conf FROM p GROUP BY doc_id, part
"""


def merged_segments(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of a text layer: every third starts a column of its own, in rows of six."""
    sql = """
SELECT l_orderkey AS doc_id, 1 AS page, 'p' || cast(n as string) AS text, cast(n % 6 * 40 + CASE WHEN n % 6 >= 3 THEN 60 ELSE 0 END as double) AS x0, cast(700 - 20 * floor(n / 6.0) as double) AS y0, cast(n % 6 * 40 + CASE WHEN n % 6 >= 3 THEN 60 ELSE 0 END + 35 as double) AS x1, cast(710 - 20 * floor(n / 6.0) as double) AS y1
FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS n FROM lineitem) t
"""
    return words.merged_segments(X.view(spark, d, sql, "lineitem")).select("doc_id", F.col("part").cast("long").alias("part"), "text", "x0", "x1")


MERGED_SEGMENTS = """
WITH n AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS n FROM lineitem), g AS (SELECT *, n // 3 AS part, n % 6 * 40 + CASE WHEN n % 6 >= 3 THEN 60 ELSE 0 END AS x FROM n)
SELECT doc_id, cast(part AS bigint) AS part, string_agg('p' || n, ' ' ORDER BY n) AS text, min(x)::double AS x0, (max(x) + 35)::double AS x1 FROM g GROUP BY doc_id, part
"""


def sparse_lines(spark: SparkSession, d: str) -> DataFrame:
    """Loose words on lines of three; the words of a line come in any order of height within it."""
    sql = """
SELECT l_orderkey AS doc_id, 1 AS page, 'w' || cast(n as string) AS text, n % 3 * 60 AS x, cast(floor(n / 3.0) as int) * 45 + 10 + n % 3 AS y, 50 AS w, 20 AS h, 0.5 AS conf
FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS n FROM lineitem) t
"""
    return words.sparse_lines(X.view(spark, d, sql, "lineitem")).select("doc_id", F.col("place").cast("long").alias("place"), "text", "w", "h", "conf")


SPARSE_LINES = """
WITH n AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS n FROM lineitem)
SELECT doc_id, cast(n // 3 + 1 AS bigint) AS place, string_agg('w' || n, ' ' ORDER BY n) AS text, (max(n % 3) * 60 + 50)::double AS w, (20 + max(n % 3))::double AS h, 0.5::double AS conf FROM n GROUP BY doc_id, n // 3
"""


def hybrid_lines(spark: SparkSession, d: str) -> DataFrame:
    """Two readings of a line by key: the second not asked, alike, surer, or the first empty."""
    sql = f"SELECT k, CASE WHEN k % 5 = 4 THEN '' ELSE surnames END AS text_a, 0.5 AS conf_a, CASE k % 5 WHEN 1 THEN lower(surnames) || '.' WHEN 2 THEN 'XYZ 123' WHEN 3 THEN 'QQQ' ELSE dni END AS text_b, CASE WHEN k % 5 = 3 THEN 0.4 ELSE 0.9 END AS conf_b, k % 5 <> 0 AS reread FROM ({X.IDENTITY}) i"
    f = X.view(spark, d, sql, "customer")
    return readings.chosen_lines(f.select("k", "text_a", F.col("conf_a").cast("double").alias("conf_a"), "text_b", F.col("conf_b").cast("double").alias("conf_b"), "reread")).select("k", "text", "conf", "origin", "alt")


HYBRID_LINES = f"""
WITH i AS ({X.IDENTITY}) SELECT k, CASE k % 5 WHEN 2 THEN 'XYZ 123' WHEN 4 THEN dni ELSE surnames END AS text, CASE WHEN k % 5 IN (1, 2, 4) THEN 0.9 ELSE 0.5 END::double AS conf, CASE WHEN k % 5 IN (2, 4) THEN 'b' ELSE 'a' END AS origin,
  CASE k % 5 WHEN 1 THEN lower(surnames) || '.' WHEN 2 THEN surnames WHEN 3 THEN 'QQQ' END AS alt FROM i
"""


def reused_lines(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that an earlier reading covers with sure lines; two half lines cover a box together."""
    k = F.col("c_custkey")
    base = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("doc_id"), F.lit(1).alias("page"))
    v = lambda x: F.lit(float(x))
    boxes = base.select("*", F.lit(0).alias("box_no"), v(0.1).alias("x"), v(0.1).alias("y"), v(0.4).alias("w"), v(0.02).alias("h"))
    half = lambda n, x: base.select("*", F.lit(n).alias("line_no"), v(x).alias("x"), v(0.101).alias("y"), v(0.2).alias("w"), v(0.02).alias("h"), F.when(F.col("doc_id") % 3 == n, 0.5).otherwise(0.95).alias("conf"))
    previous = half(1, 0.1).unionByName(half(2, 0.3).where("doc_id % 4 <> 0"))
    return readings.reused(boxes, previous).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


REUSED_LINES = "SELECT c_custkey AS doc_id, n AS line_no FROM customer, (VALUES (1::bigint), (2::bigint)) v(n) WHERE c_custkey % 4 <> 0 AND c_custkey % 3 = 0"


def worst_pages(spark: SparkSession, d: str) -> DataFrame:
    sql = "SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS page, CASE l_partkey % 3 WHEN 0 THEN 'apta' WHEN 1 THEN 'riesgo' ELSE 'rechazar' END AS verdict, 'w' || cast(l_partkey % 3 as string) AS warning FROM lineitem"
    pages = X.view(spark, d, sql, "lineitem").withColumn("warnings", F.array("warning"))
    return quality.worst_page(pages).select("doc_id", "verdict", F.array_join("warnings", ",").alias("warnings"))


WORST_PAGES = """
WITH p AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS page, l_partkey % 3 AS v FROM lineitem),
f AS (SELECT doc_id, v, min(page) AS page FROM p GROUP BY doc_id, v)
SELECT doc_id, CASE max(v) WHEN 0 THEN 'apta' WHEN 1 THEN 'riesgo' ELSE 'rechazar' END AS verdict, string_agg('w' || v, ',' ORDER BY page) AS warnings FROM f GROUP BY doc_id
"""

# Templates.

_TEMPLATE = "SELECT * FROM (VALUES ('dni', 0.1, 0.8, 0.3, 0.08), ('can', 0.7, 0.8, 0.2, 0.06), ('nombre', 0.4, 0.3, 0.3, 0.07), ('etiqueta.nombre', 0.4, 0.24, 0.15, 0.04), ('etiqueta.sexo', 0.4, 0.45, 0.1, 0.04)) v(key, x, y, w, h)"


def _template(spark: SparkSession) -> DataFrame:
    return spark.sql(_TEMPLATE).select("key", *[F.col(c).cast("double").alias(c) for c in "xywh"])


def template_fit(spark: SparkSession, d: str) -> DataFrame:
    """Boxes a little off their places, upside down for every third photo: the error tells which way it lies."""
    t = _template(spark).where("key in ('dni', 'can', 'nombre')")
    k = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("photo_id"))
    off = (F.col("photo_id") % 7) / 1000.0
    m = k.crossJoin(F.broadcast(t)).select("photo_id", "key", F.when(F.col("photo_id") % 3 == 0, 1 - F.col("x") - F.col("w") - off).otherwise(F.col("x") + off).alias("x"), F.when(F.col("photo_id") % 3 == 0, 1 - F.col("y") - F.col("h")).otherwise(F.col("y")).alias("y"), "w", "h")
    return template.fit_error(m, t).select("photo_id", F.bround(F.least("error", "error_turned"), 6).alias("error"), "turned")


TEMPLATE_FIT = "SELECT c_custkey AS photo_id, round_even((c_custkey % 7) / 1000.0, 6)::double AS error, c_custkey % 3 = 0 AS turned FROM customer"


#: Boxes and labels of a card as every supplier's photos place them, a little differently for each.
_PLACED = """
SELECT s_suppkey AS k, key, x + (s_suppkey % 11) / 1000.0 AS x, y + (s_suppkey % 7) / 1000.0 AS y, w + (s_suppkey % 5) / 1000.0 AS w, h AS h
FROM supplier, (VALUES ('dni', 0.1, 0.8, 0.3, 0.08), ('can', 0.7, 0.8, 0.2, 0.06), ('nombre', 0.4, 0.3, 0.3, 0.07), ('etiqueta.nombre', 0.4, 0.24, 0.15, 0.04), ('etiqueta.sexo', 0.4, 0.45, 0.1, 0.04)) v(key, x, y, w, h)
WHERE key <> 'etiqueta.sexo' OR s_suppkey % 3 <> 0
"""


def template_zones(spark: SparkSession, d: str) -> DataFrame:
    """Zones with margins, and the zone of a name from its label to the next one, in the template of every supplier."""
    t = X.view(spark, d, _PLACED, "supplier").select("k", "key", *[F.col(c).cast("double").alias(c) for c in "xywh"])
    z = template.zone_boxes(t.where("not startswith(key, 'etiqueta.')"), "k").withColumn("how", F.lit("box")).unionByName(template.name_zones(t, "k").withColumn("how", F.lit("labels")))
    return z.select("k", "how", "key", *[F.bround(c, 6).alias(c) for c in "xywh"])


TEMPLATE_ZONES = f"""
WITH p AS (SELECT k, key, x::double AS x, y::double AS y, w::double AS w, h::double AS h FROM ({_PLACED}) t), b AS (SELECT * FROM p WHERE key NOT LIKE 'etiqueta.%'),
l AS (SELECT n.k, n.x, n.y, n.w, n.h, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, s.y AS below FROM p n JOIN p a ON a.k = n.k AND a.key = 'etiqueta.nombre' LEFT JOIN p s ON s.k = n.k AND s.key = 'etiqueta.sexo' WHERE n.key = 'nombre'),
m AS (SELECT k, greatest(0, least(ax, x) - 0.015) AS x0, ay + 0.9 * ah AS y0, least(1, greatest(x + w, ax + aw) + 0.3) AS x1, CASE WHEN below IS NULL THEN y + h + 0.012 ELSE greatest(below - 0.004, ay + 0.9 * ah + h) END AS y1 FROM l)
SELECT k, how, key, round_even(x, 6) AS x, round_even(y, 6) AS y, round_even(w, 6) AS w, round_even(h, 6) AS h FROM (
  SELECT k, 'box' AS how, key, x - 0.015 AS x, y - 0.012 AS y, least(1, x + w + CASE key WHEN 'nombre' THEN 0.3 ELSE 0.03 END) - (x - 0.015) AS w, least(1, y + h + 0.012) - (y - 0.012) AS h FROM b
  UNION ALL SELECT k, 'labels', 'nombre', x0, y0, x1 - x0, least(1, y1) - y0 FROM m) z
"""


def template_straightened(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of cards that are moved and made larger, back on the unit square."""
    k = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    s, x0, y0 = (100.0 + F.col("k") % 9), (F.col("k") % 13).cast("double"), (F.col("k") % 17).cast("double")
    c = F.array(x0, y0, x0 + s, y0, x0 + s, y0 + s * 2, x0, y0 + s * 2)
    got = template.straightened(k.select(F.col("k").cast("string").alias("photo_id"), F.lit("dni").alias("key"), (x0 + s * 0.25).alias("x"), (y0 + s).alias("y"), (s * 0.5).alias("w"), (s * 0.4).alias("h"), c.alias("corners")))
    return got.select(F.col("photo_id").cast("long").alias("k"), *[F.bround(v, 6).alias(v) for v in "xywh"])


TEMPLATE_STRAIGHTENED = "SELECT s_suppkey AS k, 0.25::double AS x, 0.5::double AS y, 0.5::double AS w, 0.2::double AS h FROM supplier"

# Bytes of files.


def pdf_bytes(spark: SparkSession, d: str) -> DataFrame:
    """What bytes tell of a PDF: its kind, why it cannot be read, forms, signatures, how often it was saved."""
    k = F.col("c_custkey")
    head = F.when(k % 7 == 0, F.lit("GIF89a")).otherwise(F.concat(F.repeat(F.lit("\n "), (k % 3).cast("int")), F.lit("%PDF-1.7\n"), F.when(k % 5 == 0, "/Linearized 1\n").otherwise("")))
    body = F.concat(F.when(k % 4 == 0, "/AcroForm 3 0 R\n").otherwise(""), F.when(k % 6 == 0, "/ByteRange [0 1 2 3]\n").otherwise(""), F.when(k % 11 == 0, "/Encrypt 5 0 R\n").otherwise(""), F.repeat(F.lit("%%EOF\n"), (k % 4).cast("int")))
    raw = F.when(k % 13 == 0, "").otherwise(F.concat(head, body)).cast("binary")
    from ..operators.authenticity import revisions

    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("k"), raw.alias("c")).select("k", files.is_pdf(F.col("c")).alias("pdf"), files.unreadable(F.col("c")).alias("reason"), files.has_form(F.col("c")).alias("form"), files.has_signature(F.col("c")).alias("signature"), revisions(F.col("c")).cast("long").alias("saves"))


PDF_BYTES = """
SELECT c_custkey AS k, c_custkey % 13 <> 0 AND c_custkey % 7 <> 0 AS pdf, CASE WHEN c_custkey % 13 = 0 THEN 'vacio' WHEN c_custkey % 7 = 0 THEN 'formato' WHEN c_custkey % 11 = 0 THEN 'cifrado' WHEN c_custkey % 4 = 0 THEN 'corrupto' END AS reason,
  c_custkey % 13 <> 0 AND c_custkey % 4 = 0 AS form, c_custkey % 13 <> 0 AND c_custkey % 6 = 0 AS signature,
  cast(greatest(1, CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE c_custkey % 4 - CASE WHEN c_custkey % 5 = 0 AND c_custkey % 7 <> 0 THEN 1 ELSE 0 END END) AS bigint) AS saves FROM customer
"""


def pdf_signed_and_made(spark: SparkSession, d: str) -> DataFrame:
    """Files that are signed, saved again after it, or signed twice, made by programs whose names are escaped, octal or Unicode strings."""
    k = F.col("c_custkey")
    number = k.cast("string")
    wide = F.concat(F.lit("<FEFF00D10075"), F.regexp_replace(number, "([0-9])", "003$1"), F.lit(">"))
    producer = F.when(k % 4 == 0, F.concat(F.lit("/Producer (Word \\(2016\\) (b) "), number, F.lit(")"))).when(k % 4 == 1, F.concat(F.lit("/Producer "), wide)).when(k % 4 == 2, F.concat(F.lit("/Producer(Acme\\056PDF\\\n"), number, F.lit(")"))).otherwise("/ProducerX (no)")
    old = F.concat(F.lit("%PDF-1.7\n7 0 obj\n<< /Producer (old) >>\nendobj\ntrailer << /Info 7 0 R >>\n%%EOF\n7 0 obj\n<< "), producer, F.lit(" /Creator <4D79> >>\nendobj\ntrailer << /Info 7 0 R >>\n"))
    signed = lambda before, tail: F.concat(before, F.lit("/ByteRange [0 10 20 "), F.lpad((F.length(before) + 31 + len(tail) - 20).cast("string"), 10, "0"), F.lit("]" + tail))
    once = F.when(k % 5 == 0, old).otherwise(signed(old, "\n%%EOF\n"))
    raw = F.when(k % 5 == 2, F.concat(once, F.lit("more\n%%EOF\n"))).when(k % 5 == 3, signed(once, "\n%%EOF\n")).when(k % 5 == 4, F.concat(signed(once, "\n%%EOF\n"), F.lit(" "))).otherwise(once)
    f = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("k"), F.encode(raw, "ISO-8859-1").alias("c"))
    r, i = authenticity.signature_ranges(F.col("c")), authenticity.information(F.col("c"))
    said = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return f.select("k", i["Producer"].alias("producer"), i["Creator"].alias("creator"), F.array_join(F.transform(r, lambda x: said(x["covers"])), ",").alias("covers"), F.array_join(F.transform(r, lambda x: said(x["changed_after"])), ",").alias("changed"))


PDF_SIGNED_AND_MADE = """
SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'Word (2016) (b) ' || c_custkey WHEN 1 THEN 'Ñu' || c_custkey WHEN 2 THEN 'Acme.PDF' || c_custkey END AS producer, 'My' AS creator,
  split_part(';true;false;false,true;false,false', ';', cast(c_custkey % 5 AS int) + 1) AS covers, split_part(';false;true;?,false;true,true', ';', cast(c_custkey % 5 AS int) + 1) AS changed FROM customer
"""


def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes in points on pages turned by quarters, as fractions of the page that is shown."""
    k = F.col("s_suppkey")
    v = lambda x: F.lit(float(x))
    b = files.to_page(v(10), v(20), v(30), v(40), v(100), v(200), (k % 4) * 90)
    return spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("k"), *[F.bround(b[c], 6).alias(c) for c in "xywh"])


PAGE_BOXES = """
SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 0.1 WHEN 1 THEN 0.1 WHEN 2 THEN 0.7 ELSE 0.8 END::double AS x, CASE s_suppkey % 4 WHEN 0 THEN 0.8 WHEN 1 THEN 0.1 WHEN 2 THEN 0.1 ELSE 0.7 END::double AS y,
  CASE WHEN s_suppkey % 2 = 0 THEN 0.2 ELSE 0.1 END::double AS w, CASE WHEN s_suppkey % 2 = 0 THEN 0.1 ELSE 0.2 END::double AS h FROM supplier
"""

QUERIES = (
    zone_lines_chosen, zone_versions, zone_variants, zone_mended, front_fields, front_boxes, front_labels, zone_values, back_cascade, front_cascade, card_answer, card_identifiers, label_tests, field_provenance, field_places, lines_of_spans, result_row,
    best_attempts, page_enough, card_side, word_lines, merged_segments, sparse_lines, hybrid_lines, reused_lines, worst_pages, template_fit, template_zones, template_straightened, pdf_bytes, pdf_signed_and_made, page_boxes,
)
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in QUERIES}
