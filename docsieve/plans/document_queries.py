"""Queries over layout, lookups, the classifier and the extractors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import row_form
from ..operators import classify, extract, layout, lookup
from . import fixtures as X
from .scalar_queries import _FOLD

#: Two columns; centres of a row differ by less than half a height, and the right one comes first in half of the rows.
_GRID = """
SELECT doc_id, line_no, 1 AS page, 'line ' || cast(line_no as string) AS text, cast(CASE WHEN line_no % 2 = 0 THEN 10 ELSE 60 END as double) / 100 AS x,
  cast(100 + 50 * floor((line_no + 0.0) / 2) + CASE WHEN line_no % 4 < 2 THEN line_no % 2 * 4 ELSE (1 - line_no % 2) * 4 END as double) / 1000 AS y, cast(30 as double) / 100 AS w, cast(10 + (doc_id + line_no) % 5 as double) / 1000 AS h, 'capa_texto' AS origin, cast(1 as double) AS conf, cast(NULL as string) AS alt
FROM (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS line_no FROM lineitem) t
"""


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.reading_order(X.view(spark, d, _GRID, "lineitem")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("place").cast("long").alias("place"))


READING_ORDER = f"WITH g AS ({_GRID}) SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no // 2, x) AS place FROM g"


def page_rows(spark: SparkSession, d: str) -> DataFrame:
    return layout.column_text(X.view(spark, d, _GRID, "lineitem")).select("doc_id", F.col("row").cast("long").alias("row"), "text")


PAGE_ROWS = f"WITH g AS ({_GRID}) SELECT doc_id, cast(line_no // 2 + 1 AS bigint) AS row, string_agg(text, '  ' ORDER BY x) AS text FROM g GROUP BY doc_id, line_no // 2"


def letter_height(spark: SparkSession, d: str) -> DataFrame:
    return layout.letter_height(X.view(spark, d, _GRID, "lineitem"))


LETTER_HEIGHT = f"""
WITH g AS ({_GRID}), r AS (SELECT doc_id, h, row_number() OVER (PARTITION BY doc_id ORDER BY h) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM g)
SELECT doc_id, max(h) FILTER (WHERE i = n // 2) AS height FROM r GROUP BY doc_id
"""

#: A form: a labelled number in one row, boxes with their values below, and two sections.
_FORM = f"""
SELECT k AS doc_id, n AS line_no, 1 AS page, replace(replace(replace(t, '@DNI', dni), '@NAME', given || ' ' || surnames), '@FIRM', 'OBRAS ' || surnames || ' SL') AS text, cast(x as double) / 100 AS x, cast(y as double) / 100 AS y, cast(w as double) / 100 AS w, cast(1 as double) / 100 AS h,
  'capa_texto' AS origin, cast(1 as double) AS conf, cast(NULL as string) AS alt
FROM ({X.IDENTITY}) i, (VALUES (0, 'NIF:', 10, 10, 8), (1, '@DNI', 30, 10, 15), (2, 'RAZÓN SOCIAL', 10, 20, 20), (3, 'DOMICILIO', 60, 20, 20), (4, '@FIRM', 10, 22, 40), (5, 'CALLE MAYOR', 60, 22, 30),
  (6, 'DATOS DE LA EMPRESA', 10, 30, 40), (7, 'una línea', 10, 35, 20), (8, 'otra línea', 10, 40, 20), (9, 'CLÁUSULAS', 10, 45, 20), (10, '@NAME', 10, 50, 30)) v(n, t, x, y, w)
WHERE n NOT IN (7, 8) OR k % 3 <> n - 7
"""


def _forms(spark: SparkSession, d: str) -> DataFrame:
    return layout.documents(X.view(spark, d, _FORM, "customer"))


def label_value_same_row(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d).select("doc_id", lookup.labelled(r"\bNIF\b\s*:?").alias("value"))


LABEL_VALUE_SAME_ROW = f"WITH i AS ({X.IDENTITY}) SELECT k AS doc_id, dni AS value FROM i"


def label_value_below(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d).select("doc_id", lookup.labelled(r"\bRAZON\s+SOCIAL\b\s*:?").alias("value"))


LABEL_VALUE_BELOW = f"WITH i AS ({X.IDENTITY}) SELECT k AS doc_id, 'OBRAS ' || surnames || ' SL' AS value FROM i"


def section_slice(spark: SparkSession, d: str) -> DataFrame:
    part = lookup.section(r"DATOS\s+DE\s+LA\s+EMPRESA", "CLAUSULAS")
    return _forms(spark, d).select("doc_id", F.array_join(F.transform(part, lambda ln: ln["norm"]), "|").alias("lines"))


SECTION_SLICE = "SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'OTRA LINEA' WHEN 1 THEN 'UNA LINEA' ELSE 'UNA LINEA|OTRA LINEA' END AS lines FROM customer"

#: Texts of documents with a sentence of a type, by the key modulo 19; the last has none.
_SENTENCES = (
    "Diploma de la Fundación Laboral de la Construcción, nivel básico, 60 horas", "Título de Técnico Superior en Prevención de Riesgos Profesionales", "Máster Universitario en Prevención de Riesgos Laborales, la Rectora",
    "Título universitario oficial de Arquitecto", "Curso de coordinador de seguridad y salud en obras de construcción", "La Tesorería General de la Seguridad Social certifica: al corriente", "La Agencia Tributaria certifica: al corriente de sus obligaciones tributarias",
    "Póliza de responsabilidad civil, tomador y límite por siniestro", "Registro de Empresas Acreditadas, inscripción", "Comunicación de apertura del centro de trabajo", "Plan de seguridad y salud de la obra", "Evaluación de riesgos y medidas preventivas",
    "Coordinación de actividades empresariales (CAE)", "Contrato de trabajo indefinido y cláusulas", "Certificado de aptitud del reconocimiento médico: apto", "Información de riesgos del puesto, artículo 18, recibí", "Formación del artículo 19, 8 horas", "Entrega de equipos de protección individual (EPI)", "",
)
_TYPED = f"SELECT doc_id AS k, text || chr(10) || split_part('{'|'.join(_SENTENCES)}', '|', cast(doc_id % 19 as int) + 1) AS t FROM documents"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    f = X.view(spark, d, _TYPED, "documents").select("k", row_form(F.col("t")).alias("n"))
    return f.select("k", classify.scores(F.col("n")).alias("s"))


def classify_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("k", F.explode_outer(F.filter("s", lambda x: x["points"] > 0)).alias("x")).where("x is not null").select("k", "x.kind", "x.points")


_KEYS_SQL = ", ".join(f"({i}, '{kind}', '{p.replace(chr(39), chr(39) * 2)}', cast({w} AS double))" for i, (kind, table) in enumerate(classify.KEYS.items()) for p, w in table.items())
_SCORED_SQL = f"""
f AS ({_TYPED}), n AS (SELECT k, trim(regexp_replace({_FOLD.format(c='t')}, '[\\s\\x0B]+', ' ', 'g')) AS n FROM f), p(ord, kind, pattern, points) AS (VALUES {_KEYS_SQL}),
s AS (SELECT k, ord, kind, sum(points) AS points FROM n JOIN p ON regexp_matches(n, pattern) GROUP BY k, ord, kind),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY points DESC, ord) AS place FROM s)
"""
CLASSIFY_SCORE = f"WITH {_SCORED_SQL} SELECT k, kind, points FROM s"


def classify_top3(spark: SparkSession, d: str) -> DataFrame:
    c = _scored(spark, d).select("k", classify.ranked(F.col("s")).alias("r")).select("k", classify.classify(F.col("r")).alias("c"))
    return c.select("k", F.coalesce("c.kind", F.lit("")).alias("kind"), "c.confidence", F.array_join(F.transform("c.candidates", lambda x: x["kind"]), ",").alias("candidates"))


CLASSIFY_TOP3 = f"""
WITH {_SCORED_SQL}, a AS (SELECT k, max(kind) FILTER (WHERE place = 1) AS k1, max(points) FILTER (WHERE place = 1) AS p1, coalesce(max(points) FILTER (WHERE place = 2), 0) AS p2, string_agg(kind, ',' ORDER BY place) FILTER (WHERE place <= 3) AS candidates FROM r GROUP BY k)
SELECT doc_id AS k, CASE WHEN p1 >= 3 THEN k1 ELSE '' END AS kind, CASE WHEN p1 >= 3 THEN round_even(p1 / (p1 + p2 + 1), 2) ELSE 0.0::double END AS confidence, coalesce(candidates, '') AS candidates FROM documents LEFT JOIN a ON a.k = doc_id
"""


def reading_status(spark: SparkSession, d: str) -> DataFrame:
    """Each text asked for as the type of its neighbour where the key is a multiple of 4."""
    kinds = F.array(*map(F.lit, classify.KEYS))
    wanted = F.get(kinds, ((F.col("k") + F.when(F.col("k") % 4 == 0, 1).otherwise(0)) % 18).cast("int"))
    r = _scored(spark, d).select("k", classify.ranked(F.col("s")).alias("r"), wanted.alias("wanted")).select("k", "wanted", classify.classify(F.col("r"), F.col("wanted")).alias("c"))
    free = F.col("wanted").isin("plan_seguridad_salud", "evaluacion_riesgos", "cae_documentacion")
    return r.select("k", classify.status(F.col("c.agrees"), F.col("c.kind"), F.col("wanted"), ~free, F.when(free, 0).otherwise(F.col("k") % 2), F.when(F.col("k") % 6 == 1, "riesgo").otherwise("apta")).alias("status"))


_KINDS = ", ".join(f"({i}, '{k}')" for i, k in enumerate(classify.KEYS))
READING_STATUS = f"""
WITH {_SCORED_SQL}, t(i, kind) AS (VALUES {_KINDS}), w AS (SELECT doc_id AS k, t.kind AS wanted, t.i BETWEEN 10 AND 12 AS free FROM documents JOIN t ON t.i = (doc_id + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END) % 18),
b AS (SELECT w.*, r.kind AS top, coalesce(r.points, 0) AS p1, coalesce(s.points, 0) AS own FROM w LEFT JOIN r ON r.k = w.k AND r.place = 1 LEFT JOIN s ON s.k = w.k AND s.kind = w.wanted)
SELECT k, CASE WHEN NOT (own >= 3 AND own >= 0.6 * p1) AND p1 >= 3 AND top <> wanted THEN 'OTRO_DOCUMENTO' WHEN ((own >= 3 AND own >= 0.6 * p1) OR NOT free) AND (free OR k % 2 = 0) THEN 'COMPLETA' WHEN k % 6 = 1 THEN 'ILEGIBLE' ELSE 'INCOMPLETA' END AS status FROM b
"""

_DIPLOMA = f"""
SELECT k AS doc_id, n AS line_no, 1 AS page, replace(replace(replace(replace(t, '@DNI', dni), '@NAME', given || ' ' || surnames), '@H', cast(20 + k % 80 as string)), '@DATE', cast(1 + k % 28 as string) || ' de ' || split_part('enero,marzo,mayo,julio', ',', cast(k % 4 as int) + 1) || ' de ' || cast(2010 + k % 15 as string)) AS text,
  cast(10 as double) / 100 AS x, cast(y as double) / 100 AS y, cast(80 as double) / 100 AS w, cast(12 as double) / 1000 AS h, 'capa_texto' AS origin, cast(1 as double) AS conf, cast(NULL as string) AS alt
FROM ({X.IDENTITY}) i, (VALUES (0, 'FUNDACIÓN LABORAL DE LA CONSTRUCCIÓN', 10), (1, 'D. @NAME, con NIF @DNI, ha superado el curso', 20), (2, 'con una duración de @H horas', 25), (3, 'Madrid, a @DATE', 40)) v(n, t, y)
WHERE n <> 2 OR k % 5 <> 0
"""


def _diplomas(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract(layout.documents(X.view(spark, d, _DIPLOMA, "customer")), "flc_60h", F.lit(X.AS_OF).cast("date"))


def doc_fields_long(spark: SparkSession, d: str) -> DataFrame:
    return extract.long_fields(_diplomas(spark, d))


DOC_FIELDS_LONG = f"""
WITH i AS ({X.IDENTITY}) SELECT k AS doc_id, field, CASE field WHEN 'titular' THEN given || ' ' || surnames WHEN 'tratamiento' THEN 'DON' WHEN 'nif' THEN dni WHEN 'horas' THEN cast(20 + k % 80 AS varchar)
  ELSE cast(2010 + k % 15 AS varchar) || '-' || list_extract(['01', '03', '05', '07'], cast(k % 4 AS int) + 1) || '-' || lpad(cast(1 + k % 28 AS varchar), 2, '0') END AS value
FROM i, (VALUES ('titular'), ('tratamiento'), ('nif'), ('horas'), ('fecha')) v(field) WHERE field <> 'horas' OR k % 5 <> 0
"""


def required_missing(spark: SparkSession, d: str) -> DataFrame:
    return _diplomas(spark, d).select("doc_id", F.array_join("missing", ",").alias("missing"))


REQUIRED_MISSING = "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 5 = 0 THEN 'horas' ELSE '' END AS missing FROM customer"

QUERIES = (reading_order, page_rows, letter_height, label_value_same_row, label_value_below, section_slice, classify_score, classify_top3, reading_status, doc_fields_long, required_missing)
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in QUERIES}
