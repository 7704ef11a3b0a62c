"""Deterministic inputs derived from the driver's tables.

Each is plain SQL over a table that Spark and DuckDB both read the same way, so the
same rows feed a query and its oracle. AS_OF stands for today.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import spread

AS_OF = "2026-06-30"
#: Tables of a few bytes a row, or of one row group, whose rows cost much.
SPREAD = ("customer", "supplier", "orders", "documents")

_NUM = "lpad(cast((c_custkey * 7919) % 100000000 as string), 8, '0')"
_LETTER = "substr('TRWAGMYFPDXBNJZSQVHLCKE', cast(((c_custkey * 7919) % 100000000) % 23 as int) + 1, 1)"

#: DNI with a wrong letter where the key is a multiple of 5.
NIF = f"""
SELECT c_custkey AS k, {_NUM} || CASE WHEN c_custkey % 5 = 0 THEN
         substr('TRWAGMYFPDXBNJZSQVHLCKE', cast((((c_custkey * 7919) % 100000000) % 23 + 1 + c_custkey % 7) % 23 as int) + 1, 1)
       ELSE {_LETTER} END AS nif
FROM customer
"""

#: NIE by the key modulo 3, wrong where it is a multiple of 4.
NIE = """
SELECT s_suppkey AS k, substr('XYZ', cast(s_suppkey % 3 as int) + 1, 1) || lpad(cast((s_suppkey * 104729) % 10000000 as string), 7, '0') ||
       substr('TRWAGMYFPDXBNJZSQVHLCKE', cast(((s_suppkey % 3) * 10000000 + (s_suppkey * 104729) % 10000000 + CASE WHEN s_suppkey % 4 = 0 THEN 3 ELSE 0 END) % 23 as int) + 1, 1) AS nie
FROM supplier
"""

#: CIF of all initials with every control sign in turn, so that about one in ten is right.
CIF = """
SELECT c_custkey AS k, substr('ABCDEFGHJKLMNPQRSUVW', cast(c_custkey % 20 as int) + 1, 1) || lpad(cast((c_custkey * 7907) % 10000000 as string), 7, '0') ||
       substr('0123456789ABCDEFGHIJ', cast((c_custkey * 13) % 20 as int) + 1, 1) AS cif
FROM customer
"""

#: Identities, with names from fixed lists, and a kind of corruption by the key modulo 8.
IDENTITY = f"""
SELECT c_custkey AS k, c_custkey % 8 AS kind, {_NUM} || {_LETTER} AS dni,
       substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(c_custkey % 26 as int) + 1, 1) || substr('BCDFGHJKLMNPQRSTVWXYZ', cast(c_custkey % 21 as int) + 1, 1) ||
         substr('AEIOUXYZ', cast((c_custkey * 3) % 8 as int) + 1, 1) || lpad(cast((c_custkey * 997) % 1000000 as string), 6, '0') AS support,
       lpad(cast(40 + (c_custkey * 7) % 60 as string), 2, '0') || lpad(cast(1 + c_custkey % 12 as string), 2, '0') || lpad(cast(1 + c_custkey % 28 as string), 2, '0') AS birth,
       lpad(cast(27 + c_custkey % 10 as string), 2, '0') || lpad(cast(1 + (c_custkey * 5) % 12 as string), 2, '0') || lpad(cast(1 + (c_custkey * 3) % 28 as string), 2, '0') AS expiry,
       CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
       split_part('GARCIA,LOPEZ,MUÑOZ,PEREZ,IBAÑEZ,RUIZ,GOMEZ,DIAZ', ',', cast(c_custkey % 8 as int) + 1) || ' ' ||
         split_part('SANZ,VEGA,CANO,GIL,MORA,RAMOS,PRIETO', ',', cast(c_custkey % 7 as int) + 1) AS surnames,
       split_part('CARMEN,LUIS,ANA MARIA,JOSE,LUCIA,PEDRO,MARTA,JUAN,SARA', ',', cast(c_custkey % 9 as int) + 1) AS given
FROM customer
"""

#: Spanish text with a date in four spellings, an amount and ids.
DATED = """
SELECT o_orderkey AS k, CASE o_orderkey % 4
  WHEN 0 THEN 'Fecha: ' || cast(day(o_orderdate) as string) || '/' || lpad(cast(month(o_orderdate) as string), 2, '0') || '/' || cast(year(o_orderdate) as string) || '.'
  WHEN 1 THEN 'Madrid, a ' || cast(day(o_orderdate) as string) || ' de ' || split_part('enero,febrero,marzo,abril,mayo,junio,julio,agosto,septiembre,octubre,noviembre,diciembre', ',', cast(month(o_orderdate) as int)) || ' de ' || cast(year(o_orderdate) as string)
  WHEN 2 THEN 'dado el ' || cast(day(o_orderdate) as string) || ' DE' || upper(split_part('enero,febrero,marzo,abril,mayo,junio,julio,agosto,septiembre,octubre,noviembre,diciembre', ',', cast(month(o_orderdate) as int))) || ' DE' || cast(year(o_orderdate) as string)
  ELSE 'el 31-0' || cast(1 + o_orderkey % 9 as string) || '-' || lpad(cast(year(o_orderdate) % 100 as string), 2, '0') || ' y el ' || cast(day(o_orderdate) as string) || '.' || cast(month(o_orderdate) as string) || '.' || cast(year(o_orderdate) as string) END AS t
FROM orders
"""


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Runs fixture SQL with ``{table}`` names bound to the Parquet tables of sf_dir; no view is left behind."""
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    # work on whole texts, and on cards and documents made from a key, is heavy for each row, so these rows are spread over the cores
    return spark.sql(sql, **{t: spread(read(t)) if t in SPREAD else read(t) for t in tables})
