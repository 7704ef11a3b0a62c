"""Which document is it? Points for the patterns of each type that a text holds."""

from __future__ import annotations

import json
import re
import re._constants as _sre
import zlib
from dataclasses import dataclass
from re._parser import parse as _parse

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let
from .field_rules import INDUSTRIAL

LEAST, SHARE = 3.0, 0.6

# Types in registry order, patterns over upper case without accents, and their points.
KEYS: dict[str, dict[str, float]] = {
    "flc_60h": {r"FUNDACION LABORAL DE LA CONSTRUCCION": 3, r"CONVENIO (?:GENERAL|COLECTIVO)[A-Z ]{0,20}CONSTRUCCION": 2, r"\b60\s*(?:,00\s*)?H(?:ORAS)?\b": 1.5, r"NIVEL BASICO": 1.5, r"PLENO APROVECHAMIENTO": 1, r"PREVENCION": 0.5, r"TARJETA PROFESIONAL DE LA CONSTRUCCION": 1, r"\bDIPLOMA\b": 0.5},
    "ts_riesgos": {r"TECNICO SUPERIOR EN PREVENCION DE RIESGOS PROFESIONALES": 4, r"TITULO DE TECNICO SUPERIOR": 1.5, r"FORMACION PROFESIONAL": 1, r"CICLO FORMATIVO": 1, r"REY DE ESPAÑA": 0.5, r"\b(?:MINISTR[OA]|CONSEJER[OA])\b": 0.5},
    "ts_prl": {r"MASTER UNIVERSITARIO": 3, r"PREVENCION DE RIESGOS LABORALES": 2, r"\bUNIVERSI(?:DAD|TAT)\b": 1, r"\bRECTOR": 1, r"REGISTRO NACIONAL DE TITULADOS": 1, r"TITULO (?:OFICIAL|PROPIO)": 1, r"\bMASTER\b": 1},
    "titulo_tecnico": {r"\bARQUITECT[OA]\b|ARQUITECTURA": 4, r"\bAPAREJADOR": 4, r"INGENIER(?:O|A|IA)\s+(?:TECNIC[OA]\s+)?(?:EN\s+)?INDUSTRIAL": 4, rf"INGENIERIA\s+(?:EN\s+|DE\s+)?(?:{INDUSTRIAL}|EDIFICACION)": 3, r"\bINGENIER": 1, r"\bUNIVERSI(?:DAD|TAT)\b": 1, r"\bRECTOR": 1, r"REGISTRO NACIONAL DE TITUL": 1, r"TITULO (?:UNIVERSITARIO )?OFICIAL": 1, r"\bGRADUAD[OA]\b|\bGRADO EN\b": 1},
    "curso_coordinador_ss": {r"COORDINADOR(?:A|ES)?\s+(?:EN\s+MATERIA\s+)?DE\s+SEGURIDAD\s+Y\s+SALUD": 5, r"COORDINACION\s+(?:EN\s+MATERIA\s+)?DE\s+SEGURIDAD\s+Y\s+SALUD": 4, r"(?:REAL DECRETO|R\.?D\.?) 1627/1997": 1, r"OBRAS?\s+DE\s+CONSTRUCCION": 1, r"\bCURSO\b": 1, r"\bHORAS\b": 0.5, r"APROVECHAMIENTO|SUPERADO": 0.5, r"\bCERTIFICA|\bDIPLOMA\b": 0.5},
    "certificado_tgss": {r"TESORERIA GENERAL DE LA SEGURIDAD SOCIAL": 3, r"AL CORRIENTE": 2, r"SEGURIDAD SOCIAL": 1, r"\bCERTIFICA\b": 1, r"CUENTA DE COTIZACION|\bC\.?C\.?C\.?\b": 0.5, r"OBLIGACIONES": 0.5},
    "certificado_aeat": {r"AGENCIA (?:ESTATAL DE ADMINISTRACION )?TRIBUTARIA": 3, r"OBLIGACIONES TRIBUTARIAS": 2, r"AL CORRIENTE": 2, r"\bCERTIFICA\b": 1, r"LEY GENERAL TRIBUTARIA|REGLAMENTO GENERAL[A-Z ,]{0,40}GESTION": 1},
    "seguro_rc": {r"RESPONSABILIDAD CIVIL": 3, r"\bPOLIZA\b": 2, r"\bTOMADOR": 1.5, r"\bASEGURADOR": 1, r"\bSINIESTRO": 1, r"CONDICIONES PARTICULARES": 1, r"\bPRIMA\b": 0.5, r"SUMA ASEGURADA|LIMITE": 0.5},
    "registro_empresa": {r"REGISTRO DE EMPRESAS ACREDITADAS": 4, r"LEY 32/2006": 2, r"\bINSCRIPCION\b": 1.5, r"SECTOR DE LA CONSTRUCCION": 1, r"\bR\.?E\.?A\.?\b": 1},
    "apertura_centro_trabajo": {r"\bAPERTURA\b": 2, r"CENTRO DE TRABAJO": 2, r"REANUDACION": 1.5, r"\bCOMUNICACION\b": 1, r"AUTORIDAD LABORAL": 1, r"ORDEN TIN/1071/2010": 2, r"\bOBRAS?\b": 0.5, r"\bPROMOTOR": 0.5},
    "plan_seguridad_salud": {r"PLAN DE SEGURIDAD Y SALUD": 4, r"(?:REAL DECRETO|R\.?D\.?) 1627/1997": 1.5, r"ESTUDIO (?:BASICO )?DE SEGURIDAD": 1, r"\bCONTRATISTA": 1, r"\bOBRA\b": 0.5, r"\bCOORDINADOR": 0.5},
    "evaluacion_riesgos": {r"EVALUACION DE (?:LOS )?RIESGOS": 4, r"PUESTOS? DE TRABAJO": 1, r"PROBABILIDAD": 1, r"SEVERIDAD|CONSECUENCIAS": 1, r"MEDIDAS PREVENTIVAS": 1, r"ARTICULO 16|ART\. 16": 0.5},
    "cae_documentacion": {r"COORDINACION DE ACTIVIDADES EMPRESARIALES": 4, r"(?:REAL DECRETO|R\.?D\.?) 171/2004": 2, r"CONCURRENCIA": 1, r"EMPRESA(?:RIO)? (?:TITULAR|PRINCIPAL)": 1, r"\bCAE\b": 0.5},
    "contrato_laboral": {r"CONTRATO DE TRABAJO": 4, r"PERSONA TRABAJADORA|\bTRABAJADOR": 1, r"CUENTA DE COTIZACION": 1, r"CLAUSULAS": 1, r"ESTATUTO DE LOS TRABAJADORES": 1, r"\bJORNADA\b": 0.5, r"INDEFINID|DURACION DETERMINADA|TEMPORAL": 0.5},
    "reconocimiento_medico": {r"RECONOCIMIENTO MEDICO": 3, r"VIGILANCIA DE LA SALUD": 2, r"\bAPTITUD\b": 2, r"CERTIFICADO DE APTITUD": 2, r"MEDIC[OA] DEL TRABAJO|MEDICINA DEL TRABAJO": 1.5, r"\bAPTO\b": 1.5, r"ARTICULO 22|ART\. 22": 1},
    "informacion_art18": {r"ARTICULO 18|ART\.? 18": 3, r"\bINFORMACION\b": 1, r"RIESGOS (?:DEL|DE SU) PUESTO": 1.5, r"MEDIDAS (?:DE PROTECCION|PREVENTIVAS)": 0.5, r"\bRECIBI\b|HE RECIBIDO": 1, r"EMERGENCIA": 0.5},
    "formacion_art19": {r"ARTICULO 19|ART\.? 19": 3, r"\bFORMACION\b": 1.5, r"\bHORAS\b": 0.5, r"CONTENIDO|TEMARIO": 0.5, r"ASISTENCIA|APROVECHAMIENTO": 0.5, r"\bRECIBI\b|HE RECIBIDO": 0.5},
    "entrega_epis": {r"EQUIPOS? DE PROTECCION INDIVIDUAL": 3, r"\bEPIS?\b": 2, r"\bENTREGA": 1.5, r"(?:REAL DECRETO|R\.?D\.?) 773/1997": 1.5, r"\bTALLA\b|\bMARCA\b|\bMODELO\b": 0.5, r"\bRECIBI\b": 1},
}


def _needs(tree) -> list[str] | None:
    """Literals of which a text that matches holds at least one; None if there are none to go by."""
    best: list[str] | None = None
    run = ""
    for op, arg in [*tree, (None, None)]:
        if op is _sre.LITERAL:
            run += chr(arg)
            continue
        if len(run) > 2 and (best is None or len(run) > min(map(len, best))):
            best = [run]
        run = ""
        if op is _sre.BRANCH:
            options = [_needs(x) for x in arg[1]]
            if best is None and all(options):
                best = [x for o in options for x in o]
        elif op is _sre.SUBPATTERN and best is None:
            best = _needs(arg[-1])
    return best


#: Signs of a word that lead to patterns, and lists of the index; words that are shorter lead by fewer signs.
GRAMS, LISTS = (4, 3), 1024


def _tree(grams: list[str]) -> str:
    """A regular expression of the grams by their first signs; where one begins another, the longer is taken."""
    heads: dict[str, list[str]] = {}
    for g in sorted(grams):
        heads.setdefault(g[0], []).append(g[1:])
    tails = {h: [t for t in rest if t] for h, rest in heads.items()}
    return "|".join(re.escape(h) + (f"(?:{_tree(t)})" + ("?" if "" in heads[h] else "") if t else "") for h, t in tails.items())


def _gram(literal: str, taken: dict[str, list[int]]) -> str | None:
    """Signs in a row that every text with the literal has in one of its words: of those as long as can be, one that fewest patterns have."""
    for n in GRAMS:
        some = [w[i : i + n] for w in literal.split() for i in range(len(w) - n + 1)]
        if some:
            return min(some, key=lambda g: len(taken.get(g, ())))
    return None


@dataclass(frozen=True)
class Index:
    """Patterns of types by what a text needs to match them, as an inverted list; it is a constant of the plan."""

    kinds: list[str]
    patterns: list[str]
    tree: str
    lists: list[list[dict]]
    open: list[int]
    points: list[list[dict]]

    @classmethod
    def of(cls, keys: dict[str, dict[str, float]]) -> Index:
        patterns = list(dict.fromkeys(p for table in keys.values() for p in table))
        grams: dict[str, list[int]] = {}
        free = []
        for i, p in enumerate(patterns):
            own = [_gram(x, grams) for x in _needs(_parse(p)) or [""]]
            if not all(own):
                free.append(i)
                continue
            for g in dict.fromkeys(own):
                grams.setdefault(g, []).append(i)
        lists: list[list[dict]] = [[] for _ in range(LISTS)]
        for g, of in grams.items():
            # where a shorter gram begins this one, only this one is found
            begun = [i for n in GRAMS if n < len(g) for i in grams.get(g[:n], ())]
            lists[zlib.crc32(g.encode()) % LISTS].append({"gram": g, "of": list(dict.fromkeys([*of, *begun]))})
        place = {p: i for i, p in enumerate(patterns)}
        points: list[list[dict]] = [[] for _ in patterns]
        for k, table in enumerate(keys.values()):
            for p, w in table.items():
                points[place[p]].append({"kind": k, "points": float(w)})
        return cls(list(keys), patterns, _tree(list(grams)), lists, free, points)

    def hits(self, text: Column) -> Column:
        """The patterns that occur, by their numbers. Grams of the text lead to those that may, and only these are looked for."""
        patterns, open_ = _constant(self.patterns, "array<string>"), _constant(self.open, "array<int>")
        if not self.tree:
            return F.filter(open_, lambda p: F.regexp_like(text, F.get(patterns, p)))
        lists = _constant(self.lists, "array<array<struct<gram:string,of:array<int>>>>")
        held = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({self.tree}))"), F.lit(1)))
        led = lambda g: F.flatten(F.transform(F.filter(F.get(lists, (F.crc32(g.cast("binary")) % LISTS).cast("int")), lambda x: x["gram"] == g), lambda x: x["of"]))
        may = F.array_distinct(F.concat(open_, F.flatten(F.transform(held, led))))
        return F.filter(may, lambda p: F.regexp_like(text, F.get(patterns, p)))


def _constant(value: list, kind: str) -> Column:
    """A value as one constant, however large; the optimiser reads it once."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def scores(text: Column, keys: dict[str, dict[str, float]] = KEYS) -> Column:
    """array<struct<kind, points>> of the types with points, in registry order; a pattern counts once however often it occurs.

    What a text costs depends on its signs and on the patterns that occur, not on how many types there are.
    """
    index = Index.of(keys)
    kinds, points = _constant(index.kinds, "array<string>"), _constant(index.points, "array<array<struct<kind:int,points:double>>>")
    all_ = F.flatten(F.transform(index.hits(text), lambda p: F.get(points, p)))

    def summed(a: Column) -> Column:
        total = lambda k: F.aggregate(F.filter(a, lambda x: x["kind"] == k), F.lit(0.0), lambda s, x: s + x["points"])
        return F.transform(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["kind"]))), lambda k: F.struct(F.get(kinds, k).alias("kind"), F.bround(total(k), 2).alias("points")))

    return let(all_, summed)


def ranked(scored: Column) -> Column:
    """Best first; ties keep registry order."""
    order = F.array_sort(F.transform(scored, lambda s, i: F.struct((-s["points"]).alias("p"), i.alias("i"), s.alias("s"))))
    return F.transform(order, lambda x: x["s"])


def classify(order: Column, wanted: Column | None = None) -> Column:
    """(kind, confidence, candidates, agrees) of a ranked array: null under LEAST points."""
    p1, p2 = F.get(order, F.lit(0))["points"], F.coalesce(F.get(order, F.lit(1))["points"], F.lit(0.0))
    kind = F.when(p1 >= LEAST, F.get(order, F.lit(0))["kind"])
    fields = [
        kind.alias("kind"), F.when(p1 >= LEAST, F.bround(p1 / (p1 + p2 + 1), 2)).otherwise(F.lit(0.0)).alias("confidence"),
        F.filter(F.slice(order, 1, 3), lambda s: s["points"] > 0).alias("candidates"),
    ]
    if wanted is not None:
        own = F.coalesce(F.get(F.filter(order, lambda s: s["kind"] == wanted), F.lit(0))["points"], F.lit(0.0))
        fields.append(((own >= LEAST) & (own >= SHARE * p1)).alias("agrees"))
    return F.struct(*fields)


def status(agrees: Column, kind: Column, wanted: Column, has_mandatory: Column, missing: Column, quality: Column) -> Column:
    """OTRO_DOCUMENTO, COMPLETA, ILEGIBLE or INCOMPLETA, in this order of tests."""
    other = ~agrees & kind.isNotNull() & (kind != wanted)
    return F.when(F.coalesce(other, F.lit(False)), "OTRO_DOCUMENTO").when((agrees | has_mandatory) & (missing == 0), "COMPLETA").when(quality != "apta", "ILEGIBLE").otherwise("INCOMPLETA")
