"""What is read for each document type: fixed patterns, kinds of rules, and the table that joins them.

``extract`` evaluates the table. A rule never guesses: where it finds nothing it gives null.
"""

from __future__ import annotations

from dataclasses import dataclass

from .lookup import NAME, NUM, TITLE

# All patterns by which fields are found, in the order of the types. They are
# matched against rows in upper case without accents.
ADDRESS = r"(?:\bD\.?\s*/\s*D(?:Ñ|N)?A?\.?|\bD\.?\s*/\s*Dª\.?|\bDON(?:A|ÑA)?\b|\bDOÑA\b|\bD(?:Ñ|N)A\.|\bD\.)"
AFTER_NAME = (
    r"(?=\s*,?\s*(?:CON\b|PROVIST|TITULAR|MAYOR\b|NACID|DE\s+NACIONALIDAD|CUYO|N\.?I\.?F|D\.?N\.?I|N\.?I\.?E|HA\s|QUE\s|EN\s+CALIDAD|"
    r"[^A-ZÑ]*(?:\b[A-ZÑ]\b[^A-ZÑ]*)*$))"
)
PERSON = rf"({ADDRESS})\s*{NAME}{AFTER_NAME}"
PERSON_LABELS = r"^(?:NOMBRE\s+Y\s+APELLIDOS|APELLIDOS\s+Y\s+NOMBRE|APELLIDOS,\s*NOMBRE|TITULAR|ALUMNO/?A?|TRABAJADOR/?A?|PERSONA\s+TRABAJADORA|INTERESADO/?A?)\b\s*:?"
ID_LABEL = r"(?:N\.?\s?I\.?\s?F\.?|D\.?\s?N\.?\s?I\.?|N\.?\s?I\.?\s?E\.?|DOCUMENTO\s+NACIONAL\s+DE\s+IDENTIDAD)"
PERSON_ID_LABEL = rf"\b{ID_LABEL}(?:\s*/\s*N\.?I\.?E\.?)?\s*:?"
PERSON_ID_VALUE = r"([XYZ]?[0-9][0-9.\s\-]{6,11}[0-9A-Z])"
ID_NEAR_NAME = rf"(?s){ADDRESS}\s*{NAME}{AFTER_NAME}.{{0,160}}?{ID_LABEL}[^A-Z0-9]{{0,12}}([XYZ0-9][0-9.\s\-]{{6,12}}[A-Z])"
MISSPELT_ID = ID_LABEL + r"[^A-Z0-9]{0,12}((?:[XYZ]\d{7}|\d{8})[A-Z])\b"
COMPANY_ID_LABEL = r"\b(?:C\.?\s?I\.?\s?F\.?|N\.?\s?I\.?\s?F\.?)(?:\s*/\s*N\.?I\.?F\.?)?(?:\s*/\s*N\.?I\.?E\.?)?(?:\s+(?:DE\s+LA\s+EMPRESA|EMPRESA))?\s*:?"
ID_VALUE = r"([A-Z]?[0-9][0-9.\s\-]{6,10}[0-9A-Z])"
COMPANY_LABEL = r"\b(?:RAZON\s+SOCIAL|NOMBRE\s+O\s+RAZON\s+SOCIAL(?:\s+DE\s+LA\s+EMPRESA)?|DENOMINACION(?:\s+SOCIAL)?|EMPRESA|TOMADOR(?:\s+DEL\s+SEGURO)?|APELLIDOS\s+Y\s+NOMBRE\s+O\s+RAZON\s+SOCIAL)\b\s*:?"
COMPANY = r"([A-Z0-9Ñ][A-Z0-9Ñ&.,'\- ]{2,70}?\b(?:S\.?\s?L\.?\s?U?\.?|S\.?\s?A\.?\s?U?\.?|S\.?\s?COOP\.?|S\.?\s?L\.?\s?L\.?|C\.?\s?B\.?)(?=[\s,.;]|$))"
DAY = r"(?:\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}|\d{1,2}\s+DE\s+[A-Z]+\s+DE\s+\d{4})"
TITLE_END = r"\s(?:POR\s+LA|POR\s+EL|CON\s+CARACTER|CON\s+VALIDEZ|EXPIDE|QUE\s+LE|EN\s+EL\s+CENTRO)\b.*$"
DURATION = r"DURACION(?:\s+TOTAL)?\s+DE\s+(\d{2,3})(?:[,.]0+)?\s*HORAS"
COURSE_HOURS = r"CURSO\s+DE\s+(\d{2,3})\s*H(?:ORAS)?\b"
BASIC_HOURS = (r"\b(\d{2,3})\s*H(?:ORAS)?\.?\s+(?:DE\s+)?NIVEL\s+BASICO", r"NIVEL\s+BASICO[^\n]{0,60}?\b(\d{2,3})\s*HORAS")
ANY_HOURS = r"\b(\d{2,3})(?:[,.]0+)?\s*HORAS\b"
STUDENT_NUMBER = rf"{NUM}\s*(?:DE\s+)?REGISTRO\s*:?\s*(\d{{3,}}(?:\s*/\s*\d{{3,}}){{1,3}})"
COURSE_NUMBER = rf"{NUM}\s*DE\s+CURSO\s*:?\s*(\d{{6,}})\s?([A-Z]{{2,4}})?\b"
GIVEN_BY = r"POR\s+PARTE\s+DE\s+([A-Z0-9Ñ][A-Z0-9Ñ.,&\-\s]{2,60}?)\s*,?\s*LA\s+(?:JORNADA|ACCION|ACTIVIDAD)"
ORGANISED_BY = r"(?:IMPARTIDO|ORGANIZADO)\s+POR\s+([A-Z0-9Ñ][A-Z0-9Ñ.,&\-\s]{2,60}?)\s*(?:,|\.|\bCON\b|\bEN\b|$)"
SCHOOL_LABEL = r"^(?:ENTIDAD\s+(?:FORMADORA|IMPARTIDORA|ORGANIZADORA)|CENTRO\s+FORMADOR|IMPARTIDO\s+POR)\b\s*:?"
SCHOOL_LABEL_SHORT = r"^(?:ENTIDAD\s+(?:FORMADORA|IMPARTIDORA|ORGANIZADORA)|CENTRO\s+FORMADOR)\b\s*:?"
CONSTRUCTION = r"FUNDACION LABORAL|CONVENIO[A-Z ]{0,30}CONSTRUCCION"
HIGHER_TECHNICIAN = rf"\b(TECNICO SUPERIOR EN{TITLE})"
REGIONS = (
    "ANDALUCIA", "ARAGON", "ASTURIAS", "ILLES BALEARS", "ISLAS BALEARES", "CANARIAS", "CANTABRIA", "CASTILLA-LA MANCHA", "CASTILLA - LA MANCHA", "CASTILLA LA MANCHA", "CASTILLA Y LEON", "CATALUNYA", "CATALUÑA",
    "COMUNITAT VALENCIANA", "COMUNIDAD VALENCIANA", "EXTREMADURA", "GALICIA", "COMUNIDAD DE MADRID", "REGION DE MURCIA", "NAVARRA", "PAIS VASCO", "EUSKADI", "LA RIOJA", "CEUTA", "MELILLA",
)
ANY_REGISTER = r"REGISTRO\s+(?:AUTONOMICO|NACIONAL|NAL\.?)\s+DE\s+TITUL(?:OS|ADOS)"
NATIONAL_REGISTER = r"REGISTRO\s+(?:NACIONAL|NAL\.?)\s+DE\s+TITUL(?:OS|ADOS)"
LONG_NUMBER, REGION_NUMBER, YEAR_NUMBER = r"\b(\d{8,14})\b", r"\b([A-Z]{2}-[A-Z]-\d{5,8})\b", r"\b((?:19|20)\d{2}/\d{5,7})\b"
MASTER = rf"\b(MASTER(?: UNIVERSITARIO)? EN{TITLE})"
UNIVERSITY = (
    r"POR\s+LA\s+(UNIVERSI(?:DAD|TAT)\s+[A-ZÑ .'\-]{3,80}?)(?=\s*(?:,|\.|\n|\s+Y\s|\s+EXPIDE|\s+CON\s|$))",
    r"\b(UNIVERSI(?:DAD|TAT)\s+(?:DE\s+|DEL\s+|POLITECNICA\s+|NACIONAL\s+|COMPLUTENSE\s+|AUTONOMA\s+)[A-ZÑ .'\-]{2,70}?)(?=\s*(?:,|\.|\n|$))",
)
OWN_DEGREE = r"TITULO\s+PROPIO|ESTUDIOS?\s+PROPIOS?|TITULACION\s+PROPIA"
FULL_MASTER, ANY_MASTER = r"MASTER\s+UNIVERSITARIO", r"\bMASTER\b"
OFFICIAL_MASTER = r"REGISTRO\s+NACIONAL\s+DE\s+TITULADOS|TITULO\s+OFICIAL|VALIDEZ\s+EN\s+TODO\s+EL\s+TERRITORIO|REY\s+DE\s+ESPAÑA"
OFFICIAL_DEGREE = r"REGISTRO\s+NACIONAL\s+DE\s+TITUL|TITULO\s+(?:UNIVERSITARIO\s+)?OFICIAL|VALIDEZ\s+EN\s+TODO\s+EL\s+TERRITORIO|REY\s+DE\s+ESPAÑA"
DEGREE = (
    rf"\b((?:GRADUAD[OA]|GRADO|MASTER\s+UNIVERSITARIO|LICENCIAD[OA]|DIPLOMAD[OA])\s+EN{TITLE}|(?:INGENIER[OA]|ARQUITECT[OA])(?:\s+TECNIC[OA])?(?:\s+INDUSTRIAL)?(?:\s+(?:EN|DE){TITLE})?|APAREJADOR)"
)
BUILDING_ENGINEER = r"ARQUITECTURA\s+TECNICA|ARQUITECT[OA]\s+TECNIC[OA]|APAREJADOR|(?:INGENIERIA|INGENIER[OA])\s+(?:DE\s+|EN\s+)?(?:LA\s+)?EDIFICACION"
INDUSTRIAL = r"INDUSTRIAL|MECANICA|ELECTRICA|ELECTRONICA\s+INDUSTRIAL|QUIMICA\s+INDUSTRIAL|ORGANIZACION\s+INDUSTRIAL|TECNOLOGIAS?\s+INDUSTRIALES|DISEÑO\s+INDUSTRIAL"
COORDINATOR_COURSE = r"COORDINA(?:DOR(?:A|ES)?|CION)\s+(?:EN\s+MATERIA\s+)?DE\s+SEGURIDAD\s+Y\s+SALUD"
ISSUE_DATE = r"\b(?:FECHA\s+DE\s+(?:EMISION|EXPEDICION)|EXPEDID[OA]|EMITID[OA])\b"
CLEAR = r"\b(NO\s+)?(?:ESTA|SE\s+ENCUENTRA|FIGURA)\s+AL\s+CORRIENTE"
DEBT = r"\bTIENE\s+(?:DEUDAS|DEUDA)\s+PENDIENTE|\bNO\s+ESTA\s+AL\s+CORRIENTE"
POLICY_HOLDER = r"(?<![A-Z])[TF]OMADOR"
POLICY_HOLDER_LABEL = rf"{POLICY_HOLDER}(?:\s+DEL\s+SEGURO|\s+DE\s+LA\s+POLIZA)?\b\s*:?"
POLICY_HOLDER_IN_LETTER = rf"{POLICY_HOLDER}\s+ES\s+(?:EL\s+|LA\s+|D\.?\s+|DONA?\s+)?([A-Z0-9Ñ][^:;]{{2,90}}?)\s*,?\s+CON\s+(?:C\.?I\.?F|N\.?I\.?F|DNI)\b"
INSURER_LABEL = r"\bENTIDAD\s+ASEGURADORA\b\s*:?|\b(?:ASEGURADORA?|COMPA[NÑ]IA(?:\s+ASEGURADORA)?)\s*:|^\W*(?:ASEGURADORA?|COMPA[NÑ]IA(?:\s+ASEGURADORA)?)\W*$"
INSURER = (
    r"(?:^|[.;:]\s)([A-Z][A-Z0-9Ñ .&\-]{1,50}?,?\s*S\.?\s?A\.?)\s+DE\s+SEGUROS\b",
    r"\b([A-Z][A-Z ]{2,40}\s+SEGUROS(?:\s+Y\s+REASEGUROS)?(?:\s*,?\s*S\.?A\.?)?|SEGUROS\s+[A-Z][A-Z ]{2,40})\b",
)
NO_INSURER = r"^(?:(?:DE|Y|LA|EL|COMPANIA|COMPAÑIA)\s+)*SEGUROS(?:\s+Y\s+REASEGUROS)?$"
POLICY_LABEL = rf"(?:{NUM}\s*(?:DE\s+)?POLIZA|\bPOLIZA\s+{NUM})\s*:?"
POLICY_VALUE = r"\b((?=[A-Z0-9/\-.]*\d)[A-Z0-9][A-Z0-9/\-.]{4,}[0-9A-Z])\b"
PERIOD = rf"DESDE[^\n]{{0,40}}?({DAY})[^\n]{{0,40}}?HASTA[^\n]{{0,40}}?({DAY})"
BEGINS = r"\b(?:FECHA\s+DE\s+EFECTO|EFECTO|INICIO\s+DE\s+(?:LA\s+)?VIGENCIA|FECHA\s+DE\s+INICIO|ENTRADA\s+EN\s+VIGOR)\b"
ENDS = r"\b(?:FECHA\s+DE\s+VENCIMIENTO|VENCIMIENTO|FIN\s+DE\s+(?:LA\s+)?VIGENCIA|FECHA\s+DE\s+FIN)\b"
LIMIT = r"\bLIMITE\b[^\n]{0,30}(?:SINIESTRO|INDEMNIZACION)|SUMA\s+ASEGURADA|LIMITE\s+MAXIMO"
APPLICANT = r"DATOS\s+DE(?:L|\s+LA)\s+SOLICI(?:TUD|TANTE)|FECHA\s+DE\s+LA\s+SOLICITUD|EN\s+REPRESENTACION\s+DE"
REGISTERED = r"\bCERTIFICA\b|CUYOS\s+DATOS|FIGURA\s+INSCRITA"
FIRM_LABEL = r"\b(?:(?:NOMBRE\s+O\s+)?RAZON\s+SOCIAL|DENOMINACION(?:\s+SOCIAL)?)\b\s*:?"
REGISTERED_ON = r"FECHA\s+DE\s+INSCRIPCION|\bDESDE\s+EL\b"
REGISTER_LABEL = rf"(?:{NUM}\s*(?:DE\s+)?(?:INSCRIPCION|REGISTRO)(?:\s+REA)?|\bNUM\.?\s*REA)\b\s*:?"
REGISTER_VALUE = r"\b(\d{2}[/ ]\d{2}[/ ]\d{5,}|\d{6,})\b"
SITE_LABEL = r"\b(?:DOMICILIO\s+DEL\s+CENTRO(?:\s+DE\s+TRABAJO)?|DIRECCION\s+DE\s+LA\s+OBRA|EMPLAZAMIENTO(?:\s+DE\s+LA\s+OBRA)?|SITUACION\s+DE\s+LA\s+OBRA)\b\s*:?"
OPENS = r"\bFECHA\s+DE\s+(?:INICIO|COMIENZO|APERTURA)\b"
FIRM_PART = r"DATOS\s+DE\s+LA\s+EMPRESA|\bLA\s+EMPRESA\b"
WORKER_PART = r"DATOS\s+DE\s+LA\s+PERSONA\s+TRABAJADORA|DATOS\s+DEL\s+TRABAJADOR|DATOS\s+DE\s+LA\s+TRABAJADORA"
PARTS_END = r"DATOS\s+DE\s+LA\s+ASISTENCIA|DECLARAN|CLAUSULAS"
FIRM_ID_LABEL = r"^C\.?\s?I\.?\s?F\.?(?:\s*/\s*N\.?I\.?F\.?)?(?:\s*/\s*N\.?I\.?E\.?)?\s*:?"
WORKER_ID_LABEL = r"\bN\.?\s?I\.?\s?F\.?(?:\s*/\s*N\.?I\.?E\.?)?\s*:?"
WORKER_NAME_LABEL = r"^(?:D\.?\s*/\s*D(?:Ñ|N)?A?\.?|NOMBRE(?:\s+Y\s+APELLIDOS)?)\s*:?"
FIRM_NAME_LABEL = r"\bNOMBRE\s+O\s+RAZON\s+SOCIAL(?:\s+DE\s+LA\s+EMPRESA)?\b\s*:?"
STARTS = r"\b(?:INICIANDOSE\s+LA\s+RELACION\s+LABORAL\s+EN\s+FECHA|FECHA\s+DE\s+INICIO|FECHA\s+DE\s+ALTA|CON\s+EFECTOS?\s+(?:DESDE|DE)|A\s+PARTIR\s+DEL?\s+(?:DIA)?)"
CONTRACT = r"\bCONTRATO\s+DE\s+TRABAJO\s+(INDEFINIDO|TEMPORAL|DE\s+DURACION\s+DETERMINADA|FIJO[\s\-]DISCONTINUO|FORMATIVO|PARA\s+LA\s+FORMACION|EN\s+PRACTICAS|A\s+TIEMPO\s+PARCIAL)"
EXAMINED = r"\bFECHA\s+(?:DEL\s+)?(?:RECONOCIMIENTO|EXAMEN|REVISION)\b"
FITNESS_LABEL = r"\b(?:RESULTADO|CALIFICACION|DICTAMEN|CONCLUSION)(?:\s+DE\s+(?:LA\s+)?APTITUD)?\b\s*:?"
FITNESS = r"\b(NO\s+APTO|APTO\s+CON\s+(?:RESTRICCIONES|LIMITACIONES|ADAPTACIONES)|APTO|PENDIENTE\s+DE\s+CALIFICACION)\b"
RECEIVER_LABEL = r"(?:\bENTREGA\s+A|\bINFORMA\s+Y\s+ENTREGA\s+A|^TRABAJADOR/?A?|^PERSONA\s+QUE\s+SE\s+INCORPORA|^NOMBRE\s+Y\s+APELLIDOS|^APELLIDOS\s+Y\s+NOMBRE|^NOMBRE\s+DEL\s+TRABAJADOR)\b\s*:?"
SIGNED_ROW = r"(?:FIRMA|RECIBI)"
SHEET_DATE = r"\bFECHA\b(?!\s+(?:DE\s+)?(?:APROB|REVIS|VERSI|EDICI|NACIM|IMPRES|ACTUALIZ))\s*:?"


@dataclass(frozen=True)
class Said:
    """What the first of the patterns that occurs holds in its groups, put together and brought into a shape."""

    patterns: tuple[str, ...]
    groups: tuple[int, ...] = (1,)
    shape: str = "plain"


@dataclass(frozen=True)
class Beside:
    """The value beside a label, of a kind that is tested and read, in a part of the document."""

    label: str
    value: str | None = None
    kind: str = "text"
    part: str | None = None
    shape: str = "plain"


@dataclass(frozen=True)
class Behind:
    """A value within so many signs after a label."""

    label: str
    value: str
    window: int = 250


@dataclass(frozen=True)
class Dated:
    """The first date at a label, in its row or in the next ones."""

    label: str
    rows: int


@dataclass(frozen=True)
class OneOf:
    """The first of the names that the document says."""

    names: tuple[str, ...]


@dataclass(frozen=True)
class Whole:
    """A reading of the whole document, by name; with a label, of its part or of what the label stands for."""

    name: str
    label: str | None = None


@dataclass(frozen=True)
class Told:
    """The value of the first row of the table whose conditions hold: patterns that are said, and with ``!`` ones that are not."""

    table: tuple[tuple[tuple[str, ...], str], ...]


@dataclass(frozen=True)
class First:
    """The first rule that gives a value."""

    rules: tuple


@dataclass(frozen=True)
class If:
    """A rule that counts only under a condition, by name or a pattern, else another."""

    test: str
    rule: object
    other: object = None


@dataclass(frozen=True)
class Of:
    """A value computed from fields that are read."""

    name: str


_PERSON_FIELDS = {"titular": Whole("holder"), "tratamiento": Whole("honorific"), "nif": Whole("person_id"), "fecha": Whole("document_date")}
_UNIVERSITY = Said(UNIVERSITY, shape="line")
_REGISTERED_DEGREE = Behind(NATIONAL_REGISTER, YEAR_NUMBER, 400)
_CERTIFICATE = {
    "razon_social": Whole("company_name", COMPANY_LABEL),
    "identificador": Whole("company_id"),
    "fecha_emision": First((Dated(ISSUE_DATE, 2), Whole("document_date"))),
    "al_corriente": First((Whole("stated", CLEAR), Told((((DEBT,), "false"),)))),
    "codigo_verificacion": Whole("verification_code"),
    "caduca": Of("expiry"),
    "validez_meses": Of("months"),
}
_FREE = {"razon_social": Whole("company_name", COMPANY_LABEL), "identificador": Whole("company_id"), "fecha": Whole("document_date")}
_SHEET = {
    "nif_trabajador": Whole("person_id"),
    "nombre_trabajador": First((Beside(RECEIVER_LABEL, NAME, "name"), Whole("only_holder"))),
    "fecha": First((Whole("row_date", SIGNED_ROW), Dated(SHEET_DATE, 1), Whole("document_date"))),
    "firmado": Whole("signed"),
}

#: Fields of each type with their rules, in registry order, and those that are mandatory.
RULES: dict[str, tuple[dict[str, object], tuple[str, ...]]] = {
    "flc_60h": (
        _PERSON_FIELDS | {
            "horas": Said((DURATION, COURSE_HOURS, *BASIC_HOURS)),
            "numero_registro": Said((STUDENT_NUMBER,), shape="tight"),
            "numero_curso": Said((COURSE_NUMBER,), groups=(1, 2)),
            "entidad": First((Said((GIVEN_BY,), shape="party"), Beside(SCHOOL_LABEL))),
        },
        ("titular", "nif", "horas", "fecha"),
    ),
    "ts_riesgos": (
        _PERSON_FIELDS | {"titulo": Said((HIGHER_TECHNICIAN,), shape="title"), "comunidad_autonoma": OneOf(REGIONS), "numero_registro": First((Behind(ANY_REGISTER, LONG_NUMBER), Said((REGION_NUMBER,))))},
        ("titular", "nif", "titulo", "fecha"),
    ),
    "ts_prl": (
        _PERSON_FIELDS | {
            "titulo": Said((MASTER,), shape="title"), "universidad": _UNIVERSITY,
            "titulo_oficial": Told((((OWN_DEGREE,), "false"), ((FULL_MASTER, OFFICIAL_MASTER), "true"), ((ANY_MASTER, "!" + FULL_MASTER), "false"))),
            "numero_registro": _REGISTERED_DEGREE,
        },
        ("titular", "titulo", "universidad", "fecha"),
    ),
    "titulo_tecnico": (
        _PERSON_FIELDS | {"titulo": Whole("degree", DEGREE), "profesion": Of("profession"), "universidad": _UNIVERSITY, "titulo_oficial": Told((((OWN_DEGREE,), "false"), ((OFFICIAL_DEGREE,), "true"))), "numero_registro": _REGISTERED_DEGREE},
        ("titular", "titulo", "profesion", "fecha"),
    ),
    "curso_coordinador_ss": (
        _PERSON_FIELDS | {"horas": Said((DURATION, COURSE_HOURS, ANY_HOURS)), "entidad": First((Said((ORGANISED_BY,), shape="party"), Beside(SCHOOL_LABEL_SHORT)))},
        ("titular", "horas", "fecha"),
    ),
    "certificado_tgss": (_CERTIFICATE, ("identificador", "fecha_emision", "al_corriente")),
    "certificado_aeat": (_CERTIFICATE, ("identificador", "fecha_emision", "al_corriente")),
    "seguro_rc": (
        {
            "tomador": If(POLICY_HOLDER, First((Said((POLICY_HOLDER_IN_LETTER,), shape="company"), Whole("company_name", POLICY_HOLDER_LABEL)))),
            "identificador": Whole("id_from", POLICY_HOLDER),
            "aseguradora": First((Beside(INSURER_LABEL, kind="no company id"), Said(INSURER, shape="insurer"))),
            "poliza": Beside(POLICY_LABEL, POLICY_VALUE),
            "vigencia_desde": First((Whole("period_start", PERIOD), Dated(BEGINS, 1))),
            "vigencia_hasta": First((Whole("period_end", PERIOD), Dated(ENDS, 1))),
            "limite_siniestro": Whole("largest_amount", LIMIT),
        },
        ("identificador", "poliza", "vigencia_desde", "vigencia_hasta"),
    ),
    "registro_empresa": (
        {
            "razon_social": If(APPLICANT, Whole("company_name in registered", FIRM_LABEL), Whole("company_name", FIRM_LABEL)),
            "identificador": If(APPLICANT, Whole("company_id in registered"), If("one id at most", Whole("company_id"))),
            "numero_inscripcion": Beside(REGISTER_LABEL, REGISTER_VALUE, shape="slashes"),
            "fecha": First((Dated(REGISTERED_ON, 2), If("!" + APPLICANT, Whole("document_date")))),
        },
        ("identificador", "numero_inscripcion"),
    ),
    "apertura_centro_trabajo": (
        {"razon_social": Whole("company_name", COMPANY_LABEL), "identificador": Whole("company_id"), "direccion_obra": Beside(SITE_LABEL), "fecha": First((Dated(OPENS, 1), Whole("document_date")))},
        ("identificador", "fecha"),
    ),
    "plan_seguridad_salud": (_FREE, ()),
    "evaluacion_riesgos": (_FREE, ()),
    "cae_documentacion": (_FREE, ()),
    "contrato_laboral": (
        {
            "identificador_empresa": Beside(FIRM_ID_LABEL, ID_VALUE, "any id", part="firm"),
            "razon_social": If("has firm", Whole("company_name", FIRM_NAME_LABEL)),
            "nif_trabajador": First((Beside(WORKER_ID_LABEL, ID_VALUE, "person id", part="worker"), If("no parts", Whole("person_id")))),
            "nombre_trabajador": First((Beside(WORKER_NAME_LABEL, NAME, "any name", part="worker"), If("no parts", Whole("holder")))),
            "fecha_inicio": Dated(STARTS, 1),
            "tipo_contrato": Said((CONTRACT,), shape="line"),
        },
        ("identificador_empresa", "nif_trabajador", "fecha_inicio", "tipo_contrato"),
    ),
    "reconocimiento_medico": (
        {"nif": Whole("person_id"), "fecha": First((Dated(EXAMINED, 1), Whole("document_date"))), "apto": First((Beside(FITNESS_LABEL, FITNESS, shape="line"), Whole("only_option", FITNESS)))},
        ("nif", "fecha", "apto"),
    ),
    "informacion_art18": (_SHEET, ("fecha", "firmado")),
    "formacion_art19": (_SHEET, ("fecha", "firmado")),
    "entrega_epis": (_SHEET, ("fecha", "firmado")),
}

#: Of these fields one is enough, and the first is named where both are missing.
EITHER = {k: ("nif_trabajador", "nombre_trabajador") for k in ("informacion_art18", "formacion_art19", "entrega_epis")}

#: Three-valued checks of each type: a test by name with its arguments.
_COMMON = (("titular_tras_don_dona", "addressed"), ("fecha_no_futura", "past", "fecha"))
_OFFICIAL = ("titulo_oficial", "true", "titulo_oficial")
CHECKS: dict[str, tuple[tuple, ...]] = {
    "flc_60h": (*_COMMON, ("nif_letra_valida", "id_letter"), ("horas_minimo_60", "at_least", "horas", 60), ("menciona_convenio_construccion", "says", CONSTRUCTION)),
    "ts_riesgos": (*_COMMON, ("nif_letra_valida", "id_letter"), ("titulo_prevencion_riesgos", "holds", "titulo", "TECNICO SUPERIOR", "PREVENCION", "RIESGOS")),
    "ts_prl": (*_COMMON, ("titulo_prevencion_riesgos_laborales", "holds", "titulo", "PREVENCION", "RIESGOS", "LABORALES"), _OFFICIAL),
    "titulo_tecnico": (*_COMMON, ("habilita_coordinador_seguridad_salud", "one_of", "profesion", "arquitecto", "arquitecto_tecnico", "ingeniero_industrial"), _OFFICIAL),
    "curso_coordinador_ss": (*_COMMON, ("nif_letra_valida", "id_letter"), ("curso_coordinador_seguridad_salud", "says", COORDINATOR_COURSE), ("horas_minimo_200", "at_least", "horas", 200)),
    "certificado_tgss": (("identificador_valido", "valid_id", "identificador"), ("vigente", "in_force", "fecha_emision", "caduca"), ("al_corriente", "true", "al_corriente")),
    "certificado_aeat": (("identificador_valido", "valid_id", "identificador"), ("vigente", "in_force", "fecha_emision", "caduca"), ("al_corriente", "true", "al_corriente")),
    "seguro_rc": (("identificador_valido", "valid_id", "identificador"), ("vigente", "in_force", "vigencia_desde", "vigencia_hasta"), ("fechas_coherentes", "before", "vigencia_desde", "vigencia_hasta")),
    "registro_empresa": (("identificador_valido", "valid_id", "identificador"),),
    "apertura_centro_trabajo": (("identificador_valido", "valid_id", "identificador"),),
    "plan_seguridad_salud": (),
    "evaluacion_riesgos": (),
    "cae_documentacion": (),
    "contrato_laboral": (("identificador_empresa_valido", "valid_id", "identificador_empresa"), ("nif_trabajador_valido", "read", "nif_trabajador")),
    "reconocimiento_medico": (("apto", "starts", "apto", "APTO"), ("fecha_no_futura", "past", "fecha")),
    "informacion_art18": (("firmado", "true", "firmado"),),
    "formacion_art19": (("firmado", "true", "firmado"),),
    "entrega_epis": (("firmado", "true", "firmado"),),
}
