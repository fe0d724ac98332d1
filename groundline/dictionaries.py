"""Word lists and lookup tables. A ``Dictionary`` bundles them so callers can swap any of them."""

from __future__ import annotations

from dataclasses import dataclass


# ---- Fixed values: Spanish stopwords (unaccented, as the search normaliser leaves them) ----
STOPWORDS = tuple(
    """
    de la que el en y a los del se las por un para
    con no una su al lo como mas pero sus le ya o
    este si porque esta entre cuando muy sin sobre tambien
    me hasta hay donde quien desde todo nos durante todos
    uno les ni contra otros ese eso ante ellos e esto
    mi antes algunos unos yo otro otras otra tanto
    esa estos mucho quienes nada muchos cual poco ella estar
    estas algunas algo nosotros mis tus cuales
    """.split()
)

# ---- Fixed values: canonical indicators and their aliases, in match order ----
INDICATORS = (
    ("ROE", ("roe", "retorno sobre patrimonio", "retorno sobre el patrimonio", "return on equity",
             "rentabilidad sobre el patrimonio")),
    ("ROA", ("roa", "retorno sobre activos", "retorno sobre los activos", "return on assets",
             "rentabilidad sobre activos")),
    ("ROIC", ("roic", "retorno sobre capital invertido", "retorno sobre el capital invertido")),
    ("deuda_ebitda", ("deuda ebitda", "deuda / ebitda", "deuda/ebitda", "deuda neta / ebitda",
                      "deuda neta/ebitda", "leverage", "ratio de apalancamiento",
                      "deuda financiera / ebitda")),
    ("EBITDA", ("ebitda", "ebitda ajustado", "ebitda consolidado", "ebitda acumulado")),
    ("utilidad_neta", ("utilidad neta", "ganancia neta", "resultado neto", "net income",
                       "utilidad del ejercicio", "beneficio neto")),
    ("utilidad_operativa", ("utilidad operativa", "resultado operativo", "ganancia operativa",
                            "operating income", "ebit")),
    ("apalancamiento", ("apalancamiento", "ratio de deuda", "endeudamiento", "cobertura de intereses",
                        "solvencia", "ratio de apalancamiento financiero")),
    ("liquidez", ("liquidez", "ratio corriente", "prueba acida", "capital de trabajo",
                  "liquidez corriente", "liquidez general")),
    ("flujo_caja", ("flujo de caja", "flujo de efectivo", "cash flow", "flujo libre de caja", "fcf",
                    "flujo operativo")),
    ("margen_bruto", ("margen bruto", "gross margin")),
    ("margen_operativo", ("margen operativo", "operating margin")),
    ("ventas", ("ventas", "ventas netas", "ingresos", "sales", "revenue", "ingresos totales",
                "ingresos de actividades ordinarias")),
    ("morosidad", ("morosidad", "cartera atrasada", "cartera pesada", "npl", "provisiones")),
    ("riesgos", ("riesgos", "riesgo de credito", "riesgo cambiario", "riesgo de tasa",
                 "riesgo de liquidez")),
)

# Aliases that are searchable but belong to no indicator.
UNASSIGNED_ALIASES = (
    "margen ebitda", "margen neto", "pobreza", "poverty", "macroeconomico", "macroeconomic", "gdp", "pbi",
)

# ---- Fixed values: broad question aspects ----
ASPECTS = (
    ("rentabilidad", "margen bruto, margen operativo, ROE, ROA y utilidad neta"),
    ("liquidez", "capital de trabajo, razon corriente y flujo de caja operativo"),
    ("solvencia", "deuda total, deuda neta sobre EBITDA y apalancamiento financiero"),
    ("ingresos", "ventas netas, ingresos por linea de negocio y volumen de operaciones"),
    ("calidad_activos", "morosidad, provisiones para colocaciones y ratio de cobertura"),
    ("eficiencia", "gastos de administracion, ratio de eficiencia y costo de ventas"),
    ("riesgos", "riesgo de tipo de cambio, tasa de interes y exposicion macroeconomica"),
    ("inversiones", "capex, adquisicion de activos fijos y proyectos de expansion"),
    ("pobreza", "poverty rate Gini index macroeconomic conditions GDP growth"),
    ("macroecon", "macroeconomic conditions GDP growth poverty reduction inflation"),
)

# ---- Fixed values: Spanish to English terms ----
CROSS_LINGUAL = (
    ("pobreza", "poverty"),
    ("macroeconómicos", "macroeconomic"),
    ("macroeconomicos", "macroeconomic"),
    ("crecimiento", "GDP growth"),
    ("inflación", "inflation"),
    ("inflacion", "inflation"),
    ("empleo", "employment"),
    ("desempleo", "unemployment"),
    ("inversión", "investment"),
    ("inversion", "investment"),
    ("banco mundial", "World Bank Macro Poverty Outlook"),
    ("proyecciones", "forward-looking future outlook projections"),
    ("proyeccion", "forward-looking future outlook projection"),
    ("proyecta", "projects"),
    ("proyecto", "project"),
    ("futuras", "future"),
    ("futura", "future"),
    ("futuro", "future"),
    ("perspectivas", "outlook forward-looking"),
)

# ---- Fixed values: issuers ----
# Words that name an issuer inside a question, in lookup order.
QUESTION_ISSUERS = (
    ("ferreycorp", ("ferreycorp", "ferreyros")),
    ("financieraefectiva", ("financiera", "efectiva")),
    ("worldbank", ("banco mundial", "world bank", "bancomundial", "worldbank")),
    ("microsoft", ("microsoft",)),
)
# Narrower words of the strict mode when a compound question is cut into segments.
STRICT_SEGMENT_WORDS = (
    ("ferreycorp", "ferreycorp"),
    ("financieraefectiva", "financiera"),
    ("worldbank", "banco mundial"),
)
# Fragments that map a written issuer name to its canonical key, first rule that hits wins.
ISSUER_NAME_RULES = (
    ("worldbank", ("worldbank", "bancomundial", "world", "bank")),
    ("financieraefectiva", ("financiera", "efectiva")),
    ("ferreycorp", ("ferreycorp", "ferreyros")),
)
# Names that identify an issuer inside an answer, with the name used in the corpus.
ANSWER_ISSUERS = (
    ("Ferreycorp", ("ferreycorp", "ferreyros")),
    ("Financiera Efectiva", ("financiera efectiva",)),
    ("Banco Mundial", ("banco mundial", "world bank", "worldbank")),
    ("Microsoft", ("microsoft", "msft")),
)
# Words that mark a figure as belonging to one business segment.
SEGMENT_QUALIFIERS = (
    "gran minería", "gran mineria", "segmento", "récord de ventas", "record de ventas",
    "línea de negocio", "linea de negocio",
)
# Conversational openings that carry no search terms.
SEGMENT_PREFIXES = (
    "comparando los reportes del corpus:",
    "comparando los reportes:",
    "segun los reportes del corpus:",
    "segun los documentos:",
)
# Words that only describe the document itself.
DOCUMENT_WORDS = (
    "annual", "report", "memoria", "informe", "ficha", "outlook", "macro", "poverty", "anual",
    "2024", "2025", "2026", "2023", "2022", "2021",
    "en", "de", "el", "la", "los", "las", "del", "y", "que", "cual", "cuales",
)
# Words that mark a table or heading line as a table of contents.
CONTENTS_MARKERS = (
    "contenido", "indice", "índice", "indices", "tabla de contenido", "table of contents", "contents",
)


@dataclass(frozen=True)
class Dictionary:
    """Language and domain data used by expansion, decomposition and attribution."""

    stopwords: tuple = STOPWORDS
    indicators: tuple = INDICATORS
    extra_aliases: tuple = UNASSIGNED_ALIASES
    aspects: tuple = ASPECTS
    cross_lingual: tuple = CROSS_LINGUAL
    question_issuers: tuple = QUESTION_ISSUERS
    strict_segment_words: tuple = STRICT_SEGMENT_WORDS
    issuer_name_rules: tuple = ISSUER_NAME_RULES
    answer_issuers: tuple = ANSWER_ISSUERS
    segment_qualifiers: tuple = SEGMENT_QUALIFIERS
    segment_prefixes: tuple = SEGMENT_PREFIXES
    document_words: tuple = DOCUMENT_WORDS
    contents_markers: tuple = CONTENTS_MARKERS

    def synonyms(self, canon: str) -> list[str]:
        """Aliases of a canonical indicator, compared without case."""
        for name, aliases in self.indicators:
            if name.lower() == canon.lower():
                return list(aliases)
        return []

    def all_aliases(self) -> list[str]:
        """Every searchable alias."""
        return [alias for _, aliases in self.indicators for alias in aliases] + list(self.extra_aliases)


DEFAULT_DICTIONARY = Dictionary()
