"""Identifiers, word lists, patterns and formats the results depend on."""

BASE = "http://example.org"

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
RDFS_COMMENT = "http://www.w3.org/2000/01/rdf-schema#comment"
SKOS_PREF_LABEL = "http://www.w3.org/2004/02/skos/core#prefLabel"
SKOS_DEFINITION = "http://www.w3.org/2004/02/skos/core#definition"
SKOS_BROADER = "http://www.w3.org/2004/02/skos/core#broader"
DCTERMS_DESCRIPTION = "http://purl.org/dc/terms/description"
XSD = "http://www.w3.org/2001/XMLSchema#"
SOSA = "http://www.w3.org/ns/sosa/"
QUDT = "http://qudt.org/schema/qudt/"
QUANTITY_KIND = "http://qudt.org/vocab/quantitykind/"

# File extensions.
TABLE_EXTENSIONS = ["csv", "tsv"]
TEXT_EXTENSIONS = ["json", "txt", "md", "xml", "yaml", "yml"]

# Separators in order of preference.
SEPARATORS = ["\t", ";", ","]

# Cell texts that mean "no value" (the pandas.read_csv defaults).
NULL_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Date formats in order of preference, as (name, Java patterns).
DATE_FORMATS = [
    ("%Y-%m-%dT%H:%M:%S%z", ["yyyy-M-d'T'H:m:sXXX", "yyyy-M-d'T'H:m:sxx"]),
    ("%Y-%m-%d %H:%M:%S%z", ["yyyy-M-d H:m:sXXX", "yyyy-M-d H:m:sxx"]),
    ("%Y-%m-%dT%H:%M:%S", ["yyyy-M-d'T'H:m:s"]),
    ("%Y-%m-%d %H:%M:%S", ["yyyy-M-d H:m:s"]),
    ("%d.%m.%Y %H:%M:%S", ["d.M.yyyy H:m:s"]),
    ("%d/%m/%Y %H:%M:%S", ["d/M/yyyy H:m:s"]),
    ("%d.%m.%Y %H:%M", ["d.M.yyyy H:m"]),
    ("%d/%m/%Y %H:%M", ["d/M/yyyy H:m"]),
    ("%Y-%m-%d", ["yyyy-M-d"]),
]

# Corpora in the order in which candidates are listed; others follow by name.
CORPORA = ["qudt", "gemet"]

# Free day-first parsing has no Spark form; this ordered list stands in for it.
AMBIGUOUS = "AMBIGUOUS"
_FRACTION = "[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"
AMBIGUOUS_PATTERNS = [
    f"yyyy-M-d'T'H:m[:s{_FRACTION}]", f"yyyy-M-d H:m[:s{_FRACTION}]", f"yyyy/M/d[ H:m[:s{_FRACTION}]]",
    f"d.M.yyyy[ H:m[:s{_FRACTION}]]", f"d/M/yyyy[ H:m[:s{_FRACTION}]]", f"d-M-yyyy[ H:m[:s{_FRACTION}]]",
    f"d MMM yyyy[ H:m[:s{_FRACTION}]]", f"d MMMM yyyy[ H:m[:s{_FRACTION}]]", f"MMM d, yyyy[ H:m[:s{_FRACTION}]]", f"MMMM d, yyyy[ H:m[:s{_FRACTION}]]",
]

# Patterns of the profiler.
DATETIME_NAMES = r"(?iU)\b(time|datetime|timestamp|date|dato|tid)\b"
QUALITY_NAMES = r"(?iU)\b(flag|flags|quality|qc|valid|invalid|status|error)\b"
ISO_8601 = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})?$"
OFFSET_SUFFIX = r"[+-]\d{2}:?\d{2}$"
DURATION = r"^-?\d+\s+days?\b"
VOTE_DOT = r"^-?\d+(?:\.\d+)?([eE][+-]?\d+)?$"
VOTE_COMMA = r"^-?\d+(?:,\d+)?$"

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER = r"^[+-]?\d+$"
BOOLEAN = r"^(True|False|TRUE|FALSE|true|false)$"

# Roles and classes.
OBSERVABLE_ROLES = ["observable_property", "unknown"]
NUMERIC_DTYPES = ["float64", "float32", "int64", "int32"]
COLUMN_CLASSES = ["measurement", "derived", "diagnostic", "quality"]

# Unit spellings, keyed by the lower-cased folded spelling.
UNIT_ALIASES = {
    "l/s": "L/s", "lps": "L/s", "m3/s": "m3/s", "m^3/s": "m3/s", "m3/h": "m3/h", "m^3/h": "m3/h",
    "degc": "Cel", "deg c": "Cel", "celsius": "Cel", "us/cm": "uS/cm", "mg/l": "mg/L",
    "ug/l": "ug/L", "percent": "%", "pct": "%",
}

# One unit listed under two identifiers.
UNIT_EQUIVALENTS = {"unit:MicroS-PER-CentiM": "unit:MicroS-PER-CM"}

# Fixed values: (part of a URI, prefix of its short token); the first match wins.
TOKEN_FAMILIES = [
    ("quantitykind/", "qudt"), ("/vocab/unit/", "unit"), ("/concept/", "gemet"),
    ("gwsw.nl", "gwsw"), ("example.org/property/", "mint"),
]

# Abbreviations expanded in column names.
ABBREVIATIONS = {
    "cod": "chemical oxygen demand", "tss": "total suspended solids",
    "bod": "biochemical oxygen demand", "do": "dissolved oxygen", "tn": "total nitrogen",
    "tp": "total phosphorus", "nh4": "ammonium", "temp": "temperature", "cond": "conductivity",
    "turb": "turbidity", "precip": "precipitation", "vel": "velocity", "lvl": "level",
}

# Retrieval constants.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
RRF_OFFSET = 60
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
CLASS_THRESHOLD = 0.42
RECALL_DEPTHS = [1, 5, 10, 20, 30, 50]

# Evidence and metadata limits.
EVIDENCE_CHARS = 20000
TRUNCATED = "\n…[truncated]"
METADATA_LINE_CHARS = 160
METADATA_CHARS = 200
