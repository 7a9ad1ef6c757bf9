"""Word lists, patterns and tables that results depend on."""

from __future__ import annotations

# Patterns of lines that are page furniture wherever they stand.
BOILERPLATE_PATTERNS = [
    r"^Product Folder Links?:.*$",
    r"^Submit Document Feedback.*$",
    r"^(?i:Copyright\s*©.*)$",
    r"^www\.ti\.com\s*$",
    r"^[A-Z][A-Z0-9]*\s+[–-]\s+[A-Z]+ \d{4}\s+[–-]\s+REVISED.*$",
    r"^PRODUCTION DATA\.?$",
]

# Furniture that is only recognised by its place on a page: "3 of 12", "Page 3 of 12", "Rev. B".
N_OF_M = r"(?i)^\s*(?:rev\.?\s+[a-z0-9][^|\n]*\s*[|·•]?\s*)?[-–—]?\s*\d+\s+of\s+\d+\s*[-–—]?\s*$"
PAGE_OF = r"(?i)^\s*(?:rev\.?\s+[a-z0-9]\s*[|·•]\s*)?page\s+\d+(?:\s+of\s+\d+)?\s*$"
BARE_REVISION = r"(?i)^\s*rev\.?\s*[.|×: ]*\s*[a-z0-9]\s*$"
# Geometry of recurring slots, in points and shares of pages.
SLOT_HEIGHT, SLOT_SHARE, SLOT_PAGES = 15.0, 0.4, 2
GUTTER_LEFT, GUTTER_BOTTOM = 80.0, 700.0

# Fixed value: a printed table-of-contents line with dot leaders.
DOT_LEADER = r"^\s*(?:(\d+(?:\.\d+)*)\s+)?(.+?)[\s .·•]*\.{2,}\s*(\d+)\s*$"

# Document types by file name, in order of priority.
DOC_TYPE_PATTERNS = [
    ("errata", r"errata"),
    ("register_map", r"register|regmap|reg[-_ ]?map|programming"),
    ("app_note", r"app[-_ ]?note|sbaa|slaa|swra|\bug[-_ ]?\d+"),
    ("datasheet", r"datasheet|data[-_ ]?sheet|^[a-z0-9]+\.pdf$"),
]
UNKNOWN_DOC_TYPE = "unknown"

# Vendors in order of detection, their brand marks and backends.
VENDOR_PROFILES = [
    ("ti", ["texas instruments"], ["ti_html", "pdf_layout"]),
    ("adi", ["analog devices"], ["pdf_layout"]),
    ("qorvo", ["qorvo"], ["pdf_layout"]),
    ("unknown", [], ["pdf_layout"]),
]
DEFAULT_VENDOR = "ti"
COMPANION_BACKEND = "pdf_text"

# Roles of table headers, in order of priority.
ROLE_PATTERNS = [
    ("conditions", r"^test conditions?(\s*/\s*comments?)?(\(\d+\))?$"),
    ("min", r"^(min|minimum)(\(\d+\))?$"),
    ("typ", r"^(typ|typical)(\(\d+\))?$"),
    ("typ", r"^(nom|nominal)(\(\d+\))?$"),
    ("max", r"^(max|maximum)(\(\d+\))?$"),
    ("unit", r"^unit(s)?(\(\d+\))?$"),
    ("value", r"^value(\s*/\s*range)?(\(\d+\))?$"),
    ("parameter", r"^parameter(\(\d+\))?$"),
    ("parameter", r"^thermal metric(\(\d+\))?$"),
    ("symbol", r"^part number(\(\d+\))?$"),
    ("value", r"^package size(\(\d+\))?$"),
    ("name", r"^package(\(\d+\))?$"),
]
NUMERIC_ROLES = ["min", "typ", "max", "value", "unit"]
VALUE_ROLES = ["min", "typ", "max", "value"]
LEADING_ROLES = ["symbol", "name", "conditions"]

# Canonical names of unit spellings.
CANONICAL_UNITS = {
    "Ω": "ohm", "Ω": "ohm", "ohm": "ohm", "dB": "dB", "dBm": "dBm", "dBc/Hz": "dBc/Hz", "dBFS": "dBFS", "deg": "deg",
    "V": "V", "mV": "mV", "mVpp": "mVpp", "Vppdiff": "Vppdiff", "A": "A", "mA": "mA", "µA": "µA", "°C": "°C", "°C/W": "°C/W",
    "Hz": "Hz", "kHz": "kHz", "MHz": "MHz", "GHz": "GHz", "SPS": "SPS", "MSPS": "MSPS", "GSPS": "GSPS", "bps": "bps", "Mbps": "Mbps", "Gbps": "Gbps",
    "s": "s", "ms": "ms", "ns": "ns", "ps": "ps", "UI": "UI", "F": "F", "pF": "pF", "W": "W", "mW": "mW", "bits": "bits",
}

# What a plot's caption may measure, and tags of section titles.
MEASURE_KEYWORDS = [
    "acpr", "nsd", "output power", "fullscale", "gain error", "phase error", "phase noise", "imd", "hd2", "hd3", "harmonic", "return loss", "s11",
    "nf", "noise figure", "image rejection", "spurious", "sfdr", "snr", "eye diagram", "jitter", "settling", "bandwidth", "flatness", "dsa",
]
SECTION_TAGS = [("tx", r"\btx\b"), ("rx", r"\brx\b"), ("fb", r"\bfb\b"), ("pll-clock", r"\bpll\b|\bclock\b")]
FREQUENCY = r"(\d+(?:\.\d+)?)\s*(mhz|ghz)"
FIGURE_NUMBER = r"Figure\s+(\d+(?:[-.]\d+)?[a-z]?)"

# Shapes of revisions and document ids.
REVISION = r"\bRev[.\s]*([A-Z][A-Z0-9]?|\d{1,3})"
DOCUMENT_ID = r"\bS[A-Z]{2}[A-Z0-9]*\d[A-Z0-9]*\b"

# Image files.
IMAGE_SUFFIXES = ["-high.gif", ".gif", ".png", ".jpg", ""]
IMAGE_EXTENSIONS = [".gif", ".png", ".jpg", ".jpeg", ".svg", ".bin"]
IMAGE_HOST = "https://www.ti.com"

# How an index is shortened until it fits (tokens of a description, with conventions, with key facts).
INDEX_LADDER = [(30, True, True), (20, True, True), (12, True, True), (6, True, True), (0, True, True), (0, False, True), (0, False, False)]
INDEX_TOKEN_BUDGET = 3000

# Phrases that mark a text block as test conditions.
CONDITION_HINTS = ["typical values", "unless otherwise noted", "over operating free-air", "over free-air temperature", "test conditions", "nominal power supplies"]
# Text blocks and classes of a viewer page that are no content, and the address of a section.
VIEWER_SKIP_TEXTS = ["request full data sheet"]
VIEWER_SKIP_CLASSES = ["section-label"]
VIEWER_SECTION_URL = r'/document-viewer/([^/]+)/datasheet/(GUID-[^#\s"]+)'

# Words that make the number before them a quantity.
UNIT_WORDS = {
    "ghz", "mhz", "khz", "hz", "dbm", "dbc", "db", "v", "mv", "kv", "uv", "a", "ma", "ua", "ohm", "ω", "kω", "mω", "w", "mw", "lsb", "bits", "s",
    "ms", "ns", "f", "pf", "uf", "rms", "dbfs", "sps", "msps", "gsps",
}
# Words that head the columns of parametric tables, without blanks and signs.
HEADER_TOKENS = {
    "min", "max", "typ", "tpy", "nom", "unit", "units", "value", "values", "valuerange", "parameter", "rating", "ratings", "testconditions",
    "testcondition", "thermal", "thermalmetric", "partno", "partnumber",
}
