"""Scalar functions over text columns. All are built-in expressions; white
space is Unicode white space, and missing text is the empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetloom.functions import lexicons as lx

_WS = r"(?U)[\s\x1c-\x1f]"
_AROUND = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _AROUND, "")


def collapse(c: Column) -> Column:
    """White-space runs become one blank, none stays around the text."""
    return F.trim(F.regexp_replace(c, rf"{_WS}+", " "))


def count_tokens(c: Column) -> Column:
    """A token is four code points, rounded up; null and empty text have 0."""
    return F.floor((F.length(F.coalesce(c, F.lit(""))) + 3) / 4)


def truncate_to_tokens(c: Column, budget: int | Column, ellipsis: str = " …") -> Column:
    """c if it fits the budget; else cut between words so that it fits, with an
    ellipsis; nothing where not even that fits."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    room = budget * 4 - len(ellipsis)
    cut = F.substring(c, F.lit(1), room.cast("int"))
    whole_words = F.when(F.contains(cut, F.lit(" ")), F.regexp_extract(cut, r"(?s)^(.*) [^ ]*\z", 1)).otherwise(cut)
    return F.when((budget > 0) & (count_tokens(c) <= budget), c).when(room <= 0, "").otherwise(F.concat(whole_words, F.lit(ellipsis)))


def squash(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def contains(haystack: Column, needle: Column, strict: bool = False) -> Column:
    """Contained as it is or squashed. A needle without a-z and 0-9 squashes
    to nothing, which is always contained; strict asks for more."""
    loose = F.contains(squash(haystack), squash(needle))
    return F.contains(haystack, needle) | ((loose & (squash(needle) != "")) if strict else loose)


def norm_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def normalize_text(c: Column) -> Column:
    """Dashes become hyphens, white-space runs one blank."""
    return collapse(F.translate(c, "–−—", "---"))


def canonical_unit(c: Column) -> Column:
    """struct(verbatim, canonical, known): unknown spellings stay as they are."""
    key = strip(c)
    table = F.create_map(*[F.lit(x) for kv in lx.CANONICAL_UNITS.items() for x in kv])
    return F.struct(c.alias("verbatim"), F.coalesce(table[key], key).alias("canonical"), F.coalesce(F.map_contains_key(table, key), F.lit(False)).alias("known"))


def slugify(c: Column, max_len: int = 60) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(slug, 1, max_len), "-+$", "")


def section_stem(number: Column, title: Column) -> Column:
    """File stem of a section: its number (if it has one), then its title."""
    numbered = F.concat(F.replace(number, F.lit("."), F.lit("-")), F.lit("-"), title)
    return slugify(F.when(number != "", numbered).otherwise(title))


def split_number(c: Column) -> Column:
    """struct(number, title) of a heading such as ``4.5 Transmitter``."""
    text, pattern = strip(c), r"(?s)^(\d+(?:\.\d+)*)\s*[. ]?\s*(.*)$"
    numbered = text.rlike(r"^\d")
    return F.struct(
        F.when(numbered, F.regexp_extract(text, pattern, 1)).otherwise("").alias("number"),
        F.when(numbered, strip(F.regexp_extract(text, pattern, 2))).otherwise(text).alias("title"),
    )


def page_revision(c: Column) -> Column:
    """The last revision token of a page, else its first document id, else ''."""
    revisions = F.regexp_extract_all(c, F.lit(lx.REVISION), 1)
    found = F.concat(F.lit("Rev. "), F.element_at(revisions, -1))
    return F.when(F.size(revisions) > 0, found).otherwise(F.regexp_extract(c, lx.DOCUMENT_ID, 0))


def sniff_revision(pages: Column, max_pages: int = 3) -> Column:
    """The first page (of the first three) that says something decides."""
    found = F.filter(F.transform(F.slice(pages, 1, max_pages), page_revision), lambda x: x != "")
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def figure_number(c: Column) -> Column:
    return F.regexp_extract(c, "(?i)" + lx.FIGURE_NUMBER, 1)


def section_tags(title: Column) -> Column:
    """Path tags, then each frequency in MHz; whole ones without a fraction."""
    path = F.filter(F.array(*[F.when(title.rlike("(?i)" + p), F.lit(t)) for t, p in lx.SECTION_TAGS]), lambda x: x.isNotNull())
    lower = F.lower(title)
    numbers, units = (F.regexp_extract_all(lower, F.lit(lx.FREQUENCY), i) for i in (1, 2))

    def tag(pair: Column) -> Column:
        mhz = pair["n"].cast("double") * F.when(pair["u"] == "ghz", 1000.0).otherwise(1.0)
        return F.concat(F.when(mhz == F.floor(mhz), mhz.cast("long").cast("string")).otherwise(mhz.cast("string")), F.lit("mhz"))

    pairs = F.zip_with(numbers, units, lambda n, u: F.struct(n.alias("n"), u.alias("u")))
    return F.array_distinct(F.concat(path, F.transform(pairs, tag)))


def caption_tags(c: Column) -> Column:
    lower = F.lower(c)
    return F.filter(F.array(*[F.lit(k) for k in lx.MEASURE_KEYWORDS]), lambda k: F.contains(lower, k))


def parse_tablenote(c: Column) -> Column:
    """struct(marker, text) of a table note, null if it is none."""
    pattern = r"(?s)^\s*(\(\d+\)|[†‡*§#]+|\d+\))\s*(.*)$"
    text = strip(c)
    marker, body = F.regexp_extract(text, pattern, 1), collapse(F.regexp_extract(text, pattern, 2))
    return F.when((marker != "") & (body != ""), F.struct(marker.alias("marker"), body.alias("text")))


def first_sentence(paragraphs: Column, max_words: int = 28) -> Column:
    """The first sentence (of the first paragraph whose first sentence has at
    least four words), cut to max_words words."""
    def words(p: Column) -> Column:
        text = strip(F.regexp_replace(strip(p), "^[• ]+", ""))
        return F.filter(F.split(F.get(F.split(text, r"(?U)(?<=[.!?])\s+"), F.lit(0)), rf"{_WS}+"), lambda w: w != "")

    fitting = F.filter(F.transform(F.filter(paragraphs, lambda p: p.isNotNull()), words), lambda w: F.size(w) >= 4)
    return F.coalesce(F.array_join(F.slice(F.get(fitting, F.lit(0)), 1, max_words), " "), F.lit(""))


def value_field(value: Column, low: Column, typical: Column, high: Column) -> Column:
    parts = F.filter(F.array(low, typical, high), lambda x: x != "")
    return F.when(value != "", value).otherwise(F.array_join(parts, "/"))


def pages_label(start: Column, end: Column, prefix: str = "") -> Column:
    several = end.isNotNull() & (end != 0) & (end != start)
    one = F.concat(F.lit(prefix), start.cast("string"))
    return F.when(start.isNull(), "?").when(several, F.concat(one, F.lit("-"), end.cast("string"))).otherwise(one)


def cache_name(url: Column) -> Column:
    return F.concat(F.substring(F.sha1(url), 1, 16), F.lit(".html"))


def extension_of(url: Column) -> Column:
    """The extension of an image address if it is a known one, else .bin."""
    ext = F.lower(F.regexp_extract(F.regexp_extract(url, r"([^/]*)$", 1), r"[^.](\.[^./]+)$", 1))
    return F.when(ext.isin(lx.IMAGE_EXTENSIONS), ext).otherwise(".bin")


def binary_cache_name(url: Column) -> Column:
    return F.concat(F.substring(F.sha1(url), 1, 16), extension_of(url))


def image_variants(url: Column) -> Column:
    """Addresses to try for an image: itself, then its other qualities and
    types, without repeating it."""
    quality = F.lower(url).rlike(r"-(low|high)\.gif$")
    base = F.when(quality, F.regexp_replace(url, r"(?i)-(low|high)\.gif$", "")).otherwise(F.regexp_replace(url, r"\.[^.]+$", ""))
    others = F.transform(F.array(*[F.lit(s) for s in lx.IMAGE_SUFFIXES]), lambda s: F.concat(base, s))
    return F.concat(F.array(url), F.filter(others, lambda x: x != url))


def absolute_url(url: Column, host: str = lx.IMAGE_HOST) -> Column:
    return F.when(F.startswith(url, F.lit("/")), F.concat(F.lit(host.rstrip("/")), url)).otherwise(url)


def doc_dir_name(doc_type: Column, content_hash: Column) -> Column:
    return F.concat(doc_type, F.lit("-"), F.substring(content_hash, 1, 8))


def plot_file_path(number: Column, plot_id: Column, ext: Column) -> Column:
    stem = F.when(number != "", F.replace(number, F.lit("."), F.lit("-"))).otherwise("unsectioned")
    return F.concat(F.lit("figures/"), stem, F.lit("/"), plot_id, ext)


def spec_fields(*columns: Column) -> Column:
    return F.concat_ws(" ", *columns)


def detect_doc_type(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    out = None
    for kind, pattern in lx.DOC_TYPE_PATTERNS:
        out = (F if out is None else out).when(name.rlike(pattern), kind)
    return out.otherwise(lx.UNKNOWN_DOC_TYPE)


def is_boilerplate(line: Column) -> Column:
    text = strip(line)
    return text.rlike("|".join(f"(?:{p})" for p in lx.BOILERPLATE_PATTERNS))


def is_placed_furniture(text: Column, page: Column, x: Column, y: Column) -> Column:
    """Page machinery, and the page's own number in its gutters."""
    own = text.rlike(r"^\d+$") & (F.regexp_replace(text, "^0+", "") == page.cast("string")) & ((x < lx.GUTTER_LEFT) | (y > lx.GUTTER_BOTTOM))
    return text.rlike(lx.N_OF_M) | text.rlike(lx.PAGE_OF) | text.rlike(lx.BARE_REVISION) | own


def looks_like_conditions(text: Column) -> Column:
    lower = F.lower(text)
    out = F.lit(False)
    for hint in lx.CONDITION_HINTS:
        out = out | F.contains(lower, F.lit(hint))
    return out
