"""SQL that reads and converts stated quantities, apart from the operators: the
oracle of p5_found. Its unit table is built from the fixed values."""

from __future__ import annotations

from sheetloom.functions.units import QUANTITY_LETTERS, QUANTITY_WORDS, unit_table

_NUMBER = r"[+\-−–]?(?:\d[\d,]*(?:\.\d+)?|\.\d+)(?:[eE][+\-−]?\d+)?"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spelling(c: str) -> str:
    """The form in which units are looked up."""
    for a, b in (("\u00b5", "\u03bc"), ("\u2126", "\u03a9"), ("\u2103", "\u00b0C"), ("\u2109", "\u00b0F"), ("\u212a", "K"), ("\u00ba", "\u00b0")):
        c = f"replace({c}, '{a}', '{b}')"
    return rf"rtrim(trim(regexp_replace({c}, '\s+', ' ', 'g')), '.')"


def _plain(c: str) -> str:
    return rf"regexp_replace(coalesce({c}, ''), '[\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]', ' ', 'g')"


def _word(quantity: str) -> str:
    return quantity[:-1] + "(?:y|ies)" if quantity.endswith("y") else quantity + "s?"


def stated_values_sql() -> str:
    """CTEs up to v(table_id, part_number, row, name, quantity, value)."""
    units = ", ".join(f"({_quoted(s)}, '{u.quantity}', {u.factor!r}::DOUBLE, {u.offset!r}::DOUBLE, {str(u.log).lower()})" for s, u in unit_table().items())
    words = "[" + ", ".join(map(_quoted, QUANTITY_WORDS)) + "]"
    letters = "CASE string_split(name, '_')[1] " + " ".join(f"WHEN '{k}' THEN '{q}'" for k, q in QUANTITY_LETTERS.items()) + " END"
    condition = " ".join(
        rf"WHEN '{q}' THEN regexp_extract(conditions, '(?i)\b{_word(q)}\s*(?:are\s+(?:given\s+)?in\s+|in\s+|\[)\s*([^;,\]]+?)\s*(?:[;,\]]|\.\s|\.?$)', 1)" for q in QUANTITY_WORDS
    )
    bare = "('', '-', '–', '—', '−', 'n/a', 'N/A')"
    last = "list_filter(regexp_extract_all(lower({}), '[a-z]+'), lambda w: list_contains({}, w))[-1]"
    return rf"""
WITH u(spelling, quantity, factor, shift, log) AS (VALUES {units}),
k AS (SELECT min(table_id) AS table_id FROM table_blocks GROUP BY doc_hash, section, table_index),
t AS (SELECT DISTINCT ON (table_id) table_id, part_number, headers, grid, {_plain("conditions")} AS conditions FROM table_blocks WHERE table_id IN (SELECT table_id FROM k)),
h AS (SELECT table_id, unnest(headers) AS h, generate_subscripts(headers, 1) AS j FROM t),
hc AS (SELECT table_id, j, lower(regexp_extract(h, '(?i)^\s*(min|typ|nom|max|value)', 1)) AS role, trim(regexp_extract({_plain("h")}, '(?is)^\s*(?:min|typ|nom|max|value)\w*\.?\s*(.*?)\s*$', 1)) AS rest
       FROM h WHERE regexp_matches(h, '(?is)^\s*(min|typ|nom|max|value)')),
hu AS (SELECT table_id, min(j) AS unit_at FROM h WHERE regexp_matches(h, '(?i)^\s*units?\s*$') GROUP BY table_id),
g AS (SELECT table_id, part_number, conditions, unnest(grid) AS cells, generate_subscripts(grid, 1) - 1 AS row FROM t),
r AS (SELECT *, trim({_plain("cells[1]")}) AS name, coalesce(cells[2], '') AS about FROM g WHERE trim({_plain("cells[1]")}) <> ''),
c AS (SELECT r.table_id, r.row, hc.j, hc.role, hc.rest, {_plain("r.cells[hc.j]")} AS cell FROM r JOIN hc USING (table_id) WHERE hc.j <= len(r.cells)),
n AS (SELECT *, replace(replace(regexp_extract(cell, '^\s*[±~≈≤≥<>=]*\s*({_NUMBER})', 1), '−', '-'), '–', '-') AS digits, regexp_extract(cell, '(?s)^\s*[±~≈≤≥<>=]*\s*{_NUMBER}\s*(.*?)\s*$', 1) AS beside FROM c),
f AS (SELECT *, try_cast(CASE WHEN digits = '' THEN NULL WHEN NOT contains(digits, ',') THEN digits
        WHEN regexp_full_match(digits, '[+-]?\d{{1,3}}(,\d{{3}})+(\.\d+)?([eE][+-]?\d+)?') THEN replace(digits, ',', '')
        WHEN len(digits) - len(replace(digits, ',', '')) = 1 AND NOT contains(digits, '.') THEN replace(digits, ',', '.') END AS DOUBLE) AS x FROM n),
p AS (SELECT *, count(*) OVER (PARTITION BY table_id, row) AS found FROM f WHERE x IS NOT NULL AND isfinite(x)
      QUALIFY row_number() OVER (PARTITION BY table_id, row ORDER BY role NOT IN ('typ', 'nom', 'value'), j) = 1),
q AS (SELECT r.*, p.x, p.beside, p.role, p.found, CASE WHEN hu.unit_at <= len(r.cells) THEN {_plain("r.cells[hu.unit_at]")} ELSE '' END AS in_row,
        CASE WHEN left(p.rest, 1) IN ('(', '[') AND right(p.rest, 1) IN (')', ']') THEN trim(p.rest[2:-2]) WHEN left(p.rest, 1) IN ('/', ',') THEN trim(p.rest[2:]) ELSE '' END AS in_header,
        coalesce({last.format("string_split(about, ',')[1]", words)}, {last.format("about", words)}, CASE WHEN contains(name, '_') THEN {letters} END) AS hint
      FROM r JOIN p USING (table_id, row) LEFT JOIN hu USING (table_id) WHERE p.role IN ('typ', 'nom', 'value') OR p.found = 1),
s AS (SELECT *, CASE WHEN trim(beside) NOT IN {bare} THEN beside WHEN trim(in_row) NOT IN {bare} THEN in_row WHEN in_header NOT IN {bare} THEN in_header
        ELSE nullif(CASE hint {condition} END, '') END AS unit FROM q),
m AS (SELECT s.*, coalesce(a.quantity, b.quantity) AS quantity, coalesce(a.factor, b.factor) AS factor, coalesce(a.shift, b.shift) AS shift, coalesce(a.log, b.log) AS log
      FROM s LEFT JOIN u a ON a.spelling = {_spelling("s.unit")} LEFT JOIN u b ON len(s.unit) > 2 AND b.spelling = lower({_spelling("s.unit")})),
v AS (SELECT m.table_id, m.part_number, m.row, m.name, m.quantity, ((CASE WHEN m.log THEN m.factor * 10 ** (m.x / 10) ELSE m.x * m.factor + m.shift END) - o.shift) / o.factor AS value
      FROM m JOIN common_units cu ON cu.quantity = m.quantity JOIN u o ON o.spelling = {_spelling("cu.common_unit")} AND o.quantity = m.quantity AND NOT o.log)"""


def agreeing_rows_sql() -> str:
    return (
        stated_values_sql()
        + """
SELECT DISTINCT a.table_id AS table_id_a, CAST(a.row AS INTEGER) AS row_a, b.table_id AS table_id_b, CAST(b.row AS INTEGER) AS row_b
FROM v a JOIN v b ON a.part_number = b.part_number AND a.name = b.name AND a.quantity = b.quantity AND a.table_id < b.table_id
WHERE abs(a.value - b.value) <= 0.005 * greatest(abs(a.value), abs(b.value))"""
    )
