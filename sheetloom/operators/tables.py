"""Tables: header roles, spec records, footnotes, Markdown and CSV twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetloom.functions import lexicons as lx
from sheetloom.functions.text import canonical_unit, normalize_text, strip


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _pattern_role(header: Column) -> Column:
    out = None
    for role, pattern in lx.ROLE_PATTERNS:
        out = (F if out is None else out).when(header.rlike("(?i)" + pattern), role)
    return out


def assign_roles(tables: DataFrame, headers: str = "headers", out: str = "roles") -> DataFrame:
    """tables with the role of each header: by pattern; the first two
    ``parameter`` columns are symbol and name; blank columns before the first
    numeric role are, in order, symbol, name and conditions; the titled column
    left of the unit is the value if no numeric role but the unit is there and
    a name stands to its left. Null headers count as blank.

    Each step is a column of its own, so that later steps read its result
    instead of computing it again."""
    h, first, roles, filled = (F.col(f"_{n}") for n in ("h", "first", "roles", "filled"))
    t = tables.withColumn("_h", F.transform(F.coalesce(headers, F.array().cast("array<string>")), lambda x: strip(F.coalesce(x, F.lit("")))))
    t = t.withColumn("_first", F.transform(h, _pattern_role))

    def parameters(r: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(first, F.lit(1), i), lambda x: x == "parameter"))
        return F.when(r == "parameter", F.when(before == 0, "symbol").when(before == 1, "name").otherwise("other")).otherwise(F.coalesce(r, F.lit("other")))

    t = t.withColumn("_roles", F.transform(first, parameters))
    numeric = F.filter(F.transform(roles, lambda r, i: F.when(r.isin(lx.NUMERIC_ROLES), i)), lambda i: i.isNotNull())
    t = t.withColumn("_numeric", F.coalesce(F.array_min(numeric), F.lit(0)))  # without numeric roles no column is before it
    t = t.withColumn("_blank", F.transform(roles, lambda r, i: (i < F.col("_numeric")) & (r == "other") & (F.get(h, i) == "")))

    def leading(r: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice("_blank", F.lit(1), i), lambda x: x))
        return F.when(F.get("_blank", i) & (before < len(lx.LEADING_ROLES)), F.get(_texts(lx.LEADING_ROLES), before)).otherwise(r)

    t = t.withColumn("_filled", F.transform(roles, leading))
    t = t.withColumn("_unit", F.when(~F.arrays_overlap(filled, _texts(lx.VALUE_ROLES)), F.array_position(filled, "unit").cast("int") - 1).otherwise(-1))

    def inferred(r: Column, i: Column) -> Column:
        named = F.array_contains(F.slice(filled, F.lit(1), i), "name")
        return F.when((i == F.col("_unit") - 1) & (r == "other") & (F.get(h, i) != "") & named, "value").otherwise(r)

    return t.withColumn(out, F.transform(filled, inferred)).drop("_h", "_first", "_roles", "_numeric", "_blank", "_filled", "_unit")


def unmapped_headers(headers: Column, roles: Column) -> Column:
    pairs = F.arrays_zip(F.transform(headers, strip).alias("h"), roles.alias("r"))
    return F.transform(F.filter(pairs, lambda x: (x["r"] == "other") & (x["h"] != "")), lambda x: x["h"])


def classify_table(roles: Column) -> Column:
    named = F.arrays_overlap(roles, _texts(["symbol", "name"]))
    valued = F.arrays_overlap(roles, _texts(lx.VALUE_ROLES))
    unit = F.array_contains(roles, "unit")
    limits = F.arrays_overlap(roles, _texts(["min", "typ", "max"]))
    return F.when(named & valued & unit, "parametric").when(named & ~unit & ~limits, "info").otherwise("unmapped")


def not_blank(row: Column) -> Column:
    return F.exists(row, lambda c: strip(c) != "")


def cell_for_role(row: Column, roles: Column, role: str) -> Column:
    """The first cell with the role that isn't blank, else ''."""
    pairs = F.arrays_zip(row.alias("c"), F.slice(roles, F.lit(1), F.size(row)).alias("r"))
    return F.coalesce(F.get(F.filter(pairs, lambda x: (x["r"] == role) & (strip(x["c"]) != "")), F.lit(0))["c"], F.lit(""))


RECORD_ROLES = ("symbol", "name", "conditions", "min", "typ", "max", "value", "unit")


def _places_of(roles: Column, role: str) -> Column:
    indexed = F.transform(roles, lambda r, i: F.when(r == role, i))
    return F.filter(indexed, lambda i: i.isNotNull())


def _first_filled(row: Column, places: Column) -> Column:
    """The first cell at one of the places that isn't blank, else ''."""
    cells = F.transform(places, lambda i: F.get(row, i))
    return F.coalesce(F.get(F.filter(cells, lambda c: strip(F.coalesce(c, F.lit(""))) != ""), F.lit(0)), F.lit(""))


def cited_markers(row: Column, footnotes: Column) -> Column:
    """Markers of the table's footnotes that stand in the row, then other
    numbers in parentheses (these as often as they occur)."""
    text = F.array_join(row, " ")
    known = F.filter(F.transform(footnotes, lambda f: f["marker"]), lambda m: F.contains(text, m))
    printed = F.regexp_extract_all(text, F.lit(r"(\(\d+\))"), 1)
    return F.concat(known, F.filter(printed, lambda m: ~F.array_contains(known, m)))


def spec_tables(tables: DataFrame) -> DataFrame:
    """tables with roles, kind, unmapped_headers and n_records."""
    headers = F.coalesce(F.col("headers"), F.array().cast("array<string>"))
    out = assign_roles(tables)
    rows = F.filter(F.coalesce(F.col("grid"), F.array().cast("array<array<string>>")), not_blank)
    return out.withColumns({"kind": classify_table(F.col("roles")), "unmapped_headers": unmapped_headers(headers, F.col("roles")), "n_records": F.size(rows)})


def spec_records(tables: DataFrame) -> DataFrame:
    """One record per row that isn't blank, of tables of every kind; the row
    index is the row's place in the grid. The page is the row's, else the
    table's. Null cells are empty."""
    # where a role's cells stand is found once per table
    places = F.struct(*[_places_of(F.col("roles"), r).alias(r) for r in RECORD_ROLES])
    t = spec_tables(tables).withColumn("_places", places).select("table_id", "doc_hash", "part_number", "section", "table_index", "conditions", "footnotes", "page", "row_pages", "_places", F.posexplode("grid").alias("row_index", "_row"))
    t = t.withColumn("_row", F.transform("_row", lambda c: F.coalesce(c, F.lit("")))).where(not_blank(F.col("_row")))
    cell = {r: _first_filled(F.col("_row"), F.col("_places")[r]) for r in RECORD_ROLES}
    notes = F.coalesce(F.col("footnotes"), F.array().cast("array<struct<marker:string,text:string>>"))
    unit = canonical_unit(cell["unit"])
    return t.select(
        "table_id",
        "doc_hash",
        "part_number",
        "section",
        "table_index",
        "row_index",
        *[normalize_text(cell[r]).alias(r) for r in ("symbol", "name", "conditions")],
        normalize_text(F.coalesce("conditions", F.lit(""))).alias("table_conditions"),
        *[normalize_text(cell[r]).alias(r) for r in ("min", "typ", "max", "value")],
        unit["verbatim"].alias("unit"),
        unit["canonical"].alias("unit_canonical"),
        notes.alias("footnotes"),
        cited_markers(F.col("_row"), notes).alias("cited_markers"),
        F.coalesce(F.get("row_pages", F.col("row_index")), F.col("page")).alias("page"),
        F.col("_row").alias("row_verbatim"),
    )


def footnote_audit(cited: Column, footnotes: Column) -> Column:
    """struct(orphans, uncited, ok) of the markers cited in a table against
    those of its footnotes."""
    noted = F.transform(footnotes, lambda f: f["marker"])
    orphans = F.array_sort(F.array_except(cited, noted))
    return F.struct(orphans.alias("orphans"), F.array_sort(F.array_except(noted, cited)).alias("uncited"), (F.size(orphans) == 0).alias("ok"))


def attach_footnotes(footnotes: Column, more: Column) -> Column:
    """Footnotes united by marker; of equal markers the first counts."""
    every = F.concat(footnotes, more)
    return F.filter(every, lambda f, i: ~F.array_contains(F.transform(F.slice(every, F.lit(1), i), lambda x: x["marker"]), f["marker"]))


def disambiguate(headers: Column) -> Column:
    """The k-th repetition of a header gets ``_k``, from the second on."""
    def named(h: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice(headers, F.lit(1), i), lambda x: x == h)) + 1
        return F.when(nth > 1, F.concat(h, F.lit("_"), nth.cast("string"))).otherwise(h)

    return F.transform(headers, named)


def grid_markdown(headers: Column, grid: Column) -> Column:
    def cell(c: Column) -> Column:
        return strip(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))

    def line(row: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(row, cell), " | "), F.lit(" |"))

    rule = F.concat(F.lit("|"), F.array_join(F.transform(headers, lambda _: F.lit(" --- ")), "|"), F.lit("|"))
    head = F.when(F.size(headers) > 0, F.array(line(headers), rule)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, F.transform(grid, line)), "\n")


def grid_csv(headers: Column, grid: Column) -> Column:
    """Comma-separated lines, each ended by a newline; a cell is quoted only
    if it holds a comma, a quote or a line end, or is a row's only and empty
    cell."""
    def cell(c: Column) -> Column:
        c = F.coalesce(c, F.lit(""))
        return F.when(c.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    def line(row: Column) -> Column:
        joined = F.array_join(F.transform(row, cell), ",")
        return F.when((F.size(row) == 1) & (joined == ""), F.lit('""')).otherwise(joined)

    head = F.when(F.size(headers) > 0, F.array(line(disambiguate(headers)))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.transform(F.concat(head, F.transform(grid, line)), lambda x: F.concat(x, F.lit("\n"))), "")


def key_symbols(tables: DataFrame, limit: int = 8) -> DataFrame:
    """(doc_hash, section, symbols): the first distinct first cells of 2 to 14
    characters of a section's tables, in reading order. Each symbol is reduced
    to its first place before a section's few are put together."""
    rows = tables.select("doc_hash", "section", "table_index", "table_id", F.posexplode("grid").alias("row_index", "_row"))
    rows = rows.withColumn("symbol", F.get("_row", F.lit(0))).where(F.length("symbol").between(2, 14))
    place = F.min(F.struct("table_index", "table_id", "row_index")).alias("place")
    first = rows.groupBy("doc_hash", "section", "symbol").agg(place)
    nth = F.row_number().over(Window.partitionBy("doc_hash", "section").orderBy("place", "symbol"))
    kept = first.withColumn("nth", nth).where(F.col("nth") <= limit)
    ordered = F.array_sort(F.collect_list(F.struct("nth", "symbol")))
    return kept.groupBy("doc_hash", "section").agg(F.transform(ordered, lambda x: x["symbol"]).alias("symbols"))
