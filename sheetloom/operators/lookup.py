"""Spec lookups and their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetloom.functions.text import value_field

#: Columns kept in lower case beside the records, so that a lookup's substring
#: filters reach the scan of a written table.
LOWERED = ("symbol", "name", "section")


def with_lowered(specs: DataFrame) -> DataFrame:
    return specs.withColumns({f"{c}_lc": F.lower(c) for c in LOWERED})


def find_specs(specs: DataFrame, symbol: str = "", name: str = "", section: str = "") -> DataFrame:
    """Records that contain every given text, in any case, in that field; the
    section counts as a text too, so ``4.1`` also finds ``4.10``."""
    out = specs
    for column, needle in (("symbol", symbol), ("name", name), ("section", section)):
        if needle:
            field = F.col(f"{column}_lc") if f"{column}_lc" in specs.columns else F.lower(column)
            out = out.where(F.contains(field, F.lit(needle.lower())))
    return out


def answer_line() -> Column:
    value = F.trim(F.concat(value_field(F.col("value"), F.col("min"), F.col("typ"), F.col("max")), F.lit(" "), "unit"))
    detail = F.when(F.col("conditions") != "", F.concat(F.lit(", "), "conditions")).otherwise("")
    page = F.concat(F.lit("p."), F.coalesce(F.col("page").cast("string"), F.lit("?")))
    place = F.format_string(" [table %d row %d]", "table_index", "row_index")
    return F.concat("name", F.lit(" ("), "symbol", F.lit("): "), value, detail, F.lit(" — §"), F.coalesce("section", F.lit("")), F.lit(", "), page, place)


def answer_notes() -> Column:
    cited = F.filter("footnotes", lambda f: F.array_contains(F.col("cited_markers"), f["marker"]))
    return F.transform(cited, lambda f: F.concat(F.lit("  "), f["marker"], F.lit(" "), f["text"]))


def format_answers(specs: DataFrame, by: list[str], limit: int = 5) -> DataFrame:
    """(by..., answer): the first records of each group as lines with their
    cited footnotes, and how many more there are. Only the few first records
    of a group are ever put together."""
    order = ["doc_hash", "table_id", "row_index"]
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    total = specs.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    top = specs.withColumn("nth", nth).where(F.col("nth") <= limit).select(*by, "nth", F.concat(F.array(answer_line()), answer_notes()).alias("lines"))
    lines = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", "lines"))), lambda x: x["lines"]))
    joined = top.groupBy(*by).agg(lines.alias("lines")).join(total, by)
    more = F.when(F.col("total") > limit, F.array(F.format_string("... and %d more matches", F.col("total") - limit))).otherwise(F.array().cast("array<string>"))
    return joined.select(*by, F.array_join(F.concat("lines", more), "\n").alias("answer"))
