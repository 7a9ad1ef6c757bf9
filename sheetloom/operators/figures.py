"""The plot catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetloom.functions.text import absolute_url, caption_tags, extension_of, figure_number, image_variants, pages_label, plot_file_path, section_tags, slugify, squash


def plot_records(figures: DataFrame) -> DataFrame:
    """figures(doc_hash, sec_pos, number, title, fig_pos, caption, conditions,
    page_start, page_end, image_url) as plot records. Ids count the figures of
    a section; a section without number is known by its title."""
    nth = F.row_number().over(Window.partitionBy("doc_hash", "sec_pos").orderBy("fig_pos"))
    stem = F.when(F.col("number") != "", F.col("number")).otherwise(slugify(F.col("title")))
    return figures.select(
        "doc_hash",
        F.format_string("%s-f%03d", stem, nth).alias("id"),
        F.col("number").alias("section"),
        "caption",
        figure_number(F.col("caption")).alias("figure_number"),
        "conditions",
        "page_start",
        "page_end",
        "image_url",
        F.lit("").alias("file"),
        F.concat(section_tags(F.col("title")), caption_tags(F.col("caption"))).alias("tags"),
    )


def find_plots(plots: DataFrame, q: str = "", caption: str = "", conditions: str = "", section: str = "", tags: list[str] | None = None) -> DataFrame:
    """All given conditions must hold: substrings (in any case) of caption and
    conditions, the exact section, every tag."""
    def has(c: Column, needle: str) -> Column:
        return F.contains(F.lower(c), F.lit(needle.lower()))

    out = plots
    if q:
        out = out.where(has(F.concat("caption", F.lit(" "), "conditions"), q))
    if caption:
        out = out.where(has(F.col("caption"), caption))
    if conditions:
        out = out.where(has(F.col("conditions"), conditions))
    if section:
        out = out.where(F.col("section") == section)
    for tag in tags or []:
        out = out.where(F.array_contains("tags", tag.lower()))
    return out


def plot_answer_line() -> Column:
    detail = F.when(F.col("conditions") != "", F.concat(F.lit(" — "), "conditions")).otherwise("")
    file = F.when(F.col("file") != "", F.concat(F.lit(" — file: "), "file")).otherwise("")
    label = F.concat(F.when(F.col("page_start").isNull(), "?").otherwise(pages_label(F.col("page_start"), F.col("page_end"), "p.")))
    return F.concat("caption", F.lit(" — §"), "section", F.lit(" ("), label, F.lit(")"), detail, file)


def largest_images(fetched: DataFrame) -> DataFrame:
    """fetched(plot_id, variant, url, data) -> the largest image of each plot;
    of equal sizes the first variant."""
    best = F.max_by(F.struct("url", "data"), F.struct(F.length("data"), -F.col("variant"))).alias("b")
    return fetched.where("data is not null").groupBy("plot_id").agg(best).select("plot_id", "b.url", "b.data")


def pair_with_anchors(plots: DataFrame, anchors: DataFrame, least_height: float = 6.0) -> DataFrame:
    """Clip of each plot: the first anchor (by kind: captions before titles,
    then order) with its squashed caption on one of its pages. anchors
    (doc_hash, page, key, kind, anchor_pos, y0, y1); flat ones are skipped."""
    wanted = plots.where("page_start is not null").select("doc_hash", "id", squash(F.col("caption")).alias("key"), "page_start", F.coalesce("page_end", "page_start").alias("page_last"))
    tall = anchors.where(F.col("y1") - F.col("y0") >= least_height)
    hits = wanted.join(tall, ["doc_hash", "key"]).where("page between page_start and page_last")
    clip = F.min_by(F.struct("page", "y0", "y1"), F.struct("kind", "anchor_pos")).alias("clip")
    return hits.groupBy("doc_hash", "id").agg(clip).select("doc_hash", "id", "clip.page", "clip.y0", "clip.y1")


def image_candidates(plots: DataFrame) -> DataFrame:
    """(plot_id, variant, url) of the addresses to try for each plot."""
    rows = plots.where("image_url <> ''").select(F.col("id").alias("plot_id"), F.posexplode(image_variants(F.col("image_url"))).alias("variant", "url"))
    return rows.withColumn("url", absolute_url(F.col("url")))


def with_images(plots: DataFrame, candidates: DataFrame, fetched: DataFrame) -> DataFrame:
    """plots with the file of their largest fetched image (and its data);
    plots without any keep an empty file. fetched(url, data)."""
    best = largest_images(candidates.join(fetched.where("data is not null").select("url", "data"), "url"))
    joined = plots.join(best.withColumnRenamed("plot_id", "id"), "id", "left")
    file = F.when(F.col("url").isNotNull(), plot_file_path(F.col("section"), F.col("id"), extension_of(F.col("url")))).otherwise(F.col("file"))
    return joined.select(*[c for c in plots.columns if c != "file"], file.alias("file"), F.col("data").alias("image"))
