"""Whether expected answers stand where they are cited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.functions.text import contains, count_tokens, spec_fields
from sheetloom.operators.ranges import pages_of


def _joined_texts(rows: DataFrame, question: str, order: str) -> DataFrame:
    """The texts of a question in order, joined by newlines."""
    ordered = F.array_sort(F.collect_set(F.struct(order, "text")))
    return rows.groupBy(question).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("blob"))


def verify_questions(questions: DataFrame, sections: DataFrame, pages: DataFrame, strict: bool = False) -> DataFrame:
    """(question_id, corpus_contains, page_truth, passed, matched_files,
    missing). The sections that cover a cited page, joined in order of their
    files, and the cited pages themselves, joined in order, must each contain
    every expected substring (as it is or squashed). Plot questions pass here;
    questions without text to look at fail.

    questions(question_id, doc_hash, expected_substrings, pages, is_plot),
    sections(doc_hash, file, page_start, page_end, text), pages(doc_hash, page,
    text). Joins go by keys; the wide texts are joined once, last."""
    asked = questions.where("not is_plot").select("question_id", "doc_hash", F.explode("pages").alias("page")).distinct()
    spans = pages_of(sections.select("doc_hash", "file", "page_start", "page_end")).select("doc_hash", "file", "page")
    files = asked.join(spans, ["doc_hash", "page"]).select("question_id", "doc_hash", "file").distinct()
    matched = files.groupBy("question_id").agg(F.array_sort(F.collect_set("file")).alias("matched_files"))
    corpus = _joined_texts(files.join(sections.select("doc_hash", "file", "text"), ["doc_hash", "file"]), "question_id", "file").withColumnRenamed("blob", "corpus")
    cited = _joined_texts(asked.join(pages.select("doc_hash", "page", "text"), ["doc_hash", "page"]), "question_id", "page").withColumnRenamed("blob", "cited")
    out = questions.join(matched, "question_id", "left").join(corpus, "question_id", "left").join(cited, "question_id", "left")

    def holds(blob: str, s: Column) -> Column:
        return contains(F.coalesce(F.col(blob), F.lit("")), s, strict)

    subs = F.coalesce(F.col("expected_substrings"), F.array().cast("array<string>"))
    plot = F.col("is_plot")
    in_corpus = plot | (F.col("corpus").isNotNull() & F.forall(subs, lambda s: holds("corpus", s)))
    on_page = plot | ((F.coalesce("cited", F.lit("")) != "") & F.forall(subs, lambda s: holds("cited", s)))
    passed = in_corpus & on_page
    missing = F.filter(subs, lambda s: ~(holds("corpus", s) & holds("cited", s)))
    none = F.array().cast("array<string>")
    return out.select(
        "question_id",
        in_corpus.alias("corpus_contains"),
        on_page.alias("page_truth"),
        passed.alias("passed"),
        F.coalesce("matched_files", none).alias("matched_files"),
        F.when(passed, none).otherwise(missing).alias("missing"),
    )


def summarize(results: DataFrame) -> DataFrame:
    """One row: total, passed, failed, accuracy (0 for no question) and the
    number of questions without a covering section."""
    n, ok = F.count(F.lit(1)), F.count_if("passed")
    return results.agg(
        n.alias("total"), ok.alias("passed"), (n - ok).alias("failed"),
        F.when(n == 0, 0.0).otherwise(ok / F.greatest(n, F.lit(1))).alias("accuracy"),
        F.count_if(F.size("matched_files") == 0).alias("without_section"),
    )


def lookup_economics(results: DataFrame, sections: DataFrame, questions: DataFrame, index_tokens: int) -> DataFrame:
    """One row: what a question costs (the index and its first file) on
    average and at most, against all section texts."""
    first = results.select("question_id", F.get("matched_files", F.lit(0)).alias("file")).join(questions.select("question_id", "doc_hash"), "question_id")
    tokens = sections.select("doc_hash", "file", count_tokens(F.col("text")).alias("tokens"))
    per = first.join(tokens.groupBy("doc_hash", "file").agg(F.max("tokens").alias("tokens")), ["doc_hash", "file"], "left")
    cost = F.lit(index_tokens) + F.coalesce("tokens", F.lit(0))
    costs = per.agg(F.coalesce(F.avg(cost), F.lit(0.0)).alias("avg_per_question"), F.coalesce(F.max(cost), F.lit(0)).alias("max_per_question"))
    return costs.crossJoin(tokens.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("full_dump_tokens")))


def _entry(column: str, key: str) -> Column:
    """The value of a map's key, '' if there is none."""
    return F.coalesce(F.try_element_at(F.col(column), F.lit(key)), F.lit(""))


def verify_specs(questions: DataFrame, specs: DataFrame) -> DataFrame:
    """(question_id, passed) of questions with a spec_query: among the
    document's records that match all of its fields and stand on a cited page,
    each expected substring must be in one."""
    asked = questions.where("spec_query is not null").select("question_id", "doc_hash", "spec_query", F.col("expected_substrings").alias("subs"), F.explode_outer(F.array_distinct("pages")).alias("page"))
    q = {k: F.lower(_entry("spec_query", k)) for k in ("symbol", "name", "section")}
    text = spec_fields(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("symbol", "name", "conditions", "table_conditions", "min", "typ", "max", "value", "unit")])
    records = specs.select("doc_hash", "page", *[F.lower(F.coalesce(c, F.lit(""))).alias(f"_{c}") for c in q], text.alias("_text"))
    hit = F.col("_text").isNotNull()
    for k, needle in q.items():
        hit = hit & F.contains(F.col(f"_{k}"), needle)
    # records meet the questions of their page only
    met = asked.join(records, ["doc_hash", "page"], "left")
    subs = F.when(F.size("subs") > 0, F.col("subs")).otherwise(F.array(F.lit(None).cast("string")))
    per_sub = met.select("question_id", hit.alias("hit"), "_text", F.explode(subs).alias("sub"))
    ok = F.coalesce(F.col("hit") & (F.col("sub").isNull() | contains(F.col("_text"), F.col("sub"))), F.lit(False))
    return per_sub.groupBy("question_id", "sub").agg(F.max(ok).alias("ok")).groupBy("question_id").agg(F.min("ok").alias("passed"))


#: An image file of no more bytes than this is no plot.
LEAST_IMAGE = 1024


def verify_plots(questions: DataFrame, plots: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(question_id, found) of questions with a plot_query: whether a plot of
    the document matches its caption, conditions and section and begins on a
    cited page. With files(file, bytes) its image must be there too, and hold
    more than LEAST_IMAGE bytes."""
    if files is not None:
        plots = plots.join(files.where(F.col("bytes") > LEAST_IMAGE).select("file").distinct(), "file", "left_semi")
    asked = questions.where("plot_query is not null").select("question_id", "doc_hash", "plot_query", F.explode_outer(F.array_distinct("pages")).alias("page"))
    q = {k: _entry("plot_query", k) for k in ("caption_contains", "conditions_contain", "section")}
    p = plots.select("doc_hash", F.col("page_start").alias("page"), F.lower("caption").alias("_c"), F.lower("conditions").alias("_d"), F.col("section").alias("_s"))
    hit = F.contains(F.col("_c"), F.lower(q["caption_contains"])) & F.contains(F.col("_d"), F.lower(q["conditions_contain"]))
    hit = hit & ((q["section"] == "") | (q["section"] == F.col("_s")))
    met = asked.join(p, ["doc_hash", "page"], "left")
    return met.groupBy("question_id").agg(F.max(F.coalesce(hit, F.lit(False))).alias("found"))


def verification_report(results: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, line): the rows of the report's table."""
    pages = F.array_join(F.transform(F.coalesce("pages", F.array().cast("array<int>")), lambda p: F.concat(F.lit("p."), p.cast("string"))), ", ")
    sign = [F.when(F.col(c), "✅").otherwise("❌") for c in ("corpus_contains", "page_truth")]
    joined = questions.select("question_id", "question", "pages").join(results, "question_id")
    return joined.select("question_id", F.concat(F.lit("| "), F.col("question_id").cast("string"), F.lit(" | "), "question", F.lit(" | "), pages, F.lit(" | "), sign[0], F.lit(" | "), sign[1], F.lit(" |")).alias("line"))
