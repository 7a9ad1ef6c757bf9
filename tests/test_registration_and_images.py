import pytest
from pyspark.sql import functions as F

from sheetloom.operators import figures as fg
from sheetloom.operators import html
from sheetloom.operators import index as ix
from sheetloom.operators import inventory as inv
from sheetloom.operators.plain import plain_sections
from sheetloom.runtime import shared_dir, sized, spread, staged
from sheetloom.sources import decode


def test_registration(spark):
    files = spark.createDataFrame([("/x/ug-12_errata.pdf", "h1", ["Analog Devices Rev. B"]), ("/x/dac9.pdf", "h2", None)], "path string, content_hash string, page_texts array<string>")
    a, b = inv.register_sources(files, "P").orderBy("content_hash").collect()
    assert (a.doc_type, a.revision, a.page_count, a.vendor, a.vendor_evidence) == ("errata", "Rev. B", 1, "adi", 'brand:"analog devices" (p.1)')
    assert (b.doc_type, b.revision, b.page_count, b.vendor, b.vendor_evidence, b.part_number) == ("datasheet", "", 0, "ti", "", "P")
    assert {r.vendor_evidence for r in inv.register_sources(files, vendor="qorvo").collect()} == {"cli-override: --vendor qorvo"}
    with pytest.raises(ValueError, match="unknown vendor"):
        inv.register_sources(files, vendor="nix")
    assert {r.vendor for r in inv.pin_vendor(files.withColumns({"vendor": F.lit("ti"), "vendor_evidence": F.lit("")}), "adi").collect()} == {"adi"}


def test_evidence_is_only_filled_in(spark):
    src = spark.createDataFrame([("a", "x.pdf", "qorvo", ""), ("b", "x.pdf", "qorvo", "kept"), ("c", "x.pdf", "adi", None)], "content_hash string, path string, vendor string, vendor_evidence string")
    pages = spark.createDataFrame([("a", "QORVO"), ("c", "qorvo")], "content_hash string, text string")
    assert [r.vendor_evidence for r in inv.backfill_evidence(src, pages).orderBy("content_hash").collect()] == ['brand:"qorvo" (p.1)', "kept", None]


def test_changed_files_replace_their_registration(spark):
    schema = "part_number string, path string, content_hash string"
    old = spark.createDataFrame([("P", "a", "1"), ("P", "b", "1"), ("P", "note", "7")], schema)
    now = spark.createDataFrame([("P", "a", "2"), ("P", "b", "1"), ("P", "new", "3")], schema)
    assert sorted(map(tuple, inv.refresh_by_path(old, now).collect())) == [("P", "a", "2"), ("P", "b", "1"), ("P", "note", "7")]


def test_reasons_are_shortened(spark):
    rows = spark.createDataFrame([(["a", "b"],), (["a", "b", "c", "d"],), ([],)], "r array<string>")
    assert [x.s for x in rows.select(inv.shown_reasons(F.col("r")).alias("s")).collect()] == ["a; b", "a; b; c; …", ""]


def test_images(spark):
    plots = spark.createDataFrame([("4-f001", "4.1", "/i/x-low.gif", ""), ("4-f002", "", "", "")], "id string, section string, image_url string, file string")
    candidates = fg.image_candidates(plots)
    assert candidates.count() == 6 and candidates.first().url.startswith("https://")
    fetched = spark.createDataFrame([("https://www.ti.com/i/x-low.gif", b"1"), ("https://www.ti.com/i/x.png", b"123"), ("https://www.ti.com/i/x.jpg", None)], "url string, data binary")
    got = {r.id: (r.file, r.image) for r in fg.with_images(plots, candidates, fetched).collect()}
    assert got == {"4-f001": ("figures/4-1/4-f001.png", bytearray(b"123")), "4-f002": ("", None)}
    p = spark.createDataFrame([("d", "f1", "Fig. A", 1, 2), ("d", "f2", "Fig B", 9, None)], "doc_hash string, id string, caption string, page_start int, page_end int")
    anchors = spark.createDataFrame([("d", 2, "figa", "caption", 1, 5.0, 50.0), ("d", 1, "figa", "title", 1, 0.0, 90.0), ("d", 9, "figb", "caption", 1, 5.0, 8.0)], "doc_hash string, page int, key string, kind string, anchor_pos int, y0 double, y1 double")
    assert list(map(tuple, fg.pair_with_anchors(p, anchors).collect())) == [("d", "f1", 2, 5.0, 50.0)]


def test_written_descriptions_fall_back(spark):
    base = spark.createDataFrame([("1", "plain"), ("2", "plain")], "key string, description string")
    written = spark.createDataFrame([("1", " better "), ("2", "  "), ("9", "x")], base.schema)
    assert sorted(map(tuple, ix.override_descriptions(base, written, ["key"]).collect())) == [("1", "better"), ("2", "plain")]


def test_briefs_and_facts(spark):
    rows = [("P", "d", 0, "Features", ["• Fast conversion", "no bullet", "• ab", "  • Small"]), ("P", "d", 1, "Description", ["Too short.", "This paragraph has more than eight words in it."]), ("Q", "e", 0, None, [None])]
    got = {r.part: (r.brief, r.facts) for r in ix.brief_and_facts(spark.createDataFrame(rows, "part string, doc_hash string, sec_pos int, title string, paragraphs array<string>"), ["part"]).collect()}
    assert got == {"P": ("This paragraph has more than eight words in it.", ["Fast conversion", "Small"]), "Q": ("", [])}


def test_plain_sections_follow_the_contents(spark):
    pages = spark.createDataFrame([("d", 1, "a\n1"), ("d", 2, "b"), ("d", 3, None), ("e", 1, "x")], "doc_hash string, page int, text string")
    toc = spark.createDataFrame([("d", 0, "1", "One", 1, 1), ("d", 1, "", "Two", 1, 2), ("d", 2, "", "Nowhere", 1, None)], "doc_hash string, pos int, number string, title string, level int, page int")
    got = sorted((r.doc_hash, r.sec_pos, r.title, r.page_start, r.page_end, r.paragraphs) for r in plain_sections(pages, toc).collect())
    assert got == [("d", 0, "One", 1, 1, ["a"]), ("d", 1, "Two", 2, 3, ["b"]), ("e", 0, "Page 1", 1, 1, ["x"])]


def test_the_viewer_path(spark):
    url = "//h/document-viewer/X/datasheet/GUID-1"
    contents = spark.createDataFrame([("d", f'<a id="4.1" data-navtitle="Limits" href="{url}">x</a>')], "doc_hash string, html string")
    cache = spark.createDataFrame([("https:" + url, '<div id="GUID-1"><h2>4.1 Limits</h2><p>Text</p></div>')], "url string, html string")
    outline = spark.createDataFrame([("d", 0, "4.1", "Limits", 2, 7)], "doc_hash string, pos int, number string, title string, level int, page int")
    (r,) = html.viewer_sections(contents, cache, outline).collect()
    assert (r.number, r.title, r.level, r.paragraphs, r.method, r.page_start, r.page_end) == ("4.1", "Limits", 2, ["Text"], "exact", 7, 7)


def test_without_a_pdf_library_decoding_says_so(spark):
    files = spark.createDataFrame([("h", b"%PDF")], "content_hash string, content binary")
    if decode.available():
        assert decode.decode(files)["pages"].count() == 0
    else:
        with pytest.raises(decode.DecoderMissing, match="no PDF library"):
            decode.decode(files)


def test_runtime_helpers(spark):
    df = spark.range(30)
    plan = sized(df, 10)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in plan.lower() and "broadcast" in sized(df, 100)._jdf.queryExecution().logical().toString().lower()
    assert spread(df.coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert staged(df, "t").count() == 30 and shared_dir(spark) == shared_dir(spark)


def test_drift_reads_the_first_page_whatever_the_hash_looks_like(spark, tmp_path):
    from sheetloom.plans.catalog import QUERIES

    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("sources", [(1, "sha256:AB 12", "x.pdf", "datasheet", "ti", ""), (2, "cd34", "x.pdf", "datasheet", "adi", ""), (3, "ef56", "x.pdf", "datasheet", "ti", "")], "source_id long, content_hash string, path string, doc_type string, vendor string, vendor_evidence string")
    put("section_plans", [(1, "ab12", 0, "a.md", "Analog Devices"), (2, "cd34", 0, "a.md", "by ANALOG DEVICES"), (3, "ef56", 0, "a.md", "none"), (4, "ef56", 1, "b.md", "Qorvo on page 2")], "plan_id long, doc_hash string, sec_pos int, file string, markdown string")
    put("sections", [(1, "ab12", 0, 1, 1), (2, "cd34", 0, 1, 1), (3, "ef56", 0, 1, 1), (4, "ef56", 1, 2, 2)], "section_id long, doc_hash string, sec_pos int, page_start int, page_end int")
    assert list(map(tuple, QUERIES["vendor_drift"](spark, str(tmp_path)).collect())) == [(1, "ti", "adi", 'brand:"analog devices" (p.1)')]


def test_contents_and_vendors_are_used_by_the_queries(spark, tmp_path):
    from sheetloom.plans.catalog import QUERIES

    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("section_plans", [(1, "d", 0, "a", "one\n1"), (2, "d", 1, "b", "two"), (3, "d", 2, "c", "three\nlines")], "plan_id long, doc_hash string, sec_pos int, file string, markdown string")
    put("sections", [(1, "d", 0, "1", "A", 1, 1, 1), (2, "d", 1, "1.1", "B", 2, 2, 2), (3, "d", 2, "2", "C", 1, 3, 3)], "section_id long, doc_hash string, sec_pos int, number string, title string, level int, page_start int, page_end int")
    got = sorted(map(tuple, QUERIES["plain_outline_sections"](spark, str(tmp_path)).collect()))
    assert got == [("d", 0, "A", 1, 2, 2, 6), ("d", 1, "B", 2, 2, 1, 3), ("d", 2, "C", 3, 3, 2, 10)]
    put("sources", [(1, "ti", "datasheet"), (2, "qorvo", "datasheet"), (3, "x", "datasheet"), (4, "x", "errata")], "source_id long, vendor string, doc_type string")
    assert sorted((r.source_id, r.backend) for r in QUERIES["backend_routed"](spark, str(tmp_path)).collect()) == [(1, "ti_html"), (2, "pdf_layout"), (3, None), (4, "pdf_text")]
