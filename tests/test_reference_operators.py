"""Reference operators on small literals: nulls, blanks, ties, repetitions."""

import pytest
from pyspark.sql import functions as F

from sheetloom.functions import text as tx
from sheetloom.operators import figures as fg
from sheetloom.operators import furniture as fu
from sheetloom.operators import inventory as inv
from sheetloom.operators import lookup as lk
from sheetloom.operators import pages as pg
from sheetloom.operators import ranges as rg
from sheetloom.operators import tables as tb
from sheetloom.operators import verify as vf
from sheetloom.operators.grid import expand, html_table
from sheetloom.operators.html import extract_sections, parse_section, parse_toc, toc_entries
from sheetloom.operators.index import describe, index_ladder, index_lines, section_markdown


@pytest.fixture(scope="module")
def one(spark):
    """Values of expressions over literals, in one job."""
    row = spark.range(1)
    return lambda *exprs: list(row.select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).first())


def s(x):
    return F.lit(x).cast("string")


def texts(*xs):
    return F.array(*[s(x) for x in xs])


def test_headings_of_any_depth_have_exact_ranges(spark):
    from sheetloom.operators.ranges import ranges_to_document_end

    levels = [1, 17, 18, 17, 30, 2]
    toc = spark.createDataFrame([("d", i, str(i), level, i + 1) for i, level in enumerate(levels)], "doc_hash string, pos int, number string, level int, page int")
    got = ranges_to_document_end(toc, spark.createDataFrame([("d", 9)], "doc_hash string, last_page int")).orderBy("pos").collect()
    assert [r.page_end for r in got] == [9, 3, 3, 5, 5, 9]


def test_tokens_and_truncation(one):
    assert one(*[tx.count_tokens(s(x)) for x in ("", None, "a", "abcd", "abcde", "\U0001f600" * 4)]) == [0, 0, 1, 1, 2, 1]
    assert one(tx.truncate_to_tokens(s("alpha beta gamma"), 3), tx.truncate_to_tokens(s("ab"), 1), tx.truncate_to_tokens(s("alphabet soup"), 0), tx.truncate_to_tokens(s("a" * 20), 2)) == ["alpha …", "ab", "", "aaaaaa …"]


def test_squash_and_contains(one):
    assert one(tx.squash(s("±1.5 dB (Typ)")), tx.squash(s(None)), tx.norm_title(s(" RX – Typical  ")), tx.normalize_text(s(" a–b −c "))) == ["15dbtyp", None, "rx typical", "a-b -c"]
    assert one(tx.contains(s("a-b c"), s("AB")), tx.contains(s("x"), s("Ω")), tx.contains(s("x"), s("Ω"), strict=True), tx.contains(s("x"), s("y"))) == [True, True, False, False]


def test_names_and_numbers(one):
    assert one(tx.section_stem(s("4.5"), s("TX Out (dB)")), tx.section_stem(s(""), s("--A  b--")), tx.slugify(s("x" * 59 + " y"))) == ["4-5-tx-out-db", "a-b", "x" * 59]
    got = one(tx.split_number(s("4.5. Limits ")), tx.split_number(s(" Plain 5 ")), tx.split_number(s("7")))
    assert [tuple(x) for x in got] == [("4.5", "Limits"), ("", "Plain 5"), ("7", "")]
    assert one(tx.sniff_revision(texts("x SUPPORT", "Rev. A to Rev. B SBAS1E", "Rev. C")), tx.sniff_revision(texts("SBAS41E")), tx.sniff_revision(texts("a", "b", "c", "Rev. D")), tx.sniff_revision(texts("Revision 3"))) == ["Rev. B", "SBAS41E", "", ""]
    assert one(tx.figure_number(s("see figure 4-1a TX")), tx.figure_number(s("none"))) == ["4-1a", ""]


def test_tags(one):
    assert one(tx.section_tags(s("TX at 0.85 GHz and 800 MHz, clock 800 mhz")), tx.caption_tags(s("IMD and S11 over DSA"))) == [["tx", "pll-clock", "850mhz", "800mhz"], ["imd", "s11", "dsa"]]


def test_notes_labels_urls(one):
    note = [tx.parse_tablenote(s(x)) for x in ("(1)  a\n b", "† c", "2) d", "plain", "(3) ")]
    assert [x and tuple(x) for x in one(*note)] == [("(1)", "a b"), ("†", "c"), ("2)", "d"), None, None]
    n = F.lit(None).cast("int")
    assert one(tx.pages_label(n, n), tx.pages_label(F.lit(3), n), tx.pages_label(F.lit(3), F.lit(5)), tx.pages_label(F.lit(3), F.lit(3), "p.")) == ["?", "3", "3-5", "p.3"]
    assert one(tx.image_variants(s("/a/x-low.gif")), tx.image_variants(s("/a/x.png")), tx.absolute_url(s("/a")), tx.extension_of(s("http://h/a.PNG")), tx.extension_of(s("http://h.com/a"))) == [
        ["/a/x-low.gif", "/a/x-high.gif", "/a/x.gif", "/a/x.png", "/a/x.jpg", "/a/x"], ["/a/x.png", "/a/x-high.gif", "/a/x.gif", "/a/x.jpg", "/a/x"], "https://www.ti.com/a", ".png", ".bin"]
    assert one(tx.plot_file_path(s("4.1"), s("4.1-f001"), s(".gif")), tx.doc_dir_name(s("datasheet"), s("0123456789"))) == ["figures/4-1/4.1-f001.gif", "datasheet-01234567"]


def test_sentences(one):
    assert one(tx.first_sentence(texts("Short one. x", None, "• A much longer sentence here. Next."), 3), tx.first_sentence(texts()), tx.first_sentence(F.lit(None).cast("array<string>"))) == ["A much longer", "", ""]


def test_boilerplate(one):
    text = "Keep\nCopyright © 2024 X\n\n\n\nwww.ti.com \n5\nSBAS1E – MAY 2021 – REVISED JUNE 2022"
    assert tuple(one(fu.strip_boilerplate(s(text)))[0]) == ("Keep\n\n5", 3)
    assert one(fu.page_paragraphs(s(" a \n\n7\n17"), F.lit(7))) == [["a", "17"]]


def test_roles(spark):
    heads = [
        (["PARAMETER", "PARAMETER", "TEST CONDITIONS", "MIN", "UNIT"], ["symbol", "name", "conditions", "min", "unit"], "parametric"),
        (["", " ", "", "", "Typ", "Units"], ["symbol", "name", "conditions", "other", "typ", "unit"], "parametric"),
        (["PACKAGE", "RTA(2)", "UNIT"], ["name", "value", "unit"], "parametric"),
        (["Part Number", "Package"], ["symbol", "name"], "info"),
        (["Foo", "Bar"], ["other", "other"], "unmapped"),
        ([], [], "unmapped"),
        (None, [], "unmapped"),
        (["parameter"] * 3 + ["value"], ["symbol", "name", "other", "value"], "info"),
    ]
    df = spark.createDataFrame([(i, h, [["x"]]) for i, (h, _, _) in enumerate(heads)], "i int, headers array<string>, grid array<array<string>>")
    got = {r.i: (r.roles, r.kind) for r in tb.spec_tables(df).collect()}
    assert [got[i] for i in range(len(heads))] == [(r, k) for _, r, k in heads]


TABLES = "table_id long, doc_hash string, part_number string, section string, table_index int, headers array<string>, grid array<array<string>>, conditions string, footnotes array<struct<marker:string,text:string>>, page int, row_pages array<int>"


def test_records_and_answers(spark):
    rows = [(1, "d", "P", "4.1", 0, ["Parameter", "Parameter", "Min", "Max", "Unit"], [["I_Q", "Quiescent (1)", "1", "2", " µA"], ["", " ", None, "", ""], ["V", "Supply", "", "5", "V"]], None, [("(1)", "note")], 7, [9])]
    specs = tb.spec_records(spark.createDataFrame(rows, TABLES)).cache()
    a, b = specs.orderBy("row_index").collect()
    assert (a.row_index, a.symbol, a.unit, a.unit_canonical, a.cited_markers, a.page, a.table_conditions) == (0, "I_Q", " µA", "µA", ["(1)"], 9, "")
    assert (b.row_index, b.page, b.cited_markers) == (2, 7, [])
    assert lk.find_specs(lk.with_lowered(specs), symbol="i_q", section="4.").count() == 1 and lk.find_specs(specs, name="nix").count() == 0
    (ans,) = lk.format_answers(specs, ["part_number"], limit=1).collect()
    assert ans.answer == "Quiescent (1) (I_Q): 1/2  µA — §4.1, p.9 [table 0 row 0]\n  (1) note\n... and 1 more matches"
    assert tb.spec_records(spark.createDataFrame([], TABLES)).count() == 0
    assert [r.symbols for r in tb.key_symbols(spark.createDataFrame(rows, TABLES)).collect()] == [["I_Q"]]


def test_table_texts(one):
    grid = F.array(texts("a|b", "c\nd"), texts('x,"y"', None))
    assert one(tb.grid_markdown(texts("h", "h"), grid), tb.grid_csv(texts("h", "h"), grid), tb.grid_csv(texts(), F.array(texts("")))) == [
        '| h | h |\n| --- | --- |\n| a\\|b | c d |\n| x,"y" |  |', 'h,h_2\na|b,"c\nd"\n"x,""y""",\n', '""\n']
    assert one(tb.disambiguate(texts("a", "a", "b", "a"))) == [["a", "a_2", "b", "a_3"]]
    note = lambda m: F.struct(s(m).alias("marker"), s("t" + m).alias("text"))
    assert [f.marker for f in one(tb.attach_footnotes(F.array(note("1"), note("2")), F.array(note("2"), note("3"))))[0]] == ["1", "2", "3"]
    audit = one(tb.footnote_audit(texts("1", "9"), F.array(note("1"), note("2"))))[0]
    assert (audit.orphans, audit.uncited, audit.ok) == (["9"], ["2"], False)


def test_spans_fill_the_grid():
    assert expand([[("A", 2, 1), ("x", 1, 2)], [("y", 1, 1)], []]) == [["A", "x", "x"], ["A", "y", ""], ["", "", ""]]
    assert expand([[("A", 3, 1), ("B", 1, 1)], [], [("c", 1, 1)]]) == [["A", "B"], ["A", ""], ["A", "c"]]
    got = html_table("<table><thead><tr><th rowspan=2>P</th><th colspan=2>V</th></tr><tr><th>min</th><th>max</th></tr></thead><tr><td>a<sup>(1)</sup><td>1<td>2</table>")
    assert got == {"headers": ["P", "V min", "V max"], "grid": [["a(1)", "1", "2"]], "cited_markers": ["(1)"]}
    with pytest.raises(ValueError, match="no table"):
        html_table("<p>x</p>")


def test_viewer_pages(spark):
    main = '<a id="4.1" data-navtitle="Limits" href="//h/document-viewer/X/datasheet/GUID-1#GUID-1">z</a><a href="//h/document-viewer/X/datasheet/GUID-0" data-navtitle="123"></a><a href="/other">o</a>'
    assert toc_entries(main * 2)[0][1:] == ("4.1", "Limits", 2, "https://h/document-viewer/X/datasheet/GUID-1#GUID-1")
    toc = parse_toc(spark.createDataFrame([("d", main * 2), ("e", None)], "doc string, html string"), "doc")
    assert [(r.doc, r.number) for r in toc.collect()] == [("d", "4.1")]
    page = '<div id="GUID-1" class="subsection"><h2>4.1 Limits</h2><span class="caption">Cap</span><table><tr><td>a</td></tr></table><div class="tablenote">(1) n</div><p>Request full data sheet</p><p>T<sub>A</sub> x</p></div>'
    cache = spark.createDataFrame([("https://h/document-viewer/X/datasheet/GUID-1#GUID-1", page)], "url string, html string")
    (r,) = extract_sections(toc, cache).collect()
    assert r.section.paragraphs == ["TA x"] and r.section.tables[0].caption == "Cap" and r.section.tables[0].footnotes[0].marker == "(1)" and r.section.error is None
    bad = cache.withColumn("html", F.lit("<p>nothing</p>"))
    assert extract_sections(toc, bad).first().section.error.startswith("no section")
    with pytest.raises(Exception, match="no cached page"):
        extract_sections(toc, cache.limit(0)).collect()
    with pytest.raises(ValueError, match="no section"):
        parse_section("", "")


TOC = "doc_hash string, pos int, number string, title string, level int, page int"


def test_ranges_and_ownership(spark):
    toc = spark.createDataFrame([("d", 0, "1", "a", 1, 1), ("d", 1, "1.1", "b", 2, 2), ("d", 2, "", "c", 1, 3), ("d", 3, "2", "e", 1, 6), ("d", 4, "9", "f", 1, None)], TOC)
    assert sorted((r.number, r.page_start, r.page_end) for r in rg.ranges_from_outline(toc).collect()) == [("1", 1, 5), ("1.1", 2, 5), ("2", 6, 6)]
    ends = rg.ranges_to_document_end(toc, spark.createDataFrame([("d", 9)], "doc_hash string, last_page int"))
    assert sorted((r.pos, r.page_start, r.page_end) for r in ends.collect()) == [(0, 1, 2), (1, 2, 2), (2, 3, 5), (3, 6, 9)]
    assert sorted((r.pos, r.page) for r in rg.owned_by_deeper(ends).where("owned").collect()) == [(0, 2)]
    q = spark.createDataFrame([(1, "d", [2, 2, 4]), (2, "d", []), (3, "x", [1])], "question_id long, doc_hash string, pages array<int>")
    sec = spark.createDataFrame([("d", "f1", 1, 3), ("d", "f2", 4, None), ("d", "f3", None, 9)], "doc_hash string, file string, page_start int, page_end int")
    assert sorted(map(tuple, rg.covering_sections(q, sec).collect())) == [(1, "f1"), (1, "f2")]


def test_page_cascade(spark):
    toc = spark.createDataFrame([("d", 0, "1", "Features", 1, 1), ("d", 1, "2", "RX Typical Characteristics at 1.75 GHz", 1, 4), ("d", 2, "3", "Rest", 1, None)], TOC)
    rows = [("d", 0, "1", "zzz", 1), ("d", 1, "", "Features!", 1), ("d", 2, "", "RX Typical Characteristics at 1.9 GHz", 1), ("d", 3, "", "Child", 2), ("d", 4, "", "Grandchild", 3), ("d", 5, "", "Sibling", 2), ("d", 6, "3", "Unpaged", 1), ("e", 0, "", "Alone", 1)]
    out = pg.assign_pages(spark.createDataFrame(rows, "doc_hash string, sec_pos int, number string, title string, level int"), toc).cache()
    got = {(r.doc_hash, r.sec_pos): (r.method, r.page_start) for r in out.collect()}
    assert [got["d", i] for i in range(7)] == [("exact", 1), ("title", 1), ("fuzzy", 4), ("inherited", 4), ("inherited", 4), ("unmatched", None), ("unmatched", None)]
    assert got["e", 0] == ("unmatched", None)
    rep = {r.doc_hash: r for r in pg.assignment_report(out).collect()}
    assert (rep["d"].n_exact, rep["d"].n_fuzzy, rep["d"].n_inherited, rep["d"].n_unmatched, rep["e"].coverage) == (1, 2, 2, 2, 0.0)


def test_pins_and_deltas(spark):
    t = spark.createDataFrame([(1, "d", "1", [["V_REF", "1.25 V", "12"], ["I_Q", "30 mA", None]]), (2, "d", "1", [["a"]]), (3, "d", "9", [["V_REF", "1.25 V"]])], "table_id long, doc_hash string, section string, grid array<array<string>>")
    r = spark.createDataFrame([("d", "1", 2, 4)], "doc_hash string, section string, page_start int, page_end int")
    p = spark.createDataFrame([("d", 1, "V_REF 1.25V I_Q 30mA"), ("d", 3, "vref 1.25 v"), ("d", 4, "V REF, 1.25V")], "doc_hash string, page int, text string")
    assert list(map(tuple, pg.pin_table_pages(t, r, p).collect())) == [(1, 3, 2)]
    rows = spark.createDataFrame([("d", "Alpha", 1), ("d", "Beta", 2)], "doc_hash string, title string, page int")
    pages = spark.createDataFrame([("d", 2, "alpha"), ("d", 3, "BETA"), ("d", 1, "alpha")], "doc_hash string, page int, text string")
    assert list(map(tuple, pg.printed_page_delta(rows, pages).collect())) == [("d", 1)]
    lines = [("d", 1, i, 50.0 + 10 * (i % 2), f"{i}.1 Part {i} ..... {i}") for i in range(4)] + [("d", 2, 0, 50.0, "note .... 3")]
    toc = pg.table_of_contents(spark.createDataFrame(lines, "doc_hash string, page int, line_no int, x double, text string"))
    assert sorted((x.number, x.title, x.level, x.printed_page) for x in toc.collect()) == [(f"{i}.1", f"Part {i}", 1 + i % 2, i) for i in range(4)]


def test_verification(spark):
    q = spark.createDataFrame(
        [(1, "d", ["5 V", "ok"], [1], False), (2, "d", ["5 V"], [9], False), (3, "d", ["x"], [1], True), (4, "d", ["nope"], [1], False), (5, "d", None, None, False)],
        "question_id long, doc_hash string, expected_substrings array<string>, pages array<int>, is_plot boolean",
    )
    sec = spark.createDataFrame([("d", "b.md", 1, 2, "has 5V"), ("d", "a.md", 1, 1, "all ok")], "doc_hash string, file string, page_start int, page_end int, text string")
    pages = spark.createDataFrame([("d", 1, "5 V ok")], "doc_hash string, page int, text string")
    res = vf.verify_questions(q, sec, pages).cache()
    got = {r.question_id: (r.corpus_contains, r.page_truth, r.matched_files, r.missing) for r in res.collect()}
    assert got == {1: (True, True, ["a.md", "b.md"], []), 2: (False, False, [], ["5 V"]), 3: (True, True, [], []), 4: (False, False, ["a.md", "b.md"], ["nope"]), 5: (False, False, [], [])}
    (sm,) = vf.summarize(res).collect()
    assert (sm.total, sm.passed, sm.failed, sm.accuracy, sm.without_section) == (5, 2, 3, 0.4, 3)
    assert vf.summarize(res.limit(0)).first().accuracy == 0.0
    (e,) = vf.lookup_economics(res, sec, q, 10).collect()
    assert (e.avg_per_question, e.max_per_question, e.full_dump_tokens) == (10.8, 12, 4)


def test_lookups_of_questions(spark):
    q = spark.createDataFrame([(1, "d", ["5"], [2], {"symbol": "V"}, {"caption_contains": "gain"}), (2, "d", ["6"], [2], {"symbol": "V"}, {"section": "9"}), (3, "d", [], [2], None, None)],
                              "question_id long, doc_hash string, expected_substrings array<string>, pages array<int>, spec_query map<string,string>, plot_query map<string,string>")
    specs = tb.spec_records(spark.createDataFrame([(1, "d", "P", "4", 0, ["Parameter", "Value", "Unit"], [["V_X", "5", "V"]], None, None, 2, None)], TABLES))
    assert sorted(map(tuple, vf.verify_specs(q, specs).collect())) == [(1, True), (2, False)]
    figs = spark.createDataFrame([("d", 0, "4", "TX 1 GHz", 0, "Figure 2. Gain flatness", "25 C", 2, 2, ""), ("d", 1, "", "My DAC", 0, "x", "", None, None, "")],
                                 "doc_hash string, sec_pos int, number string, title string, fig_pos int, caption string, conditions string, page_start int, page_end int, image_url string")
    plots = fg.plot_records(figs).cache()
    assert sorted((p.id, p.figure_number, p.tags) for p in plots.collect()) == [("4-f001", "2", ["tx", "1000mhz", "flatness"]), ("my-dac-f001", "", [])]
    assert sorted(map(tuple, vf.verify_plots(q, plots).collect())) == [(1, True), (2, False)]
    assert fg.find_plots(plots, q="gain flatness 25", tags=["TX"]).count() == 1 and fg.find_plots(plots, section="4", tags=["rx"]).count() == 0
    assert sorted(r.a for r in plots.select(fg.plot_answer_line().alias("a")).collect()) == ["Figure 2. Gain flatness — §4 (p.2) — 25 C", "x — § (?)"]
    img = spark.createDataFrame([("p", 0, "u0", b"ab"), ("p", 1, "u1", b"cd"), ("p", 2, "u2", None)], "plot_id string, variant int, url string, data binary")
    assert fg.largest_images(img).first().url == "u0"


def test_inventory(spark):
    src = spark.createDataFrame([(2, "h1"), (1, "h1"), (3, "h2")], "source_id long, content_hash string")
    old = spark.createDataFrame([(9, "h2")], src.schema)
    once = inv.append_inventory(old, src)
    assert sorted(map(tuple, once.collect())) == [(1, "h1"), (9, "h2")] == sorted(map(tuple, inv.append_inventory(once, src).collect()))
    v = [inv.vendor_of(s(a), s(b)) for a, b in (("x Analog Devices", "qorvo.pdf"), ("x", "Qorvo.pdf"), (None, None))]
    assert [tuple(x) for x in spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(v)]).first()] == [("adi", 'brand:"analog devices" (p.1)'), ("qorvo", 'brand:"qorvo" (filename)'), ("ti", "")]
    b = [inv.backend_of(s(a), s(d), r) for a, d, r in (("ti", "datasheet", ["pdf_layout"]), ("ti", "datasheet", ["ti_html", "pdf_layout"]), ("adi", "errata", []), ("adi", "datasheet", []))]
    assert list(spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(b)]).first()) == ["pdf_layout", "ti_html", "pdf_text", None]


def test_index(spark):
    sec = spark.createDataFrame([("P", "1", "One", "f1", 1, 2, 40, 1, 0, "word " * 60), ("P", "2", "Two", "f2", None, None, 9, 0, 3, "")],
                                "part string, number string, title string, file string, page_start int, page_end int, token_count int, n_tables int, n_figures int, description string")
    pick = {b: index_ladder(sec, ["part"], budget=b, conventions_tokens=10).first() for b in (3000, 60, 30, 1)}
    assert [(pick[b].desc_budget, pick[b].with_conventions, pick[b].fits) for b in (3000, 60, 30, 1)] == [(30, True, True), (20, True, True), (0, False, True), (0, False, False)]
    pick_zero = lambda df: index_ladder(df, ["part"], budget=30, conventions_tokens=10)
    lines = [r.line for r in index_lines(sec, pick_zero(sec), ["part"]).orderBy("number").collect()]
    assert lines == ["- **1 One** — p.1-2 — `f1` (40 tok, 1 tables)", "- **2 Two** — p.? — `f2` (9 tok, 3 figs)"]
    d = spark.range(1).select(describe(texts("This is a fine sentence. x"), texts("A", "B"), F.lit(2)).alias("a"), describe(texts(), texts(), F.lit(0)).alias("b")).first()
    assert tuple(d) == ("This is a fine sentence. Parameters: A, B. 2 plots.", "(no content)")
    one = spark.sql("""select '4' number, 'Lim' title, 2 page_start, 3 page_end, array('para') paragraphs,
        array(named_struct('caption', '', 'conditions', 'VDD', 'headers', array('h'), 'grid', array(array('1')), 'footnotes', array(named_struct('marker', '(1)', 'text', 'n')), 'csv_file', 'tables/t.csv')) tables,
        array(named_struct('caption', 'Figure 1. x', 'conditions', '', 'page', 3)) figures""")
    md = one.select(section_markdown(F.lit("Rev. A")).alias("m")).first().m
    assert md == ("# 4 Lim\n\n<!-- source: Rev. A p.2-3 -->\n\npara\n\n## Unnumbered table\n\n> **Test conditions:** VDD\n\n| h |\n| --- |\n| 1 |\n\n**Footnotes:**\n\n- (1) n\n\n*Machine-readable: `tables/t.csv`*\n\n## Figures\n\n- **Figure 1. x** (p.3)\n")
