"""Layout on a page of our own: 612 x 792 points, six columns."""

import pandas as pd

from sheetloom.operators import reconstruct as rc
from sheetloom.operators.layout import Entry, entry_ranges, extract_document, extract_layout, figure_anchors, figure_title_anchors, printed_toc, read_pages

LEFTS = [56, 222, 435, 460, 515, 548]
HEADER = ["Parameter", "Test Conditions", "Min", "Typ", "Max", "Unit"]


class Sheet:
    """Collects spans; every text is one line in a block of its own."""

    def __init__(self):
        self.spans, self.boxes, self.no = [], [], 0

    def line(self, page, y, *parts, size=8.0, block=None):
        self.no += 1
        for k, (x, text, *more) in enumerate(parts):
            s = more[0] if more else size
            up = more[1] if len(more) > 1 else 0.0
            self.spans.append((page, self.no if block is None else block, self.no, k, float(x), x + 4.0 * len(text), y - up, y + s - up, s, text))

    def row(self, page, y, cells, indent=0.0):
        self.line(page, y, *[(x + (indent if i == 0 else 0), c) for i, (x, c) in enumerate(zip(LEFTS, cells, strict=True)) if c])

    def frames(self):
        spans = pd.DataFrame(self.spans, columns=["page", "block", "line_no", "span_no", "x0", "x1", "y0", "y1", "size", "text"])
        return spans, pd.DataFrame(self.boxes, columns=["page", "x0", "y0", "x1", "y1"])

    def extract(self, toc=()):
        return list(extract_document("d", *self.frames(), list(toc)))


def spec_table(sheet, page=1, y=100.0, caption="Table 3. DAC Limits", rows=4):
    sheet.line(page, y - 36, (56, "Nominal supplies, unless noted."))
    sheet.line(page, y - 16, (56, caption))
    sheet.row(page, y, HEADER)
    for i in range(rows):
        sheet.row(page, y + 13 * (i + 1), [f"Gain {i}", "VDD = 1 V" if i % 2 else "", "", f"{i}.5", "9" if i else "", "dB"])
    return y + 13 * (rows + 1)


def test_a_captioned_table_is_rebuilt():
    s = Sheet()
    end = spec_table(s)
    s.line(1, end + 4, (56, "1 Measured with the supply of the evaluation board attached to it."))
    s.line(1, end + 60, (56, "Plain closing text that, as a longer sentence, belongs to no table at all."))
    (sec,) = s.extract()
    (t,) = sec["tables"]
    assert t["headers"] == HEADER and len(t["grid"]) == 4 and t["grid"][1] == ["Gain 1", "VDD = 1 V", "", "1.5", "9", "dB"]
    assert t["caption"] == "Table 3. DAC Limits" and t["conditions"] == "Nominal supplies, unless noted."
    assert t["footnotes"] == [{"marker": "1", "text": "Measured with the supply of the evaluation board attached to it."}]
    assert sec["paragraphs"] == ["Plain closing text that, as a longer sentence, belongs to no table at all."]
    assert (sec["tables_detected"], sec["tables_accepted"], sec["tables_rejected"], sec["ladder"]) == (1, 1, 0, "per_page")
    assert 0 < sec["mean_fidelity"] < 1


def test_a_table_goes_on_over_the_page():
    s = Sheet()
    spec_table(s, 1)
    s.line(2, 144, (56, "Table 3. DAC Limits"))
    s.row(2, 160, HEADER)
    s.row(2, 173, ["", "VDD = 2 V", "", "7.5", "", "dB"])
    s.row(2, 186, ["Offset", "", "", "8.5", "", "dB"])
    secs = s.extract()
    (t,) = secs[0]["tables"]
    assert t["grid"][4:] == [["Gain 3", "VDD = 2 V", "", "7.5", "", "dB"], ["Offset", "", "", "8.5", "", "dB"]]
    assert t["row_pages"] == [1] * 4 + [2] * 2 and secs[1]["tables"] == [] and secs[0]["tables_detected"] == 2


def test_indented_children_and_blank_cells_get_their_parameter():
    cells = [["Range", "", "", ""], ["AC", "", "1", ""], ["", "", "2", ""], ["Next", "", "3", ""]]
    rc.spread_first_column(cells, [0.0, 13.0, 26.0, 39.0], [62.4, 72.0, None, 56.0], 56.0)
    assert [c[0] for c in cells] == ["Range", "Range AC", "Range AC", "Next"]


def test_reasons_of_rejection():
    def row(y, *xs):
        return rc.Row([rc.Line(0, 0, y, xs[0], "x", tuple(rc.Span(x, x + 9, y, y + 8, 8.0, "abc") for x in xs))])

    assert rc.rejection([row(0, 50, 200)], rc.Bands([50, 200]), [], 0, 9) == "fewer than 2 rows"
    assert rc.rejection([row(0, 50), row(13, 50)], rc.Bands([50]), [], 0, 9) == "single column"
    assert rc.rejection([row(0, 40, 200), row(13, 50, 200)], rc.Bands([50, 200]), [], 0, 9) == "words fall outside the column bands"
    fused = [row(y, 50, 150, 300) for y in (0, 13, 26)]
    assert rc.rejection(fused, rc.Bands([50, 300]), [], 0, 99) == "side-by-side columns fused into one band"
    ragged = [row(0, 50, 200), row(13, 50), row(26, 50), row(39, 50), row(52, 50)]
    assert rc.rejection(ragged, rc.Bands([50, 200]), [], 0, 99) == "columns not stable across rows"
    full = [row(y, 50, 200) for y in (0, 13, 26, 39)]
    assert rc.rejection(full, rc.Bands([50, 200]), [], 0, 99) == "occupancy pattern not tabular"
    assert rc.rejection(full, rc.Bands([50, 200]), [(120.0, 0.0, 50.0)], 0, 99) is None


def test_rows_are_anchored_not_chained():
    lines = [rc.Line(i, 0, y, 0.0, "a", ()) for i, y in enumerate([0.0, 1.5, 3.0, 13.0, 14.9, 15.1])]
    assert [[ln.y for ln in r.lines] for r in rc.baseline_rows(lines)] == [[0.0, 1.5], [3.0], [13.0, 14.9], [15.1]]
    assert rc.cluster_starts([1.0, 5.0, 9.0, 30.0, 30.04], 6.0) == [1.0, 30.0]


def test_raised_markers_are_cited():
    spans = (rc.Span(50, 80, 10, 18, 8.0, "Coupling"), rc.Span(80.5, 83, 8, 13, 5.0, "2"), rc.Span(200, 204, 10, 18, 8.0, "7"), rc.Span(204.2, 207, 15, 20, 5.0, "0"))
    assert rc.row_markers(rc.Row([rc.Line(0, 0, 10, 50, "x", spans)])) == ["2"]


def test_furniture_headings_and_ownership():
    s = Sheet()
    for p in (1, 2, 3):
        s.line(p, 30, (250, "Acme DAC9 sheet"))
        s.line(p, 760, (300, f"Page {p} of 3"))
    s.line(1, 100, (56, "1 Features"), size=14.0)
    s.line(1, 120, (56, "Fast and small."))
    s.line(2, 100, (56, "2 Specifications"), size=14.0)
    s.line(2, 120, (56, "2.1 Limits"), size=12.0)
    s.line(2, 140, (56, "Keep cool."))
    s.line(3, 100, (56, "Rest of the limits."))
    toc = [Entry("1", "Features", 1, 1), Entry("2", "Specifications", 1, 2), Entry("2.1", "Limits", 2, 2)]
    secs = s.extract(toc)
    assert [(x["number"], x["page_start"], x["page_end"], x["paragraphs"]) for x in secs] == [("1", 1, 1, ["Fast and small."]), ("2", 2, 3, []), ("2.1", 2, 3, ["Keep cool.", "Rest of the limits."])]


def test_mirrored_headers_are_two_tables():
    s = Sheet()
    s.line(1, 80, (56, "Absolute Ratings"), size=14.0)
    xs = [56, 180, 330, 450]
    s.line(1, 100, *zip(xs, ["Parameter", "Value", "Parameter", "Value"], strict=True))
    for i in range(4):
        y = 113 + 13 * i
        s.line(1, y, *[(x, c) for x, c in zip(xs, [f"A{i}", "5 V" if i < 3 else "", f"B{i}", "7 V" if i else ""], strict=True) if c])
    (sec,) = s.extract()
    assert [t["headers"] for t in sec["tables"]] == [["Parameter", "Value"]] * 2
    assert sec["tables"][0]["grid"][0] == ["A0", "5 V"] and sec["tables"][1]["grid"][0] == ["B0", ""]


def test_figures_with_caption_and_with_title():
    s = Sheet()
    s.line(1, 200, (56, "Figure 2. Gain over time"))
    s.line(1, 300, (60, "Functional Block Diagram"), size=14.0)
    s.boxes += [(1, 50.0, 296.0, 300.0, 316.0), (1, 50.0, 320.0, 300.0, 500.0)]
    s.line(1, 220, (56, "See Figure 2 for more."))
    (sec,) = s.extract()
    assert [f["caption"] for f in sec["figures"]] == ["Figure 2. Gain over time", "Functional Block Diagram"]
    assert sec["paragraphs"] == ["See Figure 2 for more."]


def test_printed_contents_lead_the_sections():
    s = Sheet()
    for i, (t, p) in enumerate([("Features", 1), ("Limits", 2), ("Package", 3)]):
        s.line(1, 100 + 13 * i, (56, f"{i + 1} {t} ........ {p}"))
        s.line(p + 1, 100, (56, f"{t} text follows here"))
    pages = read_pages(*s.frames(), 4)
    assert [(e.number, e.title, e.level, e.page) for e in printed_toc(pages)] == [("1", "Features", 1, 2), ("2", "Limits", 1, 3), ("3", "Package", 1, 4)]


def test_an_outline_is_held_against_the_printed_contents():
    s = Sheet()
    for i, (t, p) in enumerate([("Features", 1), ("Limits", 2), ("Package", 3)]):
        s.line(1, 100 + 13 * i, (56, f"{i + 1} {t} ........ {p}"))
        s.line(p + 1, 100, (56, f"{t} text follows here"))
    secs = s.extract([Entry("1", "Features", 1, 2), Entry("3", "Package", 1, 4)])
    assert secs[0]["ladder"] == "outline" and secs[0]["warning"] == "outline lacks 1 printed titles: Limits"


def test_title_clips(spark):
    lines = [("d", 1, 1, 60.0, 300.0, "Functional Block Diagram", 14.0), ("d", 1, 2, 60.0, 500.0, "Second Long Title", 14.0), ("d", 1, 3, 60.0, 650.0, "small print down here", 8.0)]
    boxes = [("d", 1, 50.0, 296.0, 300.0, 316.0), ("d", 1, 50.0, 496.0, 300.0, 516.0), ("d", 1, 50.0, 320.0, 300.0, 490.0)]
    got = figure_title_anchors(spark.createDataFrame(lines, "doc_hash string, page int, line_no int, x double, y double, text string, size double"), spark.createDataFrame(boxes, "doc_hash string, page int, x0 double, y0 double, x1 double, y1 double"))
    assert sorted((r.key, r.y0, r.y1) for r in got.collect()) == [("functionalblockdiagram", 296.0, 496.0), ("secondlongtitle", 496.0, 690.0)]


def test_ranges_close_at_the_next_entry_up():
    e = [Entry("1", "a", 1, 2), Entry("1.1", "b", 2, 3), Entry("", "c", 2, None), Entry("2", "d", 1, 5), Entry("3", "e", 1, 99)]
    assert entry_ranges(e, 9) == [(2, 4), (3, 4), None, (5, 9), (9, 9)]


def test_documents_run_in_one_job(spark):
    s = Sheet()
    spec_table(s)
    spans, boxes = s.frames()
    a = spark.createDataFrame(pd.concat([spans.assign(doc_hash=d) for d in ("x", "y")]))
    b = spark.createDataFrame([], "doc_hash string, page long, x0 double, y0 double, x1 double, y1 double")
    toc = spark.createDataFrame([("y", 0, "1", "All", 1, 1)], "doc_hash string, pos int, number string, title string, level int, page int")
    got = sorted((r.doc_hash, r.ladder, r.title, len(r.tables), r.tables[0].grid[0][0]) for r in extract_layout(a, b, toc).collect())
    assert got == [("x", "per_page", "Page 1", 1, "Gain 0"), ("y", "outline", "All", 1, "Gain 0")]
    assert extract_layout(a.limit(0), b, toc.limit(0)).count() == 0


def test_figure_clips(spark):
    lines = [("d", 1, i, x, y, t) for i, (x, y, t) in enumerate([(50.0, 200.0, "Figure 1. A"), (300.0, 205.0, "Figure 2. B"), (300.0, 206.0, "no figure"), (50.0, 400.0, "Figure 3: C")])]
    rows = figure_anchors(spark.createDataFrame(lines, "doc_hash string, page int, line_no int, x double, y double, text string")).collect()
    assert sorted((r.key, r.y0, r.y1) for r in rows) == [("figure1a", 0.0, 200.0), ("figure2b", 0.0, 205.0), ("figure3c", 217.0, 400.0)]
