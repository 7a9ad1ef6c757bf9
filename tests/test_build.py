import pandas as pd
import pytest

from sheetloom.cli import main
from sheetloom.sources.cache import ExtractionCache
from sheetloom.sources.readers import read_inventory, read_manifests, read_plots, read_specs
from test_layout import Sheet, spec_table


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    s = Sheet()
    s.line(1, 40, (56, "1 Features"), size=14.0)
    s.line(1, 60, (56, "Everything about the amplifier is fast and small and cheap."))
    end = spec_table(s, 2)
    s.line(2, end + 80, (56, "Figure 2. Gain bandwidth over time"))
    spans, boxes = s.frames()
    spans = spans.assign(doc_hash="aaaaaaaa11")
    broken = spans.assign(doc_hash="cccccccc33", page=0)
    put = lambda df, name: df.write.parquet(f"{root}/{name}.parquet")
    put(spark.createDataFrame([("P1", "aaaaaaaa11", "datasheet", "Rev. A", "a.pdf", 2), ("P1", "bbbbbbbb22", "errata", "", "b.pdf", 2), ("P2", "cccccccc33", "datasheet", "", "c.pdf", 1)], "part_number string, content_hash string, doc_type string, revision string, path string, page_count int"), "sources")
    put(spark.createDataFrame(pd.concat([spans, broken])), "page_spans")
    put(spark.createDataFrame([], "doc_hash string, page long, x0 double, y0 double, x1 double, y1 double"), "page_drawings")
    put(spark.createDataFrame([("aaaaaaaa11", 0, "1", "Features", 1, 1), ("aaaaaaaa11", 1, "2", "Limits", 1, 2)], "doc_hash string, pos int, number string, title string, level int, page int"), "toc")
    put(spark.createDataFrame([("bbbbbbbb22", 1, "Erratum one\n1\nUse 5 V"), ("bbbbbbbb22", 2, "two"), ("aaaaaaaa11", 2, "Gain 1 VDD = 1 V 1.5 9 dB")], "doc_hash string, page int, text string"), "pages")
    return root


@pytest.fixture(scope="module")
def corpus(folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    assert main(["build", str(folder), "--corpus", out]) == 1  # one document is broken
    return out


def test_the_corpus_is_complete(spark, corpus):
    stats = {r.part_number: r for r in spark.read.parquet(f"{corpus}/tables/stats").collect()}
    assert (stats["P1"].n_sections, stats["P1"].n_tables, stats["P1"].n_figures, stats["P1"].n_specs, stats["P1"].failed_documents) == (4, 1, 1, 4, 0)
    assert stats["P2"].failed_documents == 1 and "Error" in stats["P2"].error
    index = open(f"{corpus}/parts/P1/INDEX.md", encoding="utf-8").read()
    assert index.startswith("# P1 — datasheet corpus\n") and "## Section map — `datasheet-aaaaaaaa`" in index and "**2 Limits** — p.2" in index and "`errata`" in index
    row = spark.read.parquet(f"{corpus}/tables/index").where("part_number = 'P1'").first()
    assert row.markdown == index and row.tokens == -(-len(index) // 4) and row.step == 0
    limits = open(f"{corpus}/parts/P1/docs/datasheet-aaaaaaaa/sections/001-2-limits.md", encoding="utf-8").read()
    assert limits.startswith("# 2 Limits\n\n<!-- source: Rev. A p.2 -->\n") and "## Table 3. DAC Limits" in limits and "*Machine-readable: `tables/001-2-limits-t01.csv`*" in limits and limits.endswith("(p.2)\n")
    assert open(f"{corpus}/parts/P1/docs/datasheet-aaaaaaaa/tables/001-2-limits-t01.csv").read().startswith("Parameter,Test Conditions,Min,Typ,Max,Unit\nGain 0,,,0.5,,dB\n")
    (listed,) = [m for m in read_manifests(spark, f"{corpus}/parts/*/manifest.json").collect() if m.part_number == "P1"]
    assert len(listed.sections) == 4 and listed.sections[1].file.endswith("001-2-limits.md") and {d.status for d in listed.documents} == {"done"}
    specs = read_specs(spark, f"{corpus}/parts/*/docs/*/specs.json").orderBy("pos").collect()
    assert [(s.name or s.symbol, s.typ, s.unit.verbatim) for s in specs][:2] == [("Gain 0", "0.5", "dB"), ("Gain 1", "1.5", "dB")]
    assert [p.caption for p in read_plots(spark, f"{corpus}/parts/*/docs/*/plots.json").collect()] == ["Figure 2. Gain bandwidth over time"]
    assert stats["P1"].n_footnotes == 0 and stats["P1"].lines_removed == 0
    plain = spark.read.parquet(f"{corpus}/tables/sections").where("doc_hash = 'bbbbbbbb22'").orderBy("sec_pos").collect()
    assert [(r.title, r.paragraphs) for r in plain] == [("Page 1", ["Erratum one", "Use 5 V"]), ("Page 2", ["two"])]


def test_lookups(corpus, capsys):
    assert main(["query", "--corpus", corpus, "--part", "P1", "--section", "2"]) == 0
    assert "table 0 row 0" in capsys.readouterr().out
    assert main(["query", "--corpus", corpus, "--part", "P1", "--symbol", "zz"]) == 1
    assert main(["query", "--corpus", corpus, "--part", "NIX"]) == 2
    assert main(["plots", "--corpus", corpus, "--part", "P1", "--q", "gain", "--tag", "bandwidth"]) == 0
    assert "Figure 2. Gain bandwidth over time — §2 (p.2)" in capsys.readouterr().out
    assert main(["plots", "--corpus", corpus, "--part", "P1", "--tag", "dsa"]) == 1
    assert main(["status", "--corpus", corpus]) == 0 and main(["version"]) == 0


def test_verification(folder, corpus, tmp_path, capsys):
    golden = tmp_path / "q.yaml"
    golden.write_text("questions:\n- {id: a, question: 'Gain of 1?', expected_substrings: ['1.5'], pages: [2]}\n")
    assert main(["verify", "--corpus", corpus, "--part", "P1", "--golden", str(golden), "--pages", f"{folder}/pages.parquet"]) == 0
    assert "1/1 passed (100%)" in capsys.readouterr().out
    assert main(["verify", "--corpus", corpus, "--part", "P1", "--golden", str(golden)]) == 1
    capsys.readouterr()
    golden.write_text("questions:\n- {id: a, question: 'Gain of 1?', expected_substrings: ['1.5'], pages: [2], spec_query: {symbol: 'gain 1'}}\n- {id: b, question: 'Plot?', pages: [2], plot_query: {caption_contains: bandwidth}}\n")
    assert main(["verify", "--corpus", corpus, "--part", "P1", "--golden", str(golden), "--pages", f"{folder}/pages.parquet", "--specs"]) == 0
    out = capsys.readouterr().out
    assert "Spec record found" in out and "Plot found" in out and "❌" not in out
    assert main(["verify", "--corpus", corpus, "--part", "P1", "--golden", str(tmp_path / "nix.yaml")]) == 2
    golden.write_text("questions: []\n")
    assert main(["verify", "--corpus", corpus, "--part", "P1", "--golden", str(golden)]) == 2


def test_documents_are_registered_once(spark, corpus, tmp_path, capsys):
    file = tmp_path / "dac9-datasheet.pdf"
    file.write_bytes(b"%PDF")
    add = ["add-doc", "--corpus", corpus, "--part", "P9", str(file)]
    assert main(add) == 0 and main(add) == 0
    assert capsys.readouterr().out.splitlines() == ["P9: 1 documents"] * 2
    row = read_inventory(spark, f"{corpus}/parts/P9/sources.json").first()
    assert (row.doc_type, row.vendor, row.part_number) == ("datasheet", "ti", "P9")
    assert main([*add, "--vendor", "nobody"]) == 2 and main(["add-doc", "--corpus", corpus, "--part", "P9", "nix.pdf"]) == 2
    assert read_inventory(spark, f"{corpus}/parts/P0/sources.json").count() == 0


def test_only_what_changed_is_built_again(spark, folder, corpus, capsys):
    assert main(["build", str(folder), "--corpus", corpus]) == 1
    out = capsys.readouterr().out
    # the broken part is tried again, the good one isn't
    assert "P1: skipped" in out and "P2: failed" in out and "0 done, 1 failed, 1 skipped" in out
    ledger = {r.content_hash: r for r in spark.read.parquet(f"{corpus}/tables/documents").collect()}
    assert (ledger["aaaaaaaa11"].status, ledger["aaaaaaaa11"].tables_accepted, ledger["cccccccc33"].status) == ("done", 1, "failed")
    assert spark.read.parquet(f"{corpus}/cache/extract").select("doc_hash").distinct().count() == 2
    assert main(["build", str(folder), "--corpus", corpus, "--force"]) == 1
    assert "1 done, 1 failed, 0 skipped" in capsys.readouterr().out
    assert spark.read.parquet(f"{corpus}/cache/extract").count() == 4


def test_no_document_is_dropped(spark, folder, tmp_path, capsys):
    root, out = tmp_path / "in", str(tmp_path / "out")
    for name in ("page_spans", "page_drawings", "toc", "pages"):
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        if name == "toc":  # an outline without pages, of a companion and of a datasheet; one without page texts
            df = df.where("doc_hash <> 'aaaaaaaa11'").unionByName(spark.createDataFrame([("bbbbbbbb22", 0, "1", "Nowhere", 1, None), ("aaaaaaaa11", 0, "1", "Nowhere", 1, None), ("gggggggg77", 0, "1", "One", 1, 1)], df.schema))
        if name == "pages":
            df = df.unionByName(spark.createDataFrame([("dddddddd44", 1, "Typeless")], df.schema))
        df.write.parquet(f"{root}/{name}.parquet")
    rows = [("P1", "aaaaaaaa11", "datasheet"), ("P1", "bbbbbbbb22", "errata"), ("P3", "dddddddd44", None), ("P3", "eeeeeeee55", "datasheet"), ("P4", "ffffffff66", "errata"), ("P4", "gggggggg77", "errata")]
    spark.createDataFrame([(p, h, t, "", "x.pdf", None) for p, h, t in rows], "part_number string, content_hash string, doc_type string, revision string, path string, page_count int").write.parquet(f"{root}/sources.parquet")
    assert main(["build", str(root), "--corpus", out]) == 1
    assert "1 done, 2 failed, 0 skipped" in capsys.readouterr().out
    ledger = {r.content_hash: (r.status, r.error) for r in spark.read.parquet(f"{out}/tables/documents").collect()}
    done, failed = ("done", None), ("failed", "no decoded pages")
    assert ledger == {"aaaaaaaa11": done, "bbbbbbbb22": done, "dddddddd44": done, "eeeeeeee55": failed, "ffffffff66": failed, "gggggggg77": failed}
    stats = {r.part_number: (r.n_documents, r.failed_documents) for r in spark.read.parquet(f"{out}/tables/stats").collect()}
    assert stats == {"P1": (2, 0), "P3": (1, 1), "P4": (None, 2)}
    titles = [(r.doc_hash, r.title) for r in spark.read.parquet(f"{out}/tables/sections").orderBy("doc_hash", "sec_pos").collect()]
    assert titles == [(h, f"Page {n}") for h, n in (("aaaaaaaa11", 1), ("aaaaaaaa11", 2), ("bbbbbbbb22", 1), ("bbbbbbbb22", 2), ("dddddddd44", 1))]
    index = open(f"{out}/parts/P3/INDEX.md", encoding="utf-8").read()
    assert "- `unknown`  — ? pages — `docs/unknown-dddddddd/`" in index and "`docs/datasheet-eeeeeeee/`" in index


def test_vendors_are_routed_and_tables_pinned(spark, folder, tmp_path, capsys):
    root, out = tmp_path / "in", str(tmp_path / "out")
    for name in ("page_spans", "page_drawings", "toc", "pages"):
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        if name == "toc":
            df = df.unionByName(spark.createDataFrame([("dddddddd44", 0, "4.1", "Limits", 1, 2), ("dddddddd44", 1, "5", "End", 1, 4)], df.schema))
        if name == "pages":
            df = df.unionByName(spark.createDataFrame([("dddddddd44", 2, "4.1 Limits"), ("dddddddd44", 3, "Supply 1.71 V and gain 20.5 dB")], df.schema))
        df.write.parquet(f"{root}/{name}.parquet")
    rows = [("P1", "aaaaaaaa11", "ti"), ("P2", "aaaaaaaa11", "adi"), ("P3", "dddddddd44", None), ("P4", "eeeeeeee55", "nobody")]
    spark.createDataFrame([(p, h, "datasheet", "", "x.pdf", 4, v) for p, h, v in rows], "part_number string, content_hash string, doc_type string, revision string, path string, page_count int, vendor string").write.parquet(f"{root}/sources.parquet")
    url = "//h/document-viewer/X/datasheet/GUID-"
    spark.createDataFrame([("dddddddd44", f'<a id="4.1" data-navtitle="Limits" href="{url}1">x</a><a id="5" data-navtitle="End" href="{url}2">y</a>'), ("aaaaaaaa11", None)], "doc_hash string, html string").write.parquet(f"{root}/contents.parquet")
    table = "<table><thead><tr><th>Parameter</th><th>Typ</th></tr></thead><tbody><tr><td>Supply 1.71 V</td><td>1.71</td></tr><tr><td>Gain</td><td>20.5 dB</td></tr></tbody></table>"
    page = f'<div id="GUID-1"><h2>4.1 Limits</h2><p>Text</p>{table}<div class="graph"><img src="//h/f.png" alt="Figure 1. Gain"><div class="textnote">VDD = 5 V</div></div></div>'
    spark.createDataFrame([("https:" + url + "1", page)], "url string, html string").write.parquet(f"{root}/viewer_pages.parquet")
    for _ in range(2):  # the second time from the cache, but for what failed
        assert main(["build", str(root), "--corpus", out, "--force"]) == 1
        assert "2 done, 2 failed, 0 skipped" in capsys.readouterr().out
        ledger = {(r.part_number, r.backend, r.error) for r in spark.read.parquet(f"{out}/tables/documents").collect()}
        assert ledger == {("P1", "pdf_layout", None), ("P2", "pdf_layout", None), ("P3", "ti_html", f"no cached page for https:{url}2"), ("P4", None, "no backend for the vendor")}
        one, two = spark.read.parquet(f"{out}/tables/sections").where("part_number = 'P3'").orderBy("sec_pos").collect()
        assert (one.title, one.paragraphs, one.page_start, one.page_end, [t.page for t in one.tables]) == ("Limits", ["Text"], 2, 3, [3])
        assert (two.title, two.paragraphs, two.page_start) == ("End", [], 4)
        (plot,) = spark.read.parquet(f"{out}/tables/plots").where("part_number = 'P3'").collect()
        assert (plot.caption, plot.conditions, plot.image_url) == ("Figure 1. Gain", "VDD = 5 V", "//h/f.png")
        assert {r.page for r in spark.read.parquet(f"{out}/tables/specs").where("part_number = 'P3'").collect()} == {3}


def test_cached_backends_keep_their_columns(spark, tmp_path):
    cache = ExtractionCache(spark, str(tmp_path / "c"))
    cache.store(spark.createDataFrame([("a",)], "doc_hash string"), "pdf_text", "1")
    cache.store(spark.createDataFrame([("b", 7)], "doc_hash string, tables int"), "ti_html", "1")
    cached, missing = cache.lookup(spark.createDataFrame([("a",), ("b",)], "doc_hash string"), "ti_html", "1")
    assert [r.tables for r in cached.collect()] == [7] and [r.doc_hash for r in missing.collect()] == ["a"]


def test_wrong_use(tmp_path):
    assert main(["build", str(tmp_path), "--corpus", str(tmp_path)]) == 2
    with pytest.raises(SystemExit) as e:
        main([])
    assert e.value.code == 2
