import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sheetloom.operators.inventory import latest_stage
from sheetloom.sources import readers as rd
from sheetloom.sources import writers as wr
from sheetloom.streaming import events as ev


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("b.PDF", b"2"), ("a.pdf", b"1"), ("c.txt", b"3"), ("sub/d.pdf", b"4")):
        (tmp_path / name).write_bytes(data)
    rows = rd.discover_documents(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.part, r.content_hash[:8]) for r in rows] == [("A", "6b86b273"), ("B", "d4735e3a")]
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        rd.discover_documents(spark, str(tmp_path / "nix")).collect()


def test_unreadable_files_are_left_out_and_listed(spark, tmp_path):
    good = {"part_number": "P", "doc_hash": "h", "records": [{"section": "4", "symbol": "V", "unit": {"verbatim": "V", "canonical": "V"}, "page": 2}, {"section": "5"}]}
    for d, text in (("a", json.dumps(good, indent=1)), ("b", '{"records": [')):
        (tmp_path / d).mkdir()
        (tmp_path / d / "specs.json").write_text(text)
    path = f"{tmp_path}/*/specs.json"
    assert [(r.pos, r.section, r.page) for r in rd.read_specs(spark, path).orderBy("pos").collect()] == [(0, "4", 2), (1, "5", None)]
    assert [os.path.basename(os.path.dirname(r._path)) for r in rd.unreadable_documents(spark, path).collect()] == ["b"]


def test_inventory_round_trip(spark, tmp_path):
    row = ("h", "a.pdf", "P", "datasheet", "", 3, False, "ti", "", datetime(2025, 1, 2))
    df = spark.createDataFrame([row], rd.SOURCE_DOCUMENT)
    wr.save_inventory(df, f"{tmp_path}/sources.json")
    assert [tuple(r) for r in rd.read_inventory(spark, f"{tmp_path}/sources.json").collect()] == [row]
    (tmp_path / "broken.json").write_text("[{")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        rd.read_inventory(spark, f"{tmp_path}/broken.json").collect()


def test_golden_questions(spark, tmp_path):
    (tmp_path / "q.yaml").write_text("questions:\n- {id: q1, question: 'What?', expected_substrings: ['5 V'], pages: [2], spec_query: {symbol: V}}\n")
    (q,) = rd.read_golden(spark, f"{tmp_path}/q.yaml").collect()
    assert (q.id, q.pages, q.spec_query, q.plot_query, q.kind) == ("q1", [2], {"symbol": "V"}, None, "direct")
    (tmp_path / "bad.yaml").write_text("questions:\n- {question: 'What?'}\n")
    with pytest.raises(ValueError, match="without id"):
        rd.read_golden(spark, f"{tmp_path}/bad.yaml")


def test_fetching_only_what_is_missing(spark):
    urls = spark.createDataFrame([("http://h/a.png",), ("http://h/b",)], "url string")
    cache = spark.createDataFrame([("http://h/a.png", b"x")], "url string, data binary")
    cached, missing = rd.fetch_plan(urls, cache, binary=True)
    assert cached.count() == 1 and missing.first().name.endswith(".bin")

    def get(url):
        raise OSError("offline")

    (r,) = rd.fetch_missing(missing, get).collect()
    assert (r.url, r.data, r.error) == ("http://h/b", None, "offline")


def test_backends_and_settings():
    rd.register_backend("plain", lambda x: x)
    assert "plain" in rd.backends() and rd.backend("plain")(1) == 1
    with pytest.raises(KeyError, match="unknown backend"):
        rd.backend("nix")
    assert rd.Settings(env={"SHEETLOOM_INDEX_TOKEN_BUDGET": "99"}).index_token_budget == 99
    with pytest.raises(ValueError, match="at least 1"):
        rd.Settings(env={"SHEETLOOM_BATCH_WORKERS": "0"})


def test_files_appear_whole_or_not_at_all(spark, tmp_path):
    wr.atomic_write(f"{tmp_path}/x/a.md", "one")
    wr.atomic_write(f"{tmp_path}/x/a.md", "two")
    with pytest.raises(IsADirectoryError):
        wr.atomic_write(f"{tmp_path}/x", "no")
    assert os.listdir(tmp_path / "x") == ["a.md"] and os.listdir(tmp_path) == ["x"] and (tmp_path / "x/a.md").read_text() == "two"
    files = spark.createDataFrame([("s/1.md", "ä"), ("s/2.md", ""), ("s/2.md", "")], "path string, text string")
    assert sorted(r.bytes for r in wr.write_text_files(files, str(tmp_path)).collect()) == [0, 0, 2]
    assert [r.path for r in wr.repeated_paths(files).collect()] == ["s/2.md"]


def test_tables_overwrite_only_their_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    wr.write_table(spark.createDataFrame([("a", 1), ("b", 1)], "part string, n int"), path, ["part"])
    wr.write_table(spark.createDataFrame([("b", 2)], "part string, n int"), path, ["part"])
    assert sorted((r.part, r.n) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2)]


def test_event_logs_and_their_streams(spark, tmp_path):
    shown = []
    path = wr.log_path(str(tmp_path), "/in/my:dir.x/", datetime(2025, 1, 2, 3, 4, 5, 6))
    assert path.endswith("batches/my_dir-20250102-030405-000006/batch.jsonl")
    log = wr.EventLog(path, 2, shown.append)
    log.emit("header", jobs=[1, 2])
    log.emit("extracting", 1, "A", "a\nb")
    log.emit("done", 1, "A")
    log.emit("failed", 2, "B", "no")
    assert shown == ["batch: header", "[1/2] A: extracting (a b)", "[1/2] A: done", "[2/2] B: failed (no)"]
    events = wr.read_events(spark, path)
    assert events.where("job is null").count() == 1
    last = latest_stage(events.where("job is not null").withColumn("order", F.when(F.col("stage") == "done", 2).otherwise(1)), "job", "stage", "timestamp", "order")
    assert [r.stage for r in last.orderBy("job").collect()] == ["done", "failed"]
    stream = ev.latest_stages(ev.tail_events(spark, f"{tmp_path}/batches"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("stages").start()
    try:
        q.processAllAvailable()
        rows = spark.sql("select run, job, part, stage from stages order by job").collect()
    finally:
        q.stop()
    assert [(r.job, r.part) for r in rows] == [(1, "A"), (2, "B")] and rows[1].stage == "failed" and rows[0].run.startswith("my_dir-")
    blocked = wr.EventLog(f"{path}/under/a/file.jsonl", 1, shown.append)
    blocked.emit("x", 1, "A")
    blocked.emit("y", 1, "A")
    assert sum("unavailable" in x for x in shown) == 1


def test_windows_and_arriving_documents(spark, tmp_path):
    (tmp_path / "ev" / "r1").mkdir(parents=True)
    (tmp_path / "ev" / "r1" / "batch.jsonl").write_text("".join(json.dumps({"timestamp": f"2025-01-01T00:{m:02d}:00Z", "job": 1, "part": "A", "stage": "s", "detail": ""}) + "\n" for m in (1, 2, 31)))
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.Pdf").write_bytes(b"1")
    for name, df, mode in (("w", ev.counts_per_window(ev.tail_events(spark, f"{tmp_path}/ev")), "complete"), ("d", ev.new_documents(spark, str(tmp_path / "docs")), "append")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(f"out_{name}").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    assert sorted(r.n for r in spark.table("out_w").collect()) == [1, 2]
    assert spark.table("out_d").count() == 1
