import random

import pytest
from pyspark.sql import functions as F

from sheetloom.operators.merkle import IncrementalRun, build_tree, changed_leaves, changed_records, depth_for, keyed_records
from sheetloom.sources.versions import Outrun
from sheetloom.operators.registrations import STALE, current_registrations, files_to_build, finished_builds


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v string")


def diff(spark, new, old, depth):
    a, b = (keyed_records(frame(spark, x), ["k"], "v", depth) for x in (new, old))
    out = changed_records(a, b, changed_leaves(build_tree(a, depth), build_tree(b, depth), depth), ["k"], "v")
    return {(r.k, r.v, r.change) for r in out.collect()}


def test_depth_follows_the_number_of_records():
    assert depth_for(0) == 1
    assert depth_for(64 * 256) == 1
    assert depth_for(64 * 256 + 1) == 2
    assert depth_for(10**30) == 5


def test_changes_equal_a_plain_comparison(spark):
    rng = random.Random(4)
    old = {f"k{i}": f"v{i}" for i in range(800)}
    new = dict(old)
    for k in rng.sample(sorted(old), 40):
        del new[k]
    for k in rng.sample(sorted(new), 30):
        new[k] += "x"
    new |= {f"n{i}": "v" for i in range(20)}
    want = {(k, v, "new" if k not in old else "changed") for k, v in new.items() if old.get(k) != v}
    want |= {(k, None, "removed") for k in old.keys() - new.keys()}
    assert diff(spark, list(new.items()), list(old.items()), 2) == want


def test_null_keys_and_values_are_values(spark):
    assert diff(spark, [(None, "a"), ("b", None)], [(None, "a"), ("b", "x")], 1) == {("b", None, "changed")}
    assert diff(spark, [(None, "a")], [(None, "b")], 1) == {(None, "a", "changed")}


def test_equal_and_empty_tables_have_no_changes(spark):
    rows = [("a", "1"), ("b", "2")]
    assert diff(spark, rows, rows[::-1], 3) == set()
    assert diff(spark, [], [], 2) == set()
    assert diff(spark, rows, [], 2) == {("a", "1", "new"), ("b", "2", "new")}


def test_only_leaves_that_differ_are_found(spark):
    rows = [(f"k{i}", "v") for i in range(500)]
    trees = [build_tree(keyed_records(frame(spark, x), ["k"], "v", 3), 3) for x in (rows, [*rows[1:], ("k0", "w")])]
    assert changed_leaves(*trees, 3).count() == 1


def test_a_failed_run_repeats_and_skips_nothing(spark, tmp_path):
    run = IncrementalRun(spark, f"file://{tmp_path}/store", ["k"], "v")
    run.run(frame(spark, [("a", "1"), ("b", "1")]), lambda c: c.select("k", "v"))

    def broken(changes):
        raise RuntimeError("lost")

    second = frame(spark, [("a", "2"), ("b", "1"), ("c", "1")])
    with pytest.raises(RuntimeError):
        run.run(second, broken)
    assert len(run.published()) == 1
    run.run(second, lambda c: c.select("k", "v"))
    assert sorted(map(tuple, run.outputs().collect())) == [("a", "2"), ("b", "1"), ("c", "1")]
    met = []
    run.run(second, lambda c: met.append(c.count()) or c.select("k", "v"))
    assert met == [0] and run.outputs().count() == 3


def test_removed_keys_lose_their_output(spark, tmp_path):
    run = IncrementalRun(spark, f"file://{tmp_path}/store", ["k"], "v")
    run.run(frame(spark, [("a", "1"), ("b", None), (None, "1")]), lambda c: c.select("k", "v"))
    run.run(frame(spark, [("b", None)]), lambda c: c.select("k", "v"))
    assert [tuple(r) for r in run.outputs().collect()] == [("b", None)]
    run.run(frame(spark, [("a", "1"), ("b", None)]), lambda c: c.select("k", "v"))
    assert sorted(r.k for r in run.outputs().collect()) == ["a", "b"]


def test_the_second_of_two_racing_runs_is_refused(spark, tmp_path):
    run = IncrementalRun(spark, f"file://{tmp_path}/store", ["k"], "v")
    other = IncrementalRun(spark, f"file://{tmp_path}/store", ["k"], "v")

    def slow(changes):
        other.run(frame(spark, [("a", "2")]), lambda c: c.select("k", "v"))
        return changes.select("k", "v")

    with pytest.raises(Outrun):
        run.run(frame(spark, [("a", "1")]), slow)
    assert [tuple(r) for r in run.outputs().collect()] == [("a", "2")]


def test_a_grown_store_is_cut_deeper_and_only_changed_leaves_are_written(spark, tmp_path):
    def numbers(n, changed=()):
        v = F.when(F.col("id").isin(*changed), "x").otherwise("v") if changed else F.lit("v")
        return spark.range(n).select(F.concat(F.lit("k"), F.col("id")).alias("k"), v.alias("v"))

    run = IncrementalRun(spark, f"file://{tmp_path}/store", ["k"], "v")
    met = []

    def keep(c):
        met.append(c.count())
        return c.select("k", "v")

    run.run(numbers(64), keep)
    assert run.versions.latest()[1]["depth"] == 1
    run.run(numbers(100_000), keep)
    assert run.versions.latest()[1]["depth"] == 2
    name = run.run(numbers(100_000, (3, 70_000)), keep)
    assert met == [64, 99_936, 2]
    assert spark.read.parquet(f"file://{tmp_path}/store/{name}/records").count() < 50
    run.run(numbers(100_000, (3,)), keep)
    assert met[-1] == 1 and run.outputs().where("v = 'x'").count() == 1 and run.outputs().count() == 100_000


SOURCES = "source_id long, content_hash string, path string, part_number string, registered_at timestamp_ntz, extra string"
BUILDS = "build_id long, part_number string, path string, content_hash string, pipeline_version string, backend string, extractor_version string, status string, generated_at timestamp_ntz"
VERSIONS = "backend string, output_version string, pipeline_version string"


def ts(day):
    import datetime

    return None if day is None else datetime.datetime(2025, 1, day)


def work(spark, sources, builds, versions=(("x", "o1", "p1"),)):
    s = spark.createDataFrame([(*r, "e") for r in sources], SOURCES)
    out = files_to_build(s, spark.createDataFrame(list(builds), BUILDS), spark.createDataFrame(list(versions), VERSIONS))
    return sorted(r.source_id for r in out.collect())


def done(i, path, h, day=1, p="p1", b="x", e="o1", status="done"):
    return (i, "P", path, h, p, b, e, status, ts(day))


def test_notations_of_hashes_and_paths_do_not_matter(spark):
    sources = [(1, "SHA256:AB c", "./d//a.pdf", "P", ts(1)), (2, "ef", "d/B.pdf", "P", ts(1))]
    assert work(spark, sources, [done(1, "d\\a.pdf", " abC"), done(2, "d/b.pdf", "ef")]) == [2]


def test_the_latest_registration_and_the_latest_done_build_count(spark):
    sources = [(5, "new", "a", "P", ts(2)), (3, "new", "a", "P", ts(2)), (1, "old", "a", "P", ts(1)), (3, "new", "a", "P", ts(2))]
    assert work(spark, sources, [done(1, "a", "new", 1), done(2, "a", "old", 3)]) == [3]
    assert work(spark, sources, [done(1, "a", "new", 3), done(2, "a", "old", 1), done(9, "a", "old", 4, status="failed")]) == []


def test_stale_blank_and_unknown_versions_are_work(spark):
    s = [(1, "h", "a", "P", ts(1))]
    assert work(spark, s, [done(1, "a", "h", p="p0")]) == [1]
    assert work(spark, s, [done(1, "a", "h", e=" ")]) == [1]
    assert work(spark, s, [done(1, "a", "h", p=None)]) == [1]
    assert work(spark, s, [done(1, "a", "h", b="y")]) == [1]
    assert work(spark, s, [done(1, "a", "h", e="")], [("x", "", "p1")]) == [1]


def test_nulls_and_empty_tables(spark):
    assert work(spark, [], []) == []
    assert work(spark, [(1, None, "a", "P", None), (2, "", None, None, None)], [done(1, "a", None)]) == [1, 2]
    assert work(spark, [], [done(1, "a", "h")]) == []
    r = current_registrations(spark.createDataFrame([(1, "h", "a", "P", None, "e"), (2, "h2", "a", "P", ts(1), "e")], SOURCES)).collect()
    assert [(x.value, x.source_id) for x in r] == [("h2", 2)]
    b = finished_builds(spark.createDataFrame([done(1, "a", "h", None), done(2, "a", "g", None)], BUILDS), spark.createDataFrame([], VERSIONS)).collect()
    assert [x.value for x in b] == [STALE]
