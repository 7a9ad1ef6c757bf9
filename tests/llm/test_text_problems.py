import os
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheetloom.llm import boilerplate, bpe, splitting
from sheetloom.llm.boilerplate import LineCounts, RepeatedLines, cleaned_sections, lines_of, repeated_lines
from sheetloom.llm.lookalikes import Rewriter, choose, look_alike_classes, mapping_for, only_to_the_eye, uniform
from sheetloom.llm.mixing import budgets, fit_subset, mix_report, mix_sources
from sheetloom.sources.versions import Outrun
from sheetloom.llm.repetition import measure_texts, repetition, repetitive, suffix_order

SECTIONS = "section_id long, vendor string, doc_hash string, paragraphs array<string>, number string, boilerplate_removed int, h1 string, bin string"


def sections(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (8 - len(r))) for r in rows], SECTIONS)


# --- lines repeated within a source -------------------------------------------------------------------------------------------


def plain_form(line):
    return re.sub(r"\d+", "#", " ".join(line.lower().split()))


def brute_lines(rows, threshold):
    docs, places = {}, []
    for i, vendor, doc, paras, *_ in rows:
        for p, para in enumerate(paras or []):
            for n, line in enumerate((para or "").split("\n")):
                if plain_form(line) and vendor is not None and doc is not None:
                    docs.setdefault((vendor, plain_form(line)), set()).add(doc)
                    places.append((i, p, n, (vendor, plain_form(line))))
    return {(i, p, n) for i, p, n, k in places if len(docs[k]) >= threshold}


def random_sections(rng, n):
    lines = ["Page 1 of 9", "page  22 of 10", "Print me", "PRINT ME ", "", " ", "a", "b\t c", "Ünique x"]
    return [
        (i, rng.choice(["v", "v", "v", "w", None]), rng.choice([f"d{rng.randrange(12)}", None if rng.random() < 0.1 else "d0"]),
         rng.choice([None, [], [None, "x"], ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 4))) for _ in range(2)]]))
        for i in range(n)
    ]


@pytest.mark.parametrize("parts", [1, 3])
def test_deltas_give_what_one_pass_gives(spark, parts):
    rng = random.Random(parts)
    rows = random_sections(rng, 90)
    cuts = [rows[k::parts] for k in range(parts)]
    got = set(map(tuple, repeated_lines([sections(spark, c) for c in cuts], threshold=4).collect()))
    assert got == brute_lines(rows, 4) and got


def test_only_documents_with_newly_crossed_lines_are_rebuilt(spark):
    store = LineCounts(spark, threshold=3)
    first, touched = store.merge(sections(spark, [(1, "v", "a", ["x\ny"]), (2, "v", "b", ["x"]), (3, "v", "c", ["z"])]))
    assert first.count() == 0 and touched.count() == 0
    newly, touched = store.merge(sections(spark, [(4, "v", "e", ["X "]), (5, "v", "a", ["x"])]))
    assert newly.count() == 1 and touched.count() == 2


MERGE = """
import sys
from sheetloom.llm.boilerplate import RepeatedLines
from sheetloom.runtime import local_session
spark = local_session("merge", "2")
rows = [(int(i), "v", d, [p]) for i, d, p in (x.split("|") for x in sys.argv[2:])]
RepeatedLines(spark, sys.argv[1], 3).merge(spark.createDataFrame(rows, "section_id long, vendor string, doc_hash string, paragraphs array<string>"))
"""


def test_a_store_is_opened_again_by_another_process(spark, tmp_path):
    root = f"file://{tmp_path}/lines"
    subprocess.run([sys.executable, "-c", MERGE, root, "1|a|x", "2|b|x", "3|a|own"], check=True, capture_output=True, env=os.environ | {"PYTHONPATH": os.getcwd()})
    store = RepeatedLines(spark, root, 3)
    newly, touched = store.merge(sections(spark, [(4, "v", "c", ["X"])]))
    assert (newly.count(), touched.count()) == (1, 2)
    assert sorted(map(tuple, store.found().collect())) == [(1, 0, 0), (2, 0, 0), (4, 0, 0)]
    with pytest.raises(ValueError, match="threshold"):
        LineCounts(spark, root, 4)


def test_racing_merges_and_compaction(spark, monkeypatch):
    monkeypatch.setattr(boilerplate, "COMPACT_EVERY", 1)
    store = RepeatedLines(spark, threshold=3)
    for i in range(4):
        store.merge(sections(spark, [(i, "v", f"d{i}", ["x\ny" if i else "x"])]))
    assert len(store.state["pairs"]) == 1 and store.table("pairs").count() == 0
    assert store.found().count() == 7
    other = RepeatedLines(spark, store.root, 3)

    def race(*_):
        other.derive = lambda *_: None
        other.merge(sections(spark, [(8, "v", "d8", ["z"])]))

    store.derive = race
    with pytest.raises(Outrun):
        store.merge(sections(spark, [(9, "v", "d9", ["z"])]))


@pytest.mark.parametrize("parts", [1, 3])
def test_cleaning_keeps_the_rest(spark, parts):
    rows = [(i, "v", f"d{i}", [f"Own {'abc'[i]}\nPage 4", "Page 5", None, ""]) for i in range(3)] + [(9, "w", "q", ["Page 1"]), (10, "v", "z", None), (9, "w", "q", ["Page 1"]), (11, None, None, ["Page 1"])]
    out = cleaned_sections([sections(spark, rows[k::parts]) for k in range(parts)], threshold=3).orderBy("section_id").collect()
    assert [(r.section_id, r.paragraphs, r.boilerplate_removed) for r in out] == [
        (0, ["Own a", None, ""], 2), (1, ["Own b", None, ""], 2), (2, ["Own c", None, ""], 2), (9, ["Page 1"], 0), (9, ["Page 1"], 0), (10, None, 0), (11, ["Page 1"], 0),
    ]
    assert out[0].asDict().keys() == {f.split()[0] for f in SECTIONS.split(", ")}


def test_no_lines_in_empty_tables(spark):
    assert repeated_lines([sections(spark, [])]).count() == 0
    assert lines_of(sections(spark, [(1, "v", "d", ["a" * 100_000])]), "section_id").count() == 1


# --- splitting ------------------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n。é\U0001f600", max_size=90), max_size=4), st.integers(2, 6), st.integers(0, 5))
def test_pieces_cover_the_text(texts, limit, overlap):
    overlap = min(overlap, limit - 1)
    owner, start, end = splitting.split_batch(texts, limit, overlap)
    for i, t in enumerate(texts):
        pieces = [(int(s), int(e)) for o, s, e in zip(owner, start, end, strict=True) if o == i]
        assert (not pieces) == (not t)
        if t:
            assert pieces[0][0] == 0 and pieces[-1][1] == len(t)
            assert all(0 < e - s <= limit * 4 for s, e in pieces)
            assert all(b[0] == a[1] - overlap * 4 for a, b in zip(pieces, pieces[1:]))


def test_natural_ends_are_preferred():
    word = "word " * 300
    text = ("Sentence one. " * 20 + "\n") * 12 + word
    _, start, end = splitting.split_batch([text], 100, 10)
    assert all(text[e - 1] in "\n " or e == len(text) for e in end)
    assert sum(text[e - 1] == "\n" for e in end) > 3
    _, _, hard = splitting.split_batch(["x" * 5000], 100, 10)
    assert np.diff(hard).max() == 360


def test_paragraphs_fences_tables_and_quotes():
    def strengths(text):
        at, kind = splitting.boundary_strengths(np.array(list(map(ord, text)), dtype=np.uint32), np.array([0]))
        return dict(zip(at.tolist(), kind.tolist(), strict=True))

    assert strengths("a\n\nb") == {2: splitting.LINE, 3: splitting.PARAGRAPH}
    assert strengths("a\n# b")[2] == splitting.PARAGRAPH
    assert strengths("|a|\n|b|\nc") == {4: splitting.SENTENCE, 8: splitting.LINE}
    assert strengths("```\n\nx\n```\ny") == {4: splitting.SENTENCE, 5: splitting.SENTENCE, 7: splitting.SENTENCE, 11: splitting.LINE}
    assert strengths('Go." Now') == {5: splitting.SENTENCE}
    assert strengths("(x) y") == {4: splitting.WORD}


def test_hard_cuts_keep_letters_whole():
    text = "e\u0301" * 3001
    _, start, end = splitting.split_batch([text, "x" * 5000], 100, 9)
    assert not any(text[e : e + 1] == "\u0301" for e in end[start < 6002] if e < 6002)
    rng = random.Random(5)
    for _ in range(30):
        t = "".join(rng.choice("ab\u0301\u200d\U0001f468") for _ in range(rng.randrange(1, 400)))
        _, start, end = splitting.split_batch([t], 6, 1)
        assert start[0] == 0 and end[-1] == len(t) and (end - start).max() <= 24 and all(start[1:] == end[:-1] - 4)


def test_split_tables(spark):
    df = spark.createDataFrame([(1, "a" * 10, 5), (2, None, 5), (3, "", 5), (4, "b " * 40, 5), (4, "b " * 40, 5)], "id long, t string, piece_pos int")
    out = splitting.split_pieces(df, "id", "t", 5, 1).collect()
    assert sorted((r.id, r.piece_pos, r.piece_count) for r in out if r.id == 1) == [(1, 0, 1)]
    assert {r.id for r in out} == {1, 4}
    assert all(r.text == ("a" * 10 if r.id == 1 else "b " * 40)[r.start : r.end] and r.token_count <= 5 for r in out)
    assert [r.id for r in splitting.oversized(df, "id", "t", 5, 1).collect()] == [4]
    assert splitting.split_pieces(df.limit(0), "id", "t").count() == 0
    with pytest.raises(ValueError, match="overlap"):
        splitting.split_batch(["a"], 4, 4)


# --- look-alikes ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b"),
    [("Ｔｈｅ", "The"), ("café", "café"), ("сафе", "caфe"), ("ﬁﬂﬃ", "fiflffi"), ("5 µF", "5 μF"), ("ΩK", "ΩK"),
     ("℃", "°C"), ("㎒", "MHz"), ("a​­b﻿", "ab"), ("x　y z", "x y z"), ("a‑b", "a-b"), ("e​́", "é"), ("е́", "é"), ("m²", "㎡"),
     ("ộ", "ộ")],
)
def test_equal_looking_text_is_equal(a, b):
    r = Rewriter(choose({}))
    assert r(a) == r(b)


@pytest.mark.parametrize(("a", "b"), [("a", "A"), ("e", "é"), ("2", "²"), ("3", "٣"), ("1", "①"), ("-", "—"), ("o", "0"), ("TM", "™"), ("1/2", "½"), ("u", "μ"), ("é", "è")])
def test_text_a_reader_can_tell_apart_stays_so(a, b):
    r = Rewriter(choose({}))
    assert r(a) != r(b)


@pytest.mark.parametrize(
    ("a", "b"),
    [("\ud55c\uae00", "\u1112\u1161\u11ab\u1100\u1173\u11af"), ("\uf9b4", "\u9818"), ("x\u0323\u0302", "x\u0302\u0323"), ("\u043aot", "kot"), ("a\u200db", "ab"), ("\u0958", "\u0915\u093c")],
)
def test_canonical_forms_are_equal(a, b):
    r = Rewriter(choose({}))
    assert r(a) == r(b)


@pytest.mark.parametrize(
    ("a", "b"),
    [("\U0001f468\u200d\U0001f469\u200d\U0001f467", "\U0001f468\U0001f469\U0001f467"), ("\u0645\u06cc\u200c\u062e\u0648\u0627\u0647\u0645", "\u0645\u06cc\u062e\u0648\u0627\u0647\u0645"),
     ("\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f", "\U0001f3f4\U000e0067\U000e0062\U000e0073\U000e0063\U000e0074\U000e007f")],
)
def test_joiners_that_show_are_kept(a, b):
    r = Rewriter(choose({}))
    assert r(a) != r(b) and r(r(a)) == r(a)


def test_representatives_are_never_rewritten():
    mapping = choose({})
    r = Rewriter(mapping)
    assert all(r(v) == v for v in set(mapping.values()))
    assert r.plain_ascii_stays and not Rewriter(choose({"\u0430": 9})).plain_ascii_stays


def test_frequent_members_represent_their_class():
    assert choose({"а": 5, "a": 2})["a"] == "а"
    assert choose({"a": 5, "а": 2})["а"] == "a"
    groups, invisible = look_alike_classes()
    assert len({m for g in groups for m in g}) == sum(map(len, groups)) and "​" in invisible


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé​еﬁfi  ａΩKé-‑", max_size=12))
def test_rewriting_is_stable(text):
    r = Rewriter(choose({}))
    assert r(r(text)) == r(text)


def test_found_only_by_the_eye(spark):
    q = spark.createDataFrame(
        [(1, "d", None, ["café", "cafe", "x y", None, ""]), (2, "d", "2", ["x y"]), (3, "nix", None, ["a"]), (4, None, None, ["a"]), (5, "d", "1", None), (1, "d", None, ["café", "cafe", "x y", None, ""])],
        "question_id long, doc_hash string, section string, expected_substrings array<string>",
    )
    s = sections(spark, [(1, "v", "d", ["one cafés", "x y", None], "1"), (2, "v", "d", ["x y"], "2"), (3, "v", "d", None, "2")])
    got = set(map(tuple, only_to_the_eye(q, s).collect()))
    # "cafe" stands there code point for code point, before the accent
    assert got == {(1, 0), (1, 2), (2, 0)}
    assert only_to_the_eye(q.limit(0), s.limit(0)).count() == 0


def test_uniform_columns(spark):
    df = spark.createDataFrame([(None,), ("",), ("\uff41" * 50_000,), ("a" * 50_001,), ("e\u0301",)], "text string")
    out = [r.t for r in df.select(uniform(df.text, mapping_for((df, "text"))).alias("t")).collect()]
    assert out == [None, "", "a" * 50_000, "a" * 50_001, "\u00e9"]


# --- encoding ---------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder_of(Path(bpe.VOCABULARY).read_text())


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text(alphabet="aabeinrst 01\n=-'", max_size=200)))
def test_ids_are_those_of_merging_by_rank(encoder, reference, text):
    ids = list(encoder.encode(text))
    assert ids == reference(text)
    assert encoder.decode(np.array(ids, dtype=np.int64)).decode() == text


def test_hard_texts(encoder, reference):
    for text in ("<|endoftext|> x", "a" * 5000, "=" * 4000, "\n" * 3000 + "x", "日本" * 500, "\U0001f468‍\U0001f469" * 200):
        assert list(encoder.encode(text)) == reference(text)


def test_encode_and_decode_tables(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello world", "y")], "doc_id long, text string, ids string")
    enc = bpe.encode_texts(df)
    got = sorted((r.doc_id, list(r.ids)) for r in enc.collect())
    assert got[2:] == [(2, []), (3, [])] and got[0] == got[1]
    assert sorted((r.doc_id, r.text) for r in bpe.decode_texts(enc).collect()) == [(1, "Hello world"), (1, "Hello world"), (2, ""), (3, "")]
    assert bpe.encode_texts(df.limit(0)).count() == 0


# --- mixing ----------------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6), st.integers(0, 200), st.sampled_from([5, 40, 1 << 16]))
def test_budgets_are_met_as_nearly_as_possible(hist, budget, window):
    lengths, counts = list(hist), list(hist.values())
    taken = fit_subset(lengths, counts, budget, window)
    assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
    total = sum(n * t for n, t in zip(lengths, taken, strict=True))
    sums = {0}
    for n, c in hist.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    best = max(s for s in sums if s <= budget)
    assert total <= budget
    if window > budget:
        assert total == best


def mix_input(spark, rng):
    lengths = [(i, s, rng.randrange(1, 60)) for i, s in enumerate("a" * 300 + "b" * 40 + "c" * 3)]
    targets = [("a", 0.6, 1), ("b", 0.3, 4), ("c", 0.05, 50), ("gone", 0.05, 3), ("none", 0.0, 1)]
    return spark.createDataFrame(lengths, "doc_id long, source string, n_tokens long"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares_are_reached_within_the_caps(spark):
    lengths, targets = mix_input(spark, random.Random(2))
    mixed = mix_sources(lengths, targets, seed=3).cache()
    caps = {"a": 1, "b": 4, "c": 50}
    rows = mixed.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.repeats <= caps[r.source] for r in rows)
    report = {r.source: r for r in mix_report(mixed, targets).collect()}
    assert set(report) == {"a", "b", "c", "gone", "none"}
    for s, share in (("a", 0.6), ("b", 0.3), ("c", 0.05)):
        assert abs(report[s].actual_share - share / 0.95) < 0.01
    assert report["gone"].documents == 0 and report["gone"].actual_share == 0
    again = mix_sources(lengths.repartition(3), targets, seed=3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_a_total_that_can_not_be_reached_is_filled_as_far_as_possible(spark):
    lengths, targets = mix_input(spark, random.Random(2))
    assert {s: b for s, b, _ in budgets(lengths, targets, 10**9)} == {r.source: r.n * {"a": 1, "b": 4, "c": 50}[r.source] for r in lengths.groupBy("source").sum("n_tokens").toDF("source", "n").collect()}
    assert mix_sources(lengths.limit(0), targets).count() == 0
    assert mix_sources(lengths, targets.limit(0)).count() == 0


# --- repetition -----------------------------------------------------------------------------------------------------------------


def brute_repetition(text, run=6):
    w = [x.lower() for x in re.findall(r"[^\W_]+", text)]
    seen, marks = set(), [0] * len(w)
    for i in range(len(w) - run + 1):
        g = tuple(w[i : i + run])
        if g in seen:
            marks[i : i + run] = [1] * run
        seen.add(g)
    longest = 0
    for i in range(len(w)):
        for j in range(i):
            k = 0
            while i + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            longest = max(longest, k if k >= run else 0)
    return len(w), sum(marks), longest


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c A d_e".split()), max_size=40).map(" ".join), max_size=5), st.integers(2, 6))
def test_repetition_equals_brute_force(texts, run):
    got = list(zip(*map(list, measure_texts(texts, run)), strict=True))
    assert got == [brute_repetition(t, run) for t in texts]


def test_suffix_arrays_sort_suffixes():
    rng = np.random.default_rng(0)
    for _ in range(30):
        x = rng.integers(0, 3, rng.integers(1, 40))
        order, _ = suffix_order(x)
        assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def test_repetition_of_tables(spark):
    spam = "buy the best part here now " * 9
    df = spark.createDataFrame([(1, spam, 0), (2, "one two three", 0), (3, None, 0), (4, "", 0), (5, "word " * 30_000, 0), (1, spam, 0)], "doc_id long, text string, n_words int")
    got = {r.doc_id: (r.n_words, r.repeated_words, r.repeated_share) for r in repetition(df).collect()}
    assert got[1] == (54, 48, 48 / 54) and got[2] == (3, 0, 0.0) and got[3] == got[4] == (0, 0, 0.0) and got[5][1] == 29_999
    assert sorted(r.doc_id for r in repetitive(df).collect()) == [1, 5]
    assert repetition(df.limit(0)).count() == 0


def test_forms_are_chosen_by_the_whole_corpus(spark, monkeypatch):
    from sheetloom.llm import lookalikes

    seen = []
    monkeypatch.setattr(lookalikes, "choose", lambda counts: seen.append(dict(counts)) or choose(counts))
    q = spark.createDataFrame([(1, "d", None, ["\u2212"])], "question_id long, doc_hash string, section string, expected_substrings array<string>")
    s = spark.createDataFrame([("d", "1", ["\u2212"]), ("e", "1", ["\u2212\u2212", None])], "doc_hash string, number string, paragraphs array<string>")
    assert lookalikes.only_to_the_eye(q, s).count() == 0
    assert [c["\u2212"] for c in seen] == [4]


def test_the_report_shows_what_the_mix_reaches(spark):
    lengths = spark.createDataFrame([(i, "big", 10) for i in range(50)] + [(99, "tiny", 10)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = {r.source: (r.tokens, r.tokens_held, r.total_tokens, r.total_held) for r in mix_report(mix_sources(lengths, targets), targets, lengths).collect()}
    assert got == {"big": (10, 500, 20, 510), "tiny": (10, 10, 20, 510)}
