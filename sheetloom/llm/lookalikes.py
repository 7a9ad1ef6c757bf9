"""Text that looks the same brought to one form.

Strings that print alike (a full-width letter and its plain one, an accented
letter and letter plus combining accent, a ligature and its letters, a unit
sign and its letters, kinds of blank and of hyphen, letters of other scripts)
are joined into transitive classes by union-find over code points and strings.
Of each class one member is chosen as representative by how often its members
occur in the corpus, and texts are rewritten by an automaton that replaces, at
each place, the longest member that is no representative. Invisible characters
are a class with the empty string.

Before that, canonically equivalent text is made equal (order of accents,
syllables written in parts, compatibility ideographs), and invisible characters
go, but for joiners where they show: between letters of scripts whose letters
join, and between pictographs.

Case, accents, digits of other scripts and raised digits tell texts apart and
are never joined.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.runtime import staged

# Letters of other scripts that print like a Latin one.
LETTERS = {
    "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "і", "j": "јϳ", "k": "к", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "р", "q": "ԛզ", "s": "ѕ",
    "u": "ս", "v": "ѵν", "w": "ԝ", "x": "х", "y": "у",
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈͿᎫ", "K": "КΚᏦ",
    "L": "Ꮮ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅᏚՏ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᏔ",
    "X": "ХΧ", "Y": "ҮΥ", "Z": "ΖᏃ",
}
# Kinds of hyphen, and invisible characters besides the category Cf.
HYPHENS = "-\u02d7\u2010\u2011\u2012\u2212\ufe63\uff0d"
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"
# Where joiners show (scripts whose letters join or stack; pictographs), and the letters that spell a flag's region.
JOINING_SCRIPTS = "\u0600-\u07ff\u0840-\u085f\u0860-\u08ff\u0900-\u0dff\u1000-\u109f\u1780-\u17ff\u1800-\u18af\ua840-\ua87f\ufb50-\ufdff\ufe70-\ufefc"
PICTOGRAPHS = "\u00a9\u00ae\u203c-\u3299\U0001f000-\U0001faff"
TAGS = "\U000e0020-\U000e007f"
JOINERS = "\u200c\u200d"
_NO_JOIN = re.compile(f"(?<![{JOINING_SCRIPTS}])\u200c|\u200c(?![{JOINING_SCRIPTS}])|(?<![{JOINING_SCRIPTS}{PICTOGRAPHS}])\u200d|\u200d(?![{JOINING_SCRIPTS}{PICTOGRAPHS}])")
_NO_FLAG = re.compile(f"(?<![\U0001f3f4{TAGS}])[{TAGS}]+")
#: Kinds of one-step decomposition that change neither meaning nor look much.
_ALIKE_KINDS = {"<wide>", "<narrow>", "<compat>", "<square>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<small>"}


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, s: str) -> str:
        root = s
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[s] != root:
            self.parent[s], s = root, self.parent[s]
        return root

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def groups(self) -> list[list[str]]:
        by: dict[str, list[str]] = {}
        for s in self.parent:
            by.setdefault(self.find(s), []).append(s)
        return sorted(sorted(g) for g in by.values() if len(g) > 1)


def _invisible(c: str) -> bool:
    """Format characters (not the signs that enclose Arabic numbers), fillers
    and variation selectors."""
    n = ord(c)
    return c in INVISIBLE or (unicodedata.category(c) == "Cf" and not 0x600 <= n <= 0x605) or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF


def _decomposition(c: str) -> str | None:
    """What c is made of, one step deep, if both look the same; raised,
    lowered, circled and styled forms and fractions don't."""
    d = unicodedata.decomposition(c)
    if not d:
        return None
    kind, parts = (d.split(" ", 1)) if d[0] == "<" else ("", d)
    if kind and (kind not in _ALIKE_KINDS or (kind == "<square>" and ord(c) > 0xFFFF)):
        return None
    out = "".join(chr(int(x, 16)) for x in parts.split())
    # spacing accents are composed of a blank and an accent; they don't look like a blank
    if out[0] == " " and len(out) > 1:
        return None
    # dots, roman numerals and signs in brackets stay; letters and digits of other widths, ligatures, units are joined
    if kind == "<compat>" and (unicodedata.category(c) in ("No", "Nl", "Po") or out[0] == "("):
        return None
    return out


@lru_cache(maxsize=1)
def look_alike_classes() -> tuple[tuple[tuple[str, ...], ...], frozenset[str]]:
    """(classes of at least two strings, invisible code points), from the
    Unicode data of this Python and the fixed letters above."""
    uf = Classes()
    invisible = set()
    base_alike: dict[str, set[str]] = {}
    for letter, others in LETTERS.items():
        for o in others:
            uf.join(letter, o)
            base_alike.setdefault(letter, set()).add(o)
    for h in HYPHENS:
        uf.join("-", h)
    composed: list[tuple[str, str, str]] = []
    for n in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= n <= 0xD7A3 or 0xD800 <= n <= 0xDFFF or 0xF900 <= n <= 0xFAFF or 0x2F800 <= n <= 0x2FA1F or 0xE000 <= n <= 0xF8FF or n >= 0xF0000:
            continue
        c = chr(n)
        if _invisible(c):
            invisible.add(c)
        elif unicodedata.category(c) == "Zs":
            uf.join(" ", c)
        elif d := _decomposition(c):
            uf.join(c, d)
            if len(d) == 2 and unicodedata.combining(d[1]):
                composed.append((c, d[0], d[1]))
    # an accent on a look-alike of the base is a look-alike of the accented letter; several accents may be written out
    parts = {c: (b, m) for c, b, m in composed}
    for c, b, m in composed:
        for other in base_alike.get(b, ()):
            uf.join(c, other + m)
        if b in parts:
            bb, bm = parts[b]
            uf.join(c, bb + bm + m)
            if unicodedata.combining(bm) != unicodedata.combining(m):
                uf.join(c, bb + m + bm)
    return tuple(tuple(g) for g in uf.groups()), frozenset(invisible)


def _letters(s: str) -> int:
    return sum(not unicodedata.combining(c) for c in s)


def choose(counts: dict[str, int]) -> dict[str, str]:
    """Every member that has to be rewritten -> the representative of its
    class: among the members that spell out the most letters (so that part of
    a ligature is found inside it) the most frequent, then the shortest, then
    the first in code point order. Combining sequences give way to a composed
    letter, so that a bare letter isn't found inside an accented one."""
    groups, invisible = look_alike_classes()
    out = dict.fromkeys(invisible, "")
    for group in groups:
        # a representative is its own canonical form
        stable = [s for s in group if unicodedata.is_normalized("NFC", s)] or group
        most = max(map(_letters, stable))
        spelled = [s for s in stable if _letters(s) == most]
        plain = [s for s in spelled if len(s) == most] or spelled
        best = min(plain, key=lambda s: (-counts.get(s, 0), len(s), s))
        out |= {s: best for s in group if s != best}
    # closed: parts of a representative may belong to classes of their own
    rewriter = Rewriter(out)
    closed = {k: rewriter(v) if v else v for k, v in out.items()}
    return {k: v for k, v in closed.items() if k != v}


class Rewriter:
    """Replaces members by representatives, longest match first, left to
    right, until nothing changes."""

    def __init__(self, mapping: dict[str, str]) -> None:
        self.mapping = mapping
        contextual = {c for c in map(chr, [*map(ord, JOINERS), *range(0xE0020, 0xE0080)])}
        self.invisible = {ord(k): None for k, v in mapping.items() if v == "" and len(k) == 1 and k not in contextual}
        self.automaton = ahocorasick.Automaton()
        for k, v in mapping.items():
            if v:
                self.automaton.add_word(k, (len(k), v))
        self.automaton.make_automaton()
        # a canonical text without the last code point of any member stays as it is
        self.trigger = frozenset(k[-1] for k in mapping)

    @property
    def plain_ascii_stays(self) -> bool:
        return not any(c < "\x80" for c in self.trigger)

    def _once(self, text: str) -> str:
        out, at = [], 0
        for end, (n, v) in self.automaton.iter_long(text):
            start = end - n + 1
            out += (text[at:start], v)
            at = end + 1
        out.append(text[at:])
        return unicodedata.normalize("NFC", "".join(out))

    def __call__(self, text: str | None) -> str | None:
        if not text or (self.trigger.isdisjoint(text) and unicodedata.is_normalized("NFC", text)):
            return text
        text = text.translate(self.invisible)  # these may stand inside a longer member
        while (bare := _NO_FLAG.sub("", _NO_JOIN.sub("", text))) != text:
            text = bare
        text = unicodedata.normalize("NFC", text)
        met = []  # should rewriting ever go round, the smallest text of the round is taken
        while text not in met:
            met.append(text)
            text = self._once(text)
        return min(met[met.index(text) :])


def member_counts(texts: DataFrame, column: str) -> dict[str, int]:
    """Occurrences in the corpus of every class member of one code point (longer
    members count as 0): counted per batch, summed by one shuffle of a few rows
    per task. The result is bounded by the table of members, not by the data,
    and goes to the driver as the automaton's input."""
    groups, _ = look_alike_classes()
    single = np.array(sorted({ord(s) for g in groups for s in g if len(s) == 1}), dtype=np.uint32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(single), dtype=np.int64)
        for batch in batches:
            for chunk in np.array_split(np.array(batch.column(0).drop_null().to_pylist(), dtype=object), 1 + batch.num_rows // 500):
                cp = np.frombuffer("".join(chunk).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                seen, n = np.unique(cp[cp >= 128], return_counts=True)
                few = np.bincount(cp[cp < 128], minlength=128)
                at = np.searchsorted(single, seen)
                at[at == len(single)] = 0
                hit = single[at] == seen
                total[at[hit]] += n[hit]
                low = single < 128
                total[low] += few[single[low]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(single[some].astype(np.int32)), pa.array(total[some])], names=["cp", "n"])

    rows = texts.select(column).mapInArrow(count, "cp int, n long").groupBy("cp").agg(F.sum("n").alias("n"))
    return {chr(r.cp): r.n for r in rows.collect()}


def mapping_for(*corpora: tuple[DataFrame, str]) -> dict[str, str]:
    """The rewriting chosen by the frequencies of all (table, text column)."""
    counts: dict[str, int] = {}
    for df, column in corpora:
        for k, n in member_counts(df, column).items():
            counts[k] = counts.get(k, 0) + n
    return choose(counts)


def corpus_mapping(questions: DataFrame, sections: DataFrame) -> dict[str, str]:
    """The rewriting by the frequencies of all expected substrings and all
    paragraphs, so that every query writes a text the same way."""
    return mapping_for((questions.select(F.explode("expected_substrings").alias("text")), "text"), (sections.select(F.explode("paragraphs").alias("text")), "text"))


def uniform(c: Column, mapping: dict[str, str]) -> Column:
    """A text column in its uniform form; null stays null. Texts of plain ASCII
    aren't sent to Python unless the mapping rewrites ASCII."""

    @F.pandas_udf("string")
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewriter = Rewriter(mapping)
        for batch in batches:
            yield batch.map(rewriter, na_action="ignore")

    if not Rewriter(mapping).plain_ascii_stays:
        return rewrite(c)
    return F.coalesce(rewrite(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def only_to_the_eye(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """(question_id, substring_pos) of expected substrings that look as if
    they were contained in a paragraph of the question's sections (those of
    its doc_hash and, unless section is null, of number = section), but are
    contained code point for code point in none.

    Null substrings and paragraphs, and questions without doc_hash, are no
    case; an empty substring is contained in any paragraph, so it is none
    either. Repeated questions and sections change nothing. Forms are chosen by the
    whole corpus, but only paragraphs of documents with questions are looked at; substrings meet the paragraphs of
    their own sections inside the join, which emits matches only and is split
    by adaptive execution where one document is hot."""
    asked = questions.where("doc_hash is not null").select("question_id", "doc_hash", "section", F.posexplode("expected_substrings").alias("substring_pos", "sub"))
    asked = asked.where("sub is not null").distinct()
    mapping = corpus_mapping(questions, sections)

    def formed(df: DataFrame, text: str) -> DataFrame:
        """df with the form of a text, where it differs; written once, as it is read twice."""
        form = df.withColumn("_form", uniform(F.col(text), mapping))
        return staged(form.withColumn(f"{text}_form", F.when(F.col("_form") != F.col(text), F.col("_form"))).drop("_form"), text)

    a = formed(asked, "sub")
    paras = sections.join(a.select("doc_hash").distinct(), "doc_hash", "left_semi").select("doc_hash", "number", F.explode("paragraphs").alias("para"))
    p = formed(paras.where("para is not null"), "para")
    visible = F.contains(F.coalesce("para_form", "para"), F.coalesce("sub_form", "sub")) | F.contains(F.col("para"), F.col("sub"))
    exact = F.contains(F.col("para"), F.col("sub"))

    def met(some: DataFrame, on: list[str]) -> DataFrame:
        return some.join(p.select(*on, "para", "para_form"), on).where(visible).groupBy("question_id", "substring_pos").agg(F.max(exact).alias("exact"))

    in_section = met(a.where("section is not null").withColumnRenamed("section", "number"), ["doc_hash", "number"])
    anywhere = met(a.where("section is null").drop("section"), ["doc_hash"])
    # a question that comes repeatedly, with and without its section, is asked in both ways
    found = in_section.unionByName(anywhere).groupBy("question_id", "substring_pos").agg(F.max("exact").alias("exact"))
    return found.where("not exact").select("question_id", "substring_pos")
