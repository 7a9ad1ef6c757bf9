"""The share of a document's words that repeat earlier words of the same
document, by suffix arrays.

The words of a group of documents form one sequence in which documents can't
match each other. Ranks of all substrings of 1, 2, 4, ... words (prefix
doubling) give the suffix array; the same ranks, taken from long to short, give
the longest common prefix of neighbours in it. Runs of neighbours whose common
prefix has at least ``run`` words are the LCP intervals of substrings that
repeat; every suffix of an interval but the first in the document has an
earlier copy, so its first ``run`` words are repeated. The union of these spans
is that of all maximal repeated substrings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.runtime import spread

#: A word is repeated if it lies in so many words running that occurred before.
RUN_WORDS = 6
#: A document is a case from this share of repeated words on, as a fraction.
SHARE = (7, 20)
#: Documents are handled in groups of about so many words, each one whole.
GROUP_WORDS = 1 << 18

_WORD = re.compile(r"[^\W_]+")


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks of substrings of 1, 2, 4, ... symbols at every
    position). Ranks start at 1; 0 stands for what lies past the end."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    levels, width = [rank], 1
    while rank.max(initial=0) < n and width < n:
        after = np.zeros(n, dtype=np.int64)
        after[: n - width] = rank[width:]
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        levels.append(rank)
        width *= 2
    return np.argsort(rank, kind="stable"), levels


def neighbour_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of each suffix with the next one in order."""
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(len(a), dtype=np.int64)
    n = len(order)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), dtype=bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        step = same * (1 << k)
        lcp += step
        a += step
        b += step
    return lcp


def measure(doc: np.ndarray, word: np.ndarray, docs: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(repeated words, words of the longest repeat) of each of ``docs``
    documents; doc and word give each position's document (ascending) and
    word id."""
    repeated, longest = np.zeros(docs, dtype=np.int64), np.zeros(docs, dtype=np.int64)
    if not len(doc):
        return repeated, longest
    # one closing symbol per document, that no other position has: no match crosses documents
    ends = np.flatnonzero(np.diff(doc, append=doc[-1] + 1)) + 1
    size = int(word.max()) + 2
    symbols = np.insert(doc.astype(np.int64) * size + word, ends, doc[ends - 1].astype(np.int64) * size + size - 1)
    owner = np.insert(doc, ends, doc[ends - 1])
    order, levels = suffix_order(symbols)
    lcp = neighbour_prefixes(order, levels)
    np.maximum.at(longest, owner[order[:-1]], np.where(lcp >= run, lcp, 0))
    # intervals: runs of neighbours with a common prefix of `run` words; the smallest position of each is the first copy
    interval = np.concatenate([[0], np.cumsum(lcp < run)])
    first = np.full(interval[-1] + 1, len(symbols), dtype=np.int64)
    np.minimum.at(first, interval, order)
    again = order[order > first[interval]]
    cover = np.zeros(len(symbols) + 1, dtype=np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + run, -1)
    np.add.at(repeated, owner, np.cumsum(cover[:-1]) > 0)
    return repeated, longest


def measure_texts(texts: list[str], run: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, repeated words, words of the longest repeat) of each text."""
    n_words = np.zeros(len(texts), dtype=np.int64)
    repeated, longest = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    start, held, ids, lower = 0, [], {}, {}

    def flush(end: int) -> None:
        if held:
            words = np.concatenate(held)
            doc = np.repeat(np.arange(end - start), n_words[start:end])
            repeated[start:end], longest[start:end] = measure(doc, words, end - start, run)

    size = 0
    for i, text in enumerate(texts):
        words = _WORD.findall(text)
        out = np.empty(len(words), dtype=np.int64)
        for j, w in enumerate(words):
            known = ids.get(w)
            if known is None:
                known = ids[w] = lower.setdefault(w.lower(), len(lower))
            out[j] = known
        n_words[i] = len(words)
        held.append(out)
        size += len(words)
        if size >= GROUP_WORDS:
            flush(i + 1)
            start, held, size, ids, lower = i + 1, [], 0, {}, {}
    flush(len(texts))
    return n_words, repeated, longest


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN_WORDS) -> DataFrame:
    """(id, n_words, repeated_words, repeated_share, longest_repeat) of every
    row. Words are runs of letters and digits in lower case. Null and empty
    texts have no words and the share 0; repeated rows give repeated rows;
    other columns are ignored. No shuffle: each document is measured whole, in
    the task that reads it."""
    kind = df.schema[id_col].dataType.simpleString()

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, r, longest = measure_texts(batch.column(1).to_pylist(), run)
            share = r / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(r), pa.array(share), pa.array(longest)],
                names=[id_col, "n_words", "repeated_words", "repeated_share", "longest_repeat"],
            )

    return spread(df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))).mapInArrow(
        run_batches, f"`{id_col}` {kind}, n_words long, repeated_words long, repeated_share double, longest_repeat long"
    )


def repetitive(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: tuple[int, int] = SHARE) -> DataFrame:
    """Distinct ids of documents with at least the given share of repeated
    words (compared in whole numbers)."""
    enough = (F.col("n_words") > 0) & (F.col("repeated_words") * share[1] >= F.col("n_words") * share[0])
    return repetition(df, id_col, text_col).where(enough).select(id_col).distinct()
