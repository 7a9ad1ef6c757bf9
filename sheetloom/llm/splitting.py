"""Cutting oversized texts at natural boundaries, with overlap.

Sizes are in tokens of four code points, rounded up. A text is cut at ends
e1 < e2 < ... < en = its length; piece i runs from the overlap before the last
end to its own end, so consecutive pieces share exactly ``overlap`` tokens and
no piece has more than ``limit``.

Every position that may end a piece is a boundary of some strength: end of a
paragraph (a blank line, or the line before a heading), of a line, of a sentence
(closing quotes and brackets belong to it), of a word. Lines inside a fence and
between two rows of a table count as sentences, so that these come apart last
among lines. Synthetic boundaries cut stretches that have none, never between a
letter and its combining marks or joiners. Each boundary is joined to its farthest legal successor: the last boundary of
the strongest kind present in the second half of the reachable window, else of
the strongest present at all. The successor table is then squared again and
again (pointer doubling), which marks all ends of all texts of a batch in
log2(longest chain) vectorised steps rather than piece by piece.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.runtime import spread

CHARS_PER_TOKEN = 4
LIMIT = 512
#: Texts are handled in groups of about so many code points, each text whole.
CHUNK_CHARS = 1 << 20
OVERLAP = 40

# Code points that end a line, a sentence, or are blank.
_NEWLINES = np.array([0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029], dtype=np.uint32)
_STOPS = np.array([0x21, 0x2E, 0x3F, 0x3002, 0xFF01, 0xFF1F, 0x2026], dtype=np.uint32)
_WIDE_STOPS = np.array([0x3002, 0xFF01, 0xFF1F], dtype=np.uint32)
_BLANKS = np.array([0x09, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000], dtype=np.uint32)

_CLOSERS = np.array([0x22, 0x27, 0x29, 0x5D, 0x7D, 0xBB, 0x2019, 0x201D, 0x203A, 0x300D, 0x300F, 0xFF09], dtype=np.uint32)
_HASH, _PIPE, _FENCE = 0x23, 0x7C, 0x60

#: Strengths, weakest first; the end of a text is stronger than all.
WORD, SENTENCE, LINE, PARAGRAPH = 0, 1, 2, 3
END = 4


def boundary_strengths(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, strengths) of the boundaries of a run of code points, in
    which texts begin at starts. A boundary at p ends a piece before code point
    p."""
    newline = np.isin(cp, _NEWLINES)
    blank = newline | np.isin(cp, _BLANKS)
    stop = np.isin(cp, _STOPS)
    # what closes a quote or bracket right behind a stop ends the sentence in its place
    closer = np.isin(cp, _CLOSERS)
    ends = np.maximum.accumulate(np.where(closer, -1, np.arange(len(cp))))  # the last code point that is no closer
    stop |= closer & (ends >= 0) & stop[np.maximum(ends, 0)]
    stop[starts[starts > 0] - 1] = False  # the next text's blank doesn't end this text's sentence
    strength = np.full(len(cp) + 1, -1, dtype=np.int8)
    strength[1:][blank] = WORD
    # after the blank that follows a stop, or right after a full-width stop
    strength[2:][stop[:-1] & blank[1:]] = SENTENCE
    strength[1:][np.isin(cp, _WIDE_STOPS)] = SENTENCE
    strength[1:][newline] = LINE
    _mark_lines(cp, newline, blank, starts, strength)
    at = np.flatnonzero(strength >= 0)
    return at, strength[at]


def _mark_lines(cp: np.ndarray, newline: np.ndarray, blank: np.ndarray, starts: np.ndarray, strength: np.ndarray) -> None:
    """Changes the strength of line ends by the lines around them."""
    text_starts = np.unique(starts[starts < len(cp)])
    begin = np.union1d(text_starts, np.flatnonzero(newline[:-1]) + 1)  # where lines begin
    if len(begin) < 2:
        return
    end = np.append(begin[1:], len(cp))
    inked = np.append(np.cumsum(~blank), 0)
    empty = (inked[end - 1] - np.where(begin > 0, inked[begin - 1], 0)) == 0
    first = cp[begin]
    fence = (first == _FENCE) & (begin + 2 < end)
    fence[fence] = (cp[begin[fence] + 1] == _FENCE) & (cp[begin[fence] + 2] == _FENCE)
    opened = np.cumsum(fence)  # fences up to and with the line; counted from each text's start below
    text = np.searchsorted(text_starts, begin, side="right") - 1
    before_text = np.append(0, opened)[np.searchsorted(begin, text_starts)]
    inside = (opened - before_text[text]) % 2 == 1  # the line's end lies inside a fence
    last, following = np.arange(len(begin) - 1), np.arange(1, len(begin))
    same = text[last] == text[following]
    # the line end between two lines of a text lies where the second begins
    at = begin[following][same]
    last, following = last[same], following[same]
    grade = np.full(len(at), LINE, dtype=np.int8)
    grade[empty[last] | ((first[following] == _HASH) & ~inside[last])] = PARAGRAPH
    grade[inside[last] | ((first[last] == _PIPE) & (first[following] == _PIPE))] = SENTENCE
    strength[at] = grade


def _is_extending(cp: np.ndarray) -> np.ndarray:
    """Code points that belong to the one before them."""
    kinds = {c: unicodedata.category(chr(c)) in ("Mn", "Mc", "Me") or c in (0x200C, 0x200D) or 0x1F3FB <= c <= 0x1F3FF for c in np.unique(cp).tolist()}
    return np.array([kinds[c] for c in cp.tolist()], dtype=bool)


def _careful_cuts(cp: np.ndarray, begin: int, end: int, step: int, shift: int) -> list[int]:
    """Cuts at most a step apart between two boundaries, before code points
    that begin a letter; a letter of more than half a step is cut hard."""
    out, at = [], begin
    while end - at > step:
        cut = at + step
        back = cut
        while back > at + step // 2 and (_is_extending(cp[back + shift : back + shift + 1])[0] or cp[back + shift - 1] == 0x200D):
            back -= 1
        at = back if back > at + step // 2 else cut
        out.append(at)
    return out


def cut_ends(lengths: np.ndarray, cp: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, end) of all pieces of a batch of texts whose code points follow
    each other in cp. limit and overlap are in code points, limit > overlap.

    Positions are those of the batch; each text's coordinates are shifted so
    that texts can't reach each other."""
    step = limit - overlap
    starts = np.concatenate([[0], np.cumsum(lengths)])
    at, strength = boundary_strengths(cp, starts)
    text = np.searchsorted(starts, at, side="left") - 1  # a boundary at a text's very end belongs to that text
    ok = text >= 0
    at, strength, text = at[ok], strength[ok], text[ok]
    n = len(lengths)
    # nodes: per text its start (a virtual end at `overlap`, so that the first window is a whole limit), its boundaries, its end
    gap = limit + 1
    base = np.arange(n, dtype=np.int64) * 2 * gap + starts[:-1]  # shifted coordinates: base[t] + position within the text
    where = np.concatenate([base + np.minimum(overlap, lengths), base[text] + (at - starts[text]), base + lengths])
    kind = np.concatenate([np.full(n, PARAGRAPH, np.int8), strength, np.full(n, END, np.int8)])
    owner = np.concatenate([np.arange(n), text, np.arange(n)])
    first = np.concatenate([np.ones(n, bool), np.zeros(len(at) + n, bool)])
    # boundaries inside the first `overlap` code points can't be ends: the next piece would start before the text
    keep = first | (where - base[owner] > overlap) | (kind == END)
    where, kind, owner, first = where[keep], kind[keep], owner[keep], first[keep]
    order = np.lexsort((~first, where, owner))
    where, kind, owner, first = where[order], kind[order], owner[order], first[order]
    # synthetic boundaries wherever two nodes of a text are farther apart than a step
    far = np.flatnonzero((owner[1:] == owner[:-1]) & (where[1:] - where[:-1] > step))
    if len(far):
        counts = (where[far + 1] - where[far] - 1) // step
        k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + 1
        extra, run = np.repeat(where[far], counts) + k * step, np.repeat(far, counts)
        place = np.minimum(extra - base[owner[run]] + starts[owner[run]], len(cp) - 1)
        torn = np.unique(run[_is_extending(cp[place]) | (cp[place - 1] == 0x200D)])
        if len(torn):
            # these runs are cut one by one, each cut moved back to where a letter begins
            kept = ~np.isin(run, torn)
            cuts = [(r, c) for r in torn.tolist() for c in _careful_cuts(cp, int(where[r]), int(where[r + 1]), step, int(starts[owner[r]] - base[owner[r]]))]
            extra = np.concatenate([extra[kept], np.array([c for _, c in cuts], dtype=np.int64)])
            run = np.concatenate([run[kept], np.array([r for r, _ in cuts], dtype=np.int64)])
        where = np.concatenate([where, extra])
        kind = np.concatenate([kind, np.full(len(extra), -1, np.int8)])
        owner = np.concatenate([owner, owner[run]])
        first = np.concatenate([first, np.zeros(len(extra), bool)])
        order = np.lexsort((~first, where, owner))
        where, kind, owner, first = where[order], kind[order], owner[order], first[order]
    m = len(where)
    ids = np.arange(m)
    reach = np.searchsorted(where, where + step, side="right") - 1  # farthest node in the window; never another text's
    half = np.searchsorted(where, where + step // 2, side="right")  # first node of the window's second half
    successor = np.full(m, -1, dtype=np.int64)
    for lower in (half, ids + 1):
        for strongest in (END, PARAGRAPH, LINE, SENTENCE, WORD, -1):
            last = np.maximum.accumulate(np.where(kind >= strongest, ids, -1))
            candidate = last[reach]
            take = (successor < 0) & (candidate >= np.maximum(lower, ids + 1))
            successor[take] = candidate[take]
    # a text's end is its own successor (and nothing else is: a next node is at most a step away)
    ends = kind == END
    successor[ends] = ids[ends]
    successor[successor < 0] = ids[successor < 0]
    marked = first.copy()
    jump = successor
    while True:
        reached = jump[marked]
        if marked[reached].all():
            break
        marked[reached] = True
        jump = jump[jump]
    marked &= ~first
    return owner[marked], where[marked] - base[owner[marked]]


def split_batch(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the pieces of many texts, in order."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    some = np.flatnonzero(lengths > 0)
    owners, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # whole texts, a bounded number of code points at a time
    for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(lengths[some]) // CHUNK_CHARS)) + 1):
        if len(part):
            cp = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            owner, end = cut_ends(lengths[part], cp, limit * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN)
            owners.append(part[owner])
            ends.append(end)
    owner, end = np.concatenate(owners), np.concatenate(ends)
    same = owner[1:] == owner[:-1]
    start = np.zeros(len(end), np.int64)
    start[1:][same] = end[:-1][same] - overlap * CHARS_PER_TOKEN
    return owner, start, end


def split_pieces(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(id, piece_pos, piece_count, start, end, token_count[, text]) of all
    pieces; start and end count code points. A text within the limit is one
    piece, a null or empty text none. Repeated rows give repeated pieces;
    other columns of df are ignored."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece_pos int, piece_count int, start int, `end` int, token_count int" + (", text string" if with_text else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            owner, start, end = split_batch(texts, limit, overlap)
            count = np.bincount(owner, minlength=len(texts))
            pos = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            columns = [
                batch.column(0).take(pa.array(owner)),
                pa.array(pos, pa.int32()),
                pa.array(count[owner], pa.int32()),
                pa.array(start, pa.int32()),
                pa.array(end, pa.int32()),
                pa.array(-((start - end) // CHARS_PER_TOKEN), pa.int32()),
            ]
            names = [id_col, "piece_pos", "piece_count", "start", "end", "token_count"]
            if with_text:
                columns.append(pa.array([texts[o][s:e] for o, s, e in zip(owner.tolist(), start.tolist(), end.tolist(), strict=True)], pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return spread(df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))).mapInArrow(cut, schema)


def oversized(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The distinct ids of texts that had to be cut."""
    return split_pieces(df, id_col, text_col, limit, overlap, with_text=False).where("piece_pos = 1").select(id_col).distinct()
