"""Byte-level BPE encoding in linear time, and decoding by an offset table.

A text is cut into words by the tokenizer's pattern. Within a word an
Aho-Corasick automaton gives the longest token that starts at each byte;
walking left to right, a token is kept if it is compatible with the one before
(merging their bytes by rank gives exactly these two tokens), otherwise a
shorter one is tried, and where none fits the walk goes back one token and
never enters that position again. The result equals that of merging by rank.

The vocabulary is read once from ``path`` by the driver and travels to the
workers as one broadcast of a fixed size; it is never copied into this
repository.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# Fixed value: the pattern that cuts texts into words for byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words whose ids are remembered by a worker, and pairs of tokens.
WORD_CACHE = 1 << 18
PAIR_CACHE = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The vocabulary file's letters for bytes: printable Latin-1 characters
    stand for themselves, the other bytes for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """tokens: the bytes of each id, as Latin-1 strings; merges: (left, right)
    in order of rank."""

    def __init__(self, tokens: list[str], merges: list[tuple[str, str]]) -> None:
        self.tokens = tokens
        self.words = regex.compile(PATTERN)
        ids = {t: i for i, t in enumerate(tokens) if t}
        self.ids = ids
        self.size = [len(t) for t in tokens]
        # id of the merged token by its two parts; a token's parts; ranks are in order of merges
        self.merged: dict[tuple[int, int], int] = {}
        self.parts = [(i, i) for i in range(len(tokens))]
        self.rank = [0] * len(tokens)
        for rank, (a, b) in enumerate(merges, 1):
            pair, whole = (ids[a], ids[b]), ids[a + b]
            self.merged.setdefault(pair, whole)
            if self.rank[whole] == 0:
                self.parts[whole], self.rank[whole] = pair, rank
        # tokens that merging by rank can reach, and each one's longest proper prefix among them
        reachable = [t for t in tokens if len(t) == 1 or (t and self.rank[ids[t]])]
        self.automaton = ahocorasick.Automaton()
        for t in reachable:
            self.automaton.add_word(t, ids[t])
        self.automaton.make_automaton()
        known = set(reachable)
        self.shorter = [-1] * len(tokens)
        for t in reachable:
            self.shorter[ids[t]] = next((ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in known), -1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, array] = {}
        # decoding: all tokens' bytes in one blob, and where each begins
        self.blob = np.frombuffer("".join(tokens).encode("latin-1"), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.size)])

    @classmethod
    def parse(cls, text: str) -> Encoder:
        model = json.loads(text)["model"]
        alphabet = byte_alphabet()

        def plain(token: str) -> str:
            return "".join(chr(alphabet[c]) for c in token)

        vocabulary = model["vocab"]
        tokens = [""] * (max(vocabulary.values()) + 1)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        for token, i in vocabulary.items():
            if len(token) == 1 or token in made:  # special tokens are ordinary text
                tokens[i] = plain(token)
        return cls(tokens, [(plain(a), plain(b)) for a, b in merges])

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, merged by rank, give a and b: taking
        the latest merge of either apart again and again, no merge across the
        border may come before it."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        merged, parts, rank = self.merged, self.parts, self.rank
        limit, left_made = len(rank) + 1, True
        while True:
            across = merged.get((a, b))
            # a merge across the border precedes one of the left side of the same or later rank, and one of the right side of a later rank
            if across is not None and (rank[across] < limit if left_made else rank[across] <= limit):
                return False
            if rank[a] == 0 and rank[b] == 0:
                return True
            # undo the later merge; of equal ranks the right one was made later
            if rank[a] > rank[b]:
                limit, left_made, a = rank[a], True, parts[a][1]
            else:
                limit, left_made, b = rank[b], False, parts[b][0]

    def encode_word(self, word: str) -> array:
        """Ids of one word, given as Latin-1 string of its UTF-8 bytes."""
        n = len(word)
        longest = [-1] * n
        size = self.size
        for end, token in self.automaton.iter(word):
            start = end - size[token] + 1
            if longest[start] < 0 or size[longest[start]] < size[token]:
                longest[start] = token
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            while token >= 0 and not (open_at[at + size[token]] and (not out or self.compatible(out[-1], token))):
                token = self.shorter[token]
            if token < 0:  # nothing fits here any more: back to the token before, which then gets shorter
                open_at[at] = 0
                token = out.pop()
                at -= size[token]
                continue
            out.append(token)
            at += size[token]
            if at == n:
                return array("i", out)
            token = longest[at]

    def encode(self, text: str) -> array:
        out, cache = array("i"), self.cache
        for word in self.words.findall(text):
            ids = cache.get(word)
            if ids is None:
                if len(cache) >= WORD_CACHE:
                    cache.clear()
                ids = self.encode_word(word.encode("utf-8", "surrogatepass").decode("latin-1"))
                if len(word) <= 64:
                    cache[word] = ids
            out.extend(ids)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of many ids by one gather from the blob."""
        ids = np.asarray(ids, dtype=np.int64)
        start, n = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        before = np.cumsum(n) - n
        return self.blob[np.repeat(start - before, n) + np.arange(n.sum())].tobytes()


@lru_cache(maxsize=4)
def encoder_of(text: str) -> Encoder:
    return Encoder.parse(text)


def shipped_encoder(df: DataFrame, path: str) -> Callable[[], Encoder]:
    """A function that gives the encoder on a worker; it is built once there."""
    with open(path, encoding="utf-8") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    return lambda: encoder_of(sent.value)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, ids array<int>) of every row, without special tokens; text that
    looks like one is ordinary text. Null and empty texts give an empty list.
    Repeated rows give repeated rows, other columns are ignored."""
    encoder = shipped_encoder(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for batch in batches:
            lists = [e.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate([np.frombuffer(x, dtype=np.int32) for x in lists if len(x)] or [np.zeros(0, np.int32)])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text_col: str = "text", out: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """df without text_col, with the token count of its text."""
    encoder = shipped_encoder(df, path)
    keep = [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for batch in batches:
            n = pa.array([len(e.encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*keep, out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text_col]
    return spread(df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))).mapInArrow(run, ", ".join([*fields, f"`{out}` long"]))


def decode_texts(encoded: DataFrame, id_col: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """(id, text) from the output of encode_texts; the inverse for all texts
    but null, which comes back empty. Null ids give null."""
    encoder = shipped_encoder(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for batch in batches:
            texts = [None if x is None else e.decode(np.array(x, dtype=np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")
