"""Encoding texts with a public byte-level BPE vocabulary.

The merges run as rounds over one flat array that holds the symbols of many
distinct words at once. A round finds the rank of every adjacent pair by binary
search over the sorted pair keys, takes in every word its lowest-ranked pair,
replaces all its occurrences, and drops the words that have no pair left.
Texts are cut at white space into pieces first; a task encodes each distinct
piece it meets once and copies its ids from then on.

Defined results: a null text and an empty text give an empty list; every row of
the input gives one row, repeated ids included; whole texts are encoded,
whatever their length; special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern that splits text into words before the merges.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space with what follows it up to the next white space. The words of such a piece do not depend on its
#: neighbours, so pieces are what a task remembers. \\x1c-\\x1f are white space to Python but not to the word pattern.
PIECE_PATTERN = r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+"
TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE_50K = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
#: A vocabulary file beyond this size is refused, as its table is broadcast.
MAX_VOCABULARY_BYTES = 16_000_000
#: Characters of text handled at a time, and distinct words remembered by a task.
SLICE_CHARS, MEMORY_PIECES, MEMORY_IDS = 2_000_000, 400_000, 8_000_000
_SHIFT = 1 << 32
_NONE = np.int64(1) << 62


class PairTable:
    """The vocabulary as sorted keys of symbol pairs and the symbols they make."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, made = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * _SHIFT + right)
                    made.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.made = np.array(made, dtype=np.int64)[order]

    @classmethod
    def read(cls, path: str) -> PairTable:
        if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
            raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))})

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol each pair makes, which is also its rank; _NONE for no pair."""
        wanted = left * _SHIFT + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.made[at], _NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and the number of ids of each word."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbols = self.bytes[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_words = [], []
        while len(symbols):
            rank = np.full(len(symbols), _NONE)
            rank[:-1] = np.where(word[:-1] == word[1:], self.ranks(symbols[:-1], symbols[1:]), _NONE)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(word)]))
            over = lowest == _NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                symbols, word, rank, lowest = (x[~over] for x in (symbols, word, rank, lowest))
            hit = rank == lowest
            # pairs that share a symbol: from the left, every other one of a run is replaced
            at = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], at, -1)) if len(hit) else at
            hit &= (at - run) % 2 == 0
            symbols = np.where(hit, rank, symbols)
            keep = ~np.r_[False, hit[:-1]] if len(hit) else hit
            symbols, word = symbols[keep], word[keep]
        if not done_symbols:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        return symbols[np.argsort(word, kind="stable")].astype(np.int32), np.bincount(word, minlength=len(words))


class Encoder:
    """A pair table with the pieces it has met, for whole batches of texts."""

    def __init__(self, pairs: PairTable):
        self.pairs = pairs
        self.pieces, self.words = re.compile(PIECE_PATTERN).findall, regex.compile(WORD_PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.start = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.index]
        if not new:
            return
        split = [self.words(p) for p in new]
        words = list(set(chain.from_iterable(split)))
        flat, size = self.pairs.encode([w.encode("utf-8", "surrogatepass") for w in words])
        place = {w: i for i, w in enumerate(words)}
        start = np.cumsum(size) - size
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), dtype=np.int64)
        ids, sizes = _gather(flat, start, size, at, np.fromiter(map(len, split), dtype=np.int64, count=len(split)))
        self.start = np.r_[self.start, len(self.flat) + np.cumsum(sizes) - sizes]
        self.flat, self.size = np.r_[self.flat, ids], np.r_[self.size, sizes]
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))

    def places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The places of all pieces of the texts, and the number of pieces of each text."""
        split = [self.pieces(t) if t else [] for t in texts]
        if len(self.index) > MEMORY_PIECES or len(self.flat) > MEMORY_IDS:
            self.forget()
        self.learn(set().union(*split))
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        return np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(counts.sum())), counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of ids of each text."""
        at, counts = self.places(texts)
        return _gather(self.flat, self.start, self.size, at, counts)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        at, counts = self.places(texts)
        return np.diff(np.r_[0, np.cumsum(self.size[at])][np.r_[0, np.cumsum(counts)]])


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the stretches flat[start:start + size] at the given places; sizes of consecutive groups of them."""
    sizes = size[at]
    ends = np.r_[0, np.cumsum(sizes)]
    ids = flat[np.repeat(start[at] - ends[:-1], sizes) + np.arange(ends[-1])]
    return ids, np.diff(ends[np.r_[0, np.cumsum(counts)]])


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of about SLICE_CHARS characters together."""
    begin = chars = 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if chars >= SLICE_CHARS:
            yield begin, i + 1
            begin, chars = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


_KEPT: dict[int, Encoder] = {}


def _encoder(pairs: PairTable) -> Encoder:
    """The encoder of this Python worker, kept from task to task with the pieces it has met."""
    if id(pairs) not in _KEPT:
        _KEPT.clear()
        _KEPT[id(pairs)] = Encoder(pairs)
    return _KEPT[id(pairs)]


@lru_cache(maxsize=4)
def _pairs(path: str) -> PairTable:
    return PairTable.read(path)


def _plain(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(df[id_column].alias("key"), df[text_column].alias("text"))


def encode_corpus(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """(id, ids array<int>) of every row; the table of the vocabulary is read once and broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(_pairs(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids, sizes = encoder.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["key", "ids"])

    key = df.schema[id_column].dataType.simpleString()
    return _plain(df, id_column, text_column).mapInArrow(run, f"key {key}, ids array<int>").withColumnRenamed("key", id_column)


def count_tokens(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = BYTE_BPE_50K, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, n_tokens bigint) of every row, by the same pieces and merges without building the lists."""
    shared = df.sparkSession.sparkContext.broadcast(_pairs(vocabulary))
    plain = df.select(df[text_column].alias("text"), df[id_column].alias("key"), *[df[c].alias(f"kept_{i}") for i, c in enumerate(keep)])
    names = [*plain.columns[1:], "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                kept = [batch.column(c).slice(a, b - a) for c in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(encoder.count(texts[a:b]))], names=names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[1:])
    return plain.mapInArrow(run, f"{schema}, n_tokens bigint").toDF(id_column, *keep, "n_tokens")
