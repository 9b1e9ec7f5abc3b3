"""Pages made of strung-together search words, product tags or links in place of sentences.

Every line is reduced to a shape: how many words it has, how many of them are
capitalised, how many separators, and whether it holds links, tags, numbers or
initials. Shapes of one page are grouped, and a page is flagged if few shapes that
are no sentences hold most of it.

Which shapes are no sentences is seen from the lines themselves, without any list
of words. Lines with links or tags (#word, joined_word, product codes like AB-123)
are none. Lines of numbers or initials are records, as tables of prices, ships,
results, names and contents have them; lines in capitals are headings; neither
speaks for or against. The running text of all other lines is cut at the ends of
sentences, and after lines of verse (capitalised, with one comma, at the end). A
piece is a sentence if it ends (scans read a dot as ; too), has some words but not
endlessly many, hardly repeats them (long ones even less) and is not mostly
separators; a piece that breaks off counts if it is short, repeats nothing and
holds no link. Search words strung together either never end, or end after every
phrase, or repeat. A shape of plain lines is a sentence shape if half of its words
or more lie in sentences.

The work is done by array operations over the code points of many pages at once,
in the task that read them; every page is looked at whole. Only the identifiers of
flagged pages (or the sums of the shapes of a task) are shuffled.

Defined results: null, empty and blank texts are not flagged; rows without an id
are left out; an id given in several rows is flagged once, if one of its texts is;
every copy of a page is judged by its own text; columns besides id and text are
ignored, whatever their names; an empty table gives no rows. A task works on
BLOCK characters at a time, or on one page if that is longer (some 80 bytes each).
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of an ended sentence, words from which it is long, and words of a piece that breaks off; shares of distinct words
#: asked of an ended sentence, and of long ones and pieces that break off.
LEAST_WORDS, MOST_WORDS, LONG_WORDS, MOST_BROKEN, DISTINCT, DISTINCT_LONG = 4, 100, 45, 30, 0.5, 0.7
#: Pieces of up to so many words that end are not searched for repeats.
PLAIN_WORDS = 20
#: A piece is strung together from so many separators on, if there is one for every so many words.
SEPARATORS, PER_SEPARATOR = 4, 3
#: A line is a record from a number on every so many words, or an initial on every so many.
PER_NUMBER, PER_INITIAL = 4, 3
#: Shapes of a page that count as few, and the share of the page they must hold.
FEW, MOSTLY = 6, 0.5
#: Characters worked on at once.
BLOCK = 1_000_000

SPACE, LINE, UPPER, LOWER, DIGIT, DROPPED, END, OTHER = range(8)
LINE_ENDS, SEPARATING, CLOSING = "\n\r\v\f\x1c\x1d\x1e\x85  ", "·|•,;:/>*–—-+~=»«", ")]\"'»”’"


def _kind_of(code: int) -> int:
    c = chr(code)
    if c in LINE_ENDS:
        return LINE
    name = unicodedata.category(c)
    if c == "\t" or name[0] == "Z":
        return SPACE
    if name in ("Mn", "Me", "Cf"):  # combining accents, soft hyphens and signs without width
        return DROPPED
    if name[0] == "L":
        return UPPER if name in ("Lu", "Lt") else LOWER
    return DIGIT if name[0] == "N" else END if c in ".!?;" else OTHER


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower-case form of each code point of the basic plane."""
    codes = range(0x10000)
    small = [chr(c).lower() for c in codes]
    return np.array([_kind_of(c) for c in codes], np.uint8), np.array([ord(s) if len(s) == 1 else c for c, s in zip(codes, small, strict=True)], np.uint32)


def _moved(mask: np.ndarray, by: int) -> np.ndarray:
    """The mask as seen from places further back (by > 0: what comes after)."""
    out = np.zeros_like(mask)
    if by > 0:
        out[:-by] = mask[by:]
    else:
        out[-by:] = mask[:by]
    return out


class _Tokens:
    """Runs of characters between blanks, over the texts of a block."""

    def __init__(self, texts: list[str]):
        kinds, lower = _tables()
        code = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        wide = code > 0xFFFF
        kind = kinds[np.where(wide, 0, code)]
        if wide.any():
            found, place = np.unique(code[wide], return_inverse=True)
            kind[wide] = np.array([_kind_of(int(c)) for c in found], np.uint8)[place]
        page = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
        kept = kind != DROPPED
        code, kind, page = code[kept], kind[kept], page[kept]
        inside = (kind != SPACE) & (kind != LINE)
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.first, self.after = edges[::2], edges[1::2]
        first, last = self.first, self.after - 1
        self.page, self.line = page[first], np.cumsum(kind == LINE, dtype=np.int32)[first]
        letter, small = (kind == UPPER) | (kind == LOWER), np.where(code > 0xFFFF, code, lower[np.minimum(code, 0xFFFF)])
        digit, sign = kind == DIGIT, lambda c: code == ord(c)
        is_ = lambda c: small == ord(c)
        inner = letter | digit | sign("-") | sign("_")
        # www. / http: https: / a dot between three signs of a name and three small letters
        link = is_("w") & _moved(is_("w"), 1) & _moved(is_("w"), 2) & _moved(sign("."), 3)
        link |= is_("t") & _moved(is_("t"), 1) & _moved(is_("p"), 2) & (_moved(sign(":"), 3) | _moved(sign(":"), 4))
        link |= sign(".") & _moved(inner, -1) & _moved(inner, -2) & _moved(inner, -3) & _moved(kind == LOWER, 1) & _moved(kind == LOWER, 2) & _moved(kind == LOWER, 3)
        tag = (sign("#") & _moved(letter | digit, 1)) | (sign("_") & _moved(letter, -1))
        tag |= sign("-") & _moved(letter, -1) & _moved(letter, -2) & _moved(digit, 1) & _moved(digit, 2)
        self.letters, self.digits, self.uppers = self._count(letter), self._count(digit), self._count(kind == UPPER)
        self.links, self.tags = self._count(link) > 0, self._count(tag) > 0
        self.separators = self._count(np.isin(code, [ord(c) for c in SEPARATING]))
        plain = ~self.links & ~self.tags
        comma, dot = code[last] == ord(","), code[last] == ord(".")
        self.initials = (self.letters == 1) & (self.uppers == 1) & (self.digits == 0) & (comma | dot)
        self.words = plain & ~self.initials & (self.letters > self.digits)
        self.numbers = plain & ~self.words & (self.digits > 0)
        self.capitals = self.words & (kind[first] == UPPER)
        closed = np.isin(code[last], [ord(c) for c in CLOSING]) & (last > first)
        self.ends = plain & ~self.initials & (self.letters + self.digits > 0) & (kind[last - closed] == END)
        bare = (self.letters + self.digits == 0) & (code[last] != ord(":")) & (kind[last] != END)
        self.strings, self.commas = bare | comma, comma
        # a hash of the letters of a token: the sum over its letters of a mixture with the letter before
        before = np.where(_moved(letter, -1), np.r_[np.uint32(0), small[:-1]], 0).astype(np.uint64)
        mixed = (small.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (before * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed[~letter] = 0
        self.hashes = np.add.reduceat(mixed, first) if len(first) else np.zeros(0, np.uint64)

    def _count(self, mask: np.ndarray) -> np.ndarray:
        upto = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=upto[1:])
        return upto[self.after] - upto[self.first]


def _sums(mask: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(mask.astype(np.int32), starts)


def _in_sentences(t: _Tokens, apart: np.ndarray, paused: np.ndarray) -> np.ndarray:
    """Which words of running text lie in sentences; apart: tokens of records and headings, paused: places of tokens that end a verse."""
    ends = t.ends.copy()
    ends[paused] = True
    new = np.r_[True, (t.page[1:] != t.page[:-1]) | ends[:-1] | (apart[1:] != apart[:-1])]
    piece, first = np.cumsum(new) - 1, np.flatnonzero(new)
    ended = ends[np.r_[first[1:], len(new)] - 1]
    size, strings, odd = _sums(t.words, first), _sums(t.strings, first), _sums(t.links | t.tags, first)
    looked = ((~ended & (size > 0)) | (size > PLAIN_WORDS)) & ((size <= MOST_WORDS) & (ended | (size <= MOST_BROKEN)))
    own = looked[piece] & t.words
    at = piece[own]
    both = (at.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) ^ (t.hashes[own] * np.uint64(0x2545F4914F6CDD1D))
    unlike = np.bincount(at[np.unique(both, return_index=True)[1]], minlength=len(first)) / np.maximum(size, 1)
    unlike = np.where(looked, unlike, 1.0)
    strung = (strings >= SEPARATORS) & (strings * PER_SEPARATOR >= size)
    whole = ended & (size >= LEAST_WORDS) & (size <= MOST_WORDS) & (unlike >= np.where(size > LONG_WORDS, DISTINCT_LONG, DISTINCT))
    broken = ~ended & (size > 0) & (size <= MOST_BROKEN) & (unlike >= DISTINCT_LONG) & (odd == 0)
    return (whole | broken)[piece] & ~strung[piece] & ~apart & t.words


#: Parts of a shape with their number of levels, and the upper bounds of the levels of counts.
PARTS = {"k": 4, "w": 4, "c": 3, "s": 3, "n": 2, "i": 2}
SHAPES = math.prod(PARTS.values())
KINDS = ("", "heading", "record", "tag or link")
WORD_LEVELS, SEPARATOR_LEVELS = (0.5, 3.5, 12.5), (0.5, 2.5)


def shape_name(shape: int, sentence: bool) -> str:
    """Kind of the line, and the levels of words, capitals, separators, numbers and initials."""
    levels = []
    for part, size in reversed(PARTS.items()):
        shape, level = divmod(shape, size)
        levels.append(f"{part}{level}")
    kind = int(levels.pop()[1:])
    return " ".join([KINDS[kind] or ("sentence" if sentence else "loose"), *reversed(levels)])


def _block_shapes(texts: list[str]) -> dict[str, np.ndarray]:
    """One entry of each page and shape: page, shape, lines, words, weight, sentence (0 or 1), counts (it is no sentence)."""
    t = _Tokens(texts)
    if not len(t.first):
        return {k: np.zeros(0, np.int64) for k in ("page", "shape", "lines", "words", "weight", "sentence", "counts")}
    starts = np.flatnonzero(np.r_[True, t.line[1:] != t.line[:-1]])
    count = lambda mask: _sums(mask, starts)
    words, capitals, separators, numbers, initials = map(count, (t.words, t.capitals, t.separators, t.numbers, t.initials))
    links, tags, letters = count(t.links), count(t.tags), count(t.letters)
    record = (initials >= 2) | ((initials > 0) & (initials * PER_INITIAL >= words)) | ((numbers > 0) & (numbers * PER_NUMBER >= words))
    heading = (count(t.uppers) == letters) & (letters > 3)
    last = np.r_[starts[1:], len(t.first)] - 1
    verse = t.capitals[starts] & t.commas[last] & (words >= LEAST_WORDS) & (separators == 1)
    held = count(_in_sentences(t, np.repeat(record | heading, last + 1 - starts), last[verse]))
    kind = np.select([(links > 0) | (tags > 0), record, heading], [3, 2, 1], 0)
    levels = [kind, np.searchsorted(WORD_LEVELS, words), (capitals > 0).astype(np.int64) + (capitals * 2 >= np.maximum(words, 1)), np.searchsorted(SEPARATOR_LEVELS, separators), numbers > 0, initials > 0]
    shape = np.zeros(len(starts), np.int64)
    for level, size in zip(levels, PARTS.values(), strict=True):
        shape = shape * size + level
    key, place = np.unique(t.page[starts].astype(np.int64) * SHAPES + shape, return_inverse=True)
    total = lambda values: np.bincount(place, values, len(key)).astype(np.int64)
    out = {"page": key // SHAPES, "shape": key % SHAPES, "lines": total(None), "words": total(words), "weight": total(np.maximum(words, 1) + links + tags)}
    out["sentence"] = (total(held) * 2 >= np.maximum(out["words"], 1)).astype(np.int64)
    of_kind = out["shape"] // (SHAPES // PARTS["k"])
    out["counts"] = ((of_kind == 3) | ((of_kind == 0) & (out["words"] > 0) & (out["sentence"] == 0))).astype(np.int64)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, dict[str, np.ndarray], int]]:
    """The ids, shapes and number of pages of blocks of bounded size."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        begin = held = 0
        for n, text in enumerate(texts):
            held += len(text)
            if held >= BLOCK or n == len(texts) - 1:
                yield batch.column(0).slice(begin, n + 1 - begin), _block_shapes(texts[begin : n + 1]), n + 1 - begin
                begin, held = n + 1, 0


def _judged(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for ids, s, n in _blocks(batches):
        whole = np.bincount(s["page"], s["weight"], n)
        order = np.lexsort((s["shape"], -s["weight"], 1 - s["counts"], s["page"]))
        page, counts, weight = s["page"][order], s["counts"][order], s["weight"][order]
        first = np.flatnonzero(np.r_[True, page[1:] != page[:-1]]) if len(page) else np.zeros(0, np.int64)
        place = np.arange(len(page)) - np.repeat(first, np.diff(np.r_[first, len(page)]))
        few = np.bincount(page, weight * counts * (place < FEW), n)
        share = np.where(whole > 0, few / np.maximum(whole, 1), 0.0)
        columns = [ids, pa.array(np.bincount(s["page"], s["lines"], n).astype(np.int64)), pa.array(np.bincount(s["page"], s["words"], n).astype(np.int64))]
        columns += [pa.array(np.bincount(s["page"], s["counts"], n).astype(np.int64)), pa.array(share), pa.array(share >= MOSTLY)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _texts(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    page = df.select(df[id_column].alias("page_id"), df[text_column].cast("string").alias("page_text"))
    return page.filter("page_id is not null and page_text is not null")


def page_shapes(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_lines, n_words, n_shapes, few_share, flagged) of every row with a text: the shapes that are no sentences, and the share the FEW largest hold."""
    pages = _texts(df, id_column, text_column)
    names = [id_column, "n_lines", "n_words", "n_shapes", "few_share", "flagged"]
    schema = f"`{id_column}` {pages.schema['page_id'].dataType.simpleString()}, n_lines bigint, n_words bigint, n_shapes bigint, few_share double, flagged boolean"
    return pages.mapInArrow(lambda batches: _judged(batches, names), schema)


def stuffed_pages(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id) of the flagged pages."""
    return page_shapes(df, id_column, text_column).filter("flagged").select(id_column).distinct()


def shape_report(df: DataFrame) -> DataFrame:
    """(shape, n_lines, n_words) over the corpus: which line shapes there are, and how much they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s, _ in _blocks(batches):
            key, place = np.unique(s["shape"] * 2 + s["sentence"], return_inverse=True)
            names = [shape_name(int(k) // 2, bool(k % 2)) for k in key]
            sums = [pa.array(np.bincount(place, s[c], len(key)).astype(np.int64)) for c in ("lines", "words")]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *sums], names=["shape", "n_lines", "n_words"])

    found = _texts(df, "doc_id", "text").mapInArrow(run, "shape string, n_lines bigint, n_words bigint")
    return found.groupBy("shape").agg(F.sum("n_lines").alias("n_lines"), F.sum("n_words").alias("n_words"))
