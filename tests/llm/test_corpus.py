"""Encoding, mixing and page shapes on small corpora."""

from __future__ import annotations

import base64
import random

import pyarrow as pa
import pytest
import tiktoken

from leakscope.llm import mixture, shapes, tokens


@pytest.fixture(scope="module")
def reference():
    with open(tokens.BYTE_BPE_50K, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=tokens.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [None, "", "   ", "a" * 5_000, "<|endoftext|> x", "it’s don't  \n\n x", "한글 é́ 😀" * 50, "a!\x1c\x1d b\x85c d  e\x1f", "  x   y\n  z\t\t q \n", "﻿­word‐\r\nbreak"]


def test_ids_equal_the_tokenizer(spark, reference):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcdefgh") for _ in range(3_000)), "".join(chr(rng.randint(1, 0x2FFF)) for _ in range(5_000)), "word " * 40_000]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(0, "twice", "", "")], "doc_id bigint, text string, ids string, key string")
    got = sorted((r.doc_id, r.ids) for r in tokens.encode_corpus(df).collect())
    want = sorted((i, reference.encode_ordinary(t) if t else []) for i, t in [*enumerate(texts), (0, "twice")])
    assert got == want
    counts = sorted((r.doc_id, r.n_tokens) for r in tokens.count_tokens(df).collect())
    assert counts == sorted((i, len(ids)) for i, ids in want)
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_forgetting_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY_PIECES", 3)
    encoder = tokens.Encoder(tokens._pairs(tokens.BYTE_BPE_50K))
    for text in ("one two three four", "five six one", "two two"):
        assert encoder.encode([text])[0].tolist() == reference.encode_ordinary(text)


def corpus(spark, sizes):
    rows = [(i, "word " * n if n else t, s) for i, (s, n, t) in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


MIX = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.15, 2), ("none", 0.05, 1), ("zero", 0.0, 1)]


def test_mixture_reaches_shares(spark, monkeypatch):
    monkeypatch.setattr(mixture, "LEAF_DOCUMENTS", 50)
    monkeypatch.setattr(mixture, "FAN", 3)
    rng = random.Random(2)
    sizes = [(s, rng.randint(5, 60), "") for s, n in (("a", 700), ("b", 90), ("c", 60), ("zero", 20), ("unlisted", 20), (None, 20)) for _ in range(n)] + [("a", 0, ""), ("a", 0, None)]
    df, mix = corpus(spark, sizes), spark.createDataFrame(MIX, "source string, target_share double, max_repeats int")
    used, report = mixture.mixture(df, mix)
    rows, by = used.collect(), {r.source: r for r in report.collect()}
    caps = {s: c for s, _, c in MIX}
    assert {r.source for r in rows} == {"a", "b", "c"} and all(1 <= r.copies <= caps[r.source] for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)
    for s, share, _ in MIX[:3]:
        assert by[s].actual_share == pytest.approx(share / 0.95, abs=0.01)
        assert by[s].tokens == sum(r.copies * r.n_tokens for r in rows if r.source == s)
    assert by["none"].tokens == 0 and not by["none"].reached and by["zero"].reached
    assert sorted(map(tuple, mixture.mixture(df, mix)[0].collect())) == sorted(map(tuple, rows))  # the same choice again
    full = {r.source: r for r in mixture.mixture(df, mix, total="available")[1].collect()}
    assert all(r.tokens <= r.max_repeats * r.available_tokens for r in full.values()) and full["b"].copies == 270  # at its cap
    assert sum(r.tokens for r in full.values()) > 1.05 * sum(r.tokens for r in by.values())


def test_larger_total_fills_caps():
    sources = [{"source": "a", "share": 0.5, "cap": 1, "tokens": 100}, {"source": "b", "share": 0.5, "cap": 9, "tokens": 100}, {"source": "c", "share": 0.0, "cap": 9, "tokens": 100}]
    assert mixture.amounts(sources, 400) == {"a": 100.0, "b": 300.0}
    assert mixture.amounts(sources) == {"a": 100.0, "b": 100.0}
    assert mixture.amounts(sources, 10_000) == {"a": 100.0, "b": 900.0} and mixture.amounts([]) == {}


def test_pivot_keeps_tokens():
    pivot, rng, kept = mixture._Pivot(), random.Random(1), 0.0
    sizes = [rng.randint(1, 100) for _ in range(2_000)]
    for i, t in enumerate(sizes):
        kept += sum(t2 * p for _, t2, p in pivot.add(i, t, 0.3, rng.random()))
    assert abs(kept + (pivot.open[1] * pivot.open[2] if pivot.open else 0) - 0.3 * sum(sizes)) < 1e-6


def test_mixture_of_nothing(spark):
    mix = spark.createDataFrame([*MIX, (None, 0.5, 1), ("a", None, None)], "source string, target_share double, max_repeats int")
    used, report = mixture.mixture(corpus(spark, [("a", 0, ""), ("a", 0, None)]), mix)
    assert used.count() == 0 and report.count() == len(MIX)
    assert mixture.mixture(corpus(spark, [("b", 4, "")]), mix.limit(0))[0].count() == 0


CASES = {
    "keywords": "tallow garden seed tallow\ngarden seed GARDEN SEED tallow\n" * 8,
    "dots": "copper pan. feather bed. copper\npan. copper pan. Feather bed.\n" * 8,
    "services": "\n".join(f"watch repair Town{chr(97 + i)} · watch" for i in range(20)),
    "tags": "#roof_slater #timber #wool\n#tallow_clerk #wool\n" * 5,
    "links": "https://pelul.invalid/cor?id=18\n> http://www.yar.invalid/far  yar-tools.test/nor.html\n" * 5,
    "codes": "BA-987 iron stove 17\nBA-998 tram company x3 *\nBA-813 copper pan No. 37\nBA-227 copper pan 30 new\n" * 5,
    "pipes": "flax piano tuner | feather bed | oats\n| mill owners | fire brigade | slate |\n" * 5,
    "mixed": "The relief fund opened the society at noon.\n" + "night mail copper pan brass kettle\n" * 12,
}
OTHERS = {
    "article": "The town band stood under water beside the cattle pens.\nThe choir was adjourned for want of coal.\n" * 6,
    "article_links": "The town band stood under water near the quay.\nThe choir was adjourned for want of coal.\n" * 6 + "www.shop.example\n",
    "prices": "Wool . . 18/3 — 28/5\nOats . . 33/4 — 3/8\n" * 8,
    "ships": "Fargil, 100 tons, Toryar, barley\nCorost, 321 tons, Gilul, hay\n" * 8,
    "contents": "The parish clerk. . . . . . 8\nThe town band. . . . . . 11\n" * 6,
    "results": "Denlor 0, Breven 4\nCorba 8, Norcor 3\n" * 6,
    "initials": "The choir (J. Dalor) was closed since\nMichaelmas, and the band (B. Rosul) fell short.\n" * 3,
    "columns": "THE TOWN BAND FELL SHORT\nThe choir was closed for want\nof coal. The tram stood under\nwater near the quay on Tuesday\n" * 4,
    "names": "L. Thornlor, H. Breharmar, B. Rospel,\nD. Pelros, W. Coring, B. Wick\n" * 8,
    "verse": "The night mail lost the bridge toll at the room,\nThe choir of Brebre approved the tram,\n" * 6,
    "short": "Lost yesterday evening, brass kettle,\nreward given.",
    "adverts": "KELWICK & CO.\nBoots mended while you wait.\nPiano to let, apply to Norul.\nSoap and candles sold at honest prices.\n" * 3,
    "empty": "",
    "blank": " \n\t\r\n",
    "null": None,
    "signs": "--- *** ---",
}


def test_pages(spark):
    rows = [(k, t, 1, "x") for k, t in {**CASES, **OTHERS}.items()]
    df = spark.createDataFrame([*rows, *rows[:1], (None, CASES["tags"], 1, "x")], "doc_id string, text string, n_words int, family string")
    assert {r.doc_id for r in shapes.stuffed_pages(df).collect()} == set(CASES)
    assert shapes.stuffed_pages(df.limit(0)).count() == 0
    assert shapes.shape_report(df).count() > 5


def test_blocks_do_not_matter(monkeypatch):
    texts = [t or "" for t in {**CASES, **OTHERS}.values()] + ["\U0001d400\U0001d401 \U00010400 x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["a", "b"])
    whole = pa.Table.from_batches(shapes._judged([batch], list("abcdef"))).to_pydict()
    monkeypatch.setattr(shapes, "BLOCK", 1)
    assert pa.Table.from_batches(shapes._judged([batch, batch.slice(0, 0)], list("abcdef"))).to_pydict() == whole
    assert [n for n, f in zip([*CASES, *OTHERS, "wide"], whole["f"], strict=True) if f] == list(CASES)


def test_shape_counts_by_hand():
    s = shapes._block_shapes(["Sale of soap.\nTWO WORDS\nA. Bell, 3 www.x-shop.test", "", "oats oats oats oats oats, hay"])
    names = [shapes.shape_name(int(k), bool(t)) for k, t in zip(s["shape"], s["sentence"], strict=True)]
    assert list(zip(s["page"].tolist(), names, s["lines"].tolist(), s["words"].tolist(), strict=True)) == [
        (0, "loose w1 c1 s0 n0 i0", 1, 3),
        (0, "heading w1 c2 s0 n0 i0", 1, 2),
        (0, "tag or link w1 c2 s1 n1 i1", 1, 1),
        (2, "loose w2 c0 s1 n0 i0", 1, 6),
    ]


def test_decomposed_accents_and_invisible_signs(spark):
    text = "Der Bürger fand während des Jahres großen Beifall.\nÜber die Straße kam u​nd ging der Rat für ihn.\n" * 5
    import unicodedata

    df = spark.createDataFrame([(1, unicodedata.normalize("NFD", text)), (2, "word word wool\n" * 30_000)], "doc_id int, text string")
    assert [r.doc_id for r in shapes.stuffed_pages(df).collect()] == [2]
