"""BPE against the tokenizers library: ids, decoded text, and the lexicon on its own."""

import gc
import hashlib
import json
import pickle
import random
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cohortlens.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary())


@pytest.fixture(scope="module")
def merges():
    with open(bpe.vocabulary(), encoding="utf-8") as f:
        return bpe.Merges(json.load(f))


TEXTS = ["", None, " \n", "Hello, WORLD! don't we'll I'M", "<|startoftext|>a<|endoftext|> <|STARTOFTEXT|> <|", "été ÉTÉ é", "ΑΣ Σας İI ß", "日本語 123 ½²", "x" * 5000,
         "ab" * 3000 + "'s", "👩‍👩‍👧 café\x1cb a", "\x85  z", "՘ ₏ ͸", "a\0b", "word " * 20_000, "w1 w2 w1", "w1 w2 w1"]


def test_code_points(library, merges):
    rng = random.Random(0)
    points = [c for c in rng.sample(range(0x110000), 20_000) if not 0xD800 <= c < 0xE000] + list(range(0x250))
    for c in points:
        s = f"a{chr(c)}B1 {chr(c)}"
        assert [i for w in merges.words(s) for i in merges.ids(w)] == library.encode(s, add_special_tokens=False).ids, hex(c)


def test_texts_of_random_code_points(library, merges):
    """Whole texts by pieces: separators, special tokens and newer capitals inside words."""
    rng = random.Random(1)
    some = ["a", "B", "'s", "'", "\x1c", "\x1f", "\x85", "\u2000", "\u3000", " ", "\n", "\u0301", "\u0345", "Σ", "İ", "9", "½", "<|endoftext|>", "<|", "\u200b",
            *map(chr, [0x1C89, 0xA7CB, 0xA7DC, 0x10D5E, 0x16EA3, 0x558, 0x10940])]
    enc = bpe.Encoder(merges, bpe.compile_lexicon([]))
    texts = ["".join(rng.choice(some) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(0x300), rng.randrange(0xE000, 0x20000)]))
                     for _ in range(rng.randrange(30))) for _ in range(6000)]
    for t, ids in zip(texts, enc.encode(texts)[0]):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, ascii(t)


def test_words_merged_together_and_alone(merges):
    rng = random.Random(3)
    words = ["", "<|endoftext|>", "x" * 100, "aaaa", "ababab", *("".join(rng.choice("abcéth aeiou日") for _ in range(rng.randrange(1, 30))) for _ in range(3000))]
    assert merges.ids_of(words) == [merges.ids(w) if w else [] for w in words]
    assert merges.ids_of([]) == []
    pieces = [p for w in words for p in merges.pieces(w)] + ["É", "\x1c", "a\u0301Σ", "'s't", "՘a"]
    assert merges.words_of(pieces) == [merges.words(p) for p in pieces]


def test_newer_capitals_inside_words(library, merges):
    for c in bpe.NEWER_LOWER:
        s = f"xA{chr(c)}b"
        assert [i for w in merges.words(s) for i in merges.ids(w)] == library.encode(s, add_special_tokens=False).ids, hex(c)


def test_lexicon_numbers_and_shares_suffixes():
    words = sorted({bytes(random.Random(i).choices(b"abc", k=1 + i % 7)) for i in range(300)})
    lex = bpe.compile_lexicon([(w, [i, i + 1]) for i, w in enumerate(words)])
    assert bpe.look_up(lex, words).tolist() == list(range(len(words)))
    assert bpe.look_up(lex, [b"", b"d", b"abcabcabcabc", words[0] + b"d"]).tolist() == [-1] * 4
    assert lex["ids"][lex["at"][5]: lex["at"][6]].tolist() == [5, 6]
    suffixes = bpe.compile_lexicon([(w, []) for w in sorted(p + b"tion" for p in (b"a", b"b", b"c", b"na"))])
    assert len(suffixes["final"]) == 7  # one chain for the shared suffix
    assert bpe.look_up(bpe.compile_lexicon([]), [b"a"]).tolist() == [-1]


@pytest.mark.parametrize("lexicon", [100_000, 3, 0])
def test_digests_ids_and_decoding_match_the_library(spark, library, lexicon):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as row").repartition(3)
    codec = bpe.Codec(df, bpe.vocabulary(), lexicon=lexicon)
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    shown = [library.decode(x, skip_special_tokens=False) for x in expected]
    digest = {i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(s.encode()).hexdigest()) for i, (x, s) in enumerate(zip(expected, shown))}
    assert {r[0]: tuple(r[1:]) for r in codec.digests(df).collect()} == digest
    if lexicon == 3:
        ids = codec.encode(df)
        assert {r.doc_id: r.ids for r in ids.collect()} == dict(enumerate(expected))
        assert {r.doc_id: r.text for r in codec.decode(ids).collect()} == dict(enumerate(shown))


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plain_pieces_cost_no_python_call_each(library, merges):
    """Pieces, words, ids and decoded text are arrays: the calls of an encoder do not grow with the words."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdeTR9.,", k=rng.randrange(3, 12))) for _ in range(20_000)]
    texts = [" ".join(words[i: i + 100]) for i in range(0, len(words), 100)]
    enc = bpe.Encoder(merges, bpe.compile_lexicon([]))
    enc.encode(texts[:1])
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        ids = enc.encode(texts)[0]
    finally:
        sys.setprofile(None)
    assert calls[0] < 10_000
    assert [x.tolist() for x in ids] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_an_encoder_keeps_nothing_of_the_texts(merges):
    rng = random.Random(8)
    enc = bpe.Encoder(merges, bpe.compile_lexicon([]))
    texts = [" ".join("".join(rng.choices("abcdeé", k=12)) for _ in range(200)) for _ in range(100)]
    enc.encode(texts[:2])
    tracemalloc.start()
    try:
        enc.encode(texts)
        gc.collect()
        assert tracemalloc.get_traced_memory()[0] < 500_000
    finally:
        tracemalloc.stop()


def test_pieces_of_every_kind_of_byte(library, merges):
    """Classes of bytes, apostrophes, marks and spaces that only the pattern knows, at the ends of pieces and texts."""
    rng = random.Random(9)
    some = ["A", "z", "7", "42", ".", "--", "'", "'LL", "'s", "<", "<|startoftext|>", "\x00", "\x1d", "\x7f", "\xa0", " ", "\x85", "é", "Ñ", "_", " ", "\t", "\n", "\r\n"]
    texts = ["".join(rng.choices(some, k=rng.randrange(12))) for _ in range(4000)]
    enc = bpe.Encoder(merges, bpe.compile_lexicon(sorted((w.encode(), merges.ids(w)) for w in ("a", "z", "--", "é", "'"))))
    ids, out = enc.encode(texts)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in ids] == expected
    assert out.decoded(enc.tokens).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in expected]


def test_what_a_worker_is_sent_is_small(merges):
    """The merges go to the tasks as arrays, not as Python objects or as a file to be parsed."""
    sent = pickle.dumps(merges)
    tracemalloc.start()
    try:
        got = pickle.loads(sent)
        assert tracemalloc.get_traced_memory()[1] < 6_000_000
    finally:
        tracemalloc.stop()
    words = ["don't"[:3], "x" * 5000, "ab" * 3000 + "é", "hello", "<|endoftext|>"]
    assert got.ids_of(words) == merges.ids_of(words) == [got.ids(w) for w in words]
    assert got.words("Été 12's <|endoftext|>") == merges.words("Été 12's <|endoftext|>")
    assert got.tokens.equals(merges.tokens)


def test_counting_holds_one_chunk_of_an_arrow_batch(merges):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefgh ", k=2000)) for _ in range(4000)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    sent = type("Sent", (), {"value": merges})
    next(bpe._count(sent)(iter([batch.slice(0, 10)])))
    tracemalloc.start()
    try:
        n = sum(sum(b.column(1).to_pylist()) for b in bpe._count(sent)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == sum(len(t.split()) for t in texts)
    assert peak < 12_000_000
