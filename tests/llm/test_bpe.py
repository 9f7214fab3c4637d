"""Encoding and decoding against the tokenizers library."""
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spendweave.llm import bpe

LIBRARY = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def want(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@given(st.text(max_size=80) | st.text("abcdefhilnorstu' 's12<|>endoftxEÉßΣσİ漢é", max_size=200))
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    made = bpe.codec()
    ids = made.encode(text)
    assert (ids, made.decode(ids)) == want(text)


def test_long_words_and_specials():
    rng = random.Random(1)
    made = bpe.codec()
    for text in ["x" * 20_000, "".join(rng.choice("thexq") for _ in range(30_000)), "a<|endoftext|>b <|startoftext|><|endoftext|>", "ΟΔΥΣΣΕΥΣ ΣΑΣ",
                 "Ⅷ ½ 12,345.6", "ᲉꟋ", "it's we'll I'M 'S", " \x85 tab\tend ", "é" * 500, "漢字" * 3000]:
        assert (made.encode(text), made.decode(made.encode(text))) == want(text)


def test_heap_and_list_agree():
    made, rng = bpe.codec(), random.Random(2)
    for _ in range(200):
        word = bytes(rng.choice(b"theinaorst") for _ in range(rng.randint(2, bpe.SHORT)))
        ids = [made.inner[b] for b in word]
        assert made._merged(list(ids)) == made._merged_by_heap(list(ids))


def test_cuts_are_certain():
    """No token of any word reaches across a forced boundary, and there are such boundaries."""
    made, rng, seen = bpe.codec(), random.Random(3), 0
    for _ in range(2000):
        word = "".join(rng.choice("abcjqxzvkwßéçü") for _ in range(rng.randint(2, 12)))
        ends, at = set(), 0
        letters = {c: b for b, c in enumerate(bpe.byte_letters())}
        for token in LIBRARY.encode(word, add_special_tokens=False).tokens:
            at += len([letters[c] for c in token.removesuffix("</w>")])
            ends.add(at)
        places = made.cuts(word.encode())
        seen += len(places)
        assert set(places) <= ends
    assert seen > 1000
    long = ("ab" * 40 + "qx" * 20).encode()
    assert made.cuts(long) == [i for i in range(1, len(long)) if not made.joined[long[i - 1] * 256 + long[i]]]


def test_every_byte_is_in_the_vocabulary():
    made = bpe.codec()
    assert None not in made.inner and None not in made.last


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    made = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY))
    text = "one two three four five six seven eight nine ten " * 3
    assert made.encode(text) == want(text)[0] and len(made.of_word) <= 5


def test_odd_rows(odd, odd_rows, none):
    got = bpe.encode(odd, ("ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    expected = []
    for doc_id, text, *_ in odd_rows:
        ids, decoded = want(text)
        expected.append((doc_id or 0, len(ids), ids, decoded, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids, r.decoded, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(expected)
    assert bpe.encode(none).count() == 0


def test_query_against_the_library(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in bpe.op12_bpe(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for row in rows:
        ids, decoded = want(row.text)
        r = got[row.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


@pytest.mark.parametrize("text", ["", " ", "\n\n"])
def test_nothing_to_encode(text):
    assert bpe.codec().encode(text) == []
