import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spendweave.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_plan(counts, capacity):
    plan, fill, items = packing.BinPlan(counts, capacity), {}, {}
    for length, lo, hi, base, per_bin, offset in plan.slots:
        for rank in range(lo, hi):
            items.setdefault(length, []).append(rank)
            fill.setdefault(base + (rank - lo) // per_bin, []).append((offset + (rank - lo) % per_bin * length, length))
    assert {s: sorted(r) for s, r in items.items()} == {s: list(range(c)) for s, c in counts.items() if c}
    assert sorted(fill) == list(range(plan.bins))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return plan.bins


@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), min_size=1), st.just(40))
@settings(max_examples=200, deadline=None)
def test_plans_are_whole_and_gapless(counts, capacity):
    bins = check_plan(counts, capacity)
    assert bins >= -(-sum(s * c for s, c in counts.items()) // capacity)


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - s)
    return len(gaps)


def test_as_good_as_best_fit_on_single_items():
    rng = random.Random(5)
    for _ in range(60):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 120))]
        assert check_plan({s: sizes.count(s) for s in set(sizes)}, 100) <= best_fit_decreasing(sizes, 100)


def test_large_items_are_matched_as_often_as_possible():
    rng = random.Random(6)
    for _ in range(100):
        sizes = [rng.randint(34, 100) for _ in range(9)]

        def most(left):
            if not left:
                return 0
            a, *rest = left
            return max([most(rest), *[1 + most(rest[:i] + rest[i + 1:]) for i, b in enumerate(rest) if a + b <= 100]])
        assert check_plan({s: sizes.count(s) for s in set(sizes)}, 100) == len(sizes) - most(sizes)


def test_cut():
    assert packing.cut(1, 8) == [(0, 1)] and packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(9, 8) == [(0, 1), (1, 8)] and packing.cut(16, 8) == [(0, 8), (8, 8)]


def test_odd_rows(spark, odd, odd_rows, none, tokenizer):
    rows = packing.pack(odd).collect()
    want = []
    for doc_id, text, *_ in odd_rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc_id, p, a, n, zlib.crc32(ids[a:a + n])) for p, (a, n) in enumerate(packing.cut(len(ids), 2048))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (s, o, n), (s2, o2, _) in zip(places, places[1:]):
        assert (s2 == s and o2 == o + n) or (s2 == s + 1 and o2 == 0)
    assert all(o + n <= 2048 for _, o, n in places)
    assert packing.pack(none).count() == 0


@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", "a", " b\n\n", "  ", "é漢", "'s", "12 ", "<", "X."]), max_size=12).map("".join))
@settings(max_examples=200, deadline=None)
def test_ids_are_those_of_the_file(tokenizer, text):
    assert packing._encode(None)(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_sequences_give_the_texts_back(spark, tokenizer):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma " * 3000), (3, None)], "doc_id long, text string")
    placed = packing.pack(docs)
    sequences = packing.token_sequences(docs, placed).collect()
    texts = tokenizer.decode([i for s in sorted(sequences, key=lambda s: (-len(s.ids), s.sequence_id)) for i in s.ids if i], skip_special_tokens=False)
    assert texts.count("gamma") == 3000 and texts.count("alpha beta") == 1
    assert sum(len(s.ids) for s in sequences) == placed.agg({"length": "sum"}).first()[0]
