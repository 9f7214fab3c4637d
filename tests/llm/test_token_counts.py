import random
import re

import public_tokenizers
import pytest

from spendweave.llm import token_counts as tc


@pytest.fixture(scope="module")
def model():
    return tc.Unigram.load(public_tokenizers.path(tc.MODEL))


def plain_count(model, word):
    """Viterbi over one word, from every start."""
    marked = tc.WORD_START + word
    best = [(0.0, 0)]
    for end in range(1, len(marked) + 1):
        size = len(marked[end - 1].encode())
        top = (best[end - 1][0] + model.unknown * size, best[end - 1][1] + size)
        for start in range(end - 1, -1, -1):
            score = model.score.get(marked[start:end])
            if score is not None and best[start][0] + score >= top[0]:
                top = (best[start][0] + score, best[start][1] + 1)
        best.append(top)
    return best[-1][1]


def test_trie_gives_the_counts_of_single_words(model):
    rng = random.Random(3)
    words = {"".join(rng.choice("aeinst漢😀é") for _ in range(rng.randint(1, 14))) for _ in range(800)}
    counter = tc.TrieCounter(model, known=100)
    for _ in range(3):                                    # batches, with forgetting in between
        part = set(rng.sample(sorted(words), 400))
        counter.learn(part)
        assert all(counter.counts[w] == plain_count(model, w) for w in part)


def test_shared_prefixes_are_scored_once(model):
    counter = tc.TrieCounter(model)
    counter.learn({"prefix" + x for x in "abc"} | {"prefix"})
    assert counter.nodes == 7 + 3                         # the mark and six letters, then one more for each


def test_odd_rows(odd, odd_rows, none, model):
    rows = tc.token_counts(odd).collect()
    want = []
    for doc_id, text, *_ in odd_rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        counts = {w: plain_count(model, w) for w in set(words) if len(w) < 1000}
        if any(len(w) >= 1000 for w in words):
            continue
        want.append((doc_id or 0, len(words), sum(counts[w] for w in words)))
    long_words = [r for r in rows if r.doc_id == 9]
    assert sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in rows if r.doc_id != 9) == sorted(want)
    assert long_words[0].n_words == 1 and 0 < long_words[0].n_tokens <= 70_001
    assert tc.token_counts(none).count() == 0
