import random

import numpy as np
import xxhash

from spendweave.llm import golay, simhash
from spendweave.llm.components import components


def roots(values, links):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def by_pairs(values, distance=4):
    return roots(values, [(a, b) for i, a in enumerate(values) for b in values[i + 1:] if (a ^ b).bit_count() <= distance])


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.uint32)
    index = golay.decode(words)
    assert (np.bincount(index, minlength=4096) == 2048).all()
    codeword = (index << 11) | np.array([golay.remainder(int(i) << 11) for i in range(4096)], np.uint32)[index]
    assert np.bitwise_count(words ^ codeword).max() == 3


def test_words_two_bits_apart_share_a_key():
    rng = random.Random(2)
    for bits in (21, 22, 23):
        words = [rng.getrandbits(bits) for _ in range(300)]
        for flips in (1, 2):
            moved = [w ^ sum(1 << b for b in rng.sample(range(bits), flips)) for w in words]
            a, b = golay.fuzzy_keys(np.array(words), bits), golay.fuzzy_keys(np.array(moved), bits)
            assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist()))
    assert max(len(set(r)) for r in golay.fuzzy_keys(np.array(words), 23).tolist()) == 6


def plain_fingerprint(text, shingle=4):
    words, word = [], []
    for c in (text or ""):
        c = c.lower() if "A" <= c <= "Z" else c
        if c in " \t\n\x0b\x0c\r":
            words, word = words + ["".join(word)] * bool(word), []
        else:
            word.append(c)
    words += ["".join(word)] * bool(word)
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints(odd_rows):
    for _, text, *_ in odd_rows:
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint("A bİC d") == plain_fingerprint("A bİC d")


def test_spark_hash_is_the_same(spark):
    assert spark.sql("select xxhash64('one two three four')").first()[0] % 2 ** 64 == xxhash.xxh64_intdigest("one two three four", 42)


def clumps(seed=9):
    rng, values = random.Random(seed), set()
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice((1, 2, 40))):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    return sorted(values | {rng.getrandbits(64) for _ in range(200)})


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def classes_of(spark, values, held=simhash.HELD):
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = {r.node % 2 ** 64: r.root % 2 ** 64 for r in simhash.fingerprint_classes(fps, held=held).collect()}
    groups = {}
    for v in values:
        groups.setdefault(found.get(v, v), set()).add(v)
    return sorted(map(sorted, groups.values()))


def test_no_link_is_lost(spark):
    values, groups = clumps(), {}
    for v, root in by_pairs(values).items():
        groups.setdefault(root, set()).add(v)
    want = sorted(map(sorted, groups.values()))
    assert classes_of(spark, values) == want
    assert classes_of(spark, values, held=8) == want          # buckets too large to hold go by midpoints


def test_search_connects_what_pairs_connect():
    values = np.array(clumps(4), np.uint64)
    found = simhash.search_links(values, 4)
    assert len(found) < len(values)
    assert roots(values.tolist(), [(int(a), int(b)) for a, b in found]) == by_pairs(values.tolist())


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, odd_rows, none):
    rows = simhash.near_duplicates(odd).collect()
    fps = [plain_fingerprint(r[1]) for r in odd_rows]
    root = by_pairs(sorted(set(fps)))
    smallest = {}
    for (doc_id, *_), fp in zip(odd_rows, fps):
        if doc_id is not None:
            smallest[root[fp]] = min(doc_id, smallest.get(root[fp], doc_id))
    want = sorted(((r[0] or 0), f"{fp:016x}", smallest.get(root[fp])) for r, fp in zip(odd_rows, fps))
    assert sorted(((r.doc_id or 0), r.fingerprint, r.component_id) for r in rows) == want
    assert simhash.near_duplicates(none).count() == 0
