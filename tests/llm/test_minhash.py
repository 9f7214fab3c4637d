import random

import corpus_pipeline as pipeline

from spendweave.llm import minhash, simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_pairs_at_the_required_similarity_go(spark):
    """Edited copies between 0.8 and 0.9 go, those below 0.8 stay, as comparing all pairs has it."""
    rng, rows = random.Random(3), []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((2 * i, " ".join(words)))
        for at in rng.sample(range(5, 195), rng.randint(2, 7)):
            words[at] = f"new{at}"
        rows.append((2 * i + 1, " ".join(words)))
    sets = {i: shingles(t) for i, t in rows}
    like = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 120, 2)}
    assert sum(0.8 <= v < 0.9 for v in like.values()) >= 10 and sum(v < 0.8 for v in like.values()) >= 10
    kept = {r.doc_id for r in pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept == {i for i in range(120) if i % 2 == 0 or like[i - 1] < 0.8}


def test_pairs_within_a_template(spark):
    """Pairs just above 0.8 among documents that all share most of their words: nearly all are linked."""
    rng, rows = random.Random(9), []
    template = [f"t{i}" for i in range(760)]
    for i in range(200):
        own, tails = [f"p{i}x{j}" for j in range(40)], [[f"q{i}x{s}x{j}" for j in range(94)] for s in (0, 1)]
        rows += [(2 * i + s, " ".join(template + own + tails[s])) for s in (0, 1)]
    sets = {i: shingles(t) for i, t in rows}
    like = [len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) for i in range(200)]
    across = len(sets[0] & sets[2]) / len(sets[0] | sets[2])
    assert 0.8 <= min(like) < 0.81 and across < 0.75
    got = {r.node: r.root for r in minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    linked = sum(got.get(2 * i + 1) == 2 * i for i in range(200))
    assert linked >= 190 and len(set(got.values())) == len(got)      # and no pair is linked to another one


def test_classes_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [(i, minhash.shingle_hashes(t)) for i, t in rows if t.split()]
    root = {i: i for i, _ in sets}
    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1:]:
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and minhash.similarity(a, b) >= 0.8:
                low, high = sorted((root[i], root[j]))
                if low != high:
                    root = {k: low if v == high else v for k, v in root.items()}
    got = {r.node: r.root for r in minhash.near_copies(docs.select("doc_id", "text"), "doc_id").collect()}
    assert {i: got.get(i, i) for i in root} == root


def test_near_stage_goes_by_fingerprints_too(spark, monkeypatch):
    """Where MinHash finds no candidates, pairs whose fingerprints meet by Golay keys are linked, but for those below 0.8."""
    rng, rows = random.Random(4), []
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(600)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], f"new{i}"]))]
    rows += [(80, ""), (81, " \n"), (82, None)]
    prints = [simhash.fingerprint(t, minhash.SHINGLE) for _, t in rows[:80]]
    close = [i for i in range(0, 80, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= simhash.DISTANCE]
    assert len(close) >= 30
    monkeypatch.setattr(minhash, "_keys", lambda least, n, first: [])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = {(r.a, r.b) for r in simhash.candidate_pairs(docs, "doc_id", minhash.SHINGLE).collect()}
    assert pairs == {(i, i + 1) for i in close}
    kept = {r.doc_id for r in pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == set(range(83)) - {i + 1 for i in close}
