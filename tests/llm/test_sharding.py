import math
import random
import zlib
from collections import Counter

from spendweave.llm import sharding


def test_hypergeometric_follows_its_law():
    rng, good, bad, draws, n = random.Random(3), 30, 50, 20, 20_000
    seen = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(n))
    law = {x: math.comb(good, x) * math.comb(bad, draws - x) / math.comb(good + bad, draws) for x in range(draws + 1)}
    chi = sum((seen[x] - n * p) ** 2 / (n * p) for x, p in law.items() if n * p >= 5)
    assert chi < 40 and max(seen) <= 20                       # about 14 degrees of freedom


def test_hypergeometric_edges_and_large_numbers():
    rng = random.Random(1)
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 0, 3) == 3
    assert sharding.hypergeometric(rng, 4, 4, 8) == 4
    draws = [sharding.hypergeometric(rng, 10 ** 10, 7 * 10 ** 10, 10 ** 6) for _ in range(200)]
    assert abs(sum(draws) / 200 - 125_000) < 5 * 331 / math.sqrt(200)


def test_matrix_has_the_given_sums():
    blocks, shards = [5, 0, 12, 7, 1], [7, 6, 6, 6]
    matrix = sharding.communication_matrix(blocks, shards, 4)
    assert [sum(r) for r in matrix] == blocks and [sum(c) for c in zip(*matrix)] == shards


def test_odd_rows(odd, odd_rows, none):
    rows = sharding.shard(odd).collect()
    expected = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == expected
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {len(s) for s in slots.values()} <= {len(rows) // 8, len(rows) // 8 + 1} and len(slots) == 8
    assert sharding.shard(none).count() == 0


def test_shuffle_is_uniform(spark):
    """Over seeds, each row meets each shard equally often."""
    docs = spark.range(40).selectExpr("id as doc_id", "cast(id as string) as text").coalesce(2).cache()
    seen = Counter()
    for seed in range(12):
        for r in sharding.shard(docs, shards=4, seed=100 + seed * 7).collect():
            seen[r.doc_id < 20, r.shard] += 1
    assert all(40 <= n <= 80 for n in seen.values()) and sum(seen.values()) == 480       # 60 expected, sd about 5.5


def test_no_python_in_the_plan(odd):
    plan = sharding.shard(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
