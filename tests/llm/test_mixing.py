import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from spendweave.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, limit=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > limit * sizes[s] + 1e-9}
        for s in over or free:
            target[s] = limit * sizes[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        free -= over or free
    return target


def sizes_of(rows):
    out = {}
    for _, text, _, source, *_ in rows:
        out[source] = out.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return out


def test_odd_rows(odd, odd_rows, none):
    rows = mixing.mix(odd, carry=("doc_id", "source")).collect()
    want, sizes = plain_targets(sizes_of(odd_rows)), sizes_of(odd_rows)
    assert len(rows) == len(odd_rows)
    for source in sizes:
        own = [r for r in rows if r.source == source]
        assert own[0].target == pytest.approx(want[source]) and own[0].source_size == sizes[source]
        each = mixing.block_size(sum(want.values()), min(w for w in want.values() if w), len(want))
        assert -2 * each - 0.5 <= sum(r.taken for r in own) - want[source] <= 0.5
    assert all(0 <= r.taken <= 2 * r["size"] and sum(r.taken_passes) == r.taken for r in rows)
    assert sorted((r.doc_id or 0, r.taken) for r in rows) == sorted((r.doc_id or 0, r.taken) for r in mixing.mix(odd).collect())
    assert mixing.mix(none).count() == 0


def test_corpus_without_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in mixing.mix(docs).collect()] == [(0, 0.0, 0)] * 2


def van_der_corput(k):
    x = F.lit(0.0)
    for bit in range(24):
        x = x + F.shiftright(k, bit) % 2 / F.lit(2.0 ** (bit + 1))
    return x


def plain_van_der_corput(k):
    return sum((k >> bit & 1) / 2 ** (bit + 1) for bit in range(24))


def plain_golden(k):
    golden = (math.sqrt(5) - 1) / 2
    return ((k >> 20) * ((2 ** 20 * golden) % 1) + k % 2 ** 20 * golden) % 1


DOCS = [(i, " ".join(["w"] * (i * 7 % 13)), "s" + str(i % 4)) for i in range(60)]


def walked(docs, each, point):
    """Walk the slots one by one, and in each the words of its block: {doc_id: (words, first slot)}, words by source."""
    sizes, streams = {}, {}
    for i, text, s in docs:
        sizes[s] = sizes.get(s, 0) + len(text.split())
    target, order, total = plain_targets(sizes), sorted(sizes), sum(plain_targets(sizes).values())
    for source in order:
        own = sorted((d for d in docs if d[2] == source), key=lambda d: hashlib.md5(f"mix|{d[0]}".encode()).hexdigest())
        streams[source] = ([d[0] for d in own for _ in d[1].split()] * 2)[:int(math.floor(target[source] + 0.5))]
    bounds = [sum(target[s] for s in order[:n + 1]) / total for n in range(len(order))]
    taken, first, used = {}, {}, dict.fromkeys(order, 0)
    slots = math.ceil(total / each)
    held = [order[next((n for n, hi in enumerate(bounds) if point(k) < hi), len(order) - 1)] for k in range(slots)]
    for k, source in [*enumerate(held), *[(slots + n, s) for n, s in enumerate(order) if s not in held]]:
        for doc_id in streams[source][used[source] * each:(used[source] + 1) * each]:
            taken[doc_id] = taken.get(doc_id, 0) + 1
            first.setdefault(doc_id, k)
        used[source] += 1
    return taken, first


@pytest.mark.parametrize("points, plain", [(mixing.golden_point, plain_golden), (van_der_corput, plain_van_der_corput)])
def test_words_are_those_of_the_slots(spark, points, plain):
    rows = mixing.mix(spark.createDataFrame(DOCS, "doc_id long, text string, source string"), block_words=3, points=points).collect()
    sizes = {s: sum(len(t.split()) for _, t, x in DOCS if x == s) for s in ("s0", "s1", "s2", "s3")}
    target = plain_targets(sizes)
    each = mixing.block_size(sum(target.values()), min(target.values()), 4, 3)
    taken, first = walked(DOCS, each, plain)
    assert {r.doc_id: r.taken for r in rows if r.taken} == taken
    assert {r.doc_id: min(k for k in r.slots if k is not None) for r in rows if r.taken} == first


def test_the_sequence_decides(spark, monkeypatch):
    """Another sequence gives another order and, by blocks, other amounts."""
    monkeypatch.setattr(mixing, "block_size", lambda *_: 20)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    golden, halves, poor = ([(r.doc_id, r.taken, r.slots) for r in mixing.mix(docs, points=p).orderBy("doc_id").collect()]
                            for p in (mixing.golden_point, van_der_corput, lambda k: F.lit(0.5) + k * 0))
    assert [x[2] for x in golden] != [x[2] for x in halves]
    assert [x[1] for x in golden] != [x[1] for x in poor] and sum(x[1] for x in poor) < sum(x[1] for x in golden)


def test_schedule_is_even(spark):
    sources = spark.createDataFrame([("=a", 0, 10, 5.0), ("=b", 1, 10, 3.0), ("=c", 2, 10, 2.0), ("=d", 3, 1, 1e-9), ("", 4, 0, 0.0)],
                                    "_key string, position int, source_size long, target double")
    slots = sorted((r.k, r._key) for r in mixing.schedule(sources, 5, 2000).collect())
    assert [k for k, _ in slots] == [*range(2000), 2003] and slots[-1][1] == "=d"
    for n in (10, 100, 1000, 2000):                       # every beginning of the schedule is near the shares
        for key, share in (("=a", 0.5), ("=b", 0.3), ("=c", 0.2)):
            assert abs(sum(s == key for _, s in slots[:n]) - n * share) <= 4


def test_no_python_in_the_plan(odd):
    plan = mixing.mix(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
