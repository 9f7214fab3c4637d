import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spendweave.llm import quality_rules as rules


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if often[window] > 1:
            covered.update(range(i, i + 8))
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, odd, odd_rows):
    rng = random.Random(1)
    more = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(100, 180)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.text_counts(docs, ["doc_id"]).collect())
    assert got == sorted(((r[0] or 0), *plain_counts(r[1])) for r in [*odd_rows, *more])


def test_binomial_tail(spark):
    cases = [(0, 10), (3, 10), (10, 10), (7, 400), (0, 1)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", rules.binomial_tail(F.col("k"), F.col("n"), 0.03).alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(sum(math.comb(r.n, i) * 0.03 ** i * 0.97 ** (r.n - i) for i in range(r.k + 1)), rel=1e-9)


def test_cutoffs_against_plain_search(spark):
    rng = random.Random(4)
    rows = [(s, *[abs(rng.gauss(0, scale)) for scale in (0.05, 0.02, 0.1, 0.01)]) for s, n in (("de", 3000), ("en", 5000), ("xx", 20)) for _ in range(n)]
    holdout = spark.createDataFrame(rows, "stratum string, " + ", ".join(f"{r} double" for r in rules.RULES))
    got = {r.stratum: r for r in rules.certified_cutoffs(holdout).collect()}
    level, share = rules.DELTA / (3 * 4 * len(rules.GRID)), rules.ALPHA / 4

    def tail(k, n):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(share) + (n - i) * math.log1p(-share)) for i in range(k + 1))
    for stratum in ("de", "en"):
        own = [r for r in rows if r[0] == stratum]
        for j, rule in enumerate(rules.RULES):
            fit = [c for c in rules.GRID if tail(sum(r[j + 1] > c for r in own), len(own)) <= level]
            assert got[stratum][f"max_{rule}"] == min(fit)
    assert "xx" not in got                                # too few documents to prove anything


def test_odd_rows(odd, odd_rows, none, labels):
    rows = rules.apply_rules(odd, labels).collect()
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed)              # seven labels prove no cutoff
    assert len(rows) == len(odd_rows)
    assert rules.apply_rules(none, labels).count() == 0 and rules.apply_rules(odd, labels.limit(0)).count() == len(odd_rows)


def test_false_rejection_is_limited_on_unseen_labels(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(f"w{rng.randrange(3000)}" + ("#" if rng.random() < (0.002 if i % 5 else 0.9) else "") for _ in range(30)), "en") for i in range(6000)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i, *_ in docs], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in rules.apply_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string"), labels).collect()}
    unseen = [i for i in kept if zlib.crc32(str(i).encode()) % 3 == 1]
    good, bad = [kept[i] for i in unseen if i % 5], [kept[i] for i in unseen if not i % 5]
    assert sum(good) / len(good) >= 1 - rules.ALPHA and sum(bad) / len(bad) < 0.05


def test_few_hundred_labels_are_enough(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{rng.randrange(3000)}" + ("#" if i % 5 == 0 else "") for _ in range(30)), lang)
            for lang, first in (("de", 0), ("en", 600), ("es", 1200), ("fr", 1800)) for i in range(first, first + (600 if lang != "es" else 100))]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i, *_ in docs], "doc_id long, quality int, toxic int")
    rows = rules.apply_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string"), labels, ("doc_id", "lang")).collect()
    n = Counter(r.lang for r in rows if r.doc_id % 5 and zlib.crc32(str(r.doc_id).encode()) % 3 != 1)
    assert 252 <= min(n["de"], n["en"], n["fr"]) and n["es"] < 252
    for r in rows:
        assert r.base_failed or r.kept == (r.lang == "es" or r.doc_id % 5 > 0)


def test_chosen_cutoffs_against_plain_search(spark):
    rng = random.Random(6)
    docs = [(s, *[abs(rng.gauss(0, scale)) for scale in (0.05, 0.02, 0.1, 0.01)]) for s, n in (("de", 3000), ("en", 700), ("xx", 20)) for _ in range(n)]
    frame = spark.createDataFrame(docs, "stratum string, " + ", ".join(f"{r} double" for r in rules.RULES))
    got = {r.stratum: [r[f"max_{x}"] for x in rules.RULES] for r in rules.chosen_cutoffs(frame, frame, F.lit(False)).collect()}

    def low(k, n, share, level):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(share) + (n - i) * math.log1p(-share)) for i in range(k + 1)) <= level
    for stratum in ("de", "en", "xx"):
        own = [r[1:] for r in docs if r[0] == stratum]
        common = [c for c in rules.GRID if low(sum(max(r) > c for r in own), len(own), rules.ALPHA, rules.DELTA / 6)]
        each = [min((c for c in rules.GRID if low(sum(r[j] > c for r in own), len(own), rules.ALPHA / 4, rules.DELTA / 24)), default=None) for j in range(4)]
        choices = [[min(common, default=None)] * 4, each]
        gone = [sum(any(c is not None and v > c for v, c in zip(r, choice)) for r in own) for choice in choices]
        assert got[stratum] == choices[gone[1] > gone[0]]


def test_no_python_in_the_plan(odd, labels):
    plan = rules.apply_rules(odd, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
