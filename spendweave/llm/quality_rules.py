"""Quality rules whose cutoffs come from labelled holdouts with exact binomial bounds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage, words

WINDOW = 8                 # words of a window; a power of two
SYMBOLS = "[#*$%&|<>]+"
ALPHA = 0.02               # share of good documents of a stratum that all rules together may reject
DELTA = 0.05               # probability that any of the bounds fails
RULES = ("symbols_per_word", "repeated_share", "upper_share", "dup_lines_per_word")
GRID = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0, 1.5, 2.0)


MOST_STRATA = 10_000       # rows of a cutoff table up to which it is sent to every task; larger ones are joined by an exchange


def small_side(table: DataFrame, name: str) -> DataFrame:
    """The table as a stage, to be broadcast if its counted rows allow that."""
    kept = stage(table, name)
    return F.broadcast(kept) if kept.count() <= MOST_STRATA else kept


def _removed(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def text_counts(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Counts of every whole text, without a shuffle: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper.

    Window hashes are built by doubling (1, 2, 4, 8 words), so each word is hashed four times whatever the window. Only
    texts whose window hashes aren't all different are sorted. Each array is a column of its own: an array named inside a
    lambda would be built again for every element.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*carry, text.alias("_text"), words(text).alias("_w"))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    rows = rows.select(
        *carry, F.size("_w").cast("long").alias("n_words"), F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _removed(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"), _removed(F.col("_text"), "[A-Z]+").cast("long").alias("n_upper"),
        F.filter(F.split("_text", "\n"), has_word).alias("_lines"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    counts = ["n_words", "word_chars", "n_symbols", "n_upper"]
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    counts.append("n_dup_lines")
    width = 1
    while width < WINDOW:
        shifted = F.slice("_h", width + 1, F.greatest(F.size("_h"), F.lit(1)))
        rows = rows.select(*carry, *counts, F.zip_with("_h", shifted, lambda a, b: F.xxhash64(a, b)).alias("_h"))
        width *= 2
    rows = rows.select(*carry, *counts, F.slice("_h", 1, F.greatest(F.col("n_words").cast("int") - WINDOW + 1, F.lit(0))).alias("_h"))
    numbered = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.select(*carry, *counts, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(numbered)).alias("_s"))
    other = lambda j: F.get("_s", j)["h"]
    twice = F.filter("_s", lambda e, j: F.coalesce(e["h"] == other(j - 1), F.lit(False)) | F.coalesce(e["h"] == other(j + 1), F.lit(False)))
    rows = rows.select(*carry, *counts, F.sort_array(F.transform(twice, lambda e: e["i"])).alias("_at"))
    covered = F.aggregate(
        "_at", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")), lambda acc: acc["n"])
    return rows.select(*carry, *counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def with_statistics(counts: DataFrame) -> DataFrame:
    per_word = lambda c: F.col(c) / F.greatest("n_words", F.lit(1))
    return (counts.withColumn("symbols_per_word", per_word("n_symbols")).withColumn("repeated_share", per_word("n_repeat_words"))
            .withColumn("upper_share", F.col("n_upper") / F.greatest("word_chars", F.lit(1)))
            .withColumn("dup_lines_per_word", per_word("n_dup_lines")))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exactly, by the incomplete beta function of the JVM's math library."""
    k, n = k.cast("double"), n.cast("double")
    inside = k < n
    tail = F.reflect(F.lit("org.apache.commons.math3.special.Beta"), F.lit("regularizedBeta"), F.lit(1.0 - p),
                     F.when(inside, n - k).otherwise(F.lit(1.0)), F.when(inside, k + 1).otherwise(F.lit(1.0)))
    return F.when(inside, tail.cast("double")).otherwise(F.lit(1.0))


def certified_cutoffs(holdout: DataFrame, alpha: float = ALPHA, delta: float = DELTA, grid=GRID) -> DataFrame:
    """For each stratum, the lowest cutoff of each rule that is proven not to reject more than its share of good documents.

    ``holdout``: stratum and statistics of good labelled documents. A cutoff is proven when so few rejections would have a
    probability of at most delta / (strata x rules x cutoffs) if the true share were alpha / rules (Clopper-Pearson bound, Bonferroni
    correction); so with probability 1 - delta all chosen cutoffs hold at once. A rule without a proven cutoff is off (null).
    One pass: rejections are counted for the whole grid in one aggregation.
    """
    tests = [(rule, cutoff) for rule in RULES for cutoff in grid]
    rejected = [F.sum((F.col(rule) > cutoff).cast("long")).alias(f"k{i}") for i, (rule, cutoff) in enumerate(tests)]
    counted = holdout.groupBy("stratum").agg(F.count("*").alias("n"), *rejected)
    cells = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(cutoff).alias("cutoff"), F.col(f"k{i}").alias("k"))
                      for i, (rule, cutoff) in enumerate(tests)])
    level = F.lit(delta) / (F.count("*").over(W.partitionBy()) * len(tests))      # before the cells are spread out: one row a stratum
    each = counted.withColumn("level", level).select("stratum", "n", "level", F.inline(cells))
    proven = each.where(binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES)) <= F.col("level"))
    return proven.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RULES])


def chosen_cutoffs(counts: DataFrame, holdout: DataFrame, base: Column, alpha: float = ALPHA, delta: float = DELTA, grid=GRID) -> DataFrame:
    """For each stratum, cutoffs with which all rules together are proven not to reject more than their share of good documents.

    Half of delta goes to one cutoff for all rules: the documents that any rule rejects are tested against the whole of alpha, from
    the loosest cutoff to the strictest, at level delta / (2 x strata). The other half goes to each rule's own cutoffs, tested against
    alpha / rules in the same order. A fixed order needs no correction for the number of cutoffs: the first true excess in it has to
    pass for any error. Rejections only grow along it, so the lowest proven cutoff is where the order stops. Both hold at once, so a
    stratum may take the one that rejects more of ``counts`` outside the base check (ties: the common cutoff).
    """
    tail = lambda k: binomial_tail(F.col(k), F.col("n"), alpha)
    rejected = [F.sum((F.greatest(*RULES) > c).cast("long")).alias(f"k{i}") for i, c in enumerate(grid)]
    counted = holdout.groupBy("stratum").agg(F.count("*").alias("n"), *rejected)
    level = F.lit(delta / 2) / F.count("*").over(W.partitionBy())
    proven = [F.when(tail(f"k{i}") <= F.col("level"), F.lit(c)) for i, c in enumerate(grid)]
    common = counted.withColumn("level", level).select("stratum", F.least(*proven).alias("common"))
    own = certified_cutoffs(holdout, alpha, delta / 2 * len(grid), grid)      # takes the correction for the grid back
    both = small_side(common.join(own, "stratum", "left"), "rules-cutoffs")
    over_common = F.coalesce(F.greatest(*RULES) > F.col("common"), F.lit(False))
    over_own = F.coalesce(F.greatest(*[(F.col(r) > F.col(f"max_{r}")).cast("int") for r in RULES]) == 1, F.lit(False))
    wins = (counts.where(~base).join(both, "stratum").groupBy("stratum")
            .agg((F.sum(over_common.cast("long")) >= F.sum(over_own.cast("long"))).alias("_wins")))
    use_common = F.coalesce("_wins", F.lit(True)) & F.col("common").isNotNull()
    return both.join(wins, "stratum", "left").select(
        "stratum", *[F.when(use_common, F.col("common")).otherwise(F.col(f"max_{r}")).alias(f"max_{r}") for r in RULES])


def apply_rules(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id",), alpha: float = ALPHA) -> DataFrame:
    """Counts, base check and verdict for every document.

    Good labelled documents (quality 1) with crc32(doc_id as text) mod 3 other than 1 set the cutoffs per language; the rest
    of the labels stays untouched, to check the guarantee. Null text counts as empty and fails the base check. Null
    languages form a stratum; languages without proven cutoffs keep what passes the base check (with four languages those with
    fewer than 252 good labels in the folds). Null label ids are left out,
    a document labelled twice counts once (with its lower label). Empty tables work; other columns are ignored. Equal window hashes (64 bits) count as equal windows.
    """
    named = docs.withColumn("_stratum", F.coalesce(F.col("lang").cast("string"), F.lit("")))
    out = list(dict.fromkeys([*carry, "doc_id"]))
    counts = stage(with_statistics(text_counts(named, [*out, "_stratum"])).withColumnRenamed("_stratum", "stratum"), "rules-counts")
    good = (labels.select(F.col("doc_id").alias("_id"), "quality").where("_id is not null").groupBy("_id").agg(F.min("quality").alias("quality"))
            .where("quality = 1").where(F.crc32(F.col("_id").cast("string").cast("binary")) % 3 != 1))
    holdout = counts.join(good, F.col("doc_id") == F.col("_id")).select("stratum", *RULES)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    cutoffs = small_side(chosen_cutoffs(counts, stage(holdout, "rules-holdout"), base, alpha), "rules-chosen")
    over = [F.coalesce(F.col(r) > F.col(f"max_{r}"), F.lit(False)) for r in RULES]
    rejected = over[0] | over[1] | over[2] | over[3]
    return counts.join(cutoffs, "stratum", "left").select(
        *out, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & ~rejected).alias("kept"), "stratum", *RULES, *[f"max_{r}" for r in RULES])


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return apply_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                            "base_failed", "kept")


#: The fold's CRC-32 is worked out bit by bit, the binomial tail is summed term by term. 'all' is the common cutoff of all rules.
SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i,
          unnest(list_transform(range(1, len(ws) - 6), lambda i: hash(array_to_string(ws[i:i + 7], ' ')))) AS h FROM w WHERE len(ws) >= 8),
often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM win),
covered AS (SELECT doc_id, sum(least(8, i - last))::BIGINT AS n FROM (
              SELECT doc_id, i, lag(i, 1, i - 8) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM often WHERE c > 1) GROUP BY doc_id),
c AS (SELECT w.doc_id, stratum, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
        (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(t) - len(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
        coalesce(covered.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id)),
s AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM c),
v AS (SELECT s.*, r.rule, r.v FROM s, LATERAL (VALUES
        ('a', n_symbols::DOUBLE / greatest(n_words, 1)), ('b', n_repeat_words::DOUBLE / greatest(n_words, 1)),
        ('c', n_upper::DOUBLE / greatest(word_chars, 1)), ('d', n_dup_lines::DOUBLE / greatest(n_words, 1))) r(rule, v)),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND xor(4294967295, list_reduce(
           list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, (x & 1) * 3988292384) END)) % 3 <> 1),
grid AS (SELECT unnest([0.02::DOUBLE, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0, 1.5, 2.0]) AS cutoff),
top AS (SELECT doc_id, stratum, max(v) AS v FROM v GROUP BY ALL),
tested AS (SELECT stratum, 'all' AS rule, 0.02::DOUBLE AS p, cutoff, count(*) AS n, count(*) FILTER (v > cutoff) AS k FROM top JOIN good USING (doc_id), grid GROUP BY ALL
           UNION ALL SELECT stratum, rule, 0.005, cutoff, count(*), count(*) FILTER (v > cutoff) FROM v JOIN good USING (doc_id), grid GROUP BY ALL),
m AS (SELECT 0.025 / count(DISTINCT stratum) AS level FROM tested),
proven AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM tested WHERE list_sum(list_transform(range(k + 1),
             lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p))))
             <= (SELECT level FROM m) / CASE rule WHEN 'all' THEN 1 ELSE 4 END GROUP BY ALL),
base AS (SELECT doc_id, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s),
over AS (SELECT doc_id, stratum, bool_or(rule = 'all') AS by_common, bool_or(rule <> 'all') AS by_own FROM (
           SELECT doc_id, stratum, rule FROM top JOIN proven USING (stratum) WHERE rule = 'all' AND top.v > cutoff
           UNION ALL SELECT doc_id, stratum, rule FROM v JOIN proven USING (stratum, rule) WHERE v.v > cutoff) GROUP BY ALL),
wins AS (SELECT stratum, count(*) FILTER (by_common) >= count(*) FILTER (by_own) AS common_wins FROM over JOIN base USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
gone AS (SELECT doc_id FROM over LEFT JOIN wins USING (stratum) WHERE CASE
           WHEN coalesce(common_wins, true) AND EXISTS (FROM proven p WHERE p.stratum = over.stratum AND rule = 'all') THEN by_common ELSE by_own END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM gone) AS kept
FROM s JOIN base USING (doc_id)
"""
