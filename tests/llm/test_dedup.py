"""Exact dedup against an index, and line dedup."""
import hashlib
import random
import re
import uuid

import pytest

from spendweave.llm import exact_dedup, line_dedup


@pytest.fixture
def index(spark):
    made = exact_dedup.DigestIndex(spark, f"test_index_{uuid.uuid4().hex[:8]}", buckets=4)
    yield made
    made.drop()


def test_odd_rows(odd, odd_rows, none, index):
    rows = exact_dedup.deduplicate(odd, index).collect()
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in odd_rows]
    want = []
    for (doc_id, *_), text in zip(odd_rows, normal):
        ids = [r[0] for r, t in zip(odd_rows, normal) if t == text]
        want.append((doc_id or 0, min((i for i in ids if i is not None), default=None), len(ids), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.text_sha256) for r in rows) == sorted(want)
    kept = [r for r in rows if r.kept]
    assert len(kept) == len({r.text_sha256 for r in rows}) == len({r.text_sha256 for r in kept})     # one row of each, also of repeated rows
    assert all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.deduplicate(none, index, "empty").count() == 0


def test_later_batches_meet_the_index(spark, index):
    def frame(*rows):
        return spark.createDataFrame(rows, "doc_id long, text string")
    first = exact_dedup.deduplicate(frame((5, "a b"), (7, "c")), index, "monday").collect()
    assert all(r.kept for r in first)
    second = {r.doc_id: r for r in exact_dedup.deduplicate(frame((1, "a \n b"), (9, "d"), (8, "d")), index, "tuesday").collect()}
    assert (second[1].kept, second[1].keep_id) == (False, 5)
    assert (second[8].kept, second[9].kept, second[9].keep_id) == (True, False, 8)
    assert {r.keep_id for r in index.table().collect()} == {5, 7, 8} and index.table().count() == 3
    again = exact_dedup.deduplicate(frame((1, "a \n b"), (9, "d"), (8, "d")), index, "tuesday")        # a retried batch
    assert sorted((r.doc_id, r.kept) for r in again.collect()) == [(1, False), (8, True), (9, False)] and index.table().count() == 3


@pytest.mark.parametrize("ranges", [2, 3, 50])
def test_ranges_of_ids_make_no_difference(spark, odd, none, ranges):
    rng = random.Random(ranges)
    texts = [f"text  {rng.randrange(40)}" for _ in range(200)]
    rows = [(rng.randrange(150) if i % 9 else None, None if i % 31 == 0 else t) for i, t in enumerate(texts)]
    for docs in (odd, none, spark.createDataFrame(rows, "doc_id long, text string").repartition(6)):
        got = []
        for n in (1, ranges):
            made = exact_dedup.DigestIndex(spark, f"test_ranges_{uuid.uuid4().hex[:8]}", buckets=4)
            got.append(sorted(map(str, exact_dedup.deduplicate(docs, made, ranges=n).collect())))
            by_digest = [r.digest for r in made.table().collect()]
            assert len(by_digest) == len(set(by_digest))
            made.drop()
        assert got[0] == got[1]


def test_the_second_range_meets_the_index(spark, index):
    docs = spark.createDataFrame([(i, f"t {i % 6}") for i in range(12)], "doc_id long, text string")
    met = []
    add = index.add
    index.add = lambda digests, batch: met.append((index.table().count(), digests.count())) or add(digests, batch)
    assert sum(r.kept for r in exact_dedup.deduplicate(docs, index, ranges=2).collect()) == 6
    assert met == [(0, 6), (6, 6)] and index.table().count() == 6


def test_index_side_is_not_shuffled(spark, index):
    exact_dedup.deduplicate(spark.createDataFrame([(1, "x")], "doc_id long, text string"), index).collect()
    new = spark.createDataFrame([(b"x", 1)], "digest binary, keep_id long").repartition(index.buckets, "digest")
    plan = new.join(index.table().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1


def brute_passages(rows, run_words=line_dedup.RUN_WORDS):
    """(doc_id, start, length, keep_doc_id) of runs of units that came earlier, character by character."""
    seen, out = set(), []
    keeper = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        doc_id, text = rows[i][0], rows[i][1] or ""
        spans, begin = [], 0
        for at, c in enumerate(text):
            last = at + 1 == len(text)
            if c == "\n":
                spans.append((begin, at))
                begin = at + 1
            elif last or (c in ".!?。！？" and text[at + 1] not in ".!?。！？"):
                spans.append((begin, at + 1))
                begin = at + 1
        run = []
        for a, b in [*spans, (0, -1)]:
            body = text[a:b] if b >= 0 else ""
            words = tuple(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), body)))
            if b >= 0 and not words:
                continue
            if words in seen:
                strip = body.strip(" \t\n\x0b\x0c\r")
                start = a + body.index(strip)
                run.append((start, start + len(strip), max(len(words), len(strip) // 12), keeper[words]))
            else:
                if sum(r[2] for r in run) >= run_words:
                    out.append((doc_id or 0, run[0][0], run[-1][1] - run[0][0], run[0][3]))
                run = []
                if b >= 0:
                    seen.add(words)
                    keeper[words] = doc_id
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id or 0, r.start, r.length, r.keep_doc_id) for r in df.collect()), key=str)


def test_passages_of_odd_rows(odd, odd_rows, none):
    for run_words in (1, 6, line_dedup.RUN_WORDS):
        assert found(line_dedup.repeated_passages(odd, run_words)) == brute_passages(odd_rows, run_words)
    assert len(found(line_dedup.repeated_passages(odd, 6))) >= 4
    assert line_dedup.repeated_passages(none).count() == 0


def planted(seed=7):
    """Passages of 51 to 90 words that begin and end inside lines of other documents; and sentences that recur by chance."""
    rng = random.Random(seed)
    sentence = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n)) + rng.choice(".!?")
    common = [sentence(5) for _ in range(8)]
    passages = [[sentence(rng.randint(6, 12)) for _ in range(9)] for _ in range(5)]
    rows, holds = [], {}
    for i in range(80):
        body = [rng.choice(common) if rng.random() < 0.15 else sentence(rng.randint(4, 14)) for _ in range(25)]
        if i % 4 == 0:
            p = i // 4 % 5
            body[10:10] = ["so it began", *passages[p], "and it went on."]
            holds[i] = " ".join(passages[p])
        lines = [" ".join(body[j:j + 7]) for j in range(0, len(body), 7)]
        rows.append((i, "\n".join(lines)))
    return rows, holds


def test_passages_inside_lines(spark):
    rows, holds = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    cuts = line_dedup.repeated_passages(docs)
    assert found(cuts) == brute_passages(rows)
    by_doc = {}
    for r in cuts.collect():
        by_doc.setdefault(r.doc_id, []).append(rows[r.doc_id][1][r.start:r.start + r.length])
    later = {i for i in holds if i // 4 >= 5}
    assert set(by_doc) == later                                       # clean documents and first holders are left alone
    for i in later:
        cut, whole = " ".join(by_doc[i]).split(), holds[i].split()
        assert len(set(whole) & set(cut)) >= 0.8 * len(set(whole)) and len(cut) <= len(whole) + 15


def test_texts_are_cut_at_the_offsets(spark):
    """Rows of equal and of null ids are cut one by one, and the rest of a text stays as it was."""
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(1, f"Title\nété. {long}.\n\nend"), (2, f"été and so\n{long.upper()}. And 😀 more.\nend"), (1, f"Title\nété. {long}.\n\nend"), (None, f"x. {long}. y"), (None, f"x. {long}. y"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = [(r.doc_id, r.text, r.removed) for r in line_dedup.cut_texts(docs).collect()]
    assert sorted(((i or 0, t) for i, t, _ in out if t), key=str) == sorted([(0, "x.  y"), (1, rows[0][1]), (2, "été and so\n And 😀 more.\nend")], key=str)
    assert [t for i, t, _ in out].count("") == 2                       # of equal rows the second is cut whole
    [two] = [x for x in out if x[0] == 2]
    span = two[2][0]
    assert rows[1][1][span.start:span.start + span.length].lower() == long + "." and span.keep_doc_id == 1
    assert [x[1] for x in out if x[0] == 3] == [None]


def test_scripts_without_spaces(spark):
    passage = "漢字仮名交文例" * 60 + "。"
    rows = [(1, "短文。" + passage), (2, "別文。" + passage), (3, "短文。他。")]
    assert found(line_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_passages(rows) == [(2, 3, len(passage), 1)]
