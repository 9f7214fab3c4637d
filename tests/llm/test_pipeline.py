"""Each stage does what its operator decides, and nothing else."""
import corpus_pipeline as pipeline
import pytest

from spendweave.llm import common, mixing, packing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, step in pipeline.STAGES:
        docs = common.stage(step(spark, docs, SF), "test-stage")
        out.append(docs)
    return out


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_classifier_keeps_good_and_drops_bad(spark, stages):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in stages[0].collect()}
    rows = docs.join(labels, "doc_id").collect()
    assert sum(r.doc_id in kept for r in rows if r.quality == 1) / sum(r.quality == 1 for r in rows) > 0.99
    assert sum(r.doc_id in kept for r in rows if r.quality == 0) / sum(r.quality == 0 for r in rows) < 0.1


def test_exact_stage(stages):
    import re
    first = {}
    for doc_id, text in texts(stages[0]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), (doc_id, text))
    assert texts(stages[1]) == sorted(first.values())


def test_near_stage(stages):
    """All pairs of five-word shingle sets: of what similarities of 0.8 or more connect, the smallest id stays."""
    rows = texts(stages[1])
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for _, t in rows]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small and small >= 0.8 * large:
                both = len(sets[i] & sets[j])
                if both >= 0.8 * (small + large - both):
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
    first = {}
    for row, r in zip(rows, root):
        first.setdefault(r, row)
    assert texts(stages[2]) == sorted(first.values())


def test_mix_stage(stages):
    rows = mixing.mix(stages[2], carry=("doc_id", "text")).collect()
    want = []
    for r in rows:
        for n in r.taken_passes:
            if n:
                want.append((r.doc_id, r.text if n == r["size"] else " ".join(r.text.split()[:n])))
    assert texts(stages[3]) == sorted(want)
    cut = sum(n not in (0, r["size"]) for r in rows for n in r.taken_passes)
    assert cut <= len({r.source for r in stages[2].collect()})       # the target of a source ends inside one document at most


def test_pack_stage(stages):
    want = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.tokenised_pieces(stages[3], ["doc_id"]).collect())
    rows = stages[4].collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.02 * total / 2048 + 1


def test_columns_and_run(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(s.schema.simpleString() == docs.schema.simpleString() for s in stages[:-1])
    got = pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in got.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in stages[4].collect())


def test_odd_rows_go_through(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, none):
        columns = docs.columns
        for _, step in pipeline.STAGES[:-1]:
            docs = common.stage(step(spark, docs, str(tmp_path)), "test-odd")
            assert docs.columns == columns
        last = pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert (last.count() > 0) == (docs.count() > 0)
