"""The filter audit against counting every order document by document."""
import itertools
import random
import re

from spendweave.llm import filter_audit as fa

LABELS = "doc_id long, quality int, toxic int"


def fails(rows, row):
    doc_id, text = row[0], row[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    smaller = [r for r in rows if (r[1] or "") == text and r[0] is not None and (doc_id is None or r[0] < doc_id)]
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": bool(smaller)}


def brute(rows, labels):
    good, toxic = ({i for i, *v in labels if v[at] == 1 and i is not None} for at in (0, 1))
    failed, out, shapley = [(r, fails(rows, r)) for r in rows], {}, {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in failed if (r[2] or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, name in enumerate(order, 1):
                removed = [d for d in left if d[1][name]]
                left = [d for d in left if not d[1][name]]
                out[part, order, step] = [len(left), len(removed), sum(f[name] for _, f in mine) - len(removed),
                                          sum(f[name] and sum(f.values()) == 1 for _, f in mine), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
                shapley[part, name] = shapley.get((part, name), 0) + len(removed)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def report(spark, path, labels, **more):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in fa.interaction_report(fa.mask_counters(spark, path, labels, **more)).collect()}


def made(seed, n):
    rng = random.Random(seed)
    texts = [None, "", " ".join(f"w{i}" for i in range(250)), "X Y Z", "same " * 300, "a # b", "漢字 " * 210 + "$", " ".join(f"u{i}" for i in range(220)) + "\x85"]
    return [(rng.choice([None, *range(n)]), rng.choice(texts), rng.choice(["en", "de", None])) for _ in range(n)]


def write(spark, rows, path, files):
    for at in range(files):
        part = rows[at::files]
        spark.createDataFrame([(*r, 1, 2) for r in part], "doc_id long, text string, lang string, mask int, n int").coalesce(1).write.mode("append").parquet(path)


def test_later_files_retract(spark, tmp_path):
    """Ids fall from file to file, so every batch takes back what an earlier one counted."""
    rows = sorted(made(1, 150), key=lambda r: (r[0] is not None, -(r[0] or 0)))
    by_file = [rows[i * 30:(i + 1) * 30] for i in range(5)]
    for part in by_file:
        write(spark, part, f"{tmp_path}/docs", 1)
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 150, 2)] + [(3, 0, 0), (3, 1, 0), (None, 1, 1), (5, None, None)]
    table = spark.createDataFrame([(a, b if b is None else int(b), c if c is None else int(c)) for a, b, c in labels], LABELS)
    want = brute(rows, labels)
    for batches in (1, 5):
        got = report(spark, f"{tmp_path}/docs", table, batches=batches, work=f"{tmp_path}/work{batches}")
        assert got == want
    changes = spark.read.parquet(f"{tmp_path}/work5/changes")
    assert changes.where("n < 0").count() > 0                       # masks were retracted
    assert len(want) == 3 * 600


def test_a_stream_goes_on_with_new_files(spark, tmp_path):
    rows = made(2, 80)
    path, labels = f"{tmp_path}/docs", spark.createDataFrame([], LABELS)
    write(spark, rows[:40], path, 2)
    assert report(spark, path, labels, work=f"{tmp_path}/work") == brute(rows[:40], [])
    write(spark, rows[40:], path, 2)
    assert report(spark, path, labels, work=f"{tmp_path}/work") == brute(rows, [])


def test_odd_and_empty_tables(spark, tmp_path, odd, odd_rows, none, labels):
    odd.write.parquet(f"{tmp_path}/odd")
    none.write.parquet(f"{tmp_path}/none")
    rows = [(r[0], r[1], r[2]) for r in odd_rows]
    assert report(spark, f"{tmp_path}/odd", labels) == brute(rows, [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert report(spark, f"{tmp_path}/none", labels) == {}


def test_large_state_goes_to_disk(spark, tmp_path, odd, odd_rows, labels, monkeypatch):
    """With RocksDB the same result; the session's settings are put back."""
    monkeypatch.setattr(fa, "HELD_BYTES", 0)
    key = next(iter(fa._ROCKS))
    before = spark.conf.get(key)
    odd.write.parquet(f"{tmp_path}/odd")
    assert report(spark, f"{tmp_path}/odd", labels) == brute([r[:3] for r in odd_rows], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert spark.conf.get(key) == before
    assert fa._state_settings(spark, 10 ** 9) and not fa._state_settings(spark, 0)
