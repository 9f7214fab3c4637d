"""Interaction audit of five document filters, by a stream that retracts what a smaller id makes wrong.

All files of a table are processed as available-now micro-batches. Four filters look at one document; the fifth asks whether a smaller
id has the same text anywhere, which a batch alone can't know. So the state of a text is its smallest id so far and the masks (failed
filters) of the rows that hold it; some hundred texts share a state row. When a smaller id arrives, the earlier masks are retracted from the counters and counted
again as failing. Counters by part and mask are all that the report needs: 120 orders are read off 32 masks.
"""
from __future__ import annotations

import hashlib
import itertools
import json
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import shared_folder, track

FILTERS = "ABCDE"            # bit i of a mask: the document fails filter i
COPY = 1 << FILTERS.index("E")
BATCHES = 4                  # micro-batches for a table; what comes out doesn't depend on it
CAPITALS, SYMBOLS = bytes(range(ord("A"), ord("Z") + 1)), b"#$%&*|"

# one entry of a counter: [part, mask, good, toxic, rows]
Cell = tuple[str, int, int, int]


def own_mask(text: str) -> int:
    """Failed filters of a text by itself: A too short, B too few different words, C too many capitals, D symbols."""
    body = text.encode("utf-8", "surrogatepass")
    words = body.split()                # bytes split at ASCII white space only
    return ((len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words))
            + 4 * (100 * (len(body) - len(body.translate(None, CAPITALS))) > 3 * len(text))
            + 8 * (len(body) != len(body.translate(None, SYMBOLS))))


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            texts = [t.as_py() or "" for t in batch.column("text")]
            digests = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(map(own_mask, texts), pa.int32()), pa.array(digests)],
                                             names=["doc_id", "part", "mask", "digest"])


def _packed(cells: Counter) -> str:
    return json.dumps([[*cell, n] for cell, n in sorted(cells.items()) if n])


def _unpacked(packed: str) -> Counter:
    return Counter({tuple(cell): n for *cell, n in json.loads(packed)})


def _failing(cells: Counter) -> Counter:
    return Counter({(part, mask | COPY, good, toxic): n for (part, mask, good, toxic), n in cells.items()})


def _combined(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """One row for each text of an Arrow batch: its smallest id, the cells of the rows with that id, and those of all the others."""
    for batch in batches:
        least: dict[str, tuple] = {}
        first: dict[str, Counter] = {}
        others: dict[str, Counter] = {}
        for doc_id, part, mask, digest, good, toxic in zip(*batch.to_pydict().values()):
            order, cell = (doc_id is None, doc_id or 0), (part, mask, good, toxic)
            if digest not in least or order < least[digest]:
                if digest in least:
                    others.setdefault(digest, Counter()).update(first[digest])
                least[digest], first[digest] = order, Counter([cell])
            elif order == least[digest]:
                first[digest][cell] += 1
            else:
                others.setdefault(digest, Counter())[cell] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(d[:12], 16) % keys for d in least], pa.int64()), pa.array(list(least)), pa.array([not o[0] for o in least.values()]),
             pa.array([o[1] for o in least.values()], pa.int64()), pa.array([_packed(first[d]) for d in least]),
             pa.array([_packed(others[d]) if d in others else "" for d in least])],
            names=["key", "digest", "known", "id", "first", "others"])


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state of the texts that share a key: for each its smallest id and the cells that are counted for it as no copies."""
    texts = json.loads(state.get[0]) if state.exists else {}
    change = Counter()
    for frame in frames:
        for digest, known, number, first, others in zip(*(frame[c].tolist() for c in ("digest", "known", "id", "first", "others"))):
            if others:
                change.update(_failing(_unpacked(others)))
            new, cells = [not known, number], _unpacked(first)
            order, held = texts.get(digest, (None, []))
            if order is not None and new > order:
                change.update(_failing(cells))
                continue
            change.update(cells)
            if order is not None and new < order:           # the earlier one is no longer the first: retract, and count as a copy
                earlier = Counter({tuple(cell): n for *cell, n in held})
                change.subtract(earlier)
                change.update(_failing(earlier))
            elif order is not None:
                cells.update({tuple(cell): n for *cell, n in held})
            texts[digest] = (new, [[*cell, n] for cell, n in cells.items()])
    state.update((json.dumps(texts),))
    yield pd.DataFrame({"change": [_packed(change)]})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = Counter()
        for packed in batch.column("change").to_pylist():
            total.update(_unpacked(packed))
        rows = [(*cell, n) for cell, n in total.items() if n]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "mask", "good", "toxic", "n"])


@contextmanager
def _settings(spark: SparkSession, **wanted: str):
    """Settings that a stream takes over when it starts, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


TEXTS_PER_KEY = 256          # a key's texts share one state row and one call
STATE_BYTES = 100            # about what the state of a text takes
HELD_BYTES = 64 << 20        # state of a partition up to which it is held in memory

# State above that is kept in RocksDB, whose changes go to the checkpoint; memory is shared by all stores of an executor.
_ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
          "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
          "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
          "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400"}


def _stream_path(path: str, files: list[str]) -> str:
    """A stream reads folders or patterns: the path of a single file becomes a pattern that only this file matches."""
    folder, _, name = path.rstrip("/").rpartition("/")
    if len(files) == 1 and files[0].rpartition("/")[2] == name:
        return f"{folder}/[{name[0]}]{name[1:]}"
    return path


def _state_settings(spark: SparkSession, rows: int) -> dict[str, str]:
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _ROCKS if rows * STATE_BYTES > HELD_BYTES * partitions else {}


def _keys_of(spark: SparkSession, work: str, rows: int) -> int:
    """How many keys the texts are dealt to: fixed when a folder is first used, as the state is found by it."""
    try:
        return spark.read.schema("keys long").parquet(f"{work}/keys").first()["keys"]
    except AnalysisException:
        keys = max(1, math.ceil(rows / TEXTS_PER_KEY))
        spark.createDataFrame([(keys,)], "keys long").write.parquet(f"{work}/keys")
        return keys


def mask_counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES, work: str | None = None) -> DataFrame:
    """Count the documents below ``path`` by part (lang, null: empty), mask, good (a label has quality 1) and toxic (toxic 1).

    A document fails E when a smaller doc_id has an identical text (null counts as empty). Null ids come after all others and not before
    each other; rows of equal id and text don't fail because of each other. Labels without id are left out; a document
    with several labels is good, or toxic, if one says so. An empty table gives no counters; other columns are ignored.

    ``work``: folder of checkpoint and results; run again with the same folder, a stopped run goes on after the last complete batch,
    and files that have come since are added. Copies in an Arrow batch are combined before the exchange, so a text that a third of all rows
    hold sends some rows for each task.
    """
    work = work or f"{shared_folder(spark)}/filter-audit-{uuid.uuid4().hex[:12]}"
    track(spark, work)
    table = spark.read.parquet(path)
    files, rows = table.inputFiles(), table.count()            # counted by the files' footers
    keys = _keys_of(spark, work, rows)
    documents = (spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, math.ceil(len(files) / batches)))
                 .parquet(_stream_path(path, files)))
    masked = (documents.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
              .mapInArrow(_masks, "doc_id long, part string, mask int, digest string"))
    flags = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("_id"))
             .agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
                  F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")))
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("no id "), F.col("digest")))      # null ids must not meet in one task
    labelled = masked.join(flags, named == F.col("_id"), "left").select(
        "doc_id", "part", "mask", "digest", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    combined = labelled.mapInArrow(lambda b: _combined(b, keys), "key long, digest string, known boolean, id long, first string, others string")
    changes = combined.groupBy("key").applyInPandasWithState(
        _update, "change string", "texts string", "append", GroupStateTimeout.NoTimeout)
    out = "part string, mask int, good int, toxic int, n long"
    with _settings(spark, **_state_settings(spark, rows)):
        query = (changes.mapInArrow(_summed, out).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
                 .option("checkpointLocation", f"{work}/checkpoint").start(f"{work}/changes"))
    try:
        query.awaitTermination()
    finally:
        query.stop()
    try:
        found = spark.read.schema(out).parquet(f"{work}/changes")
    except AnalysisException:                           # a stream without files writes no table
        found = spark.createDataFrame([], out)
    return found.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def interaction_report(counters: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A part's counters are at most 32 masks; a filter that is one of m failed by a document removes it in 120 / m of the orders.
    """
    by_mask = counters.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    cells = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            steps.append(("".join(order), step, 1 << FILTERS.index(name), before))
            before |= steps[-1][2]
    literal = ", ".join(f"struct('{o}' AS filter_order, {s} AS step, {b} AS bit, {e} AS earlier)" for o, s, b, e in steps)
    each = cells.select("part", "cells", F.expr(f"inline(array({literal}))"))

    def total(condition: str, value: str) -> F.Column:
        return F.expr(f"aggregate(filter(cells, c -> {condition}), 0L, (s, c) -> s + {value})")

    here = "(c.mask & bit) <> 0 and (c.mask & earlier) = 0"
    return each.select(
        "part", "filter_order", "step", total("(c.mask & (bit | earlier)) = 0", "c.n").alias("kept"), total(here, "c.n").alias("removed"),
        total("(c.mask & bit) <> 0 and (c.mask & earlier) <> 0", "c.n").alias("redundant"), total("c.mask = bit", "c.n").alias("unique_fails"),
        total(here, "c.good").alias("good_lost"), total(here, "c.toxic").alias("toxic_lost"),
        total("(c.mask & bit) <> 0", "c.n * 120 div bit_count(c.mask)").alias("shapley"))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    counters = mask_counters(spark, f"{sf_dir}/documents.parquet", spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return interaction_report(counters)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (SELECT doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
        100 * (len(t) - len(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * len(t), regexp_matches(t, '[#$%&*|]'),
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), min(doc_id) OVER (PARTITION BY t) IS NOT NULL)] AS fails FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
p(o) AS (SELECT '' UNION ALL SELECT o || x FROM p, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(o, x)),
o AS (SELECT o AS filter_order, step, position(o[step] IN 'ABCDE') AS i,
        list_transform(range(1, step), lambda j: position(o[j] IN 'ABCDE')) AS earlier FROM p, range(1, 6) s(step) WHERE len(o) = 5),
c AS (SELECT f.*, o.*, len(list_filter(earlier, lambda j: fails[j])) > 0 AS gone FROM f, o),
r AS (SELECT part, filter_order, step, i, sum(n) FILTER (NOT gone AND NOT fails[i]) AS kept, sum(n) FILTER (NOT gone AND fails[i]) AS removed,
        sum(n) FILTER (gone AND fails[i]) AS redundant, sum(n) FILTER (fails[i] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
        sum(good) FILTER (NOT gone AND fails[i]) AS good_lost, sum(toxic) FILTER (NOT gone AND fails[i]) AS toxic_lost FROM c GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, i), 0)::BIGINT AS shapley
FROM r
"""
