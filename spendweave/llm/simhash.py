"""Near-duplicate classes by SimHash, with candidates from fuzzy hashing by the Golay code."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage
from .components import components
from .golay import fuzzy_keys

BITS = 64
SEGMENTS = ((0, 22), (22, 21), (43, 21))     # (first bit, bits)
DISTANCE = 4                                 # what two segments with at most two errors each allow for
SHINGLE = 4
CHUNK = 1 << 14                              # shingles whose bits are unpacked at a time
WIDE = 16                                    # rows of a bucket from which links are found by search instead of by shifts
HELD = 50_000                                # rows of a bucket that a task holds; more are linked by midpoints


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the shingles' XXH64 (seed 42). A-Z are lower-cased, words are runs outside ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(BITS, np.int64), max(1, len(words) - shingle + 1)
    for at in range(0, n, CHUNK):
        stop = min(at + CHUNK, n)
        spans = zip(starts[at:stop], ends[at + shingle - 1:stop + shingle - 1]) if len(words) >= shingle else [(0, len(joined) + 1)]
        hashes = np.array([digest(joined[a:b - 1], 42) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, carry: list[str], shingle: int = SHINGLE) -> DataFrame:
    """``carry`` and fp (the fingerprint's bits as a signed long), in one pass over the whole texts."""
    named = docs.select(*carry, F.col("text").alias("_text"))
    schema = T.StructType([*[named.schema[c] for c in carry], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("_text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(fps, pa.int64())], names=[*carry, "fp"])

    return named.mapInArrow(run, schema)


def bucket_keys(fps: DataFrame) -> DataFrame:
    """(key, fp) rows. Of at most four errors in three segments, some two segments have at most two errors together, so
    fingerprints that link share a Golay key in both; a key is the pair's number and the two codeword indices."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                values = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                sides = [fuzzy_keys(values >> np.uint64(first) & np.uint64((1 << bits) - 1), bits).astype(np.int64) for first, bits in SEGMENTS]
                new = [np.concatenate([np.ones((len(k), 1), bool), k[:, 1:] != k[:, :-1]], axis=1) for k in sides]
                for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
                    row, a, b = np.nonzero(new[i][:, :, None] & new[j][:, None, :])
                    key = pair << 24 | sides[i][row, a] << 12 | sides[j][row, b]
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(values[row].view(np.int64))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key int, fp long")


def search_links(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect exactly the values connected by pairs within ``distance``: each found value is compared with those not
    yet found only, so a clump costs one comparison per value and gives one link per value."""
    left, links = values.copy(), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            seen = front.pop()
            near = np.bitwise_count(left ^ seen) <= distance
            if near.any():
                links += [(seen, v) for v in left[near]]
                front += list(left[near])
                left = left[~near]
    return links


def bucket_links(keys: DataFrame, distance: int = DISTANCE, held: int = HELD) -> DataFrame:
    """(a, b, hot) from rows that lie together by key, sorted. Small buckets: rows compared at growing shifts, all buckets of a batch at
    once. Wide ones: search. A bucket above ``held`` rows isn't kept: its rows come out one by one, marked hot."""

    def links_of(key, fp):
        found = []
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        for s, n in zip(starts[sizes >= WIDE], sizes[sizes >= WIDE]):
            found += search_links(fp[s:s + n], distance)
        small = np.repeat(sizes < WIDE, sizes)
        for shift in range(1, WIDE):
            same = np.flatnonzero((key[shift:] == key[:-shift]) & small[shift:])
            if not len(same):
                break
            close = same[np.bitwise_count(fp[same] ^ fp[same + shift]) <= distance]
            found += zip(fp[close], fp[close + shift])
        return found

    def batch_of(links, hot):
        a, b = np.array(links, np.uint64).reshape(-1, 2).T.copy().view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), hot))], names=["a", "b", "hot"])

    def run(batches):
        held_key, held_fp, flushed = np.zeros(0, np.int32), np.zeros(0, np.uint64), None
        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if flushed is not None:
                hot = key == flushed
                yield batch_of([(v, v) for v in fp[hot]], True)
                key, fp = key[~hot], fp[~hot]
            if not len(key):
                held_key, held_fp = key, fp
                continue
            last = np.searchsorted(key, key[-1])          # the last bucket may go on
            yield batch_of(links_of(key[:last], fp[:last]), False) if last else batch_of([], False)
            held_key, held_fp = key[last:], fp[last:]
            if len(held_key) > held:
                flushed = held_key[0]
                yield batch_of([(v, v) for v in held_fp], True)
                held_key, held_fp = held_key[:0], held_fp[:0]
        yield batch_of(links_of(held_key, held_fp), False) if len(held_key) else batch_of([], False)

    parts = keys.repartition("key").sortWithinPartitions("key")
    return parts.mapInArrow(run, "a long, b long, hot boolean")


def midpoint_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Exact links of fingerprints in buckets too large to hold: values within four bits have a value between them, two bits
    from both. Each emits its 2,081 neighbours within two bits, and all that meet in one hang under the smallest: no pairs."""
    if distance != 4:
        raise ValueError("midpoints are laid out for a distance of four")
    bits = [1 << i for i in range(BITS)]
    near = np.array([0, *bits, *[x | y for i, x in enumerate(bits) for y in bits[:i]]], np.uint64)

    def run(batches):
        for batch in batches:
            for v in batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64):
                yield pa.RecordBatch.from_arrays([pa.array((v ^ near).view(np.int64)), pa.array(np.full(len(near), v).view(np.int64))], names=["mid", "fp"])

    met = fps.select("fp").mapInArrow(run, "mid long, fp long")
    least = met.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("_b")).where("a <> _b").select("mid", "a")
    return met.join(least, "mid").select("a", F.col("fp").alias("b")).where("a <> b")


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, held: int = HELD) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints (column fp) within ``distance`` bits of each other, chains included."""
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")    # many keys from few bytes
    keys = bucket_keys(spread)
    found = stage(bucket_links(keys, distance, held), "simhash-links")
    links = found.where("not hot").select("a", "b")
    hot = found.where("hot").select(F.col("a").alias("fp")).distinct()
    if hot.limit(1).count():
        links = links.unionByName(midpoint_links(hot, distance))
    return links


def fingerprint_classes(fps: DataFrame, distance: int = DISTANCE, held: int = HELD) -> DataFrame:
    """(node, root) for the distinct fingerprints (column fp) that link to another one."""
    return components(fingerprint_links(fps, distance, held))


def candidate_pairs(rows: DataFrame, row: str, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(a, b): pairs of row numbers for a check on the whole texts, a below b. Rows of one fingerprint meet its smallest row, and smallest rows
    of linked fingerprints meet each other. ``rows`` needs different numbers in ``row``; texts without words meet nobody."""
    signed = stage(with_fingerprint(rows, [row], shingle).where("fp <> 0").select(F.col(row).alias("row"), "fp"), "simhash-rows")
    fps = stage(signed.groupBy("fp").agg(F.min("row").alias("first")), "simhash-fps")
    equal = signed.join(fps, "fp").where("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    side = lambda of: fps.select(F.col("fp").alias(of), F.col("first").alias(f"{of}_first"))
    linked = fingerprint_links(fps, distance).distinct().join(side("a"), "a").join(side("b"), "b")
    return equal.unionByName(linked.select(F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b")).distinct())


def near_duplicates(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Fingerprint and class of every row. Fingerprints with at most ``distance`` differing bits link, links chain.

    Equal fingerprints are one node, so copies cost nothing; classes are found between distinct fingerprints. Texts without
    words have fingerprint zero and link like others. Null ids have a class when another row of it has an id, else a null
    component_id. An empty table gives an empty result; other columns are ignored.

    Returns ``carry``, fingerprint (16 hex digits), component_id (smallest doc_id reachable), fp.
    """
    if distance > DISTANCE:
        raise ValueError(f"the segments find up to {DISTANCE} differing bits")
    wanted = list(dict.fromkeys([*carry, "doc_id"]))
    rows = stage(with_fingerprint(docs, wanted, shingle), "simhash-rows")
    fps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-fps")
    rooted = (fps.join(fingerprint_classes(fps, distance), F.col("fp") == F.col("node"), "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    rooted = stage(rooted, "simhash-rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stage(rooted.join(smallest, "root").select("fp", "component_id", "root"), "simhash-classes")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(classes, "fp").select(*wanted, hexed.alias("fingerprint"), "component_id", "root")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
