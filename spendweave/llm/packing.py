"""Best-fit packing of tokenised documents into sequences of fixed length, with matching of large items."""
from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import running_total, slices_for, stage

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k"      # ids of byte_bpe_50k.json; the rank file of the same vocabulary gives the same ids faster
ADDED = ("<|endoftext|>", 50256)  # fixed value: the token that file adds; its string in a text is this id
BATCH_ROWS = 256


def encoder(folder_of=None):
    """Text to ids, as the vocabulary's JSON file has them without special tokens at the ends. Built once per Python worker;
    ``folder_of`` maps a vocabulary file's name to its path."""
    import base64

    import public_tokenizers
    import tiktoken

    path = (folder_of or public_tokenizers.path)(f"{VOCABULARY}.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    ordinary = tiktoken.Encoding(VOCABULARY, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        if ADDED[0] not in text:
            return ordinary(text)
        first, *others = text.split(ADDED[0])
        ids = ordinary(first)
        for part in others:
            ids.append(ADDED[1])
            ids += ordinary(part)
        return ids

    return encode


_encoders: dict = {}


def _encode(folder_of):
    if folder_of not in _encoders:
        _encoders[folder_of] = encoder(folder_of)
    return _encoders[folder_of]


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: full ones, but for the first, which has what is over."""
    head = n_ids % capacity or capacity
    return [(0, head)] + [(start, capacity) for start in range(head, n_ids, capacity)]


def tokenised_pieces(docs: DataFrame, carry: list[str], capacity: int = CAPACITY, folder_of=None) -> DataFrame:
    """One row for each piece: ``carry``, piece, start, length, ids_crc32. Ids themselves stay in the Python worker."""
    named = docs.select(*carry, F.coalesce("text", F.lit("")).alias("_text"))
    kept = [named.schema[c] for c in carry]
    schema = T.StructType([*kept, T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encode(folder_of)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):       # a slice's texts as Python strings at a time
                batch = whole.slice(at, BATCH_ROWS)
                source, piece, starts, lengths, crcs = [], [], [], [], []
                for i, text in enumerate(batch.column("_text")):
                    ids = np.array([*encode(text.as_py()), 0], dtype="<u4")
                    for p, (start, length) in enumerate(cut(len(ids), capacity)):
                        source.append(i), piece.append(p), starts.append(start), lengths.append(length)
                        crcs.append(zlib.crc32(ids[start:start + length]))
                carried = batch.select(carry).take(pa.array(source, pa.int64())) if source else batch.select(carry)
                yield pa.RecordBatch.from_arrays(
                    [*carried.columns, pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (starts, lengths, crcs)]],
                    names=[f.name for f in schema])

    return named.mapInArrow(run, schema)


class BinPlan:
    """Bins for counts of item lengths. Equal bins are one entry, so the work and the plan depend on the capacity only.

    ``slots``: (length, lo, hi, base, per_bin, offset). Items lo to hi - 1 of a length go to the bins from ``base`` on, ``per_bin``
    in each, the first at ``offset``.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.bins, self.slots = capacity, dict(counts), 0, []
        self.done = dict.fromkeys(counts, 0)
        self.gaps: list[int] = []                                  # sorted gaps that some bins have
        self.open: dict[int, list[tuple[int, int]]] = {}           # gap: [(first bin, bins)]
        self._match_large()
        self._fit_small()

    def _fill(self, length: int, base: int, bins: int, per_bin: int, offset: int, items: int) -> None:
        lo = self.done[length]
        self.slots.append((length, lo, lo + items, base, per_bin, offset))
        self.done[length] += items
        self.left[length] -= items

    def _leave(self, gap: int, base: int, bins: int) -> None:
        if gap and bins:
            if gap not in self.open:
                insort(self.gaps, gap)
                self.open[gap] = []
            self.open[gap].append((base, bins))

    def _match_large(self) -> None:
        """Items above a third of the capacity share a bin with one more of their kind at most. The largest left is paired
        with the largest that fits beside it: no pairing has more pairs."""
        large = sorted(s for s in self.left if 3 * s > self.capacity)
        while large:
            a = large[-1]
            if not self.left[a]:
                large.pop()
                continue
            i = bisect_left(large, self.capacity - a + 1) - 1
            while i >= 0 and (not self.left[large[i]] or (large[i] == a and self.left[a] < 2)):
                i -= 1
            base = self.bins
            if i < 0:
                n = self.left[a]
                self._fill(a, base, n, 1, 0, n)
                self._leave(self.capacity - a, base, n)
            else:
                b = large[i]
                n = self.left[a] // 2 if a == b else min(self.left[a], self.left[b])
                self._fill(a, base, n, 1, 0, n)
                self._fill(b, base, n, 1, a, n)
                self._leave(self.capacity - a - b, base, n)
            self.bins += n

    def _fit_small(self) -> None:
        """The others, longest first, each into the smallest gap that holds it."""
        for s in sorted((s for s in self.left if 3 * s <= self.capacity), reverse=True):
            while self.left[s]:
                at = bisect_left(self.gaps, s)
                if at == len(self.gaps):
                    gap, base, bins = self.capacity, self.bins, -(-self.left[s] // (self.capacity // s))
                    self.bins += bins
                else:
                    gap = self.gaps[at]
                    base, bins = self.open[gap].pop()
                    if not self.open[gap]:
                        del self.open[gap], self.gaps[at]
                per_bin = gap // s
                full = min(bins, self.left[s] // per_bin)
                if full:
                    self._fill(s, base, full, per_bin, self.capacity - gap, full * per_bin)
                    self._leave(gap - per_bin * s, base, full)
                if full < bins and (rest := self.left[s]):
                    self._fill(s, base + full, 1, per_bin, self.capacity - gap, rest)
                    self._leave(gap - rest * s, base + full, 1)
                    full += 1
                self._leave(gap, base + full, bins - full)


def pack(docs: DataFrame, capacity: int = CAPACITY, carry: tuple[str, ...] = ("doc_id",), folder_of=None) -> DataFrame:
    """Place every document in a sequence of at most ``capacity`` tokens, in as few sequences as best fit finds.

    A document is its ids and one id 0; longer ones are cut. The driver gets the count of each piece length, at most
    ``capacity`` numbers, and plans bins for counts. Pieces are then numbered within their length and look up their place; a
    length that a third of all pieces have is numbered in slices. Null and empty texts are one token. Repeated rows are
    packed one by one, null ids as any. An empty table gives an empty result; other columns are ignored.

    Returns ``carry``, piece, start, length, ids_crc32, sequence_id (gapless from 0), offset (gapless from 0).
    """
    spark = docs.sparkSession
    pieces = tokenised_pieces(docs, list(carry), capacity, folder_of).withColumn("_row", F.monotonically_increasing_id())
    pieces = stage(pieces, "pack-pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = BinPlan(counts, capacity)
    slices = slices_for(sum(counts.values()))
    names = ("length", "_lo", "_hi", "_base", "_per_bin", "_offset")
    slots = spark.createDataFrame(plan.slots, ", ".join(f"{n} long" for n in names))
    numbered = running_total(pieces.withColumn("_slice", F.pmod(F.xxhash64("_row"), F.lit(slices))), ["length"], "_slice", [F.col("_row")],
                             F.lit(1).cast("long"), "_rank")
    at = F.col("_rank") - F.col("_lo")
    placed = numbered.join(F.broadcast(slots), "length").where("_rank >= _lo and _rank < _hi")   # bounded by the capacity
    return placed.select(*carry, "piece", "start", "length", "ids_crc32", (F.col("_base") + F.floor(at / F.col("_per_bin"))).alias("sequence_id"),
                         (F.col("_offset") + at % F.col("_per_bin") * F.col("length")).alias("offset"))


def token_sequences(docs: DataFrame, placed: DataFrame, capacity: int = CAPACITY, folder_of=None) -> DataFrame:
    """The sequences themselves: sequence_id, ids, doc_ids in their order. A sequence is one small group.

    ``placed`` is what ``pack`` returned for ``docs``; doc_id has to be unique here.
    """
    wanted = placed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("places"))
    schema = "sequence_id long, offset long, doc_id long, ids array<int>"

    def run(batches):
        encode = _encode(folder_of)
        for batch in batches:
            for row in batch.to_pylist():
                ids = [*encode(row["text"] or ""), 0]
                out = [(p["sequence_id"], p["offset"], row["doc_id"], ids[p["start"]:p["start"] + p["length"]]) for p in row["places"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    map(list, zip(*out)), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=["sequence_id", "offset", "doc_id", "ids"])

    parts = docs.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(run, schema)
    ordered = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return parts.groupBy("sequence_id").agg(ordered.alias("p")).select(
        "sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
