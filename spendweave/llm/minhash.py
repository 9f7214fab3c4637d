"""Near copies by Jaccard similarity: candidates by bands of MinHash values, each checked on the whole sets of shingles."""
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

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6          # a pair at similarity 0.8 shares a band with probability 1 - (1 - 0.8^6)^24 = 0.9993
SINGLES = 48                 # values that are keys by themselves, of use where few rows have them
FEW = 4                      # rows of a single value's bucket that make a candidate pair
CHUNK = 1 << 11              # shingles hashed at a time by all functions


def _functions() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
    return draw[0], draw[1] | np.uint64(1)


MASKS, FACTORS = _functions()


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 of the runs of ``shingle`` words, sorted; a shorter text is one run. Words as in ``simhash.fingerprint``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = list(accumulate(len(w) + 1 for w in words))
    spans = zip([0, *ends[:n - 1]], ends[shingle - 1:]) if len(words) >= shingle else [(0, len(joined) + 1)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b - 1], 42) for a, b in spans], np.uint64))


def least_values(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values: for each function the least of the hashed shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        least = np.minimum(least, ((hashes[at:at + CHUNK, None] ^ MASKS) * FACTORS).min(axis=0))
    return least


def _keys(least: np.ndarray, rows: int, first: int) -> list[int]:
    """A signed 64-bit key for each run of ``rows`` values."""
    keys = [xxhash.xxh64_intdigest(band.tobytes(), first + i) for i, band in enumerate(least.reshape(-1, rows))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def band_keys(hashes: np.ndarray) -> list[int]:
    return _keys(least_values(hashes), ROWS, 0)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def near_copies(rows: DataFrame, row: str, shingle: int = SHINGLE, at_least: float = SIMILARITY,
                candidates: DataFrame | None = None) -> DataFrame:
    """(node, root) for the rows, by number ``row``, that links of at least this similarity connect, roots themselves left out. Texts without words don't link.

    In each band's bucket every row is compared with the smallest row and with the longest one, so a bucket of any size costs two
    pairs a row. Rows alike to each other but to neither of these, as copies within a large family that shares a template, meet by
    single values: a value that two to four rows have comes from a shingle that only they share. Pairs are checked on the whole texts,
    which are joined for candidates only. ``candidates`` are pairs (a, b) of row numbers from elsewhere that are checked too.

    ``rows`` needs different numbers in ``row``. Null, empty and blank texts have no shingles and no link; repeated rows are linked as
    any equal texts; an empty table gives an empty result; other columns are ignored.
    """
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, sizes, keys, singles = [], [], [], []
            for number, text in zip(batch.column(0), batch.column(1)):
                hashes = shingle_hashes(text.as_py(), shingle)
                if len(hashes):
                    least = least_values(hashes)
                    numbers.append(number.as_py()), sizes.append(len(hashes)), keys.append(_keys(least, ROWS, 0))
                    singles.append(_keys(least[::len(least) // SINGLES], 1, BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                                              pa.array(singles, pa.list_(pa.int64()))], names=["row", "n", "keys", "singles"])

    texts = rows.select(F.col(row).alias("row"), F.col("text").alias("_text"))
    signed = stage(texts.mapInArrow(signatures, "row long, n long, keys array<long>, singles array<long>"), "minhash-rows")
    banded = signed.select("row", "n", F.explode("keys").alias("key"))
    heads = (banded.groupBy("key").agg(F.count("*").alias("_c"), F.min("row").alias("first"), F.max(F.struct("n", "row"))["row"].alias("longest"))
             .where("_c > 1").select("key", F.array("first", "longest").alias("heads")))
    heads = stage(heads, "minhash-heads")
    met = banded.join(heads.hint("merge"), "key").select("row", F.explode("heads").alias("head")).where("row <> head")
    rare = (signed.select("row", F.explode("singles").alias("key")).groupBy("key")
            .agg(F.count("*").alias("_c"), F.min("row").alias("a"), F.max("row").alias("b")).where(F.col("_c").between(2, FEW)).select("a", "b"))
    met = met.select(F.least("row", "head").alias("a"), F.greatest("row", "head").alias("b")).unionByName(rare)
    met = met.unionByName(candidates) if candidates is not None else met
    pairs = stage(met.distinct(), "minhash-pairs")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            last, known = None, None
            for i, j, s, t in zip(*(batch.column(c).to_pylist() for c in range(2)), batch.column(2), batch.column(3)):
                if i != last:
                    last, known = i, shingle_hashes(s.as_py(), shingle)
                if similarity(known, shingle_hashes(t.as_py(), shingle)) >= at_least:
                    a.append(i), b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    side = lambda of, text: texts.select(F.col("row").alias(of), F.col("_text").alias(text))
    with_texts = pairs.join(side("b", "_t").hint("merge"), "b").join(side("a", "_s").hint("merge"), "a").select("a", "b", "_s", "_t")
    return components(stage(with_texts.mapInArrow(verified, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])), "minhash-links"))
