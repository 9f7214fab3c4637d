"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet and read again before
the next one starts. All but the last return the columns of ``documents``. Rows are told apart by a number that is written
with them first, so repeated and null ids are decided one by one.
"""
from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendweave.llm import exact_dedup, minhash, mixing, packing, quality_classifier, simhash
from spendweave.llm.common import paths_since, release_all_but, release_paths, stage, stages_written, words


_inner: dict[str, list[str]] = {}     # stage files made inside the pipeline's stages, by application


def _tidy(step):
    """Before a stage starts, the files that earlier stages made inside are deleted, but for those that ``docs`` still reads.

    A stage's result is written before the next one starts, so nothing else needs them.
    """
    @functools.wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        made = _inner.setdefault(spark.sparkContext.applicationId, [])
        read = docs.inputFiles() if made else ()
        idle = [p for p in made if not any(p.rsplit("/", 1)[-1] in f for f in read)]
        release_paths(spark, idle)
        since = stages_written(spark)
        out = step(spark, docs, sf_dir)
        made[:] = [p for p in made if p not in idle] + paths_since(spark, since)
        return out
    return run_step


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    row = "_row_of_stage"
    while row in docs.columns:
        row += "_"
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), name), row


@_tidy
def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores below one half go. Without labels nothing is rejected."""
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.with_score(docs, model, "_score_of_stage")
    return scored.where("_score_of_stage >= 0.5").select(*docs.columns)


@_tidy
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space apart) the row with the smallest id stays."""
    rows, row = _numbered(docs, "stage-exact")
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex[:12]}")
    decided = exact_dedup.deduplicate(rows, index, carry=("doc_id", row))
    index.drop()
    return rows.join(decided.where("not kept").select(row), row, "left_anti").select(*docs.columns)


@_tidy
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links connect, the one with the smallest id stays (null ids last). A link is a similarity (Jaccard) of
    five-word shingles of 0.8 or more, checked on the whole texts. Candidates come from SimHash fingerprints that meet by Golay
    keys and, since pairs near 0.8 differ in more bits than these allow for, from bands of MinHash values."""
    rows, row = _numbered(docs, "stage-near")
    met = simhash.candidate_pairs(rows, row, minhash.SHINGLE)
    found = minhash.near_copies(rows, row, candidates=met)
    found = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    classes = stage(rows.select("doc_id", row).join(found, F.col(row) == F.col("node")).select("doc_id", row, "root"), "stage-classes")
    place = F.struct(F.when(F.col("doc_id").isNull(), 1).otherwise(0), F.col("doc_id"), F.col(row))
    first = stage(classes.groupBy("root").agg(F.min_by(row, place).alias("_stays")), "stage-firsts")
    gone = classes.join(first, "root").where(F.col(row) != F.col("_stays")).select(row)
    return rows.join(gone, row, "left_anti").select(*docs.columns)


@_tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each reading of their source. Where a source's target ends inside a document,
    that reading has the document's first words only, joined by spaces (one document of a source at most). Documents of
    which no word is taken aren't part of the mix. Rows are written in the order of the schedule's slots, which interleaves the sources."""
    rows, row = _numbered(docs, "stage-mix")
    taken = mixing.mix(rows, carry=("doc_id", row)).where("taken > 0").select(
        row, F.col("size").alias("_size_of_stage"), F.arrays_zip(F.col("taken_passes").alias("_taken"), F.col("slots").alias("_slot")).alias("_readings"))
    copies = rows.join(taken, row).select("*", F.inline("_readings")).where("_taken > 0")
    copies = copies.repartitionByRange(F.col("_slot"), F.col(row)).sortWithinPartitions("_slot", row)
    cut = F.col("_taken") < F.col("_size_of_stage")
    head = F.array_join(F.slice(words(F.col("text")), 1, F.col("_taken").cast("int")), " ")
    out = copies.withColumn("text", F.when(cut, head).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@_tidy
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 2,048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mix sources", mix_sources),
    ("pack sequences", pack_sequences),
]

#: Training, tokenising and 64-bit hashing can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = stages_written(spark)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        release_all_but(spark, start)
    return docs
