"""Substring dedup by hashing lines and the sentences in them: the earliest of equal passages stays, the others are cut out."""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage

RUN_WORDS = 30       # words of neighbouring repeated units that make a passage; fewer repeat by chance and are left alone
SCRIPT_CHARS = 12    # in scripts without spaces, so many characters count as a word
# A line, or a sentence within a line. Every character of a text is in one match.
UNIT = "[^\\n.!?。！？]*[.!?。！？]+|[^\\n.!?。！？]+|\\n"


def units(docs: DataFrame, carry: list[str]) -> DataFrame:
    """A row for each line or sentence with a word: ``carry``, unit (from 0), start and length (code points of the text), words, digest.
    Normalised: A-Z in lower case, words (runs outside ASCII white space) joined by one space. Ends of a line that a passage shares
    with other text are units of their own."""
    named = docs.select(*carry, F.col("text").alias("_text"))
    schema = T.StructType([*[named.schema[c] for c in carry], T.StructField("unit", T.IntegerType()), T.StructField("start", T.IntegerType()),
                           T.StructField("length", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("digest", T.BinaryType())])
    find, blank = re.compile(UNIT).finditer, " \t\n\x0b\x0c\r"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                source, numbers, starts, lengths, sizes, digests = [], [], [], [], [], []
                for i, text in enumerate(batch.column("_text")):
                    number = 0
                    for match in find(text.as_py() or ""):
                        part = match.group().strip(blank)
                        if part:
                            words = part.encode("utf-8", "surrogatepass").lower().split()
                            at = match.start() + len(match.group()) - len(match.group().lstrip(blank))
                            source.append(i), numbers.append(number), starts.append(at), lengths.append(len(part))
                            sizes.append(max(len(words), len(part) // SCRIPT_CHARS))
                            digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                            number += 1
                carried = batch.select(carry).take(pa.array(source, pa.int64()))
                yield pa.RecordBatch.from_arrays([*carried.columns, *[pa.array(c, pa.int32()) for c in (numbers, starts, lengths, sizes)],
                                                  pa.array(digests, pa.binary())], names=[f.name for f in schema])

    return named.mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, run_words: int = RUN_WORDS, carry: tuple[str, ...] = ("doc_id",), row: str | None = None) -> DataFrame:
    """The passages to cut: ``carry``, unit (their first), start, length (in code points of the text), units, words, and where the unit
    that stays for their first one is: keep_doc_id, keep_unit, keep_start.

    A unit is repeated when an equal one comes earlier in the order of (doc_id, place of the row, unit); null ids come last. Neighbouring
    repeated units of a document with ``run_words`` words or more together are a passage: a single sentence that recurs by chance
    stays. Null, empty and blank texts have no units; a repeated row loses its passages in all rows but one. An empty table gives an empty
    result; other columns are ignored. ``row`` names a column that tells rows apart, if there is one.

    Firsts are pre-aggregated in each task, only digests seen twice are joined with their units, and the rows of a unit that a
    third of all documents have are split between tasks in the join. Runs are found within documents.
    """
    wanted = list(dict.fromkeys([*carry, "doc_id"]))
    number = F.col(row) if row else F.monotonically_increasing_id()
    numbered = docs.select(*wanted, "text", number.alias("_row"))
    found = stage(units(numbered, [*wanted, "_row"]), "line-units")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row", "unit", "start")
    firsts = (found.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
              .select("digest", F.col("first.doc_id").alias("keep_doc_id"), F.col("first._row").alias("_keep_row"),
                      F.col("first.unit").alias("keep_unit"), F.col("first.start").alias("keep_start")))
    firsts = stage(firsts, "line-firsts")
    repeated = found.join(firsts.hint("merge"), "digest").where("not (_row = _keep_row and unit = keep_unit)").drop("digest")
    in_order = W.partitionBy("_row").orderBy("unit")
    runs = repeated.withColumn("_run", F.col("unit") - F.row_number().over(in_order)).groupBy("_row", "_run").agg(
        *[F.first(c).alias(c) for c in wanted if c != "_row"], F.min("unit").alias("unit"), F.min("start").cast("long").alias("start"),
        (F.max(F.col("start") + F.col("length")) - F.min("start")).cast("long").alias("length"), F.count("*").alias("units"),
        F.sum("words").alias("words"), F.min_by(F.struct("keep_doc_id", "keep_unit", "keep_start"), "unit").alias("keep"))
    return runs.where(F.col("words") >= run_words).select(
        *wanted, *(["_row"] if row else []), "unit", "start", "length", "units", "words", F.col("keep.keep_doc_id").alias("keep_doc_id"),
        F.col("keep.keep_unit").alias("keep_unit"), F.col("keep.keep_start").cast("long").alias("keep_start"))


def cut_texts(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` without their repeated passages, and ``removed``: their spans in original offsets with the document that keeps them.

    Rows are numbered first and cut by that number, so rows of equal or null ids are told apart. Texts without cuts are passed on
    untouched (removed is null); a text of which nothing is left is empty.
    """
    row = "_row_to_cut"
    while row in docs.columns:
        row += "_"
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "cut-rows")
    cuts = repeated_passages(rows, run_words, row=row).select(F.col("_row").alias("_cut_row"), F.struct("start", "length", "keep_doc_id").alias("_span"))
    spans = cuts.groupBy("_cut_row").agg(F.sort_array(F.collect_list("_span")).alias("_spans"))
    joined = rows.join(spans, F.col(row) == F.col("_cut_row"), "left").drop("_cut_row")
    text = F.col("text")
    state = F.aggregate(
        "_spans", F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.struct(F.concat(s["kept"], text.substr((s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))).alias("kept"),
                              (x["start"] + x["length"]).alias("at")),
        lambda s: F.concat(s["kept"], text.substr((s["at"] + 1).cast("int"), F.char_length(text))))
    return joined.withColumn("text", F.when(F.col("_spans").isNull(), text).otherwise(state)).withColumn("removed", F.col("_spans")).drop("_spans", row)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\n.!?。！？]*[.!?。！？]+|[^\n.!?。！？]+|\n') AS parts FROM documents),
e AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM p),
o AS (SELECT doc_id, i, part, coalesce(sum(len(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM e),
u AS (SELECT doc_id, i, place + len(part) - len(regexp_replace(part, '^[\x20\x09-\x0D]+', '')) AS start, regexp_replace(part, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body FROM o),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS unit, start, len(body) AS length,
        greatest(len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')), len(body) // 12) AS words,
        regexp_replace(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM u WHERE body <> ''),
f AS (SELECT *, first(doc_id) OVER w AS keep_doc_id, first(unit) OVER w AS keep_unit, first(start) OVER w AS keep_start FROM n
      WINDOW w AS (PARTITION BY norm ORDER BY doc_id, unit)),
r AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM f WHERE NOT (doc_id = keep_doc_id AND unit = keep_unit))
SELECT doc_id, min(unit)::INT AS unit, min(start)::BIGINT AS start, (max(start + length) - min(start))::BIGINT AS length, count(*)::BIGINT AS units, sum(words)::BIGINT AS words,
       arg_min(keep_doc_id, unit) AS keep_doc_id, arg_min(keep_unit, unit)::INT AS keep_unit, arg_min(keep_start, unit)::BIGINT AS keep_start
FROM r GROUP BY doc_id, run HAVING sum(words) >= 30
"""
