"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 14
FACTORS = 6
TRAIN_ROWS = 10_000     # bound of the labelled sample that the model is fitted on
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.08, 2e-5
LEAST_STEPS = 600       # mini-batches; a small sample is read more often
UPPER, DIGITS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>"
STATISTICS = ("log_words", "log_chars", "chars_per_word", "distinct_share", "top_word_share", "upper_share", "digit_share", "symbol_share",
              "exclamations", "bars", "stops", "commas", "lines_per_word", "repeated_lines", "wide_share", "longest_word", "stated_chars")


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Buckets and weights of the words (logarithm of counts, unit length), and the statistics, of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    counts = Counter(words)
    n, size = max(1, len(words)), max(1, len(raw))
    buckets = np.fromiter(map(crc32, counts), np.int64, len(counts)) & (BUCKETS - 1)
    buckets, inverse = np.unique(buckets, return_inverse=True)
    weights = np.log1p(np.bincount(inverse, np.fromiter(counts.values(), np.float64, len(counts)), len(buckets))) if len(words) else np.zeros(0)
    weights /= max(1e-9, float(np.sqrt((weights ** 2).sum())))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    statistics = [np.log1p(len(words)), np.log1p(len(raw)), sum(map(len, words)) / n, len(counts) / n, max(counts.values(), default=0) / n, share(UPPER),
                  share(DIGITS), share(SYMBOLS), raw.count(b"!") / n, raw.count(b"|") / n, raw.count(b".") / n, raw.count(b",") / n, len(lines) / n,
                  (len(lines) - len(set(lines))) / max(1, len(lines)), sum(1 for w in counts if not w.isascii()) / n, np.log1p(max(map(len, counts), default=0)),
                  np.log1p(max(0, n_chars or 0))]
    return buckets, weights, [float(s) for s in statistics]


@dataclass
class FactorisationMachine:
    """score = bias + sum w x + 1/2 sum over factors of ((sum v x)^2 - sum v^2 x^2): all pairwise interactions, in time linear in
    the entries of x. Statistics come after the buckets and are standardised and clipped."""
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def rows(self, found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, value) of texts' features."""
        statistics = np.clip((np.array([f[2] for f in found]) - self.mean) / self.spread, -4, 4) / np.sqrt(len(STATISTICS))
        places = np.arange(len(STATISTICS)) + BUCKETS
        row = np.repeat(np.arange(len(found)), [len(f[0]) + len(places) for f in found])
        column = np.concatenate([np.concatenate([f[0], places]) for f in found])
        value = np.concatenate([np.concatenate([f[1], s]) for f, s in zip(found, statistics)])
        return row, column, value

    def margin(self, row, column, value, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.v[column] * value[:, None]
        sums = np.stack([np.bincount(row, vx[:, f], n) for f in range(vx.shape[1])], axis=1)
        squares = np.bincount(row, (vx ** 2).sum(axis=1), n)
        return self.bias + np.bincount(row, self.w[column] * value, n) + 0.5 * ((sums ** 2).sum(axis=1) - squares), sums, vx

    def score(self, found: list[tuple]) -> np.ndarray:
        if not found:
            return np.zeros(0)
        margin, _, _ = self.margin(*self.rows(found), len(found))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    @classmethod
    def fit(cls, found: list[tuple], labels: np.ndarray, seed: int = 7) -> FactorisationMachine:
        """Logistic loss, AdaGrad on mini-batches in a fixed order of draws. Without labels of both kinds every score is the share
        of label 1 (one half without any)."""
        rng, width = np.random.default_rng(seed), BUCKETS + len(STATISTICS)
        share = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.5
        model = cls(float(np.log(share / (1 - share))), np.zeros(width), np.zeros((width, FACTORS)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
        if len(set(labels.tolist())) < 2:
            model.bias = 0.0 if not len(labels) else model.bias
            return model
        table = np.array([f[2] for f in found])
        model.mean, model.spread = table.mean(axis=0), table.std(axis=0) + 1e-6
        model.v = rng.normal(0, 0.05, (width, FACTORS))
        seen_w, seen_v, seen_b = np.full(width, 1e-3), np.full((width, FACTORS), 1e-3), 1e-3
        for _ in range(max(EPOCHS, -(-LEAST_STEPS // -(-len(found) // BATCH)))):
            order = rng.permutation(len(found))
            for at in range(0, len(order), BATCH):
                chosen = order[at:at + BATCH]
                row, column, value = model.rows([found[i] for i in chosen])
                margin, sums, vx = model.margin(row, column, value, len(chosen))
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]) / len(chosen)
                used, place = np.unique(column, return_inverse=True)
                pull = error[row] * value
                gw = np.bincount(place, pull, len(used)) + DECAY * model.w[used]
                gv = np.stack([np.bincount(place, pull * (sums[row, f] - vx[:, f]), len(used)) for f in range(FACTORS)], axis=1) + DECAY * model.v[used]
                seen_w[used] += gw ** 2
                seen_v[used] += gv ** 2
                seen_b += float(error.sum()) ** 2
                model.w[used] -= RATE * gw / np.sqrt(seen_w[used])
                model.v[used] -= RATE * gv / np.sqrt(seen_v[used])
                model.bias -= RATE * float(error.sum()) / seen_b ** 0.5
        return model


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _stated(docs: DataFrame):
    return F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> FactorisationMachine:
    """Fit on labelled documents that aren't held out: all of them, or ``train_rows`` in the order of a digest of the id.

    Features are made by the executors; the driver gets those of ``train_rows`` documents at most, not their texts. Labels without
    id or quality are left out; a document labelled twice counts once, with its lower label.
    """
    chosen = (labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
              .groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("int").alias("quality")).orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(train_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                found = [features(t.as_py(), n.as_py()) for t, n in zip(batch.column("text"), batch.column("stated"))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), batch.column("quality"), *[pa.array([f[i] for f in found], t) for i, t in
                                                                   enumerate((pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.float64())))]],
                    names=["_id", "quality", "buckets", "weights", "statistics"])

    texts = docs.select(F.col("doc_id"), F.col("text"), _stated(docs).alias("stated"))
    joined = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_id", "quality", "text", "stated")   # train_rows ids at most
    id_type = docs.schema["doc_id"].dataType.simpleString()
    made = joined.mapInArrow(run, f"_id {id_type}, quality int, buckets array<int>, weights array<float>, statistics array<double>")
    table = made.dropDuplicates(["_id"]).toArrow().sort_by("_id")
    lists = [[x.values.to_numpy() for x in table[c]] for c in ("buckets", "weights", "statistics")]
    found = [(b.astype(np.int64), w.astype(np.float64), list(s)) for b, w, s in zip(*lists)]
    return FactorisationMachine.fit(found, np.array(table["quality"].to_pylist(), np.float64))


def with_score(docs: DataFrame, model: FactorisationMachine, column: str = "score") -> DataFrame:
    """``docs`` and a score for each row from its whole text; nothing is shuffled. Null text counts as empty."""
    kept = [c for c in docs.columns if c != column]
    held = [f"_c{i}" for i in range(len(kept))]
    named = docs.select(*[F.col(c).alias(h) for c, h in zip(kept, held)], F.col("text").alias("_text"), _stated(docs).alias("_stated"))
    schema = T.StructType([*named.schema.fields[:len(kept)], T.StructField("_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 128):
                batch = whole.slice(first, 128)
                found = [features(t.as_py(), n.as_py()) for t, n in zip(batch.column("_text"), batch.column("_stated"))]
                yield pa.RecordBatch.from_arrays([*[batch.column(h) for h in held], pa.array(model.score(found))], names=[*held, "_score"])

    return named.mapInArrow(run, schema).toDF(*kept, column)


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, held_out, score, predicted. Language, source, labels and id are no inputs; the id only deals the folds. Repeated rows
    are scored each, a null id isn't held out, an empty table gives an empty result, other columns are ignored."""
    model = train(docs, labels, train_rows)
    wanted = list(dict.fromkeys([*carry, "doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else [])]))
    out = list(dict.fromkeys([*carry, "doc_id"]))
    named = docs.select(*wanted)
    scored = with_score(named.select(*out, "text", _stated(named).alias("n_chars")), model)
    return scored.select(*out, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels).select("doc_id", "held_out", "score", "predicted")
