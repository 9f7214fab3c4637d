"""Token counts by a unigram model over a trie of the distinct words."""
from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_START = "▁"       # fixed value: the vocabulary's mark of a word's beginning
MODEL = "piece_bpe_32k.model"
KNOWN_WORDS = 200_000       # words whose counts a task remembers; forgetting them costs time only


class Unigram:
    """Pieces with log scores. The score of a piece is Zipf's law at its place in the vocabulary: -log(place + 1).

    A character outside the vocabulary is written as its UTF-8 bytes, one token each, at the score of the last place.
    """

    def __init__(self, pieces: list[str]):
        self.score = {p: -math.log(i + 1) for i, p in enumerate(pieces) if p}
        self.longest = max(map(len, self.score), default=1)
        self.unknown = -math.log(len(pieces) + 1)

    @classmethod
    def load(cls, path: str) -> Unigram:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        return cls([model.id_to_piece(i) for i in usable])


class TrieCounter:
    """Token counts of words. New words of a batch are walked in sorted order, which is the depth-first order of their trie:
    the forward scores of the path to the present node are kept on a stack, those of a shared prefix are computed once, and the
    count at a word's end is stored. The stack is as deep as the longest word; equal scores prefer the longer last piece."""

    def __init__(self, model: Unigram, known: int = KNOWN_WORDS):
        self.model, self.known, self.counts = model, known, {}
        self.nodes = 0          # forward scores computed so far

    def learn(self, words: set[str]) -> None:
        if len(self.counts) > self.known:
            self.counts.clear()
        score, longest, unknown = self.model.score.get, self.model.longest, self.model.unknown
        path, best, tokens = "", [0.0], [0]
        for word in sorted(w for w in words if w not in self.counts):
            marked = WORD_START + word
            depth, most = 0, min(len(path), len(marked))
            while depth < most and path[depth] == marked[depth]:
                depth += 1
            del best[depth + 1:], tokens[depth + 1:]
            self.nodes += len(marked) - depth
            for end in range(depth + 1, len(marked) + 1):
                size = len(marked[end - 1].encode("utf-8", "surrogatepass"))
                top, count = best[end - 1] + unknown * size, tokens[end - 1] + size
                for start in range(end - 1, max(0, end - longest) - 1, -1):
                    s = score(marked[start:end])
                    if s is not None and best[start] + s >= top:
                        top, count = best[start] + s, tokens[start] + 1
                best.append(top), tokens.append(count)
            path = marked
            self.counts[word] = tokens[-1]


def token_counts(docs: DataFrame, model_path: str | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Number of words and of unigram tokens of every whole text; nothing is shuffled.

    Words are runs outside ASCII white space. Null, empty and blank texts have 0 of both. A batch's texts are handled together,
    so words are looked up once; very long words take memory in proportion to their length. Repeated rows are counted each;
    other columns are ignored. ``model_path``: a vocabulary file on every executor, that of public_tokenizers by default.
    """
    named = docs.select(*carry, F.col("text").alias("_text"))
    schema = T.StructType([*[named.schema[c] for c in carry], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        counter = TrieCounter(Unigram.load(model_path or public_tokenizers.path(MODEL)))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [[w.decode("utf-8", "surrogatepass") for w in (t.as_py() or "").encode("utf-8", "surrogatepass").split()]
                         for t in batch.column("_text")]
                counter.learn(set().union(*texts))
                count = counter.counts.__getitem__
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in carry], pa.array(map(len, texts), pa.int64()), pa.array([sum(map(count, t)) for t in texts], pa.int64())],
                    names=[f.name for f in schema])

    return named.mapInArrow(run, schema)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
