"""Byte-pair encoding and decoding with forced-boundary splitting.

Two neighbouring bytes that stand side by side inside no token of the vocabulary can't end up in one token, so the place between
them is a certain cut: no merge crosses it, and the parts on both sides are encoded as if they stood alone. Words are cut there and
their fragments, which recur far more often than words, are merged once.
"""
from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "word_bpe_49k.json"
BATCH_ROWS = 128          # texts that are Python objects at a time
REMEMBERED = 400_000      # words, and fragments, whose ids a Python worker keeps; then it starts anew
SHORT = 40                # symbols up to which the best pair is looked up in a list, above in a heap
PLAIN = "Ͱ"          # characters below are lower-cased and composed alike by every version of Unicode
# Outside of these blocks the libraries' versions of Unicode don't agree on all letters; texts with such characters are split by
# the library that defines the ids.
SETTLED = regex.compile(r"[^\x00-\u0557\u2000-\u206F\u2190-\u27BF\u3000-\u9FFF\uAC00-\uD7A3\U0001F300-\U0001F64F]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes stand for themselves, the others for U+0100 and on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256))
    return [chr(b) if b in printable else chr(256 + next(others)) for b in range(256)]


class Codec:
    """The vocabulary of a ``tokenizers`` file with word ends: text to ids and back. Built once per Python worker."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.end, vocabulary = model["end_of_word_suffix"], model["vocab"]
        self.normalise = Tokenizer.from_file(path).normalizer.normalize_str
        pattern = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.settled_words, self.split = regex.compile(pattern).findall, Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        letters = byte_letters()
        self.inner = [vocabulary.get(c) for c in letters]                 # ids of single bytes, inside and at the end of a word
        self.last = [vocabulary.get(c + self.end) for c in letters]
        self.merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b])
                       for rank, (a, b) in enumerate(p if isinstance(p, list) else p.split(" ") for p in model["merges"])}
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")").split if self.added else None
        self.tokens = {i: t for t, i in (vocabulary | self.added).items()}
        self.joined = self._joined(vocabulary, {c: b for b, c in enumerate(letters)})
        self.of_word: dict[str, list[int]] = {}
        self.of_fragment: dict[tuple[bytes, bool], list[int]] = {}

    def _joined(self, vocabulary: dict[str, int], byte_of: dict[str, int]) -> np.ndarray:
        """joined[a * 256 + b]: bytes a and b are neighbours inside some token."""
        joined = np.zeros(65536, bool)
        for token in vocabulary:
            body = token[:-len(self.end)] if token.endswith(self.end) and token != self.end else token
            at = [byte_of[c] for c in body]
            for a, b in zip(at, at[1:]):
                joined[a * 256 + b] = True
        return joined

    def cuts(self, word: bytes) -> list[int]:
        """Places in a word at which no token can reach across."""
        if len(word) < SHORT:
            joined = self.joined
            return [i for i in range(1, len(word)) if not joined[word[i - 1] * 256 + word[i]]]
        at = np.frombuffer(word, np.uint8).astype(np.int64)
        return (np.flatnonzero(~self.joined[at[:-1] * 256 + at[1:]]) + 1).tolist()

    def _merged(self, ids: list[int]) -> list[int]:
        """Merge the pair of the lowest rank, the first of equal ones, until none is left."""
        merges = self.merges
        if len(ids) > SHORT:
            return self._merged_by_heap(ids)
        none = (1 << 60, 0)
        pairs = [merges.get(p, none) for p in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) is not none:
            i = pairs.index(best)
            ids[i:i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = merges.get((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = merges.get((ids[i], ids[i + 1]), none)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        merges, n = self.merges, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*merges[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heap = [(rank, i, new) for rank, new, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or merges.get((ids[i], ids[j]), (0, -1))[1] != new:
                continue                        # one of the two went into another token meanwhile
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (found := merges.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (found[0], left, found[1]))
        return [x for x in ids if x >= 0]

    def fragment_ids(self, fragment: bytes, ends_word: bool) -> list[int]:
        known = self.of_fragment.get((fragment, ends_word))
        if known is None:
            ids = [self.inner[b] for b in fragment]
            if ends_word:
                ids[-1] = self.last[fragment[-1]]
            known = self._merged([i for i in ids if i is not None])
            if len(fragment) <= SHORT:
                if len(self.of_fragment) >= REMEMBERED:
                    self.of_fragment.clear()
                self.of_fragment[fragment, ends_word] = known
        return known

    def word_ids(self, word: str) -> list[int]:
        body = word.encode("utf-8")
        places = [0, *self.cuts(body), len(body)]
        if len(places) == 2:
            ids = self.fragment_ids(body, True)
        else:
            ids = [i for a, b in zip(places, places[1:]) for i in self.fragment_ids(body[a:b], b == len(body))]
        if len(word) <= SHORT:
            if len(self.of_word) >= REMEMBERED:
                self.of_word.clear()
            self.of_word[word] = ids
        return ids

    def words(self, text: str) -> list[str]:
        return [w for w, _ in self.split(text)] if SETTLED.search(text) else self.settled_words(text)

    def _plain_ids(self, text: str, out: list[int]) -> None:
        plain, known = max(text) < PLAIN, self.of_word.get
        text = unicodedata.normalize("NFC", text).lower() if plain else self.normalise(text)
        for word in self.settled_words(text) if plain else self.words(text):
            out += known(word) or self.word_ids(word)

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, without special tokens at its ends; the strings of added tokens in it are those tokens."""
        out: list[int] = []
        for i, part in enumerate(self.split_added(text) if self.split_added else [text]):
            if i % 2:
                out.append(self.added[part])
            elif part:
                self._plain_ids(part, out)
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens as they stand in the vocabulary, joined by spaces: the file names no decoder. Unknown ids are left out."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


_codecs: dict[str, Codec] = {}


def codec(folder_of=None, name: str = VOCABULARY) -> Codec:
    import public_tokenizers

    path = (folder_of or public_tokenizers.path)(name)
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


# What encode() can return, beside the carried columns and n_tokens.
_RESULTS = {
    "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), lambda made, ids: ids),
    "decoded": (T.StringType(), pa.string(), lambda made, ids: made.decode(ids)),
    "ids_sha256": (T.StringType(), pa.string(), lambda made, ids: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()),
    "decoded_sha256": (T.StringType(), pa.string(), lambda made, ids: hashlib.sha256(made.decode(ids).encode("utf-8")).hexdigest()),
}


def encode(docs: DataFrame, results: tuple[str, ...] = ("ids", "decoded"), carry: tuple[str, ...] = ("doc_id",), folder_of=None) -> DataFrame:
    """Encode every whole text and decode it again: ``carry``, n_tokens and the wanted ``results``: ids (array), decoded (text),
    ids_sha256, decoded_sha256 (of the ids as little-endian unsigned 32-bit integers, of the decoded text in UTF-8).

    Null and empty texts have no ids and decode to an empty text. Every row is encoded by itself, so repeated rows, ties and null ids
    need no rule; other columns are ignored, an empty table gives an empty result. No shuffle: a text of any length stays in its task,
    words and fragments that a worker remembers are bounded. ``folder_of`` maps the vocabulary's name to its path.
    """
    named = docs.select(*carry, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    schema = T.StructType([*[named.schema[c] for c in carry], T.StructField("n_tokens", T.LongType()),
                           *[T.StructField(r, _RESULTS[r][0]) for r in results]])
    makers = [_RESULTS[r][1:] for r in results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(folder_of)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                counts, columns = [], [[] for _ in makers]
                for text in batch.column("_text"):
                    ids = made.encode(text.as_py())
                    counts.append(len(ids))
                    for column, (_, value) in zip(columns, makers):
                        column.append(value(made, ids))
                yield pa.RecordBatch.from_arrays(
                    [*batch.select(list(carry)).columns, pa.array(counts, pa.int64()), *[pa.array(c, kind) for c, (kind, _) in zip(columns, makers)]],
                    names=[f.name for f in schema])

    return named.mapInArrow(run, schema)


def op12_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ("ids_sha256", "decoded_sha256"))
