"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds
(multiplies) its letters' vectors, each permuted by its place; a text's vector
bundles (adds) its trigrams' vectors, and a language's prototype bundles its
training texts. A text gets the language of the closest prototype by cosine.

Null text, or text without a letter: ``und`` with score 0. Null or empty
language: the row takes no part in training. Equal cosines: the language that sorts first. Empty
tables give empty results, and without any training row everything is ``und``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievespark.llm.common import append_columns, bound_batches, slices

DIMENSIONS = 1024
#: Trigram vectors kept by a worker (4 bytes a dimension: 64 MB at 1,024 dimensions).
CACHED = 16_384
#: Prototypes are broadcast; more languages than this is an error, not a plan.
MOST_LANGUAGES = 2_000

_letter = np.zeros(0x110000, bool)
_known = np.zeros(0x110000, bool)
_lower_done: set[int] = set()


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    if not _known[codes].all():
        for c in np.unique(codes[~_known[codes]]):
            _letter[c] = chr(int(c)).isalpha()
            _known[c] = True
    return _letter[codes]


def trigrams(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of the lower-cased letters, other runs as one space, and their counts."""
    none = np.empty(0, np.int64)
    if not data:
        return none, none
    codes = np.frombuffer(data.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letters = _letters(codes)
    if not letters.any():
        return none, none
    codes = np.where(letters, codes, 32)
    codes = np.concatenate(([32], codes, [32]))
    space = codes == 32
    codes = codes[~(space & np.concatenate(([False], space[:-1])))]
    keys = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    return np.unique(keys, return_counts=True)


class Vectors:
    """Trigram vectors, made when they are first met."""

    def __init__(self, dimensions: int, seed: int) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((256, dimensions), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 65_536:
                self.letters.clear()
            self.letters[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return self.letters[code]

    def make(self, key: int) -> np.ndarray:
        a, b, c = (self.letter((key >> s) & 0x1FFFFF) for s in (42, 21, 0))
        return np.roll(a, 2) * np.roll(b, 1) * c

    def of(self, keys: np.ndarray) -> np.ndarray:
        """A row for each of the distinct ``keys``."""
        if len(keys) > CACHED:
            return np.stack([self.make(k) for k in keys.tolist()]).astype(np.float32)
        get = self.rows.get
        at = [get(k, -1) for k in keys.tolist()]
        if -1 in at:
            if len(self.rows) + at.count(-1) > CACHED:
                self.rows.clear()
                at = [-1] * len(at)
            for i, (k, row) in enumerate(zip(keys.tolist(), at, strict=True)):
                if row < 0:
                    at[i] = self.rows[k] = n = len(self.rows)
                    if n >= len(self.table):
                        self.table = np.concatenate((self.table, np.empty_like(self.table)))[:CACHED]
                    self.table[n] = self.make(k)
        return self.table[at]

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dimensions)
        for i in range(0, len(keys), 4096):
            total += counts[i : i + 4096].astype(np.float32) @ self.of(keys[i : i + 4096])
        return total


_spaces: dict[tuple[int, int], Vectors] = {}


def _space(dimensions: int, seed: int) -> Vectors:
    return _spaces.setdefault((dimensions, seed), Vectors(dimensions, seed))


class Profile:
    """Language prototypes, as unit vectors in the order of their names."""

    def __init__(self, languages: list[str], prototypes: np.ndarray, seed: int) -> None:
        self.languages, self.seed = languages, seed
        self.prototypes = (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def predict(self, data: bytes | None) -> tuple[str, float]:
        keys, counts = trigrams(data)
        if not len(keys) or not self.languages:
            return "und", 0.0
        vector = _space(self.prototypes.shape[1], self.seed).bundle(keys, counts)
        cosines = self.prototypes @ (vector / max(np.linalg.norm(vector), 1e-12)).astype(np.float32)
        best = int(np.argmax(cosines))
        return self.languages[best], float(min(1.0, max(0.0, cosines[best])))


def train(docs: DataFrame, training: Column | None = None, dimensions: int = DIMENSIONS, seed: int = 1) -> Profile:
    """Prototypes from ``text`` and ``lang`` of all rows of ``docs`` where ``training`` holds.

    A task adds up its texts' trigram counts by language and sends one vector
    for each language it met, so the driver gets ``dimensions`` numbers a
    language from a sum over tasks.
    """
    bound_batches(docs.sparkSession)
    rows = docs.where((F.lit(True) if training is None else training) & F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull())
    schema = "lang string, place int, value double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        space = _space(dimensions, seed)
        for batch in batches:
            for part in slices(batch, 512):
                met: dict[str, list] = {}
                for lang, data in zip(part.column(1).to_pylist(), part.column(0).cast(pa.binary()).to_pylist(), strict=True):
                    met.setdefault(lang, []).append(trigrams(data))
                for lang, found in met.items():
                    keys = np.concatenate([k for k, _ in found])
                    if len(keys):
                        distinct, at = np.unique(keys, return_inverse=True)
                        counts = np.bincount(at, np.concatenate([c for _, c in found]))
                        sums[lang] = sums.get(lang, 0) + space.bundle(distinct, counts)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(total)], ["lang", "place", "value"])

    summed = rows.select("text", "lang").mapInArrow(run, schema).groupBy("lang", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("double").alias("value"))
    by_lang = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v")).select("lang", F.col("v.value").alias("v"))
    got = sorted(by_lang.limit(MOST_LANGUAGES + 1).collect())
    if len(got) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} distinct values of lang")
    return Profile([r[0] for r in got], np.array([r[1] for r in got]).reshape(len(got), dimensions), seed)


def identify(docs: DataFrame, profile: Profile) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (cosine, 0 to 1) from ``text`` alone; a map without shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(profile))
    cache: list[Profile] = []

    def score(batch: pa.RecordBatch) -> list:
        if not cache:
            cache.append(pickle.loads(shared.value))
        column = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        made = [cache[0].predict(data) for data in column.to_pylist()]
        return [[m[0] for m in made], [m[1] for m in made]]

    return append_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], score)
