"""Quality rules: document statistics and a hashed n-gram log-likelihood ratio.

Byte n-grams of all texts are hashed into buckets; the raw-corpus multinomial
counts all documents, the trusted-target multinomial those that ``trusted``
names. A text scores the mean over its n-grams of log(target / raw), and is
kept if the score reaches a fixed threshold and its statistics pass.

Null or empty text: no words, so it fails the base rules. A text shorter than
an n-gram scores 0. Without a trusted document every ratio is 1, so the
verdict is left to the base rules. Repeated rows and ties are judged alike; null ids are judged, but are never trusted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievespark.llm.common import append_columns, bound_batches, slices, texts_of
from sievespark.llm.words import Words, segment_sums, shingles

BUCKETS = 1 << 14
THRESHOLD = -0.3
SMOOTHING = 1.0
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_VISIBLE = np.array([b not in (0x20, *range(0x09, 0x0E)) and b & 0xC0 != 0x80 for b in range(256)])


def byte_grams(words: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each 4-byte run within a text, and the bounds of each text's runs."""
    sizes = np.maximum(words.text_ends - words.text_starts - 3, 0)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    lanes = as_strided(words.bytes[:4].view("<u4"), (len(words.bytes) - 3,), (1,))
    grams = lanes[np.repeat(words.text_starts - bounds[:-1], sizes) + np.arange(bounds[-1])]
    return (grams * np.uint32(0x9E3779B1)) >> np.uint32(33 - buckets.bit_length()), bounds


def statistics(words: Words, texts: list[bytes | None]) -> dict[str, np.ndarray]:
    def within(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags[words.bytes])))
        return total[words.text_ends] - total[words.text_starts]

    dup = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text and b"\n" in text:
            lines = [line for line in text.split(b"\n") if line.strip()]
            dup[i] = len(lines) - len(set(lines))
    counts = np.diff(words.first)
    runs, bounds = shingles(words.hashes(), words.first, WINDOW)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    full = counts[doc] >= WINDOW
    runs, doc, at = runs[full], doc[full], (np.arange(len(runs)) - bounds[doc] + words.first[doc])[full]
    order = np.lexsort((runs, doc))
    same = (runs[order][1:] == runs[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(runs), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(words.starts) + WINDOW + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    repeated = segment_sums((np.cumsum(cover)[: len(words.starts)] > 0).astype(np.int64), words.first)
    return {"n_words": counts, "word_chars": within(_VISIBLE), "n_symbols": within(_SYMBOL), "n_dup_lines": dup, "n_repeat_words": repeated}


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(target / raw) of each bucket; ``trusted``: the ``doc_id`` of trusted documents.

    Raw counts cover every document, and the target every trusted one: texts
    meet the ids in a shuffled join, rows without an id spread by their text.
    A task sends one row a bucket.
    """
    bound_batches(docs.sparkSession)
    ids = trusted.select(F.col("doc_id").alias("__id"), F.lit(0).cast("long").alias("__zero")).where("__id is not null").distinct()
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    texts = docs.select("doc_id", "text", spread.alias("__spread"))
    marked = texts.join(ids.hint("shuffle_hash"), (F.col("doc_id") == F.col("__id")) & (F.col("__spread") == F.col("__zero")), "left").select("text", F.col("__id").isNotNull().alias("trusted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                grams, bounds = byte_grams(Words(texts_of(part)), buckets)
                raw += np.bincount(grams, minlength=buckets)
                own = np.repeat(part.column(1).to_numpy(zero_copy_only=False), np.diff(bounds))
                target += np.bincount(grams[own], minlength=buckets)
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(raw[met]), pa.array(target[met])], ["bucket", "raw", "target"])

    counted = marked.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.full(buckets, SMOOTHING), np.full(buckets, SMOOTHING)
    for bucket, r, t in counted:
        raw[bucket] += r
        target[bucket] += t
    if target.sum() == buckets * SMOOTHING:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, needs: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score``; a map without shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batch: pa.RecordBatch) -> list:
        texts = texts_of(batch)
        words = Words(texts)
        stats = statistics(words, texts)
        grams, bounds = byte_grams(words, len(shared.value))
        scores = segment_sums(shared.value[grams], bounds) / np.maximum(np.diff(bounds), 1)
        failed = (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEATED_PERCENT * stats["n_words"])
        return [pa.array(c) for c in (*stats.values(), failed, ~failed & (scores >= threshold), scores)]

    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("score", T.DoubleType())]
    return append_columns(docs, fields, run, needs)
