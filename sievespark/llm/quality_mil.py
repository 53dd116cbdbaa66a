"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage of the whole
text is described by its words, hashed into buckets with learnt vectors, by the
kinds of its bytes and their neighbours and by how its words repeat, and
encoded by a small network; gated attention weighs the passages, learnt from
document labels alone, and the weighted sum is scored. The model is trained on
the driver from a bounded sample of labelled documents, each with all its
passages: at most ``TRAIN_BOUND`` documents and ``TRAIN_BYTES`` of text, in the
order of a hash of their ids; documents that would exceed the bytes are passed
over. Scoring is a map over all documents.

Null or empty text: one passage without a word, scored like any other. Labels
other than 0 and 1 are ignored; a document with both counts as 1. Of rows that
repeat a labelled id, the least text is learnt from. Without both classes the
score is the share of label 1, or 0.5 without labels. Equal texts score alike
to the last bit, wherever they lie: sums run in an order of their own document.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievespark.llm.common import append_columns, bounded_ids, materialize, texts_of
from sievespark.llm.words import Words

PASSAGE = 96
TRAIN_BOUND = 3000
TRAIN_BYTES = 16 << 20
THRESHOLD = 0.3
HIDDEN, GATE = 24, 12
BUCKETS = 1 << 11

_KINDS = 10
_kind = np.full(256, 9)
for _b in range(128):
    _c = chr(_b)
    _kind[_b] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c == " " else 4 if _c == "\n" else 5 if _c in ".,;:" else 6 if _c in "!?'\"()-" else 7 if _c in "#*$%&|<>" else 8
FEATURES = _KINDS * _KINDS + 6


@dataclass
class Bags:
    """Passages of some texts: dense features ``x`` of each, ``words`` (buckets) between ``word_bounds``, and the ``bounds`` of each text's passages."""

    x: np.ndarray
    words: np.ndarray
    word_bounds: np.ndarray
    bounds: np.ndarray

    def take(self, chosen: np.ndarray) -> Bags:
        """The bags of some texts."""
        rows = np.concatenate([np.arange(self.bounds[i], self.bounds[i + 1]) for i in chosen])
        sizes = np.diff(self.word_bounds)[rows]
        ends = np.cumsum(sizes)
        words = self.words[np.repeat(self.word_bounds[rows] - (ends - sizes), sizes) + np.arange(ends[-1])]
        return Bags(self.x[rows], words, np.concatenate(([0], ends)), np.concatenate(([0], np.cumsum(np.diff(self.bounds)[chosen]))))


def passages(texts: list[bytes | None]) -> Bags:
    words = Words(texts)
    counts = np.diff(words.first)
    per = np.maximum(-(-counts // PASSAGE), 1)
    bounds = np.concatenate(([0], np.cumsum(per)))
    total = int(bounds[-1])
    doc = np.repeat(np.arange(len(texts)), per)
    k = np.arange(total) - bounds[doc]
    first_word = words.first[doc] + k * PASSAGE
    has = counts[doc] > 0
    at = np.where(k == 0, words.text_starts[doc], words.starts[np.minimum(first_word, max(len(words.starts) - 1, 0))] if len(words.starts) else 0)
    end = np.where(np.concatenate((doc[1:] == doc[:-1], [False])), np.concatenate((at[1:], [0])), words.text_ends[doc])
    sizes = end - at
    passage = np.repeat(np.arange(total), sizes)
    kinds = _kind[words.bytes]
    where = np.repeat(at - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))
    following = np.where(np.repeat(end, sizes) > where + 1, kinds[where + 1], 3)  # the end of a passage counts as a space
    pairs = np.bincount(passage * _KINDS * _KINDS + kinds[where] * _KINDS + following, minlength=total * _KINDS * _KINDS).reshape(total, -1)
    out = np.zeros((total, FEATURES))
    out[:, : _KINDS * _KINDS] = np.sqrt(pairs / np.maximum(sizes, 1)[:, None])
    hashes = words.hashes()
    word_doc = words.doc
    of = bounds[word_doc] + (np.arange(len(word_doc)) - words.first[word_doc]) // PASSAGE
    n = np.bincount(of, minlength=total)
    if len(hashes):
        order = np.lexsort((hashes, of))
        new = np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])))
        distinct = np.bincount(of[order][new], minlength=total)
        same_next = np.concatenate(((hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1]), [False]))
        length = np.bincount(of, words.ends - words.starts, minlength=total)
        m = np.maximum(n, 1)
        out[:, -6:] = np.stack([distinct / m, np.bincount(of, same_next, minlength=total) / m, np.log1p(n) / 5, length / m / 10, np.log1p(counts[doc]) / 8, has], 1)
    buckets = (hashes >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)
    return Bags(out, buckets, np.concatenate(([0], np.cumsum(n))), bounds)


def segments(rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``rows[bounds[i] : bounds[i + 1]]``, 0 where empty."""
    out = np.zeros((len(bounds) - 1, *rows.shape[1:]))
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(rows, bounds[full])
    return out


def product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w``, each row added up in the order of its columns: the library's product depends on the row's place."""
    out = np.zeros((x.shape[0], w.shape[1]))
    for column, weights in zip(np.ascontiguousarray(x.T), w, strict=True):
        out += column[:, None] * weights
    return out


class Attention:
    """Encoder, gated attention and scorer; trained by Adam on whole bags."""

    def __init__(self, width: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        init = lambda a, b: rng.standard_normal((a, b)) / np.sqrt(a)
        self.p = {"W": init(width, HIDDEN), "E": np.zeros((BUCKETS, HIDDEN)), "b": np.zeros(HIDDEN), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": init(GATE, 1), "c": init(HIDDEN, 1), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(width), np.ones(width)

    def forward(self, bags: Bags, dot: Callable[[np.ndarray, np.ndarray], np.ndarray] = product) -> dict[str, np.ndarray]:
        p, bounds, sizes = self.p, bags.bounds, np.diff(bags.bounds)
        x = np.clip((bags.x - self.mean) / self.scale, -8, 8)
        share = 1 / np.sqrt(np.maximum(np.diff(bags.word_bounds), 1))[:, None]
        h = np.tanh(dot(x, p["W"]) + segments(p["E"][bags.words], bags.word_bounds) * share + p["b"])
        t, s = np.tanh(dot(h, p["V"])), 1 / (1 + np.exp(-dot(h, p["U"])))
        e = dot(t * s, p["w"])[:, 0]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, bounds[:-1]), sizes))
        a = e / np.repeat(np.add.reduceat(e, bounds[:-1]), sizes)
        z = np.add.reduceat(a[:, None] * h, bounds[:-1])
        y = 1 / (1 + np.exp(-np.clip(dot(z, p["c"]) + p["d"], -30, 30)))[:, 0]
        return {"x": x, "share": share, "h": h, "t": t, "s": s, "a": a, "z": z, "y": y}

    def gradients(self, bags: Bags, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy."""
        p, f, sizes = self.p, self.forward(bags, np.matmul), np.diff(bags.bounds)
        dlogit = ((f["y"] - labels) / len(labels))[:, None]
        dz = np.repeat(dlogit @ p["c"].T, sizes, 0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, bags.bounds[:-1]), sizes))
        dg = de[:, None] * p["w"].T
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        of_word = np.repeat(dh * f["share"], np.diff(bags.word_bounds), 0)
        order = np.argsort(bags.words, kind="stable")
        dE = segments(of_word[order], np.searchsorted(bags.words[order], np.arange(BUCKETS + 1)))
        return {"W": f["x"].T @ dh, "E": dE, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de[:, None], "c": f["z"].T @ dlogit, "d": dlogit.sum(0)}

    def fit(self, bags: Bags, labels: np.ndarray, epochs: int, seed: int, batch: int = 64, rate: float = 0.004, decay: float = 1e-4) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = bags.x.mean(0), bags.x.std(0) + 0.05
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for i in range(0, len(order), batch):
                chosen = order[i : i + batch]
                step += 1
                for k, g in self.gradients(bags.take(chosen), labels[chosen]).items():
                    g = g + decay * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


class Constant:
    """Where there is one class, or none, to learn from."""

    def __init__(self, score: float) -> None:
        self.score = score

    def forward(self, bags: Bags) -> dict[str, np.ndarray]:
        return {"y": np.full(len(bags.bounds) - 1, self.score)}


def training_sample(docs: DataFrame, labels: DataFrame, training: Column | None, bound: int, most_bytes: int) -> list[tuple[bytes, int]]:
    """Text and label of the documents that are learnt from."""
    known = labels.where(F.col("quality").isin(0, 1) & (F.lit(True) if training is None else training)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.join(F.broadcast(bounded_ids(known, bound)), "doc_id").select(F.col("doc_id").alias("__id"), "quality")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    sample = materialize(sample.groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
    took, total = [], 0
    for doc_id, size in sample.select("doc_id", F.octet_length("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # at most ``bound`` rows
        if total + size <= most_bytes:
            took.append(doc_id)
            total += size
    rows = sample.where(F.col("doc_id").isin(took)).orderBy("doc_id").collect()
    return [(r.text.encode(), int(r.quality)) for r in rows]


def train(docs: DataFrame, labels: DataFrame, training: Column | None = None, bound: int = TRAIN_BOUND, epochs: int = 12, seed: int = 7, most_bytes: int = TRAIN_BYTES) -> Attention | Constant:
    """A model of ``labels`` (doc_id, quality) from ``text`` of ``docs``; ``training``: condition on ``doc_id`` of the rows it may learn from."""
    sample = training_sample(docs, labels, training, bound, most_bytes)
    y = np.array([q for _, q in sample], float)
    if not len(y) or len(np.unique(y)) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    model = Attention(FEATURES, seed)
    model.fit(passages([t for t, _ in sample]), y, epochs, seed)
    return model


def score(docs: DataFrame, model: Attention | Constant, threshold: float = THRESHOLD, needs: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``, from ``text`` alone; a map without shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    opened: list = []

    def run(batch: pa.RecordBatch) -> list:
        if not opened:
            opened.append(pickle.loads(shared.value))
        texts, out = texts_of(batch), []
        for i in range(0, len(texts), 256):
            out.append(opened[0].forward(passages(texts[i : i + 256]))["y"])
        y = np.concatenate(out) if out else np.empty(0)
        return [pa.array(y), pa.array((y >= threshold).astype(np.int32))]

    return append_columns(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], run, needs)
