"""SimHash fingerprints, and permuted block tables that find all near ones.

A text's terms are its lower-cased words and word pairs. Each distinct term
votes with weight 1 + ln(occurrences) on every bit of its hash; a fingerprint
bit is set where the votes are above 0. Equal texts have equal fingerprints.

To find all fingerprints within ``radius`` bits, the bits are cut into blocks.
Fingerprints that near agree on at least ``blocks - radius`` of them, so for
each choice of that many blocks one table keyed by those blocks brings them
together. A search asks for some fingerprints and counts the documents near to
each; rows of a table's key are compared where they meet, and keys of over
``MEMBERS`` fingerprints are cut into parts, to each of which go all that ask.

Null or empty text: no terms, the fingerprint of zeros. Repeated texts share
one fingerprint and are compared once; empty tables give none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievespark.llm.common import append_columns, attach, bound_batches, materialize, mix64, partitions, slices, texts_of
from sievespark.llm.words import Words, shingles

BITS = 128
RADIUS = 3
BLOCKS = 4
#: Distinct fingerprints of one key that meet in one task.
MEMBERS = 4096
#: Documents that the query searches for: those whose id is divisible by this.
ASK_EVERY = 20


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """A row of 16 bytes for each text."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    pairs, bounds = shingles(hashes, words.first, 2)
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for i in range(len(texts)):
        terms = np.concatenate((hashes[words.first[i] : words.first[i + 1]], pairs[bounds[i] : bounds[i + 1]]))
        if len(terms):
            votes, total = np.zeros(BITS, np.float64), 0.0
            distinct, counts = np.unique(terms, return_counts=True)
            weights = (1 + np.log(counts)).astype(np.float32)
            both = np.stack((mix64(distinct), mix64(distinct ^ np.uint64(0xA0761D6478BD642F))), 1).view(np.uint8)
            for k in range(0, len(distinct), 8192):
                votes += weights[k : k + 8192] @ np.unpackbits(both[k : k + 8192], axis=1).astype(np.float32)
                total += float(weights[k : k + 8192].sum())
            out[i] = np.packbits(2 * votes > total + 1e-3)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits of two rows of fingerprints."""
    return 1 - np.unpackbits(a ^ b, axis=-1).sum(-1) / BITS


def fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fingerprint`` (32 hex digits); a map without shuffle."""
    return append_columns(docs, [T.StructField("fingerprint", T.StringType())], lambda batch: [[r.tobytes().hex() for r in fingerprints(texts_of(batch))]])


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at most ``doc_id``, by a search in two levels."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not groups:
        return F.lit(0)
    up_to = lambda a: F.size(F.filter(a, lambda b: b <= doc_id))
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    coarse = up_to(lit([g[0] for g in groups]))
    fine = up_to(F.element_at(F.array(*[lit(g) for g in groups]), F.greatest(coarse, F.lit(1))))
    return F.when(doc_id.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * step + fine)


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Each document against an edit of itself and against the next document by id.

    The edit replaces the last floor(n/2) code points by as many from the start
    of the next document (after the last: the first). Texts are shuffled once,
    by ranges of ids; the first document of each range is copied to the range
    before it, so every range is read in order, row by row, without knowing
    the others. Null ids come first; equal ids are ordered by text.
    """
    spark = docs.sparkSession
    bound_batches(spark, 4 << 20)
    docs = docs.select("doc_id", "text")
    n = 4 * partitions(spark)
    cuts = F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n) if n > 1 else F.array().cast("array<bigint>")
    cuts, least, nulls = docs.agg(cuts, F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    bounds = sorted({b for b in cuts or [] if b > least})
    pid = _range_of(F.col("doc_id"), bounds)
    first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(least)
    starts = F.col("doc_id").isin(bounds) if len(bounds) < 500 else F.array_contains(F.array(*[F.lit(b) for b in bounds]), F.col("doc_id"))
    copy = F.when(first, len(bounds)).when(starts, pid - 1)
    placed = docs.select("doc_id", "text", F.explode(F.when(copy.isNotNull(), F.array(F.struct(pid.alias("pid"), F.lit(0).alias("copy")), F.struct(copy.alias("pid"), F.lit(1).alias("copy")))).otherwise(F.array(F.struct(pid.alias("pid"), F.lit(0).alias("copy"))))).alias("at"))
    ordered = placed.select("doc_id", "text", "at.pid", "at.copy").repartition(partitions(spark), "pid").sortWithinPartitions("pid", "copy", "doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for part in slices(batch, 128):
                rows += zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True)
                own = [(i, a, b) for i, (a, b) in enumerate(zip(rows[:-1], rows[1:], strict=True)) if not a[2]]
                texts = [text or "" for _, text, _ in rows]
                edited = []
                for i, _, _ in own:
                    half = len(texts[i]) // 2
                    edited.append((texts[i][: len(texts[i]) - half] + texts[i + 1][:half]).encode())
                marks, new = fingerprints([t.encode() for t in texts]), fingerprints(edited)
                at = np.array([i for i, _, _ in own], np.int64)
                columns = [[a[0] for _, a, _ in own], [len(texts[i]) for i in at], [hashlib.sha256(e).hexdigest() for e in edited], [marks[i].tobytes().hex() for i in at], [r.tobytes().hex() for r in new], likeness(marks[at], new), likeness(marks[at], marks[at + 1])]
                types = (part.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)
                rows = rows[-1:]

    return ordered.mapInArrow(run, schema)


def _tables(radius: int, blocks: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Bounds of the blocks in hex digits, and the blocks that key each table."""
    if not 0 <= radius < blocks <= 32:
        raise ValueError("0 <= radius < blocks <= 32")
    return [round(k * BITS / 4 / blocks) for k in range(blocks + 1)], list(combinations(range(blocks), blocks - radius))


def near_counts(marked: DataFrame, asked: Column, radius: int = RADIUS, blocks: int = BLOCKS, members: int = MEMBERS) -> DataFrame:
    """``fingerprint, copies, n_near`` of the fingerprints of the rows of ``marked`` where ``asked`` holds.

    ``copies``: rows that ask with it; ``n_near``: rows of ``marked`` whose
    fingerprint has at most ``radius`` other bits, its own rows included. A
    pair that several tables bring together counts in the first of them.
    """
    cuts, tables = _tables(radius, blocks)
    spark = marked.sparkSession
    bound_batches(spark)
    ask = F.coalesce(asked, F.lit(False))
    distinct = materialize(marked.where("fingerprint is not null").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("rows"), F.count_if(ask).alias("copies")))
    half = lambda k: F.conv(F.substring("fingerprint", 16 * k + 1, 16), 16, -10).cast("long")
    part = lambda k: F.substring("fingerprint", cuts[k] + 1, cuts[k + 1] - cuts[k])
    keys = F.array(*[F.xxhash64(F.lit(t), *[part(k) for k in chosen]) for t, chosen in enumerate(tables)])
    keyed = distinct.select(half(0).alias("high"), half(1).alias("low"), "rows", (F.col("copies") > 0).alias("asks"), F.posexplode(keys).alias("table", "key"))
    large = materialize(keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("a")).where((F.col("n") > members) & (F.col("a") > 0)).select("table", "key", F.ceil(F.col("n") / members).cast("int").alias("parts")))
    placed = keyed.join(large, ["table", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    at = lambda p, q: F.struct(p.cast("int").alias("part"), F.lit(q).alias("query"))
    own = F.array(at(F.pmod(F.xxhash64("low", "high", "key"), F.col("parts")), False))
    every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: at(p, True))
    rows = placed.select("table", "key", "high", "low", "rows", F.explode(F.when(F.col("asks"), F.concat(own, every)).otherwise(own)).alias("at")).select("table", "key", "at.part", "at.query", "high", "low", "rows")
    rows = rows.repartition(partitions(spark), "table", "key", "part").sortWithinPartitions("table", "key", "part", F.col("query").desc())
    masks = []
    for chosen in tables:
        mask = sum(((1 << 4 * (cuts[k + 1] - cuts[k])) - 1) << (BITS - 4 * cuts[k + 1]) for k in chosen)
        masks.append((np.uint64(mask >> 64), np.uint64(mask & 0xFFFFFFFFFFFFFFFF)))

    def near(table: int, asks: np.ndarray, high: np.ndarray, low: np.ndarray, count: np.ndarray) -> np.ndarray:
        out = np.zeros(len(asks), np.int64)
        for i, (h, w) in enumerate(asks):
            x, y = high ^ h, low ^ w
            close = np.flatnonzero(np.bitwise_count(x) + np.bitwise_count(y) <= radius)
            x, y = x[close], y[close]
            first = np.ones(len(close), bool)
            for a, b in masks[:table]:
                first &= (x & a | y & b) != 0
            out[i] = count[close[first]].sum()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asks, counts = None, [], np.empty(0, np.int64)

        def made() -> pa.RecordBatch:
            pairs = np.array(asks, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(counts)], ["high", "low", "n_near"])

        for batch in batches:
            for piece in slices(batch, members):
                table, key, of, query, high, low, count = (c.to_numpy(zero_copy_only=False) for c in piece.columns)
                high, low = high.view(np.uint64), low.view(np.uint64)
                edges = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1]) | (of[1:] != of[:-1])) + 1
                for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True):
                    if i == j:
                        continue
                    if now != (table[i], key[i], of[i]):
                        if asks:
                            yield made()
                        now, asks, counts = (table[i], key[i], of[i]), [], np.empty(0, np.int64)
                    q = i + int(np.count_nonzero(query[i:j]))  # those that ask come first
                    asks += zip(high[i:q], low[i:q], strict=True)
                    counts = np.concatenate((counts, np.zeros(q - i, np.int64)))
                    if asks and q < j:
                        counts += near(int(table[i]), asks, high[q:j], low[q:j], count[q:j])
        if asks:
            yield made()

    found = rows.mapInArrow(run, "high long, low long, n_near long").groupBy("high", "low").agg(F.sum("n_near").alias("n_near"))
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    found = found.select(F.concat(digits("high"), digits("low")).alias("fingerprint"), "n_near")
    return distinct.where("copies > 0").select("fingerprint", "copies").join(found, "fingerprint")


def edits_and_neighbours(docs: DataFrame, ask_every: int = ASK_EVERY) -> DataFrame:
    """:func:`edit_likeness`, and ``n_near`` of the documents whose id is divisible by ``ask_every`` (null for others)."""
    marked = materialize(edit_likeness(docs))
    asked = F.coalesce(F.col("doc_id") % ask_every == 0, F.lit(False))
    counts = materialize(near_counts(marked.select("doc_id", "fingerprint"), asked))
    total = counts.agg(F.sum("copies")).first()[0] or 0
    asking = attach(marked.where(asked), counts, ["fingerprint"], "copies", total)
    return asking.unionByName(marked.where(~asked).withColumn("n_near", F.lit(None).cast("long")))


def near_fingerprints(marked: DataFrame, radius: int = RADIUS, blocks: int = 6) -> DataFrame:
    """All pairs ``a < b`` of different values of ``fingerprint`` in ``marked`` with at most ``radius`` differing bits, and ``distance``.

    Copies of a fingerprint take part once. A table's key holds
    ``blocks - radius`` blocks, at least 128 / blocks bits each; a pair that
    several tables find is returned once, from the first of them.
    """
    cuts, tables = _tables(radius, blocks)
    distinct = materialize(marked.select("fingerprint").where("fingerprint is not null").distinct())
    part = lambda c, k: F.substring(c, cuts[k] + 1, cuts[k + 1] - cuts[k])
    keys = F.array(*[F.struct(F.lit(t).alias("table"), F.concat(*[part(F.col("fingerprint"), k) for k in chosen]).alias("key")) for t, chosen in enumerate(tables)])
    keyed = distinct.select("fingerprint", F.explode(keys).alias("k")).select("fingerprint", "k.*")
    left, right = keyed.withColumnRenamed("fingerprint", "a"), keyed.withColumnRenamed("fingerprint", "b")
    pairs = left.join(right, ["table", "key"]).where("a < b")
    word = lambda c, k: F.conv(F.substring(c, 8 * k + 1, 8), 16, 10).cast("long")
    distance = sum((F.bit_count(word(F.col("a"), k).bitwiseXOR(word(F.col("b"), k))) for k in range(BITS // 32)), F.lit(0))
    same = F.array(*[part(F.col("a"), k) == part(F.col("b"), k) for k in range(blocks)])
    earlier = F.lit(False)
    for t, chosen in enumerate(tables):
        agree = F.lit(True)
        for k in chosen:
            agree = agree & F.get(same, F.lit(k))
        earlier = earlier | ((F.lit(t) < F.col("table")) & agree)
    return pairs.select("a", "b", distance.cast("int").alias("distance"), earlier.alias("seen")).where(~F.col("seen") & (F.col("distance") <= radius)).select("a", "b", "distance")
