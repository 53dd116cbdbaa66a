"""MinHash near-duplicates with sequential Bayesian verification.

1. A text's set holds its distinct word shingles. Texts with equal sets form a
   class; only one set of each class goes on, so copies cost nothing further.
2. Band keys of a MinHash signature bring classes together. Buckets of two or
   more classes are compared where they lie, signature batch by signature
   batch: once the posterior probability that a pair's similarity reaches the
   threshold is below ``MISS``, the pair is dropped.
3. A first round lets each bucket name a spanning forest of its surest pairs,
   which full sets confirm or refute; confirmed links are contracted. A second
   names each class's best pair with another component.
4. The last round tests every pair, in every bucket, that survives the
   posterior and still lies in two components, on full sets that its bucket
   then holds. A pair that no round tests therefore lies within a component, shares no band or
   was pruned, so the components are those of all links found by the method.

Buckets of over ``BLOCK`` classes are dealt to several tasks: the first round in
blocks, the others in cells that bring each two blocks together, without those
of two blocks of the bucket's largest component. A bucket whose classes are one component is
done. A pair of similarity 0.8 shares no band with probability 7e-6. Nothing of
the size of the corpus reaches the driver.

Null or empty text, or text without words: an empty set, linked with nothing,
its own component. Fewer words than a shingle: the whole sequence as one. Rows
that repeat a doc_id are classed by their own texts. Null ids take part in
links and never name a component with an id; empty tables give empty results.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievespark.llm.common import attach, bound_batches, materialize, mix64, partitions, slices, texts_of
from sievespark.llm.words import Words, shingles

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 30, 5
#: Classes of one bucket that meet in one task, and shingles that count as one more.
BLOCK = 4096
SHINGLES = 512
#: Matches among a signature's bytes from which the first round names a pair.
SURE = 128
BATCH = 30
MISS = 1e-5
_HASHES = BANDS * ROWS
_SEEDS = mix64(np.arange(1, _HASHES + 1, dtype=np.uint64))


def shingle_sets(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and the bounds of each text's."""
    words = Words(texts, lower=True)
    runs, bounds = shingles(words.hashes(), words.first, size)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((runs, doc))
    runs, doc = runs[order], doc[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])
    return runs[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash signatures (32 bits a hash) of non-empty sets."""
    out = np.empty((len(bounds) - 1, _HASHES), np.uint32)
    for k, seed in enumerate(_SEEDS):
        out[:, k] = np.minimum.reduceat((((sets ^ seed) * (seed | np.uint64(1))) >> np.uint64(32)).astype(np.uint32), bounds[:-1])
    return out


def least_matches(percent: int = PERCENT, miss: float = MISS, batch: int = BATCH) -> list[int]:
    """Matches that a pair needs after 1, 2, ... batches.

    A byte of two signatures agrees with probability s + (1 - s) / 256. With a
    uniform prior on the similarity s, the posterior after m matches in n is
    summed on a grid.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    needed = []
    for n in range(batch, _HASHES + 1, batch):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(log - log.max())
            if weight[s >= percent / 100].sum() >= miss * weight.sum():
                break
        needed.append(m)
    return needed


def likely(a: np.ndarray, b: np.ndarray, needed: list[int], batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of byte signatures survive every batch, and their matches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(needed):
        cut = slice(k * batch, (k + 1) * batch)
        matches[alive] += (a[alive, cut] == b[alive, cut]).sum(1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out, matches


def signed(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, node, bands, bytes``: the class of each row, its band keys and its signature's bytes; null for empty sets."""
    bound_batches(docs.sparkSession)
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_shingles long, node long, bands array<long>, bytes binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 512):
                sets, bounds = shingle_sets(texts_of(part), size)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                node, bands, low = [None] * len(sizes), [None] * len(sizes), [None] * len(sizes)
                if len(full):
                    sig = signatures(sets, np.concatenate((bounds[:-1][full], bounds[-1:])))
                    keys = np.zeros((len(full), BANDS), np.uint64)
                    for r in range(ROWS):
                        keys = mix64(keys * np.uint64(31) + sig[:, r::ROWS].astype(np.uint64) + np.uint64(1))
                    keys = (keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                    small = sig.astype(np.uint8)
                    for j, i in enumerate(full.tolist()):
                        node[i] = xxhash.xxh3_64_intdigest(sets[bounds[i] : bounds[i + 1]].tobytes()) - (1 << 63)
                        bands[i], low[i] = keys[j], small[j].tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(node, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


_ROW = "key", "x", "y", "own", "node", "n", "comp", "bytes", "bands", "set"


class Cell:
    """Classes that meet in one task: ``own`` side, ``node``, size ``n``, ``comp`` and signature of each; band keys and full sets in the last round."""

    def __init__(self, columns: list[np.ndarray], needed: list[int]) -> None:
        key, x, y, self.own, self.node, self.n, self.comp, self.sig, self.bands, self.sets = columns
        self.key, self.x, self.y, self.needed = key[0], int(x[0]), int(y[0]), needed

    def partners(self, i: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the rows ``among`` survive the comparison with row i, and their matches."""
        n = self.n[among]
        among = among[100 * np.minimum(n, self.n[i]) >= PERCENT * np.maximum(n, self.n[i])]
        keep, matches = likely(np.broadcast_to(self.sig[i], (len(among), _HASHES)), self.sig[among], self.needed)
        return among[keep], matches[keep]

    def forest(self) -> Iterator[tuple[int, np.ndarray]]:
        """Row and partners of a spanning forest of the surest pairs, from the first row outwards."""
        left, queue = np.arange(len(self.node)), deque()
        while len(left):
            if not queue:
                queue.append(int(left[0]))
                left = left[1:]
            i = queue.popleft()
            near, matches = self.partners(i, left)
            near = near[matches >= SURE]
            if len(near):
                yield i, near
                queue.extend(near.tolist())
                left = np.setdiff1d(left, near, assume_unique=True)

    def across(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each row outside the largest component, its partners in other components and their matches; no pair twice."""
        if self.x != self.y:
            side = np.flatnonzero(self.own == self.x)
            for i in np.flatnonzero(self.own == self.y).tolist():
                yield i, *self.partners(i, side[self.comp[side] != self.comp[i]])
            return
        comps, counts = np.unique(self.comp, return_counts=True)
        if len(comps) < 2:
            return
        top = self.comp == comps[np.argmax(counts)]
        at = np.arange(len(top))
        for i in np.flatnonzero(~top).tolist():
            yield i, *self.partners(i, at[(self.comp != self.comp[i]) & (top | (at > i))])

    def best(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each row's partner of most matches."""
        for i, near, matches in self.across():
            if len(near):
                yield i, near[[np.argmax(matches)]]

    def links(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each row's partners by full sets; a pair is tested in the first of the buckets that it shares."""
        for i, near, _ in self.across():
            shared = self.bands[near] == self.bands[i]
            near = near[self.bands[i][shared.argmax(1)] == self.key]
            if len(near):
                sizes = self.n[near]
                values = np.concatenate([self.sets[j] for j in near.tolist()])
                mine = self.sets[i]
                found = mine[np.minimum(np.searchsorted(mine, values), len(mine) - 1)] == values
                common = np.add.reduceat(found.astype(np.int64), np.cumsum(sizes) - sizes)
                near = near[100 * common >= PERCENT * (sizes + len(mine) - common)]
                if len(near):
                    yield i, near


def _cells(batches: Iterator[pa.RecordBatch], needed: list[int]) -> Iterator[Cell]:
    """The cells of sorted rows; only a batch and one cell are held."""
    held: list[list[np.ndarray]] = []

    def made() -> Cell:
        return Cell([np.concatenate(c) for c in zip(*held, strict=True)], needed)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        columns.append(np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(-1, _HASHES))
        full = batch.column(8).null_count == 0
        columns.append(batch.column(8).flatten().to_numpy().reshape(-1, BANDS) if full else np.zeros((batch.num_rows, 0), np.int64))
        sets = np.empty(batch.num_rows, object)
        for i, v in enumerate(batch.column(9).to_pylist() if full else []):
            sets[i] = np.frombuffer(v, np.uint64)
        columns.append(sets)
        key, x, y = columns[:3]
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            if held and (i or [c[-1] for c in held[-1][:3]] != [key[0], x[0], y[0]]):
                yield made()
                held = []
            held.append([c[i:j] for c in columns])
    if held:
        yield made()


def _named(rows: DataFrame, pick: Callable[[Cell], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """Distinct pairs ``a < b`` with their components that ``pick`` names in the cells of ``rows``.

    Rows of a cell come in one order of nodes that holds in all cells, so
    that buckets of the same classes name the same pairs.
    """
    needed = least_matches()
    bound_batches(rows.sparkSession)
    if "set" not in rows.columns:
        rows = rows.withColumns({"bands": F.lit(None).cast("array<long>"), "set": F.lit(None).cast("binary")})
    rows = rows.select(*_ROW, F.xxhash64("node").alias("order")).repartition(partitions(rows.sparkSession), "key", "x", "y").sortWithinPartitions("key", "x", "y", "order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        size = 0
        for cell in _cells(batches, needed):
            for i, near in pick(cell):
                swap = cell.node[near] < cell.node[i]
                ends = [np.where(swap, v[near], v[i]) for v in (cell.node, cell.comp)] + [np.where(swap, v[i], v[near]) for v in (cell.node, cell.comp)]
                out.append(np.stack([ends[0], ends[2], ends[1], ends[3]], 1))
                size += len(near)
                if size > 1 << 16:
                    yield _pairs(out)
                    out, size = [], 0
        if out:
            yield _pairs(out)

    return materialize(rows.mapInArrow(run, "a long, b long, comp_a long, comp_b long").distinct())


def _pairs(out: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(out), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(4)], ["a", "b", "comp_a", "comp_b"])


def _blocks(multi: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of the first round: each bucket (key, node, members) cut into blocks."""
    block = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("members") / BLOCK)).cast("int")
    rows = multi.select("key", "node", block.alias("x")).join(classes.select("node", "n", "bytes"), "node")
    return rows.select("key", "x", F.col("x").alias("y"), F.col("x").alias("own"), "node", "n", F.col("node").alias("comp"), "bytes")


def _grid(multi: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of the later rounds: cells of the buckets that hold several components.

    A bucket of up to ``BLOCK`` classes, long ones counted by their shingles, is one cell. Of a larger one, the
    largest component is cut into blocks -1, -2, ... and the rest into 0, 1, ...:
    any two blocks meet in a cell, but for two of the largest component.
    """
    at = materialize(_with_comps(multi.select("key", "node", "n"), comps, "node"))
    weight = F.sum(1 + F.col("n") / SHINGLES)
    sizes = at.groupBy("key", "comp_node").agg(weight.alias("w")).groupBy("key")
    sizes = sizes.agg(F.count(F.lit(1)).alias("comps"), F.sum("w").alias("all"), F.max("w").alias("most"), F.max_by("comp_node", F.struct("w", "comp_node")).alias("top")).where("comps > 1")
    whole = F.col("all") <= BLOCK
    tops = F.when(whole, 0).otherwise(F.ceil(F.col("most") / BLOCK)).cast("int")
    rest = F.when(whole, 1).otherwise(F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("most")) / BLOCK))).cast("int")
    rows = at.join(sizes.select("key", "top", tops.alias("tops"), rest.alias("rest")), "key")
    in_top = (F.col("tops") > 0) & (F.col("comp_node") == F.col("top"))
    code = F.xxhash64("node", "key")
    own = F.when(in_top, -1 - F.pmod(code, F.greatest("tops", F.lit(1)))).otherwise(F.pmod(code, "rest")).cast("int")
    cell = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    others = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda h: F.when(in_top, cell(F.col("own"), h)).otherwise(cell(F.least("own", h), F.greatest("own", h))))
    above = F.when(in_top | (F.col("tops") == 0), F.array().cast("array<struct<x:int,y:int>>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest("tops", F.lit(1))), lambda g: cell(-g, F.col("own"))))
    rows = rows.withColumn("own", own).select("key", "node", "comp_node", "own", F.explode(F.concat(others, above)).alias("cell"))
    return rows.select("key", "cell.x", "cell.y", "own", "node", F.col("comp_node").alias("comp"))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Components ``a, b`` of those of ``pairs`` (a, b, comp_a, comp_b) whose full sets are similar enough."""
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "set": "set_a"}), "a").join(sets.withColumnsRenamed({"node": "b", "set": "set_b"}), "b").select("comp_a", "comp_b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= PERCENT * (len(both) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` of the nodes of ``links`` (a, b): equal ``comp`` for linked nodes.

    Each round maps every node to the least node within two steps, in the
    order of a hash that changes by the round, and contracts: stars vanish in one round, and
    the number of nodes falls by a constant factor in expectation, whatever the
    shape. A hub's links are merged before they meet.
    """
    edges = materialize(links.select("a", "b").distinct())
    labels, step = None, 0
    while not edges.isEmpty():
        step += 1
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(step)).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        near = ends.groupBy("node").agg(F.min(F.xxhash64("to", F.lit(step))).alias("h"), F.min_by("to", F.xxhash64("to", F.lit(step))).alias("to"))
        near = near.select("node", F.least(F.struct("h", F.col("to").alias("id")), rank("node")).alias("best"))
        near = materialize(near.select("node", "best.h", "best.id"))
        far = ends.join(near.select(F.col("node").alias("to"), "h", "id"), "to").groupBy("node").agg(F.min("h").alias("far_h"), F.min_by("id", "h").alias("far_id"))
        to = materialize(far.join(near, "node").select("node", F.when(F.col("far_h") < F.col("h"), F.col("far_id")).otherwise(F.col("id")).alias("comp")))
        moved = edges.join(to.withColumnsRenamed({"node": "a", "comp": "x"}), "a").join(to.withColumnsRenamed({"node": "b", "comp": "y"}), "b")
        edges = materialize(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if labels is None:
            labels = to
        else:
            labels = labels.join(to.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp", "left").select("node", F.coalesce("next", "comp").alias("comp"))
    return materialize(labels) if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def _with_comps(rows: DataFrame, comps: DataFrame, *names: str) -> DataFrame:
    """``rows`` with the component of each column named, the node itself where it has none."""
    for name in names:
        own = comps.select(F.col("node").alias("__node"), F.col("comp").alias("__comp"))
        rows = rows.join(own, F.col(name) == F.col("__node"), "left").withColumn(f"comp_{name}", F.coalesce("__comp", name)).drop("__node", "__comp")
    return rows


def _merged(comps: DataFrame, step: DataFrame) -> DataFrame:
    """``comps`` after its components were linked as ``step`` (node, comp) says."""
    moved = comps.join(step.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp", "left").select("node", F.coalesce("next", "comp").alias("comp"))
    return materialize(moved.union(step.join(comps.select("node"), "node", "left_anti").select("node", "comp")))


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows = materialize(signed(docs, size))
    classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    first = rows.where("node is not null").select("node", F.col("doc_id").alias("__id"), F.col("n_shingles").alias("n"), "bands", "bytes")
    classes = classes.join(first.withColumnRenamed("node", "__node"), (F.col("node") == F.col("__node")) & F.col("rep").eqNullSafe(F.col("__id"))).drop("__id", "__node")
    classes = materialize(classes.dropDuplicates(["node"]))
    keyed = classes.select("node", "n", F.explode("bands").alias("key"))
    members = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    multi = materialize(keyed.join(members, "key"))
    signed_classes = classes.select("node", "n", "bytes")
    tested = _named(_blocks(multi, classes), Cell.forest)
    comps = components(_links(tested, _sets_of(tested, classes, docs, size)))
    best = _named(_grid(multi, comps).join(signed_classes, "node"), Cell.best).join(tested.select("a", "b"), ["a", "b"], "left_anti")
    best = materialize(best)
    if not best.isEmpty():
        comps = _merged(comps, components(_links(best, _sets_of(best, classes, docs, size))))
    cells = materialize(_grid(multi, comps))
    if not cells.isEmpty():
        sets = _sets_of(cells.select("node"), classes, docs, size)
        full = classes.select("node", "n", "bytes", "bands").join(sets, "node")
        links = _named(cells.join(full, "node"), Cell.links)
        comps = _merged(comps, components(links.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))))
    named = classes.select("node", "rep", "copies")
    named = _with_comps(named, comps, "node")
    least = named.groupBy("comp_node").agg(F.min("rep").alias("component"))
    named = materialize(named.join(least, "comp_node").select("node", "component", "copies"))
    total = named.agg(F.sum("copies")).first()[0] or 0
    out = attach(rows.select("doc_id", "n_shingles", "node"), named, ["node"], "copies", total)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _sets_of(of: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``node, set`` (sorted hashes) of the classes in ``of`` (pairs a, b, or nodes), from the texts of their least ids."""
    nodes = (of if "node" in of.columns else of.select(F.col("a").alias("node")).union(of.select("b"))).select("node").distinct()
    wanted = classes.select("node", "rep").join(nodes, "node").select(F.col("rep").alias("__rep"), F.col("node").alias("__want"))
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("__rep"))).select("text", "__want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 512):
                sets, bounds = shingle_sets(texts_of(part), size)
                made = [sets[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                want = part.column(1).to_pylist()
                keep = [k for k, (w, s) in enumerate(zip(want, made, strict=True)) if xxhash.xxh3_64_intdigest(s) - (1 << 63) == w]
                yield pa.RecordBatch.from_arrays([pa.array([want[k] for k in keep], pa.int64()), pa.array([made[k] for k in keep], pa.binary())], ["node", "set"])

    return materialize(texts.mapInArrow(run, "node long, set binary").dropDuplicates(["node"]))
