"""Packing token pieces into sequences: best-fit decreasing over a length histogram.

Texts are tokenized, an end token is added and only what is longer than a
sequence is cut. Lengths are small whole numbers, so best-fit decreasing over
all pieces is worked out on the driver from a histogram of at most ``capacity``
rows, whatever the number of documents: equal pieces are placed in runs, and a
segment tree over the remaining capacities finds the tightest open bins in
logarithmic time. The plan says where the r-th piece of each length goes. The
pieces get their ranks r by counts per (length, salt), so that a length that
many documents share is ranked by many tasks.

Null or empty text: a piece that holds the end token alone. Equal documents get
places of their own. A repeated ``doc_id`` is packed as often as it occurs.
Empty tables give no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sievespark.llm.common import bound_batches, materialize, partitions, slices, texts_of
from sievespark.llm.words import Ragged, Words

CAPACITY = 4096
END_TOKEN = 1
#: Words that a worker keeps (about 200 bytes each).
MOST_CACHED = 800_000

#: Longer runs between spaces, which text hardly has, go to the tokenizer one by one.
MOST_WORD_BYTES = 64

#: Outside of these, letters may be composed, folded or spaced in ways that only the tokenizer's own normaliser knows.
_unusual = re.compile("[^\t\n\r -~¡-įı-ɏ‐-‧]")
_controls = re.compile(b"[^\t\n\r -~]")
_NONE = np.uint32(0xFFFFFFFF)


class PairTable:
    """(left id, right id) -> rank of the merge, for arrays of pairs; open addressing in numpy."""

    def __init__(self, pairs: np.ndarray) -> None:
        keys = (pairs[:, 0].astype(np.uint64) << np.uint64(32)) | pairs[:, 1].astype(np.uint64)
        self.bits = max(8, (16 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(1 << self.bits, _NONE)
        todo, at = np.arange(len(keys)), self.slot(keys)
        while len(todo):
            _, first = np.unique(at, return_index=True)
            first = first[self.ranks[at[first]] == _NONE]
            self.keys[at[first]], self.ranks[at[first]] = keys[todo[first]], todo[first]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)).ravel()
        at = self.slot(keys)
        out = np.where(self.keys[at] == keys, self.ranks[at], _NONE)
        todo = np.flatnonzero((self.ranks[at] != _NONE) & (self.keys[at] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at[todo]] == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (self.ranks[at[todo]] != _NONE)]
        return out.reshape(left.shape)


class WordTokens:
    """word -> little-endian ids, as the library ``tokenizers`` gives them.

    Its normaliser and splitter work within runs between spaces, so a word's
    ids don't depend on its neighbours and are kept, by a 64-bit hash of the word
    (two of 800,000 words share one with probability 2e-8). The words that a batch of
    texts adds go through the file's merges together, one merge of each word at
    a time. Texts with unusual characters or one of the file's added tokens, and
    long words, go to the library, and so does everything if the file's
    normaliser or splitters aren't those that this rests on.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Ragged(1)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_words = rests_on_words(spec)
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))).encode(), re.IGNORECASE) if added else None
        if not self.by_words:
            return
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.split = regex.compile(next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]).findall
        self.pairs = PairTable(np.array([(vocab[a], vocab[b]) for a, b in merges], np.uint32).reshape(-1, 2))
        self.made = np.array([vocab[a + b] for a, b in merges], np.uint32)
        end = spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.inner, self.last = (np.array([vocab[c + e] for c in letters], np.uint32) for e in ("", end))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merged(self, units: list[bytes]) -> list[bytes]:
        """Ids of units of 1 to ``MOST_WORD_BYTES`` bytes that the splitter leaves whole."""
        out: list[bytes] = [b""] * len(units)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        for width in np.unique(sizes):
            own = np.flatnonzero(sizes == width)
            rows = np.frombuffer(b"".join([units[i] for i in own]), np.uint8).reshape(len(own), width)
            ids = self.inner[rows]
            ids[:, -1] = self.last[rows[:, -1]]
            while len(own):
                if ids.shape[1] == 1:
                    done = np.ones(len(own), bool)
                else:
                    ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
                    at = ranks.argmin(1)
                    rank = ranks[np.arange(len(own)), at]
                    done = rank == _NONE
                for i, row in zip(own[done].tolist(), ids[done].astype("<u4"), strict=True):
                    out[i] = row.tobytes()
                if done.all():
                    break
                own, ids, at, rank = own[~done], ids[~done], at[~done], rank[~done]
                places = np.arange(ids.shape[1] - 1)
                rest = np.take_along_axis(ids, places + (places > at[:, None]), 1)
                rest[np.arange(len(own)), at] = self.made[rank]
                ids = rest
        return out

    def learn(self, keys: list[int], words: list[bytes]) -> None:
        lowered = [w.decode().lower() for w in words]
        split = [[w] if w.isalpha() else self.split(w) for w in lowered]
        units = set().union(*split)
        short = [(u, c) for u in units if len(c := u.encode()) <= MOST_WORD_BYTES]
        ids = dict(zip([u for u, _ in short], self.merged([c for _, c in short]), strict=True))
        if len(ids) < len(units):
            ids |= {u: self.whole(u) for u in units if u not in ids}
        self.known.add(keys, [[ids[s[0]] if len(s) == 1 else b"".join([ids[u] for u in s]) for s in split]])

    def odd(self, text: bytes) -> bool:
        """Whether the text has to go to the library."""
        return not self.by_words or is_unusual(text) or (self.added is not None and self.added.search(text) is not None)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian ids of each text, without an end token."""
        odd = {i: self.whole(t.decode("utf-8", "replace")) for i, t in enumerate(texts) if t and self.odd(t)}
        words = Words([None if i in odd else t for i, t in enumerate(texts)])
        distinct, at, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.known.rows) + len(distinct) > MOST_CACHED:
            self.known.clear()
        keys, get = distinct.tolist(), self.known.rows.get
        new = [i for i, k in enumerate(keys) if get(k) is None]
        self.learn([keys[i] for i in new], [words.word(at[i]) for i in new])
        rows = np.fromiter(map(self.known.rows.__getitem__, keys), np.int64, len(keys))
        flat, sizes = self.known.gather(0, rows[back])
        flat = flat.tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes)))[words.first].tolist()
        return [odd[i] if i in odd else flat[ends[i] : ends[i + 1]] for i in range(len(texts))]


def rests_on_words(spec: dict) -> bool:
    """Whether the file lower-cases, splits at white space and by one pattern, and merges bytes to words with an end-of-word suffix."""

    def kinds(part: dict | None, inner: str) -> list[str]:
        part = part or {}
        return [k for p in part.get(inner, ()) for k in kinds(p, inner)] if part.get("type") == "Sequence" else [part.get("type", "")]

    model = spec["model"]
    normal = kinds(spec.get("normalizer"), "normalizers")
    splits = kinds(spec.get("pre_tokenizer"), "pretokenizers")
    plain = not model.get("dropout") and not model.get("continuing_subword_prefix") and model.get("end_of_word_suffix")
    return normal == ["NFC", "Replace", "Lowercase"] and splits == ["Split", "ByteLevel"] and model["type"] == "BPE" and bool(plain)


def is_unusual(text: bytes) -> bool:
    if text.isascii():
        return _controls.search(text) is not None
    return _unusual.search(text.decode("utf-8", "replace")) is not None


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(0x100 + len(letters) - len(printable))
    return [letters[b] for b in range(256)]


_tokens: dict[str, WordTokens] = {}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each piece of each document; ``tokenizer``: path of its file on every machine."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long").fields])
    end = np.array([end_token], "<u4").tobytes()
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _tokens:
            _tokens[tokenizer] = WordTokens(tokenizer)
        encode = _tokens[tokenizer].encode
        for batch in batches:
            for part in slices(batch, 2048):
                at, out = [], []
                for row, ids in enumerate(encode(texts_of(part))):
                    ids = memoryview(ids + end)
                    for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[i : i + 4 * capacity]
                        at.append(row)
                        out.append((k, i // 4, len(piece) // 4, zlib.crc32(piece)))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *columns], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class CapacityTree:
    """A segment tree over remaining capacities: which of them have open bins."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def put(self, capacity: int, value: bool) -> None:
        at = capacity + self.size
        self.any[at] = value
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, need: int) -> int:
        """The least capacity of at least ``need`` that has an open bin, or -1."""
        at = need + self.size
        while not self.any[at]:
            while at & 1:  # a right child: its parent's right neighbour comes next
                at >>= 1
                if at <= 1:
                    return -1
            at += 1
        while at < self.size:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Best-fit decreasing of ``histogram[length]`` items of each length.

    Returns runs ``(length, first rank, items, items a bin, first bin, offset)``
    and the number of bins. Open bins of equal remaining capacity are kept as
    runs of neighbouring bins; the tightest bin for an item stays the tightest
    for its equals until it is full, so a run takes them bin by bin, exactly as
    one item at a time would.
    """
    tree = CapacityTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def add(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in open_bins or not open_bins[room]:
                open_bins[room] = []
                tree.put(room, True)
            open_bins[room].append((first, count))

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                fit = capacity // length
                first, count, room = bins, -(-left // fit), capacity
                bins += count
            else:
                first, count = open_bins[room].pop()
                if not open_bins[room]:
                    tree.put(room, False)
            fit = room // length
            full = min(count, left // fit)
            for n_bins, each in ((full, fit), (1, left - full * fit if full < count else 0)):
                if n_bins and each:
                    runs.append((length, rank, n_bins * each, each, first, capacity - room))
                    add(room - each * length, first, n_bins)
                    first, count, rank, left = first + n_bins, count - n_bins, rank + n_bins * each, left - n_bins * each
            add(room, first, count)
    return np.array(runs, np.int64).reshape(-1, 6), bins


def place(runs: np.ndarray, length: np.ndarray, rank: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of items by their length and their rank among equals."""
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    starts = np.searchsorted(runs[:, 0], np.arange(capacity + 2))
    at = np.empty(len(length), np.int64)
    for n in np.unique(length):
        own = length == n
        lo, hi = starts[n], starts[n + 1]
        at[own] = lo + np.searchsorted(runs[lo:hi, 1], rank[own], "right") - 1
    run = runs[at]
    within = rank - run[:, 1]
    return run[:, 4] + within // run[:, 3], run[:, 5] + within % run[:, 3] * run[:, 0]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a table that can be read again) with ``sequence_id`` and ``offset``.

    The driver gets at most ``capacity`` counts; the plan it broadcasts has a
    few runs for each of them.
    """
    spark = pieces.sparkSession
    histogram = {int(n): c for n, c in pieces.groupBy("length").count().collect()}
    runs, _ = best_fit_decreasing(histogram, capacity)
    plan = spark.sparkContext.broadcast(runs)
    salts = 4 * partitions(spark)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "__salt").count()
    before = counts.withColumn("__before", F.sum("count").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "__salt", F.coalesce("__before", F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("__within", within).join(before.hint("shuffle_merge"), ["length", "__salt"])
    ranked = ranked.select(*pieces.columns, (F.col("__before") + F.col("__within")).cast("long").alias("__rank"))
    schema = T.StructType([*pieces.schema.fields, *T.StructType.fromDDL("sequence_id long, offset long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            bins, offset = place(plan.value, batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False), rank, capacity)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bins), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """Tokenize, cut and pack ``docs``; the pieces are written once, so no text is tokenized twice."""
    return pack(materialize(token_pieces(docs, tokenizer, capacity, end_token)), capacity)
