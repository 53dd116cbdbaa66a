"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

A batch's new words become token-position rows, one per byte. A recursive
query joins neighbouring rows with the merge table and contracts each word's
leftmost pair of least rank until no pair merges. Occurrences of that pair
further on in the word are contracted in the same round where the merge table
shows that nothing could come between. Ordered aggregation spells the ids, and
decodes the ids of whole texts. Words recur, so a worker keeps what it has
coded, up to a bound. As the library does, a word that is a token is coded as
that token.

A query takes words of at most ``SYMBOLS`` bytes together, and so many rounds
that it holds at most ``ROWS`` rows; words that aren't done go on in the next
query, so memory is bounded by the longest word, whatever its length.

Null or empty text: no tokens, and empty bytes. Repeated rows are coded alike;
empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sievespark.llm.common import append_columns, texts_of
from sievespark.llm.words import SPACE, Ragged, Words

#: Coded chunks that a worker keeps (about 200 bytes each).
MOST_CACHED = 800_000
#: Bytes of the words of one query (a longer word has a query of its own), and rows that its rounds may add up to.
SYMBOLS = 1 << 18
ROWS = 8 << 20
#: Words of more bytes contract all occurrences of a pair in a round, which costs short ones more than it saves.
SHORT = 64
#: Ids that are decoded by one query; a longer text takes several.
IDS = 1 << 20

#: key: word number, then the place of the token's first byte in 32 bits. A word without a pair to merge passes once more, as done.
CONTRACT = """
CREATE OR REPLACE TEMP TABLE contracted AS
WITH RECURSIVE tokens(round, done, key, id) AS (
    SELECT 0, false, key, id FROM symbols
    UNION ALL
    (
        WITH pairs AS (
            SELECT round, key, id, lead(id) OVER spelling AS following, lead(key) OVER spelling AS next, lag(key) OVER spelling AS previous
            FROM tokens WHERE NOT done AND round < {rounds} WINDOW spelling AS (ORDER BY key)
        ), best AS (
            SELECT key >> 32 AS word, min((m.id::BIGINT << 32) | (key & 4294967295)) AS choice
            FROM pairs p JOIN merges m ON p.id = m.lhs AND p.following = m.rhs
            WHERE key >> 32 = next >> 32 GROUP BY key >> 32
        )
        SELECT p.round + 1, b.word IS NULL, p.key, CASE WHEN p.key & 4294967295 = b.choice & 4294967295 THEN (b.choice >> 32)::INT ELSE p.id END
        FROM pairs p LEFT JOIN best b ON p.key >> 32 = b.word
        WHERE b.word IS NULL OR p.previous IS NULL OR p.previous <> ((b.word << 32) | (b.choice & 4294967295))
    )
)
SELECT done, key, id FROM tokens WHERE done OR round = {rounds}
"""

#: The same for long words: the further occurrences of the chosen pair go with the leftmost, every other one of those that
#: overlap, unless a neighbour in the word could join the new token in a merge of lower rank, which would come first.
CONTRACT_ALL = """
CREATE OR REPLACE TEMP TABLE contracted AS
WITH RECURSIVE tokens(round, done, key, id) AS (
    SELECT 0, false, key, id FROM symbols
    UNION ALL
    (
        WITH pairs AS (
            SELECT round, key, id, lag(id) OVER spelling AS left_id, lead(id) OVER spelling AS following, lead(id, 2) OVER spelling AS right_id, lead(key) OVER spelling AS next
            FROM tokens WHERE NOT done AND round < {rounds} WINDOW spelling AS (ORDER BY key)
        ), merging AS (
            SELECT key, next, left_id, right_id, m.id AS merged FROM pairs p JOIN merges m ON p.id = m.lhs AND p.following = m.rhs WHERE key >> 32 = next >> 32
        ), best AS (
            SELECT key >> 32 AS word, min((merged::BIGINT << 32) | (key & 4294967295)) AS choice FROM merging GROUP BY key >> 32
        ), equal AS (
            SELECT g.*, b.word, g.key & 4294967295 = b.choice & 4294967295 AS leftmost FROM merging g JOIN best b ON g.key >> 32 = b.word AND g.merged = b.choice >> 32
        ), wary AS (
            SELECT DISTINCT word FROM equal e JOIN hasty h ON h.token = e.merged AND h.partner IN (e.merged, CASE WHEN h.on_right THEN e.right_id ELSE e.left_id END)
        ), numbered AS (
            SELECT key, next, merged, coalesce(lag(next) OVER places <> key, true) AS fresh, row_number() OVER places AS nth
            FROM equal e LEFT JOIN wary w ON e.word = w.word WHERE w.word IS NULL OR leftmost WINDOW places AS (ORDER BY key)
        ), chosen AS (
            SELECT key, next, merged FROM (SELECT *, max(CASE WHEN fresh THEN nth END) OVER (ORDER BY key) AS start FROM numbered) WHERE (nth - start) % 2 = 0
        )
        SELECT p.round + 1, b.word IS NULL, p.key, coalesce(c.merged, p.id)
        FROM pairs p LEFT JOIN best b ON p.key >> 32 = b.word LEFT JOIN chosen c ON p.key = c.key LEFT JOIN chosen gone ON p.key = gone.next
        WHERE gone.next IS NULL
    )
)
SELECT done, key, id FROM tokens WHERE done OR round = {rounds}
"""

SPELL = "SELECT key >> 32 AS word, array_to_string(list(id ORDER BY key), ',') AS ids FROM contracted WHERE done GROUP BY key >> 32"

DECODE = """
SELECT row, unhex(array_to_string(list(v.hex ORDER BY t.pos), '')) AS decoded
FROM ids t JOIN vocabulary v ON v.id = t.id GROUP BY row
"""


class Codec:
    """Ranks, merge table and DuckDB of one worker."""

    def __init__(self, ranks: str, pattern: str) -> None:
        import duckdb
        import regex

        with open(ranks, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split, self.cuttable = regex.compile(pattern).findall, pattern == SPACED
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.most = max(self.ranks.values())
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        columns = [pa.array(c, pa.int32()) for c in zip(*merges, strict=True)]
        self.table("merges", pa.table({"lhs": columns[0], "rhs": columns[1], "id": columns[2]}))
        hasty = [(a, b, True) for a, b, r in merges if a > r] + [(b, a, False) for a, b, r in merges if b > r]
        self.table("hasty", pa.Table.from_pylist([dict(zip(("token", "partner", "on_right"), h, strict=True)) for h in hasty], pa.schema({"token": pa.int32(), "partner": pa.int32(), "on_right": pa.bool_()})))
        self.table("vocabulary", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": pa.array([t.hex() for t in self.ranks])}))
        #: of coded chunks: ids, each followed by a comma
        self.chunks = Ragged(1)

    def table(self, name: str, rows: pa.Table) -> None:
        self.db.register("rows_in", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS FROM rows_in")
        self.db.unregister("rows_in")

    def contract(self, words: list[str]) -> list[str]:
        """Ids of each word, joined by commas."""
        data = [w.encode() for w in words]
        out = [str(r) if (r := self.ranks.get(d)) is not None else "" for d in data]
        rows = sorted((i for i, ids in enumerate(out) if not ids), key=lambda i: len(data[i]))
        sizes = np.array([len(data[i]) for i in rows], np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(rows):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SYMBOLS, "right"))
            if at < (short := int(np.searchsorted(sizes, SHORT, "right"))):
                to = min(to, short)
            to = max(at + 1, to)
            self.contracted([data[i] for i in rows[at:to]], rows[at:to], out)
            at = to
        return out

    def contracted(self, words: list[bytes], rows: list[int], out: list[str]) -> None:
        """Puts the ids of ``words`` into their ``rows`` of ``out``; the longest word is the last."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = (np.repeat(np.arange(len(words)), sizes) << 32) | place
        self.table("symbols", pa.table({"key": key, "id": self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]}))
        if (large := 400 * len(key)) > 400_000_000:
            self.db.execute(f"SET memory_limit = '{large}B'")
        query = CONTRACT if sizes[-1] <= SHORT else CONTRACT_ALL
        left = len(key)
        while left:
            self.db.execute(query.format(rounds=max(1, ROWS // left)))
            spelled = self.db.sql(SPELL).to_arrow_table()
            for word, ids in zip(spelled.column(0).to_pylist(), spelled.column(1).to_pylist(), strict=True):
                out[rows[word]] = ids
            left = self.db.execute("CREATE OR REPLACE TEMP TABLE symbols AS SELECT key, id FROM contracted WHERE NOT done").fetchone()[0]

    def learn(self, keys: list[int], chunks: list[str]) -> None:
        split = [self.split(c) for c in chunks]
        words = list(set().union(*split))
        coded = dict(zip(words, self.contract(words), strict=True))
        self.chunks.add(keys, [[(",".join([coded[w] for w in s]) + ",").encode() for s in split]])

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text, joined by commas."""
        odd = {i: self.split(t.decode("utf-8", "replace")) for i, t in enumerate(texts) if t and not (self.cuttable and cuttable(t))}
        if odd:
            own = list(set().union(*odd.values()))
            coded = dict(zip(own, self.contract(own), strict=True))
            odd = {i: ",".join([coded[w] for w in s]).encode() for i, s in odd.items()}
        words = Words([None if i in odd else t for i, t in enumerate(texts)], SPACE)
        bare = np.isin(words.starts, words.text_starts)
        distinct, at, back = np.unique(words.hashes() ^ bare.astype(np.uint64), return_index=True, return_inverse=True)
        if len(self.chunks.rows) + len(distinct) > MOST_CACHED:
            self.chunks.clear()
        keys, get = distinct.tolist(), self.chunks.rows.get
        new = [i for i, k in enumerate(keys) if get(k) is None]
        self.learn([keys[i] for i in new], [" " * (not bare[at[i]]) + words.word(at[i]).decode("utf-8", "replace") for i in new])
        rows = np.fromiter(map(self.chunks.rows.__getitem__, keys), np.int64, len(keys))[back]
        flat, sizes = self.chunks.gather(0, rows)
        flat, ends = flat.tobytes(), np.concatenate(([0], np.cumsum(sizes)))[words.first].tolist()
        return [odd[i] if i in odd else flat[ends[i] : max(ends[i], ends[i + 1] - 1)] for i in range(len(texts))]

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        """The bytes that lists of ids stand for."""
        pieces = [(i, ids[k : k + IDS]) for i, ids in enumerate(lists) for k in range(0, len(ids), IDS)]
        parts: list[list[bytes]] = [[] for _ in lists]
        at = 0
        while at < len(pieces):
            to, held = at, 0
            while to < len(pieces) and (to == at or held + len(pieces[to][1]) <= IDS):
                held += len(pieces[to][1])
                to += 1
            sizes = [len(ids) for _, ids in pieces[at:to]]
            ids = np.concatenate([ids for _, ids in pieces[at:to]]).astype(np.int32)
            self.db.register("ids", pa.table({"row": np.repeat(np.arange(to - at, dtype=np.int32), sizes), "pos": np.arange(held, dtype=np.int32), "id": ids}))
            if self.db.execute("SELECT count(*) FROM ids t ANTI JOIN vocabulary v ON v.id = t.id").fetchone()[0]:
                raise ValueError("an id that the vocabulary doesn't have")
            for row, decoded in sorted(self.db.execute(DECODE).fetchall()):
                parts[pieces[at + row][0]].append(bytes(decoded))
            self.db.unregister("ids")
            at = to
        return [b"".join(p) for p in parts]


#: A fixed value: the pattern of which a match holds a space in its first place only, unless it is a run of white space.
#: So a text without such runs can be cut before each space, and the chunks are split as the whole is.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII_RUNS = [bytes([c]) + b" " for c in (0x20, *range(0x09, 0x0E), *range(0x1C, 0x20))]
_WIDE_RUNS = re.compile(rb"(?:\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80) ").search


def cuttable(text: bytes) -> bool:
    """Whether no space follows white space or ends the text."""
    return not (text[-1:] == b" " or any(run in text for run in _ASCII_RUNS) or (not text.isascii() and _WIDE_RUNS(text)))


def ids_of(joined: bytes) -> np.ndarray:
    """The ids in a list joined by commas."""
    return np.fromstring(joined.decode(), np.int32, sep=",") if joined else np.empty(0, np.int32)


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(ranks: str, pattern: str) -> Codec:
    if (ranks, pattern) not in _codecs:
        _codecs[ranks, pattern] = Codec(ranks, pattern)
    return _codecs[ranks, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``docs`` with ``tokens`` (array of ids), from ``text``; ``ranks``: path of the rank file on every machine."""

    def run(batch: pa.RecordBatch) -> list:
        return [[ids_of(ids) for ids in _codec(ranks, pattern).encode(texts_of(batch))]]

    return append_columns(docs, [T.StructField("tokens", T.ArrayType(T.IntegerType(), False))], run)


def decode(rows: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``rows`` with ``decoded`` (binary), from ``tokens``; null tokens: empty."""

    def run(batch: pa.RecordBatch) -> list:
        lists = batch.column(batch.schema.get_field_index("tokens")).to_pylist()
        return [_codec(ranks, pattern).decode([np.array(x or (), np.int64) for x in lists])]

    return append_columns(rows, [T.StructField("decoded", T.BinaryType())], run)


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each document: encode, then decode the ids; a map without shuffle."""

    def run(batch: pa.RecordBatch) -> list:
        codec, sha = _codec(ranks, pattern), hashlib.sha256
        coded = codec.encode(texts_of(batch))
        lists = [ids_of(ids) for ids in coded]
        return [[len(x) for x in lists], [sha(ids).hexdigest() for ids in coded], [sha(b).hexdigest() for b in codec.decode(lists)]]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return append_columns(docs, fields, run, needs=["doc_id", "text"]).drop("text")
