"""Scanners and views that built-in functions can't express, as Arrow-batched functions."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sievespark import schema as S
from sievespark.functions import tables, unicode as U


#: White space is Unicode's, to which Python's class adds U+001C to U+001F.
_host = re.compile("https?://([^/?#<>\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*)")


def mixed_hosts(spark: SparkSession):
    """string -> the hosts of its URLs that are non-ASCII and in no single script; null for null."""
    shared = spark.sparkContext.broadcast(U.script_sets(spark))

    def beginnings(host: str):
        """The host, and what is left of it without closing punctuation, which is no part of a URL."""
        while host:
            yield host
            host = host[:-1] if host[-1] in ".,;:!?\"')" else ""

    @F.pandas_udf("array<string>")
    def judge(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else sorted({h for m in _host.finditer(t) for h in beginnings(m[1]) if not h.isascii() and not U.single_script(h, shared.value)}))

    return judge


def folded(spark: SparkSession):
    """string -> its look-alike skeleton; null for ASCII text and text in a single script."""
    alike, sets = spark.sparkContext.broadcast(U.prototypes(spark)), spark.sparkContext.broadcast(U.script_sets(spark))

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None or t.isascii() or U.single_script(t, sets.value) else U.skeleton(t, alike.value))

    return fold


def contained_phrases(phrases: tuple[str, ...], threshold: float):
    """string (normalised) -> the indices of the phrases whose distinct byte trigrams it holds to a share of ``threshold``, and 4 at least; null for null."""
    data = [re.sub(r"\s+", " ", p.lower()).strip().encode() for p in phrases]
    own = [{int.from_bytes(d[i : i + 3]) for i in range(len(d) - 2)} for d in data]
    grams = np.array(sorted(set().union(*own)), np.int64)
    member = np.array([[g in o for o in own] for g in grams.tolist()], bool).reshape(len(grams), len(own))
    sizes = np.array([max(1, len(o)) for o in own], np.float32)
    known: list[np.ndarray] = []

    def of(text: str | None) -> list[int] | None:
        if text is None:
            return None
        if not known:
            known.append(np.zeros(1 << 24, bool))
            known[0][grams] = True
        b = np.frombuffer(text.encode(), np.uint8).astype(np.int32)
        codes = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        met = member[np.searchsorted(grams, np.unique(codes[known[0][codes]]))].sum(0)
        return np.flatnonzero((met >= 4) & (met.astype(np.float32) / sizes >= np.float32(threshold))).tolist()

    @F.pandas_udf("array<int>")
    def contained(texts: pd.Series) -> pd.Series:
        return texts.map(of, na_action="ignore") if len(texts) else pd.Series([], dtype=object)

    return contained


def links(text: str):
    """(start, end, visible, url) of ``[visible](url)``; parentheses in the url balance, and it holds no white space."""
    at = 0
    while (begin := text.find("[", at)) >= 0:
        close = text.find("]", begin + 1)
        if close < 0:
            return
        if text[close + 1 : close + 2] != "(":
            at = close + 1
            continue
        depth, end = 1, None
        for k in range(close + 2, len(text)):
            c = text[k]
            if c in " \t\r\n":
                break
            depth += (c == "(") - (c == ")")
            if not depth:
                end = k
                break
        if end is None:
            at = begin + 1
            continue
        if close > begin + 1 and end > close + 2:
            yield begin, end + 1, text[begin + 1 : close], text[close + 2 : end]
        at = end + 1


_domain = re.compile(tables.DOMAIN)


def host_of(url: str) -> str | None:
    for scheme in ("https://", "http://", "//"):
        if url.startswith(scheme):
            url = url[len(scheme) :]
            break
    host = re.split("[/?#]", url, maxsplit=1)[0].rsplit("@", 1)[-1].split(":", 1)[0]
    return host if "." in host else None


def same_site(a: str, b: str) -> bool:
    """Whether the last two labels are equal; a name without two labels is no one's."""
    x, y = a.rsplit(".", 2)[-2:], b.rsplit(".", 2)[-2:]
    return len(x) == len(y) == 2 and [p.lower() for p in x] == [p.lower() for p in y]


@dataclass(frozen=True)
class MarkdownLinkSmuggle:
    """Links whose text shows another site than they lead to."""

    name: str = "markdown_link_smuggle"

    def matches(self, text: Column) -> Column:
        @F.pandas_udf("array<struct<start:int,end:int,text:string>>")
        def spans(texts: pd.Series) -> pd.Series:
            def of(t: str | None):
                if t is None:
                    return None
                out = []
                for a, b, visible, url in links(t):
                    shown, host = _domain.search(visible), host_of(url)
                    if shown and host and not same_site(shown[0], host):
                        begin = len(t[:a].encode())
                        out.append({"start": begin, "end": begin + len(t[a:b].encode()), "text": t[a:b]})
                return out

            return texts.map(of)

        found = F.transform(spans(F.when(text.contains("]("), text)), lambda s: S.match(self.name, F.lit("domain_mismatch"), s["start"], s["end"], s["text"], S.HIGH, S.BLOCK))
        return F.coalesce(found, F.when(text.isNotNull(), S.no_matches()))

    def native(self, text: Column) -> Column:
        raise TypeError("links are read in Python, which can't be called for decoded runs: switch base64 off")


@dataclass(frozen=True)
class OnnxScan:
    """A binary ONNX classifier over the whole text: a match where class 1 reaches ``threshold``.

    ``model`` and ``tokenizer`` are paths on every machine; files that don't load
    raise at construction. A worker opens its session once and runs texts of
    like length together. What fails at run time is no match; see
    :meth:`scores` for the status.
    """

    model: str
    tokenizer: str
    threshold: float = 0.5
    severity: int = S.WARN
    confidence: int = S.MEDIUM
    name: str = "onnx_scanner"
    pattern: str = "prompt_injection"
    max_seq_len: int = 512
    providers: tuple[str, ...] = ("CPUExecutionProvider",)

    def __post_init__(self) -> None:
        object.__setattr__(self, "threshold", min(1.0, max(0.0, self.threshold)))
        open_session(self)

    def scores(self, text: Column) -> Column:
        """``struct<score: float, status: string>``; status is ok, or what failed."""
        spec = self

        @F.pandas_udf("score float, status string")
        def run(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(_classify(spec, texts.tolist()), columns=["score", "status"])

        return run(text)

    def matches(self, text: Column) -> Column:
        hit = S.match(self.name, F.lit(self.pattern), F.lit(0), F.octet_length(text), text, self.confidence, self.severity)
        return F.when(self.scores(text)["score"] >= F.lit(self.threshold).cast("float"), F.array(hit)).when(text.isNotNull(), S.no_matches())


#: Tokens, padding included, that go through the model together.
TOKENS_AT_ONCE = 8192
_sessions: dict = {}


def open_session(spec: OnnxScan):
    """The tokenizer and the session of a process; raises where a file doesn't load."""
    key = (spec.model, spec.tokenizer, spec.providers)
    if key not in _sessions:
        import onnxruntime
        from tokenizers import Tokenizer

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        _sessions[key] = (Tokenizer.from_file(spec.tokenizer), onnxruntime.InferenceSession(spec.model, options, providers=list(spec.providers)))
    return _sessions[key]


def softmax_binary(a: float, b: float) -> float:
    """Probability of the second of two logits, in single precision."""
    x = np.array([a, b], np.float32)
    e = np.exp(x - x.max())
    return float(e[1] / e.sum())


def _classify(spec: OnnxScan, texts: list[str | None]) -> list[tuple[float | None, str | None]]:
    """Score and status of each text; a batch that fails is tried again text by text."""
    out: list[tuple[float | None, str | None]] = [(None, None)] * len(texts)
    encoded: dict[int, tuple[list[int], list[int]]] = {}
    for i, text in enumerate(texts):
        if isinstance(text, str):
            try:
                e = open_session(spec)[0].encode(text)
                encoded[i] = (e.ids[: spec.max_seq_len], e.attention_mask[: spec.max_seq_len])
                out[i] = (0.0, "empty")
            except Exception as error:  # the contract: a classifier that fails lets the text pass, and says so
                out[i] = (None, f"{type(error).__name__}: {error}")
    order = sorted((i for i, (ids, _) in encoded.items() if ids), key=lambda i: len(encoded[i][0]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(encoded[order[to]][0]) <= TOKENS_AT_ONCE:
            to += 1
        chosen, at = order[at:to], to
        try:
            made = _run(spec, [encoded[i] for i in chosen])
        except Exception:
            made = []
            for i in chosen:
                try:
                    made += _run(spec, [encoded[i]])
                except Exception as error:
                    made.append((None, f"{type(error).__name__}: {error}"))
        for i, result in zip(chosen, made, strict=True):
            out[i] = result
    return out


def _run(spec: OnnxScan, rows: list[tuple[list[int], list[int]]]) -> list[tuple[float | None, str]]:
    """Rows padded at the end, under a mask of 0, to the length of the longest."""
    width = max(len(ids) for ids, _ in rows)
    ids, mask = (np.array([r[k] + [0] * (width - len(r[k])) for r in rows], np.int64) for k in (0, 1))
    logits = np.asarray(open_session(spec)[1].run(None, {"input_ids": ids, "attention_mask": mask})[0])
    if logits.ndim < 2 or logits.shape[-1] != 2:
        return [(None, "unexpected output shape")] * len(rows)
    return [(softmax_binary(*pair), "ok") for pair in logits.reshape(len(rows), -1)[:, :2]]
