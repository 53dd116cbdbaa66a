"""Scanners: each turns a string column into an array of matches, in built-in functions.

``matches(null)`` is null. Array order is pattern order, then position. Cheap
conditions that every hit implies keep the regexes away from most texts.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sievespark import schema as S
from sievespark.functions import tables, text as X
from sievespark.functions.positions import any_of, bound, find_all, find_each


class Scanner(Protocol):
    name: str

    def matches(self, text: Column) -> Column: ...


def _each(spans: Column, make) -> Column:
    return F.transform(spans, make)


def _named(scanner: str, pattern: str, confidence: int, severity: int):
    """span -> match of a fixed pattern."""
    return lambda s: S.match(scanner, F.lit(pattern), s["start"], s["end"], s["text"], confidence, severity)


def _graded(scanner: str, spans: Column, grades: list[tuple[str, int, int]]) -> Column:
    """Matches of the spans of several patterns, each with its own id, confidence and severity."""
    table = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(c).alias("c"), F.lit(s).alias("s")) for k, c, s in grades])
    one = lambda g: lambda s: S.match(scanner, g["id"], s["start"], s["end"], s["text"], g["c"], g["s"])
    return F.flatten(F.zip_with(spans, table, lambda found, g: F.transform(found, one(g))))


def _session() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active session to read the Unicode tables with")
    return spark


def _either(c: str) -> str:
    return c.upper() + c.lower() if c.isascii() and c.isalpha() else re.sub(r"([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E])", r"\\\1", c)


def phrase_regex(phrases: tuple[str, ...]) -> str:
    """A regex of ASCII case-insensitive phrases, of which the first in the table wins at a place: a tree by shared beginnings.

    A phrase that begins with one before it in the table can't win, so it is left out.
    """
    root: dict = {}
    for phrase in phrases:
        at, dead = root, False
        for c in _ascii_lower(phrase):
            dead = dead or None in at
            at = at.setdefault(c, {}) if not dead else {}
        if not dead:
            at[None] = True  # what is below has come before

    def spelt(node: dict) -> str:
        parts = [f"[{_either(c)}]" + spelt(below) for c, below in node.items() if c is not None]
        if None in node:
            parts.append("")
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return "(?=[" + "".join(map(_either, root)) + "])" + spelt(root)


def covering(phrases: tuple[str, ...], least: int = 6) -> tuple[str, ...]:
    """A few lower-case pieces, such that each phrase holds one of them."""
    left, out = {_ascii_lower(p) for p in phrases}, []
    while left:
        pieces = Counter(q for p in left for q in {p[i : i + least] for i in range(max(1, len(p) - least + 1))})
        out.append(max(pieces, key=lambda q: (pieces[q], len(q), q)))
        left = {p for p in left if out[-1] not in p}
    return tuple(out)


@dataclass(frozen=True)
class BanSubstrings:
    """Hits of literal phrases, ASCII case-insensitive, leftmost first in table order; no word boundary."""

    name: str
    patterns: tuple[str, ...]
    severity: int = S.WARN
    confidence: int = S.MEDIUM

    def matches(self, text: Column) -> Column:
        if not self.patterns or "" in self.patterns:
            raise ValueError("phrases must not be empty")
        gate = any_of(text, covering(self.patterns), lower=True) if all(p.isascii() for p in self.patterns) else None
        spans = find_all(text, phrase_regex(self.patterns), gate)
        entries: dict[str, str] = {}
        for p in self.patterns:
            entries.setdefault(_ascii_lower(p), p)
        names = F.create_map(*[F.lit(v) for e in entries.items() for v in e])
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        return _each(spans, lambda s: S.match(self.name, F.element_at(names, F.translate(s["text"], upper, lower)), s["start"], s["end"], s["text"], self.confidence, self.severity))


def _ascii_lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def ban_code() -> BanSubstrings:
    return BanSubstrings("ban_code", tables.CODE_MARKERS)


def role_override() -> BanSubstrings:
    return BanSubstrings("role_override", tables.ROLE_MARKERS, S.BLOCK, S.HIGH)


def injection_phrases() -> BanSubstrings:
    return BanSubstrings("injection", tables.INJECTION_PHRASES, S.BLOCK, S.HIGH)


def identity_leaks() -> BanSubstrings:
    return BanSubstrings("identity_leak", tables.IDENTITY_LEAKS)


@dataclass(frozen=True)
class InvisibleText:
    """One match per invisible character."""

    name: str = "invisible_text"

    def matches(self, text: Column) -> Column:
        chars = tuple(c for c, _ in tables.INVISIBLE)
        spans = find_all(text, "[" + "".join(chars) + "]", (F.octet_length(text) > F.char_length(text)) & any_of(text, chars))
        names = F.create_map(*[F.lit(v) for e in tables.INVISIBLE for v in e])
        return _each(spans, lambda s: S.match(self.name, F.element_at(names, s["text"]), s["start"], s["end"], s["text"], S.HIGH, S.BLOCK))


@dataclass(frozen=True)
class TokenLimit:
    """The tail beyond a number of characters; 0 disables."""

    limit: int
    name: str = "token_limit"

    def matches(self, text: Column) -> Column:
        if self.limit <= 0:
            return F.when(text.isNotNull(), S.no_matches())
        start = F.octet_length(F.left(text, F.lit(self.limit)))
        hit = S.match(self.name, F.lit("overflow"), start, F.octet_length(text), F.substring(text, self.limit + 1, 2**31 - 1), S.HIGH, S.BLOCK)
        return F.when(F.char_length(text) > self.limit, F.array(hit)).when(text.isNotNull(), S.no_matches())


@dataclass(frozen=True)
class RegexPattern:
    """A caller's Java regex. Java backtracks, so a pattern should not be able to explode.

    ``holds``: substrings of which every hit holds one, for a cheap test before the regex.
    """

    id: str
    regex: str
    severity: int = S.WARN
    confidence: int = S.MEDIUM
    holds: tuple[str, ...] = ()


@dataclass(frozen=True)
class RegexScan:
    """All hits of each pattern in turn, empty ones included where they don't touch the hit before. Patterns are compiled at construction."""

    name: str
    patterns: tuple[RegexPattern, ...]

    def __post_init__(self) -> None:
        spark = SparkSession.getActiveSession()
        for p in self.patterns:
            if spark is not None:
                spark.sparkContext._jvm.java.util.regex.Pattern.compile(p.regex)
            else:
                re.compile(p.regex)

    def matches(self, text: Column) -> Column:
        # no hit begins within a character that Java writes as two units
        whole = lambda p: f"(?![\\x{{DC00}}-\\x{{DFFF}}])(?:{p.regex})"
        if not self.patterns:
            return F.when(text.isNotNull(), S.no_matches())
        spans = find_each(text, [(whole(p), any_of(text, p.holds) if p.holds else None) for p in self.patterns])
        return _graded(self.name, spans, [(p.id, p.confidence, p.severity) for p in self.patterns])


@dataclass(frozen=True)
class Repetition:
    """Runs of one character, ``min_run`` long at least; below 2 disables."""

    min_run: int
    name: str = "repetition"

    def matches(self, text: Column) -> Column:
        if self.min_run < 2:
            return F.when(text.isNotNull(), S.no_matches())
        # a gap never starts with the run before it, so the group in the pattern leaves split's pieces as they are
        spans = find_all(text, f"(?s)(.)\\1{{{self.min_run - 1},}}")
        return _each(spans, lambda s: S.match(self.name, F.lit("char_flood"), s["start"], s["end"], s["text"], S.HIGH, S.BLOCK))


def _class(ranges) -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


_NEUTRAL = r"\s\x{21}-\x{2F}\x{30}-\x{39}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7E}"


@dataclass(frozen=True)
class ScriptMix:
    """Runs outside the dominant script, once more than ``threshold`` characters are; a run is named by its first character."""

    threshold: int = 0
    name: str = "script_mix"

    def matches(self, text: Column) -> Column:
        known = [(name, _class(r)) for name, r in tables.SCRIPTS]
        all_known = "".join(c for _, c in known)
        foreign = [f"(?U)[^{inside}{_NEUTRAL}]+" for _, inside in known] + [f"[{all_known}]+"]
        without = lambda t, inside: F.char_length(F.regexp_replace(t, f"[{inside}]", ""))

        def counted(plain: Column) -> Column:
            own = [F.char_length(plain) - without(plain, inside) for _, inside in known]
            return F.struct(F.char_length(plain).alias("all"), F.array(*own, without(plain, all_known)).alias("own"))

        def judged(c: Column) -> Column:
            most = F.array_max(c["own"])
            first = F.array_position(c["own"], most).cast("int")  # of equals, the first in the table
            spans = find_all(text, F.element_at(F.array(*[F.lit(f) for f in foreign]), first), c["all"] - most > max(self.threshold, 0))
            return _each(spans, lambda s: S.match(self.name, _script_of(F.left(s["text"], F.lit(1)), known), s["start"], s["end"], s["text"], S.MEDIUM, S.WARN))

        return F.when(text.isNotNull(), bound(bound(F.regexp_replace(text, f"(?U)[{_NEUTRAL}]", ""), counted), judged))


def _script_of(char: Column, known) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, inside in known:
        out = out.when(char.rlike(f"[{inside}]"), F.lit(name))
    return out.otherwise(F.lit("other"))


@dataclass(frozen=True)
class PiiPatterns:
    """Personal data by shape; where there is a checksum, what fails it is dropped and what passes it is certain."""

    name: str = "pii_patterns"
    only: tuple[str, ...] = ()

    def matches(self, text: Column) -> Column:
        checks = {"ssn": X.ssn_valid, "luhn": X.luhn_ok, "iban": X.iban_ok}
        wanted = [(key, regex, check) for key, regex, check in tables.PII if not self.only or key in self.only]
        if not wanted:
            return F.when(text.isNotNull(), S.no_matches())

        def gate(key: str, seen: Column) -> Column:
            holds = tables.PII_HOLDS[key]
            held = text.rlike(holds) if len(holds) > 1 else text.contains(holds)
            return held if key in tables.PII_WITHOUT_DIGITS else seen & held

        def valid(s: Column, i: Column) -> Column:
            out = F.lit(True)
            for k, (_, _, check) in enumerate(wanted):
                out = F.when(i == k, checks[check](s["text"])).otherwise(out) if check else out
            return out

        spans = bound(text.rlike(r"(?U)\d"), lambda seen: find_each(text, [(regex, gate(key, seen)) for key, regex, _ in wanted]))
        if any(check for _, _, check in wanted):
            spans = F.transform(spans, lambda found, i: F.filter(found, lambda s: valid(s, i)))
        return _graded(self.name, spans, [(key, *((S.HIGH, S.BLOCK) if check else (S.MEDIUM, S.WARN))) for key, _, check in wanted])


@dataclass(frozen=True)
class TemplateMarkerShape:
    """Chat-template tags around a word of 3 to 16 letters that isn't allowed."""

    allowed: tuple[str, ...] = ()
    name: str = "template_marker_shape"

    def allow(self, *words: str) -> TemplateMarkerShape:
        return TemplateMarkerShape((*self.allowed, *words), self.name)

    def matches(self, text: Column) -> Column:
        spans = find_all(text, "(?mdU)(?:" + "|".join(p for _, p in tables.TEMPLATE_SHAPES) + ")", any_of(text, ("<|", "<<", "[", "###")))
        if self.allowed:
            words = F.array(*[F.lit(w.lower()) for w in self.allowed])
            spans = F.filter(spans, lambda s: ~F.array_contains(words, F.lower(F.regexp_extract(s["text"], "([A-Za-z]+)", 1))))
        kind = lambda t: F.when(t.startswith("<|"), "pipe_sentinel").when(t.startswith("<<"), "angle_sentinel").when(t.startswith("["), "bracket").otherwise("markdown_heading")
        return _each(spans, lambda s: S.match(self.name, kind(s["text"]), s["start"], s["end"], s["text"], S.HIGH, S.BLOCK))


@dataclass(frozen=True)
class UrlExtract:
    """URLs as information, each followed by its host if that mixes scripts. ``spark`` gives the script tables; by default the active session does."""

    spark: SparkSession | None = field(default=None, compare=False)
    name: str = "url_extract"

    def matches(self, text: Column) -> Column:
        return self._scan(text, True)

    def native(self, text: Column) -> Column:
        """URLs alone: whether a host mixes scripts takes Python."""
        return self._scan(text, False)

    def _scan(self, text: Column, judge: bool) -> Column:
        from sievespark.operators.arrow import mixed_hosts

        spans = F.transform(find_all(text, tables.URL, any_of(text, ("http://", "https://"))), lambda s: F.struct(s["start"].alias("start"), X.trim_url_tail(s["text"]).alias("text")))
        spans = F.filter(spans, lambda s: F.char_length(s["text"]) > 0)
        url = lambda s: S.match(self.name, F.lit("url"), s["start"], s["start"] + F.octet_length(s["text"]), s["text"], S.HIGH, S.INFO)
        host = lambda s: F.regexp_extract(s["text"], "://([^/?#]*)", 1)
        begin = lambda s: s["start"] + F.octet_length(F.regexp_extract(s["text"], "^(.*?://)", 1))
        odd_host = r"https?://[^/?#\s]*[^\x{0}-\x{7F}/?#\s]"
        if not judge:
            return _each(spans, url)
        # only texts with a host beyond ASCII go to Python
        odd = F.coalesce(mixed_hosts(self.spark or _session())(F.when(text.rlike(odd_host), text)), F.array().cast("array<string>"))
        both = F.zip_with(spans, F.array_repeat(odd, F.size(spans)), lambda s, o: F.when(F.array_contains(o, host(s)), F.array(url(s), S.match(self.name, F.lit("idn_homograph"), begin(s), begin(s) + F.octet_length(host(s)), host(s), S.HIGH, S.BLOCK))).otherwise(F.array(url(s))))
        return F.flatten(both)


def secrets() -> RegexScan:
    """Credentials by the shapes that their vendors document."""
    return RegexScan("secrets", tuple(RegexPattern(i, r, S.BLOCK, c, holds) for i, r, c, holds in tables.SECRETS))


def assigned_tokens() -> RegexScan:
    """Hex tokens assigned to a name; an addition to :func:`secrets`."""
    return RegexScan("assigned_token", (RegexPattern("assigned_token", r"(?i)\b(?:token|secret|api_?key)\s*[=:]\s*\"[0-9a-f]{32,64}\"", S.BLOCK, S.MEDIUM),))


@dataclass(frozen=True)
class FuzzyMatch:
    """Phrases whose byte trigrams the text contains to a share of ``threshold``; the span is the whole text."""

    corpus: tuple[tuple[str, str], ...] = tables.PARAPHRASES
    threshold: float = 0.75
    severity: int = S.WARN
    confidence: int = S.MEDIUM
    name: str = "fuzzy_match"

    def matches(self, text: Column) -> Column:
        from sievespark.operators.arrow import contained_phrases

        least = min(1.0, max(0.0, self.threshold))
        names = F.array(*[F.lit(key) for key, _ in self.corpus]) if self.corpus else F.array().cast("array<string>")
        found = contained_phrases(tuple(phrase for _, phrase in self.corpus), least)(F.when(F.char_length(text) >= 12, X.normalise(text)))
        return F.coalesce(F.transform(found, lambda i: self._whole(F.get(names, i), text)), F.when(text.isNotNull(), S.no_matches()))

    def _whole(self, key: Column, text: Column) -> Column:
        return S.match(self.name, key, F.lit(0), F.octet_length(text), text, self.confidence, self.severity)

    def native(self, text: Column) -> Column:
        """The same matches from built-in functions alone, which take longer."""
        least, hits = min(1.0, max(0.0, self.threshold)), []
        for key, phrase in self.corpus:
            data = re.sub(r"\s+", " ", phrase.lower()).strip().encode()
            grams = sorted({data[i : i + 3].hex().upper() for i in range(len(data) - 2)})
            if grams:
                hits.append((key, grams))
        if not hits:
            return F.when(text.isNotNull(), S.no_matches())
        known = F.array(*[F.lit(g) for g in sorted({g for _, grams in hits for g in grams})])

        def judged(met: Column) -> Column:
            shared = lambda grams: F.size(F.array_intersect(met, F.array(*[F.lit(g) for g in grams])))
            share = lambda grams: (shared(grams) / F.lit(len(grams))).cast("float")
            return F.filter(F.array(*[F.when((shared(g) >= 4) & (share(g) >= F.lit(least).cast("float")), self._whole(F.lit(key), text)) for key, g in hits]), lambda m: m.isNotNull())

        found = bound(F.array_intersect(X.trigrams(X.normalise(text)), known), judged)
        return F.when(F.char_length(text) >= 12, found).when(text.isNotNull(), S.no_matches())


@dataclass(frozen=True)
class Deobfuscate:
    """``inner`` over views of the text: unspaced, de-leeted, look-alikes folded, base64 decoded.

    ``spark`` gives the look-alike tables; by default the active session does.
    Decoded runs are scanned within an array, where Python can't be called: an
    ``inner`` that uses it has a form ``native`` for them.
    """

    inner: Scanner
    spark: SparkSession | None = field(default=None, compare=False)
    collapse_spaces: bool = True
    leet: bool = True
    confusables: bool = True
    base64: bool = True
    name: str = "deobfuscate"

    def matches(self, text: Column) -> Column:
        from sievespark.operators.arrow import folded

        in_python = hasattr(self.inner, "native")

        def whole(view: Column) -> Column:
            found = self.inner.matches(view) if in_python else bound(view, self.inner.matches)
            return F.transform(F.slice(found, 1, 1), lambda m: S.match(self.name, m["pattern"], F.lit(0), F.octet_length(text), text, S.HIGH, S.BLOCK, True))

        out = []
        if self.collapse_spaces:
            out.append(F.when(X.letter_spaced(text), whole(X.collapse_spacing(text))).otherwise(S.no_matches()))
        if self.leet:
            out.append(F.when(X.has_leet(text), whole(X.leet_fold(text))).otherwise(S.no_matches()))
        if self.confusables:
            view = folded(self.spark or _session())(F.when(F.octet_length(text) > F.char_length(text), text))  # null where one script covers the text
            out.append(F.coalesce(whole(view), S.no_matches()))
        if self.base64:

            def decoded(run: Column) -> Column:
                scan = self.inner.native if in_python else self.inner.matches
                inner = F.coalesce(bound(X.decode_base64(run["text"]), scan), S.no_matches())
                return F.transform(inner, lambda m: S.match(self.name, m["pattern"], run["start"], run["end"], run["text"], S.HIGH, S.BLOCK, True))

            out.append(F.when(text.rlike(X.BASE64_RUN), F.flatten(F.transform(X.base64_runs(text), decoded))).otherwise(S.no_matches()))
        return F.when(text.isNotNull(), F.concat(*out) if out else S.no_matches())
