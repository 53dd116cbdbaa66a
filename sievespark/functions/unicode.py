"""Look-alike folding and script sets, from the Unicode data that Spark's own ICU library holds.

The tables are read once from the driver's JVM and go to the workers as plain
dictionaries.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import SparkSession

_ALIKE: dict[int, str] = {}
_SCRIPTS: dict[int, frozenset[str]] = {}

#: Scripts that count as written together.
_JOINT = {"Hani": ("Hanb", "Jpan", "Kore"), "Hira": ("Jpan",), "Kana": ("Jpan",), "Hang": ("Kore",), "Bopo": ("Hanb",)}


def prototypes(spark: SparkSession) -> dict[int, str]:
    """code point -> skeleton, where canonical decomposition alone doesn't give it."""
    if not _ALIKE:
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        points = [c for c in range(0x20, 0x1F000) if not 0xD800 <= c < 0xF900]
        for i in range(0, len(points), 2000):
            part = points[i : i + 2000]
            folded = checker.getSkeleton("\n".join(map(chr, part))).split("\n")
            if len(folded) != len(part):
                folded = [checker.getSkeleton(chr(c)) for c in part]
            _ALIKE.update({c: f for c, f in zip(part, folded, strict=True) if f != unicodedata.normalize("NFD", chr(c))})
    return _ALIKE


def skeleton(text: str, table: dict[int, str]) -> str:
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table))


def script_sets(spark: SparkSession) -> dict[int, frozenset[str]]:
    """Non-ASCII and ASCII letters' script extensions, augmented by the scripts they are written with; no entry: any script."""
    if not _SCRIPTS:
        jvm = spark.sparkContext._jvm
        script = jvm.com.ibm.icu.lang.UScript
        sets: dict[int, set[str]] = {}
        for code in range(2, 210):
            try:
                name = script.getShortName(code)
                # the set keeps the pattern it was made of until it changes
                pattern = jvm.com.ibm.icu.text.UnicodeSet(f"[:scx={name}:]").complement().complement().toPattern(True)
            except Exception:  # codes beyond those that this version of Unicode assigns
                continue
            for lo, hi in _ranges(pattern):
                for c in range(lo, hi + 1):
                    sets.setdefault(c, set()).update((name, *_JOINT.get(name, ())))
        _SCRIPTS.update({c: frozenset(s) for c, s in sets.items()})
    return _SCRIPTS


def _ranges(pattern: str) -> list[tuple[int, int]]:
    char = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\.|[^\\\[\]]"

    def value(s: str) -> int:
        return int(s[2:], 16) if re.fullmatch(r"\\[uUx][0-9A-Fa-f]+", s) else ord(s[-1])

    out = []
    for m in re.finditer(rf"({char})(?:-({char}))?", pattern[1:-1]):
        out.append((value(m[1]), value(m[2] or m[1])))
    return out


def single_script(text: str, sets: dict[int, frozenset[str]]) -> bool:
    """Whether one script covers every character; common and inherited ones go with any."""
    common: frozenset[str] | None = None
    for c in text:
        own = sets.get(ord(c))
        if own is not None:
            common = own if common is None else common & own
            if not common:
                return False
    return True
