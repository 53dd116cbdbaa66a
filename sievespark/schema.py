"""The match record, its codes, and reductions over arrays of matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, MEDIUM, HIGH = 0, 1, 2
INFO, WARN, BLOCK = 0, 1, 2

#: One hit: UTF-8 byte offsets, half open; ``text`` is what lies between them.
MATCH = "struct<scanner:string,pattern:string,start:int,end:int,text:string,confidence:tinyint,severity:tinyint,decoded:boolean>"
MATCHES = f"array<{MATCH}>"


def no_matches() -> Column:
    return F.array().cast(MATCHES)


def match(scanner: str, pattern: Column, start: Column, end: Column, text: Column, confidence: int | Column, severity: int | Column, decoded: bool = False) -> Column:
    code = lambda c: (F.lit(c) if isinstance(c, int) else c).cast("tinyint")
    return F.struct(F.lit(scanner).alias("scanner"), pattern.alias("pattern"), start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"), code(confidence).alias("confidence"), code(severity).alias("severity"), F.lit(decoded).alias("decoded"))


def confidence_label(code: Column) -> Column:
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), code.cast("int") + 1)


def severity_label(code: Column) -> Column:
    return F.element_at(F.array(F.lit("info"), F.lit("warn"), F.lit("block")), code.cast("int") + 1)


def flagged(matches: Column) -> Column:
    """Whether there is any match."""
    return F.size(matches) > 0


def should_refuse(matches: Column) -> Column:
    """Whether any match recommends to block."""
    return F.exists(matches, lambda m: m["severity"] == BLOCK)


def max_severity(matches: Column) -> Column:
    """The gravest severity; null where there is no match."""
    return F.array_max(F.transform(matches, lambda m: m["severity"]))


def first(matches: Column) -> Column:
    """The match that comes first in the order of scanners and patterns; null where there is none."""
    return F.get(matches, F.lit(0))


def extend(*matches: Column) -> Column:
    return F.concat(*matches)
