"""Find-all with byte offsets, from built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string>"
SPANS = f"array<{SPAN}>"


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value worked out once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def any_of(text: Column, phrases: tuple[str, ...], lower: bool = False) -> Column:
    """Whether ``text`` holds one of the phrases, or its lower-cased form does."""

    def held(t: Column) -> Column:
        out = F.lit(False)
        for p in phrases:
            out = out | t.contains(p)
        return out

    return F.exists(F.array(F.lower(text) if lower else text), held)


def find_all(text: Column, pattern: str | Column, gate: Column | None = None) -> Column:
    """``array<struct<start, end, text>>`` of the leftmost non-overlapping hits of a Java regex, or of each row's own.

    A hit may be empty, unless it touches the end of the hit before it. The
    gaps that ``split`` leaves and the hits interleave, so running sums of
    their lengths are the offsets. ``gate``: a cheap condition that holds
    wherever there is a hit; without it, rows without a hit stop at ``rlike``.
    """
    spans = F.when(_gate(text, pattern, gate), bound(_pieces(text, pattern), _interleaved))
    return F.coalesce(spans, F.when(text.isNotNull(), F.array().cast(SPANS)))


def find_each(text: Column, patterns: list[tuple[str, Column | None]]) -> Column:
    """An array of :func:`find_all` of each pattern and gate, from one expression that places the hits of all: plans stay small."""
    pieces = F.array(*[F.when(_gate(text, p, gate), _pieces(text, p)) for p, gate in patterns])
    none = F.array().cast(SPANS)
    return F.when(text.isNotNull(), F.transform(pieces, lambda s: F.when(s.isNotNull(), _interleaved(s)).otherwise(none)))


def _gate(text: Column, pattern: str | Column, gate: Column | None) -> Column:
    return F.regexp_like(text, F.lit(pattern) if isinstance(pattern, str) else pattern) if gate is None else gate


def _pieces(text: Column, pattern: str | Column) -> Column:
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"), F.split(text, pattern, F.lit(-1)).alias("gaps"))


def _interleaved(s: Column) -> Column:
    # split leaves no empty piece before an empty hit at the very start
    gaps = F.when(F.size(s["gaps"]) == F.size(s["hits"]), F.concat(F.array(F.lit("")), s["gaps"])).otherwise(s["gaps"])
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(s["hits"])), s["hits"], lambda g, h: F.struct(F.octet_length(g).alias("gap"), h.alias("hit")))
    steps = F.filter(steps, lambda x, i: (i == 0) | (x["gap"] > 0) | (x["hit"] != ""))
    return bound(steps, _placed)


def _placed(steps: Column) -> Column:
    return F.when(F.size(steps) > 0, _summed(steps, 2)["out"]).otherwise(F.array().cast(SPANS))


def _summed(steps: Column, levels: int) -> Column:
    """Length ``at`` and spans ``out`` of steps ``(gap, hit)``, in blocks of blocks: an array is copied when it grows by one, and when it is cut."""
    if not levels:
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

        def step(acc: Column, s: Column) -> Column:
            begin = acc["at"] + s["gap"]
            end = begin + F.octet_length(s["hit"])
            return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(begin.alias("start"), end.alias("end"), s["hit"].alias("text"))).alias("out"))

        return F.aggregate(steps, empty, step)

    def moved(acc: Column, block: Column) -> Column:
        spans = F.transform(block["out"], lambda x: F.struct((x["start"] + acc["at"]).alias("start"), (x["end"] + acc["at"]).alias("end"), x["text"].alias("text")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.array_append(acc["out"], spans).alias("out"))

    size = F.ceil(F.pow(F.size(steps), F.lit(levels / (levels + 1)))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / size).cast("int")), lambda i: bound(F.slice(steps, i * size + 1, size), lambda b: _summed(b, levels - 1)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
    return F.aggregate(blocks, start, moved, lambda acc: F.struct(acc["at"].alias("at"), F.flatten(acc["out"]).alias("out")))
