"""Pipelines of scanners, and what to make of their matches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievespark import schema as S
from sievespark.operators.scanners import Scanner

ALL, FIRST_HIT = "all", "first_hit"


@dataclass
class Pipeline:
    """Scanners in order. ``all`` keeps every match; ``first_hit`` stops after the first scanner with a match of any severity."""

    mode: str = ALL
    scanners: list[Scanner] = field(default_factory=list)

    def with_(self, scanner: Scanner) -> Pipeline:
        self.scanners.append(scanner)
        return self

    def matches(self, text: Column) -> Column:
        found = [s.matches(text) for s in self.scanners]
        if not found:
            return F.when(text.isNotNull(), S.no_matches())
        if self.mode == ALL:
            return F.concat(*found)
        out = F.when(F.size(found[0]) > 0, found[0])
        for m in found[1:]:  # later branches are evaluated only where the earlier found nothing
            out = out.when(F.size(m) > 0, m)
        return out.when(text.isNotNull(), S.no_matches())

    def scan(self, df: DataFrame, text: str = "text", out: str = "matches") -> DataFrame:
        """``df`` with the array of matches; a map without shuffle."""
        return df.withColumn(out, self.matches(F.col(text)))


def match_table(df: DataFrame, keys: list[str], matches: str = "matches") -> DataFrame:
    """A row for each match: the keys, ``ord`` and the fields of the match."""
    return df.select(*keys, F.posexplode(matches).alias("ord", "m")).select(*keys, "ord", "m.*")


def verdicts(df: DataFrame, keys: list[str], matches: str = "matches") -> DataFrame:
    """Per row, from its own array: ``flagged, refuse, max_severity, n_matches, first_scanner, first_pattern``; null where the text was."""
    m = F.col(matches)
    return df.select(*keys, F.when(m.isNotNull(), S.flagged(m)).alias("flagged"), S.should_refuse(m).alias("refuse"), S.max_severity(m).cast("int").alias("max_severity"), F.when(m.isNotNull(), F.size(m)).alias("n_matches"), S.first(m)["scanner"].alias("first_scanner"), S.first(m)["pattern"].alias("first_pattern"))


def roll_up(judged: DataFrame, *keys: str) -> DataFrame:
    """Rows scanned, flagged and refused by ``rollup(keys)``; null keys are the totals."""
    return judged.rollup(*keys).agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("flagged")).alias("flagged"), F.count_if(F.col("refuse")).alias("refused"), F.max("max_severity").alias("max_severity"))


def evaluate(judged: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Confusion counts of ``flagged`` against a 0/1 label."""
    both = judged.select(key, "flagged").join(labels.select(key, label), key)
    return both.agg(*[F.count_if((F.col("flagged") == f) & (F.col(label) == v)).alias(n) for n, f, v in (("true_pos", True, 1), ("false_pos", True, 0), ("false_neg", False, 1), ("true_neg", False, 0))])
