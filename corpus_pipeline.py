"""A training corpus from ``documents``: quality rules, language identification, line dedup, near-dup, packing.

Each stage reads all that the stage before it kept. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievespark.llm import langid, line_dedup, near_dup, packing, quality_rules
from sievespark.llm.common import free_name, materialize, scratch_dir
from sievespark.llm.queries import tokenizer_path


#: Cosine that a document needs with a language: three standard deviations of that of random vectors (1 / sqrt(1024)).
#: What the quality stage keeps of sf0.1 has 0.26 at least, and 0.53 where it is labelled as good.
LEAST_COSINE = 3 / langid.DIMENSIONS**0.5


def _carried(docs: DataFrame) -> DataFrame:
    """``doc_id, text, lang`` and the whole row, out of the reach of clashing names."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", "text", lang.alias("lang"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carried_row"))


def _back(rows: DataFrame, docs: DataFrame, **replaced) -> DataFrame:
    """The columns of ``docs`` again, some of them replaced."""
    return rows.select(*[(replaced.get(c) if c in replaced else F.col("carried_row").getField(c)).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    ratios = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1"))
    return _back(quality_rules.judge(_carried(docs), ratios).where("kept"), docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages go: those without a letter, and those that are no closer to any than chance."""
    rows = _carried(docs)
    profile = langid.train(rows)
    return _back(langid.identify(rows, profile).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_COSINE)), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the text, and ``n_chars`` follows it."""
    return _back(line_dedup.dedup_lines(_carried(docs)), docs, text=F.col("text"), n_chars=F.length("text").cast("long"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one with the least id, a null id being the last; of rows that share it, one."""
    row = free_name(docs, "row_key")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    gone = near_dup.near_duplicates(keyed.select(key.alias("doc_id"), "text")).where("not kept").select(F.col("doc_id.row").alias(row))
    return keyed.join(gone, row, "left_anti").drop(row)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the n-gram ratio, the language profiles and best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        made, path = stage(spark, docs, sf_dir), scratch_dir(spark)
        made.write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
