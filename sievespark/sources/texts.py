"""Readers that give scanners a ``text`` column, and sinks for what they find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str, fmt: str = "parquet", text: str = "text", keys: tuple[str, ...] = (), schema: str | None = None) -> DataFrame:
    """Only the keys and the text are read; ``fmt`` is parquet, orc, json, csv or text (one row a line, column ``value``)."""
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    return reader.load(path).select(*keys, F.col("value" if fmt == "text" else text).alias("text"))


#: Bytes of files up to which a table is dealt out anew.
SMALL = 256 << 20


def spread(df: DataFrame, small: int = SMALL) -> DataFrame:
    """A small table's rows over all cores: its files have too few row groups to give each core one.

    Larger tables are read as they lie, without a shuffle.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf, total = spark.sparkContext._jsc.hadoopConfiguration(), 0
    files = df.inputFiles()
    for name in files if len(files) <= 64 else ():
        path = hadoop(name)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return df.repartition(spark.sparkContext.defaultParallelism) if 0 < total <= small else df


def stream_texts(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", text: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(path).select(*keys, F.col(text).alias("text"))


def write_matches(table: DataFrame, path: str, mode: str = "append") -> None:
    """An audit table of matches, a folder for each scanner."""
    table.write.mode(mode).partitionBy("scanner").parquet(path)
