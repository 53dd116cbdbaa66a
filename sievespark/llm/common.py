"""What several operators share: scratch tables, Arrow passes and joins that bear hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_made: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a local master; on a
    cluster other machines wouldn't see it, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="sievespark-"))
        base = _own[0]
    path = f"{base.rstrip('/')}/sievespark-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_drop_scratch)
    _made.append((spark, path))
    return path


def _drop_scratch() -> None:
    """Results are lazy, so their scratch tables stay until the application ends."""
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)
    for spark, path in _made:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session is gone: its cluster's cleaner takes the folder
            return


def materialize(df: DataFrame) -> DataFrame:
    """The same rows, reread from a Parquet table in the shared folder; survives lost executors."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bound_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Arrow batches of at most ``most`` bytes, however long the texts are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().getConfString(key, "2147483647b")
    if not now.rstrip("bB").isdigit() or int(now.rstrip("bB")) > most:
        spark.conf.set(key, str(most))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't use, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def append_columns(df: DataFrame, fields: list[T.StructField], fn: Callable[[pa.RecordBatch], list], needs: list[str] | None = None) -> DataFrame:
    """``df`` with the columns that ``fn`` makes of each Arrow batch.

    A column of ``df`` whose name clashes (in any case) with a new one is
    replaced. ``needs``: pass only these columns on.
    """
    bound_batches(df.sparkSession)
    names = {f.name.lower() for f in fields}
    keep = [c for c in (needs or df.columns) if c.lower() not in names]
    source = df if needs is None else df.select(*{c: None for c in needs})
    schema = T.StructType([source.schema[c] for c in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            for part in slices(batch):
                made = fn(part)
                arrays = [part.column(part.schema.get_field_index(c)) for c in keep]
                arrays += [m if isinstance(m, pa.Array) else pa.array(m, t) for m, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *(f.name for f in fields)])

    return source.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what is made of one stays small."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of each row of a string column."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def code_points(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    if data.isascii():
        return len(data)
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def crc_bucket(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id falls in no bucket (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def bounded_ids(df: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` of the ids in ``doc_id``, chosen by their hash: a sample that any run draws alike."""
    return df.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], copies: str, total: int, most_hot: int = 4096) -> DataFrame:
    """Left join of ``rows`` with one row per key in ``groups``, safe where a key holds most rows.

    ``copies`` names the column of ``groups`` with the key's number of rows and
    is not returned. Keys with over ``total / most_hot`` rows are at most
    ``most_hot``, so they are broadcast; their rows take part in the shuffled
    join for the others under keys of their own, spread evenly.
    ``groups`` should be a materialised table: it is read twice.
    """
    values = [c for c in groups.columns if c not in keys and c != copies]
    least = max(1000, -(-total // most_hot))
    renamed = groups.select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.struct(*values).alias("__value"), F.col(copies).alias("__copies"))
    hot = renamed.where(F.col("__copies") > least).drop("__copies").withColumnRenamed("__value", "__hot")
    cold = renamed.where(F.col("__copies") <= least).drop("__copies").withColumn("__zero", F.lit(0).cast("long"))
    same = [F.col(k) == F.col(f"__key_{k}") for k in keys]
    out = rows.join(F.broadcast(hot), same, "left").drop(*[f"__key_{k}" for k in keys])
    lone = F.col("__hot").isNotNull() | F.greatest(F.lit(0), *[F.col(k).isNull().cast("int") for k in keys]).cast("boolean")
    out = out.withColumn("__spread", F.when(lone, F.xxhash64(*[F.col(c) for c in rows.columns])).otherwise(F.lit(0).cast("long")))
    out = out.join(cold, [*same, F.col("__spread") == F.col("__zero")], "left")
    picked = [F.coalesce(F.col(f"__hot.{v}"), F.col(f"__value.{v}")).alias(v) for v in values]
    return out.select(*[F.col(c) for c in rows.columns], *picked)
