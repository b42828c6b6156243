"""Helpers around ``mapInArrow`` and the folder that the cluster shares."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: What a function over a batch yields: first and last row (exclusive), and the new columns' arrays.
Part = tuple[int, int, list[pa.Array]]


def map_columns(df: DataFrame, run: Callable[[pa.RecordBatch], Iterable[Part]], fields: list[T.StructField]) -> DataFrame:
    """Adds columns computed from Arrow batches; a column of the same name is replaced."""
    new = [f.name for f in fields]
    # columns with clashing names can't be told apart by Arrow consumers; they are addressed by place
    kept = [i for i, f in enumerate(df.schema.fields) if f.name not in new]
    schema = T.StructType([df.schema.fields[i] for i in kept] + fields)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, arrays in run(batch):
                old = [batch.column(i).slice(lo, hi - lo) for i in kept]
                yield pa.RecordBatch.from_arrays(old + arrays, names=[f.name for f in schema.fields])

    return df.mapInArrow(over, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session on this machine alone, as in tests, gets a folder of its own; a cluster is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("touchline.shared.dir", None)
    if not found:
        import tempfile

        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines share (master {master})")

        found = "file://" + tempfile.mkdtemp(prefix="touchline-")
        spark.conf.set("touchline.shared.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Smaller Arrow batches while a table is written: rows here are packed blocks of up to some megabytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key of more than one in this many rows is hot; there are fewer such keys, so they are broadcast.
HOT_SHARE = 1000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "left") -> DataFrame:
    """Joins ``right``, one row for each key with the number ``n`` of its rows in ``left``; a hot key's rows stay spread.

    Rows of hot keys get their values by broadcast and go on by ``spread``; the others are joined by a shuffle.
    ``right`` is read twice: a written table, or a cheap one. ``n`` is not passed on.
    """
    total = right.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = F.col("n") * HOT_SHARE > F.lit(total)
    values = [c for c in right.columns if c not in keys and c != "n"]
    packed = F.struct(*values)
    told = left.join(F.broadcast(right.where(hot).select(*keys, packed.alias("_hot"))), keys, "left")
    told = told.withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(1 << 16)) + 1))
    # 0 for every n; a literal would be taken out of the join's keys, and hot rows would meet again
    no_salt = F.least(F.col("n").cast("long"), F.lit(0).cast("long"))
    out = told.join(right.where(~hot).select(*keys, packed.alias("_cold"), no_salt.alias("_salt")), [*keys, "_salt"], "left")
    found = F.coalesce("_hot", "_cold")
    out = out.where(found.isNotNull()) if how == "inner" else out
    return out.select(*left.columns, *[found[c].alias(c) for c in values])
