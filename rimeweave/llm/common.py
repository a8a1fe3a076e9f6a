"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import ensure_checkpoint_dir

#: A key that holds at least one row in so many is hot. At most so many keys can be, whatever the data.
HOT_KEYS = 1000
#: Text that a Python task works on at once; a longer single text is a slice of its own.
SLICE_BYTES = 2 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there and survives a lost executor."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, spread: str) -> DataFrame:
    """Left join of `rows` with one row of `table` per key, where a few keys may hold most rows.

    `weight` is a column of `table` with the number of rows of a key and `total` their sum. Keys with more than a
    thousandth of `total` are at most a thousand, so they are broadcast. Rows of such keys travel by a hash of the
    column `spread` in the shuffle join with all other keys.
    """
    hot_from = max(2, -(-total // HOT_KEYS))
    values = [c for c in table.columns if c != key]
    hot = table.filter(F.col(weight) >= hot_from).select(
        F.col(key).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in values)
    )
    cold = table.filter(F.col(weight) < hot_from).select(
        F.col(key).cast("string").alias("_cold"), *(F.col(c).alias(f"_cold_{c}") for c in values)
    )
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    spread_key = F.concat(F.lit("~"), F.xxhash64(spread).cast("string"))
    met = met.withColumn("_by", F.when(F.col("_hot").isNull(), F.col(key).cast("string")).otherwise(spread_key))
    met = met.join(cold, F.col("_by") == F.col("_cold"), "left")
    return met.select(*rows.columns, *(F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in values))


_shipped: set[str] = set()


def map_arrow(df: DataFrame, work: Callable, schema: T.StructType | str) -> DataFrame:
    """mapInArrow with a function of this package; the package is sent along to the Python workers once."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as held:
            for source in sorted(package.rglob("*.py")):
                held.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return df.mapInArrow(work, schema)


def is_training(id_column: Column) -> Column:
    """Rows that a classifier may learn from: crc32 of the id as text is not a multiple of five."""
    return F.crc32(id_column.cast("string")) % 5 != 0


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice take about `most` bytes, or are one text."""
    for batch in batches:
        sizes = size_of(batch.column(column)).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for at, size in enumerate(sizes):
            if held + size > most and at > start:
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += int(size)
        if len(sizes) > start:
            yield batch.slice(start, len(sizes) - start)


def size_of(column: pa.Array) -> pa.Array:
    """Bytes of each string, or items of each list."""
    lists = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
    return (pc.list_value_length(column) if lists else pc.binary_length(column)).fill_null(0)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of a batch; a missing text is empty."""
    return [text or "" for text in batch.column(column).to_pylist()]
