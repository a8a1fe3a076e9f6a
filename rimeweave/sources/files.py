"""Finding files and reading them as text lines or bytes."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import ensure_checkpoint_dir

#: text files up to this size are one row with all their lines; larger ones are read split by split
WHOLE_FILE_BYTES = 128 * 1024 * 1024


def folder_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def _options(pattern: str, recursive: bool) -> dict[str, str]:
    return {"pathGlobFilter": pattern, "recursiveFileLookup": str(recursive).lower()}


def _keep(df: DataFrame, exclude: str | None) -> DataFrame:
    """Leave out files by name; Spark applies this to the file listing."""
    return df.filter(~F.col("_metadata.file_name").contains(exclude)) if exclude else df


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False, exclude: str | None = None) -> DataFrame:
    """``path, file_name, length`` of the matching files; contents are not read."""
    found = spark.read.format("binaryFile").options(**_options(pattern, recursive)).load(path)
    return _keep(found, exclude).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), "length"
    )


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder; what made them is not done again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _unix_lines(text: Column) -> Column:
    """All three line ends become a line feed; reading line by line does the same."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def read_whole(
    spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False, exclude: str | None = None,
    limit: int = WHOLE_FILE_BYTES,
) -> DataFrame:
    """One row ``path, file_name, lines`` per file of at most ``limit`` bytes.

    A file that cannot be read (a damaged archive, no permission) has no row; the listing still has it.
    The lines leave a generator, so that they are one column: as an expression a text would be split again at each
    mention of its lines, of which a header and its errors have dozens.
    """
    options = {**_options(pattern, recursive), "ignoreCorruptFiles": "true"}
    raw = spark.read.options(**options).text(path, wholetext=True)
    raw = _keep(raw, exclude).filter(F.col("_metadata.file_size") <= limit)
    return raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"),
        F.explode(F.array(F.split(_unix_lines(F.col("value")), "\n"))).alias("lines"),
    )


def read_split_lines(
    spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False, exclude: str | None = None,
    above: int = WHOLE_FILE_BYTES,
) -> DataFrame:
    """Numbered lines ``path, file_name, line_no, value`` of files above a size.

    A file is read by many tasks.  Lines are numbered by counting the lines of
    the splits before; only per-split counts are exchanged for that.  The
    split-local ids must not change between that count and the use of it, so
    they are checkpointed first.
    """
    ensure_checkpoint_dir(spark)
    raw = spark.read.options(**_options(pattern, recursive)).text(path)
    raw = _keep(raw, exclude).filter(F.col("_metadata.file_size") > above)
    local = raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), "value",
    ).checkpoint()
    splits = local.groupBy("path", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return local.join(offsets, ["path", "_start"]).select(
        "path", "file_name", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line_no"), "value"
    )
