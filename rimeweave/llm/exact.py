"""Exact deduplication by two-pass Bloom filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import attach

#: Bits of filter per row, and the largest filter that is broadcast (32 MB). Beyond that size the filter fills up:
#: more rows take the shuffle, the result stays the same.
BITS_PER_ROW, MOST_BITS, PAGE_BITS = 16, 1 << 28, 32768
#: fixed values: the characters that do not count in a comparison
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def _cells(digest: Column, bits: int) -> list[Column]:
    """Two cells of the filter."""
    return [F.pmod(F.xxhash64(digest, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]


def repeated_cells(rows: DataFrame, digest: str, bits: int) -> DataFrame:
    """First pass: the filter, as pages of bits, of the cells that at least two rows hit."""
    cells = rows.select(F.explode(F.array(*_cells(F.col(digest), bits))).alias("cell"))
    return _pages(cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"))


def _pages(cells: DataFrame) -> DataFrame:
    return cells.groupBy(F.expr("bitmap_bucket_number(cell)").alias("page")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(cell))").alias("bits")
    )


def filter_bits(total: int) -> int:
    """Bits of a filter for `total` rows."""
    return min(MOST_BITS, max(PAGE_BITS, 1 << (BITS_PER_ROW * total).bit_length()))


def maybe_repeated(rows: DataFrame, digest: str, pages: DataFrame, bits: int) -> DataFrame:
    """Second pass: add `_maybe`, true if both cells of a row are set."""
    maybe = F.lit(True)
    for at, cell in enumerate(_cells(F.col(digest), bits)):
        rows = rows.withColumn(f"_cell{at}", cell)
        page = pages.select(F.col("page").alias(f"_page{at}"), F.col("bits").alias(f"_bits{at}"))
        rows = rows.join(F.broadcast(page), F.expr(f"bitmap_bucket_number(_cell{at})") == F.col(f"_page{at}"), "left")
        place = F.expr(f"bitmap_bit_position(_cell{at})")
        byte = F.conv(F.hex(F.substring(F.col(f"_bits{at}"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10)
        set_ = byte.cast("int").bitwiseAND(F.expr(f"shiftleft(1, cast(bitmap_bit_position(_cell{at}) % 8 as int))")) != 0
        maybe = maybe & F.coalesce(set_, F.lit(False))
    rows = rows.withColumn("_maybe", maybe)
    return rows.drop(*(f"_{name}{at}" for at in (0, 1) for name in ("cell", "page", "bits")))


def with_key_in(rows: DataFrame, key: str, wanted: DataFrame, total: int) -> DataFrame:
    """All rows whose `key` is among the about `total` keys of `wanted`, and a few others: the filter of `maybe_repeated`.

    Nothing of `rows` is shuffled for that, so that a join by `key` afterwards shuffles little else than what it finds.
    """
    bits = filter_bits(total)
    cells = wanted.select(F.explode(F.array(*_cells(F.col(key), bits))).alias("cell"))
    return maybe_repeated(rows, key, _pages(cells), bits).filter("_maybe").drop("_maybe")


def exact_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row with `keep_id`, `group_size`, `kept` and `text_sha256` of its group of equal texts.

    Texts are equal if they are after removing `BLANKS`. The longest original text of a group stays, then the smallest
    id. The first pass counts rows per filter cell, the second tests each row: rows whose cells were hit once are alone
    for certain and never shuffle; the others shuffle by their SHA-256, which decides.

    Missing texts count as empty and are copies of each other. A missing id comes after all others. Rows that repeat
    the id, text and length of the row that stays all stay. An empty table gives an empty table. Columns of the input
    with the names of added columns are replaced; others pass through.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    kept_columns = [c for c in df.columns if c not in added]
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = df.select(
        *kept_columns, F.sha2(normalised(text), 256).alias("text_sha256"), F.char_length(text).alias("_length")
    )
    total = df.count()
    bits = filter_bits(total)
    tested = maybe_repeated(rows, "text_sha256", repeated_cells(rows, "text_sha256", bits), bits)

    alone = tested.filter(~F.col("_maybe")).select(
        *kept_columns, "text_sha256", F.col(id_column).alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
    )
    shared = tested.filter("_maybe").drop("_maybe")
    order = F.struct((-F.col("_length")).alias("l"), F.col(id_column).isNull().alias("n"), F.col(id_column).alias("id"))
    groups = shared.groupBy("text_sha256").agg(F.min(order).alias("_first"), F.count("*").alias("group_size"))
    decided = attach(shared, groups, "text_sha256", "group_size", total, id_column).select(
        *kept_columns, "text_sha256", F.col("_first.id").alias("keep_id"), "group_size",
        (F.col(id_column).eqNullSafe(F.col("_first.id")) & (-F.col("_length") == F.col("_first.l"))).alias("kept"),
    )
    return alone.unionByName(decided)
