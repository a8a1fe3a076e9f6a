"""White space as text files have it; the SQL ``trim`` only knows the space."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WHITE = " \t\r\n\f\v"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))
