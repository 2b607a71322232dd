"""Small text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space at the ends of a text.
SPACES = (
    "\t\n\x0b\f\r \x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
ANSI_COLOUR = "\\x1b\\[[0-9;]*m"


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def ellipsis(text: Column, width: int) -> Column:
    """Shorten to ``width`` characters, the last three being dots."""
    return F.when(
        F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))
    ).otherwise(text)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def null_to_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def duration_text(seconds: Column) -> Column:
    """``12s`` below a minute, ``5m`` below an hour, else ``1.5h``.

    Rounds the binary value to the nearest digit, halves to the even one.
    """
    minutes = F.floor(seconds / 60) + F.pmod(seconds, F.lit(60.0)) / 60.0
    hours = F.floor(seconds / 3600) + F.pmod(seconds, F.lit(3600.0)) / 3600.0
    # Twenty times the hours as a sum and its rounding error: odd sums lie half
    # way between two tenths, and the error tells on which side.
    double_tenths = hours * 16.0 + hours * 4.0
    error = hours * 4.0 - (double_tenths - hours * 16.0)
    halfway = (double_tenths == F.floor(double_tenths)) & (F.pmod(double_tenths, F.lit(2.0)) == 1.0)
    tenths = (
        F.when(halfway & (error > 0), (double_tenths + 1) / 2)
        .when(halfway & (error < 0), (double_tenths - 1) / 2)
        .otherwise(F.bround(double_tenths / 2, 0))
        .cast("bigint")
    )
    whole = lambda value: F.bround(value, 0).cast("bigint").cast("string")
    return (
        F.when(seconds < 60, F.concat(whole(seconds), F.lit("s")))
        .when(seconds < 3600, F.concat(whole(minutes), F.lit("m")))
        .otherwise(
            F.concat(
                F.floor(tenths / 10).cast("string"),
                F.lit("."),
                (tenths % 10).cast("string"),
                F.lit("h"),
            )
        )
    )


def split_tags(tags: Column) -> Column:
    """Stored comma list -> array of trimmed tags; empty or NULL -> NULL."""
    return F.when(
        null_to_blank(tags) != "", F.transform(F.split(tags, ",", -1), trim_space)
    )
