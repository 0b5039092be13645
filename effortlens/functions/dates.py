"""Date expressions. Dates arrive as text with an offset, `2020-12-31 23:30:00-05:00`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_text(column: Column) -> Column:
    """Text before the first blank or `T`: the local day of the committer."""
    return F.substring_index(F.translate(column, "T", " "), " ", 1)


def local_day(column: Column) -> Column:
    """The local day as a date, null when the text is none."""
    return day_text(column).try_cast("date")


def instant(column: Column) -> Column:
    """The point in time, offset honoured."""
    return F.try_to_timestamp(column)


def gmt_text(column: Column) -> Column:
    """The same point in time written in GMT, whatever the session time zone is."""
    in_gmt = F.convert_timezone(None, F.lit("UTC"), instant(column))
    return F.concat(F.date_format(in_gmt, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))
