"""Words as the operators of this folder count them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Maximal runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
