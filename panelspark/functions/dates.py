"""Date helpers of report calendars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_end(date: Column) -> Column:
    return F.last_day(F.add_months(F.date_trunc("quarter", date).cast("date"), 2))


def parse_yyyymmdd(x: Column) -> Column:
    """Dates written as numbers or text like 20240331; anything else is NULL."""
    return F.try_to_date(x.cast("string"), "yyyyMMdd")


def symbol_code(x: Column) -> Column:
    """Six-digit code with leading zeros; codes that are no number stay as they are."""
    number = x.cast("string").rlike("^ *[+-]?[0-9]+ *$")
    text = F.trim(x.cast("string"))
    digits = F.regexp_replace(F.regexp_replace(text, "^[+]", ""), "^(-?)0+(?=[0-9])", "$1")
    return F.when(number, F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)).otherwise(x.cast("string"))
