"""Calendar functions and a date dimension; a fiscal year begins on 1 April and is named for the year it ends in."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FISCAL_START = 4  # month
MODEL_YEAR_START = 7  # month from which vehicles count for the next model year


def fiscal_year(d: Column) -> Column:
    return F.year(d) + (F.month(d) >= FISCAL_START).cast("int")


def fiscal_quarter(d: Column) -> Column:
    return F.floor(F.pmod(F.month(d) - FISCAL_START, F.lit(12)) / 3).cast("int") + 1


def fiscal_year_label(d: Column) -> Column:
    """FY and the year, as in FY2026."""
    return F.concat(F.lit("FY"), fiscal_year(d).cast("string"))


def quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


def model_year(d: Column) -> Column:
    return F.year(d) + (F.month(d) >= MODEL_YEAR_START).cast("int")


def attributes(d: Column) -> dict[str, Column]:
    """The columns of the date dimension, by name, for a date column."""
    return {
        "calendar_date": d.cast("date"), "year": F.year(d).cast("smallint"), "quarter": F.quarter(d).cast("smallint"), "month": F.month(d).cast("smallint"),
        "month_name": F.date_format(d, "MMMM"), "year_month": F.date_format(d, "yyyy-MM"), "week_of_year": F.weekofyear(d).cast("smallint"),
        "day_of_week": (F.weekday(d) + 1).cast("smallint"), "day_name": F.date_format(d, "EEEE"), "is_weekend": F.weekday(d) >= 5,
        "fiscal_year": fiscal_year(d).cast("smallint"), "fiscal_quarter": fiscal_quarter(d).cast("smallint"), "fiscal_year_label": fiscal_year_label(d),
    }


def fiscal_start(d: date) -> date:
    return date(d.year if d.month >= FISCAL_START else d.year - 1, FISCAL_START, 1)


def date_dimension(spark: SparkSession, first: date, last: date) -> DataFrame:
    """One row per day of the whole fiscal years that hold first and last."""
    from datetime import timedelta

    begin, end = fiscal_start(first), fiscal_start(last)
    end = date(end.year + 1, end.month, 1) - timedelta(days=1)
    days = spark.range((end - begin).days + 1).select(F.date_add(F.lit(begin), F.col("id").cast("int")).alias("d"))
    return days.select(*[c.alias(name) for name, c in attributes(F.col("d")).items()])
