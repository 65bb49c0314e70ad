"""Nights, dates and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_time(epoch_s: Column, zone: str = "America/New_York") -> Column:
    """Local wall time of epoch seconds."""
    return F.from_utc_timestamp(F.timestamp_seconds(epoch_s), zone)


FIRST_NIGHT = "2017-06-25"


def night_date(index: Column, first: str = FIRST_NIGHT) -> Column:
    """Date of a night by its place from the first."""
    return F.date_add(F.lit(first).cast("date"), index)


def night_dates(start: Column, stop: Column, first: str = FIRST_NIGHT) -> Column:
    """Dates of the nights from place start to place stop, both included."""
    return F.sequence(night_date(start, first), night_date(stop, first))


def month_night(name: Column) -> tuple[Column, Column]:
    """Month and night of names such as curves_07_01.parquet."""
    return F.regexp_extract(name, r"_(\d+)_\d+\.[^.]*$", 1), F.regexp_extract(name, r"_(\d+)\.[^.]*$", 1)
