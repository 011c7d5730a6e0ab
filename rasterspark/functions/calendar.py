"""Dates of composites: midpoint, season, hydrological year and their checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months of the seasons, first month of the hydrological year.
SEASONS = {"pre_monsoon": (3, 4, 5), "monsoon": (6, 7, 8, 9), "post_monsoon": (10, 11), "winter": (12, 1, 2)}
HYDROLOGICAL_START = 6
UNKNOWN = "unknown"


def midpoint(start: Column, end: Column) -> Column:
    return F.date_add(start, F.floor(F.datediff(end, start) / 2).cast("int"))


def season(month: Column, seasons=None) -> Column:
    """Name of the season that holds a month; a month may belong to one only."""
    seasons = SEASONS if seasons is None else seasons
    months = [m for own in seasons.values() for m in own]
    if len(set(months)) < len(months):
        raise ValueError("a month belongs to one season only")
    found = F.lit(None).cast("string")
    for name, own in seasons.items():
        found = F.coalesce(found, F.when(month.isin(*own), name)) if own else found
    return F.coalesce(found, F.lit(UNKNOWN))


def hydrological_year(date: Column, start: int = HYDROLOGICAL_START) -> Column:
    return F.year(date) - F.when(F.month(date) < start, 1).otherwise(0)


def date_issues(date: Column, season_: Column, hydro: Column, confidence: Column) -> Column:
    """Array of what contradicts the date."""
    year = F.year(date)
    checks = [
        (F.coalesce(season_ != season(F.month(date)), F.lit(True)), "season"),
        (F.coalesce(hydro != hydrological_year(date), F.lit(True)), "hydrological_year"),
        (F.coalesce((year < 1972) | (year > F.year(F.current_date()) + 1), F.lit(True)), "year"),
        (F.coalesce((confidence < 0) | (confidence > 1), F.lit(True)), "confidence"),
    ]
    return F.filter(F.array(*[F.when(bad, name) for bad, name in checks]), lambda x: x.isNotNull())


def temporal_columns(start: Column, end: Column, sensors: Column, confidence: Column | None = None, defaults=None, seasons=None) -> list[Column]:
    """Temporal metadata of a patch: middle of its scene's period, year, month, season, hydrological year, sensors and defaults."""
    middle = midpoint(start, end)
    known = {"label_version": "1.0", "annotator": "unknown", "confidence": 1.0, "confidence_source": "manual"} | (defaults or {})
    return [
        middle.alias("acquisition_date"), F.year(middle).alias("year"), F.month(middle).alias("month"), season(F.month(middle), seasons).alias("season"), hydrological_year(middle).alias("hydrological_year"),
        F.array_join(sensors, ",").alias("sensor"), F.lit(known["label_version"]).alias("label_version"), F.lit(known["annotator"]).alias("annotator"),
        F.coalesce(confidence, F.lit(known["confidence"])).alias("confidence") if confidence is not None else F.lit(known["confidence"]).alias("confidence"), F.lit(known["confidence_source"]).alias("confidence_source"),
    ]
