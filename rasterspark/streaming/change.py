"""Change against the date before, as rows of dates arrive in any order.

Each key's state is a map from date to total.  Rows add to their date's total
whichever batch brings them; every batch gives the changes of the dates it has
touched and of the dates behind them anew, so for each (key, date) the row of
the newest batch holds.  A timer of each date rings once the watermark has
passed it: nothing can change that date any more, and of all such dates only the
last stays, as the one that the next is compared with.  Rows that come more than
``late`` behind the newest are dropped, as in any watermarked stream.
"""

from __future__ import annotations

import datetime
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: What transformWithState keeps its state in.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = ("from_date", "to_date", "from_value", "to_value", "delta")


class ChangeByDate(StatefulProcessor):
    """Totals by date of one key."""

    def __init__(self, keys: tuple[str, ...], date: str, value: str):
        self.keys, self.date, self.value = keys, date, value

    def init(self, handle) -> None:
        self.handle = handle
        self.totals = handle.getMapState("totals", "day date", "total long")

    def handleInputRows(self, key, rows, timerValues):
        new: dict[datetime.date, int] = {}
        for frame in rows:
            for day, amount in frame.groupby(self.date)[self.value].sum().items():
                new[day] = new.get(day, 0) + int(amount)
        totals = {k[0]: v[0] for k, v in self.totals.iterator()}
        for day, amount in new.items():
            if day not in totals:
                self.handle.registerTimer(_end_of(day))
            totals[day] = totals.get(day, 0) + amount
            self.totals.updateValue((day,), (totals[day],))
        days = sorted(totals)
        changed = [(a, b) for a, b in zip(days, days[1:], strict=False) if a in new or b in new]
        found = [(*key, a, b, totals[a], totals[b], totals[b] - totals[a]) for a, b in changed]
        yield pd.DataFrame(found, columns=[*self.keys, *FIELDS])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        days = sorted(k[0] for k in self.totals.keys())  # noqa: SIM118
        for day in [d for d in days if _end_of(d) <= passed][:-1]:
            self.totals.removeKey((day,))
        yield pd.DataFrame([], columns=[*self.keys, *FIELDS])

    def close(self) -> None:
        pass


def _end_of(day: datetime.date) -> int:
    """Milliseconds of the end of a day."""
    return int(datetime.datetime(day.year, day.month, day.day, tzinfo=datetime.UTC).timestamp() * 1000) + 86_400_000


def running_change(stream: DataFrame, *keys: str, date: str = "acq_date", value: str = "pixels", late: str = "30 days") -> DataFrame:
    """(keys, from_date, to_date, from_value, to_value, delta), in update mode; the session's state store must be RocksDB.

    Rows without a date or without a value are left out.
    """
    kinds = [f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys]
    out = ", ".join([*kinds, "from_date date", "to_date date", "from_value long", "to_value long", "delta long"])
    rows = stream.where(F.col(date).isNotNull() & F.col(value).isNotNull()).select(*keys, F.col(date).cast("date").alias(date), F.col(value).cast("long").alias(value))
    timed = rows.withColumn("_at", F.to_timestamp_ltz(F.date_format(date, "yyyy-MM-dd'T'12:00:00'Z'"))).withWatermark("_at", late)
    return timed.groupBy(*keys).transformWithStateInPandas(ChangeByDate(keys, date, value), out, "Update", "EventTime")


@contextmanager
def rocks(spark: SparkSession):
    """The session with the state store that this needs, while its streams start and run."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def newest(rows: DataFrame, *keys: str, batch: str = "batch") -> DataFrame:
    """Of the rows of all batches, for each key and date that of the last."""
    last = F.row_number().over(Window.partitionBy(*keys, "to_date").orderBy(F.desc(batch)))
    return rows.withColumn("_last", last).where("_last = 1").drop("_last", batch)
