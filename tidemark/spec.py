"""What an operator needs to know about a series: its key, its time, and what breaks ties."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SeriesSpec:
    """Rows with the same ``keys`` are one series, in the order of ``time`` and then ``ties``."""

    keys: tuple[str, ...]
    time: str
    ties: tuple[str, ...] = ()
    metrics: tuple[str, ...] = field(default=())

    def order(self) -> list[Column]:
        return [F.col(self.time), *map(F.col, self.ties)]

    def rows(self) -> WindowSpec:
        """One specification for every row window over the series, so that they share an exchange and a sort."""
        return Window.partitionBy(*self.keys).orderBy(*self.order())

    def last_rows(self, n: int) -> WindowSpec:
        return self.rows().rowsBetween(1 - n, 0)


#: Station readings: the preset of the raw observation stream.
WEATHER = SeriesSpec(("station_id",), "timestamp", (), ("temperature", "humidity", "pressure", "wind_speed"))
