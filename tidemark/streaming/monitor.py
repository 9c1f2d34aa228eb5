"""Health of running queries: a listener whose records become a DataFrame, and files that outlive the driver."""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.log_files import store

SCHEMA = "query string, batch long, at string, input_rows long, rows_per_second double, batch_ms long, state_rows long, dropped_by_watermark long, watermark string, behind long"

NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def behind(source) -> int | None:
    """Records of a source that the batch has left for later: what the source itself reports, else the difference of its
    latest and its end offsets where both are counts by partition; None where neither is known."""
    told = (source.metrics or {}).get("maxOffsetsBehindLatest")
    if told is not None:
        return int(float(told))
    try:
        latest, end = (json.loads(x) if isinstance(x, str) else x for x in (source.latestOffset, source.endOffset))
        return sum(int(n) - int((end.get(topic) or {}).get(part, 0)) for topic, parts in latest.items() for part, n in parts.items())
    except (AttributeError, TypeError, ValueError):
        return None


class ProgressMonitor(StreamingQueryListener):
    """Keeps the last ``most`` progress records of all queries; add it with ``spark.streams.addListener``.

    With ``path``, a folder that all drivers see, each record is also a file of its own there, named by run and batch, so
    that a record that is told twice is there once, and ``history`` reads what earlier drivers have left.
    """

    def __init__(self, most: int = 10_000, path: str | None = None):
        self.records: deque[tuple] = deque(maxlen=most)
        self.path = path

    def onQueryStarted(self, event) -> None:  # noqa: N802  the listener's own names
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        state = p.stateOperators or []
        self._keep(p.runId, (p.name, p.batchId, p.timestamp, p.numInputRows, float(p.inputRowsPerSecond or 0.0), p.batchDuration, sum(s.numRowsTotal for s in state), sum(s.numRowsDroppedByWatermark for s in state), (p.eventTime or {}).get("watermark"), self._behind(p)))

    def _keep(self, run: object, record: tuple) -> None:
        self.records.append(record)
        if self.path:
            files, folder = store(self.path)
            files.create_dir(folder, recursive=True)
            with files.open_output_stream(f"{folder}/{run}-{record[1]}.json") as s:
                s.write(json.dumps(dict(zip(NAMES, record, strict=True))).encode() + b"\n")

    @staticmethod
    def _behind(progress) -> int | None:
        known = [b for b in map(behind, progress.sources or []) if b is not None]
        return sum(known) if known else None

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.records), SCHEMA)

    @staticmethod
    def history(spark: SparkSession, path: str) -> DataFrame:
        """The records of all drivers that have kept theirs in ``path``."""
        return spark.read.schema(SCHEMA).json(path)


def lag(progress: DataFrame) -> DataFrame:
    """For each query: batches, input_rows, dropped_by_watermark, slowest_ms, and how far its last batch was behind."""
    return progress.groupBy("query").agg(
        F.count_distinct("batch").alias("batches"),
        F.sum("input_rows").alias("input_rows"),
        F.sum("dropped_by_watermark").alias("dropped_by_watermark"),
        F.max("batch_ms").alias("slowest_ms"),
        F.max_by("behind", F.struct("at", "batch")).alias("behind"),
    )
