"""What a stream did in every batch, from its own metrics.

``ProgressLog`` listens to a query and keeps, for each batch that had rows,
the numbers that :func:`observed` adds to the stream's plan (counted as the
rows pass, without a job of their own) and the times Spark reports.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

METRICS = "weftcore_points"
PROGRESS = "batch_id long, rows long, weight double, input_rows long, seconds double"


def observed(points: DataFrame) -> DataFrame:
    """The stream with its rows and weight counted per batch."""
    w = F.col("weight") if "weight" in points.columns else F.lit(1.0)
    return points.observe(METRICS, F.count(F.lit(1)).alias("rows"), F.sum(w.cast("double")).alias("weight"))


class ProgressLog(StreamingQueryListener):
    """Progress of the last ``keep`` batches of one query (by its name)."""

    def __init__(self, name: str, keep: int = 10_000):
        self.name, self.rows, self.done = name, deque(maxlen=keep), False

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        self.done = True

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        if p.name != self.name:
            return
        seen = (p.observedMetrics or {}).get(METRICS)
        if seen is not None and seen["rows"]:
            self.rows.append((int(p.batchId), int(seen["rows"]), float(seen["weight"] or 0.0), int(p.numInputRows), json.loads(p.json)["durationMs"].get("triggerExecution", 0) / 1000))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), PROGRESS)
