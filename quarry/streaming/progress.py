"""Timing and progress of batches: of a stream by a listener, of any run by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """percent, rate (rows a second) and eta (seconds to go); 0 where there is nothing to divide by."""
    rate = F.when(seconds > 0, done / seconds).otherwise(F.lit(0.0))
    return F.struct(
        F.when(total > 0, done * 100.0 / total).otherwise(F.lit(0.0)).alias("percent"),
        rate.alias("rate"),
        F.when(rate > 0, (total - done) / rate).otherwise(F.lit(0.0)).alias("eta"),
    )


class BatchTimes(StreamingQueryListener):
    """Keeps name, number, rows and milliseconds of the last `most` batches of all streams of a session."""

    def __init__(self, most: int = 10_000):
        self.most, self.rows = most, []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.rows.append((p.name or str(p.id), p.batchId, p.numInputRows, float(p.batchDuration)))
        del self.rows[: -self.most]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), "query string, batch long, rows long, milliseconds double")
