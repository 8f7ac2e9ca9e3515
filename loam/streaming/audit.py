"""The audit log as a stream: appended changes, counted per window, late rows up to the watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loam.operators.graph import audit


def changes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def append(rows: DataFrame, event: str, key: str, ts: str, to: str, checkpoint: str, **details) -> StreamingQuery:
    """Audit rows of all files that are there now, each once, across restarts."""
    log = audit(rows, event, key, ts, **details)
    return log.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(rows: DataFrame, ts: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Changes by kind and window; windows close once the watermark has passed them."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def hooked(log: DataFrame, hooks: dict[str, Callable[[DataFrame], None]], checkpoint: str, errors: str) -> StreamingQuery:
    """Calls the hook of each event with the new audit rows of that event, batch by batch.

    A hook that fails stops nothing: its error is a row (event, batch, error) of the Parquet folder `errors`, which
    outlives a restart. A batch that is tried again writes the rows of that batch in place of the earlier ones.
    """

    def each(rows: DataFrame, batch: int) -> None:
        failed = []
        for event, hook in hooks.items():
            try:
                hook(rows.where(F.col("event") == event))
            except Exception as e:
                failed.append((event, batch, str(e)))
        rows.sparkSession.createDataFrame(failed, "event string, batch long, error string").coalesce(1).write.mode("overwrite").parquet(f"{errors}/of={batch}")

    return log.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
