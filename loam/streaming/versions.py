"""Versions of keys as a stream: each change or rollback that arrives is the key's next version, across restarts.

State is tables in the shared folder, not memory: a folder of versions for each batch, and how many versions each key
has, put as one commit a batch. A batch that is tried again writes the same folder again and commits once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loam.session import discard, written
from loam.sources import tables


def all_versions(spark: SparkSession, root: str, batches: int | None = None) -> DataFrame:
    """(key, idx, ts, origin, error, data) of the committed batches: version idx of a key has the data of version origin."""
    done = tables.latest(spark, root) if batches is None else batches
    if not done:
        raise ValueError(f"no versions in {root}")
    return spark.read.parquet(*(f"{root}/versions/{b}" for b in range(done)))


def add(rows: DataFrame, batch: int, root: str) -> None:
    """Makes rows (key, ts, tie, back, data) the next versions of their keys, in the order of ts and tie; a batch below the last commit is there already.

    back: null for a change, else the version to which the key goes back: its data are those of that version. A version
    that is not there is told in `error`, and the key stays as it was. Rows of one key in one batch are numbered by a
    window; earlier versions are joined, not gathered.
    """
    spark = rows.sparkSession
    if tables.latest(spark, root) > batch:
        return
    order = Window.partitionBy("key").orderBy("ts", "tie")
    numbered = rows.select("key", "ts", "back", "data", (F.row_number().over(order) - 1).cast("long").alias("idx"))
    if batch:
        known = tables.load_all(spark, root, batch)[1]["counts"]
        numbered = numbered.join(known.withColumnRenamed("versions", "before"), "key", "left").withColumn("idx", F.col("idx") + F.coalesce("before", F.lit(0))).drop("before")
    there = F.col("back").between(0, F.col("idx") - 1)
    to = F.when(F.col("back").isNull(), F.col("idx")).when(there, F.col("back")).otherwise(F.col("idx") - 1)
    error = F.when(F.col("back").isNotNull() & ~there, F.concat(F.lit("no version "), F.col("back").cast("string")))
    now = written(numbered.select("key", "idx", "ts", to.alias("origin"), error.alias("error"), F.when(F.col("back").isNull(), F.col("data")).alias("data")), "versions")
    earlier = all_versions(spark, root, batch).select("key", F.col("idx").alias("origin"), F.col("origin").alias("further")) if batch else None
    while True:  # a version may go back to one that went back itself; each round goes twice as far
        links = now.select("key", F.col("idx").alias("origin"), F.col("origin").alias("further"))
        links = links if earlier is None else links.unionByName(earlier)
        far = written(now.join(links, ["key", "origin"], "left").select("key", "idx", "ts", F.coalesce("further", "origin").alias("next"), "origin", "error", "data"), "versions")
        moved = not far.where("next <> origin").isEmpty()
        before, now = now, written(far.select("key", "idx", "ts", F.col("next").alias("origin"), "error", "data"), "versions")
        discard(before, far)
        if not moved:
            break
    now.write.mode("overwrite").parquet(f"{root}/versions/{batch}")
    counts = now.groupBy("key").agg((F.max("idx") + 1).alias("versions"))
    if batch:
        counts = counts.unionByName(known).groupBy("key").agg(F.max("versions").alias("versions"))
    tables.commit_all({"counts": counts}, root, based_on=batch)
    discard(now)


def keep(changes: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Versions of all changes (see add) that are there now, each once, across restarts; batches are those of the checkpoint."""
    return changes.writeStream.foreachBatch(lambda rows, batch: add(rows, batch, root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history(versions: DataFrame) -> DataFrame:
    """(key, idx, ts, data, error) of all versions, with the data that each has."""
    data = versions.where("idx = origin").select("key", F.col("idx").alias("origin"), F.col("data").alias("has"))
    return versions.join(data, ["key", "origin"], "left").select("key", "idx", "ts", F.col("has").alias("data"), "error")


def as_of(versions: DataFrame, ts) -> DataFrame:
    """(key, idx, data): the last version of each key up to a time; versions combine in each task before they are dealt."""
    last = versions.where(F.col("ts") <= F.lit(ts)).groupBy("key").agg(F.max(F.struct("idx", "origin")).alias("last")).select("key", "last.idx", "last.origin")
    data = versions.where("idx = origin").select("key", F.col("idx").alias("origin"), "data")
    return last.join(data, ["key", "origin"], "left").select("key", "idx", "data")
