"""Structured Streaming forms of the job stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import TimestampType


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = 1, names: str = "*.parquet") -> DataFrame:
    """Rows of Parquet files as they arrive in a folder; without a number of files, all that are there at once."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", names)
    return (rows if files_per_trigger is None else rows.option("maxFilesPerTrigger", files_per_trigger)).parquet(folder)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Rows of a table, one file or a folder of files, in one batch: files follow neither times nor ids."""
    file = f"{sf_dir}/{name}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    schema = spark.read.parquet(file).schema
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return event_stream(spark, file, schema, None)
    return event_stream(spark, sf_dir, schema, None, f"{name}.parquet")


def progress(events: DataFrame) -> DataFrame:
    """Monotone counters for each visitor."""
    return events.groupBy("visitor").agg(F.max("position").alias("last_position"), F.count("*").alias("events"))


def _admit(most: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("position")
        out = []
        for position, status in zip(rows["position"], rows["status"], strict=True):
            if status == "queued":
                out.append((key[0], position, active < most))
                active += active < most
            elif status in ENDS:
                active = max(0, active - 1)
        state.update((int(active),))
        yield pd.DataFrame(out, columns=["visitor", "position", "admitted"])

    return run


#: What takes a job out of a visitor's active ones.
ENDS = ("completed", "cancelled", "failed", "interrupted")


def admissions(events: DataFrame, per_visitor: int = 2) -> DataFrame:
    """visitor, position, admitted of each submission: a visitor has so many active jobs at most, and finished ones leave."""
    rows = events.select("visitor", "position", "status").groupBy("visitor")
    return rows.applyInPandasWithState(_admit(per_visitor), "visitor long, position long, admitted boolean", "active int", "append", "NoTimeout")


def _serve(millis: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        made = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        timed = rows["at"].notna()
        for event, at in zip(rows["event_id"][timed], rows["at"][timed].astype("datetime64[ms]").astype("int64"), strict=True):
            hit = made is not None and at - made < millis
            made = made if hit else int(at)
            out.append((key[0], event, hit))
        out += [(key[0], event, None if out or i or made is not None else False) for i, event in enumerate(rows["event_id"][~timed])]
        state.update((made,))
        yield pd.DataFrame(out, columns=["key", "event_id", "hit"])

    return run


def cached(requests: DataFrame, minutes: int = 30) -> DataFrame:
    """key, event_id, hit of requests (key, event_id, at): an answer is kept for some minutes after it was made. Whether a request
    without a time is served is unknown (null), but the first of a key is not. Instants are taken in UTC, as the hours of other zones are not all 60 minutes apart."""
    if isinstance(requests.schema["at"].dataType, TimestampType):
        requests = requests.withColumn("at", F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(unix_micros(at) as decimal(20, 0)) / 1000000)"))
    return requests.groupBy("key").applyInPandasWithState(_serve(minutes * 60_000), "key long, event_id long, hit boolean", "made long", "append", "NoTimeout")


def latest(events: DataFrame) -> DataFrame:
    """The newest job of each visitor, whether it is active, and whether any was."""
    live = F.col("status").isin("queued", "running")
    newest = F.max_by(F.struct(F.col("position").alias("position"), live.alias("active")), "position")
    rows = events.groupBy("visitor").agg(newest.alias("x"), F.max(live).alias("was_active"))
    return rows.select("visitor", "x.position", "x.active", "was_active")


def monthly_usage(events: DataFrame, most: int = 4500) -> DataFrame:
    """Calls of each calendar month, up to the quota. A month is no window duration, so it is a plain key."""
    return events.groupBy(F.date_trunc("month", F.col("created_at").cast("timestamp")).alias("month")).agg(F.least(F.count("*"), F.lit(most)).alias("used"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events of each status by window of event time, late rows dropped after the watermark. An addition to the job stream."""
    timed = events.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "status").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "status", "events")


def published(batches: DataFrame, target: str, checkpoint: str):
    """Append each completed batch to a table exactly once: it is written to a hidden folder and then renamed to one named by
    its id, which a retry replaces, so a reader never sees half a batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        jvm = batch.sparkSession.sparkContext._jvm
        path = lambda text: jvm.org.apache.hadoop.fs.Path(text)
        staging, final = path(f"{target}/_staging-{batch_id}"), path(f"{target}/batch={batch_id}")
        batch.write.mode("overwrite").parquet(str(staging.toString()))
        files = final.getFileSystem(batch.sparkSession.sparkContext._jsc.hadoopConfiguration())
        files.delete(final, True)
        if not files.rename(staging, final):
            raise OSError(f"{final.toString()} was not published")

    return batches.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def settled(stream: DataFrame, folder: str):
    """Run a complete-mode aggregate over all that is there now; its last state as a table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state")

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/state")


def appended(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream of rows over all that is there now; its rows as a table."""
    published(stream, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows").select(*stream.columns)
