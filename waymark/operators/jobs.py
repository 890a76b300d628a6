"""Job tables: latest state, queue, history pages, admission, quota, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("queued", "running")
TERMINAL = ("completed", "cancelled", "failed", "interrupted")
#: What may follow what.
NEXT = {"queued": ("running", "cancelled", "failed"), "running": ("completed", "cancelled", "failed", "interrupted")}


def latest(jobs: DataFrame, *keys: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col("position").desc())
    return jobs.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def recovered(jobs: DataFrame) -> DataFrame:
    """After a restart, what ran is interrupted."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


def invalid_transitions(jobs: DataFrame, *keys: str) -> DataFrame:
    """Rows whose status may not follow the one before."""
    before = F.lag("status").over(Window.partitionBy(*keys).orderBy("position"))
    fine = F.lit(False)
    for status, after in NEXT.items():
        fine |= (F.col("before") == status) & F.col("status").isin(*after)
    return jobs.withColumn("before", before).where(F.col("before").isNotNull() & ~fine)


def fifo(jobs: DataFrame) -> DataFrame:
    """The queued job that comes next."""
    return jobs.where("status = 'queued'").orderBy("position").limit(1)


def queue_positions(jobs: DataFrame, width: int = 100_000) -> DataFrame:
    """Each queued job's place in the one queue: counted within ranges of positions, then over the ranges."""
    rows = jobs.where("status = 'queued'").withColumn("part", F.floor(F.col("position") / width))
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))  # one row for each range
    here = F.row_number().over(Window.partitionBy("part").orderBy("position"))
    return rows.withColumn("here", here).join(parts, "part").withColumn("queue_position", (F.col("before") + F.col("here")).cast("long")).drop("part", "before", "here")


def history_page(jobs: DataFrame, before: int | None = None, size: int = 50) -> DataFrame:
    """A page, newest first, before a position; one row more than the page tells that there is a next one."""
    rows = jobs if before is None else jobs.where(F.col("position") < before)
    return rows.orderBy(F.col("position").desc()).limit(size + 1)


def admission(jobs: DataFrame, per_visitor: int = 2, overall: int = 20) -> DataFrame:
    """visitor, active, admitted: whether one more job of the visitor may enter."""
    counts = jobs.groupBy("visitor").agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("active"))
    every = counts.agg(F.sum("active").alias("all_active"))
    return counts.crossJoin(F.broadcast(every)).select("visitor", "active", ((F.col("active") < per_visitor) & (F.col("all_active") < overall)).alias("admitted"))  # one row


def monthly_usage(calls: DataFrame, most: int = 4500) -> DataFrame:
    """month, used: calls granted in each calendar month (UTC), never over the quota and never refunded."""
    return calls.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.least(F.count("*"), F.lit(most)).alias("used"))


def merge(old: DataFrame, new: DataFrame, terminal: int = 50) -> DataFrame:
    """Both lists by position, the new row winning; all active jobs and the newest `terminal` others of each visitor."""
    both = old.select("position", F.struct(*old.columns).alias("o")).join(new.select("position", F.struct(*old.columns).alias("n")), "position", "full")
    rows = both.select(F.coalesce("n", "o").alias("r")).select("r.*")
    ended = F.when(~F.col("status").isin(*ACTIVE), 1).otherwise(0)
    w = Window.partitionBy("visitor").orderBy(F.col("position").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("nth", F.sum(ended).over(w)).where((ended == 0) | (F.col("nth") <= terminal)).drop("nth")


def finished(was_active: DataFrame, now: DataFrame) -> DataFrame:
    """Positions that were active and no longer are."""
    return was_active.where(F.col("status").isin(*ACTIVE)).join(now.where(F.col("status").isin(*ACTIVE)).select("position"), "position", "left_anti")


def redacted(jobs: DataFrame, visitor: int) -> DataFrame:
    """Another visitor's jobs without what they were asked with."""
    own = F.col("visitor") == visitor
    return jobs.withColumn("owner", own).withColumn("value", F.when(own, F.col("value")))


def elapsed(jobs: DataFrame) -> DataFrame:
    """Milliseconds since the visitor's job before."""
    before = F.lag("created_at").over(Window.partitionBy("visitor").orderBy("position"))
    return jobs.withColumn("before", before).withColumn("elapsed_ms", F.expr("timestampdiff(MILLISECOND, before, created_at)")).drop("before")


def active(jobs: DataFrame, visitor: int | None = None) -> DataFrame:
    """Queued and running jobs, of one visitor or of all, newest first."""
    rows = jobs.where(F.col("status").isin(*ACTIVE))
    return (rows if visitor is None else rows.where(F.col("visitor") == visitor)).orderBy(F.col("position").desc())


def authorized(jobs: DataFrame, visitor: int, change: bool = False) -> DataFrame:
    """Jobs with outcome: 404 for those a visitor may not see, 403 for those they may not change, else 200."""
    own = F.col("visitor") == visitor
    hidden = F.when(~own & (F.col("status") != "completed"), 404)
    return jobs.withColumn("outcome", (hidden.when(~own, 403) if change else hidden).otherwise(200))


def without(rows: DataFrame, gone: DataFrame, key: str = "position") -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def cancelled(jobs: DataFrame) -> DataFrame:
    """Jobs with the status after a cancellation: active ones end, what is over stays."""
    return jobs.withColumn("after", F.when(F.col("status").isin(*ACTIVE), "cancelled").otherwise(F.col("status")))
