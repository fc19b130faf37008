"""Jobs as tables: states, latest records, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUEUED, RUNNING, SUCCEEDED, FAILED = "queued", "running", "succeeded", "failed"
TERMINAL = (SUCCEEDED, FAILED)
#: The states that may follow each.
NEXT = {QUEUED: (RUNNING, FAILED), RUNNING: (SUCCEEDED, FAILED), SUCCEEDED: (), FAILED: ()}
RECENT = 20


def allowed(before: Column, after: Column) -> Column:
    """Whether a state may follow another; a job begins queued."""
    out = before.isNull() & (after == QUEUED)
    for state, following in NEXT.items():
        if following:
            out |= (before == state) & after.isin(*following)
    return F.coalesce(out, F.lit(False))


def violations(log: DataFrame, order: str = "at") -> DataFrame:
    """Rows of a log (id, status, ...) whose state may not follow the one before."""
    before = F.lag("status").over(Window.partitionBy("id").orderBy(order))
    return log.withColumn("before", before).where(~allowed(F.col("before"), F.col("status")))


def latest(log: DataFrame, order: str = "at") -> DataFrame:
    """The last record of each job, as an upsert would leave it."""
    rest = [c for c in log.columns if c != "id"]
    return log.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("id", *(F.col(f"_r.{c}").alias(c) for c in rest))


def expired(now: Column | float, ttl: float) -> Column:
    """Whether a finished job is older than its time to live, in seconds."""
    now = now if isinstance(now, Column) else F.lit(float(now))
    return F.coalesce(F.col("status").isin(*TERMINAL) & (F.col("finished_at") < now - ttl), F.lit(False))


def swept(jobs: DataFrame, now: Column | float, ttl: float) -> DataFrame:
    """The jobs that stay."""
    return jobs.where(~expired(now, ttl))


def recent(jobs: DataFrame, n: int = RECENT) -> DataFrame:
    """The newest jobs, without their results."""
    return jobs.drop("result").orderBy(F.desc("created_at"), "id").limit(n)


def due(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs with the place of their result, for those that have one: the result itself lies in the object store."""
    return jobs.join(results.select("id", "result_ref"), "id", "left")
