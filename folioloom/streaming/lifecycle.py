"""Jobs followed in a stream: state for each job, and timers for its time to live.

A log (id, status, at) is grouped by id.  Value state holds a job's last status and
when that was set.  A record whose status may not follow the one before is
reported.  A job that is finished gets a timer for the end of its time to live, in
event time; when the watermark has passed it, the job is reported as expired and
its state goes.  What is reported depends on the records' times only, not on how
they fall into micro-batches: a record that comes after its job's time to live
ends it, as the timer would have, and begins anew.

Both kinds of report leave in one stream, so one query and one checkpoint hold
them; ``parted`` divides what it has written.

Defined cases: records of a job have to arrive in order, but for those of one
micro-batch, which are put in order by ``at`` and ``seq``; records without an id or
a time are left out, as are those that the watermark has passed; a status that
isn't known may follow nothing and is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.jobs import NEXT, QUEUED, TERMINAL

#: What a job's state holds: its last status and when that was set, in microseconds.
STATE = "status string, at long"
#: What is reported: an illegal record with the status before it, or an expired job with its end.
REPORTS = "report string, id string, seq long, before string, status string, at timestamp"
#: Times are microseconds within, as timers don't know the session's time zone.
_MADE = "report string, id string, seq long, before string, status string, us long"
ILLEGAL, EXPIRED = "illegal", "expired"

# Fixed value: the only kind of state store that has timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lifecycle(StatefulProcessor):
    """Follows one job at a time."""

    def __init__(self, ttl: float) -> None:
        self.ttl = round(ttl * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", STATE)

    def _timer(self, at: int) -> int:
        """The first millisecond after a finished job's time to live."""
        return (at + self.ttl) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Reports illegal records, and what a record shows to have expired."""
        some = pd.concat(list(rows)).sort_values(["us", "seq"], kind="stable")
        out = []
        status, since = self.state.get() if self.state.exists() else (None, 0)
        if status in TERMINAL:
            self.handle.deleteTimer(self._timer(since))
        for seq, now, at in zip(some["seq"], some["status"], some["us"].tolist(), strict=True):
            if status in TERMINAL and since + self.ttl < at:
                out.append((EXPIRED, key[0], None, None, status, since))
                status = None
            if not (now == QUEUED if status is None else now in NEXT.get(status, ())):
                out.append((ILLEGAL, key[0], seq, status, now, at))
            status, since = now, at
        self.state.update((status, since))
        if status in TERMINAL:
            self.handle.registerTimer(self._timer(since))
        yield _reports(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Reports a job whose time to live has passed."""
        status, since = self.state.get() if self.state.exists() else (None, 0)
        if status in TERMINAL and self._timer(since) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield _reports([(EXPIRED, key[0], None, None, status, since)])
        else:
            yield _reports([])

    def close(self) -> None:
        pass


def _reports(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["report", "id", "seq", "before", "status", "us"]).astype({"seq": "Int64", "us": "Int64"})


def followed(log: DataFrame, ttl: float, late: str = "1 hour") -> DataFrame:
    """The reports of a stream (id, status, seq, at timestamp); ``ttl`` in seconds, ``late`` how long records may be behind."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = log.select(F.col("id").cast("string").alias("id"), "status", F.col("seq").cast("long").alias("seq"), "at", F.unix_micros("at").alias("us")).where("id is not null and at is not null")
    made = rows.withWatermark("at", late).groupBy("id").transformWithStateInPandas(Lifecycle(ttl), _MADE, "append", "eventTime")
    return made.select("report", "id", "seq", "before", "status", F.timestamp_micros("us").alias("at"))


def follow(log: DataFrame, path: str, checkpoint: str, ttl: float, late: str = "1 hour", available_now: bool = True) -> StreamingQuery:
    """Writes the reports of a stream to a folder; a query that begins again goes on where the last ended."""
    writer = followed(log, ttl, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def parted(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(illegal records, expired jobs) of a folder of reports."""
    reports = spark.read.schema(REPORTS).parquet(path)
    illegal = reports.where(F.col("report") == ILLEGAL).select("id", "seq", "before", "status", "at")
    return illegal, reports.where(F.col("report") == EXPIRED).select("id", "status", F.col("at").alias("finished_at"))
