"""Jobs followed in a stream against plain Python and the batch form."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioloom.operators import jobs
from folioloom.streaming import lifecycle

LOG = "id string, status string, seq long, at timestamp"
START = datetime(2024, 1, 1)


def plain(rows, ttl, watermark):
    illegal, expired = set(), set()
    for job in {r[0] for r in rows} - {None}:
        status = since = None
        for _, now, seq, at in sorted((r for r in rows if r[0] == job and r[3] is not None), key=lambda r: (r[3], r[2])):
            if status in jobs.TERMINAL and since + ttl < at:
                expired.add((job, status, since))
                status = None
            if not (now == "queued" if status is None else now in jobs.NEXT.get(status, ())):
                illegal.add((job, seq, status, now, at))
            status, since = now, at
        if status in jobs.TERMINAL and since + ttl < watermark:
            expired.add((job, status, since))
    return illegal, expired


def run(spark, tmp_path, parts, ttl, late="10 seconds"):
    """The parts land one after another, and a query of its own runs over each."""
    for part in parts:
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
        log = spark.readStream.schema(LOG).parquet(str(tmp_path / "landing"))
        query = lifecycle.follow(log, str(tmp_path / "reports"), str(tmp_path / "checkpoint"), ttl, late)
        assert query.awaitTermination(240)
        time.sleep(0.1)
    return lifecycle.parted(spark, str(tmp_path / "reports"))


def sets(found):
    out = [[tuple(r) for r in df.collect()] for df in found]
    assert all(len(x) == len(set(x)) for x in out)
    return tuple(map(set, out))


def test_any_cut_of_a_log_gives_the_same(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"j{rng.randrange(12)}", rng.choice(["queued", "running", "succeeded", "failed", "queued", "running", "odd"]), k, START + timedelta(seconds=7 * k, microseconds=rng.randrange(10**6))) for k in range(240)]
    rows += [(None, "queued", 1, START), ("j1", "queued", 2, None)]
    watermark = max(r[3] for r in rows if r[3]) - timedelta(seconds=10)
    want = plain(rows, timedelta(seconds=90), watermark)
    assert want[0] and want[1]
    assert sets(run(spark, tmp_path / "whole", [rows], 90)) == want
    # Two restarts; the watermark of a part lies before what follows it.
    assert sets(run(spark, tmp_path / "cut", [rows[:70] + rows[240:], rows[70:170], rows[170:240]], 90)) == want


def test_equal_to_the_batch_form(spark, tmp_path):
    """Without expiry in between, the illegal records are those of ``violations``, and the jobs that stay those of ``swept``."""
    rng = random.Random(2)
    rows = [(f"j{rng.randrange(15)}", rng.choice(["queued", "running", "succeeded", "failed"]), k, START + timedelta(seconds=k)) for k in range(100)]
    rows.append(("last", "queued", 100, START + timedelta(seconds=5000)))
    illegal, expired = run(spark, tmp_path, [rows[:60], rows[60:]], 300)
    log = spark.createDataFrame(rows, LOG)
    assert sets([illegal.select("id", "seq", "before", "status")]) == sets([jobs.violations(log, "seq").select("id", "seq", "before", "status")])
    last = jobs.latest(log.withColumn("finished_at", F.col("at").cast("double")), "seq")
    now = (START + timedelta(seconds=4990) - datetime(1970, 1, 1)).total_seconds()
    stay = {r.id for r in jobs.swept(last, now, 300.0).collect()}
    assert {r.id for r in last.collect()} - stay == {r.id for r in expired.collect()}
