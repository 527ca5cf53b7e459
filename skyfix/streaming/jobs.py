"""Jobs as a state machine over their log, as a stream and in batch.

A log row is (job_id, key, state, detail, ts, seq). With a key it says what a stage of the job is doing; without one it is the job's own
state, and `done` or `error` ends the run. A run also ends when its job is silent for longer than `timeout`; it then counts as failed, at
the moment the time was over. A row after that begins another run of the job. A failed run's last stage (or a
stage `error`, if there was none) gets the state `error` and the reason.

The stream orders rows by event time: each job keeps the rows that the watermark has not passed, and of the rest only
a summary (a row for each stage). An event-time timer wakes a job when its first waiting row or its silence is due. So rows out of order,
repeated rows and rows late within the watermark's delay make no difference, and a job that has ended leaves no state behind.

Defined cases: rows without job_id or ts are ignored; rows of a job with equal ts and seq are one (of several that differ, the smallest by key, state and
detail, nulls first); a null or empty detail keeps the one before; of rows with equal ts the larger seq is later (null smallest).
A job's rows are ordered by one task, and its waiting rows are held in memory while they are sorted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TIMEOUT = 900.0
LATE = "10 minutes"
ENDED = ("done", "error")
SILENT = "No news in time."
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ROWS = "at long, seq long, key string, state string, detail string"
_STAGES = "key string, state string, detail string, first long, last long"
_OUT = "job_id long, started long, finished long, job_state string, place int, key string, state string, detail string, micros long"


def _order(row: tuple) -> tuple:
    return tuple((x is not None, x) for x in row)


class JobRuns(StatefulProcessor):
    """One job: rows that wait for the watermark, and the summary of its current run."""

    def __init__(self, timeout: float):
        self.timeout = round(timeout * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROWS)
        self.stages = handle.getListState("stages", _STAGES)
        self.run = handle.getValueState("run", "started long, last long, stage string")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.at, r.seq, r.key, r.state, r.detail) for r in rows]
        self.waiting.appendList(new)
        self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed, job = timerValues.getCurrentWatermarkInMs() * 1000, key[0]
        self.due.clear()
        rows = sorted(set(self.waiting.get() if self.waiting.exists() else ()), key=_order)
        ready, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        run = list(self.run.get()) if self.run.exists() else None
        stages = {s[0]: list(s) for s in self.stages.get()} if run else {}
        before = None
        for at, seq, stage, state, detail in ready:
            if (at, seq) == before:
                continue
            before = at, seq
            if run and at - run[1] > self.timeout:
                yield from self._fail(job, run, stages, run[1] + self.timeout, SILENT)
                run, stages = None, {}
            run = run or [at, at, None]
            run[1] = at
            if stage is not None:
                run[2] = stage
                _log(stages, stage, state, detail, at)
            elif state == "error":
                yield from self._fail(job, run, stages, at, detail)
                run, stages = None, {}
            elif state == "done":
                yield from _closed(job, run, stages, at, state)
                run, stages = None, {}
        if run and run[1] + self.timeout <= passed:
            yield from self._fail(job, run, stages, run[1] + self.timeout, SILENT)
            run, stages = None, {}
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if run:
            self.run.update(tuple(run))
            self.stages.put([tuple(s) for s in stages.values()]) if stages else self.stages.clear()
        else:
            self.run.clear()
            self.stages.clear()
        if rest or run:
            self._wake(min([r[0] for r in rest[:1]] + ([run[1] + self.timeout] if run else [])))

    def _wake(self, at: int) -> None:
        """A timer at the first millisecond that is not before `at`, unless there is one no later."""
        at = -(-at // 1000)
        if not self.due.exists() or at < self.due.get()[0]:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def _fail(self, job: int, run: list, stages: dict[str, list], at: int, reason: str | None) -> Iterator[Row]:
        _log(stages, run[2] or "error", "error", reason, at)
        return _closed(job, run, stages, at, "error")


def _log(stages: dict[str, list], key: str, state: str | None, detail: str | None, at: int) -> None:
    known = stages.setdefault(key, [key, state, None, at, at])
    known[1], known[2], known[4] = state, detail or known[2], at


def _closed(job: int, run: list, stages: dict[str, list], at: int, state: str) -> Iterator[Row]:
    own = [(place, key, last_state, detail, last - first) for place, (key, last_state, detail, first, last) in enumerate(stages.values(), 1)]
    for place, key, last_state, detail, micros in own or [(None,) * 5]:
        yield Row(job_id=job, started=run[0], finished=at, job_state=state, place=place, key=key, state=last_state, detail=detail, micros=micros)


def _public(rows: DataFrame) -> DataFrame:
    return rows.select(
        "job_id",
        F.timestamp_micros("started").alias("started_at"),
        F.timestamp_micros("finished").alias("finished_at"),
        "job_state",
        F.round((F.col("finished") - F.col("started")) / 1e6, 3).alias("elapsed"),
        "place",
        "key",
        "state",
        "detail",
        F.round(F.col("micros") / 1e6, 3).alias("seconds"),
    )


def _rows(log: DataFrame) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return log.select(F.col("job_id").cast("long"), at.alias("ts"), F.unix_micros(at).alias("at"), F.col("seq").cast("long"), "key", "state", "detail").filter("job_id IS NOT NULL AND ts IS NOT NULL")


def stream_runs(log: DataFrame, timeout: float = TIMEOUT, late: str = LATE) -> DataFrame:
    """The stages of every run of a streamed log, each run once, when it has ended and the watermark has passed its end. Append mode; needs
    a session whose state store is RocksDB (see rocksdb())."""
    watched = _rows(log).withWatermark("ts", late)
    return _public(watched.groupBy("job_id").transformWithState(JobRuns(timeout), _OUT, "Append", "EventTime"))


def passed(log: DataFrame, late: str = LATE) -> Column:
    """Over all rows: the watermark, in microseconds, after a stream has read the whole log."""
    span = F.expr(f"INTERVAL {late}")
    return F.unix_micros(F.timestamp_millis(F.unix_millis(F.max("ts"))) - span)


def runs(log: DataFrame, timeout: float = TIMEOUT, late: str = LATE) -> DataFrame:
    """What stream_runs() has written after it has read the whole log."""
    limit = round(timeout * 1e6)
    rows = _rows(log)
    until = rows.agg(passed(rows, late).alias("until"))
    rows = rows.groupBy("job_id", "ts", "at", "seq").agg(F.min(F.struct("key", "state", "detail")).alias("r")).select("job_id", "at", "seq", "r.*")
    rows = rows.join(F.broadcast(until)).filter("at <= until")  # one row, one figure
    in_turn = Window.partitionBy("job_id").orderBy("at", "seq")
    ends = F.col("key").isNull() & F.coalesce(F.col("state").isin(*ENDED), F.lit(False))
    fresh = F.lag("at").over(in_turn).isNull() | (F.col("at") - F.lag("at").over(in_turn) > limit) | F.lag(ends).over(in_turn)
    rows = rows.withColumn("ends", ends).withColumn("fresh", fresh).withColumn("run", F.sum(F.col("fresh").cast("int")).over(in_turn))
    when = F.struct("at", "seq")
    of = rows.groupBy("job_id", "run").agg(
        F.min("at").alias("started"),
        F.max("at").alias("last"),
        F.max_by("key", F.when(F.col("key").isNotNull(), when)).alias("stage"),
        F.max(F.when(F.col("ends"), F.col("state"))).alias("ended"),
        F.max(F.when(F.col("ends"), F.col("detail"))).alias("reason"),
        F.first("until").alias("until"),
    )
    of = of.filter((F.col("last") + limit <= F.col("until")) | F.col("ended").isNotNull())
    of = of.withColumns({"job_state": F.coalesce("ended", F.lit("error")), "finished": F.col("last") + F.when(F.col("ended").isNull(), limit).otherwise(0), "reason": F.when(F.col("ended").isNull(), SILENT).otherwise(F.col("reason"))})
    failed = of.filter("job_state = 'error'").select("job_id", "run", F.coalesce("stage", F.lit("error")).alias("key"), F.lit("error").alias("state"), F.col("reason").alias("detail"), F.col("finished").alias("at"), F.lit(None).cast("long").alias("seq"), F.lit(1).alias("by"))
    said = rows.filter("key IS NOT NULL").select("job_id", "run", "key", "state", "detail", "at", "seq", F.lit(0).alias("by")).unionByName(failed)
    order = F.struct("by", "at", "seq")
    known = F.nullif(F.col("detail"), F.lit(""))
    stages = said.groupBy("job_id", "run", "key").agg(F.max_by("state", order).alias("state"), F.max_by(known, F.when(known.isNotNull(), order)).alias("detail"), F.min(order).alias("first"), (F.max("at") - F.min("at")).alias("micros"))
    stages = stages.withColumn("place", F.row_number().over(Window.partitionBy("job_id", "run").orderBy("first")))
    return _public(of.join(stages, ["job_id", "run"], "left"))


class rocksdb:
    """With it, streams started inside keep their state in RocksDB, in `partitions` parts."""

    def __init__(self, spark: SparkSession, partitions: int | None = None):
        self.spark, self.new = spark, {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism)}

    def __enter__(self) -> None:
        self.old = {k: self.spark.conf.get(k, None) for k in self.new}
        for k, v in self.new.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_) -> None:
        for k, v in self.old.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def drained(stream: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that its sources hold now; its result, read from a table under root, a folder that the cluster shares."""
    place = f"{root}/stream-{uuid.uuid4().hex}"
    running = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{place}/rows").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/rows")
