"""Append-only journals: batch replay, the event state machine, and the same over a stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from talweg.schema import JOURNAL

# State -> event -> next state.
MOVES = {"none": {"started": "started"}, "started": {"generated": "generated", "failed": "failed"}}
TERMINAL = ("generated", "failed")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the journal's schema; a broken line fails the read."""
    return spark.read.schema(JOURNAL).option("mode", "FAILFAST").json(path)


def read_journal_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(JOURNAL).json(path)


def _next(state: Column, event: Column) -> Column:
    out = F.lit("invalid")
    for a, by in MOVES.items():
        for e, b in by.items():
            out = F.when((state == a) & (event == e), b).otherwise(out)
    return out


def replayed(journal: DataFrame, key: str = "candidate_id", line: str = "line", event: str = "event") -> DataFrame:
    """(key, n_events, state): state after all events in line order; ``invalid`` once an order is broken."""
    events = F.array_sort(F.collect_list(F.struct(line, event)))[event]
    out = journal.groupBy(key).agg(F.count("*").alias("n_events"), events.alias("_e"))
    return out.select(key, "n_events", F.aggregate("_e", F.lit("none"), _next).alias("state"))


def order_faults(journal: DataFrame, key: str = "candidate_id", line: str = "line", event: str = "event") -> DataFrame:
    """(key, line, event): events that may not follow the one before, by a window."""
    before = F.lag(event).over(Window.partitionBy(key).orderBy(line))
    ok = F.when(before.isNull(), F.col(event) == "started").otherwise((before == "started") & F.col(event).isin(*TERMINAL))
    return journal.withColumn("_ok", ok).where("NOT coalesce(_ok, false)").select(key, line, event)


def event_issues() -> Column:
    """Issues of one event: terminal events carry what they must and nothing else."""
    done, failed = F.col("event") == "generated", F.col("event") == "failed"
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("event").isin("started", *TERMINAL), F.lit(False)), "event: not allowed"),
            F.when(done & ~F.coalesce(F.col("output_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "output_sha256: missing"),
            F.when(~done & F.col("output_sha256").isNotNull(), "output_sha256: not generated"),
            F.when(failed & F.col("error").isNull(), "error: missing"),
            F.when(~failed & F.col("error").isNotNull(), "error: not failed"),
        )
    )


def unmatched(journal: DataFrame, tasks: DataFrame, key: str = "candidate_id") -> DataFrame:
    """(key, n_tasks) of journal rows that do not belong to exactly one task."""
    n = tasks.groupBy(key).agg(F.count("*").alias("_n"))
    out = journal.select(key).distinct().join(n, key, "left").select(key, F.coalesce("_n", F.lit(0)).cast("long").alias("n_tasks"))
    return out.where("n_tasks <> 1")


def remaining(tasks: DataFrame, journal: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Tasks without a terminal event."""
    return tasks.join(journal.where(F.col("event").isin(*TERMINAL)).select(key).distinct(), key, "left_anti")


def trace_faults(base: DataFrame, journal: DataFrame, listing: DataFrame, key: str, path: Column) -> DataFrame:
    """(key, fault): rows without exactly one planned and one generated event, or whose file is missing or foreign."""
    counts = journal.groupBy(key).agg(F.count_if(F.col("event") == "planned").alias("p"), F.count_if(F.col("event") == "generated").alias("g"))
    rows = base.select(key, path.alias("path"), F.lit(True).alias("_base")).join(counts, key, "full_outer")
    rows = rows.join(listing.select("path", F.lit(True).alias("_file")), "path", "full_outer")
    fault = (
        F.when(F.col(key).isNull(), "foreign file")
        .when(F.col("_base").isNull(), "foreign event")
        .when(F.coalesce(F.col("p"), F.lit(0)) != 1, "planned")
        .when(F.coalesce(F.col("g"), F.lit(0)) != 1, "generated")
        .when(F.col("_file").isNull(), "no file")
    )
    return rows.select(F.coalesce(F.col(key).cast("string"), F.col("path")).alias("key"), fault.alias("fault")).where("fault IS NOT NULL")


# ---- streams -----------------------------------------------------------------------------------------

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATES = "n_events bigint, n_repeated bigint, state string, closed boolean"


class _Candidate(StatefulProcessor):
    """State machine of one key: where it stands, how many events it took, the last line and its latest time."""

    def __init__(self, key: str, line: str, event: str, time: str, idle_ms: int):
        self.names, self.idle_ms = (key, line, event, time), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "state string, n bigint, repeated bigint, line bigint, latest bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        name, line, event, time = self.names
        now, n, repeated, last, latest = self.at.get() if self.at.exists() else ("none", 0, 0, -1, 0)
        some = pd.concat(list(rows)).sort_values([line, event])
        for number, what, when in zip(some[line], some[event], some[time], strict=True):
            latest = max(latest, int(pd.Timestamp(when).timestamp() * 1000))
            if number <= last:  # read again after a restart, or written twice
                repeated += 1
                continue
            now, n, last = MOVES.get(now, {}).get(what, "invalid"), n + 1, int(number)
        self.at.update((now, n, repeated, last, latest))
        self.handle.registerTimer(latest + self.idle_ms)
        yield pd.DataFrame({name: [key[0]], "n_events": [n], "n_repeated": [repeated], "state": [now], "closed": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.at.exists():
            return
        now, n, repeated, _, latest = self.at.get()
        if latest + self.idle_ms > expiredTimerInfo.getExpiryTimeInMs():  # a later event has a later timer
            return
        self.at.clear()
        yield pd.DataFrame({self.names[0]: [key[0]], "n_events": [n], "n_repeated": [repeated], "state": [now], "closed": [True]})

    def close(self) -> None:
        pass


def stream_states(events: DataFrame, time: str, *, delay: str = "10 minutes", idle: int = 3_600, key: str = "candidate_id", line: str = "line", event: str = "event") -> DataFrame:
    """Streaming state machine: (key, n_events, n_repeated, state, closed), a row whenever a key changes.

    Events of a micro-batch are taken in line order, as in the batch replay; a line not above the key's
    last one is a repetition and moves nothing.  Events later than ``delay`` behind the newest are left out
    by the watermark.  When the watermark is ``idle`` seconds beyond a key's latest event the key is closed:
    its last row says so and its state goes, so what is kept are the keys of the last ``idle`` seconds.
    Sets the session's state store to RocksDB, which timers need.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    seen = events.where(F.col(key).isNotNull() & F.col(line).isNotNull() & F.col(time).isNotNull()).withWatermark(time, delay).select(key, line, event, time)
    kind = events.schema[key].dataType.simpleString()
    return seen.groupBy(key).transformWithStateInPandas(_Candidate(key, line, event, time, idle * 1000), f"{key} {kind}, {STATES}", "update", "eventTime")


# ---- appending ---------------------------------------------------------------------------------------


def append_once(events: DataFrame, folder: str, batch: int) -> bool:
    """Append a batch to a journal as ``<folder>/batch=<batch>``, unless that batch is there already.

    Rows are written beside the journal, closed (which syncs them in stores that keep them), and renamed as
    a whole, so readers see all of a batch or none of it and a batch that runs again changes nothing.
    """
    spark = events.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = hadoop(f"{folder}/batch={batch}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        return False
    stage = hadoop(f"{folder}/_stage-{batch}-{uuid.uuid4().hex}")  # readers pass over names that begin so
    try:
        events.write.json(stage.toString())
        return bool(fs.rename(stage, target)) and fs.exists(target)
    finally:
        if fs.exists(stage):
            fs.delete(stage, True)


def appended(events: DataFrame, folder: str, checkpoint: str):
    """Writer of a stream into a journal, each micro-batch once, whatever restarts there are; ``start()`` it."""
    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: append_once(df, folder, batch) and None)


def replay_faults(journal: DataFrame, tasks: DataFrame, key: str, bound: Sequence[str]) -> DataFrame:
    """(key, fault): journal keys without exactly one task, with several rows, or whose ``bound`` columns differ from the task's."""
    n = tasks.groupBy(key).agg(F.count("*").alias("_tasks"), *[F.min(c).alias(f"_t_{c}") for c in bound])
    j = journal.groupBy(key).agg(F.count("*").alias("_rows"), *[F.min(c).alias(f"_j_{c}") for c in bound])
    both = j.join(n, key, "left")
    tests = [(F.coalesce("_tasks", F.lit(0)) != 1, "task"), (F.col("_rows") > 1, "repeated")]
    tests += [((F.col("_tasks") == 1) & ~F.col(f"_j_{c}").eqNullSafe(F.col(f"_t_{c}")), c) for c in bound]
    faults = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for c, name in tests]), lambda x: x.isNotNull())
    return both.select(key, F.explode(faults).alias("fault"))
