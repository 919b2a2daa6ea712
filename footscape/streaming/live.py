"""Incremental variants: live reports, observations, verifications, usage and navigation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from footscape import params as P
from footscape.operators import reports as R
from footscape.plans import incremental as IN
from footscape.session import cut, stored
from footscape.sources.exchange import write_upsert


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    return spark.read.parquet(path) if exists else None


def usage_stream(calls: DataFrame) -> DataFrame:
    """Daily counters; calls up to a day late still reach their own day (use update mode)."""
    return calls.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w")).agg(
        F.count_if(F.col("outcome") != "cached").alias("calls"), F.count_if(F.col("outcome") == "cached").alias("cached"),
        F.count_if(F.col("outcome") == "failed").alias("failed")).select(
        F.date_format(F.col("w")["start"], "yyyy-MM-dd").alias("day"), "calls", "cached", "failed")


def stream_reports(reports: DataFrame, edges: DataFrame, table: str, duplicates: str, checkpoint: str, now: Callable[[], Column]):
    """New reports: check, match to a segment, store, and list duplicate candidates.

    The candidates are the stored open reports of the last 45 days, so the window is
    kept in a table and not in stream state; each batch id is written once.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        good = R.importable_reports(df.dropDuplicates(["report_id"])).filter(F.size("errors") == 0).drop("errors")
        matched = R.match_reports(good.drop("segment_id"), edges).withColumn("segment_id", F.col("matched_segment")).drop("matched_segment")
        matched = cut(matched)
        write_upsert(matched, table, ["report_id"])
        open_ = R.filter_open_reports(_table(spark, table), now())
        pairs = R.duplicate_pairs(matched, open_)
        pairs.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{duplicates}/batch={batch_id}")

    return reports.withWatermark("created_at", "45 days").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def stream_observations(obs: DataFrame, segments: Callable[[SparkSession], DataFrame], observations: str, reports: Callable[[SparkSession], DataFrame],
                        assessments: str, checkpoint: str, now: Callable[[], Column], params: P.Params = P.DEFAULT):
    """New observations are stored and only the segments they touch are assessed again."""
    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        new = stored(df)
        write_upsert(new, observations, ["observation_id"])
        fresh = IN.observation_batch(new, segments(spark), _table(spark, observations), reports(spark), now(), params)
        write_upsert(fresh.drop("explanation"), assessments, ["segment_id"])

    return obs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def stream_verifications(events: DataFrame, segments: str, observations: str, reports: str, assessments: str, checkpoint: str,
                         now: Callable[[], Column], after: Callable[[DataFrame], None] | None = None):
    """New verifications change the segment, its assessment and, through `after`, its priority."""
    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        changed, fresh = IN.verification_batch(df, _table(spark, segments), _table(spark, observations), _table(spark, reports), _table(spark, assessments), now())
        write_upsert(changed, segments, ["segment_id"])
        write_upsert(fresh.drop("explanation"), assessments, ["segment_id"])
        if after is not None:
            after(fresh)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


PROGRESS = "session_id string, ts timestamp, step int, advanced boolean, off_route boolean, remaining_m double"
STEP_STATE = "step int"


class NavigationProcessor(StatefulProcessor):
    """Current step per session; the state is one number and ends after half an hour of silence.

    Input rows carry the ping and, from a join with the route's steps, the metres to
    the start of every step (`to_steps`), so that the processor only moves the index.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.step = handle.getValueState("step", STEP_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        pings = pd.concat(list(rows)).sort_values("ts")
        at = self.step.get()[0] if self.step.exists() else 0
        out = []
        for p in pings.itertuples(index=False):
            near = list(p.to_steps)
            advanced = bool(at < len(near) - 1 and near[at] < P.ADVANCE_M)
            at += int(advanced)
            out.append((key[0], p.ts, at, advanced, bool(p.off_m > P.OFF_ROUTE_M), float(p.remaining_m)))
        self.step.update((at,))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + 30 * 60 * 1000)
        yield pd.DataFrame(out, columns=["session_id", "ts", "step", "advanced", "off_route", "remaining_m"])

    def handleExpiredTimer(self, key, timers, info) -> Iterator[pd.DataFrame]:
        self.step.clear()
        return iter([])

    def close(self) -> None:
        pass


def navigation_stream(pings: DataFrame) -> DataFrame:
    """pings: (session_id, ts, off_m, remaining_m, to_steps array<double>) to progress rows; needs the RocksDB state store."""
    return pings.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=NavigationProcessor(), outputStructType=PROGRESS, outputMode="Append", timeMode="ProcessingTime")
