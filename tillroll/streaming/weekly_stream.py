"""Weekly tumbling sums on a stream, with open weeks as state.

``window(ts, '7 days', '7 days', '4 days')`` gives Monday-to-Monday windows
(epoch day 0 is a Thursday); the label is ``window.end - 1 day``, the Sunday
of G1.

Each micro-batch is summed by week map-side and then meets the state the batch
before left: the sums of weeks that are still open, and the largest event time
seen.  A week closes when the watermark (that time less ``delay``) has passed
its end; its sums are written once.  Events of weeks that closed before their
batch began are late: their sums go to the late table instead of being
dropped.  Readers add closed weeks, late sums and the weeks still open, so
every event counts once, in whatever order files arrive and however they are
cut into batches.

State is as large as the open weeks.  Every ``compact`` batches the written
sums are folded into one table and the folded folders are removed, so the sink
holds at most about that many folders however long the stream runs.  A batch
writes only folders that carry its number, after reading those of the batch
before, so a replayed batch replaces its own output; a folded table counts only
when it is complete, and takes the place of all batches up to its number.  Gap
weeks are filled at read time (``weekly_dense``).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: How far event times may lag behind before a week is closed, in days; batches between two foldings.
DELAY_DAYS, COMPACT = 14, 16

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def wall_clock(events: DataFrame, ts: str = "ts") -> Column:
    """Event times are wall-clock (timestamp_ntz).  Shifted so the epoch equals
    the wall clock read as UTC, windows start on Monday 00:00 wall clock
    whatever the session time zone is."""
    tz = events.sparkSession.conf.get("spark.sql.session.timeZone")
    return F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz)


def weekly_partial_sums(events: DataFrame, ts: str = "ts", value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums and counts of a batch of events by week and ``keys``."""
    tz = events.sparkSession.conf.get("spark.sql.session.timeZone")
    s = events.withColumn("_ts", wall_clock(events, ts))
    g = s.groupBy(F.window("_ts", "7 days", "7 days", "4 days").alias("w"), *keys).agg(
        F.sum(value).alias("weekly_sales_sum"), F.count(F.lit(1)).alias("events"))
    end_day = F.to_date(F.to_utc_timestamp(F.col("w.end"), tz))
    return g.select(F.date_sub(end_day, 1).alias("date"), *keys, "weekly_sales_sum", "events")


@dataclass
class Sink:
    """Folders of a stream's results below ``path``."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    delay: int = DELAY_DAYS
    compact: int = COMPACT

    def __post_init__(self):
        types = {f.split()[0]: f.split()[1] for f in EVENT_SCHEMA.split(", ")}
        own = "".join(f", {k} {types.get(k, 'string')}" for k in self.keys)
        self.schema = f"kind string, date date{own}, weekly_sales_sum double, events bigint, mark timestamp"

    def _fs(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def numbers(self, kind: str) -> list[int]:
        """Numbers of the complete folders of a kind: state, batch or base."""
        fs, path = self._fs()
        top = path(f"{self.path}/{kind}")
        if not fs.exists(top):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(top)]
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(path(f"{self.path}/{kind}/{n}/_SUCCESS")))

    def _read(self, kind: str, number: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{kind}/{number}")

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def _sum(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("kind", "date", *self.keys).agg(
            F.sum("weekly_sales_sum").alias("weekly_sales_sum"), F.sum("events").alias("events"), F.max("mark").alias("mark"))

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{kind}/{number}")

    def add(self, batch: DataFrame, number: int) -> None:
        if number in self.numbers("base"):
            return  # folded already: the batch is replayed after its last step
        before = self._read("state", number - 1) if number - 1 in self.numbers("state") else self._none()
        seen = before.where("kind = 'mark'").agg(F.max("mark").alias("m")).first().m
        sums = weekly_partial_sums(batch, keys=self.keys).withColumns({"kind": F.lit("open"), "mark": F.lit(None).cast("timestamp")})
        newest = batch.agg(F.max(wall_clock(batch)).alias("m")).first().m
        mark = max((m for m in (seen, newest) if m is not None), default=None)
        # what the watermark had closed before this batch, and what it closes with it
        over = lambda m: F.lit(False) if m is None else F.col("date") < F.date_sub(F.to_date(F.lit(m)), self.delay)
        late = sums.where(over(seen)).withColumn("kind", F.lit("late"))
        weeks = self._sum(before.where("kind = 'open'").unionByName(sums.where(~over(seen))))
        closed = weeks.where(over(mark)).withColumn("kind", F.lit("closed"))
        self._write(self._sum(closed.unionByName(late)), "batch", number)
        kept = self.spark.createDataFrame([(m,) for m in [mark] if m is not None], "mark timestamp").withColumn("kind", F.lit("mark"))
        self._write(weeks.where(~over(mark)).unionByName(kept, allowMissingColumns=True).select(*self._none().columns), "state", number)
        if number % self.compact == self.compact - 1:
            self._write(self._sum(self.written()), "base", number)
        self._tidy(number)

    def _tidy(self, number: int) -> None:
        """Remove folders that a complete folded table, or a later state, has taken the place of."""
        fs, path = self._fs()
        base = max(self.numbers("base"), default=-1)
        old = [("batch", n) for n in self.numbers("batch") if n <= base] + [("base", n) for n in self.numbers("base") if n < base]
        old += [("state", n) for n in self.numbers("state") if n < number - 1]
        for kind, n in old:
            fs.delete(path(f"{self.path}/{kind}/{n}"), True)

    def written(self) -> DataFrame:
        """Closed and late sums, folded or not."""
        base = max(self.numbers("base"), default=-1)
        parts = [self._read("base", base)] if base >= 0 else []
        parts += [self._read("batch", n) for n in self.numbers("batch") if n > base]
        out = self._none()
        for p in parts:
            out = out.unionByName(p)
        return out

    def open_weeks(self) -> DataFrame:
        last = max(self.numbers("state"), default=None)
        return self._none() if last is None else self._read("state", last).where("kind = 'open'")

    def totals(self) -> DataFrame:
        """(date, keys, weekly_sales_sum, events) of every event so far."""
        rows = self.written().unionByName(self.open_weeks())
        return rows.groupBy("date", *self.keys).agg(F.sum("weekly_sales_sum").alias("weekly_sales_sum"), F.sum("events").alias("events"))

    def late(self) -> DataFrame:
        """The same of the late events alone."""
        rows = self.written().where("kind = 'late'")
        return rows.groupBy("date", *self.keys).agg(F.sum("weekly_sales_sum").alias("weekly_sales_sum"), F.sum("events").alias("events"))


def stream_into(spark: SparkSession, path: str, keys: tuple[str, ...] = ("event_type",), files_per_batch: int | None = None,
                run_id: str = "events_weekly", delay: int = DELAY_DAYS, compact: int = COMPACT) -> Sink:
    """Stream the parquet file or folder ``path`` (availableNow) into a new sink."""
    base = scratch_path(spark, f"{run_id}-{uuid.uuid4().hex[:8]}")
    sink = Sink(spark, f"{base}/out", tuple(keys), delay, compact)
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # a stream takes a plain path for a folder; a pattern that only this path matches may be a file as well
    exact = f"{path[:-1]}[{path[-1]}]"
    q = (reader.parquet(exact).writeStream.outputMode("append").foreachBatch(lambda batch, number: sink.add(batch, number))
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return sink


def run_stream(spark: SparkSession, path: str, keys: tuple[str, ...] = ("event_type",), files_per_batch: int | None = None, **more) -> DataFrame:
    """Stream ``path`` and return the totals of every event."""
    return stream_into(spark, path, keys, files_per_batch, **more).totals()


def run_events_weekly(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """The stream over the whole ``events`` table."""
    return run_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet", keys)
