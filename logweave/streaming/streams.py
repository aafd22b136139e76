"""Structured Streaming: ingest with held-back records, epochs, sessions, general correlation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import correlate as c
from ..operators import ordering, sinks
from ..plans.rules import Rules, Source
from ..plans.storage import stage
from ..sources.lines import flatten_batches, with_timestamp


def stream_lines(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """Lines of files as they are completed in the sources' folders, with times."""
    lines = None
    for s in sources:
        raw = spark.readStream.text(s.path).select(F.lit(s.source_id).alias("source_id"), F.col("_metadata.file_path").alias("file_path"), "value")
        lines = raw if lines is None else lines.unionByName(raw)
    return with_timestamp(lines, sources)


def stream_collected(batches: DataFrame, kept: str = "7 days") -> DataFrame:
    """Logs of collectors' batches, each once: one that is sent again is dropped if its first copy came no longer than
    ``kept`` before. The state goes by arrival, so that what a rewound collector sends for the first time is not late."""
    return flatten_batches(batches).withWatermark("arrival", kept).dropDuplicatesWithinWatermark(["log_id"])


def merge_collectors(streams: Sequence[DataFrame], delay: str = "1 second") -> DataFrame:
    """Logs of collectors that are read one by one (flattened, with ``ts``): each has a watermark of its own, and what
    follows waits for the least of them (``spark.sql.streaming.multipleWatermarkPolicy``, which is ``min`` by default).
    A log that is sent again counts once; behind the watermark none does."""
    marked = [s.withWatermark("ts", delay) for s in streams]
    both = marked[0]
    for s in marked[1:]:
        both = both.unionByName(s)
    return both.dropDuplicatesWithinWatermark(["log_id"])


def tumbling(logs: DataFrame, seconds: int) -> DataFrame:
    """Epochs of logs that have a watermark, emitted when it has passed them."""
    found = logs.groupBy(F.window("ts", f"{seconds} seconds")).agg(F.count(F.lit(1)).alias("n_logs"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return found.select(F.col("window.start").alias("epoch_start"), F.col("window.end").alias("epoch_end"), "n_logs", "first_ts", "last_ts")


def stream_epochs(logs: DataFrame, seconds: int, delay: str = "1 second") -> DataFrame:
    """Tumbling epochs, emitted when the watermark has passed them."""
    return tumbling(logs.withWatermark("ts", delay), seconds)


def stream_sessions(extracted: DataFrame, key: str, gap_seconds: int, delay: str = "1 second") -> DataFrame:
    """Sessions of one key by the gap between its own logs (event clock)."""
    s = F.session_window("ts", f"{gap_seconds} seconds")
    keyed = extracted.withColumn("k", F.col(f"attrs.{key}")).filter("k IS NOT NULL")
    found = keyed.withWatermark("ts", delay).groupBy(s, "k").agg(F.count(F.lit(1)).alias("n_logs"), F.min("ts").alias("first_activity"), F.max("ts").alias("last_activity"))
    return found.select("k", "first_activity", "last_activity", "n_logs")


def stream_sequence(logs: DataFrame, folder: str, sources: list[str], emit: Callable[[DataFrame, int], None], margin_us: int = 1_000_000, checkpoint: str | None = None) -> StreamingQuery:
    """Emits records in global order once every source is past them by the margin.

    Each micro-batch starts from the sources' watermarks and the records held back, as they were written under the number
    before, so that a repeated batch starts from the same state; it emits what is ready and writes what is not. Earlier
    batches' tables go.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held, marks = f"{folder}/held", f"{folder}/marks"
        rows = sinks.read(spark, held, batch.schema, batch_id, newest=True).unionByName(batch).dropDuplicates(["log_id"])
        seen = batch.groupBy("source_id").agg(F.max("ts").alias("watermark"))
        seen = sinks.read(spark, marks, seen.schema, batch_id, newest=True).unionByName(seen).groupBy("source_id").agg(F.max("watermark").alias("watermark"))
        sinks.write_batch(seen, marks, batch_id)
        known = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in sources])).alias("source_id"))
        limit = ordering.global_watermark(sinks.read(spark, marks, before=batch_id + 1, newest=True), known)
        sinks.write_batch(ordering.pending(rows, limit, margin_us), held, batch_id)
        emit(ordering.ready(rows, limit, margin_us).orderBy("ts", "source_id", "log_id"), batch_id)
        for path in (held, marks):
            sinks.prune(spark, path, batch_id - 1)

    writer = logs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint or f"{folder}/checkpoint")
    return writer.trigger(availableNow=True).start()


#: Micro-batches after which the changes of the open fibers become one table again.
COMPACT = 16
_CLOCK = StructType().add("clock", "timestamp").add("next", "long")
_STATE = ["fiber_type", "fiber_id"]


def stream_correlate(logs: DataFrame, rules: Rules, folder: str, checkpoint: str | None = None) -> StreamingQuery:
    """General fibers over micro-batches that come in order: the fibers still open are carried to the next batch.

    A batch takes up the open fibers that hold a key of its logs; the others can only time out. What it writes is in
    proportion to it: memberships of its logs under the fiber of that time, merges, closed fibers, and of the open ones
    those that changed or ended. :func:`stream_memberships` follows merges to the last fiber. All of it goes to sinks by
    the batch's number, and a batch starts from what was written before its number, so a repeated batch gives and adds
    nothing else. A fiber's id is that of its first log and stays the same as the fiber grows.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place = {n: f"{folder}/{n}" for n in ("clock", "state", "fibers", "memberships", "survivors")}
        new = stage(ordering.with_prev_clock(ordering.sequence(batch, ["ts", "source_id", "log_id"])), "batch")
        last = sinks.read(spark, place["clock"], _CLOCK, batch_id).agg(F.max("clock").alias("clock"), F.max("next").alias("next")).first()
        told = new.agg(F.max("ts").alias("clock"), F.max("seq").alias("seq")).first()  # one row
        offset = last["next"] or 0
        clock, following = told["clock"] or last["clock"], offset + (0 if told["seq"] is None else told["seq"] + 1)
        new = new.withColumns({"prev_clock": F.coalesce("prev_clock", F.lit(last["clock"]).cast("timestamp")), "seq": F.col("seq") + offset})
        end = F.lit(clock).cast("timestamp")
        like = _schema(spark, c.STATE).add("gone", "boolean")
        known = stage(sinks.read(spark, place["state"], like, batch_id, _STATE).filter("NOT gone").drop("gone"), "known")
        taken = stage(c.touched(known, new, rules), "taken")
        found = c.resume(taken, new, rules, flush=False, end=end)
        fibers, state = stage(found.fibers, "fibers"), stage(found.state, "state")
        late = stage(c.timed_out(known.join(taken.select(*_STATE), _STATE, "left_anti"), rules, end), "late")
        ended = taken.join(state.select(*_STATE), _STATE, "left_anti").unionByName(known.join(late.select(*_STATE), _STATE, "left_semi"))
        sinks.write_batch(found.memberships, place["memberships"], batch_id, ["ruleset_version", "fiber_type"])
        sinks.write_batch(found.survivors, place["survivors"], batch_id)
        closed = fibers.filter("close_reason IS NOT NULL")
        sinks.upsert_fibers(closed.unionByName(late.withColumn("first_log_id", F.col("first_log_id").cast(closed.schema["first_log_id"].dataType))), place["fibers"], batch_id)
        sinks.write_batch(state.withColumn("gone", F.lit(False)).unionByName(ended.withColumn("gone", F.lit(True))), place["state"], batch_id)
        sinks.write_batch(spark.createDataFrame([(clock, following)], _CLOCK), place["clock"], batch_id)
        if batch_id and batch_id % COMPACT == 0:  # of the batches before, which are finished
            sinks.compact(spark, place["state"], _STATE, batch_id - 1, "gone")
            sinks.compact(spark, place["clock"], ["next"], batch_id - 1)

    writer = logs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint or f"{folder}/checkpoint")
    return writer.trigger(availableNow=True).start()


def _schema(spark: SparkSession, ddl: str) -> StructType:
    return spark.createDataFrame([], ddl).schema


def stream_memberships(spark: SparkSession, folder: str) -> DataFrame:
    """What :func:`stream_correlate` has written: each log with the last fiber that it is part of."""
    rows = sinks.read(spark, f"{folder}/memberships")
    final = c.last_survivors(sinks.read(spark, f"{folder}/survivors")).withColumnRenamed("loser_id", "fiber_id")
    return rows.join(final, ["fiber_type", "fiber_id"], "left").withColumn("fiber_id", F.coalesce("survivor_id", "fiber_id")).select(*rows.columns)
