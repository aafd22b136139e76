"""Global order, logical clock, watermarks, epochs and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stage

#: The total order of logs; ties of time are broken by source and place.
ORDER = ("ts", "source_id", "file_path", "line_ord")
#: What a fetch may hold at most, and how many logs a batch.
MAX_FETCH, MAX_LOGS = 100, 10_000


def sequence(logs: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """All sources in one order: adds ``seq``, from 0 without gaps.

    Rows are range-partitioned and sorted; a partition's first number comes from the counts of those before it.
    """
    rows = logs.orderBy(*order).withColumns({"__id": F.monotonically_increasing_id(), "__p": F.spark_partition_id()})
    rows = stage(rows, "sequence")
    counts = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    firsts = counts.select(F.col("__p").alias("__q"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    joined = rows.join(F.broadcast(firsts), F.col("__p") == F.col("__q"))
    nth = F.col("__id") - F.shiftleft(F.col("__p").cast("long"), 33)
    return joined.select(*logs.columns, (F.col("first") + nth).alias("seq"))


#: Consecutive places in the order that one window holds.
BLOCK = 1 << 20


def with_prev_clock(logs: DataFrame, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """The logical clock before each log: the time of the log just before it, of any source.

    The lag is taken inside blocks of consecutive places (``seq``, given first where it is missing); a block's first row
    takes the last time of the block before it, found on the table of blocks.
    """
    rows = logs if "seq" in logs.columns else sequence(logs, order)
    rows = rows.withColumn("__b", F.floor(F.col("seq") / BLOCK))
    inside = Window.partitionBy("__b").orderBy("seq")
    rows = rows.withColumn("__lag", F.lag("ts").over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    last = rows.groupBy("__b").agg(F.max_by("ts", "seq").alias("__v"))
    last = last.select(F.col("__b").alias("__k"), F.lag("__v").over(Window.orderBy("__b")).alias("__before"))  # a row for each block
    joined = rows.join(last, F.col("__b") == F.col("__k"))
    return joined.select(*logs.columns, F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__lag")).alias("prev_clock"))


def running(rows: DataFrame, keys: Sequence[str], block: Column | None, order: Sequence, value: Column, out: str, how=F.sum, current: bool = True) -> DataFrame:
    """The sum or maximum (``how``) of ``value`` over the rows of the same keys up to each one, with it or without.

    No window holds more than a block of a key's rows: what comes before a block is taken from the table of blocks. Without
    blocks (None) a window holds a key's rows.
    """
    if block is None:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
        return rows.withColumn("__x", value).withColumn(out, how("__x").over(whole)).drop("__x")
    rows = rows.withColumn("__b", block).withColumn("__x", value)
    inside = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    rows = rows.withColumn("__m", how("__x").over(inside))
    blocks = rows.groupBy(*keys, "__b").agg(how("__x").alias("m"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"__k{i}" for i in range(len(keys))]
    blocks = blocks.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("__b").alias("__k"), how("m").over(before).alias("__before"))
    on = F.col("__b").eqNullSafe(F.col("__k"))
    for k, n in zip(keys, names, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(n))
    joined = rows.join(blocks, on)
    both = F.coalesce(F.col("__m") + F.col("__before"), "__m", "__before") if how is F.sum else F.greatest("__m", "__before")
    return joined.withColumn(out, both).drop("__b", "__x", "__m", "__k", "__before", *names)


def neighbour(rows: DataFrame, keys: Sequence[str], block: Column | None, order: Sequence[str], value: Column, out: str, behind: bool = False) -> DataFrame:
    """``value`` of the row before (or ``behind``) each one among the rows of the same keys, null at the end.

    No window holds more than a block of a key's rows: a block's edge is taken from the table of blocks. Without blocks
    (None) a window holds a key's rows.
    """
    if block is None:
        near = F.lead if behind else F.lag
        return rows.withColumn("__x", value).withColumn(out, near("__x").over(Window.partitionBy(*keys).orderBy(*order))).drop("__x")
    rows = rows.withColumn("__b", block).withColumn("__x", value)
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    step, edge = (F.lead, F.min_by) if behind else (F.lag, F.max_by)
    rows = rows.withColumns({"__n": step("__x").over(inside), "__edge": step(F.lit(True)).over(inside).isNull()})
    blocks = rows.groupBy(*keys, "__b").agg(edge("__x", F.struct(*order)).alias("m"))
    names = [f"__k{i}" for i in range(len(keys))]
    blocks = blocks.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("__b").alias("__k"), step("m").over(Window.partitionBy(*keys).orderBy("__b")).alias("__beside"))
    on = F.col("__b").eqNullSafe(F.col("__k"))
    for k, n in zip(keys, names, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(n))
    joined = rows.join(blocks, on)
    return joined.withColumn(out, F.when(F.col("__edge"), F.col("__beside")).otherwise(F.col("__n"))).drop("__b", "__x", "__n", "__edge", "__k", "__beside", *names)


def source_watermarks(logs: DataFrame, arrival: str = "seq") -> DataFrame:
    """Per source the time of the record that came last."""
    return logs.groupBy("source_id").agg(F.max_by("ts", arrival).alias("watermark"))


def global_watermark(watermarks: DataFrame, sources: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """The least watermark of the active sources; none while one of them has none."""
    active = sources.select("source_id").distinct()
    if done is not None:
        active = active.join(done.select("source_id"), "source_id", "left_anti")
    known = active.join(watermarks, "source_id", "left")
    return known.agg(F.when(F.count_if(F.col("watermark").isNull()) == 0, F.min("watermark")).alias("watermark"))


def _with_limit(logs: DataFrame, watermark: DataFrame, margin_us: int) -> DataFrame:
    limit = watermark.select(F.timestamp_micros(F.unix_micros("watermark") - margin_us).alias("__limit"))
    return logs.crossJoin(F.broadcast(limit))  # one row


def ready(logs: DataFrame, watermark: DataFrame, margin_us: int = 1_000_000, flush: bool = False) -> DataFrame:
    """Records that may be emitted: before the watermark less the margin; all of them when flushing."""
    return logs if flush else _with_limit(logs, watermark, margin_us).filter(F.col("ts") < F.col("__limit")).drop("__limit")


def pending(logs: DataFrame, watermark: DataFrame, margin_us: int = 1_000_000) -> DataFrame:
    """Records that are kept back."""
    rows = _with_limit(logs, watermark, margin_us)
    return rows.filter(F.coalesce(F.col("ts") >= F.col("__limit"), F.lit(True))).drop("__limit")


def running_max(rows: DataFrame, value: str, arrival: str, out: str, width: int = 1 << 16) -> DataFrame:
    """The largest ``value`` up to and with each row in order of ``arrival`` (a number), by blocks of ``width``."""
    rows = rows.withColumn("__b", F.floor(F.col(arrival) / width))
    inside = Window.partitionBy("__b").orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__m", F.max(value).over(inside))
    blocks = rows.groupBy("__b").agg(F.max(value).alias("m"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("__b").alias("__k"), F.max("m").over(before).alias("__before"))
    joined = rows.join(blocks, F.col("__b") == F.col("__k"))
    return joined.withColumn(out, F.greatest("__m", "__before")).drop("__b", "__m", "__k", "__before")


def flag_late(logs: DataFrame, arrival: str = "arrival", margin_us: int = 1_000_000) -> DataFrame:
    """``is_late``: behind the largest time that came before, less the margin. Late records are not dropped."""
    rows = running_max(logs, "ts", arrival, "__seen")
    late = F.unix_micros("ts") < F.unix_micros("__seen") - margin_us
    return rows.withColumn("is_late", F.coalesce(late, F.lit(False))).drop("__seen")


def epochs(logs: DataFrame, seconds: int, collector_id: str = "collector", watermark: Column | None = None, late: str = "own", arrival: str = "seq", with_logs: bool = True, max_logs: int = MAX_LOGS) -> DataFrame:
    """Tumbling epochs aligned to the Unix epoch, empty ones left out, numbered from 0.

    With ``late="current"`` a log that comes after a later epoch has begun falls into that one. The last epoch's
    watermark is ``watermark`` (its end by default), the others' their end. With their logs, epochs of more than
    ``max_logs`` come in parts of so many (``part`` of ``n_parts``), each a batch with a number of its own.
    """
    if seconds < 1:
        raise ValueError("epochs last a second or more")
    start = F.timestamp_seconds(F.floor(F.unix_micros("ts") / (seconds * 1_000_000)) * seconds)
    rows = logs.withColumn("epoch_start", start)
    if late == "current":
        rows = running_max(rows, "epoch_start", arrival, "epoch_start_now").withColumn("epoch_start", F.col("epoch_start_now")).drop("epoch_start_now")
    aggs, keys = [F.count(F.lit(1)).alias("n_logs"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")], ["epoch_start"]
    if with_logs:
        minute = F.floor(F.unix_micros("ts") / 60_000_000)
        rows = running(rows.withColumn("__log", F.struct(*logs.columns)), keys, minute, ["ts", "__log"], F.lit(1).cast("long"), "nth")
        rows = rows.withColumn("part", F.floor((F.col("nth") - 1) / max_logs).cast("int"))
        aggs.append(F.array_sort(F.collect_list("__log")).alias("logs"))
        keys = ["epoch_start", "part"]
    found = rows.groupBy(*keys).agg(*aggs)
    order = Window.orderBy(*keys)  # a row for each epoch or part, without its logs
    end = F.timestamp_seconds(F.unix_seconds("epoch_start") + seconds)
    starts = rows.select(*keys).distinct()
    last = F.max("epoch_start").over(Window.partitionBy())
    mark = F.when(F.col("epoch_start") == last, F.coalesce(watermark, end) if watermark is not None else end).otherwise(end)
    starts = starts.withColumns({"epoch_end": end, "watermark": mark, "sequence_num": (F.row_number().over(order) - 1).cast("long"), "collector_id": F.lit(collector_id)})
    if with_logs:
        starts = starts.withColumn("n_parts", F.count(F.lit(1)).over(Window.partitionBy("epoch_start")).cast("int"))
    return found.join(starts, keys)


def batches_after(batches: DataFrame, after: int | None = None, limit: int = 10) -> DataFrame:
    """The next batches after a sequence number (None: from the start), with ``has_more`` and ``next_sequence``."""
    limit = max(1, min(limit, MAX_FETCH))
    rest = batches if after is None else batches.filter(F.col("sequence_num") > after)
    page = rest.orderBy("sequence_num").limit(limit)
    more = rest.agg((F.count(F.lit(1)) > limit).alias("has_more"))
    last = page.agg(F.max("sequence_num").alias("next_sequence"))
    return page.crossJoin(F.broadcast(more)).crossJoin(F.broadcast(last))  # one row each


def unacknowledged(batches: DataFrame, acks: DataFrame) -> DataFrame:
    return batches.join(acks.select("collector_id", "sequence_num").distinct(), ["collector_id", "sequence_num"], "left_anti")


def retain_newest(batches: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` epochs of each collector."""
    nth = F.row_number().over(Window.partitionBy("collector_id").orderBy(F.desc("sequence_num")))
    return batches.withColumn("__n", nth).filter(F.col("__n") <= n).drop("__n")


def collector_status(batches: DataFrame) -> DataFrame:
    return batches.groupBy("collector_id").agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.min("sequence_num").alias("oldest_sequence"),
        F.max("sequence_num").alias("newest_sequence"),
        F.min("watermark").alias("min_watermark"),
    )


def batch_watermarks(batches: DataFrame) -> DataFrame:
    """Watermarks of nested batches as (generation, time), and whether one moves backward."""
    mark = F.struct(F.col("epoch.generation").alias("generation"), F.col("epoch.watermark").alias("watermark"))
    rows = batches.select("collector_id", "sequence_num", mark.alias("mark"))
    order = Window.partitionBy("collector_id").orderBy("mark.generation", "sequence_num")
    before = F.lag("mark").over(order)
    return rows.withColumn("moved_backward", F.coalesce(F.col("mark") < before, F.lit(False)))


def latest_watermark(batches: DataFrame) -> DataFrame:
    return batch_watermarks(batches).groupBy("collector_id").agg(F.max("mark").alias("mark"))


def dedupe_logs(logs: DataFrame) -> DataFrame:
    """One row per log id, of batches that were sent again."""
    return logs.dropDuplicates(["log_id"])
