"""Lookups, joins, aggregations and path analysis over the three tables logs, fibers, memberships."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rules import Rules
from ..plans.storage import stage
from .ordering import BLOCK, neighbour, running

#: Most rows of a page, of a filtered fiber query, and most ids of a batch.
MAX_PAGE, MAX_FIBERS, MAX_IDS = 1000, 1000, 100
#: The shortest bucket of fibers' lives, 2 ** 26 microseconds; the stretch of a lane that one window holds, an hour.
MIN_LEVEL, LANE_US = 26, 3_600_000_000
#: Pairs of lives that one task is to make, and most tasks that their number asks for.
PAIRS_OF_TASK, MAX_TASKS = 1 << 24, 4096


def page(df: DataFrame, order: Sequence[str | Column], limit: int = 100, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(max(1, min(limit, MAX_PAGE)))


def get_log(logs: DataFrame, log_id) -> DataFrame:
    return logs.filter(F.col("log_id") == log_id)


def _ids(df: DataFrame, ids: Sequence) -> DataFrame:
    if not 1 <= len(ids) <= MAX_IDS:
        raise ValueError(f"1 to {MAX_IDS} ids")
    return df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(i) for i in ids])).alias("position", "wanted"))


def get_logs_batch(logs: DataFrame, ids: Sequence) -> DataFrame:
    """Logs in the order of ``ids``, with their ``position``."""
    wanted = _ids(logs, ids)
    return logs.join(F.broadcast(wanted), F.col("log_id") == F.col("wanted")).drop("wanted").orderBy("position")


def missing_logs(logs: DataFrame, ids: Sequence) -> DataFrame:
    return _ids(logs, ids).join(logs, F.col("log_id") == F.col("wanted"), "left_anti").select(F.col("wanted").alias("log_id"))


def logs_range(logs: DataFrame, start: str | None = None, end: str | None = None, source: str | None = None) -> DataFrame:
    """Logs in a range, both ends in it; either may be absent."""
    conditions = []
    if start is not None:
        conditions.append(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        conditions.append(F.col("ts") <= F.lit(end).cast("timestamp"))
    if source is not None:
        conditions.append(F.col("source_id") == source)
    return logs.filter(reduce(lambda a, b: a & b, conditions)) if conditions else logs


def logs_between(logs: DataFrame, start: str, end: str, limit: int = 100, offset: int = 0, source: str | None = None) -> DataFrame:
    return page(logs_range(logs, start, end, source), ["ts", "log_id"], limit, offset)


def fibers_by_type(fibers: DataFrame, fiber_type: str, closed: bool | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    rows = fibers.filter(F.col("fiber_type") == fiber_type)
    if closed is not None:
        rows = rows.filter(F.col("closed") == closed)
    return page(rows, ["first_activity", "fiber_id"], limit, offset)


def get_fiber(fibers: DataFrame, fiber_id) -> DataFrame:
    return fibers.filter(F.col("fiber_id") == fiber_id)


@dataclass
class FiberPage:
    """``rows`` of a page; ``total``: one row with the number of all matches and whether the page is short of them."""

    rows: DataFrame
    total: DataFrame


def duration_us() -> Column:
    return F.unix_micros("last_activity") - F.unix_micros("first_activity")


def overlaps(start: str | None, end: str | None) -> Column:
    """Whether a fiber's life and a range have a moment in common."""
    cond = F.lit(True)
    if end is not None:
        cond = cond & (F.col("first_activity") <= F.lit(end).cast("timestamp"))
    if start is not None:
        cond = cond & (F.col("last_activity") >= F.lit(start).cast("timestamp"))
    return cond


def query_fibers(fibers: DataFrame, types: Sequence[str] = (), attributes: dict[str, str] | None = None, closed: bool | None = None, start: str | None = None, end: str | None = None, max_fibers: int = 200, offset: int = 0) -> FiberPage:
    """All filters together; longest first."""
    rows = fibers.filter(overlaps(start, end))
    if types:
        rows = rows.filter(F.col("fiber_type").isin(*types))
    if closed is not None:
        rows = rows.filter(F.col("closed") == closed)
    for k, v in (attributes or {}).items():
        rows = rows.filter(F.col("attributes")[k] == v)
    limit = max(1, min(max_fibers, MAX_FIBERS))
    found = rows.orderBy(duration_us().desc(), "first_activity", "fiber_id").offset(offset).limit(limit)
    total = rows.agg(F.count(F.lit(1)).alias("total_matching")).withColumn("truncated", F.col("total_matching") > offset + limit)
    return FiberPage(found, total)


def filter_attributes(fibers: DataFrame, predicates: Sequence[tuple[str, str, bool]], logic: str = "and") -> DataFrame:
    """Predicates (attribute, value, is regex) joined by ``and`` or ``or``; a bad regex is compared as it is."""
    tests = []
    for name, value, is_regex in predicates:
        x = F.col("attributes")[name]
        try:
            re.compile(value)
        except re.error:
            is_regex = False
        tests.append(F.coalesce(x.rlike("(?i)" + value) if is_regex else x == value, F.lit(False)))
    if not tests:
        return fibers
    return fibers.filter(reduce((lambda a, b: a & b) if logic == "and" else (lambda a, b: a | b), tests))


def active_within(fibers: DataFrame, span: str, now: Column) -> DataFrame:
    """Fibers whose last activity is at most ``span`` (1h, 6h, 24h, 7d) before ``now``."""
    n, unit = int(span[:-1]), {"h": 3_600_000_000, "d": 86_400_000_000}[span[-1]]
    return fibers.filter(F.unix_micros("last_activity") >= F.unix_micros(now) - n * unit)


def fiber_types(fibers: DataFrame) -> DataFrame:
    return fibers.select("fiber_type").distinct().orderBy("fiber_type")


def source_ids(logs: DataFrame) -> DataFrame:
    return logs.select("source_id").distinct().orderBy("source_id")


def type_catalog(rules: Rules, logs: DataFrame) -> DataFrame:
    """Configured types and sources seen, source types first, then by name."""
    seen = logs.select(F.col("source_id").alias("name"), F.lit(True).alias("is_source_fiber")).distinct()
    structs = [F.struct(F.lit(t.name).alias("name"), F.lit(t.is_source).alias("is_source_fiber")) for t in rules.types]
    if not structs:
        return seen.orderBy(F.desc("is_source_fiber"), "name")
    named = logs.sparkSession.range(1).select(F.inline(F.array(*structs)))
    return named.unionByName(seen.join(F.broadcast(named), "name", "left_anti")).orderBy(F.desc("is_source_fiber"), "name")


def fiber_logs(memberships: DataFrame, logs: DataFrame, fiber_id=None) -> DataFrame:
    """Logs of one fiber, or of all of them."""
    rows = memberships if fiber_id is None else memberships.filter(F.col("fiber_id") == fiber_id)
    return rows.select("log_id", "fiber_id", "fiber_type").join(logs, "log_id")


def log_fibers(memberships: DataFrame, fibers: DataFrame, log_id=None) -> DataFrame:
    rows = memberships if log_id is None else memberships.filter(F.col("log_id") == log_id)
    return rows.select("log_id", "fiber_id").join(fibers, "fiber_id")


def logs_with_fibers(logs: DataFrame, memberships: DataFrame, fibers: DataFrame) -> DataFrame:
    each = log_fibers(memberships.join(logs.select("log_id"), "log_id", "left_semi"), fibers)
    grouped = each.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("fiber_type", "fiber_id"))).alias("fibers"))
    return logs.join(grouped, "log_id", "left")


def fiber_points(memberships: DataFrame, logs: DataFrame, fiber_ids: DataFrame | None = None) -> DataFrame:
    """``fiber_id, ts, source_id, log_id`` of the fibers' logs."""
    rows = memberships if fiber_ids is None else memberships.join(fiber_ids, "fiber_id", "left_semi")
    return rows.select("fiber_id", "log_id").join(logs, "log_id").select("fiber_id", "ts", "source_id", "log_id")


def related_fibers(memberships: DataFrame, rules: Rules, fiber_ids: DataFrame | None = None, with_sources: bool = False) -> DataFrame:
    """Fibers that share logs, with their number: of all, or of those in ``fiber_ids`` with all. Types that hold whole
    sources, which meet every fiber of theirs, are left out unless asked for."""
    sources = [t.name for t in rules.types if t.is_source]
    rows = memberships if with_sources or not sources else memberships.filter(~F.col("fiber_type").isin(*sources))
    a = rows if fiber_ids is None else rows.join(fiber_ids.select("fiber_id").distinct(), "fiber_id", "left_semi")
    a = a.select("log_id", F.col("fiber_id").alias("fiber_a"))
    b = rows.select("log_id", F.col("fiber_id").alias("fiber_b"))
    return a.join(b, "log_id").filter(F.col("fiber_a") != F.col("fiber_b")).groupBy("fiber_a", "fiber_b").agg(F.count(F.lit(1)).alias("shared_logs"))


def close_orphans(fibers: DataFrame, open_ids: DataFrame) -> DataFrame:
    """Fibers that are open in storage but not known to be open are closed."""
    known = open_ids.select(F.col("fiber_id").alias("o")).distinct()
    rows = fibers.join(known, F.col("fiber_id") == F.col("o"), "left")
    orphan = ~F.col("closed") & F.col("o").isNull()
    return rows.withColumn("close_reason", F.when(orphan, "orphan").otherwise(F.col("close_reason"))).withColumn("closed", F.col("closed") | orphan).drop("o")


def overlapping_fibers(fibers: DataFrame) -> DataFrame:
    """Pairs of fibers of one type whose lives meet, so that the later one starts within the life of the earlier one.

    Time is cut into leaves of ``2 ** MIN_LEVEL`` microseconds; two neighbouring nodes of a level make one of the next. A life
    is the leaves of its two ends and, between them, the largest nodes that it covers: two of a level at most, however long
    it is. A start is in one node of each level. So every pair meets in one node only, and what meets there is a pair,
    except in the leaves of ends, where times are compared: the work is that of the pairs. The join sorts; no side is broadcast.
    """
    leaf = lambda c: F.shiftright(F.unix_micros(c), MIN_LEVEL)
    rows = fibers.select("fiber_type", "fiber_id", "first_activity", "last_activity", leaf("first_activity").alias("s"), leaf("last_activity").alias("e"))
    size = rows.groupBy("fiber_type").agg(
        F.max(F.col("e") - F.col("s")).alias("leaves"),
        (F.count(F.lit(1)) * F.sum(duration_us() + 1.0) / (F.unix_micros(F.max("last_activity")) - F.unix_micros(F.min("first_activity")) + 1)).alias("pairs"),
    ).agg(F.max("leaves"), F.sum("pairs")).first()
    levels = max((size[0] or 0) - 1, 1).bit_length()
    # by pairs, about so many if lives are spread evenly: adaptive execution would go by the rows read, which tell nothing of them
    parts = max(int(fibers.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(size[1] or 0) // PAIRS_OF_TASK, MAX_TASKS))
    rows = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    starts = rows.select("fiber_type", "level", F.expr("shiftright(s, level)").alias("node"), F.col("fiber_id").alias("id2"), F.col("first_activity").alias("f2"), F.col("last_activity").alias("l2"))
    # nodes of a level from a life's first whole one up to before its end; those without their neighbour are of no larger one
    low, high = F.expr("shiftright(s + shiftleft(1L, level), level)"), F.expr("shiftright(e, level)")
    odd = lambda c: c.bitwiseAND(1)
    node = lambda when, at, end: F.when(when, F.struct(at.alias("node"), F.lit(end).alias("end")))
    leaves = F.col("level") == 0
    nodes = [node((low < high) & (odd(low) == 1), low, False), node((low + odd(low) < high) & (odd(high) == 1), high - 1, False)]
    nodes += [node(leaves, F.col("s"), True), node(leaves & (F.col("s") < F.col("e")), F.col("e"), True)]
    lives = rows.select("fiber_type", "level", "fiber_id", "first_activity", "last_activity", F.inline(F.array_compact(F.array(*nodes))))
    key = ["fiber_type", "level", "node"]
    met = starts.repartition(parts, *key).join(lives.repartition(parts, *key).hint("merge"), key)
    later = (F.col("first_activity") < F.col("f2")) | ((F.col("first_activity") == F.col("f2")) & (F.col("fiber_id") < F.col("id2")))
    met = met.filter(~F.col("end") | (later & (F.col("f2") <= F.col("last_activity"))))
    ids = [F.least("fiber_id", "id2").alias("fiber_id"), F.greatest("fiber_id", "id2").alias("other_id")]
    return met.select("fiber_type", *ids, F.col("f2").alias("from_ts"), F.least("last_activity", "l2").alias("to_ts"))


def membership_counts(memberships: DataFrame) -> DataFrame:
    return memberships.groupBy("fiber_type").agg(F.count(F.lit(1)).alias("n_memberships"), F.countDistinct("fiber_id").alias("n_fibers"))


def fiber_durations(fibers: DataFrame) -> DataFrame:
    return fibers.withColumn("duration_us", duration_us())


def time_extent(fibers: DataFrame, pad: float = 0.05) -> DataFrame:
    """First and last moment of a set of fibers, padded by a share of the time between."""
    e = fibers.agg(F.unix_micros(F.min("first_activity")).alias("a"), F.unix_micros(F.max("last_activity")).alias("b"))
    margin = F.floor((F.col("b") - F.col("a")) * pad)
    return e.select(F.timestamp_micros(F.col("a") - margin).alias("start_ts"), F.timestamp_micros(F.col("b") + margin).alias("end_ts"))


# sequences of a fiber's points

_BY_TIME = ("ts", "log_id")


def _laid(points: DataFrame) -> tuple[DataFrame, Column | None]:
    """The points, written once, and the blocks of a fiber's points: hours if a fiber has more points than a window is to
    hold, none otherwise, as blocks are about as many as the points where fibers are short."""
    points = stage(points, "points")
    most = points.groupBy("fiber_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return points, F.floor(F.unix_micros("ts") / LANE_US) if most > BLOCK else None


def _beside(points: DataFrame, block: Column | None, value: Column, out: str, behind: bool = False) -> DataFrame:
    """``value`` of the point before (or behind) each one of its fiber."""
    return neighbour(points, ["fiber_id"], block, _BY_TIME, value, out, behind)


def path_points(points: DataFrame) -> DataFrame:
    """First, last, and both sides of every change of source."""
    points, block = _laid(points)
    rows = _beside(_beside(points, block, F.col("source_id"), "before"), block, F.col("source_id"), "behind", behind=True)
    keep = F.col("before").isNull() | F.col("behind").isNull() | (F.col("before") != F.col("source_id")) | (F.col("behind") != F.col("source_id"))
    rows = _beside(rows.filter(keep).drop("before", "behind"), block, F.struct("ts", "source_id"), "same")
    return rows.filter(~F.coalesce(F.struct("ts", "source_id") == F.col("same"), F.lit(False))).drop("same")


def fiber_path(points: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("ts", "log_id", "source_id")))
    found = path_points(points).groupBy("fiber_id").agg(ordered.alias("p"))
    return found.select("fiber_id", F.transform("p", lambda x: F.struct(x["ts"].alias("ts"), x["source_id"].alias("source_id"))).alias("path"))


def lane_segments(points: DataFrame) -> DataFrame:
    """Runs of one source; a run ends where the next begins, the last at the fiber's last activity."""
    points, block = _laid(points)
    rows = _beside(points, block, F.col("source_id"), "before")
    change = F.coalesce(F.col("before") != F.col("source_id"), F.lit(True))
    rows = running(rows, ["fiber_id"], block, _BY_TIME, change.cast("long"), "run")
    runs = rows.groupBy("fiber_id", "run", "source_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_logs"))
    runs = neighbour(runs, ["fiber_id"], None if block is None else F.floor(F.col("run") / BLOCK), ["run"], F.col("start_ts"), "after", behind=True)
    return runs.withColumn("end_ts", F.greatest(F.coalesce("after", "last_ts"), F.col("start_ts"))).select("fiber_id", F.col("run").cast("long").alias("run"), "source_id", "start_ts", "end_ts", "n_logs")


def _clusters(segments: DataFrame) -> DataFrame:
    """Adds ``cluster``: stretches of a lane between moments that no segment covers, by the moment they begin."""
    block, order = F.floor(F.unix_micros("start_ts") / LANE_US), ["start_ts", F.desc("end_ts"), "fiber_id", "run"]
    rows = running(segments, ["source_id"], block, order, F.col("end_ts"), "reach", F.max, current=False)
    new = F.when(F.coalesce(F.col("start_ts") > F.col("reach"), F.lit(True)), F.col("start_ts"))
    return running(rows, ["source_id"], block, order, new, "cluster", F.max).drop("reach")


class Tracks:
    """Tracks of a lane: those in use by their ends, those free by number."""

    def __init__(self):
        self.ends: list[tuple[int, int]] = []
        self.free: list[int] = []
        self.n = 0

    def take(self, start: int, end: int) -> int:
        """The first free track for a segment; segments come by start, so a track that is free once stays so."""
        while self.ends and self.ends[0][0] < start:
            heapq.heappush(self.free, heapq.heappop(self.ends)[1])
        if self.free:
            track = heapq.heappop(self.free)
        else:
            track, self.n = self.n, self.n + 1
        heapq.heappush(self.ends, (end, track))
        return track


def assign_tracks(segments: DataFrame) -> DataFrame:
    """The first free track of each segment in its lane; a track is free again after its segment's end. Where no segment
    covers a moment all tracks are free, so a lane is dealt stretch by stretch."""
    rows = _clusters(segments).repartition("source_id", "cluster").sortWithinPartitions("source_id", "cluster", "start_ts", F.desc("end_ts"), "fiber_id", "run")
    names = segments.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, lane = None, Tracks()
        for batch in batches:
            found = []
            for source, cluster, start, end in zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("source_id", "__cluster", "__start", "__end")), strict=True):
                if (source, cluster) != group:
                    group, lane = (source, cluster), Tracks()
                found.append(lane.take(start, end))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(found, pa.int64())], [*names, "track"])

    return rows.withColumns({"__start": F.unix_micros("start_ts"), "__end": F.unix_micros("end_ts"), "__cluster": F.unix_micros("cluster")}).mapInArrow(run, f"{kinds}, track long")


def lane_concurrency(segments: DataFrame) -> DataFrame:
    """The most segments of a lane at one moment (ends are in it)."""
    edges = segments.select("source_id", F.explode(F.array(F.struct(F.unix_micros("start_ts").alias("at"), F.lit(1).alias("d")), F.struct((F.unix_micros("end_ts") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    per = edges.groupBy("source_id", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    per = running(per, ["source_id"], F.floor(F.col("at") / LANE_US), ["at"], F.col("d"), "level")
    return per.groupBy("source_id").agg(F.max("level").alias("tracks"))


def source_transitions(points: DataFrame) -> DataFrame:
    """Changes of source in fibers: number and delays in microseconds."""
    points, block = _laid(points)
    rows = _beside(points, block, F.struct(F.col("source_id").alias("from_source"), F.col("ts").alias("from_ts")), "from").select(*points.columns, "from.*")
    rows = rows.filter(F.col("from_source") != F.col("source_id"))
    delay = F.unix_micros("ts") - F.unix_micros("from_ts")
    return rows.groupBy("from_source", F.col("source_id").alias("to_source")).agg(F.count(F.lit(1)).alias("n"), F.min(delay).alias("min_delay_us"), F.max(delay).alias("max_delay_us"), F.sum(delay).alias("sum_delay_us"))


def changed_fibers(old: DataFrame, new: DataFrame) -> DataFrame:
    o = old.select("fiber_id", F.col("last_activity").alias("old_last"), F.col("closed").alias("old_closed"))
    rows = new.join(o, "fiber_id")
    return rows.filter((F.col("last_activity") != F.col("old_last")) | (F.col("closed") != F.col("old_closed")))
