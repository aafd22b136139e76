"""Rule versions, reprocessing, and scoring of rules against an expected set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rules import FiberType, Rules
from ..plans.storage import stage
from .correlate import Correlation, correlate, correlate_type
from .ordering import with_prev_clock
from .tables import logs_range, page


def reprocess(logs: DataFrame, rules: Rules, start: str | None = None, end: str | None = None) -> Correlation:
    """Correlates stored logs anew, in a range; the clock is that of the range."""
    return correlate(with_prev_clock(logs_range(logs, start, end).drop("prev_clock")), rules)


def clear_results(memberships: DataFrame, logs: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Memberships that stay when those of the range's logs go."""
    return memberships.join(logs_range(logs, start, end).select("log_id"), "log_id", "left_anti")


def cleared_fibers(fibers: DataFrame, kept: DataFrame | None = None, version: str | None = None) -> DataFrame:
    """Fibers that stay when results are cleared for reprocessing: none, or none of the ``version``. With ``kept``, the
    memberships that stay, those are spared that still have one."""
    if kept is not None:
        return fibers.join(kept.select("fiber_id").distinct(), "fiber_id", "left_semi")
    return fibers.filter(F.lit(False) if version is None else ~F.col("ruleset_version").eqNullSafe(F.lit(version)))


def compare_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fibers of two results that share logs: shared logs and Jaccard similarity; unmatched ones with null."""
    a = old.select("log_id", "fiber_type", F.col("fiber_id").alias("old_fiber"))
    b = new.select("log_id", "fiber_type", F.col("fiber_id").alias("new_fiber"))
    both = a.join(b, ["log_id", "fiber_type"], "full_outer")
    pairs = both.groupBy("fiber_type", "old_fiber", "new_fiber").agg(F.count(F.lit(1)).alias("shared"))
    na = a.groupBy("fiber_type", "old_fiber").agg(F.count(F.lit(1)).alias("n_old"))
    nb = b.groupBy("fiber_type", "new_fiber").agg(F.count(F.lit(1)).alias("n_new"))
    rows = pairs.join(na, ["fiber_type", "old_fiber"], "left").join(nb, ["fiber_type", "new_fiber"], "left")
    matched = F.col("old_fiber").isNotNull() & F.col("new_fiber").isNotNull()
    return rows.select("fiber_type", "old_fiber", "new_fiber", "shared", F.when(matched, F.col("shared") / (F.col("n_old") + F.col("n_new") - F.col("shared"))).alias("jaccard"))


def version_history(versions: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(versions, [F.desc("created_at"), "version_hash"], limit, offset)


def count_versions(versions: DataFrame) -> DataFrame:
    return versions.agg(F.count(F.lit(1)).alias("n_versions"))


def active_version(versions: DataFrame) -> DataFrame:
    return versions.filter("is_active")


def activate(versions: DataFrame, version_hash: str) -> DataFrame:
    """One version active, the rest not; an unknown one, or one whose parent is unknown, fails the query."""
    known = versions.select(F.col("version_hash").alias("h")).distinct()
    rows = versions.join(known, F.col("parent_hash") == F.col("h"), "left")
    this = F.col("version_hash") == version_hash
    orphan = this & F.col("parent_hash").isNotNull() & F.col("h").isNull()
    found = F.broadcast(versions.agg(F.count_if(F.col("version_hash") == version_hash).alias("found")))  # one row
    rows = rows.crossJoin(found)
    bad = orphan | (F.col("found") == 0)
    return rows.withColumn("is_active", F.when(bad, F.raise_error(F.lit("no such version, or no such parent"))).otherwise(this)).select(*versions.columns)


def lineage(versions: DataFrame) -> DataFrame:
    """``version_hash, ancestor, depth`` along parents; a cycle ends where it comes back.

    Each turn doubles the steps that are known, so chains of any length take as many turns as their length's logarithm.
    """
    known = stage(versions.filter("parent_hash IS NOT NULL").select("version_hash", F.col("parent_hash").alias("ancestor"), F.lit(1).alias("depth")), "lineage")
    reach, jumps = 1, known
    while True:
        on = known.select(F.col("version_hash").alias("ancestor"), F.col("ancestor").alias("further"), F.col("depth").alias("more"))
        longer = jumps.join(on, "ancestor").select("version_hash", F.col("further").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        longer = longer.join(known, ["version_hash", "ancestor"], "left_anti").groupBy("version_hash", "ancestor").agg(F.min("depth").alias("depth"))
        longer = stage(longer, "lineage")
        if longer.isEmpty():
            return known
        reach *= 2
        known, jumps = stage(known.unionByName(longer), "lineage"), longer.filter(F.col("depth") == reach)


def jumps(versions: DataFrame) -> DataFrame:
    """``version_hash, level, ancestor, steps``: the ancestor 2 ** level steps up (null above the root) and the steps taken
    to get there or to the root. A row for each version and level, where lineage has one for each pair. Levels end where all
    are at the root, or with the number of versions where parents form a cycle. Tables of all versions are sorted and
    merged: compressed ones look small enough to be sent to every executor by way of the driver."""
    level, n = 0, max(versions.count(), 1)
    parent = F.col("parent_hash")
    rows = stage(versions.select("version_hash", F.lit(0).alias("level"), parent.alias("ancestor"), parent.isNotNull().cast("long").alias("steps")).dropDuplicates(["version_hash"]), "jumps")
    table = rows
    while 2**level < n and not rows.filter("ancestor IS NOT NULL").isEmpty():
        up = rows.select(F.col("version_hash").alias("__up"), F.col("ancestor").alias("further"), F.col("steps").alias("more"))
        level += 1
        rows = rows.join(up.hint("merge"), F.col("ancestor") == F.col("__up"), "left")
        rows = stage(rows.select("version_hash", F.lit(level).alias("level"), F.col("further").alias("ancestor"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "jumps")
        table = table.unionByName(rows)
    return table


def are_ancestors(versions: DataFrame, pairs: DataFrame) -> DataFrame:
    """``ancestor, version_hash, is_ancestor`` of pairs: the version is taken up by the difference of their depths, a jump for
    each of its bits. Versions that run into a cycle of parents are followed by :func:`lineage`."""
    table = jumps(versions)
    top = table.agg(F.max("level")).first()[0] or 0
    whole = table.filter(F.col("level") == top)
    depth = whole.filter("ancestor IS NULL").select(F.col("version_hash").alias("v"), "steps")
    looped = whole.filter("ancestor IS NOT NULL").select("version_hash")
    rows = pairs.select("ancestor", "version_hash").distinct()
    rows = rows.join(depth.select(F.col("v").alias("version_hash"), F.col("steps").alias("deep")).hint("merge"), "version_hash", "left")
    rows = rows.join(depth.select(F.col("v").alias("ancestor"), F.col("steps").alias("high")).hint("merge"), "ancestor", "left")
    rows = rows.withColumns({"up": F.col("deep") - F.col("high"), "at": F.col("version_hash")})
    for level in range(top + 1):
        step = table.filter(F.col("level") == level).select(F.col("version_hash").alias("__at"), F.col("ancestor").alias("to"))
        rows = rows.join(step.hint("merge"), F.col("at") == F.col("__at"), "left").drop("__at")
        rows = rows.withColumn("at", F.when((F.col("up") > 0) & F.shiftright("up", level).bitwiseAND(F.lit(1)).cast("boolean"), F.col("to")).otherwise(F.col("at"))).drop("to")
    found = rows.select("ancestor", "version_hash", F.coalesce((F.col("up") > 0) & (F.col("at") == F.col("ancestor")), F.lit(False)).alias("is_ancestor"))
    if looped.isEmpty():
        return found
    met = lineage(versions.join(looped, "version_hash", "left_semi")).select("version_hash", "ancestor", F.lit(True).alias("met"))
    return found.join(met, ["version_hash", "ancestor"], "left").select("ancestor", "version_hash", (F.col("is_ancestor") | F.coalesce("met", F.lit(False))).alias("is_ancestor"))


def is_ancestor(versions: DataFrame, ancestor: str, version_hash: str) -> DataFrame:
    pair = versions.sparkSession.range(1).select(F.lit(ancestor).alias("ancestor"), F.lit(version_hash).alias("version_hash"))
    return are_ancestors(versions, pair).select("is_ancestor")


def working_set_window(logs: DataFrame, ids: DataFrame, gap_us: int | None, margin: bool = True) -> DataFrame:
    """First and last moment of the set, widened by the gap (an hour if it is infinite)."""
    width = (3_600_000_000 if gap_us is None else gap_us) if margin else 0
    marks = logs.join(ids.select("log_id"), "log_id", "left_semi").agg(F.unix_micros(F.min("ts")).alias("a"), F.unix_micros(F.max("ts")).alias("b"))
    return marks.select(F.timestamp_micros(F.col("a") - width).alias("start_ts"), F.timestamp_micros(F.col("b") + width).alias("end_ts"))


def score_memberships(memberships: DataFrame, ids: DataFrame) -> DataFrame:
    """Per fiber that has expected logs the intersection over union with them, and the numbers of matching, missing and
    extra ones; best first. :func:`scored_logs` has the logs themselves."""
    expected = ids.select("log_id").distinct().withColumn("expected", F.lit(True))
    size = expected.agg(F.count(F.lit(1)).alias("n_expected"))
    per = memberships.join(expected, "log_id", "left").groupBy("fiber_id").agg(F.count(F.lit(1)).alias("n"), F.count("expected").alias("matching"))
    per = per.filter("matching > 0").crossJoin(F.broadcast(size))  # one row
    missing, extra = F.col("n_expected") - F.col("matching"), F.col("n") - F.col("matching")
    iou = F.col("matching") / (F.col("n") + missing)
    return per.select("fiber_id", iou.alias("iou"), "matching", missing.alias("missing"), extra.alias("extra")).orderBy(F.desc("iou"), "fiber_id")


def scored_logs(memberships: DataFrame, ids: DataFrame) -> DataFrame:
    """``fiber_id, log_id, kind`` (matching or extra) of the fibers that have expected logs, a row each; what a fiber
    misses is what is expected and not among its matching ones."""
    expected = ids.select("log_id").distinct().withColumn("expected", F.lit(True))
    rows = memberships.select("fiber_id", "log_id").join(expected, "log_id", "left")
    scored = rows.filter("expected").select("fiber_id").distinct()
    there = rows.join(scored, "fiber_id", "left_semi").withColumn("kind", F.when(F.col("expected"), "matching").otherwise("extra"))
    return there.select("fiber_id", "log_id", "kind")


def score_rules(logs: DataFrame, ids: DataFrame, fiber_type: FiberType, version: str = "candidate") -> DataFrame:
    """Correlates the set's window by a candidate type and scores its fibers against the set."""
    window = working_set_window(logs, ids, fiber_type.gap)
    inside = logs.crossJoin(F.broadcast(window)).filter(F.col("ts").between(F.col("start_ts"), F.col("end_ts"))).drop("start_ts", "end_ts")  # one row
    inside = with_prev_clock(inside.drop("prev_clock"))
    return score_memberships(correlate_type(inside, fiber_type, version).memberships, ids)


def id_set_operations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of two id sets with where they are: ``both``, ``missing`` (in a only), ``extra`` (in b only)."""
    left, right = a.select("log_id").distinct().withColumn("in_a", F.lit(True)), b.select("log_id").distinct().withColumn("in_b", F.lit(True))
    kind: Column = F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "missing").otherwise("extra")
    return left.join(right, "log_id", "full_outer").select("log_id", kind.alias("kind"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("__n", nth).filter("__n = 1").drop("__n")
