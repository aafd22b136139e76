"""Tracks, ancestors, shared extraction and bounded epochs against plain versions."""

import random

from logweave.operators import correlate as C
from logweave.operators import extract as E
from logweave.operators import ordering as O
from logweave.operators import tables as T
from logweave.operators import versions as V
from logweave.plans.rules import Attribute, FiberType, Pattern, Rules
from pyspark.sql import functions as F


def test_tracks_are_the_first_free_ones():
    rng = random.Random(1)
    segments = sorted((s := rng.randrange(500), s + rng.randrange(40)) for _ in range(3000))
    lane, ends = T.Tracks(), []
    for start, end in segments:
        k = next((i for i, e in enumerate(ends) if e < start), len(ends))
        ends[k : k + 1] = [end]
        assert lane.take(start, end) == k


def test_a_million_overlapping_segments():
    """All meet each other: every one gets a track of its own, without a look at the others."""
    lane = T.Tracks()
    assert [lane.take(i, 2_000_000) for i in range(1_000_000)] == list(range(1_000_000))


def test_ancestors(spark):
    """A chain, a tree beside it, and parents that run in a circle."""
    parents = {f"c{i}": f"c{i - 1}" if i else None for i in range(70)} | {f"t{i}": f"t{(i - 1) // 2}" if i else "c5" for i in range(20)}
    parents |= {"x0": "x2", "x1": "x0", "x2": "x1", "y": "x1"}
    names = sorted(parents)
    rng = random.Random(6)
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(300)] + [("x1", "x1"), ("x0", "y"), ("y", "x0"), ("nobody", "c3"), ("c3", "nobody")]

    def climbs(ancestor, version):
        seen, at = set(), parents.get(version)
        while at is not None and at not in seen:
            if at == ancestor:
                return True
            seen.add(at)
            at = parents.get(at)
        return False

    versions = spark.createDataFrame(list(parents.items()), "version_hash string, parent_hash string")
    found = V.are_ancestors(versions, spark.createDataFrame(pairs, "ancestor string, version_hash string")).collect()
    assert {(r.ancestor, r.version_hash): r.is_ancestor for r in found} == {p: climbs(*p) for p in pairs}
    assert V.jumps(versions).count() == len(parents) * 8  # levels up to the first power of two that all parents' number fits


def _rules():
    user, k = (Pattern(r"user=(?P<user>\d+)"),), (Pattern(r"k=(?P<k>\d+)", close=True), Pattern(r"user=(?P<user>\d+)"))
    types = [FiberType("a", (Attribute("user", key=True),), {"s": user, "t": k[1:]}, "5s")]
    types.append(FiberType("b", (Attribute("k", key=True), Attribute("user"), Attribute("both", derived="${user}/${k}")), {"s": k}))
    return Rules((*types, FiberType("c", (Attribute("all", key=True, derived="x"),), {"t": (Pattern("."),)})))


def test_types_share_one_scan(spark, tmp_path):
    rows = [(i, "st"[i % 2], f"user={i % 3}" + (f" k={i % 5}" if i % 4 else "")) for i in range(40)]
    df = spark.createDataFrame(rows, "log_id long, source_id string, raw_text string").withColumn("ts", F.timestamp_seconds("log_id"))
    df.write.parquet(f"{tmp_path}/logs")
    logs, rules = spark.read.parquet(f"{tmp_path}/logs"), _rules()
    found = E.match_types(logs, rules)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    for t in rules.types:
        assert sorted(map(str, E.matched(found, t).collect())) == sorted(map(str, E.extract(logs, t).collect()))
    ordered = O.with_prev_clock(O.sequence(logs, ["ts", "log_id"]))
    together = C.correlate(ordered, rules).fibers
    for t in rules.types:
        alone = C.correlate_type(ordered, t).fibers
        assert sorted(map(str, together.filter(F.col("fiber_type") == t.name).collect())) == sorted(map(str, alone.collect()))


def test_epochs_in_parts(spark):
    rows = [(i, i * 7 % 30) for i in range(50)]
    logs = spark.createDataFrame(rows, "log_id long, at long").select("log_id", F.timestamp_seconds("at").alias("ts"))
    found = O.epochs(logs, 10, max_logs=4).orderBy("sequence_num").collect()
    assert [r.sequence_num for r in found] == list(range(len(found))) and max(len(r.logs) for r in found) == 4
    assert sorted(x.log_id for r in found for x in r.logs) == list(range(50))
    assert all(r.epoch_start <= x.ts < r.epoch_end for r in found for x in r.logs)
    assert O.batches_after(O.epochs(logs, 10, max_logs=4), 3, 2).select("sequence_num", "has_more").collect() == [(4, True), (5, True)]


def _lives(spark, rows):
    df = spark.createDataFrame(rows, "fiber_type string, fiber_id string, a long, b long")
    return df.select("fiber_type", "fiber_id", F.timestamp_micros("a").alias("first_activity"), F.timestamp_micros("b").alias("last_activity"))


def test_lives_that_meet(spark):
    """Points, ends on borders of buckets, lives of seconds to years, also before 1970, and moments that several share."""
    rng, leaf = random.Random(8), 1 << T.MIN_LEVEL
    rows = []
    for i in range(400):
        start = rng.choice([rng.randrange(-40, 40) * leaf, rng.randrange(-40 * leaf, 40 * leaf), rng.randrange(-9, 9) * leaf - 1])
        rows.append(("st"[i % 5 == 0], f"f{i}", start, start + rng.choice([0, 1, leaf - 1, leaf, rng.randrange(3 * leaf), rng.randrange(90 * leaf), rng.randrange(1 << 20) * leaf if i % 20 == 0 else 7])))
    rows.append(("s", "none", None, None))
    known = [r for r in rows if r[2] is not None]
    expected = sorted((t, i, j, max(a, c), min(b, d)) for t, i, a, b in known for u, j, c, d in known if t == u and i < j and a <= d and c <= b)
    found = T.overlapping_fibers(_lives(spark, rows)).select("fiber_type", "fiber_id", "other_id", F.unix_micros("from_ts"), F.unix_micros("to_ts"))
    assert sorted(map(tuple, found.collect())) == expected
    assert T.overlapping_fibers(_lives(spark, rows[:0])).count() == 0


def test_lives_meet_in_tasks_by_pairs(spark, monkeypatch):
    """A small table with many pairs is neither broadcast nor joined in as many tasks as its few rows need."""
    monkeypatch.setattr(T, "PAIRS_OF_TASK", 10_000, raising=False)
    found = T.overlapping_fibers(_lives(spark, [("s", f"f{i:03}", i, 3_600_000_000 + i) for i in range(300)]))
    assert found.count() == 300 * 299 // 2 and found.rdd.getNumPartitions() == 8
    found.write.format("noop").mode("overwrite").save()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
