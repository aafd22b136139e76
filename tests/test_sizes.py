"""What shows on larger tables only, on the smallest ones that show it."""

import duckdb
import pytest
from pyspark.sql import functions as F

from logweave import flow_queries  # noqa: F401  registers its queries with the others
from logweave import queries as Q


def same_as_sql(spark, name, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    want = con.execute(Q.ORACLES[name])
    cols = [c[0] for c in want.description]
    plain = lambda v: v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    key = lambda r: tuple(str(v) for v in r)
    got = [tuple(plain(v) for v in r) for r in Q.QUERIES[name](spark, str(folder)).select(*cols).collect()]
    assert sorted(got, key=key) == sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=key)
    return got


def events(spark, folder, n, seconds, users=50):
    """n events in order of time, so many seconds apart."""
    kind = F.element_at(F.array(*[F.lit(s) for s in Q.SOURCES]), (F.pmod(F.hash("id"), F.lit(5)) + 1).cast("int"))
    props = F.concat(F.lit('{"k": '), F.pmod(F.hash("id", F.lit(1)), F.lit(100)), F.lit("}"))
    ts = F.timestamp_micros((F.lit(1704067200) + F.col("id") * seconds).cast("long") * 1_000_000 + F.col("id"))
    rows = spark.range(n).select(F.col("id").alias("event_id"), ts.cast("timestamp_ntz").alias("ts"), F.pmod(F.hash("id", F.lit(2)), F.lit(users)).cast("long").alias("user_id"), kind.alias("event_type"), F.lit(1.0).alias("value"), props.alias("props"))
    rows.write.parquet(f"{folder}/events.parquet")


@pytest.mark.parametrize("name", ["generation_watermarks", "latest_watermarks"])
def test_epochs_in_parts_have_numbers_of_their_own(spark, tmp_path, name):
    """A day of one collector's with more than 10,000 logs is several batches."""
    events(spark, tmp_path, 100_000, 4)
    got = same_as_sql(spark, name, tmp_path)
    assert len(got) == {"generation_watermarks": 19, "latest_watermarks": 2}[name]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fibers_of_islands_are_what_the_fold_tells(spark):
    """No join of all logs with what the fold tells of them, and merges tell first logs without a join of names."""
    from logweave.flow_queries import RECEIPTS
    from logweave.operators import correlate as C

    rows = [("a1", "a", "cust=7"), ("b1", "b", "order=1"), ("c1", "c", "cust=7 order=1"), ("b2", "b", "order=2"), ("c2", "c", "cust=7 order=2")]
    logs = spark.createDataFrame([(g, s, t, i) for i, (g, s, t) in enumerate(rows)], "log_id string, source_id string, raw_text string, i long")
    logs = logs.select("log_id", F.timestamp_seconds("i").alias("ts"), "source_id", "raw_text", F.col("i").alias("seq"))  # a type without a gap needs no clock
    found = C.correlate_type(logs, RECEIPTS, named=True)
    assert "SortMergeJoin" not in plan(found.fibers) and "HashJoin" not in plan(found.fibers)
    assert "Join" not in plan(found.merges)
    assert [(r.first_log_id, r.n_logs, r.attributes) for r in found.fibers.collect()] == [("a1", 5, {"cust": "7", "order": "2"})]
    assert sorted((r.loser_log, r.survivor_log, r.log_id) for r in found.merges.collect()) == [("b1", "a1", "c1"), ("b2", "a1", "c2")]
    told = C.correlate_type(logs, RECEIPTS, membership="as_written", named=True).memberships
    assert "Join" not in plan(told) and sorted(r.first_log_id for r in told.collect()) == ["a1", "a1", "a1", "b1", "b2"]


def test_merged_fibers_are_kept_as_lists_of_lists():
    """A fiber that takes up one with many merged ones does not copy them, and tells all of them."""
    from logweave.plans.fold import Events, Island

    island, n = Island(2, 2, None, False, Events()), 3000
    for i in range(n):  # the elder fiber always takes up the one that has taken up all the younger ones
        island.step(i, f"a{i}", i, None, (None, f"{i}"), (None, None), 0, False)
    for i in range(n - 1, 0, -1):
        island.step(2 * n - i, f"m{i}", 2 * n - i, None, ("x", f"{i - 1}"), (None, None), 0, False)
    assert max(len(f.lost or ()) for f in island.alive.values()) == 1
    island.end()
    assert max(len(list(f.merged_away())) for f in island.events.told) == n - 2


@pytest.mark.parametrize("points", [1 << 20, 3])
def test_lanes_with_and_without_blocks(spark, tmp_path, monkeypatch, points):
    """Fibers that one window can hold are shuffled once; longer ones are taken hour by hour, with the same rows."""
    from logweave.operators import tables as T

    events(spark, tmp_path, 600, 900, users=5)
    monkeypatch.setattr(T, "BLOCK", points)
    for name in ("lane_segments", "fiber_path", "source_transitions", "lane_concurrency", "track_counts", "track_assignments"):
        same_as_sql(spark, name, tmp_path)
    shuffles = plan(Q.lane_segments(spark, str(tmp_path))).count("Exchange hashpartitioning")
    assert shuffles == 1 if points > 3 else shuffles > 1


def test_jumps_end_at_the_root_and_pass_the_driver_by(spark):
    from logweave.operators import versions as V

    rows = [(str(n), str(n // 2) if n > 1 else None) for n in range(1, 200)]
    versions = spark.createDataFrame(rows, "version_hash string, parent_hash string")
    assert V.jumps(versions).agg(F.max("level")).first()[0] == 3  # 2 ** 3 steps pass the root from a depth of 7; 8 levels before
    pairs = spark.createDataFrame([("3", "27"), ("5", "27"), ("27", "3"), ("1", "199")], "ancestor string, version_hash string")
    found = V.are_ancestors(versions, pairs)
    assert "Broadcast" not in plan(found)
    assert {(r.ancestor, r.version_hash): r.is_ancestor for r in found.collect()} == {("3", "27"): True, ("5", "27"): False, ("27", "3"): False, ("1", "199"): True}


def test_micro_batches_are_several_files_of_equal_number(spark, tmp_path, monkeypatch):
    """No task writes a whole micro-batch, and the batches are those of the parts."""
    from logweave import flow_queries as Q2

    events(spark, tmp_path, 3000, 300, users=20)
    monkeypatch.setattr(Q2, "FILE_LOGS", 200)
    stream = Q2._stream_files(spark, str(tmp_path))
    seen = []
    stream.writeStream.foreachBatch(lambda b, i: seen.append((b.count(), len(b.select(F.input_file_name()).distinct().collect()), b.agg(F.min("ts"), F.max("ts")).first()))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 3 and sum(n for n, _, _ in seen) == 3000 and {f for _, f, _ in seen} == {5}  # 1,000 logs each
    assert seen[0][2][1] < seen[1][2][0] and seen[1][2][1] < seen[2][2][0]
    monkeypatch.setattr(Q2, "BATCH_LOGS", 300)
    same_as_sql(spark, "stream_collected_logs", tmp_path)


def test_components_by_stars_and_rounds(spark, monkeypatch):
    from logweave.plans import components

    staged, real = [], components.stage
    monkeypatch.setattr(components, "stage", lambda df, name: staged.append(name) or real(df, name))

    def found(links):
        staged.clear()
        return dict(components.connected_components(spark.createDataFrame(links, "a long, b long")).collect())

    assert found([(1, 10), (1, 11), (2, 12), (2, 12)]) == {1: 1, 10: 1, 11: 1, 2: 2, 12: 2}
    assert staged == ["links", "parents"]
    assert found([(i + 1, i) for i in range(20)] + [(30, 31), (40, 31)]) == {i: 0 for i in range(21)} | {30: 30, 31: 30, 40: 30}
    assert found([(5, 3), (5, 4), (4, 4)]) == {3: 3, 4: 3, 5: 3}
    assert found([(4, 4)]) == {}


def test_components_of_logs_need_no_order(spark, monkeypatch):
    tables = {}
    for name, rows, schema in (
        ("orders", [(1, 7, "2024-01-02"), (2, 7, "2024-01-03"), (3, 8, "2024-01-02")], "o_orderkey long, o_custkey long, o_orderdate string"),
        ("lineitem", [(1, "2024-01-05"), (1, "2024-01-06"), (9, "2024-01-07")], "l_orderkey long, l_shipdate string"),
    ):
        tables[name] = spark.createDataFrame(rows, schema)
    monkeypatch.setattr(Q, "table", lambda spark, d, name: tables[name])
    monkeypatch.setattr(Q.O, "sequence", lambda *a: pytest.fail("sorted"))
    assert {(r.n_logs, r.n_fibers) for r in Q.merged_components(spark, "").collect()} == {(3, 1), (1, 2)}


def test_patterns_are_tried_once(spark):
    """However often keys, values and their places name what a pattern tells."""
    from logweave.flow_queries import MARKED
    from logweave.operators import correlate as C

    logs = spark.createDataFrame([("a1", "a", "cust=7 mark=1", 0)], "log_id string, source_id string, raw_text string, seq long").withColumn("ts", F.timestamp_seconds("seq"))
    tried = C._rows(logs, MARKED, False, None)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract")
    assert tried == 6  # two captures in each of three patterns
