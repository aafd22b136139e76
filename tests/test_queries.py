"""Every core query that SQL expresses, against DuckDB on the smallest tables; streams against batch."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from logweave import flow_queries  # noqa: F401  registers its queries with the others
from logweave import queries as Q
from logweave.operators import ordering as O
from logweave.operators import sinks
from logweave.plans.rules import Rules
from logweave.streaming import streams

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def _plain(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = Q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(Q.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())


def test_stream_correlate_matches_batch(spark, tmp_path):
    logs = Q.logs_of(spark, DATA).orderBy("ts").limit(120).withColumn("log_id", F.col("log_id").cast("string"))
    rows = logs.orderBy("ts").toPandas()
    schema = logs.schema
    for i in range(3):
        spark.createDataFrame(rows[i * 40 : (i + 1) * 40], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streams.stream_correlate(stream, Rules((Q.SESSION,)), f"file://{tmp_path}/out")
    q.awaitTermination()
    batch = O.with_prev_clock(O.sequence(logs, ["ts", "source_id", "log_id"]))
    from logweave.operators.correlate import correlate_type

    want = correlate_type(batch, Q.SESSION, flush=False).fibers.filter("close_reason IS NOT NULL").select("fiber_id", "n_logs")
    got = sinks.read_fibers(spark, f"file://{tmp_path}/out/fibers").select("fiber_id", "n_logs")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sinks_are_idempotent(spark, tmp_path):
    logs = Q.logs_of(spark, DATA).limit(50)
    for _ in range(2):
        sinks.write_logs(logs, f"{tmp_path}/logs")
    assert sinks.read(spark, f"{tmp_path}/logs").count() == 50


def test_writes_are_all_or_nothing(spark, tmp_path, monkeypatch):
    """A writer that dies between its files and the list leaves the old table; the repeated write comes through once."""
    path = f"{tmp_path}/sink"
    rows = [spark.createDataFrame([(k, f"{n}") for k in range(n, n + 3)], "fiber_id int, v string") for n in range(3)]
    assert sinks.write_batch(rows[0], path, 0)
    with monkeypatch.context() as m:
        m.setattr(sinks, "_commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            sinks.write_batch(rows[1], path, 1)
    shown = lambda: sorted((r.fiber_id, r.v) for r in sinks.read(spark, path, keys=["fiber_id"]).collect())
    assert shown() == [(0, "0"), (1, "0"), (2, "0")]
    assert sinks.write_batch(rows[1], path, 1) and not sinks.write_batch(rows[1], path, 1) and sinks.write_batch(rows[2], path, 2)
    assert sinks.read(spark, path).count() == 9
    want = [(0, "0"), (1, "1"), (2, "2"), (3, "2"), (4, "2")]
    assert shown() == want
    sinks.compact(spark, path, ["fiber_id"], 1)
    assert shown() == want and sorted(sinks.commits(spark, path)) == [1, 2] and sinks.read(spark, path).count() == 7
    assert sorted(r.fiber_id for r in sinks.read(spark, path, before=2).collect()) == [0, 1, 2, 3]


def test_stream_sequence_holds_back(spark, tmp_path):
    rows = [("1", "s1", 2), ("2", "s1", 4), ("3", "s2", 1), ("4", "s2", 2)]
    df = spark.createDataFrame(rows, "log_id string, source_id string, t long").select("log_id", "source_id", F.timestamp_seconds("t").alias("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = []
    q = streams.stream_sequence(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/state", ["s1", "s2"], lambda b, i: out.extend(r.log_id for r in b.collect()), margin_us=0)
    q.awaitTermination()
    assert out == ["3"]
