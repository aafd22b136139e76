"""Keyed fibers from the state store against a plain version; collectors that send again."""

import random

import pytest
from logweave.operators import ordering as O
from logweave.plans.rules import Attribute, FiberType, Pattern
from logweave.sources import lines as S
from logweave.streaming import keyed, streams
from pyspark.sql import functions as F

FLAGS = {"PEER": (("a",), (), False), "SELF": ((), ("a",), False), "CLOSE": ((), (), True), "": ((), (), False)}


def _plain(rows, gap, from_start, mark):
    """Groups of logs by fiber, and the fibers ended by ``mark``: first log, number, reason."""
    fibers, held = [], {}
    for at, log, key, flag in sorted(r for r in rows if r[0] <= mark):
        f = held.get(key)
        if f and (flag == "PEER" or gap is not None and at - (f["first"] if from_start else f["last"]) > gap):
            f = None
        if f is None:
            f = {"first": at, "logs": [], "why": None}
            fibers.append(f)
        f["last"] = at
        f["logs"].append(log)
        held[key] = None if flag in ("SELF", "CLOSE") else f
        if flag == "CLOSE":
            f["why"] = "pattern"
    for f in fibers:
        if f["why"] is None and gap is not None and mark - (f["first"] if from_start else f["last"]) > gap:
            f["why"] = "timeout"
    return sorted(sorted(f["logs"]) for f in fibers), sorted((f["logs"][0], len(f["logs"]), f["why"]) for f in fibers if f["why"])


@pytest.mark.parametrize(("gap", "mode"), [("6s", "session"), ("6s", "from_start"), ("infinite", "session")])
def test_keyed_fibers(spark, tmp_path, gap, mode):
    """Logs that come in any order within the delay, over several batches."""
    rng, rows, at = random.Random(gap + mode), [], 0
    for i in range(150):
        at += rng.choice([1, 1, 2, 3])
        rows.append((at, f"l{i:04d}", rng.choice("123"), rng.choice([*FLAGS, "", "", ""])))
    patterns = tuple(Pattern(rf"a=(?P<a>\d);{f}$", *FLAGS[f]) for f in FLAGS)
    t = FiberType("t", (Attribute("a", key=True),), {"s": patterns}, gap, mode)
    come = sorted(rows, key=lambda r: r[0] + rng.uniform(0, 8))
    for k in range(0, len(come), 50):
        df = spark.createDataFrame([(log, "s", f"a={key};{flag}", at) for at, log, key, flag in come[k : k + 50]], "log_id string, source_id string, raw_text string, at long")
        df.withColumn("ts", F.timestamp_seconds("at")).drop("at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.PROVIDER)
    try:
        logs = spark.readStream.schema("log_id string, source_id string, raw_text string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        found = keyed.stream_keyed_fibers(logs, t, "10 seconds")
        found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    told = spark.read.parquet(f"{tmp_path}/out").collect()
    groups = {}
    for r in told:
        if r.log_id:
            groups.setdefault(r.first_log_id, []).append(r.log_id)
    want, ended = _plain(rows, None if gap == "infinite" else 6, mode == "from_start", at - 10)
    assert sorted(map(sorted, groups.values())) == want
    assert sorted((r.first_log_id, r.n_logs, r.close_reason) for r in told if r.close_reason) == ended


def test_keys_of_a_bucket_share_a_state():
    """Several keys are one call and one value of the state; only those with logs or something due are told of."""
    import pandas as pd

    class State:
        exists, hasTimedOut, get, ms, at = False, False, None, 0, None

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists, self.get = False, None

        def getCurrentWatermarkMs(self):
            return self.ms

        def setTimeoutTimestamp(self, ms):
            self.at = ms

    state, fold = State(), keyed.KeyedFibers(6_000_000, False)
    told = lambda rows: sorted((tuple(r) for pdf in fold((3,), iter(rows), state) for r in pdf[["key", "first_log_id", "log_id", "n_logs", "close_reason"]].itertuples(index=False)), key=str)
    logs = pd.DataFrame([("a", 2_000_000, "l2", False, False, False), ("b", 9_000_000, "l9", False, False, False), ("a", 1_000_000, "l1", False, False, False)], columns="key us log before after close".split())
    assert told([logs]) == [] and state.at == 999  # out once the watermark is at the first log
    state.ms, state.hasTimedOut = 5_000, True
    assert told([]) == [("a", "l1", "l1", None, None), ("a", "l1", "l2", None, None)] and state.at == 8_000
    state.ms = 9_000
    assert told([]) == [("a", "l1", None, 2, "timeout"), ("b", "l9", "l9", None, None)] and state.at == 15_000
    state.ms = 16_000
    assert told([]) == [("b", "l9", None, 1, "timeout")] and not state.exists


def test_sent_again(spark, tmp_path):
    """What a rewound collector sends again comes once; what it sends late for the first time comes too."""
    log = lambda i, at: (f"l{i}", at, "s", "x", "f", i, 0)
    for name, ids in (("1", [5, 6, 7]), ("2", [8, 9]), ("3", [1, 5, 6])):
        rows = [(name, "c", [log(i, 1000 * i) for i in ids], 1, int(name))]
        kinds = "batch_id string, collector_id string, logs array<struct<log_id:string,at:long,source_id:string,raw_text:string,file_path:string,line_ord:long,file_offset:long>>, config_version long, sequence_num long"
        df = spark.createDataFrame(rows, kinds)
        logs = F.transform("logs", lambda x: F.struct(x["log_id"], F.timestamp_seconds(x["at"]).alias("ts"), x["source_id"], x["raw_text"], x["file_path"], x["line_ord"], x["file_offset"]))
        epoch = F.struct(F.lit(None).cast("timestamp").alias("start"), F.lit(None).cast("timestamp").alias("end"), F.lit(None).cast("timestamp").alias("watermark"), F.lit(0).cast("long").alias("generation"))
        S.write_batches(df.withColumn("logs", logs).withColumn("epoch", epoch).coalesce(1), f"{tmp_path}/in")
    found = streams.stream_collected(S.stream_batches(spark, f"{tmp_path}/in", files=1)).select("log_id", "ts")
    found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.log_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["l1", "l5", "l6", "l7", "l8", "l9"]


def test_neighbours_over_blocks(spark):
    """The row before and behind, in blocks of any size, is that of a window over all rows of a key."""
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, rng.choice([None, 1, 2])) for i in range(60) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "k string, i long, v int")
    for width in (1, 7, 100):
        block = F.floor(F.col("i") / width)
        got = O.neighbour(O.neighbour(df, ["k"], block, ["i"], F.col("v"), "p"), ["k"], block, ["i"], F.col("v"), "n", behind=True)
        want = []
        for key in "ab":
            mine = [r for r in rows if r[0] == key]
            want += [(*r, mine[j - 1][2] if j else None, mine[j + 1][2] if j + 1 < len(mine) else None) for j, r in enumerate(mine)]
        assert sorted(map(tuple, got.select("k", "i", "v", "p", "n").collect()), key=str) == sorted(want, key=str)
