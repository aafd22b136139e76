"""Sinks for logs, fibers and memberships that are written exactly once.

Each write goes to a folder of its own, named by its number; readers follow the list of finished writes
(``_commits``), so one that dies leaves nothing to see, and one that is repeated under its number adds nothing. A sink has
one writer at a time, as a streaming query is for its own.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .versions import latest

#: The number of the write that a row came with.
BATCH = "batch"
COMMITS = "_commits"


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def commits(spark: SparkSession, path: str) -> dict[int, dict]:
    """Finished writes by number: ``folder``, ``schema``, and whether all before are in it (``base``)."""
    fs, p = _place(spark, f"{path}/{COMMITS}")
    if not fs.exists(p):
        return {}
    names = [n for s in fs.listStatus(p) if not (n := s.getPath().getName()).startswith(("_", "."))]
    if not names:
        return {}
    texts = spark.read.option("wholetext", True).text([f"{path}/{COMMITS}/{n}" for n in names]).collect()  # a line for each write
    entries = sorted((json.loads(r.value) for r in texts), key=lambda e: (e["number"], e["base"]))
    return {e["number"]: e for e in entries}


def _entry(number: int, base: bool) -> str:
    return f"{COMMITS}/{number}{'-base' * base}"


def _commit(spark: SparkSession, path: str, entry: dict) -> None:
    """The entry appears at once or not at all."""
    fs, final = _place(spark, f"{path}/{_entry(entry['number'], entry['base'])}")
    temporary = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{COMMITS}/_{uuid.uuid4().hex}")
    out = fs.create(temporary)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(temporary, final):
        raise RuntimeError(f"write {entry['number']} of {path} is finished already")


def write_batch(df: DataFrame, path: str, number: int | None = None, partitions: list[str] | None = None, base: bool = False) -> bool:
    """Writes ``df`` as one write, under the next number unless one is given; False where that one is finished already."""
    spark = df.sparkSession
    known = commits(spark, path)
    if number is None:
        number = max(known, default=-1) + 1
    elif number in known and not base:
        return False
    folder = f"{BATCH}={number}/attempt={uuid.uuid4().hex}"
    writer = df.write
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(f"{path}/{folder}")
    _commit(spark, path, {"number": number, "folder": folder, "schema": df.schema.json(), "base": base})
    return True


def read(spark: SparkSession, path: str, like: StructType | None = None, before: int | None = None, keys: list[str] | None = None, newest: bool = False) -> DataFrame:
    """Rows of finished writes (of those before ``before``, or of the ``newest`` of them); with ``keys`` the newest row of
    each. ``like``: the columns of a sink that nothing has been written to."""
    known = {n: e for n, e in commits(spark, path).items() if before is None or n < before}
    if not known:
        return spark.createDataFrame([], like)
    start = max(known) if newest else max((n for n, e in known.items() if e["base"]), default=min(known))
    used = [e for n, e in known.items() if n >= start]
    schema = StructType.fromJson(json.loads(used[-1]["schema"]))
    rows = spark.read.schema(StructType(schema.fields).add(BATCH, LongType())).option("basePath", path).parquet(*[f"{path}/{e['folder']}" for e in used])
    if keys:
        rows = latest(rows, keys, BATCH)
    return rows.select(*schema.names)


def prune(spark: SparkSession, path: str, number: int) -> None:
    """Writes before ``number`` go, for sinks whose newest write holds all."""
    _drop(spark, path, {n: e for n, e in commits(spark, path).items() if n < number})


def _drop(spark: SparkSession, path: str, entries: dict[int, dict]) -> None:
    for n, e in entries.items():
        fs, entry = _place(spark, f"{path}/{_entry(n, e['base'])}")
        fs.delete(entry, False)
        fs.delete(_place(spark, f"{path}/{e['folder']}")[1], True)


def compact(spark: SparkSession, path: str, keys: list[str], number: int, gone: str | None = None, partitions: list[str] | None = None) -> None:
    """All up to the finished write ``number`` becomes one, with the newest row of each key (without those that are
    ``gone``), and what it was made of goes."""
    old = {n: e for n, e in commits(spark, path).items() if n <= number}
    if len(old) < 2:
        return
    rows = read(spark, path, before=number + 1, keys=keys)
    write_batch(rows if gone is None else rows.filter(~F.col(gone)), path, number, partitions, base=True)
    _drop(spark, path, old)


def _append_new(df: DataFrame, path: str, keys: list[str], partitions: list[str], number: int | None) -> None:
    """Rows whose keys are not there; only the partitions that are touched are read."""
    df = df.dropDuplicates(keys)
    if commits(df.sparkSession, path):
        touched = F.broadcast(df.select(*partitions).distinct())  # a row for each partition
        there = read(df.sparkSession, path, before=number).join(touched, partitions, "left_semi")
        df = df.join(there.select(*keys), keys, "left_anti").select(*df.columns)
    write_batch(df, path, number, partitions)


def write_logs(logs: DataFrame, path: str, number: int | None = None) -> None:
    """Appends logs whose id is not there, by day."""
    _append_new(logs.withColumn("dt", F.to_date("ts")), path, ["log_id"], ["dt"], number)


def write_memberships(memberships: DataFrame, path: str, number: int | None = None) -> None:
    _append_new(memberships, path, ["log_id", "fiber_id"], ["ruleset_version", "fiber_type"], number)


def upsert_fibers(fibers: DataFrame, path: str, number: int | None = None) -> None:
    """Writes fibers; of an id :func:`read_fibers` shows the newest row. Nothing that is there is read or rewritten."""
    write_batch(fibers.withColumn("dt", F.to_date("first_activity")), path, number, ["ruleset_version", "fiber_type", "dt"])


def read_fibers(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, keys=["fiber_id"])


def fan_out(logs: DataFrame, *sinks) -> None:
    """One ordered stream to several sinks: computed once."""
    logs = logs.persist()
    try:
        for sink in sinks:
            sink(logs)
    finally:
        logs.unpersist()
