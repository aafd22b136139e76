"""Shared pieces of the training-data operators: words, shared folders, checked joins."""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import free, shared_dir, stage  # noqa: F401  used by the operators

#: White space between words: space and the controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as characters, for ``translate``.
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: A lookup table of at most this many rows is broadcast; a larger one is joined by key.
BROADCAST_ROWS = 20_000
#: Copies of each row of a larger lookup table, so that a key with many rows is dealt to many tasks.
LOOKUP_SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; it goes when the session's file systems close."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return path


def lookup_join(rows: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "left") -> DataFrame:
    """Join ``rows`` to a table with one row per key (keys may be null).

    ``small`` is counted first: up to BROADCAST_ROWS rows it is broadcast, beyond that each of its rows is
    repeated under LOOKUP_SALTS salts and the rows choose a salt by ``spread``, so that a hot key is split.
    """
    if small.count() <= BROADCAST_ROWS:
        right = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in small.columns if c not in keys])
        on = [rows[k].eqNullSafe(right[f"__{k}"]) for k in keys]
        return rows.join(F.broadcast(right), on, how).drop(*[f"__{k}" for k in keys])
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(LOOKUP_SALTS)).cast("int"))
    right = small.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(LOOKUP_SALTS - 1))))
    right = right.select(*[F.col(k).alias(f"__{k}") for k in keys], "__s", *[c for c in small.columns if c not in keys])
    on = [left["__salt"] == right["__s"], *[left[k].eqNullSafe(right[f"__{k}"]) for k in keys]]
    return left.join(right.hint("merge"), on, how).drop("__salt", "__s", *[f"__{k}" for k in keys])


def deal(rows: DataFrame, part: str, n: int) -> DataFrame:
    """The rows with each number 0 to n - 1 of the column ``part`` in a task of its own.

    ``repartition`` by the number would put several into one task: their hashes are dealt, so a number whose hash falls
    to each task is looked for first.
    """
    if n == 1:
        return rows.repartition(1)
    numbers = rows.sparkSession.range(int(n * (math.log(n) + 12)))
    keys = numbers.groupBy(F.pmod(F.hash("id"), F.lit(n)).cast("int").alias(part)).agg(F.min("id").alias("__key"))
    return lookup_join(rows, stage(keys, "keys"), [part], F.col(rows.columns[0])).repartition(n, "__key").drop("__key")


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; ``LOGWEAVE_TOKENIZERS`` names another folder."""
    folder = os.environ.get("LOGWEAVE_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
