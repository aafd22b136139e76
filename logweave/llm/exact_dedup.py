"""Exact dedup by skew-safe combining.

Three aggregations, each grouping by digest *and* full text: inside each map task, over (digest, salt), then over the
winners of all salts. However many copies a text has, a salt group receives at most one row per map task and the last
step at most one row per salt. The winners then tell of every digest how many texts it stands for. A digest of one text
(compared in full) is enough to find the winner of a document; where texts share a digest, documents find it by their
full text. Only DataFrame functions are used.

Defined results: a null text counts as empty; the largest ``doc_id`` of equal texts stays (null ids lose to any id);
of rows that repeat both id and text exactly one stays; an empty table gives an empty result; further columns, also
ones named like this module's, are carried by :func:`drop_exact_copies` and ignored by :func:`exact_groups`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Ids of copies that are broadcast; more are joined by key.
BROADCAST_IDS = 500_000
#: Salts of the middle step.
SALTS = 32
#: Documents of one group that look up their winner in one task.
ROWS_A_GROUP = 10_000


def normalised(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """``digest, keep_id, group_size, same`` of texts with copies or with another text's digest (then ``same``: the text)."""
    local = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = local.groupBy("digest", "text", "salt").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    counted = common.stage(merged.drop("text"), "winners")
    shared = common.stage(counted.groupBy("digest").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m"), "shared")
    copied = counted.filter("group_size > 1").withColumn("same", F.lit(None).cast("string"))
    if shared.isEmpty():
        return copied
    alone = copied.join(shared, "digest", "left_anti")
    return alone.unionByName(merged.join(shared, "digest", "left_semi").withColumnRenamed("text", "same"))


def _dealt(rows: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ``part``: the rows of a large group are dealt over parts, each of which has a copy of the group."""
    large = groups.groupBy("digest").agg(F.ceil(F.sum("group_size") / ROWS_A_GROUP).alias("parts")).filter("parts > 1")
    large = common.stage(large, "large")
    rows = common.lookup_join(rows, large, ["digest"], F.col("doc_id"))
    rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0).cast("long"))).drop("parts")
    groups = common.lookup_join(groups, large, ["digest"], F.col("keep_id"))
    groups = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)))
    return rows, groups.drop("parts").hint("merge")


def _decided(rows: DataFrame, salts: int) -> DataFrame:
    """``doc_id, digest, same, keep_id, group_size, kept, text_sha256`` of ``doc_id, digest, text``."""
    groups = common.stage(_winners(rows, salts), "groups")
    texts = not groups.filter("same IS NOT NULL").isEmpty()
    rows = rows.withColumn("text_sha256", F.sha2("text", 256))
    rows = rows if texts else rows.drop("text")
    if groups.count() <= common.BROADCAST_ROWS and not texts:
        rows, groups = rows.withColumn("part", F.lit(0)), F.broadcast(groups.withColumn("part", F.lit(0)))
    else:
        rows, groups = _dealt(rows, groups)
    on = [rows["digest"] == groups["digest"], rows["part"] == groups["part"]]
    if texts:
        on.append(groups["same"].isNull() | (groups["same"] == rows["text"]))
    known = rows.join(groups, on, "left").select(
        "doc_id",
        rows["digest"],
        "same",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "text_sha256",
    )
    # rows that repeat id and text: one of them stays
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_sha256", "same").orderBy("group_size"))
    return known.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (nth == 1))


def _rows(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = normalised(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), digest(text).alias("digest"), text.alias("text"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    decided = _decided(_rows(docs, id_col, text_col, digest), salts)
    return decided.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The documents that stay, with all their columns."""
    # own names, so that columns of the documents cannot clash with those made here
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    id_name, text = names[docs.columns.index(id_col)], normalised(F.col(names[docs.columns.index(text_col)]))
    # what goes, per id and text: all rows of it, or all but one
    groups = _decided(_rows(docs, id_col, text_col, digest), salts)
    lost = groups.groupBy(F.col("doc_id").alias("of_id"), F.col("digest").alias("of_digest"), "same").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("k"))
    lost = common.stage(lost.filter("n > k").drop("n"), "lost")
    if lost.count() <= BROADCAST_IDS:
        lost = F.broadcast(lost)
    marked = own.withColumn("digest", digest(text))
    on = marked[id_name].eqNullSafe(lost["of_id"]) & (marked["digest"] == lost["of_digest"]) & (lost["same"].isNull() | (lost["same"] == text))
    marked = marked.join(lost, on, "left")
    whole = marked.filter("k IS NULL").select(*names)
    if not lost.filter("k > 0").isEmpty():
        repeated = marked.filter("k > 0").dropDuplicates(["digest", "same", id_name]).select(*names)
        whole = whole.unionByName(repeated)
    return whole.toDF(*docs.columns)


EXACT_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
