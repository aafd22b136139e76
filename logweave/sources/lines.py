"""Text sources: lines, offsets, records, identity; collector batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import parse_time
from ..operators.ordering import running
from ..plans.rules import Regex, Source

_LOG = "struct<log_id:string,ts:timestamp,source_id:string,raw_text:string,file_path:string,line_ord:bigint,file_offset:bigint>"
#: Lines of a file that one window holds.
LINES = 1 << 18
#: Nested batches as collectors hand them on.
BATCH = (
    "batch_id string, collector_id string, epoch struct<start:timestamp,end:timestamp,watermark:timestamp,generation:bigint>,"
    f" logs array<{_LOG}>, config_version bigint, sequence_num bigint"
)


def read_lines(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """Lines of all sources in file order: ``source_id, file_path, line_ord, value, file_offset``.

    A file's blocks are read in parallel; a line's place is its block's start and its number in the block, and offsets are
    running byte lengths, first by block, then by the blocks before it.
    """
    frames = []
    for s in sources:
        raw = spark.read.option("lineSep", "\n").text(s.path)
        frames.append(raw.select(F.lit(s.source_id).alias("source_id"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value"))
    lines = frames[0]
    for f in frames[1:]:
        lines = lines.unionByName(f)
    block = Window.partitionBy("file_path", "block").orderBy("nth")
    size = F.octet_length("value") + 1
    lines = lines.withColumn("in_block", F.sum(size).over(block.rowsBetween(Window.unboundedPreceding, 0)) - size)
    lines = lines.withColumn("row", F.row_number().over(block))
    blocks = lines.groupBy("file_path", "block").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("file_path").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0"))
    joined = lines.join(blocks, (F.col("file_path") == F.col("p")) & (F.col("block") == F.col("b")))
    return joined.select("source_id", "file_path", (F.col("rows0") + F.col("row") - 1).alias("line_ord"), F.regexp_replace("value", "[\r\n]+$", "").alias("value"), (F.col("bytes0") + F.col("in_block")).alias("file_offset"), (F.col("bytes0") + F.col("in_block") + size).alias("end_offset"))


def from_position(lines: DataFrame, start: str = "beginning", offsets: DataFrame | None = None) -> DataFrame:
    """Lines from the ``beginning``, the ``end`` (none) or a ``stored_offset`` per source and file."""
    if start == "beginning":
        return lines
    if start == "end":
        return lines.filter(F.lit(False))
    known = offsets.select(F.col("source_id").alias("s"), F.col("file_path").alias("p"), F.col("end_offset").alias("stored"))
    joined = lines.join(known, (F.col("source_id") == F.col("s")) & (F.col("file_path") == F.col("p")), "left")
    return joined.filter(F.col("file_offset") >= F.coalesce("stored", F.lit(0))).select(*lines.columns)


def source_offsets(records: DataFrame) -> DataFrame:
    """Where reading goes on after the last record, per source and file."""
    return records.groupBy("source_id", "file_path").agg(F.max("end_offset").alias("end_offset"))


def _by_source(sources: Sequence[Source], value) -> Column:
    first, *rest = sources
    col = F.when(F.col("source_id") == first.source_id, value(first))
    for s in rest:
        col = col.when(F.col("source_id") == s.source_id, value(s))
    return col


def with_timestamp(lines: DataFrame, sources: Sequence[Source]) -> DataFrame:
    """Adds ``has_ts`` (the source's pattern matches) and ``ts`` (null where it does not parse)."""

    def found(s: Source) -> Column:
        r = Regex(s.pattern)
        return F.when(F.col("value").rlike(r.jvm), F.regexp_extract("value", r.jvm, r.groups["ts"]))

    rows = lines.withColumn("__ts", _by_source(sources, found))
    return rows.withColumns({"has_ts": F.col("__ts").isNotNull(), "ts": _by_source(sources, lambda s: parse_time(F.col("__ts"), s.format))}).drop("__ts")


def line_kinds(lines: DataFrame) -> DataFrame:
    """``kind``: start of a record, continuation (indented, without time), or bad."""
    kind = F.when(F.col("ts").isNotNull(), "start").when(F.col("has_ts"), "bad").when(F.col("value").rlike(r"^\s"), "more").otherwise("bad")
    starts = (F.col("kind") == "start").cast("int")
    rows = running(lines.withColumn("kind", kind), ["source_id", "file_path"], F.floor(F.col("line_ord") / LINES), ["line_ord"], starts, "rec")
    return rows.withColumn("kind", F.when((F.col("kind") == "more") & (F.col("rec") == 0), "bad").otherwise(F.col("kind")))


def assemble_records(lines: DataFrame, on_error: str = "drop") -> DataFrame:
    """Records of a timestamped line and the indented ones after it; bad lines are skipped, or fail the query."""
    rows = line_kinds(lines)
    if on_error == "fail":
        rows = rows.withColumn("rec", F.when(F.col("kind") == "bad", F.raise_error(F.concat(F.lit("unusable line: "), F.col("value")))).otherwise(F.col("rec")))
    else:
        rows = rows.filter("kind <> 'bad'")
    parts = F.array_sort(F.collect_list(F.struct("line_ord", "value")))
    return rows.groupBy("source_id", "file_path", "rec").agg(
        F.min(F.when(F.col("kind") == "start", F.col("ts"))).alias("ts"),
        F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("raw_text"),
        F.min("line_ord").alias("line_ord"),
        F.min("file_offset").alias("file_offset"),
        F.max("end_offset").alias("end_offset"),
        F.count(F.lit(1)).alias("n_lines"),
    ).drop("rec")


def rejected_lines(lines: DataFrame) -> DataFrame:
    return line_kinds(lines).filter("kind = 'bad'").drop("rec")


def with_log_id(records: DataFrame) -> DataFrame:
    """An id that reading the same bytes again gives again."""
    return records.withColumn("log_id", F.sha2(F.concat_ws("\0", "source_id", "file_path", F.col("file_offset").cast("string")), 256))


def stamp_ingestion(logs: DataFrame, version: str) -> DataFrame:
    return logs.withColumns({"ingestion_time": F.current_timestamp(), "ruleset_version": F.lit(version)})


def profile_timestamps(lines: DataFrame, candidates: Sequence[tuple[str, str]]) -> DataFrame:
    """Of candidate (pattern, format) pairs, the lines matched and parsed per source, in one pass."""
    aggs = []
    for i, (pattern, kind) in enumerate(candidates):
        r = Regex(pattern)
        match = F.col("value").rlike(r.jvm)
        time = parse_time(F.regexp_extract("value", r.jvm, r.groups["ts"]), kind)
        aggs.append(F.struct(F.lit(i).alias("candidate"), F.count_if(match).alias("matched"), F.count_if(match & time.isNotNull()).alias("parsed")))
    found = lines.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_lines"), F.array(*aggs).alias("c"))
    return found.select("source_id", "n_lines", F.inline("c"))


def logs_from(spark: SparkSession, sources: Sequence[Source], on_error: str = "drop") -> DataFrame:
    """Files to identified logs."""
    return with_log_id(assemble_records(with_timestamp(read_lines(spark, sources), sources), on_error))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BATCH).json(path)


def write_batches(batches: DataFrame, path: str, mode: str = "append") -> None:
    """Puts batches down for :func:`read_batches`, times to the microsecond."""
    batches.write.mode(mode).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def stream_batches(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Batches as collectors put them down, with their files' times as ``arrival``; ``files``: most of a micro-batch."""
    reader = spark.readStream.schema(BATCH)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.json(path).withColumn("arrival", F.col("_metadata.file_modification_time"))


def flatten_batches(batches: DataFrame) -> DataFrame:
    """Logs of nested batches, with the batch's collector, sequence number and generation (and ``arrival``, if known)."""
    known = ["arrival"] if "arrival" in batches.columns else []
    rows = batches.select("collector_id", "sequence_num", F.col("epoch.generation").alias("generation"), *known, F.explode("logs").alias("l"))
    return rows.select("l.*", "collector_id", "sequence_num", "generation", *known)
