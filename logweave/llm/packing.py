"""Best-fit packing with exact-complement hashing.

Documents become token pieces of at most ``capacity`` ids. Only the number of pieces of each length matters for the
plan, so it is made on the driver from a histogram of at most ``capacity`` counts: for each length, longest first,
the gap to a full sequence is looked up among single lengths, sums of two and sums of three that are still available,
and the combination is used as often as its counts allow; what is left goes best-fit (longest piece that fits first).
The plan is a bounded table of slots (length, run of ranks) -> (sequence, offset); executors number the pieces of each
length and look their slot up. No piece passes through the driver.

Defined results: a null text is an empty document (its end id alone); empty tables give empty results; repeated rows
are packed each; null ids are kept; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
END_ID = 0
#: Pieces of one length are numbered in buckets of about this many.
BUCKET_ROWS = 50_000
#: Texts handed to the tokenizer together.
TEXTS_AT_ONCE = 512

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def text_slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts (null: empty) of a batch, a bounded number at a time."""
    for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
        part = batch.slice(at, TEXTS_AT_ONCE)
        yield part.column(0).to_pylist(), [x or "" for x in part.column(1).to_pylist()]


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every document's ids and end id, cut into pieces of at most ``capacity``: columns of PIECES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer).encode
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for ids, texts in text_slices(batch):
                rows: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, raw in zip(ids, encode(texts), strict=True):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        for col, x in zip(rows, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            col.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


class Plan:
    """Patterns of lengths that share a sequence, each with the times it is used."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        self.left[: len(counts)] = counts[: capacity + 1]
        self.left[0] = 0
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        self._exact()
        self._best_fit()

    def _use(self, lengths: tuple[int, ...]) -> None:
        kinds, each = np.unique(lengths, return_counts=True)
        times = int((self.left[kinds] // each).min())
        self.left[kinds] -= times * each
        self.patterns.append((lengths, times))

    def _pair(self, total: int, held: tuple[int, ...]) -> tuple[int, int] | None:
        """Two available lengths that sum to ``total``, the longer as long as can be; ``held`` are in use already."""
        free = self.left[: total + 1].copy()
        for x in held:
            if x <= total:
                free[x] -= 1
        low = np.arange(1, total // 2 + 1)
        fits = (free[low] > 0) & (free[total - low] > 0)
        if total % 2 == 0 and len(low) and free[total // 2] < 2:
            fits[-1] = False
        at = int(fits.argmax()) if fits.any() else -1
        return None if at < 0 else (total - int(low[at]), int(low[at]))

    def _complement(self, length: int) -> tuple[int, ...] | None:
        gap = self.capacity - length
        if gap == 0:
            return ()
        if gap <= self.capacity and self.left[gap] > (gap == length):
            return (gap,)
        if pair := self._pair(gap, (length,)):
            return pair
        for third in np.flatnonzero(self.left[: max(gap - 1, 0)])[::-1].tolist():
            if self.left[third] > (third == length) and (pair := self._pair(gap - third, (length, third))):
                return (third, *pair)
        return None

    def _exact(self) -> None:
        for length in range(self.capacity, 0, -1):
            while self.left[length] > 0 and (rest := self._complement(length)) is not None:
                self._use((length, *rest))

    def _best_fit(self) -> None:
        while (there := np.flatnonzero(self.left)).size:
            lengths, gap, free = [int(there[-1])], self.capacity - int(there[-1]), self.left.copy()
            free[lengths[0]] -= 1
            while gap and (fit := np.flatnonzero(free[: gap + 1])).size:
                x = int(fit[-1])
                n = min(int(free[x]), gap // x)
                lengths += [x] * n
                free[x] -= n
                gap -= n * x
            self._use(tuple(lengths))

    def slots(self) -> dict[str, np.ndarray]:
        """Sorted by (length, first rank): the n-th piece of a length takes the last slot that begins at or before n."""
        rows, used, sequence = [], np.zeros(self.capacity + 1, np.int64), 0
        for lengths, times in self.patterns:
            offset = 0
            for x in sorted(set(lengths), reverse=True):
                each = lengths.count(x)
                rows.append((x, int(used[x]), each, sequence, offset))
                used[x] += each * times
                offset += each * x
            sequence += times
        rows.sort()
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return {k: np.array(c, np.int64) for k, c in zip(("length", "rank", "each", "sequence", "offset"), columns, strict=True)}


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: PIECES and ``sequence_id, offset``."""
    spark = docs.sparkSession
    pieces = common.stage(cut_pieces(docs, tokenizer or common.tokenizer_path("word_bpe_49k.json"), capacity, end_id), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    slots = Plan(counts, capacity).slots()

    buckets = max(64, int(counts.sum()) // BUCKET_ROWS)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    per_bucket = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("nth", nth).join(per_bucket, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))

    table = spark.sparkContext.broadcast(slots)  # bounded by capacity, not by the data

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        width = 1 << 44
        keys = t["length"] * width + t["rank"]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, length * width + rank, side="right") - 1
            nth, each = rank - t["rank"][at], t["each"][at]
            columns = [batch.column(i) for i in range(5)]
            columns += [pa.array(t["sequence"][at] + nth // each), pa.array(t["offset"][at] + nth % each * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
