"""Language-model scoring of whole documents.

Documents are dealt by hash to chunks of about CHUNK_CHARS of text, each a task of its own and in a fixed order, so that
nothing depends on how the input lies in files. Words are 64-bit hashes. A chunk numbers its words, keeps the numbered
documents as a file in the shared folder and sends (chunk, word, count) rows, which are summed by word over all training
documents; the totals go back to the chunks. Each chunk then becomes symbols: the most frequent words, as many as
:func:`modelled` says (their number grows with the training tokens, as do the classes of the softmax), and bands of the
rarer ones by powers of two of their count; words of one occurrence and unknown words are one band. The gated recurrent
model (``recurrent``) predicts symbols, and a word's share of its band (by count; the unknown word is one more word of the
lowest band, with the mass that its words of one and two occurrences leave to it) makes the sum over all words and the
unknown one 1.

ROUNDS passes train on the executors, each over another part of all training documents: every chunk starts from the
common weights and their means, weighted by tokens, are the next ones. Means are taken over FAN models at a time, in the
order of the chunks, until few are left for the driver. Files are named by attempt and found through the rows of the
attempts that succeeded.

Defined results: null or empty text is the end token alone; a null id counts as the empty string for the split; repeated
rows are scored each (and count each); without training documents N and V are 0 and only the uniform model remains; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import io
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, recurrent
from .packing import text_slices
from .shingles import word_hashes
from .token_store import _fs

CHUNK_CHARS = 16_000_000
BANDS = 48
ROUNDS = 4
#: Models that are averaged in one task; that reach the driver in a round.
FAN, MODELS = 16, 8
HELD_OUT_OF = 10
SMOOTH = 0.1
#: The end of a document, among the hashes of words.
END = np.uint64(0)


def modelled(tokens: int) -> int:
    """Words that the model tells apart, for a number of training tokens."""
    return int(tokens**0.4)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % HELD_OUT_OF == 0


def _save(path: str, **arrays: np.ndarray) -> None:
    fs, at = _fs(path)
    data = io.BytesIO()
    np.savez(data, **arrays)
    with fs.open_output_stream(at, compression="zstd") as f:
        f.write(data.getvalue())


def _load(path: str) -> dict[str, np.ndarray]:
    fs, at = _fs(path)
    with fs.open_input_stream(at, compression="zstd") as f:
        return dict(np.load(io.BytesIO(f.read())))


def _number_words(docs: DataFrame, folder: str) -> DataFrame:
    """``chunk, file, number, word, n`` (n: occurrences in training documents) of dealt ``chunk, doc_id, text``."""

    def flush(chunk: int, ids: list, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        file = uuid.uuid4().int >> 65
        lengths = np.array([len(x) for x in parts], np.int64)
        words, tokens = np.unique(np.concatenate(parts), return_inverse=True)
        held = np.array([held_out(i) for i in ids], bool)
        _save(f"{folder}/{file}.words", tokens=tokens.astype(np.int32), lengths=lengths, held=held, ids=np.array([i or 0 for i in ids], np.int64), has_id=np.array([i is not None for i in ids], bool))
        n = np.bincount(tokens[np.repeat(~held, lengths)], minlength=len(words))
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000].view(np.int64)
            m = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, chunk, np.int32)), pa.array(np.full(m, file, np.int64)), pa.array(np.arange(at, at + m, dtype=np.int32)), pa.array(part), pa.array(n[at : at + m].astype(np.int64))],
                ["chunk", "file", "number", "word", "n"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, parts = None, [], []
        for batch in batches:
            chunks = batch.column(2).to_pylist()
            at = 0
            for doc_ids, texts in text_slices(batch):
                for doc_id, words in zip(doc_ids, word_hashes(texts), strict=True):
                    if chunks[at] != chunk:
                        if ids:
                            yield from flush(chunk, ids, parts)
                        chunk, ids, parts = chunks[at], [], []
                    ids.append(doc_id)
                    parts.append(np.append(words, END))
                    at += 1
        if ids:
            yield from flush(chunk, ids, parts)

    return docs.select("doc_id", "text", "chunk").mapInArrow(run, "chunk int, file long, number int, word long, n long")


def _band(counts: np.ndarray) -> np.ndarray:
    """Bands of rarer words: 0 for none or one occurrence, k for 2^k to 2^(k+1) - 1."""
    return np.minimum(np.frexp(np.maximum(counts, 1).astype(np.float64))[1] - 1, BANDS - 1)


class Counts:
    """What the corpus tells the model besides weights: totals, and the counts of the modelled words and the bands."""

    def __init__(self, total: int, distinct: int, top: list[int], bands: dict[int, tuple[int, int]], once: int, twice: int):
        self.total, self.distinct, self.top = total, distinct, len(top)
        #: Bands that occur; the lowest one always does.
        self.bands = max(bands, default=0) + 1
        self.unknown = math.log10(SMOOTH / (total + SMOOTH * (distinct + 1)))
        mass = np.zeros(BANDS)
        for k, (tokens, _) in bands.items():
            mass[k] = tokens
        # the band of single words: what its words leave to the unknown one, by the occurrences of words seen once and twice
        share = once / (once + 2 * twice) if once else 1.0
        self.unknown_in_band = math.log10(share) if share else -math.inf
        self.single = math.log10((1 - share) / once) if once and share < 1 else self.unknown_in_band - math.log10(max(once, 1) + 1)
        if once and share == 1.0:
            self.unknown_in_band = self.single = -math.log10(once + 1)
        self.log_mass = np.log10(np.maximum(mass, 1))
        self.symbol_counts = np.concatenate([np.array(top, np.float64), mass[: self.bands]])
        self.bands_used = mass


def _symbols(rows: DataFrame, folder: str, counts: Counts) -> DataFrame:
    """Turns every chunk's numbers into symbols and base scores, kept as a file: ``chunk, file``."""

    def finish(chunk: int, file: int, totals: np.ndarray, ranks: np.ndarray) -> pa.RecordBatch:
        c = _load(f"{folder}/{file}.words")
        tokens, lengths = c["tokens"], c["lengths"]
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        with np.errstate(divide="ignore"):
            base = np.log10((totals + SMOOTH) / (counts.total + SMOOTH * (counts.distinct + 1)))
            inner = np.where(totals == 0, counts.unknown_in_band, np.where(totals == 1, counts.single, np.log10(np.maximum(totals, 1)) - counts.log_mass[_band(totals)]))
        inner[ranks >= 0] = 0.0
        symbol = np.where(ranks >= 0, ranks, counts.top + _band(totals)).astype(np.int32)
        made = uuid.uuid4().int >> 65
        _save(
            f"{folder}/{made}.symbols", symbols=symbol[tokens], lengths=lengths, held=c["held"], ids=c["ids"], has_id=c["has_id"],
            known=np.add.reduceat((totals > 0)[tokens].astype(np.int64), starts), base=np.add.reduceat(base[tokens], starts), inner=np.add.reduceat(inner[tokens], starts),
        )
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([made], pa.int64())], ["chunk", "file"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, totals, ranks = None, [], []
        for batch in batches:
            chunks, files, _, total, rank = (batch.column(i).to_numpy() for i in range(5))
            edges = np.flatnonzero(np.r_[True, files[1:] != files[:-1]]) if batch.num_rows else []
            for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                here = (int(chunks[a]), int(files[a]))
                if at is not None and at != here:
                    yield finish(*at, np.concatenate(totals), np.concatenate(ranks))
                    totals, ranks = [], []
                at = here
                totals.append(total[a:b])
                ranks.append(rank[a:b])
        if at is not None:
            yield finish(*at, np.concatenate(totals), np.concatenate(ranks))

    return rows.mapInArrow(run, "chunk int, file long")


def _mean_weights(chunks: DataFrame, n_chunks: int, folder: str, shape: recurrent.Shape, flat: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """One round: the weighted mean of what the chunks' training documents of this turn make of the weights."""
    sent = chunks.sparkSession.sparkContext.broadcast(flat)

    def told(part: int, weight: float, model: np.ndarray) -> pa.RecordBatch:
        file = uuid.uuid4().int >> 65
        _save(f"{folder}/{file}.model", model=model)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([weight]), pa.array([file], pa.int64())], ["part", "weight", "file"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = _load(f"{folder}/{file}.symbols")
                starts = np.r_[0, np.cumsum(c["lengths"])[:-1]]
                pick = np.flatnonzero(~c["held"] & (np.arange(len(starts)) % rounds == turn))
                weight = float(c["lengths"][pick].sum())
                if weight:
                    yield told(chunk, weight, recurrent.train(shape, sent.value, c["symbols"], *recurrent.segments(starts[pick], c["lengths"][pick])))

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, weight = None, np.zeros(shape.size), 0.0
        for batch in batches:
            for p, w, file in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p // FAN != part:
                    if weight:
                        yield told(part, weight, (total / weight).astype(np.float32))
                    part, total, weight = p // FAN, np.zeros(shape.size), 0.0
                total += w * _load(f"{folder}/{file}.model")["model"]
                weight += w
        if weight:
            yield told(part, weight, (total / weight).astype(np.float32))

    schema = "part int, weight double, file long"
    models, n = common.stage(chunks.mapInArrow(fit, schema), "models"), n_chunks
    while n > MODELS:
        n = -(-n // FAN)
        groups = models.repartition(n, F.floor(F.col("part") / FAN)).sortWithinPartitions("part")
        models = common.stage(groups.mapInArrow(mean, schema), "models")
    found = models.orderBy("part").collect()  # at most MODELS
    if not found:
        return flat
    total = sum(m["weight"] * _load(f"{folder}/{m['file']}.model")["model"].astype(np.float64) for m in found)
    return (total / sum(m["weight"] for m in found)).astype(np.float32)


ROWS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: ROWS (scores are log10 probabilities of the whole text and its end)."""
    spark = docs.sparkSession
    folder = common.new_folder(spark, "lm")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    chars = docs.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    n_chunks = max(-(-chars // CHUNK_CHARS), 1)
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int"))
    dealt = common.deal(docs, "chunk", n_chunks).sortWithinPartitions("chunk", "doc_id", F.xxhash64("text"))
    words = _number_words(dealt, folder)
    words = common.stage(words, "words")
    # summed in part before the shuffle; both sides of the join are read, so that adaptive execution splits a word of many chunks
    totals = common.stage(words.groupBy("word").agg(F.sum("n").alias("total")), "totals")
    distinct = totals.filter("total > 0")

    size = distinct.agg(F.sum("total"), F.count(F.lit(1)), F.sum((F.col("total") == 1).cast("long")), F.sum((F.col("total") == 2).cast("long"))).first()
    total, n_distinct, once, twice = (int(x or 0) for x in size)
    top = distinct.filter("total > 1").orderBy(F.desc("total"), "word").limit(modelled(total)).select("word", "total")
    ranks = common.stage(top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "word"))), "top")  # few words
    ranks = ranks.select("word", (F.col("rank") - 1).alias("rank"), F.col("total").alias("n"))
    rest = distinct.join(F.broadcast(ranks), "word", "left_anti")
    band = F.least(F.floor(F.log2("total") + 1e-9), F.lit(BANDS - 1)).cast("int")
    bands = {int(k): (int(t), int(n)) for k, t, n in rest.groupBy(band).agg(F.sum("total"), F.count(F.lit(1))).collect()}
    counts = Counts(total, n_distinct, [r["n"] for r in ranks.orderBy("rank").collect()], bands, once, twice)

    words = words.drop("n").join(totals.hint("merge"), "word")
    back = words.join(F.broadcast(ranks), "word", "left").select("chunk", "file", "number", "total", F.coalesce("rank", F.lit(-1)).cast("int").alias("rank"))
    back = common.deal(back, "chunk", n_chunks).sortWithinPartitions("chunk", "number")
    chunks = common.stage(_symbols(back.select("chunk", "file", "number", "total", "rank"), folder, counts), "chunks")
    per_task = common.stage(common.deal(chunks, "chunk", n_chunks).select("chunk", "file"), "dealt")

    shape = recurrent.Shape(counts.top, counts.bands)
    flat = shape.start(counts.symbol_counts)
    if total:
        for turn in range(rounds):
            flat = _mean_weights(per_task, n_chunks, folder, shape, flat, turn, rounds)

    # a training word's own occurrence is not there for a new text: classes get the mass they have with one less
    seen = np.ones(shape.classes)
    less = np.ones(shape.classes)
    for k in range(counts.bands):
        seen[shape.word_classes + k] = less[shape.word_classes + k] = max(counts.bands_used[k], 0.5)
    shifted = rest.groupBy(F.when(F.col("total") <= 2, 0).otherwise(F.least(F.floor(F.log2(F.col("total") - 1) + 1e-9), F.lit(BANDS - 1))).cast("int")).agg(F.sum("total")).collect()
    moved = {int(k): int(t) for k, t in shifted}
    for k in range(counts.bands):
        less[shape.word_classes + k] = max(moved.get(k, 0), 0.5)
    offsets = np.log(less / seen).astype(np.float32)
    sent = spark.sparkContext.broadcast((flat, offsets))
    train_tokens = counts.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, shift = sent.value
        for batch in batches:
            for file in batch.column(1).to_pylist():
                c = _load(f"{folder}/{file}.symbols")
                starts = np.r_[0, np.cumsum(c["lengths"])[:-1]]
                model = recurrent.score(shape, weights, shift, c["symbols"], starts, c["lengths"]) / math.log(10) + c["inner"]
                columns = [
                    pa.array(c["ids"], mask=~c["has_id"]), pa.array(c["held"]), pa.array(c["lengths"]), pa.array(c["known"]),
                    pa.array(np.full(len(starts), train_tokens, np.int64)), pa.array(c["base"]), pa.array(model),
                ]
                names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return per_task.mapInArrow(run, ROWS)
