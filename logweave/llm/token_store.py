"""Token-id files: one zstandard frame per document under a shared dictionary, with an offset index.

A file holds one shard, a range of ``doc_id`` (of an id with more rows than a shard, a range of their ids' checksums), and
is written by a task of its own: ``MAGIC``, SHA-256 of the dictionary, the frames one after another, the
index (one entry of INDEX per document), the index's place and number of entries, ``MAGIC`` again. Ids are stored as
uint16 where the vocabulary allows, else uint32 (flag in the header). The dictionary, trained on the serialized ids of
a bounded sample, lies beside the shards as ``<hash>.dict``. A shard is written under a name of its attempt's own and
only counts if the manifest, which comes from the tasks that succeeded, names it: lost executors and repeated attempts
leave no half shard in the result.

Defined results: null text is empty (its end id alone); rows are ordered by ``doc_id`` (null first), repeated ids by
their ids' checksum; an empty table gives no shard and no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens
from .packing import text_slices

MAGIC = b"LWTOKEN1"
END_ID = 2
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "<u1"), ("at", "<u8"), ("size", "<u4"), ("n_tokens", "<u4"), ("start", "<u8")])
#: The dictionary is fitted on about this many documents, picked by hash, in pieces of at most PIECE_BYTES.
SAMPLE_DOCS, PIECE_BYTES, DICTIONARY_BYTES = 1_000, 16 * 1024, 64 * 1024
#: Characters of text in a shard; small corpora still get up to MIN_SHARDS shards.
SHARD_CHARS, MIN_SHARD_CHARS, MIN_SHARDS = 32_000_000, 1_000_000, 64
LEVEL = 3
#: A null id's place in the order of ids.
NULL_ID = -(1 << 63)

FRAMES = "shard int, doc_id long, n_tokens long, crc long, frame binary"
FRAME_COLUMNS = ("shard", "doc_id", "n_tokens", "crc", "frame")
MANIFEST = "shard int, path string, docs long, n_tokens long"
ROWS = "doc_id long, shard int, start_in_shard long, n_tokens long, ids_crc32 long"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _write(path: str, data: bytes) -> None:
    fs, at = _fs(path)
    with fs.open_output_stream(at) as f:
        f.write(data)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A zstandard dictionary from the serialized ids of a bounded sample; empty if there is too little to learn from."""
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    picked = F.pmod(F.xxhash64("doc_id", F.lit("dictionary")), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)
    sample = docs.filter(picked).select("doc_id", "text").repartition(1)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode, samples = tokens.encoder(tokenizer), []
        for batch in batches:
            for _, texts in text_slices(batch):
                for raw in encode.encode(texts):
                    raw = _narrow(raw, encode)
                    samples += [raw[at : at + PIECE_BYTES] for at in range(0, len(raw), PIECE_BYTES)]
        try:
            found = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:  # too few samples
            found = b""
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], ["d"])

    rows = sample.mapInArrow(fit, "d binary").collect()
    return bytes(rows[0][0]) if rows else b""


def _narrow(raw: bytes, encode: tokens.Encoder) -> bytes:
    return np.frombuffer(raw, "<u4").astype("<u2").tobytes() if encode.tokenizer.get_vocab_size() <= 1 << 16 else raw


def _compressor(dictionary: bytes):
    import zstandard

    d = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_dict_id=False, write_content_size=True, **d), zstandard.ZstdDecompressor(**d)


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode all documents and write them in ascending ``doc_id`` order; returns the manifest."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    dictionary = train_dictionary(docs, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    _write(f"{folder}/{digest}.dict", dictionary)

    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = int(max(-(-chars // SHARD_CHARS), min(MIN_SHARDS, -(-chars // MIN_SHARD_CHARS)), 1))
    parts = [k / shards for k in range(1, shards)]
    at = F.coalesce("doc_id", F.lit(NULL_ID))
    bounds = docs.agg(F.percentile_approx(at, parts, 100_000)).first()[0] if parts else []
    bounds = np.array(sorted(bounds or []), np.int64)

    def shards_of(ids: list, crcs: list[int]) -> np.ndarray:
        """Shards in the order of ids; an id that is several bounds is dealt over as many shards by checksum."""
        keys = np.array([NULL_ID if i is None else i for i in ids], np.int64)
        low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
        nth = (np.array(crcs, np.int64) * (high - low)) >> 32
        return np.where(high > low, low + 1 + nth, high).astype(np.int32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(tokenizer)
        compress = _compressor(dictionary)[0].compress
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for ids, texts in text_slices(batch):
                raws = [raw + end for raw in coder.encode(texts)]
                crcs = [zlib.crc32(x) for x in raws]
                columns = [
                    pa.array(shards_of(ids, crcs)),
                    pa.array(ids, pa.int64()),
                    pa.array([len(x) // 4 for x in raws], pa.int64()),
                    pa.array(crcs, pa.int64()),
                    pa.array([compress(_narrow(x, coder)) for x in raws], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "n_tokens", "crc", "frame"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = tokens.encoder(tokenizer).tokenizer.get_vocab_size()
        shard, writer = None, None
        for batch in batches:
            for row_shard, doc_id, n, frame in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if row_shard != shard:
                    if writer:
                        yield writer.close()
                    shard, writer = row_shard, _Writer(folder, row_shard, digest, vocabulary)
                writer.add(doc_id, n, frame)
        if writer:
            yield writer.close()

    frames = common.deal(docs.mapInArrow(encode, FRAMES), "shard", shards).sortWithinPartitions("shard", "doc_id", "crc")
    return common.stage(frames.select(*FRAME_COLUMNS).mapInArrow(write, MANIFEST), "manifest")


class _Writer:
    def __init__(self, folder: str, shard: int, digest: str, vocabulary: int):
        self.path, self.shard, self.entries, self.tokens = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tok", shard, [], 0
        fs, at = _fs(self.path)
        self.file = fs.open_output_stream(at)
        head = MAGIC + bytes.fromhex(digest) + struct.pack("<B", 2 if vocabulary <= 1 << 16 else 4)
        self.file.write(head)
        self.at = len(head)

    def add(self, doc_id: int | None, n: int, frame: bytes) -> None:
        self.file.write(frame)
        self.entries.append((doc_id or 0, doc_id is not None, self.at, len(frame), n, self.tokens))
        self.at += len(frame)
        self.tokens += n

    def close(self) -> pa.RecordBatch:
        self.file.write(np.array(self.entries, INDEX).tobytes())
        self.file.write(struct.pack("<QQ", self.at, len(self.entries)) + MAGIC)
        self.file.close()
        return pa.RecordBatch.from_arrays([pa.array([self.shard], pa.int32()), pa.array([self.path]), pa.array([len(self.entries)], pa.int64()), pa.array([self.tokens], pa.int64())], ["shard", "path", "docs", "n_tokens"])


class ShardReader:
    """Random access to one shard: the index is read at once, frames as asked for."""

    def __init__(self, path: str):
        fs, at = _fs(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        tail = self.file.read_at(16 + len(MAGIC), size - 16 - len(MAGIC))
        place, n = struct.unpack("<QQ", tail[:16])
        head = self.file.read_at(len(MAGIC) + 33, 0)
        if head[: len(MAGIC)] != MAGIC or tail[16:] != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, place), INDEX)
        digest, self.width = head[len(MAGIC) : -1].hex(), head[-1]
        fs, folder = _fs(path.rsplit("/", 1)[0])
        with fs.open_input_stream(f"{folder}/{digest}.dict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).hexdigest() != digest:
            raise ValueError(f"the dictionary of {path} has changed")
        self.decompress = _compressor(dictionary)[1].decompress

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document, as uint32."""
        e = self.index[k]
        return np.frombuffer(self.decompress(self.file.read_at(int(e["size"]), int(e["at"]))), f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Ids of the documents of that id."""
        return [self.ids(int(k)) for k in np.flatnonzero((self.index["doc_id"] == doc_id) & (self.index["has_id"] == 1))]


def read_store(manifest: DataFrame) -> DataFrame:
    """Every document of the files that the manifest names, decoded: ROWS and ``start`` over all shards."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = ShardReader(path)
                for at in range(0, len(reader.index), 4096):
                    part = reader.index[at : at + 4096]
                    decoded = [reader.ids(at + k) for k in range(len(part))]
                    columns = [
                        pa.array([int(i) if h else None for i, h in zip(part["doc_id"], part["has_id"], strict=True)], pa.int64()),
                        pa.array([shard] * len(part), pa.int32()),
                        pa.array(part["start"].astype(np.int64)),
                        pa.array([len(x) for x in decoded], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in decoded], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "start_in_shard", "n_tokens", "ids_crc32"])

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    starts = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))
    # a task for each shard: the manifest itself is small enough to be put into one otherwise
    places = manifest.select("path", (F.row_number().over(Window.orderBy("shard")) - 1).alias("place"), "shard")  # one row per shard
    dealt = common.deal(common.stage(places, "places"), "place", max(manifest.count(), 1))
    rows = dealt.select("shard", "path").mapInArrow(read, ROWS)
    joined = common.lookup_join(rows, starts, ["shard"], F.col("doc_id"))
    return joined.select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Write all documents to token files and return what reading them back gives, per document."""
    folder = folder or common.new_folder(spark, "tokens")
    return read_store(write_store(docs, folder, tokenizer or common.tokenizer_path("byte_bpe_50k.json"), end_id))
