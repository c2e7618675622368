"""Operator 5: token ids in a binary file format with a shared zstandard dictionary.

A shard file holds, in ascending document order::

    b"RFTK1\\n" | width of an id (2 or 4) | sha256 of the dictionary (32 bytes; zeros: none)
    one zstandard frame per document (its ids, little-endian, ``width`` bytes each)
    index: doc_id int64, is_null uint8, first byte uint64, token count uint64, per document
    number of documents uint64 | first byte of the index uint64 | b"RFTKEND\\n"

Any one document is read by one seek into the index and one frame. The dictionary is trained on the id arrays of
at most ``dictionary_docs`` documents (the only sample; it changes sizes, never contents) and is stored beside the shards under its hash.

Cases: null texts are empty documents (the end id alone); null ids come first in order and are kept; equal ids
are ordered by the checksum of their ids; an empty table gives no shard and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.common import chunks, doc_columns, stored, work_dir
from refrain.llm.tokens import encode_texts

MAGIC, END = b"RFTK1\n", b"RFTKEND\n"
INDEX = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("first", "<u8"), ("tokens", "<u8")])
_BLOBS = "shard int, doc_id long, n_tokens long, crc long, frame binary"
_SHARDS = "shard int, path string, docs long, tokens long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def train(samples: list[bytes], size: int = 65536) -> bytes:
    """A dictionary's bytes, or none where the samples are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _context(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


class ShardWriter:
    """Streams frames to one file; the file gets its final name only when it is whole."""

    def __init__(self, folder: str, shard: int, width: int, digest: bytes):
        self.fs, root = fs.FileSystem.from_uri(folder)
        self.path = f"{root}/shard-{shard:08d}-{uuid.uuid4().hex}.rftk"
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.at, self.rows, self.tokens = 0, [], 0
        self._put(MAGIC + bytes([width]) + digest)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, tokens: int, frame: bytes) -> None:
        self.rows.append((doc_id or 0, doc_id is None, self.at, tokens))
        self.tokens += tokens
        self._put(frame)

    def close(self) -> tuple[str, int, int]:
        first = self.at
        self._put(np.array(self.rows, INDEX).tobytes())
        self._put(struct.pack("<QQ", len(self.rows), first) + END)
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return self.path, len(self.rows), self.tokens


class ShardReader:
    """Random access to the documents of a shard file by their place in it."""

    def __init__(self, filesystem: fs.FileSystem, path: str, dictionary: bytes):
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        n, first = struct.unpack("<QQ", self.file.read_at(16, size - 16 - len(END)))
        head = self.file.read_at(len(MAGIC) + 33, 0)
        if head[: len(MAGIC)] != MAGIC or self.file.read_at(len(END), size - len(END)) != END:
            raise ValueError(f"{path} is not a whole token file")
        if head[-32:] != _digest(dictionary):
            raise ValueError(f"{path} was written with another dictionary")
        self.kind = "<u2" if head[len(MAGIC)] == 2 else "<u4"
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, first), INDEX)
        self.ends = np.append(self.index["first"][1:], np.uint64(first))
        self.codec = zstandard.ZstdDecompressor(dict_data=_context(dictionary))

    def ids(self, k: int) -> np.ndarray:
        first = int(self.index["first"][k])
        return np.frombuffer(self.codec.decompress(self.file.read_at(int(self.ends[k]) - first, first)), self.kind)


def _digest(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest() if dictionary else bytes(32)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, width: int = 2, docs_per_shard: int = 16384, dictionary_docs: int = 512, level: int = 3) -> DataFrame:
    """Encode every text and write the shards; returns the manifest (shard, path, docs, tokens).

    ``width`` 2 holds ids below 65,536. A shard's place in the order is decided by quantiles of ``doc_id`` over
    the whole table, so every document lies in exactly one shard and the shards follow each other in order.
    """
    spark = docs.sparkSession
    docs = doc_columns(docs)
    n, n_null = docs.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    shards = max(1, min(50_000, -(-n // docs_per_shard)))
    cuts: list[int] = []
    if shards > 1 and n > n_null:
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)], 20 * shards)).first()[0]))
    filesystem, root = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(root)
    sample = docs.where("text is not null").limit(dictionary_docs).select("text").toArrow()["text"].combine_chunks()
    ids, bounds = encode_texts(pa.concat_arrays(sample.chunks) if isinstance(sample, pa.ChunkedArray) else sample, tokenizer)
    dictionary = train([ids[a:b].astype(f"<u{width}").tobytes() for a, b in zip(bounds, bounds[1:]) if b > a])
    if dictionary:
        with filesystem.open_output_stream(f"{root}/dictionary-{_digest(dictionary).hex()}") as out:
            out.write(dictionary)
    digest, edges = _digest(dictionary), np.array(cuts, np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=level, dict_data=_context(dictionary), write_checksum=False)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in chunks(batches):
            ids, bounds = encode_texts(batch.column(1), tokenizer)
            narrow, raw, last = ids.astype(f"<u{width}"), ids.tobytes(), np.array([end_id], f"<u{width}").tobytes()
            doc = batch.column(0)
            place = np.where(np.asarray(doc.is_null()), 0, np.searchsorted(edges, np.asarray(doc.fill_null(0)), "right")).astype(np.int32)
            pairs = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(place),
                    doc,
                    pa.array([b - a + 1 for a, b in pairs], pa.int64()),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b] + tail) for a, b in pairs], pa.int64()),
                    pa.array([codec.compress(narrow[a:b].tobytes() + last) for a, b in pairs], pa.binary()),
                ],
                names=[c.split()[0] for c in _BLOBS.split(", ")],
            )

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(shard: int, out: ShardWriter) -> pa.RecordBatch:
            path, docs_, tokens = out.close()
            return pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "docs": docs_, "tokens": tokens}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

        at, out = None, None
        for batch in batches:
            for shard, doc, tokens, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4)):
                if shard != at:
                    if out:
                        yield row(at, out)
                    at, out = shard, ShardWriter(folder, shard, width, digest)
                out.add(doc, tokens, frame.as_py())
        if out:
            yield row(at, out)

    blobs = docs.mapInArrow(encode, _BLOBS).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "crc")
    return stored(blobs.mapInArrow(save, _SHARDS), spark)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files named in the manifest: doc_id, ids before it, its token count and checksum."""
    spark: SparkSession = manifest.sparkSession
    filesystem, root = fs.FileSystem.from_uri(folder)
    kept = [f for f in filesystem.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("dictionary-")]
    dictionary = filesystem.open_input_file(kept[0].path).read() if kept else b""
    start, rows = 0, []
    for r in manifest.orderBy("shard").collect():  # one row per shard, at most 50,000
        rows.append((r.path, start))
        start += r.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = ShardReader(files, path, dictionary)
                index = shard.index
                tokens = index["tokens"].astype(np.int64)
                starts = base + np.cumsum(tokens) - tokens
                for a in range(0, len(index), 4096):
                    part = index[a : a + 4096]
                    found = [shard.ids(k) for k in range(a, a + len(part))]
                    if any(len(x) != t for x, t in zip(found, part["tokens"])):
                        raise ValueError(f"{path}: a frame does not hold as many ids as its index says")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(part["doc_id"], pa.int64(), mask=part["is_null"].astype(bool)),
                            pa.array(starts[a : a + 4096]),
                            pa.array(tokens[a : a + 4096]),
                            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    paths = spark.createDataFrame(rows, "path string, base long")
    return paths.repartition(max(1, min(len(rows), 4096))).mapInArrow(run, _READ)


def round_trip(docs: DataFrame, tokenizer: str, **options: int) -> DataFrame:
    """Write the files into the shared folder and read them back."""
    folder = work_dir(docs.sparkSession)
    return read(write(docs, folder, tokenizer, **options), folder)
