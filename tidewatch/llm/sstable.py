"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order, in blocks of prefix-compressed keys, then a sparse index with the first
key of each block, a Bloom filter over the keys, and a footer:

    block*   zstd of entries: shared u8, rest u8, rest of key, bytes per id u8, ids u32, ids
    index    n u32, then first key (length u8, bytes), offset u64, size u32 of each block
    bloom    bits
    footer   index offset u64, bloom offset u64, bloom bytes u32, documents u64, ids u64, MAGIC

A key is doc_id as eight big-endian bytes with the sign turned, so byte order is number order; no doc_id is the empty key.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import default_tokenizer, filled, scratch, table, token_ids

MAGIC = b"TWSST001"
FOOTER = struct.Struct("<QQIQQ8s")
BLOCK_BYTES, SHARD_BYTES, END_ID = 64 << 10, 64 << 20, 2
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Collects documents in key order; done() gives the bytes of the shard."""

    def __init__(self, block_bytes: int = BLOCK_BYTES):
        self.block_bytes = block_bytes
        self.out, self.block, self.index, self.keys = io.BytesIO(), io.BytesIO(), [], []
        self.last, self.first, self.ids = b"", None, 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.first is None:
            self.first, self.last = key, b""
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        wide = 2 if not len(ids) or ids.max() < 1 << 16 else 4
        self.block.write(struct.pack("<BB", shared, len(key) - shared) + key[shared:] + struct.pack("<BI", wide, len(ids)))
        self.block.write(ids.astype(f"<u{wide}").tobytes())
        self.last = key
        self.keys.append(key)
        self.ids += len(ids)
        if self.block.tell() >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.first is not None:
            data = self.pack.compress(self.block.getvalue())
            self.index.append((self.first, self.out.tell(), len(data)))
            self.out.write(data)
            self.block, self.first = io.BytesIO(), None

    def size(self) -> int:
        return self.out.tell() + self.block.tell()

    def done(self) -> bytes:
        self._flush()
        index_at = self.out.tell()
        self.out.write(struct.pack("<I", len(self.index)))
        for key, at, size in self.index:
            self.out.write(struct.pack("<B", len(key)) + key + struct.pack("<QI", at, size))
        bits = bytearray((max(64, BLOOM_BITS * len(self.keys)) + 7) // 8)
        for key in self.keys:
            for p in _bloom_places(key, 8 * len(bits)):
                bits[p >> 3] |= 1 << (p & 7)
        bloom_at = self.out.tell()
        self.out.write(bits)
        self.out.write(FOOTER.pack(index_at, bloom_at, len(bits), len(self.keys), self.ids, MAGIC))
        return self.out.getvalue()


class Reader:
    """A shard's bytes, or any buffer that can be sliced."""

    def __init__(self, data):
        self.data = memoryview(data)
        self.index_at, self.bloom_at, self.bloom_size, self.documents, self.ids, magic = FOOTER.unpack(self.data[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a shard")
        at, self.index = self.index_at + 4, []
        for _ in range(struct.unpack_from("<I", self.data, self.index_at)[0]):
            n = self.data[at]
            self.index.append((bytes(self.data[at + 1 : at + 1 + n]), *struct.unpack_from("<QI", self.data, at + 1 + n)))
            at += 13 + n

    def _entries(self, block: int):
        _, at, size = self.index[block]
        data, p, key = zstandard.ZstdDecompressor().decompress(self.data[at : at + size]), 0, b""
        while p < len(data):
            shared, rest = data[p], data[p + 1]
            key = key[:shared] + data[p + 2 : p + 2 + rest]
            p += 2 + rest
            wide, n = struct.unpack_from("<BI", data, p)
            yield key, np.frombuffer(data, f"<u{wide}", n, p + 5).astype("<u4")
            p += 5 + wide * n

    def __iter__(self):
        for block in range(len(self.index)):
            yield from self._entries(block)

    def lookup(self, doc_id: int | None) -> np.ndarray | None:
        """Ids of the first document with this key: Bloom filter, binary search of the index, then one block."""
        key = key_of(doc_id)
        if not all(self.data[self.bloom_at + (p >> 3)] >> (p & 7) & 1 for p in _bloom_places(key, 8 * self.bloom_size)):
            return None
        lo, hi = 0, len(self.index)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        for block in (lo - 1, lo):
            if 0 <= block < len(self.index):
                for k, ids in self._entries(block):
                    if k == key:
                        return ids
        return None


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shards: int | None = None, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> list[tuple[str, int, int]]:
    """Encodes docs and writes shards in ascending doc_id order; (file, documents, ids) of each, in that order.

    Texts are dealt by range and encoded where they land, so text is shuffled rather than ids. A file is written under
    a name of its task attempt and then renamed, so a repeated task gives the same files.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder)
        count, w, out = 0, Writer(block_bytes), []

        def close():
            name = f"shard-{task.partitionId():06d}-{count:05d}.sst"
            tmp = f"{folder}/_{name}.{task.taskAttemptId()}"
            with store.open_output_stream(tmp) as f:
                f.write(w.done())
            store.move(tmp, f"{folder}/{name}")
            out.append((name, len(w.keys), w.ids))

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), token_ids(filled(part.column(1)), tokenizer), strict=True):
                    w.add(key_of(doc_id), np.append(ids, np.uint32(end_id)))
                    if w.size() >= shard_bytes:
                        close()
                        count, w = count + 1, Writer(block_bytes)
        if w.keys:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "documents", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    made = rows.mapInArrow(run, "file string, documents long, ids long").collect()  # one row a shard
    return sorted(map(tuple, made))


def read_shards(spark: SparkSession, path: str, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """One row a document, from the files: doc_id, start (ids of all before it), n_tokens, ids_crc32, shard."""
    before, total = {}, 0
    for name, _, ids in manifest:
        before[name] = total
        total += ids
    starts = spark.sparkContext.broadcast(before)  # a number a shard

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                name = file.rpartition("/")[2]
                at, doc, start, n, crc = starts.value[name], [], [], [], []
                for key, ids in Reader(content.as_buffer()):
                    doc.append(id_of(key))
                    start.append(at)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.tobytes()))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in (doc, start, n, crc)), pa.array([name] * len(doc), pa.string())], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string"
    if not manifest:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.sst").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


def token_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, **how) -> DataFrame:
    """Writes docs to path and reads them back. Null texts are the end id alone; equal doc_ids follow each other in any order,
    rows without one come first. Texts of any length are one entry; an empty table makes no file and gives no rows; other
    columns of docs are left out."""
    return read_shards(docs.sparkSession, path, write_shards(docs, path, tokenizer or default_tokenizer(), end_id, **how))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(table(spark, sf_dir, "documents"), scratch(spark, "shards"))
