"""Media columns: members of archives as a Spark data source.

Texts are stored as 8-bit grey PNG images, 192 pixels wide, in ZIP archives of a bounded size. The source plans ranges of
bytes over a directory of archives; a reader takes the members whose header starts in its range, from the archive's
central directory, streams them in Arrow batches, and tries each one again by its offset when reading it fails.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import filled, scratch, table

WIDTH = 192
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, TRIES = 48 << 20, 8 << 20, 4 << 20, 4
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str) -> bytes:
    """UTF-8, filled with spaces up to a positive multiple of the width."""
    data = text.encode()
    return data + b" " * (-len(data) % WIDTH or (0 if data else WIDTH))


def to_png(payload: bytes) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # a row starts with its filter, none
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The rows of samples of an image that to_png made."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, shape = 8, [], (0, 0)
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)[:, 1:]


def write_archives(docs: DataFrame, path: str) -> int:
    """Stores each row's payload as a member of an archive below path; the number of rows. A repeated task writes the same names."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder)
        state = {"n": 0, "rows": 0, "buf": None}

        def close():
            if state["buf"] is not None:
                state["zip"].close()
                name = f"media-{task.partitionId():06d}-{state['n']:05d}.zip"
                tmp = f"{folder}/_{name}.{task.taskAttemptId()}"
                with store.open_output_stream(tmp) as f:
                    f.write(state["buf"].getbuffer())
                store.move(tmp, f"{folder}/{name}")
                state.update(n=state["n"] + 1, buf=None)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), filled(b.column(1)), strict=True):
                if state["buf"] is None:
                    state["buf"] = io.BytesIO()
                    state["zip"] = zipfile.ZipFile(state["buf"], "w", zipfile.ZIP_STORED)
                data = text.encode()
                member = zipfile.ZipInfo(f"{state['rows']:09d}.png")
                member.comment = f"{'' if doc_id is None else doc_id},{len(data)}".encode()
                state["zip"].writestr(member, to_png(payload_of(text)))
                state["rows"] += 1
                if state["buf"].tell() >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([state["rows"]], pa.int64())], names=["rows"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "rows long").agg(F.sum("rows")).first()[0] or 0


class Range(InputPartition):
    def __init__(self, file: str, start: int, stop: int):
        self.file, self.start, self.stop = file, start, stop


class MediaArchives(DataSource):
    """format("media_archives"), option path: a directory of ZIP archives; options range_bytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, offset long, doc_id long, n_bytes long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.step, self.tries = options["path"], int(options.get("range_bytes", RANGE_BYTES)), int(options.get("tries", TRIES))

    def partitions(self):
        """Ranges of bytes from the sizes of the archives; members are looked up where they are read."""
        store, folder = fs.FileSystem.from_uri(self.path)
        files = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.base_name.startswith("media-"))
        return [Range(file, a, min(a + self.step, size)) for file, size in files for a in range(0, size, self.step)] or [Range("", 0, 0)]

    def read(self, part: Range):
        if not part.file:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(part.file) as f:
            members = [m for m in zipfile.ZipFile(f).infolist() if part.start <= m.header_offset < part.stop]
        rows, size = [], 0
        for m in members:
            doc_id, _, n = m.comment.decode().partition(",")
            media = self.member(store, part.file, m)
            rows.append((part.file, m.header_offset, int(doc_id) if doc_id else None, int(n), media))
            size += len(media)
            if size >= BATCH_BYTES:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def member(self, store, file: str, m: zipfile.ZipInfo) -> bytes:
        for k in range(self.tries):
            try:
                with store.open_input_file(file) as f:
                    head = f.read_at(30, m.header_offset)
                    if head[:4] != b"PK\x03\x04":
                        raise OSError(f"no member at {m.header_offset}")
                    name, extra = struct.unpack_from("<HH", head, 26)
                    data = f.read_at(m.compress_size, m.header_offset + 30 + name + extra)
                if len(data) != m.file_size or zlib.crc32(data) != m.CRC:
                    raise OSError(f"damaged member at {m.header_offset}")
                return data
            except OSError:
                if k + 1 == self.tries:
                    raise
                time.sleep(0.1 * 2**k)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "offset", "doc_id", "n_bytes", "media"])


def features(rows: np.ndarray) -> str:
    """Mean, deviation and mean step between neighbours of the samples, and the share of each quarter of their range."""
    x = rows.reshape(-1)
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    quarters = np.bincount(x >> 6, minlength=4) / len(x)
    return f"mean={x.mean():.3f};std={x.std():.3f};step={step:.3f};quarters=" + "/".join(f"{q:.4f}" for q in quarters)


def decode(media: DataFrame) -> DataFrame:
    """Digests and features of each stored member, from the bytes that were read back."""

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for stored in b.column(2):
                data = stored.as_py()
                rows = from_png(data)
                payload = rows.tobytes()
                for column, x in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), features(rows)), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def media_columns(docs: DataFrame, path: str) -> DataFrame:
    """Stores docs below path and reads them back; one row a document. Null texts are one row of spaces, n_bytes 0.

    Repeated rows are members of their own; a text of any length is one member, also where it is longer than a range of bytes; an
    empty table stores nothing and gives no rows; other columns of docs are left out.
    """
    spark = docs.sparkSession
    write_archives(docs, path)
    spark.dataSource.register(MediaArchives)
    return decode(spark.read.format("media_archives").option("path", path).load())


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), scratch(spark, "media"))
