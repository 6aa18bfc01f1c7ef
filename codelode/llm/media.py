"""Media columns: documents as 8-bit grey images in archives, read back by a Spark data source.

``df.write.format("codelode_media").save(folder)`` takes (id, payload text) rows and writes ZIP archives of PNG images, a
new archive whenever one reaches ``ARCHIVE_BYTES``. Tasks write under names of their own attempt; the commit lists those
that count in ``_manifest.json``, so lost or repeated attempts leave nothing that is read.

``spark.read.format("codelode_media").load(folder)`` plans byte ranges of at most ``range_bytes`` over the archives from
the manifest alone. A task reads its archive's directory, takes the members whose offset is in its range, and streams
them in Arrow batches of ``BATCH_BYTES``. A member that cannot be read is tried again by its offset, the file opened
anew; after ``RETRIES`` failures its row has the error and no media, and the others are not touched.

The folder is any URI that pyarrow's file systems open. A null or empty text becomes one row of 255s. Null and repeated
ids keep a member each. An empty table gives an empty manifest. Equal texts give equal images. Texts are held whole, one
at a time. Columns other than id and text are not stored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import tidy

WIDTH = 576
ARCHIVE_BYTES = 128 << 20
BATCH_BYTES = 4 << 20
RETRIES = 3
PNG = b"\x89PNG\r\n\x1a\n"
FORMAT = "codelode_media"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(text: str | None) -> bytes:
    """UTF-8 of the text, padded by 255 to rows of ``WIDTH`` samples; the unpadded size is a text chunk."""
    data = (text or "").encode("utf-8", "surrogatepass")
    height = max(1, -(-len(data) // WIDTH))
    rows = np.full(height * WIDTH, 255, np.uint8)
    rows[: len(data)] = np.frombuffer(data, np.uint8)
    lines = np.zeros((height, WIDTH + 1), np.uint8)
    lines[:, 1:] = rows.reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[int, bytes]:
    """Unpadded size and payload of an image written by ``to_png``; checksums are verified."""
    if not media.startswith(PNG):
        raise ValueError("not a PNG image")
    at, size, lines, width = len(PNG), 0, [], 0
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + data):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width = struct.unpack(">I", data[:4])[0]
        elif kind == b"tEXt" and data.startswith(b"bytes\0"):
            size = int(data[6:])
        elif kind == b"IDAT":
            lines.append(data)
        at += 12 + n
    samples = np.frombuffer(zlib.decompress(b"".join(lines)), np.uint8).reshape(-1, width + 1)[:, 1:]
    return size, samples.tobytes()


def image_feature(payload: bytes) -> str:
    """Mean sample and a 64-bit hash: which of 64 equal stretches are brighter than the mean."""
    x = np.frombuffer(payload, np.uint8)
    means = x.reshape(64, -1).mean(axis=1)
    bits = int.from_bytes(np.packbits(means > x.mean()).tobytes(), "big")
    return f"{x.mean():.4f}:{bits:016x}"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class MediaWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = _open(self.folder)
        fs.create_dir(base, recursive=True)
        files, stream, archive, name, n = [], None, None, "", 0

        def close() -> None:
            archive.close()
            files.append((name, stream.tell()))
            stream.close()

        for batch in iterator:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                if archive is None:
                    name, n = f"part-{uuid.uuid4().hex}.zip", 0
                    stream = fs.open_output_stream(f"{base}/{name}")
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                key = key.as_py()
                archive.writestr(zipfile.ZipInfo(f"{n}/{'' if key is None else key}.png"), to_png(text.as_py()))
                n += 1
                if stream.tell() >= ARCHIVE_BYTES:
                    close()
                    archive = None
        if archive is not None:
            close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = _open(self.folder)
        fs.create_dir(base, recursive=True)
        listed = sorted(tuple(f) for m in messages if m is not None for f in m.files)
        with fs.open_output_stream(f"{base}/_manifest.json") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = _open(self.folder)
        for m in messages:
            for name, _ in m.files if m is not None else []:
                fs.delete_file(f"{base}/{name}")


@dataclass
class ByteRange(InputPartition):
    name: str
    start: int
    end: int


class MediaReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self) -> list[ByteRange]:
        fs, base = _open(self.folder)
        with fs.open_input_stream(f"{base}/_manifest.json") as file:
            listed = json.loads(file.read())
        step = self.range_bytes
        return [ByteRange(name, at, min(at + step, size)) for name, size in listed for at in range(0, size, step)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, base = _open(self.folder)
        path, held, rows = f"{base}/{partition.name}", 0, []
        with fs.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
            for info in archive.infolist():
                if partition.start <= info.header_offset < partition.end:
                    media, error = read_member(lambda: fs.open_input_file(path), archive, info)
                    rows.append((partition.name, info.header_offset, info.filename, media, error))
                    held += len(media or b"")
                    if held >= BATCH_BYTES:
                        yield _batch(rows)
                        held, rows = 0, []
        if rows:
            yield _batch(rows)


def read_member(reopen, archive: zipfile.ZipFile, info: zipfile.ZipInfo, retries: int = RETRIES) -> tuple[bytes | None, str | None]:
    """The member's bytes, or None and the last error; after a failure the file is opened anew for this member alone."""
    error = None
    for attempt in range(retries + 1):
        try:
            if not attempt:
                return archive.read(info), None
            with reopen() as file, zipfile.ZipFile(file) as again:
                return again.read(next(x for x in again.infolist() if x.header_offset == info.header_offset)), None
        except (OSError, zipfile.BadZipFile, zlib.error, StopIteration, ValueError) as found:
            error = f"{type(found).__name__}: {found}"
    return None, error


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "offset", "member", "media", "error"])


class MediaArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "archive string, offset long, member string, media binary, error string"

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"], int(self.options.get("range_bytes", 16 << 20)))

    def writer(self, schema, overwrite: bool) -> MediaWriter:
        return MediaWriter(self.options["path"])


def write_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    docs.sparkSession.dataSource.register(MediaArchives)
    docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).write.format(FORMAT).mode("append").save(folder)


def read_media(spark, folder: str, range_bytes: int = 16 << 20) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format(FORMAT).option("range_bytes", range_bytes).load(folder)


DESCRIBED = "archive string, offset long, doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def describe_media(media: DataFrame) -> DataFrame:
    """One row a member: sizes, digests and the feature of what was read back; nulls and ``error`` where that failed."""
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [(n, kinds[k]) for n, k in (x.split(" ") for x in DESCRIBED.split(", "))]

    @tidy
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for archive, offset, member, image, error in zip(*(batch.column(i) for i in range(5)), strict=True):
                key, image, error = member.as_py().split("/", 1)[1][: -len(".png")], image.as_py(), error.as_py()
                found: tuple = (None,) * 7
                doc = None
                try:
                    doc = int(key) if key else None
                    if error is None:
                        size, payload = from_png(image)
                        found = (size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), image_feature(payload))
                except (ValueError, zlib.error, struct.error) as damage:
                    error = f"{type(damage).__name__}: {damage}"
                rows.append((archive.as_py(), offset.as_py(), doc, *found, error))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    return media.select("archive", "offset", "member", "media", "error").mapInArrow(describe, DESCRIBED)
