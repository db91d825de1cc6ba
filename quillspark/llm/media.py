"""Media columns from archive directories (operator 10): a custom Spark data source, and texts as audio members.

The source `media_archive` writes binary members into ZIP archives of about ROLL bytes under a directory and reads
them back. Reading plans a partition for each RANGE bytes of an archive, from file sizes alone; a task takes the members
whose local headers begin in its range, in order of offset, and streams them as Arrow batches of bounded size. A member
that can't be read or fails its checksum is fetched again by its own offset, up to RETRIES times, without touching the
others; after that its row carries the error instead of the bytes. Stores are reached through pyarrow's file systems.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import warnings
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quillspark.scratch import Scratch, ship_code

ROLL, RANGE, READ_AHEAD = 64 << 20, 16 << 20, 4 << 20
BATCH_BYTES, BATCH_ROWS = 4 << 20, 512
RETRIES = 3
SCHEMA = "id long, note string, media binary, archive string, offset long, attempts int, error string"
_LOCAL = struct.Struct("<4s5H3L2H")


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    end: int

    def __init__(self, archive: str, start: int, end: int):
        super().__init__((archive, start, end))
        self.archive, self.start, self.end = archive, start, end


@dataclass
class Written(WriterCommitMessage):
    archives: list[str]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def member(store: fs.FileSystem, path: str, info: zipfile.ZipInfo, ahead: bytes = b"") -> bytes:
    """The member's bytes, from those read ahead or from its own offset; raises if they are not what was written."""
    if len(ahead) < _LOCAL.size + info.compress_size:
        with store.open_input_file(path) as f:
            f.seek(info.header_offset)
            head = f.read(_LOCAL.size)
            fields = _LOCAL.unpack(head)
            ahead = head + f.read(fields[9] + fields[10] + info.compress_size)
    fields = _LOCAL.unpack(ahead[: _LOCAL.size])
    if fields[0] != b"PK\x03\x04":
        raise OSError(f"no member at {info.header_offset}")
    low = _LOCAL.size + fields[9] + fields[10]
    raw = ahead[low : low + info.compress_size]
    data = zlib.decompress(raw, -15) if info.compress_type == zipfile.ZIP_DEFLATED else raw
    if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
        raise OSError(f"checksum at {info.header_offset}")
    return data


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, span: int, retries: int):
        self.path, self.span, self.retries = path, span, retries

    def partitions(self) -> list[Range]:
        store, base = _open(self.path)
        found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(".zip"))
        return [Range(p, low, min(n, low + self.span)) for p, n in files for low in range(0, n, self.span)] or [Range("", 0, 0)]

    def fetch(self, store: fs.FileSystem, path: str, info: zipfile.ZipInfo, ahead: bytes) -> tuple[bytes | None, int, str | None]:
        error = None
        for attempt in range(1, self.retries + 1):
            try:
                return member(store, path, info, ahead if attempt == 1 else b""), attempt, None
            except (OSError, zlib.error, struct.error) as e:
                error = f"{type(e).__name__}: {e}"
        return None, self.retries, error

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, _ = _open(self.path)
        rows: list[tuple] = []
        held = 0
        with store.open_input_file(partition.archive) as f:
            with zipfile.ZipFile(f) as directory:
                infos = sorted((i for i in directory.infolist() if partition.start <= i.header_offset < partition.end), key=lambda i: i.header_offset)
            block, at = b"", 0
            for info in infos:
                need = _LOCAL.size + len(info.filename.encode()) + len(info.extra) + 64 + info.compress_size
                if not at <= info.header_offset <= info.header_offset + need <= at + len(block):
                    at = info.header_offset
                    try:
                        f.seek(at)
                        block = f.read(max(need, READ_AHEAD))
                    except OSError:  # each member is then fetched for itself
                        block = b""
                data, attempts, error = self.fetch(store, partition.archive, info, block[info.header_offset - at :][:need])
                name = info.filename.rsplit("/", 1)[-1].split(".")[0].split("_")
                number = int(name[1]) if len(name) == 3 and name[1] != "null" else None
                rows.append((number, name[-1], data, partition.archive, info.header_offset, attempts, error))
                held += info.file_size
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.string()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in SCHEMA.split(", ")])


class ArchiveWriter(DataSourceArrowWriter):
    """Rows id, note, media, extension. Archives are written to a folder of the job's own and moved from there when it commits;
    what lost, repeated or speculative tasks have left goes with that folder, when the job commits or is given up."""

    def __init__(self, path: str):
        self.path, self.own = path, f".job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = _open(self.path)
        store.create_dir(f"{base}/{self.own}", recursive=True)
        done, archive, sink, nth = [], None, None, 0
        for batch in iterator:
            for number, note, media, extension in zip(*(batch.column(k).to_pylist() for k in ("id", "note", "media", "extension"))):
                if archive is None:
                    done.append(uuid.uuid4().hex)
                    sink = store.open_output_stream(f"{base}/{self.own}/{done[-1]}.part")
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                info = zipfile.ZipInfo(f"{nth}_{'null' if number is None else number}_{note}.{extension}")
                info.compress_type = zipfile.ZIP_DEFLATED
                archive.writestr(info, media, compresslevel=1)
                nth += 1
                if sink.tell() >= ROLL:
                    archive.close()
                    sink.close()
                    archive = None
        if archive is not None:
            archive.close()
            sink.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _open(self.path)
        for name in (x for m in messages if m for x in m.archives):
            store.move(f"{base}/{self.own}/{name}.part", f"{base}/{name}.zip")
        self.clear(store, base)

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(*_open(self.path))

    def clear(self, store: fs.FileSystem, base: str) -> None:
        try:
            store.delete_dir(f"{base}/{self.own}")
        except FileNotFoundError:  # a job without rows
            pass
        except OSError as e:
            warnings.warn(f"{base}/{self.own} stays: {e}", stacklevel=3)


class MediaArchive(DataSource):
    """Options: path (an archive directory's URI), rangeBytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rangeBytes", RANGE)), int(self.options.get("retries", RETRIES)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    ship_code(spark)
    spark.dataSource.register(MediaArchive)


UNIT, RATE = 192, 8000


def wav(samples: bytes) -> bytes:
    """8-bit mono PCM; the payload's length is a multiple of two, so no pad byte follows."""
    return b"RIFF" + struct.pack("<L", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<LHHLLHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<L", len(samples)) + samples


def samples(media: bytes) -> bytes:
    """The data chunk of a RIFF/WAVE file."""
    at = 12
    while at + 8 <= len(media):
        size = struct.unpack_from("<L", media, at + 4)[0]
        if media[at : at + 4] == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _as_audio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), 512):
            part = batch.slice(low, 512)
            raw = [(t or "").encode() for t in part.column(1).to_pylist()]
            media = [wav(b + b" " * (-len(b) % UNIT if b else UNIT)) for b in raw]
            yield pa.record_batch([part.column(0), pa.array([str(len(b)) for b in raw]), pa.array(media, pa.binary()), pa.array(["wav"] * len(raw))], ["id", "note", "media", "extension"])


def feature(payload: bytes) -> str:
    """Length, extremes, mean level and energy in thousandths, and crossings of the middle level: whole numbers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"frames={len(x)};low={x.min()};high={x.max()};mean={int(x.sum()) * 1000 // len(x)};energy={int((x * x).sum()) * 1000 // len(x)};crossings={crossings}"


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for number, note, media, error in zip(*(batch.column(k).to_pylist() for k in ("id", "note", "media", "error"))):
            if media is None:
                rows.append((number, int(note), None, None, None, None, None, None, error))
                continue
            p = samples(media)
            rows.append((number, int(note), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(p), error))
        kinds = {"long": pa.int64(), "string": pa.string()}
        fields = [c.split() for c in _DIGEST.split(", ")]
        columns = list(zip(*rows)) or [[] for _ in fields]
        yield pa.record_batch([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def text_media(documents: DataFrame) -> DataFrame:
    """Write every whole text as an 8-bit WAV member, read the archives back, and describe what was read.

    The payload is the text's UTF-8 (null: empty) and spaces up to a positive multiple of UNIT bytes. Null ids are carried;
    repeated rows are separate members with equal values; very long texts are one member each, held whole by the task that writes
    or reads it; an empty table gives no rows. Other columns are not read. The archives stay for the caller, who reads them lazily.
    error is null unless a member could not be read back; its other values are then null.
    """
    spark = documents.sparkSession
    register(spark)
    path = Scratch(spark, "media").path("archives")
    made = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_as_audio, "id long, note string, media binary, extension string")
    made.write.format("media_archive").option("path", path).mode("append").save()
    return spark.read.format("media_archive").option("path", path).load().select("id", "note", "media", "error").mapInArrow(_digests, _DIGEST)
