"""Members of ZIP archives as units of reading.

The directories of archives make a table of members, which filters prune by name before a
byte of their content is read; then members are dealt to tasks, which fetch each by its
byte range.  No archive is held whole anywhere.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = "path string, name string, header long, method int, packed long, size long, crc long"


class _Seekable(io.RawIOBase):
    """A file of pyarrow as one of Python's: a seek before the start is an OSError."""

    def __init__(self, file) -> None:
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + (0 if whence == io.SEEK_SET else self.file.tell() if whence == io.SEEK_CUR else self.file.size())
        if at < 0:
            raise OSError(f"seek to {at}")
        self.file.seek(min(at, self.file.size()))
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def open_uri(path: str):
    """A seekable file of the path, by pyarrow's file systems (local, HDFS, S3, GCS)."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme in ("s3a", "s3n"):
        path = f"s3:{rest}"
    elif scheme == "file":
        path = "file:///" + rest.lstrip("/")
    where, at = fs.FileSystem.from_uri(path)
    return io.BufferedReader(_Seekable(where.open_input_file(at)), 1 << 16)


def members(spark: SparkSession, path: str, opener: Callable = open_uri) -> DataFrame:
    """MEMBERS: a row for each file in the archives at ``path``, from their directories alone.

    ``opener`` gives a seekable file for a path.  Folders inside archives are left out;
    an encrypted member, or one that is neither stored nor deflated, fails the read; an archive without members gives no row.
    """
    archives = spark.read.format("binaryFile").load(path).select("path")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b["path"].to_pylist():
                with opener(p) as file, zipfile.ZipFile(file) as z:
                    files = [i for i in z.infolist() if not i.is_dir()]
                for i in files:
                    if i.flag_bits & 1 or i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                        raise ValueError(f"{p}: {i.filename} is encrypted or packed by an unknown method")
                rows = [(p, i.filename, i.header_offset, i.compress_type, i.compress_size, i.file_size, i.CRC) for i in files]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                names = ["path", "name", "header", "method", "packed", "size", "crc"]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=names)

    return archives.mapInArrow(listed, MEMBERS)


def member_bytes(file, name: str, header: int, method: int, packed: int, size: int, crc: int) -> bytes:
    """The content of one member, by its byte range; a length or checksum that differs from the directory's fails."""
    file.seek(header)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"{name}: no member where the directory says")
    file.seek(header + 30 + sum(struct.unpack_from("<HH", head, 26)))
    data = file.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        unpacked = zlib.decompressobj(-15)
        data = unpacked.decompress(data, size + 1)
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError(f"{name}: Bad CRC-32 or length")
    return data


def parsed(chosen: DataFrame, parse: Callable[[str, bytes], pa.RecordBatch], schema: str, tasks: int | None = None, opener: Callable = open_uri) -> DataFrame:
    """``parse(path, name, content)``, a batch of ``schema``, for each of the ``chosen`` rows of ``members``.

    Members are dealt over ``tasks`` (else as many as shuffles have) by hash of their place, and
    read one at a time.
    """
    of = [F.hash("path", "header")]
    dealt = chosen.repartition(tasks, *of) if tasks else chosen.repartition(*of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in sorted(b.to_pylist(), key=lambda r: (r["path"], r["header"])):
                with opener(r["path"]) as file:
                    content = member_bytes(file, *[r[c] for c in ("name", "header", "method", "packed", "size", "crc")])
                yield parse(r["path"], r["name"], content)

    return dealt.mapInArrow(run, schema)
