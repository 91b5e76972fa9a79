"""Archives of members in a folder that all machines reach: a Spark data source to write and to read them.

Writing: each task writes archives of its own under names that no other attempt uses; when all tasks have succeeded, the
driver writes one list of the files of the attempts that count. What no list names is not there for readers, so lost and
repeated attempts leave nothing among the results. A folder without lists (archives from elsewhere) is read whole.

An archive is a ZIP file of stored members, so its directory has each member's offset, size and CRC-32. Reading: the
driver knows files and sizes alone and plans byte ranges over them; small archives share a task, up to a range's bytes.
The task of a range reads the archive's directory, takes the members whose offset is in its range, and streams their bytes
in Arrow batches of bounded size. A directory or member that can't be read or fails its check is read again, a member by
its offset, from a file opened anew, with no effect on the others; after the last try the read fails, or with
onError=report yields the member's name and error with null bytes.
"""

from __future__ import annotations

import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: The name of a list of files that a commit has written; a line has a size and a name.
LIST = "_files-"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class Shards:
    """Files of one task, each closed at about so many bytes; files: (name, size) of those that are done."""

    def __init__(self, uri: str, suffix: str, most: int):
        self.fs, self.folder = open_folder(uri)
        self.suffix, self.most = suffix, most
        self.files: list[tuple[str, int]] = []
        self.out = self.name = None
        self.fs.create_dir(self.folder, recursive=True)

    def stream(self):
        """The open file; a new one if the last is full."""
        if self.out is None or self.out.tell() >= self.most:
            self.close()
            self.name = f"{uuid.uuid4().hex}{self.suffix}"
            self.out = self.opened(self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None))
        return self.out

    def opened(self, stream):
        return stream

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.append((self.name, self.fs.get_file_info(f"{self.folder}/{self.name}").size))
        self.out = None


class _ZipStream:
    def __init__(self, stream):
        self.raw = stream
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)

    def tell(self) -> int:
        return self.raw.tell()

    def close(self) -> None:
        self.zip.close()
        self.raw.close()


class ZipShards(Shards):
    def opened(self, stream):
        return _ZipStream(stream)


def commit(uri: str, messages: list[Written | None]) -> None:
    """One list of all files, whatever their number; it appears whole, under its last name."""
    files, folder = open_folder(uri)
    files.create_dir(folder, recursive=True)
    name = f"{LIST}{uuid.uuid4().hex}"
    with files.open_output_stream(f"{folder}/.{name}", compression=None) as out:
        for m in messages:
            out.write("".join(f"{size} {f}\n" for f, size in (m.files if m else ())).encode())
    files.move(f"{folder}/.{name}", f"{folder}/{name}")


def abort(uri: str, messages: list[Written | None]) -> None:
    files, folder = open_folder(uri)
    for m in messages:
        for name, _ in m.files if m else ():
            files.delete_file(f"{folder}/{name}")


def listing(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of a folder's archives, by name; a folder that isn't there has none."""
    files, folder = open_folder(uri)
    found = [f for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File]
    lists = [f.path for f in found if f.base_name.startswith(LIST)]
    if not lists:
        return sorted((f.path, f.size) for f in found if f.path.endswith(suffix))
    out = []
    for path in lists:
        with files.open_input_stream(path, compression=None) as told:
            out += [(f"{folder}/{name}", int(size)) for size, _, name in (line.partition(" ") for line in told.read().decode().splitlines()) if name.endswith(suffix)]
    return sorted(out)


@dataclass
class Ranges(InputPartition):
    """(path, start, end) of what one task reads."""

    parts: list[tuple[str, int, int]]


def planned(archives: list[tuple[str, int]], most: int, split: bool = True) -> list[Ranges]:
    """Tasks of about so many bytes: ranges of large archives if they can be split, several small ones together."""
    out, size = [Ranges([])], 0
    for path, n in archives:
        for start in range(0, n, most) if split else (0,):
            end = min(start + most, n) if split else n
            if size and size + end - start > most:
                out.append(Ranges([]))
                size = 0
            out[-1].parts.append((path, start, end))
            size += end - start
    return out


class MemberWriter(DataSourceArrowWriter):
    """Rows (name string, bytes binary) become members."""

    def __init__(self, options: dict[str, str]):
        self.uri, self.most = options["path"], int(options.get("shardbytes", 128 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        shards = ZipShards(self.uri, ".zip", self.most)
        for batch in iterator:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                shards.stream().zip.writestr(zipfile.ZipInfo(name.as_py()), data.as_py())
        shards.close()
        return Written(shards.files)

    def commit(self, messages: list[Written | None]) -> None:
        commit(self.uri, messages)

    def abort(self, messages: list[Written | None]) -> None:
        abort(self.uri, messages)


class MemberReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]
        self.range, self.batch = int(options.get("rangebytes", 16 << 20)), int(options.get("batchbytes", 4 << 20))
        self.tries, self.report = int(options.get("tries", 3)), options.get("onerror", "fail") == "report"

    def partitions(self) -> list[Ranges]:
        return planned(listing(self.uri, ".zip"), self.range)

    def open(self, path: str):
        return open_folder(self.uri)[0].open_input_file(path)

    def member(self, path: str, file, info: zipfile.ZipInfo) -> tuple[object, bytes | None, str | None]:
        """(open file, bytes, error) of one member, read by its offset."""
        for k in range(self.tries):
            try:
                file = file or self.open(path)
                file.seek(info.header_offset)
                head = file.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise OSError("no member at its offset")
                a, b = struct.unpack("<HH", head[26:30])
                file.seek(info.header_offset + 30 + a + b)
                data = file.read(info.compress_size)
                if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
                    raise OSError("check failed")
                return file, data, None
            except OSError as e:
                error, file = e, None
                time.sleep(0.05 * 2**k)
        if not self.report:
            raise OSError(f"{info.filename} in {path}, at {info.header_offset}: {error}")
        return None, None, str(error)

    def directory(self, path: str) -> list[zipfile.ZipInfo]:
        for k in range(self.tries):
            try:
                with self.open(path) as file, zipfile.ZipFile(file) as z:
                    return z.infolist()
            except (OSError, zipfile.BadZipFile) as e:
                error = e
                time.sleep(0.05 * 2**k)
        raise OSError(f"directory of {path}: {error}")

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, start, end in partition.parts:
            members = [i for i in self.directory(path) if start <= i.header_offset < end]
            file, rows, size = None, [], 0
            for info in sorted(members, key=lambda i: i.header_offset):
                file, data, error = self.member(path, file, info)
                rows.append((info.filename, info.header_offset, data, error))
                size += len(data or b"")
                if size >= self.batch:
                    yield self.arrow(path, rows)
                    rows, size = [], 0
            if rows:
                yield self.arrow(path, rows)

    @staticmethod
    def arrow(path: str, rows: list[tuple]) -> pa.RecordBatch:
        names, offsets, data, errors = zip(*rows, strict=True)
        columns = [pa.array([path] * len(rows)), pa.array(names), pa.array(offsets, pa.int64()), pa.array(data, pa.binary()), pa.array(errors, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["archive", "name", "offset", "bytes", "error"])


class MemberArchives(DataSource):
    """format("member_archives"); path: the folder. Write (name, bytes); read archive, name, offset, bytes, error."""

    @classmethod
    def name(cls) -> str:
        return "member_archives"

    def schema(self) -> str:
        return "archive string, name string, offset long, bytes binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return MemberReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return MemberWriter(dict(self.options))


def in_memory(names_and_bytes: list[tuple[str, bytes]]) -> bytes:
    """A small archive, for tests."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in names_and_bytes:
            z.writestr(zipfile.ZipInfo(n), b)
    return out.getvalue()
