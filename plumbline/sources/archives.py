"""ZIP archives as a data source: the directory is read when the scan is planned, members when and where they are needed."""

from __future__ import annotations

import hashlib
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of packed members that a task reads, and bytes that are unpacked at a time.
PART_BYTES, STEP = 64 << 20, 1 << 20
SCHEMA = "archive string, member string, size long, sha256 string, error string"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and place of a path or URI as Spark gives it; blanks and other signs may stand in it as they are."""
    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), re.sub(r"^file:(//)?", "", path)
    scheme, rest = path.split(":", 1)
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@?&=%')}")


@dataclass
class Members(InputPartition):
    """Members of one archive: (name, place of the header, packed size, size, CRC, method, encrypted); or why it has none."""

    archive: str
    members: list[tuple[str, int, int, int, int, int, bool]]
    error: str | None = None


def planned(archive: str, part_bytes: int) -> list[Members]:
    """An archive's members in parts of some size, from its directory alone."""
    system, where = located(archive)
    try:
        with system.open_input_file(where) as raw, zipfile.ZipFile(raw) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
    except (zipfile.BadZipFile, OSError, ValueError, EOFError) as e:
        return [Members(archive, [], f"{type(e).__name__}: {e}")]
    parts, held = [Members(archive, [])], 0
    for i in infos:
        if held >= part_bytes:
            parts.append(Members(archive, []))
            held = 0
        parts[-1].members.append((i.filename, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type, bool(i.flag_bits & 1)))
        held += i.compress_size
    return [p for p in parts if p.members]


def unpacked(raw, at: int, packed: int, method: int) -> Iterator[bytes]:
    """The content of a member step by step, from the place of its header."""
    raw.seek(at)
    header = raw.read(30)
    if len(header) < 30 or header[:4] != b"PK\x03\x04":
        raise ValueError("no header where the directory says")
    raw.seek(at + 30 + sum(struct.unpack("<HH", header[26:30])))
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"compression method {method} is not known")
    inflate = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None
    while packed > 0:
        data = raw.read(min(STEP, packed))
        if not data:
            raise ValueError("the archive ends within the member")
        packed -= len(data)
        while data:
            yield inflate.decompress(data, STEP) if inflate else data
            data = inflate.unconsumed_tail if inflate else b""
    if inflate:
        yield inflate.flush()


def escapes(name: str) -> bool:
    """Whether a member's name leads out of the folder that it would be unpacked to."""
    name = name.replace("\\", "/")
    return name.startswith("/") or re.match("[A-Za-z]:", name) is not None or posixpath.normpath(name).split("/")[0] == ".."


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.part_bytes = options["path"], int(options.get("partbytes", PART_BYTES))

    def partitions(self) -> list[InputPartition]:
        system, where = located(self.root)
        info = system.get_file_info(where)
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"{self.root} does not exist")
        found = [where] if info.type == fs.FileType.File else [f.path for f in system.get_file_info(fs.FileSelector(where, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(".zip")]
        prefix = self.root[: len(self.root) - len(where)] if self.root.endswith(where) else ""
        return [part for path in sorted(found) for part in planned(prefix + path, self.part_bytes)] or [Members("", [])]

    def read(self, partition: Members) -> Iterator[tuple]:
        if partition.error is not None:
            yield partition.archive, None, None, None, partition.error
        if not partition.members:
            return
        system, where = located(partition.archive)
        with system.open_input_file(where) as raw:
            for name, at, packed, size, crc, method, locked in partition.members:
                digest, sum_, n, error = hashlib.sha256(), 0, 0, None
                try:
                    if escapes(name):
                        raise ValueError("the name leads out of the archive")
                    if locked:
                        raise ValueError("the member is encrypted")
                    for data in unpacked(raw, at, packed, method):
                        digest.update(data)
                        sum_, n = zlib.crc32(data, sum_), n + len(data)
                    if (n, sum_) != (size, crc):
                        raise ValueError("the content is not what the directory says")
                except (ValueError, zlib.error) as e:
                    error = str(e)
                yield partition.archive, name, size, None if error else digest.hexdigest(), error


class ZipMembers(DataSource):
    """spark.read.format("zip_members").load(folder or archive), with option partBytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def zip_members(spark: SparkSession, root: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(archive, member, size, sha256, error) of the files in every ZIP below root, or in the one ZIP that root names.

    Planning reads the directories only; the members of one archive are read by several tasks, each by the
    places that the directory gives, and nothing is unpacked to a disk or held as a whole. An archive that can't be read is a
    row without a member, a member that can't be read (broken, encrypted, of an unknown method, named so that it
    leads out of the archive) a row with its error. A root that isn't there is an error.
    """
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").option("partBytes", part_bytes).load(root)
