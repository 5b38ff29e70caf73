"""File trees, images, archives, manifests, receipts and settings as tables."""

from __future__ import annotations

import json
import os
import posixpath
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import paths
from plumbline.runtime import exists
from plumbline.sources import archives

MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("path", "label", "sha256", "source_id")])
PREDICTIONS = T.StructType([T.StructField(c, T.StringType()) for c in ("path", "true_label", "predicted_label")] + [T.StructField("confidence", T.DoubleType())])


def _plain(path, root: str):
    """A path below root, from the URI that Spark's readers give."""
    base = root.rstrip("/")
    return paths.relative_to(F.regexp_replace(path, r"^[a-z0-9]+:(//[^/]*)?(?=/)", ""), re.sub(r"^[a-z0-9]+:(//[^/]*)?(?=/)", "", base))


def origin(image: str = "image"):
    """The path of a row of Spark's image source, which gives it URL-encoded."""
    return F.url_decode(F.replace(F.col(f"{image}.origin"), F.lit("+"), F.lit("%2B")))


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = paths.AUDIT_EXTENSIONS, content: bool = True, start: bool = False) -> DataFrame:
    """(path, length, sha256), and with `start` the first twelve bytes in hex, of the files below root with one of the extensions, in any case; paths with a part that starts with a dot are left out.

    Order by T11's split(path, '/') for path order. Without `content` no file is opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.withColumn("path", _plain(F.col("path"), root)).where(paths.extension(F.col("path")).isin(*extensions) & ~paths.hidden(F.col("path")))
    begin = [F.hex(F.substring("content", 1, 12)).alias("start")] if start else []
    return files.select("path", "length", *([F.sha2("content", 256).alias("sha256")] if content else []), *begin)


def discover(spark: SparkSession, path: str, extensions: tuple[str, ...] = paths.SCORING_EXTENSIONS) -> DataFrame:
    """(path, length) of a tree's files with one of the extensions, by lowered path, or of the one file that path names; an error if nothing is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        raise ValueError(f"{path} does not exist")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(_plain(F.col("path"), "/").alias("path"), "length")
    files = files.withColumn("path", F.concat(F.lit("/"), "path"))
    return files if system.getFileStatus(where).isFile() else files.where(paths.extension(F.col("path")).isin(*extensions)).orderBy(F.lower("path"), "path")


def images(spark: SparkSession, root: str, level: int = 1) -> DataFrame:
    """(path, label, width, height, channels, sha256, error) of every image file below root.

    A file without a label folder is a label error and is not decoded further; one that Spark's decoder can't read
    is `unsupported` if it starts like a WebP file, else `corrupt`.
    """
    decoded = spark.read.format("image").option("recursiveFileLookup", "true").load(root)
    decoded = decoded.select(_plain(origin(), root).alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"))
    found = scan(spark, root, start=True).withColumn("label", paths.label_at(F.col("path"), level))
    j = found.join(decoded, "path", "left")
    webp = F.col("start").rlike("^52494646.{8}57454250")
    unread = F.coalesce("width", F.lit(-1)) < 0
    error = F.when(F.col("label").isNull(), "no label folder").when(unread & webp, "unsupported").when(unread, "corrupt")
    return j.select("path", "label", "width", "height", "channels", "sha256", error.alias("error"))


def unpack(archive: str, target: str) -> str:
    """target with the content of a ZIP, unpacked once. Members that leave the target are an error."""
    if not zipfile.is_zipfile(archive):
        raise ValueError(f"{archive} is no ZIP archive")
    done = os.path.join(target, ".unpacked")
    if not os.path.exists(done):
        with zipfile.ZipFile(archive) as z:
            root = os.path.realpath(target)
            for name in z.namelist():
                where = os.path.realpath(os.path.join(target, name))
                if where != root and not where.startswith(root + os.sep):
                    raise ValueError(f"{name} leaves the target folder")
            z.extractall(target)
        Path(done).touch()
    return target


def _has_images(folder: Path, extensions: tuple[str, ...]) -> bool:
    for where, folders, names in os.walk(folder):
        folders[:] = [x for x in folders if not x.startswith(".")]
        if any(Path(x).suffix.lower() in extensions and not x.startswith(".") for x in names):
            return True
    return False


def image_root(path: str, work: str, extensions: tuple[str, ...] = paths.AUDIT_EXTENSIONS) -> str:
    """The folder that holds the label folders of images.

    path may be a folder with images, which is taken as it is, even if a ZIP lies there too; a ZIP; a folder with one
    ZIP and no image (several are an error); or a missing folder beside which a ZIP of its name lies. What is in a ZIP
    is unpacked below work. A single folder that wraps all images is entered.
    """
    folder = Path(path)
    if folder.is_file():
        folder = Path(unpack(path, os.path.join(work, folder.stem)))
    elif not folder.is_dir():
        beside = [x for x in folder.parent.glob("*") if x.stem == folder.name and x.suffix.lower() == ".zip"] if folder.parent.is_dir() else []
        if len(beside) != 1:
            raise ValueError(f"{path} does not exist")
        folder = Path(unpack(str(beside[0]), os.path.join(work, folder.name)))
    elif not _has_images(folder, extensions):
        zips = [x for x in folder.iterdir() if x.is_file() and x.suffix.lower() == ".zip"]
        if len(zips) > 1:
            raise ValueError(f"{path} holds {len(zips)} archives")
        if zips:
            folder = Path(unpack(str(zips[0]), os.path.join(work, zips[0].stem)))
    loose = any(x.is_file() and x.suffix.lower() in extensions for x in folder.iterdir())
    inner = [x for x in folder.iterdir() if x.is_dir() and not x.name.startswith(".") and _has_images(x, extensions)]
    return str(inner[0] if len(inner) == 1 and not loose else folder)


def archive_members(spark: SparkSession, root: str) -> DataFrame:
    """(archive, member, size, error, code) of the files in every ZIP and TAR below root; code is the three-digit code in a name.

    Archives are opened where they are by the executors, which read a ZIP's directory, or pass through a TAR, without
    holding the archive; archives.zip_members() reads the content of members too. An archive that can't be read is a row with an
    error and no member; a file without any bytes has no row, as Spark's reader passes over it.
    """

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                system, where = archives.located(path)
                try:
                    with system.open_input_file(where) as raw:
                        if path.lower().endswith(".zip"):
                            rows = [(path, i.filename, i.file_size, None) for i in zipfile.ZipFile(raw).infolist() if not i.is_dir()]
                        else:
                            with tarfile.open(fileobj=raw) as t:
                                rows = [(path, m.name, m.size, None) for m in t if m.isfile()]
                except (zipfile.BadZipFile, tarfile.TarError, OSError, ValueError, EOFError) as e:
                    rows = [(path, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["archive", "member", "size", "error"]).astype({"size": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.lower("path").rlike(r"\.(zip|tar|tgz|tar\.gz)$"))
    return files.select("path").mapInPandas(listing, "archive string, member string, size long, error string").withColumn("code", paths.member_code(F.col("member")))


def csv_manifest(spark: SparkSession, path: str, schema: T.StructType = MANIFEST) -> DataFrame:
    """A CSV with a header by an explicit schema, so that labels such as 001 stay strings; a missing column is an error.

    Empty fields are empty strings, as in a reader that has no notion of null.
    """
    header = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    if missing := [f.name for f in schema if f.name not in header]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    raw = spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    text = lambda f: F.coalesce(f.name, F.lit("")) if isinstance(f.dataType, T.StringType) else F.col(f.name).try_cast(f.dataType)
    return raw.select(*[text(f).alias(f.name) for f in schema])


def json_document(path: str) -> dict:
    """A small JSON object; a missing file, invalid JSON and anything but an object are errors that name the path."""
    try:
        value = json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        raise ValueError(f"{path} does not exist") from None
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} is not valid JSON: {e}") from e
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no JSON object")
    return value


def label_map(path: str) -> dict[str, int]:
    """A label index from JSON: values 0 to n - 1, each once."""
    value = json_document(path)
    if sorted(value.values(), key=str) != sorted(range(len(value)), key=str):
        raise ValueError(f"{path}: indices must run from 0 without gaps")
    return value


def receipts(spark: SparkSession, pattern: str, schema: T.StructType | str) -> DataFrame:
    """The JSON documents of a glob, one row each, with `file`, ordered by it."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("file", F.input_file_name()).orderBy("file")


def page_crops(pages: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """A row for each crop of page records (source_page, writer_id, capture_id, crops array<struct<path,label,row,column>>),
    with the hash of its file where files (path, sha256) has it."""
    crops = pages.select("source_page", "writer_id", "capture_id", F.explode("crops").alias("c")).select("c.*", "source_page", "writer_id", "capture_id")
    return crops if files is None else crops.join(files.select("path", "sha256"), "path", "left")


def row_range(rows: DataFrame, first: int, last: int, without: list[int] | None = None, text: str | None = None, key: str = "row_id") -> DataFrame:
    """Rows with ids from first to last but for a list, whose text, if one is given, is the one expected; another text is an error."""
    out = rows.where(F.col(key).between(first, last) & ~F.col(key).isin(*(without or [-1])))
    if text is not None and (bad := out.where(~F.col("text").eqNullSafe(F.lit(text))).first()):
        raise ValueError(f"row {bad[key]} has another text")
    return out


def seen_hashes(spark: SparkSession, path: str | None) -> DataFrame:
    """The distinct hashes of a training manifest, none where there is no manifest."""
    if path is None or not exists(spark, path):
        return spark.createDataFrame([], "sha256 string")
    return csv_manifest(spark, path).select("sha256").where("sha256 <> ''").distinct()


def setting(name: str, default: str | None = None, env_file: str = ".env") -> str | None:
    """A setting from the environment, else from KEY=VALUE lines of a file (# comments, quotes taken off), else the default."""
    if os.environ.get(name):
        return os.environ[name]
    if os.path.exists(env_file):
        for line in Path(env_file).read_text(encoding="utf-8").splitlines():
            key, eq, value = line.partition("=")
            if eq and not key.lstrip().startswith("#") and key.strip() == name:
                return value.strip().strip("\"'")
    return default


def png(width: int, height: int, rgb: tuple[int, int, int] | bytes) -> bytes:
    """A PNG of one colour or of raw RGB rows."""
    rows = rgb if isinstance(rgb, bytes) else bytes(rgb) * (width * height)
    raw = b"".join(b"\0" + rows[i * width * 3 : (i + 1) * width * 3] for i in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def sample_tree(root: str, labels: int = 3, each: int = 10, size: int = 32) -> None:
    """A tree of small PNGs, `each` for each label, all different."""
    for label in range(labels):
        os.makedirs(posixpath.join(root, str(label)), exist_ok=True)
        for i in range(each):
            Path(root, str(label), f"{i}.png").write_bytes(png(size, size, (80 * label + 10, 20 * i % 256, (7 * i + label) % 256)))
