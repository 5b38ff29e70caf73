"""Columns over paths, labels and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffix of a stem that marks a derived file. Fixed value.
DERIVED = r"__(?:aug|erode|dilate)_[^/]*"
#: Extensions of image files for an audit, and for scoring (no gif). Fixed values.
AUDIT_EXTENSIONS = (".bmp", ".gif", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp")
SCORING_EXTENSIONS = (".bmp", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp")


def extensions(text: Column) -> Column:
    """The set of extensions in a comma-separated text: trimmed, lowered, with a leading dot; blanks dropped, sorted."""
    each = F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.transform(each, lambda x: F.when(F.substring(x, 1, 1) == ".", x).otherwise(F.concat(F.lit("."), x)))))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def hidden(relative: Column) -> Column:
    """Whether a part of a relative path starts with a dot."""
    return relative.rlike(r"(^|/)\.")


def relative_to(path: Column, root: str) -> Column:
    """The path below root; the path itself where it is not below it."""
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)


def label_at(relative: Column, level: int = 1) -> Column:
    """The name of the level-th folder above a file, null where the path is too shallow."""
    parts = F.split(relative, "/")
    return F.get(parts, F.size(parts) - 1 - F.lit(level))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def source_id(path: Column) -> Column:
    """Folder and stem, cut at the first derivation suffix: what a derived file was made from."""
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    return F.concat(folder, F.regexp_replace(stem(path), r"__(?:aug|erode|dilate)_.*$", ""))


def is_derived(path: Column) -> Column:
    return stem(path).rlike(DERIVED)


def escapes(path: Column) -> Column:
    """Whether a manifest path is absolute or climbs out of its root."""
    return F.startswith(path, F.lit("/")) | F.array_contains(F.split(path, "/"), "..")


def suffixes(path: Column) -> Column:
    """Every way to drop leading folders of a path, the whole path first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def resolution(width: Column, height: Column) -> Column:
    return F.concat_ws("x", width.cast("string"), height.cast("string"))


def writer_id(member: Column) -> Column:
    """The number after `P-`, else the stem."""
    return F.coalesce(F.nullif(F.regexp_extract(member, r"P-(\d+)", 1), F.lit("")), stem(member))


def drive_file_id(url: Column) -> Column:
    """The id in a URL path /file/d/<id>, null where there is none."""
    return F.nullif(F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"^/file/d/([^/]+)", 1), F.lit(""))


def https_host(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether a URL is https on one of the hosts."""
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("HOST")).isin(*hosts), F.lit(False))


def member_code(member: Column) -> Column:
    """The three-digit code of an archive member name, null where there is none."""
    return F.nullif(F.regexp_extract(member, r"-(\d{3})-[0-9A-F]{2}-", 1), F.lit(""))


def numeric_prefix(label: Column) -> Column:
    """The number before the first underscore of a label, for sorting."""
    return F.try_to_number(F.split(label, "_", 2)[0], F.lit("9999999999")).cast("int")


def parts(path: Column) -> Column:
    """The parts of a path as an array: ordered by it, a folder's files come before those of a folder whose name goes on with a sign below the slash."""
    return F.split(path, "/", -1)
