"""Columns over numbers, arrays, characters and hashes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def fingerprint(value: object) -> str:
    """The SHA-256 of a value's canonical JSON (sorted keys, default separators); for small driver-side values."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def short_hash(content: Column, n: int = 12) -> Column:
    return F.substring(sha256(content), 1, n)


def thai_code(ch: Column) -> Column:
    """The one-byte Thai code of a character: U+0E01 to U+0E3A and U+0E3F to U+0E5B, and ASCII as it is; else null."""
    point = F.ascii(ch)
    thai = point.between(0x0E01, 0x0E3A) | point.between(0x0E3F, 0x0E5B)
    return F.when(F.length(ch) != 1, None).when(thai, point - 3424).when(point < 128, point).cast("int")


def label_code(label: Column) -> Column:
    """The code of a class label: that of the character after its first underscore, or the number where it is one; null for anything else."""
    return F.when(label.rlike("^[0-9]+$"), label.try_cast("int")).otherwise(thai_code(F.regexp_extract(label, r"(?s)^[^_]*_(.*)$", 1)))


def marked(ch: Column) -> Column:
    """A combining mark with a dotted circle before it; anything else as it is."""
    return F.when(ch.rlike(r"^\p{M}"), F.concat(F.lit("◌"), ch)).otherwise(ch)


def identifier(text: Column) -> Column:
    return text.rlike("^[A-Za-z0-9_-]+$")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def outcome(truth: Column, predicted: Column) -> Column:
    """unknown without truth, else correct or wrong."""
    return F.when(truth.isNull(), "unknown").when(truth == predicted, "correct").otherwise("wrong")


def status(confidence: Column, threshold: float, error: Column | None = None) -> Column:
    """ERROR with an error, LOW_CONFIDENCE below the threshold, else OK."""
    low = F.when(confidence < threshold, "LOW_CONFIDENCE").otherwise("OK")
    return low if error is None else F.when(error.isNotNull(), "ERROR").otherwise(low)


def display_label(raw: Column, names: Column) -> Column:
    """`name [raw]` by a map of names, the raw label where it has none."""
    return F.concat(F.coalesce(F.try_element_at(names, raw), raw), F.lit(" ["), raw, F.lit("]"))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def percent(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it several times or within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, stable for large ones; each step is computed once a row."""
    grown = lambda z: let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))
    shares = lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total))
    return let(let(logits, grown), shares)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def expand_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, margin: float) -> Column:
    """struct<x1,y1,x2,y2> of a box grown by margin x its size on each side, to whole pixels within the image; null if it has no area."""
    if not 0 <= margin <= 1:
        raise ValueError("margin must be from 0 to 1")
    dx, dy = (x2 - x1) * margin, (y2 - y1) * margin
    a, b = F.greatest(F.lit(0), F.floor(x1 - dx)), F.greatest(F.lit(0), F.floor(y1 - dy))
    c, d = F.least(width, F.ceil(x2 + dx)), F.least(height, F.ceil(y2 + dy))
    return F.when((c > a) & (d > b), F.struct(a.cast("long").alias("x1"), b.cast("long").alias("y1"), c.cast("long").alias("x2"), d.cast("long").alias("y2")))


def grid_cell(i: Column, columns: int = 8) -> Column:
    """struct<row,col> of the i-th cell, from 0."""
    return F.struct(F.floor(i / columns).cast("int").alias("row"), (i % columns).cast("int").alias("col"))


def corners(text: Column) -> Column:
    """Four points of 'x,y x,y x,y x,y', null for anything else."""
    points = F.transform(F.split(F.trim(text), r"\s+"), lambda p: F.transform(F.split(p, ","), lambda v: v.try_cast("double")))
    good = (F.size(points) == 4) & F.forall(points, lambda p: (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull()))
    return F.when(good, F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def conv_size(n: Column, kernel: int, stride: int = 1, padding: int = 0) -> Column:
    return (F.floor((n + 2 * padding - kernel) / stride) + 1).cast("long")


def bin_of(x: Column, bins: int = 4) -> Column:
    """The bin of a value from 0 to 1, the right edge in the last one; null outside."""
    return F.when((x >= 0) & (x <= 1), F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int"))


def model_name(name: Column, tag: Column) -> Column:
    return F.concat_ws(".", name, F.nullif(tag, F.lit("")))


def ms_per_item(seconds: Column, items: Column) -> Column:
    return F.try_divide(seconds * 1000, items)
