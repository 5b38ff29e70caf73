"""Writers of tables, documents and reports."""

from __future__ import annotations

import base64
import hashlib
import html
import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import audit, sequence
from plumbline.runtime import exists, read_text, write_text


def write_csv(df: DataFrame, path: str, *columns: str, single: bool = False) -> None:
    """The columns, in that order, as CSV with a header; columns beyond them are left out. `single` is for small tables."""
    out = df.select(*(columns or df.columns))
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(value: object, path: str) -> None:
    """A small document, indented, written beside and put in place at once, on whatever storage the path names."""
    write_text(SparkSession.active(), path, json.dumps(value, ensure_ascii=False, indent=2))


def write_audit(tables: dict[str, DataFrame], report: dict, folder: str) -> None:
    """The tables of an audit as CSV folders, of as many files as they have parts, and its report as JSON."""
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}.csv")
    write_json(report, f"{folder}/audit_report.json")


def audit_to(scan: DataFrame, folder: str) -> dict:
    """The report of audit.summary() of a scan (path, label, width, sha256, ...), with its tables written to folder.

    The scan, which may open and decode every file, is read once: its rows are written and their totals observed on the
    way; counts of classes and equal contents come from the rows written. The folder gets scan.parquet, the CSV tables
    class_counts, exact_duplicate_groups, corrupt_images and label_errors, and audit_report.json.
    """
    lost, corrupt, valid = audit.states()
    seen = Observation("audit")
    totals = [F.count("*").alias("discovered")] + [F.count_if(c).alias(name) for name, c in (("valid", valid), ("corrupt", corrupt), ("label_errors", lost))]
    scan.observe(seen, *totals).write.mode("overwrite").parquet(f"{folder}/scan.parquet")
    kept = scan.sparkSession.read.parquet(f"{folder}/scan.parquet")
    sound = kept.where(valid)
    groups = audit.duplicate_groups(sound).select("duplicate_groups", "duplicate_members").first().asDict()
    sizes = audit.imbalance(sound).first()
    report = {**{k: seen.get[k] for k in ("discovered", "valid", "corrupt", "label_errors")}, "classes": sound.select("label").distinct().count(), "minimum": sizes["minimum"], "maximum": sizes["maximum"], **groups, "imbalance": sizes["ratio"]}
    write_audit({"class_counts": audit.class_counts(sound), "exact_duplicate_groups": audit.duplicate_members(sound), "corrupt_images": kept.where(corrupt).select("path"), "label_errors": kept.where(lost).select("path")}, report, folder)
    return report


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """A folder for each sheet; each is bounded by what a workbook held."""
    for name, df in sheets.items():
        write_csv(df, f"{folder}/{name}", single=True)


def freeze_copy(source: str, target: str) -> str:
    """The SHA-256 of a small document copied to target, on whatever storage either is; a target with other content is an
    error, the same content is left alone."""
    spark = SparkSession.active()
    text = read_text(spark, source)
    if not exists(spark, target):
        write_text(spark, target, text)
    elif read_text(spark, target) != text:
        raise ValueError(f"{target} is frozen and differs")
    return hashlib.sha256(text.encode()).hexdigest()


def contact_sheet(rows: DataFrame, *order: str, across: int = 10) -> DataFrame:
    """rows with sheet_row and sheet_col, `across` to a row, in an order that must tell all rows apart."""
    rows = sequence.numbered(rows, *order, name="__i")
    return rows.withColumns({"sheet_row": F.expr(f"__i div {across}").cast("int"), "sheet_col": (F.col("__i") % across).cast("int")}).drop("__i")


def append_status(df: DataFrame, path: str) -> None:
    """Rows added to a table of statuses; runs.last_status() reads the last of each run."""
    df.write.mode("append").parquet(path)


def experiment_notes(runs: DataFrame, path: str, *columns: str, notes: tuple[str, ...] = ("observation", "decision")) -> bool:
    """The columns of runs with empty ones for notes, written once; False if they are there, so that notes are never lost."""
    if exists(runs.sparkSession, path):
        return False
    write_csv(runs.select(*columns, *[F.lit("").alias(c) for c in notes]), path, *columns, *notes, single=True)
    return True


def html_report(title: str, sections: dict[str, DataFrame], path: str, image: str | None = None, rows: int = 200) -> None:
    """A page of tables, `rows` of each at most, as a report shows; an image column (bytes) becomes a picture in the page."""
    out = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in sections.items():
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr>")
        for r in df.limit(rows).collect():
            cell = lambda c, v: f"<img src='data:image/png;base64,{base64.b64encode(v).decode()}'>" if c == image and v is not None else html.escape("" if v is None else str(v))
            out.append(f"<tr>{''.join(f'<td>{cell(c, r[c])}</td>' for c in df.columns)}</tr>")
        out.append("</table>")
    write_text(SparkSession.active(), path, "\n".join(out))
