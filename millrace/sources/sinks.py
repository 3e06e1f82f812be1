"""Exports and configuration: CSV with a byte-order mark, JSON, XLSX and Parquet; validated config rows."""

from __future__ import annotations

import json
import os
import tempfile
import zipfile
from collections.abc import Sequence
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

XLSX_DROPPED = ("Occurrences", "Relevance Score", "Content Hash")
#: Exports that the driver writes as one file hold so many rows at most; larger ones go to Parquet.
FILE_ROWS = 1_000_000


def _rows(df: DataFrame) -> list[dict]:
    rows = df.limit(FILE_ROWS + 1).collect()
    if len(rows) > FILE_ROWS:
        raise ValueError(f"over {FILE_ROWS} rows: write Parquet instead")
    return [r.asDict() for r in rows]


def export(df: DataFrame, path: str, kind: str) -> None:
    """Write df as csv, json, xlsx (one file each, of a bounded size) or parquet (distributed)."""
    if kind == "parquet":
        df.write.mode("overwrite").parquet(path)
        return
    if kind not in ("csv", "json", "xlsx"):
        raise ValueError(f"unknown export format {kind!r}")
    rows, names = _rows(df), df.columns
    if kind == "csv":
        import csv

        with open(path, "w", encoding="utf-8-sig", newline="") as f:
            w = csv.DictWriter(f, names)
            w.writeheader()
            w.writerows(rows)
    elif kind == "json":
        with open(path, "w", encoding="utf-8") as f:
            json.dump(rows, f, ensure_ascii=False, indent=2, default=str)
    else:
        names = [n for n in names if n not in XLSX_DROPPED]
        write_xlsx(path, names, [[r[n] for n in names] for r in rows])


#: How texts are kept whole in CSV parts: every value is quoted, quotes are doubled, and values may hold line ends; null is an empty value without quotes.
_CSV = {"header": "true", "quoteAll": "true", "escape": '"', "multiLine": "true", "lineSep": "\n", "encoding": "UTF-8", "emptyValue": "", "nullValue": "\\N", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def export_parts(df: DataFrame, folder: str, kind: str) -> None:
    """Write any number of rows as csv, json (a line each) or parquet parts of a folder, each task its own."""
    if kind == "csv":
        df.write.options(**_CSV).csv(folder)
    elif kind == "json":
        df.write.option("ignoreNullFields", "false").json(folder)
    elif kind == "parquet":
        df.write.parquet(folder)
    else:
        raise ValueError(f"unknown export format {kind!r}")


def exported_parts(spark, folder: str, kind: str, schema) -> DataFrame:
    """Parts that export_parts has written."""
    reader = spark.read.schema(schema)
    return reader.options(**_CSV).csv(folder) if kind == "csv" else reader.json(folder) if kind == "json" else reader.parquet(folder)


def write_xlsx(path: str, names: Sequence[str], rows: Sequence[Sequence]) -> None:
    """A workbook of one sheet; column widths follow the longest cell, 12 to 50."""
    text = lambda v: "" if v is None else str(v)
    cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text(v))}</t></is></c>'
    widths = [min(50, max(12, max([len(n), *(len(text(r[i])) for r in rows)]) + 4)) for i, n in enumerate(names)]
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [names, *rows])
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Results" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><cols>{cols}</cols><sheetData>{body}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + data)


def write_config(path: str, value) -> None:
    """JSON written beside its place and moved there, so that readers see the old file or the new one."""
    folder = os.path.dirname(os.path.abspath(path))
    fd, tmp = tempfile.mkstemp(dir=folder, suffix=".tmp")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    os.replace(tmp, path)


def validated(new: DataFrame, existing: DataFrame, key: str, required: Sequence[str], pattern: str | None = None, order: str = "line") -> DataFrame:
    """New config rows with the reason each is skipped for, null where it is added.

    Reasons by priority: a required field is missing, the key is malformed, an earlier row of the
    batch has the key, the stored configuration has it.
    """
    missing = F.lit(False)
    for r in required:
        missing = missing | (F.coalesce(F.trim(F.col(r)), F.lit("")) == "")
    bad = ~F.col(key).rlike(pattern) if pattern else F.lit(False)
    seen = existing.select(F.col(key).alias("_k")).distinct()
    rows = new.join(seen, F.col(key) == F.col("_k"), "left").withColumn("_ok", ~missing & ~F.coalesce(bad, F.lit(True)))
    nth = F.row_number().over(Window.partitionBy(key, "_ok").orderBy(order))
    reason = F.when(missing, "missing field").when(bad, "invalid format").when(nth > 1, "duplicate in batch").when(F.col("_k").isNotNull(), "duplicate")
    return rows.withColumn("reason", reason).drop("_k", "_ok")


def summary(checked: DataFrame, first: int = 5) -> DataFrame:
    """added, skipped and the first errors, in order of their lines, of validated rows. Of the errors only the first are gathered."""
    bad = F.col("reason").isNotNull()
    least = checked.where(bad).select("line", F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.col("reason")).alias("text")).orderBy("line", "text").limit(first)
    errors = least.agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("errors"))
    counted = checked.agg(F.count_if(~bad).alias("added"), F.count_if(bad).alias("skipped"))
    return counted.crossJoin(F.broadcast(errors))  # one row each


def updated(config: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """config with the non-null columns of changes put into the rows of the same key."""
    new = changes.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key])
    rows = config.join(new, key, "left")
    return rows.select(*[F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in new.columns else F.col(c) for c in config.columns])


def removed(config: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    return config.join(keys.select(key).distinct(), key, "left_anti").select(config.columns)


def relabelled(groups: DataFrame, group: str, label: str) -> DataFrame:
    """groups (group, label) with a group's label set; a new group is added."""
    own = groups.sparkSession.createDataFrame([(group, label)], "group string, label string")
    return groups.where(F.col("group") != group).select("group", "label").unionByName(own)


NEWS_COLUMNS = "keyword string, title string, url string, source string, author string, published_date timestamp, scraped_date timestamp, language string, country string, summary string, content string, sentiment string, category string, image_url string, crawl_id string, status string, created_at timestamp, updated_at timestamp"


def ensure_table(spark, name: str, columns: str = NEWS_COLUMNS, partition: str = "category") -> None:
    """The sink's table if there is none. What indexes would serve is partitioned: readers prune by it."""
    space = name.rpartition(".")[0]
    if space:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {space}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING PARQUET PARTITIONED BY ({partition})")


def self_test(spark, folder: str) -> bool:
    """Whether a row written below a folder is read back as it was; the row is deleted again."""
    import uuid

    path, mark = f"{folder.rstrip('/')}/self-test-{uuid.uuid4().hex}", uuid.uuid4().hex
    spark.createDataFrame([(mark, 1)], "url string, n int").write.parquet(path)
    try:
        return [tuple(r) for r in spark.read.parquet(path).collect()] == [(mark, 1)]
    finally:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
