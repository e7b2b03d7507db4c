"""Papers from files: listing, ordered decoding of text, tables as lines, workbooks; rules from JSON; logs as appended tables."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("txt", "csv", "tsv", "xlsx", "pdf", "png", "jpg", "jpeg")
ENCODINGS = ("utf-8-sig", "utf-8", "cp950", "big5")
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RULES = "rule_id string, scope string, enabled boolean, applies_when map<string,array<string>>, priority int, description string, calculation string, warning_level string"


def suffix() -> Column:
    return F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))


def scan(spark: SparkSession, folder: str, recursive: bool = True, content: bool = True) -> DataFrame:
    """path, name, suffix, mtime, size and content of the files of known kinds; lock files (~$...) are left out, and of paths that differ by case alone the first stays."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    named = files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), suffix().alias("suffix"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), *(["content"] if content else []))
    kept = named.filter(F.col("suffix").isin(*SUFFIXES) & ~F.startswith(F.col("name"), F.lit("~$")))
    firsts = kept.groupBy(F.lower("path").alias("low")).agg(F.min("path").alias("path"))
    return kept.join(firsts.select("path"), "path", "left_semi")


def decode(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "ignore")


def table_lines(text: str, delimiter: str) -> str:
    return "\n".join(" | ".join(cell.strip() for cell in row) for row in csv.reader(io.StringIO(text), delimiter=delimiter))


def workbook_lines(data: bytes) -> list[str]:
    """The text of each sheet, in the order of their file names; rows with a value, cells joined."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        sheets = []
        for name in sorted(n for n in names if n.startswith("xl/worksheets/sheet") and n.endswith(".xml")):
            rows = []
            for row in ElementTree.fromstring(z.read(name)).iter(f"{MAIN}row"):
                cells = []
                for c in row.iter(f"{MAIN}c"):
                    v = c.find(f"{MAIN}v")
                    text = "".join(t.text or "" for t in c.iter(f"{MAIN}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                    cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
                if any(x.strip() for x in cells):
                    rows.append(" | ".join(x.strip() for x in cells))
            sheets.append("\n".join(rows))
        return sheets


def pages(files: DataFrame) -> DataFrame:
    """path, page_no, text, needs_manual, error: the pages of each file. A file that can't be read gives a page for manual review, with the reason; no file is lost."""

    def read(kind: str, data: bytes) -> list[str]:
        if kind == "xlsx":
            return workbook_lines(data)
        if kind in ("csv", "tsv"):
            return [table_lines(decode(data), "," if kind == "csv" else "\t")]
        if kind == "txt":
            return [decode(data)]
        raise ValueError(f"no reader for {kind} files here")

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, kind, data in zip(p["path"], p["suffix"], p["content"]):
                try:
                    rows += [(path, i + 1, t, not t.strip(), "") for i, t in enumerate(read(kind, bytes(data)))]
                except Exception as e:  # noqa: BLE001  the reason goes with the page
                    rows.append((path, 1, "", True, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "needs_manual", "error"])

    return files.select("path", "suffix", "content").mapInPandas(task, "path string, page_no int, text string, needs_manual boolean, error string")


def rules(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rules of the files, in their order (load_ord); without an id they are left out; priority 100 and scope global are the defaults."""
    raw = spark.read.schema(RULES).option("multiLine", True).json(paths).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    order = F.element_at(F.create_map(*(x for i, p in enumerate(paths) for x in (F.lit(p.rsplit("/", 1)[-1]), F.lit(i)))), F.regexp_extract(F.col("_at.file_path"), r"([^/]*)$", 1))
    kept = raw.filter("trim(coalesce(rule_id, '')) <> ''").withColumn("load_ord", order.cast("long") * (1 << 40) + F.col("_at").getField("col2"))
    return kept.drop("_at").fillna({"priority": 100, "scope": "global", "enabled": True})


def append(rows: DataFrame, path: str, day: str | None = None) -> None:
    """Adds rows to a log, in folders by day where a day's column is named."""
    (rows.write.mode("append").partitionBy(day) if day else rows.write.mode("append")).parquet(path)
