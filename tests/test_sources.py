"""Files, rules and watched folders."""

import json
import zipfile

from pyspark.sql import functions as F

from quayside.sources import files
from quayside.streaming import watch


def workbook(path):
    main = files.MAIN[1:-1]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Invoice No</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c t="s"><v>0</v></c><c><v>17</v></c></row><row><c t="inlineStr"><is><t> </t></is></c></row></sheetData></worksheet>')


def test_scan_and_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("發票".encode("big5"))
    (tmp_path / "sub" / "b.csv").write_text(" x , y\n1,2\n")
    workbook(tmp_path / "c.xlsx")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "~$c.xlsx").write_bytes(b"")
    (tmp_path / "e.exe").write_bytes(b"")
    found = files.scan(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.pages(found).collect()}
    assert set(got) == {"a.txt", "b.csv", "c.xlsx", "d.pdf"}
    assert got["a.txt"].text == "發票" and got["b.csv"].text == "x | y\n1 | 2" and got["c.xlsx"].text == "Invoice No | 17"
    assert got["d.pdf"].needs_manual and got["d.pdf"].error


def test_rules_keep_file_order_and_defaults(spark, tmp_path):
    (tmp_path / "two.json").write_text(json.dumps([{"rule_id": "B", "enabled": False}, {"rule_id": " "}]))
    (tmp_path / "one.json").write_text(json.dumps([{"rule_id": "A", "priority": 3, "applies_when": {"k": ["v"]}}]))
    got = files.rules(spark, [f"{tmp_path}/two.json", f"{tmp_path}/one.json"]).orderBy("load_ord").collect()
    assert [(r.rule_id, r.priority, r.enabled, r.scope) for r in got] == [("B", 100, False, "global"), ("A", 3, True, "global")]


def test_watch_folder_sees_each_file_once(spark, tmp_path):
    inbox, seen = tmp_path / "in", []
    inbox.mkdir()

    def note(batch, number):
        seen.extend(r.path.rsplit("/", 1)[-1] for r in batch.select("path").collect())

    for name in ("a.txt", "b.txt"):
        (inbox / name).write_text(name)
        watch.watch_folder(spark, str(inbox), note, f"{tmp_path}/check", once=True).awaitTermination()
    assert seen == ["a.txt", "b.txt"]


def test_append_adds_days(spark, tmp_path):
    df = spark.range(3).withColumn("day", F.lit("2024-01-01"))
    for _ in range(2):
        files.append(df, f"{tmp_path}/log", "day")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 6
