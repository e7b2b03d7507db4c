"""Changes of a folder as a stream, parsing of what changed alone, and the history of checks."""

import os
import time

from quayside.operators import feedback
from quayside.sources import files, rates, store
from quayside.streaming import listings

LISTING = "listing long, path string, mtime long, size long"


def stream(spark, folder):
    return spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(folder)


def put(spark, folder, n, rows):
    spark.createDataFrame([(n, *r) for r in rows], LISTING).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.01)


def test_changes_are_the_differences_of_listings(spark, tmp_path):
    folder, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("listings", "out", "checkpoint"))
    states = [
        [("a", 1, 1), ("b", 1, 1), ("c", 1, 1)],
        [("a", 1, 1), ("b", 2, 1), ("d", 1, 1)],
        [("a", 1, 2), ("d", 1, 1), ("c", 9, 9)],
        [("e", 1, 1)],
    ]
    for n, rows in enumerate(states[:2]):
        put(spark, folder, n, rows)
    listings.run_changes(stream(spark, folder), out, checkpoint)
    assert {(x.path, x.change) for x in spark.read.parquet(out).filter("listing = 1").collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    for n, rows in enumerate(states[2:], 2):  # another run goes on from the state of the first
        put(spark, folder, n, rows)
    listings.run_changes(stream(spark, folder), out, checkpoint)
    found = spark.read.parquet(out).collect()
    assert len({(x.path, x.listing) for x in found}) == len(found)
    for n in range(1, len(states)):
        before, after = (spark.createDataFrame(states[i], "path string, mtime long, size long") for i in (n - 1, n))
        want = {(x.path, x.change) for x in feedback.snapshot_diff(before, after).collect()}
        assert {(x.path, x.change) for x in found if x.listing == n} == want


def test_only_changed_files_are_parsed(spark, tmp_path):
    folder, root = tmp_path / "in", f"file://{tmp_path}/store"
    folder.mkdir()
    for name, text in (("a.txt", "one"), ("b.txt", "two"), ("bad.xlsx", "no workbook")):
        (folder / name).write_text(text)
    read = []

    def parse(found):
        read.append(sorted(x.path.rsplit("/", 1)[1] for x in found.select("path").collect()))
        return files.pages(found)

    def run():
        pages, changes = store.parse_changed(spark, f"file://{folder}", root, parse)
        whole = files.pages(files.scan(spark, f"file://{folder}"))
        assert sorted(map(tuple, pages.collect())) == sorted(map(tuple, whole.collect()))
        return sorted((x.path.rsplit("/", 1)[1], x.change) for x in changes.collect())

    assert run() == [("a.txt", "added"), ("b.txt", "added"), ("bad.xlsx", "added")]
    assert run() == []
    (folder / "b.txt").write_text("two and more")
    (folder / "c.txt").write_text("three")
    os.remove(folder / "a.txt")
    assert run() == [("a.txt", "removed"), ("b.txt", "changed"), ("c.txt", "added")]
    assert read == [["a.txt", "b.txt", "bad.xlsx"], [], ["b.txt", "c.txt"]]
    # a version without its commit is as if it weren't there
    (folder / "d.txt").write_text("four")
    store.parse_changed(spark, f"file://{folder}", root, parse)
    os.remove(tmp_path / "store" / "commits" / "000000003")
    assert run() == [("d.txt", "added")]


def test_history_is_committed_once(spark, tmp_path):
    root = f"file://{tmp_path}/history"
    report = spark.createDataFrame([(1, "MATCH", "bl_no", "", "A", "A"), (1, "MISMATCH", "amount", "differs", "1", "2"), (2, "MATCH", "bl_no", "", "B", "B")], "case_id long, status string, field string, message string, expected string, actual string")
    documents = spark.createDataFrame([(1, "invoice", "a.pdf", "x/a.pdf"), (3, "invoice", "c.pdf", "x/c.pdf")], "case_id long, doc_type string, source_name string, stored_name string")
    parsed = spark.createDataFrame([(1, "invoice", "a.pdf", {"b": "2", "a": "1"}, ""), (3, "invoice", "c.pdf", None, "no text")], "case_id long, doc_type string, source_name string, fields map<string,string>, error string")
    assert store.load(spark, root, "checks").count() == 0
    for batch in ("7", "8", "7"):  # the seventh comes twice
        store.save(spark, root, batch, store.history_tables(report, documents, parsed, batch, "2024-05-01 10:00:00", "import"))
    checks = store.load(spark, root, "checks")
    assert sorted((x.batch, x.check_id, x.summary) for x in checks.collect()) == [(b, f"{b}:{c}", s) for b in "78" for c, s in ((1, "MATCH: 1, MISMATCH: 1"), (2, "MATCH: 1"), (3, ""))]
    for name, n in (("uploaded_documents", 2), ("parsed_results", 2), ("check_items", 3)):
        rows = store.load(spark, root, name)
        assert rows.count() == 2 * n and rows.join(checks, ["batch", "check_id"]).count() == 2 * n
    assert {x.fields_json for x in store.load(spark, root, "parsed_results").collect()} == {'{"a":"1","b":"2"}', "{}"}
    # a batch whose commit is missing is not read
    os.remove(tmp_path / "history" / "commits" / "8")
    assert {x.batch for x in store.load(spark, root, "check_items").collect()} == {"7"}


def test_an_old_case_gets_the_old_rate(spark, tmp_path):
    root = f"file://{tmp_path}/rates"
    for name, day, lte, extra in (("1", "2023-01-01", 6000, '"bad": 3'), ("2", "2024-01-01", 6500, '"insurance": {"multiplier": 1.1}')):
        file = tmp_path / f"{name}.json"
        file.write_text('﻿{"schema_version": 1, "rate_tables": {"cfs:cbm": {"currency": "TWD", "lte_threshold": %d}, %s}}' % (lte, extra), encoding="utf-8")
        rates.publish(spark, root, name, rates.read_nested(spark, [f"file://{file}"], day))
    cases = spark.createDataFrame([(1, "cfs:cbm", "2022-05-05"), (2, "cfs:cbm", "2023-12-31"), (3, "cfs:cbm", "2024-01-01"), (4, "insurance", "2023-06-01"), (5, "none", "2024-06-01"), (6, None, None)], "case_id long, ref string, date string")
    found = {x.case_id: x.rates for x in rates.as_of(cases, rates.published(spark, root)).collect()}
    assert found == {1: None, 2: {"currency": "TWD", "lte_threshold": "6000"}, 3: {"currency": "TWD", "lte_threshold": "6500"}, 4: None, 5: None, 6: None}
    # a correction of a version's day; and one that wasn't committed
    rates.publish(spark, root, "3", spark.createDataFrame([("cfs:cbm", "2024-01-01", {"lte_threshold": "7000"})], "ref string, day string, rates map<string,string>").selectExpr("ref", "cast(day as date) as valid_from", "rates"))
    assert {x.case_id: x.rates for x in rates.as_of(cases, rates.published(spark, root)).collect()}[3] == {"lte_threshold": "7000"}
    os.remove(tmp_path / "rates" / "commits" / "3")
    assert {x.case_id: x.rates for x in rates.as_of(cases, rates.published(spark, root)).collect()} == found


def test_statistics_of_the_latest_answers(spark):
    log = spark.createDataFrame([(1, "2024-01-01", "ocr", False), (2, "2024-01-02", "field", False), (3, "2024-01-02", "", True), (4, "2024-01-03", "ocr", False), (5, "2024-01-03", "field", False), (6, "2024-01-04", None, None)], "id long, created_at string, error_type string, is_correct boolean")
    x = feedback.latest_statistics(feedback.cleaned(log), 5).first()
    assert (x.total, x.n_correct, x.n_issues) == (5, 1, 4) and [tuple(e) for e in x.errors] == [("field", 2), ("other", 1), ("ocr", 1)]
    empty = feedback.latest_statistics(feedback.cleaned(log.limit(0))).first()
    assert (empty.total, list(empty.errors)) == (0, [])
