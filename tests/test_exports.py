"""Reading by labels against a plain Python version, and the comparison of a booking."""

import random
import re

import pytest
from conftest import SF, rows as plain_rows

from quayside.operators import export, labels
from quayside.plans import exports, exports_oracle


def by_hand(kind: str, text: str) -> dict[str, str]:
    t = "\n".join(x for x in (re.sub(r"\s+", " ", line).strip() for line in text.replace("\r", "\n").split("\n")) if x)
    out = {}
    for field, names in labels.TABLES.get(labels.NAMES.get(kind, kind), {}).items():
        tries = [rf"(?im){at}{re.escape(x)}\s*[:：#]\s*([^\n]+)" for x in sorted(names, key=len, reverse=True) for at in (r"^\s*", "")]
        values = [m.group(1).strip(" \t:：")[:160] for p in tries if (m := re.search(p, t))]
        if values := [v for v in values if v]:
            out[field] = values[0]
    return out


def test_label_fields_by_hand(spark):
    rng = random.Random(5)
    bits = ["Gross Weight", "gw", "G.W.", "Packages", "Package", "Qty", "Vessel/Voyage", "Vessel", "Port", "POL", "HS Code", "Tax Rate", "Rate", "Tax", "毛重", "CY", "FOB", ":", ":", ": ", "：", " # ", "\n", "\n", "\r", "  ", "12 KGS", "x", "::", "\t", "y" * 200]
    rows = [(i, rng.choice(["INV", "PKG", "B/L", "倉單", "SO", "S/O", "DS2", "DS2報單", "other"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    rows += [(400, "INV", None), (401, "INV", ""), (402, None, "FOB: 1"), (403, "INV", "FOB: 1"), (403, "INV", "FOB: 1")]
    got: dict = {}
    for r in labels.label_fields(spark.createDataFrame(rows, "id long, doc_type string, text string")).collect():
        got.setdefault(r["id"], {})[r["field"]] = r["value"]
    want = {i: f for i, kind, text in rows if (f := by_hand(kind, text or ""))}
    assert got == want
    assert len(want) > 200


def test_label_fields_of_own_tables_and_no_rows(spark):
    papers = spark.createDataFrame([("A", "Ref: 7\nFOB: 1", 3)], "doc_type string, text string, field_ int")
    assert [tuple(r) for r in labels.label_fields(papers, {"A": {"ref": ("Ref", "Reference")}}).collect()] == [("A", 3, "ref", "7")]
    assert labels.label_fields(papers.limit(0)).count() == 0


def test_read_papers_keeps_what_is_not_read(spark):
    rows = [(1, "INV", "a.pdf", "FOB: 1"), (2, "INV", "a.PDF", None), (3, "SO", "a.docx", "FOB: 1"), (4, "x", "a", "FOB: 1")]
    got = {r["id"]: (r["kind"], r["n_fields"], r["fields"], r["error"]) for r in labels.read_papers(spark.createDataFrame(rows, "id long, doc_type string, source string, text string"), ["id"]).collect()}
    assert got == {1: ("INV", 1, "FOB=1", None), 2: ("INV", 0, "", None), 3: ("訂艙單 / SO", 0, "", labels.UNREAD + ".docx"), 4: ("x", 0, "", labels.UNREAD)}


def test_booking_results(spark):
    papers = spark.createDataFrame([(1, 0, "booking", "b"), (1, 1, "booking", "b2"), (1, 2, "bill_of_lading", "l"), (1, 3, "invoice", "i"), (2, 0, "invoice", "i"), (3, 0, "booking", "b")], "case_id long, seg int, doc_type string, source string")
    firsts = [(1, 0, "pol", "Keelung  Port"), (1, 2, "pol", "KEELUNG port"), (1, 0, "pod", "X"), (1, 2, "pod", "Y"), (1, 3, "cbm", "5"), (1, 0, "cbm", "1,000"), (1, 1, "seal_no", "S"), (1, 2, "seal_no", "S")]
    results = export.booking_results(papers, spark.createDataFrame(firsts, "case_id long, seg int, canonical string, value string"))
    got = {(r["case_id"], r["field"]): (r["status"], r["hub_value"], r["message"]) for r in results.collect()}
    assert len(got) == 24
    assert got[1, "pol"] == ("MATCH", "Keelung  Port", "pol: 一致")
    assert got[1, "pod"] == ("MISMATCH", "X", "pod: 定倉單與 l 不一致")
    assert got[1, "cbm"] == ("MISSING", "1,000", "cbm: 比對文件缺少欄位")  # an invoice isn't compared
    assert got[1, "seal_no"] == ("MISSING", "", "seal_no: 定倉單缺少欄位")  # only the first booking counts
    report = {r["case_id"]: (r["status"], r["warnings"].count("\n")) for r in export.booking_report(papers, results).collect()}
    assert report == {1: ("MISMATCH", 10), 2: ("HIGH_RISK", 0), 3: ("MISSING", 11)}
    empty = papers.limit(0)
    assert export.booking_report(empty, export.booking_results(empty, spark.createDataFrame([], "case_id long, seg int, canonical string, value string"))).count() == 0


@pytest.mark.parametrize("name", sorted(exports_oracle.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got, want = exports.queries()[name](spark, SF).toPandas(), duck.sql(exports_oracle.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain_rows(got) == plain_rows(want)


def test_a_papers_fields_stay_in_its_row(spark):
    """Every field was shuffled to its paper."""
    papers = spark.createDataFrame([(1, "INV", "a.pdf", "FOB: 1")], "id long, doc_type string, source string, text string")
    assert "Exchange" not in labels.read_papers(papers, ["id"])._jdf.queryExecution().executedPlan().toString()


def test_labels_are_read_in_batches(spark):
    """Each label was a pattern that searched each text: hundreds of them, interpreted."""
    end = "y" * 200
    rows = [
        (1, "INV", "Amount\nFOB\n:\n7"), (2, "INV", "FOB::CIF: 5"), (3, "INV", "FOB:\r\r CIF:"), (4, "INV", "x FOB: 1\nfob:2\nF.O.B#3"), (5, "INV", f"FOB # :{end}: \t:"), (6, "INV", "FOB: :\n:"), (7, "倉單", "Warehouse: :\n倉庫: K2 "),
        (8, "INV", "Pac\u212aages: 5"), (9, "INV", "Pac\u212aages: 5\npackages"), (10, "INV", "Good\u017f: 5"), (11, "INV", "Good\u017f: 5\ngoods"), (12, "SO", "Container No : : 5 Container: 6"), (13, "INV", "FOB\u3000：\xa01\u2003 2"), (14, "PKG", "a:" * 3000 + "GW:1"),
    ]
    papers = spark.createDataFrame(rows * 2, "id long, doc_type string, text string").coalesce(1)
    found = labels.label_fields(papers)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString() and "regexp" not in found._jdf.queryExecution().executedPlan().toString()
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["id"], {})[r["field"]] = r["value"]
    want = {i: f for i, kind, text in rows if (f := by_hand(kind, text))}
    # letters that only a comparison without case takes for a label's count where the text holds the label besides
    assert want.pop(10) == {"品名": "5"}
    assert got == want and found.count() == 2 * sum(map(len, want.values()))


def test_labels_with_a_sign_of_their_own(spark):
    papers = spark.createDataFrame([("A", "Ref #: 7\nNo:5"), ("A", "x Ref #\n: 8")], "doc_type string, text string")
    assert sorted(r.value for r in labels.label_fields(papers, {"A": {"ref": ("Ref #", "Reference")}}).collect()) == ["7", "8"]
