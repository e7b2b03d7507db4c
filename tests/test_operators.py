"""The papers and equivalences that a broker knows, on small tables made by hand."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quayside.functions import normalize as N
from quayside.operators import compare, extract, feedback, resolve, rules, state, tax


@pytest.mark.parametrize(
    "field, a, b, same",
    [
        ("package_count", "97 BLE", "97 BALES", True), ("quantity", "12 PCE", "12 PCS", True), ("quantity", "97", "97 BALES", False), ("gross_weight", "99.270 MTS", "99,270 KGS", True),
        ("amount", "USD30277.35", "USD 30,277.35", True), ("amount", "USD 100", "EUR 100", True), ("hs_code", "9403.60.90", "94036090", True), ("container_no", "TGHU O12", "TGHU012", True),
        ("invoice_no", "A1OOL", "A1001", True), ("incoterm", "FOB Kobe", "fob", True), ("vessel_voyage", "EVER ONE V.1", "EVERONE V1", True), ("description", "Red  Chairs", "red chairs", True), ("exchange_rate", "31.50", "31.5", True),
    ],
)
def test_equivalence(spark, field, a, b, same):
    f = F.lit(field)
    df = spark.createDataFrame([(a, b)], "a string, b string")
    got = df.select(N.equivalent(f, N.normalized(f, F.col("a")), N.normalized(f, F.col("b")))).first()[0]
    assert got is same


def test_identifier_repair_cascades(spark):
    df = spark.createDataFrame([("1OOL",), ("OIL",), ("",), ("B1OX",)], "v string")
    assert [r[0] for r in df.select(N.repair_identifier(F.col("v"))).collect()] == ["1001", "OIL", "", "B10X"]


def test_key_similarity(spark):
    df = spark.createDataFrame([("AB123", "AB123"), ("AB0123", "ABO123"), ("ABCDE", "XABCDEX"), ("ABCDEF", "ABCDEX"), ("", "A")], "a string, b string")
    got = [round(r[0], 3) for r in df.select(N.key_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.92, round(5 / 7, 3), round(5 / 6, 3), 0.0]


def test_lines_labels_and_inline_fields(spark):
    text = "COMMERCIAL INVOICE\nInvoice No: A-1\nGross Weight   12 KGS\nbooking number BK77\nInv # 55\n\nTotal Amount：USD 5\nNonsense: x"
    got = extract.parse_lines(extract.lines(spark.createDataFrame([(1, text)], "id int, text string"))).orderBy("ord").collect()
    assert [(r.canonical, r.value) for r in got] == [("invoice_no", "A-1"), ("gross_weight", "12 KGS"), ("booking_no", "BK77"), ("invoice_no", "55"), ("amount", "USD 5")]


def firsts(spark, rows):
    return spark.createDataFrame(rows, "case_id long, seg int, doc_type string, canonical string, value string")


def test_compare_and_report(spark):
    f = firsts(spark, [(1, 0, "invoice", "quantity", "5 PCS"), (1, 3, "declaration", "quantity", "5 PCE"), (1, 2, "bill_of_lading", "container_no", "ABCU1"), (1, 3, "declaration", "container_no", "ABCU2"), (1, 3, "declaration", "amount", "USD 1")])
    got = compare.compare(f).cache()
    by = {r.field: r.status for r in got.collect()}
    assert len(by) == 33 and by["quantity"] == "MATCH" and by["container_no"] == "MISMATCH" and by["amount"] == "MISSING"
    assert compare.report_status(got).first().status == "HIGH_RISK"


WIDE = "case_id long, seg int, doc_type string, ord int, canonical string, value string"


def statuses(spark, values, which):
    rows = [(1, 3, "declaration", i, k, str(v)) for i, (k, v) in enumerate(values.items())]
    return {r.rule: r.status for r in tax.evaluated(tax.wide(spark.createDataFrame(rows, WIDE)), which()).collect()}


def test_tax_formulas(spark):
    good = {"fob": 1000, "freight": 100, "insurance": 10, "cif": 1110, "exchange_rate": 30, "customs_value": 33300, "trade_promotion_fee": 13, "duty_rate": "3%", "duty_amount": 1000, "business_tax": 1716, "hs_code": "94036090"}
    got = statuses(spark, good, tax.rules)
    assert set(got.values()) == {"MATCH"}
    known = statuses(spark, good, tax.knowledge)
    assert known["hs_code"] == known["duty_rate"] == "MATCH" and known["mp1"] == known["bsmi"] == "PENDING"
    bad = statuses(spark, {"cif": 900, "fob": 1000}, tax.rules)
    assert bad["cif_logic"] == "MISMATCH" and bad["trade_promotion_fee"] == "MISSING"
    asked = statuses(spark, {"import_regulation": "MP1", "hs_code": "9403"}, tax.knowledge)
    assert asked["mp1"] == asked["bsmi"] == asked["commodity_inspection"] == "PENDING"


def test_freight_and_insurance(spark):
    df = spark.createDataFrame([(Decimal("4"), Decimal("1000")), (Decimal("6"), Decimal("1000000"))], "cbm decimal(18,6), amount decimal(18,6)")
    got = df.select(tax.freight_by_volume(F.col("cbm"), 5, 6000, 8000), tax.insurance(F.col("amount"), tax.dec("0.0012"))).collect()
    assert [tuple(r) for r in got] == [(6000, Decimal("400.00")), (8000, Decimal("1320.00"))]


def test_rule_conditions(spark):
    df = spark.createDataFrame([("Tin  Box",), (None,)], "v string")
    v = F.col("v")
    got = df.select(rules.condition("exists", v, []), rules.condition("contains", v, ["box"]), rules.condition("not_in", v, ["x"]), rules.condition("in", v, ["TIN BOX"])).collect()
    assert [tuple(r) for r in got] == [(True, True, True, True), (False, False, True, False)]


def test_components_join_chains_and_cycles(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("y", "y")]
    got = {r.v: r.root for r in resolve.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and {got[k] for k in ("x1", "x2", "x3")} == {"x1"} and got["y"] == "y"


def test_missing_documents_for_export(spark):
    df = spark.createDataFrame([(1, 0, "invoice", 0.9), (1, 1, "shipping_order", 0.9), (2, 0, "invoice", 0.1)], "case_id long, seg int, doc_type string, confidence double")
    got = sorted((r.case_id, r.doc_type) for r in resolve.missing_documents(df, "export").collect())
    assert got == [(1, "bill_of_lading"), (1, "export_declaration"), (1, "packing_list"), (2, "bill_of_lading"), (2, "booking"), (2, "export_declaration"), (2, "invoice"), (2, "packing_list")]


def test_state_order(spark):
    df = spark.createDataFrame([(0.5, True, True, 0, "MATCH", 0), (0.9, False, True, 0, "MATCH", 0), (0.9, True, False, 0, "MATCH", 0), (0.9, True, True, 1, "MATCH", 0), (0.9, True, True, 0, "MATCH", 0), (0.9, True, True, 0, "MISSING", 0), (0.9, True, True, 0, "HIGH_RISK", 1)], "least double, has_bl boolean, has_declaration boolean, n_missing int, report_status string, n_findings int")
    assert [r[0] for r in df.select(state.workflow_state()).collect()] == ["NEEDS_HUMAN_REVIEW", "WAITING_BL", "WAITING_DECLARATION", "PARTIAL_DOCUMENTS", "AUDIT_COMPLETED", "READY_FOR_AUDIT", "NEEDS_HUMAN_REVIEW"]


def test_feedback(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "", True), (2, "2024-01-03", " ocr ", False), (3, "2024-01-03", None, False)], "id long, created_at string, error_type string, is_correct boolean")
    clean = feedback.cleaned(df)
    assert [r.id for r in feedback.recent(clean, 2).collect()] == [3, 2]
    assert {r.error_type: r.n for r in feedback.statistics(clean).collect()} == {"correct": 1, "ocr": 1, "other": 1}


def test_value_pairs_brute_force(spark):
    import random

    rng = random.Random(3)
    values = {"".join(rng.choice("AO01IL7") for _ in range(rng.randint(1, 60))) for _ in range(60)}
    for v in list(values):
        for edits in (1, 1, 3, 8):
            for _ in range(min(edits, len(v) // 3 + 1)):
                i = rng.randrange(len(v))
                v = rng.choice([v[:i] + v[i + 1 :], v[:i] + "X" + v[i:], v[:i] + "0" + v[i + 1 :], v.replace("O", "0")]) or "A"
            values.add(v)
    keys = spark.createDataFrame([("bl_no", v) for v in values if v], "key string, value string")
    for least in (0.9, 0.92, 0.85, 0.72):
        found = resolve.value_pairs(keys, least, small=0 if least < 0.92 else 64).collect()
        got = {(r.a, r.b) for r in found}
        assert len(got) == len(found)
        a, b = keys.select(F.col("value").alias("a")), keys.select(F.col("value").alias("b"))
        want = a.join(b, F.col("a") < F.col("b")).filter(N.key_similarity(F.col("a"), F.col("b")) >= least)
        assert got == {(r.a, r.b) for r in want.collect()}


def test_chinese_labels(spark):
    text = "進口報單\n稅額: 120\n毛重：5 KGS\n匯率 31.5\n件數　12"
    got = extract.parse_lines(extract.lines(spark.createDataFrame([(1, text)], "id int, text string"))).orderBy("ord").collect()
    assert [(r.canonical, r.value) for r in got][:3] == [("duty_amount", "120"), ("gross_weight", "5 KGS"), ("exchange_rate", "31.5")]


def test_booking_and_guards(spark):
    from quayside.operators import booking, checks, guards

    text = "BOOKING CONFIRMATION\nBooking No: BK-77\nVessel: EVER ONE\nVoyage: 12W\nPOL: KAOHSIUNG\nETD: 2024-05-01\nConsignee: ACME"
    r = booking.parse(spark.createDataFrame([(1, text), (2, "invoice")], "id int, text string"), ["id"]).collect()
    assert len(r) == 1 and r[0].doc_type == "booking_confirmation" and r[0].missing == "pod,container_no" and r[0].fields["etd"] == "2024-05-01" and r[0].fields["customer"] == "ACME"
    df = spark.createDataFrame([("invoice_no", "ABCD", False), ("invoice_no", "A123", True), ("container_no", "ABCU123", False), ("vessel_voyage", "VESSEL", False), ("amount", "12", True), ("eta", "TO", False)], "k string, v string, ok boolean")
    assert all(x[0] == x[1] for x in df.select(guards.valid_key(F.col("k"), F.col("v")), "ok").collect())
    v = spark.createDataFrame([("1.2.3", "1.2.3-rc1"), ("1.10", "1.9.9"), ("2.0.0-rc2", "2.0.0-rc1")], "a string, b string")
    assert [x[0] for x in v.select(N.version_key(F.col("a")) > N.version_key(F.col("b"))).collect()] == [True] * 3
    assert checks.top_errors(spark.createDataFrame([("a",), ("b",), ("b",)], "error_type string"), 1).first().error_type == "b"


def test_profiles_of_odd_texts(spark):
    from quayside.operators import profiles

    docs = spark.createDataFrame([(1, None), (2, ""), (3, "zzz"), (4, "DELIVERY ORDER\nD/O No: 5\nBill of lading\nB/L No: 7\nContainer No: TGHU1234567\nShipper: a\nConsignee: b"), (5, "packing 1ist")], "id int, text string")
    near = spark.createDataFrame([(5, "packing list")], "id int, term string")
    plain = {(r.id, r.candidate): r.score for r in profiles.profile_scores(docs, ["id"]).collect()}
    nearly = {(r.id, r.candidate): r.score for r in profiles.profile_scores(docs, ["id"], profiles=(("packing_list", 10, {"layout": ("packing list",)}),), near=near).collect()}
    assert not {1, 2, 3, 5} & {k for k, _ in plain} and nearly == {(5, "packing_list"): 23}
    got = {r.id: (r.candidate, float(r.score)) for r in profiles.corrected(profiles.profile_scores(docs, ["id"]), docs, ["id"]).filter("place = 1").collect()}
    assert set(got) == {3, 4, 5} and got[3] == ("unknown", 0.28)
    # the title of a delivery order outweighs the words of a bill of lading, by the corrections
    assert got[4][0] == "delivery_order" and plain[4, "delivery_order"] < plain[4, "bill_of_lading"]
    assert profiles.corrected(profiles.profile_scores(docs.limit(0), ["id"]), docs.limit(0), ["id"]).count() == 0
