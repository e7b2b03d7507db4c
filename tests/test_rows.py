"""Steps that stay in a case's row: nothing is sorted or shuffled by case after the papers are made."""

import re

import pytest
from conftest import SF

from pyspark.sql import functions as F

from quayside.operators import compare, extract, profiles
from quayside.plans import queries as plans


@pytest.mark.parametrize("name", ["first_field", "compare_declaration", "compare_export", "result_lists", "report_text"])
def test_nothing_is_gathered_by_case(spark, name):
    """A sort or a shuffle by case of all lines' fields spilled more than the disk held."""
    plan = plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bSort(Aggregate)? ?[\[(]", plan) and "ObjectHashAggregate" not in plan
    assert len(re.findall(r"Exchange hashpartitioning\(case_id", plan)) == 0


def test_first_values_of_a_row(spark):
    text = "INVOICE\nAmount: \nAmount: USD 5\n: x\nAmount: USD 6\nQty: 3 PCS\r\nB/L No: TW1\nseal no 77\n\t\nNo field"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    got = {r.id: [(f.canonical, f.value) for f in r.x] for r in docs.select("id", extract.firsts_of(extract.parsed(F.col("text"))).alias("x")).collect()}
    assert got[1] == [("amount", "USD 5"), ("quantity", "3 PCS"), ("bl_no", "TW1"), ("seal_no", "no 77")] and got[2] == [] and got[3] == []
    by_line = extract.parse_lines(extract.lines(docs)).orderBy("id", "ord").collect()
    in_row = docs.select("id", F.explode(extract.parsed(F.col("text"))).alias("f")).select("id", "f.*").orderBy("id", "ord").collect()
    assert [(r.id, r.ord, r.canonical, r.label, r.value, r.confidence) for r in by_line] == [(r.id, r.ord, r.canonical, r.label, r.value, r.confidence) for r in in_row]


def test_values_written_alike_and_otherwise(spark):
    rows = [(1, s, k, c, v) for s, k, c, v in ((0, "invoice", "amount", "USD 1,000"), (3, "declaration", "amount", "1000.00"), (1, "packing_list", "quantity", "some PCS"), (3, "declaration", "quantity", "some pcs"), (1, "packing_list", "gross_weight", "2 MT"), (3, "declaration", "gross_weight", "2000 KGS"), (0, "invoice", "bl_no", "TWO1"), (3, "declaration", "bl_no", "TW01"), (0, "invoice", "hs_code", "94"), (3, "declaration", "hs_code", "95"))]
    got = {r.field: (r.status, r.n_papers, r.n_differ) for r in compare.compare(spark.createDataFrame(rows, "case_id long, seg int, doc_type string, canonical string, value string")).collect()}
    assert len(got) == len(compare.CHECK_FIELDS)
    assert [got[k] for k in ("amount", "quantity", "gross_weight", "bl_no", "hs_code", "cif")] == [("MATCH", 1, 0)] * 4 + [("MISMATCH", 1, 1), ("MISSING", 0, 0)]


def test_fast_patterns_say_the_same(spark):
    texts = ["", "qty", "a qty b", "xqty", "qty5", "中qty", "qty件數", "毛重 ", "件數", "_kgs", "d/o", "x d/o", "d/o1", "é d/o中", "kgs.ctn", "中 amount-1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for slow, fast in profiles.FAST.items():
        assert rows.filter(F.col("t").rlike(slow) != F.col("t").rlike(fast)).count() == 0
    words = ["", "B/L No", "提單No.", "a_b", "x—y", "Ünit", "9 9", "鿿一", "A\tB"]
    same = spark.createDataFrame([(t,) for t in words], "t string").select(F.regexp_replace("t", extract.NOT_WORD, " ").alias("a"), F.regexp_replace("t", extract.NOT_WORD_JAVA, " ").alias("b"))
    assert same.filter("a <> b").count() == 0


def test_organizer_takes_first_values_in_the_row(spark):
    from quayside.plans import organizer

    plan = organizer.case_tables(spark, SF).firsts._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bSort(Aggregate)? ?[\[(]", plan) and "Exchange hashpartitioning(case_id" not in plan


def test_a_text_is_profiled_once_and_in_its_row(spark):
    """Each text was normalized twice and searched by interpreted expressions, and its scores were grouped and joined to it."""
    from quayside.operators.profile_batches import TEXTS

    texts = [None, "", " ", "zzz", "\t\n 　", "DELIVERY ORDER\nD/O No: 5\nBill of lading\nB/L No: 7\nContainer No: TGHU1234567", "IMPORT DECLARATION\r\nDeclaration No: AA0000000001\nCIF: USD 1,000.00\n稅額： 5\x85毛重: 3 KGS", "Packing LIST\n" + "x\n" * 20 + "Delivery Order d/o", "ΣΑΣ İnvoice ■■ |a|b|", "艙單號碼 " * 9, "INVOICE\nInvoice No: INV-00001\nAmount: USD 5.25\nBuyer: a_no\n" * 3]
    docs = spark.createDataFrame([(i, t, n) for i, t in enumerate(texts) for n in (i,)], "id int, text string, n int").withColumn("file", F.when(F.col("n") % 3 == 0, F.lit("INV／海.txt")).when(F.col("n") % 3 == 1, F.lit(" PL\tx")))
    near = spark.createDataFrame([(3, "packing list"), (3, "bill of lading"), (9, "nowhere")], "id int, term string")
    for name, more in ((None, None), (F.col("file"), None), (None, near)):
        got = profiles.candidates(docs, ["id"], name=name, near=more)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and (more is not None or "Exchange" not in plan)
        want = profiles.corrected(profiles.profile_scores(docs, ["id"], name=name, near=more), docs, ["id"])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5
    # shapes, against the expressions that they stand for
    t = F.coalesce("text", F.lit(""))
    raw = F.filter(F.split(t, r"\R", -1), lambda x: F.trim(x) != "")
    from quayside.functions.normalize import classifier_text

    want = docs.select("id", classifier_text(t).alias("normal"), classifier_text(F.array_join(F.slice(raw, 1, profiles.HEADER_LINES), "\n")).alias("header"), classifier_text(F.coalesce("file", F.lit(""))).alias("file"), F.size(raw).alias("lines"), F.regexp_count(classifier_text(t), F.lit("[0-9]")).alias("digits"), F.length(classifier_text(t)).alias("chars"))
    assert sorted(map(tuple, profiles.shapes(docs, ["id"], F.col("file")).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    many = spark.range(TEXTS + 3).select("id", F.concat(F.lit("packing list "), "id").alias("text"))
    assert profiles.candidates(many.coalesce(1), ["id"]).filter("place = 1").count() == TEXTS + 3
