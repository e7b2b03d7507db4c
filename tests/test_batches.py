"""Fields read and compared a batch of cases at a time, against the same in expressions."""

import pytest
from conftest import SF

from pyspark.sql import functions as F

from quayside.operators import batches, compare, extract
from quayside.plans import queries as plans

ODD = [
    "INVOICE\nAmount: \nAmount: USD 5\n: x\nAmount: USD 6\nQty: 3 PCS\r\nB/L No: TW1\nseal no 77\n\t\nNo field", "", None, "  \n\n",
    "Gross Weight   5 KGS\nqty\t5\n數量：7\n：x\n\ta\nfoo: inv no 5\nXX: nothing\nABCD 1234567\nFOB here\nTotal   \nqty", "a Invoice No: 5\x0bB/L No: é\x85Rate: 3.5\fBKG# 99",
    "import declaration\nbill of lading\nport\nPort:\nITEM  NO   x", "ex rate 31.5\n匯率:31.5\nHS Code 9403.60\n稅則號別 9403609000\nentry#5", "S/O No 5 : x\nLabel with qty in it: 5\nqty_x-y: 5\nthe Quantity is 5\nso 5",
]
PAPERS = "case_id long, papers array<struct<seg:int,doc_type:string,text:string>>"


def same(a, b):
    key = lambda r: repr(tuple(r))
    assert a.columns == b.columns
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(i, [(0, "a", t), (2, "b", ODD[(i + 1) % len(ODD)])]) for i, t in enumerate(ODD)] + [(99, [])], PAPERS)


def test_fields_are_those_of_the_expressions(cases):
    papers = cases.select("case_id", F.explode("papers").alias("p")).select("case_id", "p.*")
    own = papers.select("case_id", "seg", "doc_type", extract.parsed(F.col("text")).alias("fs"))
    same(batches.fields(cases), own.select("case_id", "seg", "doc_type", F.explode("fs").alias("f")).select("case_id", "seg", "doc_type", "f.*"))
    firsts = own.select("case_id", "seg", "doc_type", F.explode(extract.firsts_of(F.col("fs"))).alias("f")).select("case_id", "seg", "doc_type", "f.canonical", "f.value")
    same(batches.firsts(cases), firsts)
    same(batches.values(cases).select("case_id", F.explode("values").alias("x")).select("case_id", "x.*"), firsts)
    assert batches.values(cases).count() == batches.parsed(cases).count() == len(ODD) + 1


def test_sides_say_what_the_comparison_says(spark):
    odd = [(0, "declaration", "Qty: 5 PCS\nFOB: 3"), (0, "declaration", "Qty: 4 PCS\nB/L No: A"), (1, "invoice", "Qty: 5 PCE\nFOB: 3.0\nB/L No: B"), (2, "packing_list", "Qty: 4 PCS")]
    cases = spark.createDataFrame([(1, odd), (2, odd[2:]), (3, odd[:1]), (4, []), (5, [(0, "declaration", None), (1, "x", "foo: bar")])], PAPERS)
    for targets in (None, ("invoice",)):
        found = batches.sides(cases, ("declaration",), compare.CHECK_FIELDS, targets)
        same(compare.opened(found.select("case_id", compare.judged(F.col("sides")).alias("results"))), compare.compare(batches.firsts(cases), targets=targets))


def test_each_distinct_label_is_named_once():
    """Naming every line's label took most of the time of all queries over papers."""
    import pyarrow as pa

    asked = []
    named = batches.names_of(extract.ALIASES)
    batches.read_papers(pa.array(["Qty: 5\nFOB: 3"] * 100), lambda x: asked.append(x) or named(x), batches.line_reader(extract.ALIASES))
    assert sorted(asked) == ["FOB", "Qty"]


def test_lines_are_not_read_by_interpreted_expressions(spark):
    for name in ("line_fields", "first_field", "compare_declaration", "compare_export"):
        plan = plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "regexp_replace" not in plan.split("MapInArrow")[-1]


@pytest.mark.parametrize("name", ["declaration_totals", "formal_compare", "parsed_items", "paper_bridges", "case_ids", "last_key", "handled_fields", "values_by_field", "pivot_compare", "consensus", "totals_by_type"])
def test_a_cases_fields_stay_in_its_row(spark, name):
    """Shuffles of every field by case outgrew the disk, and a task's memory grew with the cases that it gathered."""
    from quayside.plans import advice, more

    plan = (plans.queries() | more.queries() | advice.queries())[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    after = plan.split("MapInArrow")[0]
    assert "Exchange" not in after and "Aggregate" not in after and "Join" not in after and "Sort" not in after


def test_totals_of_a_row(spark):
    values = [["1,000.5 KGS", "none"], ["0.0049999999", "0.0000000001"], ["none"], [], ["1", "2", "-3"]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<string>").select("i", compare.total_of(F.col("v")).alias("t"))
    by_sum = spark.createDataFrame([(i, x) for i, v in enumerate(values) for x in v], "i int, x string").groupBy("i").agg(F.sum(compare.number(F.col("x"))).cast("decimal(38,2)").alias("t"))
    want = {r.i: r.t for r in by_sum.collect()}
    assert {r.i: r.t for r in df.collect()} == {i: want.get(i) for i in range(len(values))}


def test_papers_are_linked_without_a_vertex_for_each_value(spark):
    """Texts as vertices made the rounds of the components take most of the time."""
    from quayside.operators import resolve

    rows = [(0, "bl_no", "TWBL0000001"), (4, "bl_no", "TWBLO000001"), (5, "bl_no", "TWBL0000001"), (5, "invoice_no", "INV7"), (9, "invoice_no", "INV7"), (12, "eta", "X"), (13, "eta", "X"), (20, "container_no", "TGHU1"), (21, "bl_no", "OTHER")]
    keys = spark.createDataFrame(rows, "seg_id long, key string, value string")
    near = resolve.value_pairs(keys, 0.92)
    found = resolve.components(resolve.paper_links(keys, near))
    assert found.schema["v"].dataType.simpleString() == "bigint"
    old = resolve.components(resolve.links(keys, near)).filter("v LIKE 'p:%'").select(F.substring("v", 3, 20).cast("long").alias("v"), F.substring("root", 3, 20).alias("root"))
    parts = lambda df: sorted(sorted(r.vs) for r in df.groupBy("root").agg(F.collect_list("v").alias("vs")).collect())
    assert parts(found) == parts(old) == [[0, 4, 5, 9], [20], [21]]


def test_rows_keep_their_columns_beside_their_fields(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else "x", t) for i, t in enumerate(ODD)], "id long, source string, text string")
    got = batches.read(docs)
    assert got.columns == ["id", "source", "fields"]
    same(got, docs.select("id", "source", extract.parsed(F.col("text")).alias("fields")))


def test_organizer_reads_papers_in_batches(spark):
    from quayside.plans import organizer

    plan = organizer.case_tables(spark, SF).fields._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
