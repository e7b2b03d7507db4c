"""The registry: the surest parser wins, the first on ties, all are asked where none supports a text, and a user can add one."""

import pytest
from pyspark.sql import functions as F

from quayside.operators import parsers


def fixed(name, word, sure):
    def parse(papers, keys):
        return papers.select(*keys, F.lit(name).alias("doc_type"), F.create_map(F.lit("n"), F.length("text").cast("string")).alias("fields"), F.lit(sure).alias("confidence"))

    return parsers.Parser(name, lambda t: F.contains(t, F.lit(word)), parse)


def test_surest_first_and_none(spark):
    r = parsers.Registry().register(fixed("a", "x", 0.5)).register(fixed("b", "x", 0.5)).register(fixed("c", "y", 0.9))
    docs = spark.createDataFrame([(1, "x"), (2, "xy"), (3, "z"), (4, None), (5, "y")], "k int, text string")
    assert {x.k: x.parser for x in r.parse(docs, ["k"]).collect()} == {1: "a", 2: "c", 3: "c", 4: "c", 5: "c"}
    assert r.parse(docs.limit(0), ["k"]).count() == 0


def test_default_parsers_and_one_more(spark):
    docs = spark.createDataFrame(
        [(1, "BOOKING CONFIRMATION\nBooking No: BK123\nVessel: EVER\nVoyage: 12W\nPOL: KEELUNG\nPOD: OSAKA\nETD: 2024-01-02\nETA: 2024-01-09\nConsignee: A\nShipper: B\nContainer No: ABCD1234567\nSeal No: S1\nPackages: 5"), (2, "COMMERCIAL INVOICE\nInvoice No: INV-9\nAmount: USD 5"), (3, "nothing here")], "k int, text string"
    )
    r = parsers.default_registry()
    got = {x.k: x for x in r.parse(docs, ["k"]).collect()}
    # both parsers are as sure as they can be: the first registered stands
    assert (got[1].parser, got[1].doc_type, got[1].fields["container_no"]) == ("booking", "booking_confirmation", "ABCD1234567")
    assert (got[2].parser, got[2].doc_type, got[2].fields["invoice_no"]) == ("general", "invoice", "INV-9")
    assert got[3].doc_type == "unknown" and got[3].fields == {}
    more = {x.k: x.parser for x in r.register(fixed("mine", "INVOICE", 0.99)).parse(docs, ["k"]).collect()}
    assert more == {1: "booking", 2: "mine", 3: "general"}
    with pytest.raises(ValueError):
        r.register(fixed("mine", "", 1.0))
    with pytest.raises(ValueError):
        parsers.Registry().parse(docs, ["k"])
