"""A registry of parsers of papers: each says which texts it supports and parses them; a paper's surest result stands."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators import booking, classify, extract

#: What a parser returns for a paper beside its keys.
RESULT = ("doc_type", "fields", "confidence")


@dataclass(frozen=True)
class Parser:
    """`supports` tells from a text whether to parse it (null counts as no); `parse(papers, keys)` gives keys, doc_type, fields (map of
    name to value) and confidence for each of the papers (keys and text)."""

    name: str
    supports: Callable[[Column], Column]
    parse: Callable[[DataFrame, list[str]], DataFrame]


@dataclass
class Registry:
    parsers: list[Parser] = field(default_factory=list)

    def register(self, parser: Parser) -> Registry:
        """Adds a parser behind those that are there; names are unique."""
        if parser.name in {p.name for p in self.parsers}:
            raise ValueError(f"a parser named {parser.name} is registered already")
        self.parsers.append(parser)
        return self

    def parse(self, papers: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
        """keys, parser, doc_type, fields, confidence: of all parsers that support a paper's text (all parsers where none does) the surest
        result; the first registered wins ties. A paper that no parser gives a result for has no row. Results combine before the shuffle."""
        if not self.parsers:
            raise ValueError("no parsers are registered")
        flags = F.array(*(F.coalesce(p.supports(F.col("text")), F.lit(False)) for p in self.parsers))
        asked = papers.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_ask", flags)
        asked = asked.withColumn("_ask", F.when(F.array_contains("_ask", True), F.col("_ask")).otherwise(F.array(*(F.lit(True) for _ in self.parsers))))
        every = None
        for i, p in enumerate(self.parsers):
            mine = p.parse(asked.filter(F.col("_ask")[i]).drop("_ask"), keys)
            rows = mine.select(*keys, F.struct(F.col("confidence").cast("double").alias("confidence"), F.lit(-i).alias("ord")).alias("_o"), F.struct(F.lit(p.name).alias("parser"), *RESULT).alias("_r"))
            every = rows if every is None else every.unionByName(rows)
        return every.groupBy(*keys).agg(F.max_by("_r", "_o").alias("_r")).select(*keys, "_r.*")


def first_title(text: Column) -> Column:
    """A paper's kind by the words of its first line, else unknown."""
    head = F.lower(F.substring_index(text, "\n", 1))
    out = F.lit("unknown")
    for kind, terms in reversed(classify.TERMS):
        out = F.when(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(head, t)), kind).otherwise(out)
    return out


def general(papers: DataFrame, keys: list[str]) -> DataFrame:
    """Fields by labels, inline names and looks; a paper without any has an empty map."""
    rows = extract.lines(papers.select(*keys, first_title(F.col("text")).alias("doc_type"), "text"))
    found = extract.first_values(extract.parse_lines(rows), [*keys, "doc_type"]).select(*keys, "doc_type", "canonical", "value")
    none = papers.select(*keys, first_title(F.col("text")).alias("doc_type"), F.lit(None).cast("string").alias("canonical"), F.lit(None).cast("string").alias("value"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("canonical").isNotNull(), F.struct("canonical", "value"))))
    each = found.unionByName(none).groupBy(*keys, "doc_type").agg(F.map_from_entries(pairs).alias("fields"))
    return each.withColumn("confidence", booking.semantic_confidence(F.col("doc_type") != "unknown", F.size("fields")))


def default_registry() -> Registry:
    found = Registry()
    found.register(Parser("booking", booking.supported, booking.parse))
    return found.register(Parser("general", lambda t: F.trim(t) != "", general))
