"""Chat formatting: the layout of each record is told by a fingerprint of its field paths, which selects a declarative mapping.

Records of many layouts lie in one table (as spark.read.json gives them: one schema with all fields, null where a record lacks
one). A record's fingerprint is the SHA-256 of its sorted paths that hold a value; the registry has a mapping for each known
one. Only DataFrame functions.

Template: for each turn `<|im_start|>`, role, newline, text, `<|im_end|>`, newline. Inside roles and texts `&` is written
`&amp;` and `<|` is written `&lt;|` (in roles also a newline as `&#10;`), so no control string stands inside a text and
unescape() gives each one back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.common import unused

TURNS = "array<struct<role:string,text:string>>"
START, END = "<|im_start|>", "<|im_end|>"


class Mapping(NamedTuple):
    """turns: (role, path) in order, for layouts with a field for each turn. messages: path of an array of structs, the field
    names of role and text, and how its roles are renamed. order: an optional field of these structs that sorts them, nulls last."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] | None = None
    order: str | None = None
    rename: tuple[tuple[str, str], ...] = ()


SHARE = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
REGISTRY = (
    Mapping("messages", ("messages[].content", "messages[].role"), messages=("messages", "role", "content")),
    Mapping("turn_rows", ("rows[].role", "rows[].text"), ("rows[].turn",), messages=("rows", "role", "text"), order="turn"),
    Mapping("share", ("conversations[].from", "conversations[].value"), messages=("conversations", "from", "value"), rename=SHARE),
    Mapping("dialog", ("dialog[].speaker", "dialog[].utterance"), messages=("dialog", "speaker", "utterance"), rename=SHARE),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("prompt", ("prompt", "completion"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("prompt", "response"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question", ("question", "answer"), ("context",), (("user", "context"), ("user", "question"), ("assistant", "answer"))),
    Mapping("nested_prompt", ("request.prompt", "response.text"), ("request.system",), (("system", "request.system"), ("user", "request.prompt"), ("assistant", "response.text"))),
)


def digest(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def known(registry: Iterable[Mapping] = REGISTRY) -> dict[str, Mapping]:
    """Fingerprint to mapping, for each choice of the optional fields."""
    found: dict[str, Mapping] = {}
    for m in registry:
        for bits in range(1 << len(m.optional)):
            found.setdefault(digest([*m.required, *(p for i, p in enumerate(m.optional) if bits >> i & 1)]), m)
    return found


def paths(schema: T.StructType, names: Iterable[str], prefix: str = "") -> list[str]:
    """The paths of all leaves below the named columns; `[]` marks an array's elements."""
    out: list[str] = []
    for f in schema.fields:
        if prefix or f.name in names:
            kind, at = f.dataType, prefix + f.name
            if isinstance(kind, T.ArrayType):
                kind, at = kind.elementType, at + "[]"
            out += paths(kind, (), at + ".") if isinstance(kind, T.StructType) else [at]
    return out


def held(path: str) -> Column:
    """Whether a record has a value at the path."""
    top, *below = path.split("[].")
    value = F.col(".".join(f"`{x}`" for x in top.removesuffix("[]").split(".")))
    if not below:
        return value.isNotNull() if not path.endswith("[]") else F.coalesce(F.size(value) > 0, F.lit(False))
    return F.coalesce(F.exists(value, lambda x: _down(x, below[0]).isNotNull()), F.lit(False))


def _down(x: Column, path: str) -> Column:
    for name in path.removesuffix("[]").split("."):
        x = x[name]
    return x


def fingerprint(schema: T.StructType, names: Iterable[str]) -> Column:
    every = sorted(paths(schema, list(names)))
    return F.sha2(F.concat_ws("\n", *(F.when(held(p), p) for p in every)), 256) if every else F.sha2(F.lit(""), 256)


def _turns(m: Mapping, there: set[str]) -> Column:
    if m.messages:
        top, role, text = m.messages
        rows = F.col(f"`{top}`")
        if m.order and f"{top}[].{m.order}" in there:
            rows = F.array_sort(F.transform(rows, lambda x: F.struct(x[m.order].isNull().alias("last"), x[m.order].alias("o"), x[role].alias(role), x[text].alias(text))))
        new = dict(m.rename)

        def name(x: Column) -> Column:
            out = F.coalesce(x, F.lit(""))
            for a, b in new.items():
                out = F.when(x == a, b).otherwise(out)
            return out

        return F.transform(rows, lambda x: F.struct(name(x[role]).alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))).cast(TURNS)
    one = [F.when(held(p), F.struct(F.lit(r).alias("role"), F.col(".".join(f"`{x}`" for x in p.split("."))).cast("string").alias("text"))) for r, p in m.turns if p in there]
    return F.filter(F.array(*one), lambda x: x.isNotNull()).cast(TURNS)


def canonical(records: DataFrame, keys: list[str], registry: Iterable[Mapping] = REGISTRY) -> DataFrame:
    """keys, layout (null where no mapping is known), turns. Every row is kept; columns other than keys are the record.

    An unknown layout gives null turns. A null among an array's fields is read as an empty string.
    """
    names = [c for c in records.columns if c not in keys]
    there = set(paths(records.schema, names))
    usable = {k: m for k, m in known(registry).items() if set(m.required) <= there}
    mark = unused(records, "print")[0]
    marked = records.withColumn(mark, fingerprint(records.schema, names))
    by: dict[Mapping, list[str]] = {}
    for k, m in usable.items():
        by.setdefault(m, []).append(k)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m, prints in by.items():
        fits = F.col(mark).isin(prints)
        layout, turns = F.when(fits, m.name).otherwise(layout), F.when(fits, _turns(m, there)).otherwise(turns)
    return marked.select(*keys, layout.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def format_turns(turns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, formatted, loss_mask: for each turn, in order, the part of it that counts in the loss, as start (code points from
    the turn's first, that of its start mark) and length; length 0 for all but assistant turns. Null turns: an empty text.
    """
    turns = turns.select(*keys, F.transform("turns", lambda x: F.struct(F.replace(escape(x["role"]), F.lit("\n"), F.lit("&#10;")).alias("role"), escape(x["text"]).alias("text"))).alias("turns"))
    marked = F.transform("turns", lambda x: F.concat(F.lit(START), x["role"], F.lit("\n"), x["text"], F.lit(END + "\n")))
    mask = F.transform("turns", lambda x: F.struct((F.length(x["role"]) + len(START) + 1).alias("start"), F.when(x["role"] == "assistant", F.length(x["text"])).otherwise(0).alias("length")))
    return turns.select(*keys, F.coalesce(F.array_join(marked, ""), F.lit("")).alias("formatted"), F.coalesce(mask, F.expr("array()").cast("array<struct<start:int,length:int>>")).alias("loss_mask"))


def read_back(formatted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, turns (role, text), loss_text and formatted, all from formatted and loss_mask alone."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1 << 30)  # no text holds the mark

    def turn(x: Column) -> Column:
        head = F.substring_index(x, "\n", 1)
        return F.struct(unescape(F.replace(head, F.lit("&#10;"), F.lit("\n"))).alias("role"), unescape(x.substr(F.length(head) + 2, F.length(x) - F.length(head) - len(END) - 2)).alias("text"))

    def loss(x: Column, i: Column) -> Column:
        m = F.get(F.col("loss_mask"), i)
        return unescape(x.substr(m["start"] - len(START) + 1, m["length"]))

    return formatted.select(*keys, F.transform(pieces, turn).alias("turns"), F.array_join(F.transform(pieces, loss), "").alias("loss_text"), "formatted")
