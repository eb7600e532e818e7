"""JSON payloads as VARIANT: walks, pointers, texts and bounds as column expressions, without Python.

A walk goes down level by level inside the expression (a fold over the depths whose state is the level's nodes), so
it ends after a stated depth whatever the payload. Nodes are put in document order by their paths: keys in code-point
order, as VARIANT keeps them, places of arrays by number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = "array<struct<path:array<string>,v:variant>>"
VALUES = "array<variant>"
#: Keys that hold a payload's main text, the first that does.
MAIN_KEYS = ("text", "caption", "description", "transcript")
MOST_POINTERS = 32


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN or VOID; null for no value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _text(value: Column) -> Column:
    """The string that a value is, or null."""
    return F.when(F.schema_of_variant(value) == "STRING", value.try_cast("string"))


def _levels(payload: Column, depth: int) -> Column:
    """As many levels as a payload can have, the depth at most: none lies below more brackets than its text opens."""
    return F.least(F.lit(depth), F.coalesce(F.regexp_count(F.to_json(payload), F.lit(r"[\[{]")), F.lit(0)))


def bound(value: Column, result: Callable[[Column], Column]) -> Column:
    """result of a value that is worked out once, however often it is named: inside a fold nothing else shares it."""
    return F.element_at(F.transform(F.array(value), result), 1)


def children(node: Column) -> Column:
    path, value = node["path"], node["v"]
    fields = F.transform(F.map_entries(value.try_cast("map<string,variant>")), lambda e: F.struct(F.concat(path, F.array(e["key"])).alias("path"), e["value"].alias("v")))
    items = F.transform(value.try_cast("array<variant>"), lambda x, i: F.struct(F.concat(path, F.array(F.lpad(i.cast("string"), 10, "0"))).alias("path"), x.alias("v")))
    return F.coalesce(fields.cast(NODES), items.cast(NODES), F.array().cast(NODES))


def _values_below(value: Column) -> Column:
    return F.coalesce(F.map_values(value.try_cast("map<string,variant>")).cast(VALUES), value.try_cast(VALUES), F.array().cast(VALUES))


def main_child(node: Column) -> Column:
    """Of an object with a main key that holds text that key's value alone; all children of others."""

    def chosen(fields: Column) -> Column:
        held = [F.when(F.coalesce(_text(F.try_element_at(fields, F.lit(k))), F.lit("")) != "", F.lit(k)) for k in MAIN_KEYS]
        only = lambda key: F.when(key.isNotNull(), F.array(F.struct(F.concat(node["path"], F.array(key)).alias("path"), F.try_element_at(fields, key).alias("v"))).cast(NODES))
        return bound(F.coalesce(*held), only)

    return F.coalesce(bound(node["v"].try_cast("map<string,variant>"), chosen), children(node))


def _visited(payload: Column, depth: int, below: Callable[[Column], Column], result: Callable[[Column], Column], ends_only: bool = False) -> Column:
    """result of all nodes (path, v) down to a depth, level by level, or of those alone that have none below them."""
    none = F.array().cast(NODES)
    root = F.when(payload.isNotNull(), F.array(F.struct(F.array().cast("array<string>").alias("path"), payload.alias("v"))).cast(NODES)).otherwise(none)
    start = F.struct(root.alias("front"), none.alias("seen"))

    def step(s: Column, _: Column) -> Column:
        level = F.transform(s["front"], lambda n: F.struct(n.alias("n"), below(n).alias("below")))
        met = lambda x: F.filter(x, lambda y: F.size(y["below"]) == 0)["n"] if ends_only else s["front"]
        return bound(level, lambda x: F.struct(F.flatten(x["below"]).cast(NODES).alias("front"), F.concat(s["seen"], met(x)).cast(NODES).alias("seen")))

    return F.aggregate(F.sequence(F.lit(0), _levels(payload, depth)), start, step, lambda s: result(s["seen"]))


def walked(payload: Column, depth: int, below: Callable[[Column], Column] = children) -> Column:
    """All nodes (path, v) down to a depth, the payload itself at depth 0, in document order; empty for no payload."""
    # paths differ, so sorting paths with their places sorts the nodes
    ordered = lambda nodes: F.transform(F.array_sort(F.transform(nodes, lambda n, i: F.struct(n["path"].alias("path"), i.alias("i")))), lambda x: F.get(nodes, x["i"]))
    return _visited(payload, depth, below, ordered)


def payload_text(payload: Column, depth: int = 64) -> Column:
    """All strings, stripped, without blank ones, joined by line ends; empty for no payload."""

    def joined(nodes: Column) -> Column:
        texts = F.transform(nodes, lambda n: F.struct(n["path"].alias("path"), stripped(_text(n["v"])).alias("text")))
        return F.array_join(F.transform(F.array_sort(F.filter(texts, lambda x: F.coalesce(x["text"], F.lit("")) != "")), lambda x: x["text"]), "\n")

    return _visited(payload, depth, children, joined, ends_only=True)


def caption_text(payload: Column, most: int = 4000, depth: int = 12, nodes: int = 500) -> Column:
    """The text to show: strings in order, main keys before others, of the first nodes + 1 nodes down to a depth, `most` characters in all; an ellipsis where it was cut."""
    seen = walked(payload, depth, main_child)
    texts = F.filter(F.transform(F.slice(seen, 1, nodes + 1), lambda n: _text(n["v"])), lambda t: t.isNotNull())
    start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("parts"))

    def add(s: Column, t: Column) -> Column:
        room = F.lit(most) - s["n"]
        fits = room > 0
        part = F.when(fits, F.concat(s["parts"], F.array(F.substring(t, F.lit(1), room.cast("int"))))).otherwise(s["parts"])
        return F.struct(F.when(fits, s["n"] + F.length(t)).otherwise(s["n"]).cast("long").alias("n"), part.cast("array<string>").alias("parts"))

    cut = F.size(seen) > nodes
    return F.aggregate(texts, start, add, lambda s: F.concat(F.array_join(s["parts"], "\n"), F.when((s["n"] >= most) | cut, "…").otherwise("")))


def _paths(pointer: str) -> list[str]:
    """The VARIANT paths that a pointer may mean: a number is a key of an object and a place of an array."""
    out = ["$"]
    for part in pointer.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        mark = "'" if "'" not in part else '"'
        if mark in part:
            raise ValueError("text_field_pointer_invalid")
        steps = [f"[{mark}{part}{mark}]"] + ([f"[{int(part)}]"] if part.isascii() and part.isdigit() else [])
        out = [o + s for o in out for s in steps]
    return out


def declared_text(payload: Column, pointers: list[str], most_bytes: int = 65_536) -> Column:
    """text and reason_code: the strings that declared pointers (~0 and ~1 escaped) lead to, stripped, joined by line ends; too long a text has a reason and is null."""
    if any(not p.startswith("/") or len(p) > 256 for p in pointers):
        raise ValueError("text_field_pointer_invalid")
    found = [F.coalesce(*[F.try_variant_get(payload, path, "variant") for path in _paths(p)]) for p in pointers[:MOST_POINTERS]]
    parts = F.array(*[stripped(_text(x)) for x in found]).cast("array<string>")
    text = F.array_join(F.filter(parts, lambda t: F.coalesce(t, F.lit("")) != ""), "\n")
    long = F.octet_length(text) > most_bytes
    return F.struct(F.when(~long, text).alias("text"), F.when(long, "index_text_size_rejected").alias("reason_code"))


def payload_limits(payload: Column, depth: int = 32, values: int = 4096) -> Column:
    """Why a payload is refused, or null: no object or a number that is not finite (unsupported), too deep or too many values (limit exceeded).

    The payload's own fields are at depth 1. What lies deeper than the limit is not looked at.
    """
    # the kind first: a cast of a text that is no number is dear
    infinite = lambda v: (F.schema_of_variant(v) == "DOUBLE") & ~(F.abs(v.try_cast("double")) < F.lit(float("inf")))
    start = F.struct(F.array(payload).cast(VALUES).alias("front"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("odd"), F.to_json(payload).rlike("Infinity|NaN").alias("suspect"))

    def step(s: Column, _: Column) -> Column:
        front = lambda below: F.when(s["n"] > values, F.array().cast(VALUES)).otherwise(below).cast(VALUES)
        next_state = lambda below: F.struct(front(below).alias("front"), (s["n"] + F.size(below)).cast("long").alias("n"), (s["odd"] | s["suspect"] & F.exists(below, infinite)).alias("odd"), s["suspect"].alias("suspect"))
        return bound(F.flatten(F.transform(s["front"], _values_below)).cast(VALUES), next_state)

    def verdict(s: Column) -> Column:
        deep = F.exists(s["front"], lambda v: F.size(_values_below(v)) > 0)
        return F.when(s["odd"], "observation_payload_unsupported").when((s["n"] > values) | deep, "observation_payload_limit_exceeded")

    levels = F.sequence(F.lit(1), F.greatest(F.lit(1), _levels(payload, depth)))
    return F.when(payload.try_cast("map<string,variant>").isNull(), "observation_payload_unsupported").otherwise(F.aggregate(levels, start, step, verdict))


def tolerant_long(value: Column) -> Column:
    """A 64-bit integer that came as a number or as text; null for others."""
    text = _text(value)
    return F.when(kind(value) == "BIGINT", value.try_cast("long")).when(text.rlike(r"^-?[0-9]{1,19}$"), text.try_cast("long"))
