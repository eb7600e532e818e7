"""Scalar functions as column expressions, and two small helpers for documents of any depth."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIGEST = r"^sha256:[0-9a-f]{64}$"


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def is_digest(column: Column) -> Column:
    return column.rlike(DIGEST)


def asset_id(digest_column: Column) -> Column:
    return F.concat(F.lit("asset-"), F.substring(digest_column, 8, 12))


def derived_id(prefix: str, *parts: Column) -> Column:
    """prefix and 32 hex digits of the SHA-256 of the parts joined by a bar."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 32))


def seconds_to_ms(text: Column) -> Column:
    """Milliseconds of a decimal number of seconds with at most three places; null if it is not one."""
    return F.when(text.rlike(r"^\d+(\.\d{1,3})?$"), (text.cast("decimal(20,3)") * 1000).cast("long"))


def ms_to_clock(ms: Column) -> Column:
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def comma_list(text: Column, most: int = 32) -> Column:
    """Trimmed distinct non-empty parts between commas of either width."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.split(text, "[,，]"), lambda x: F.trim(x)), lambda x: x != "")), 1, most)


def payload_ref(ref: Column) -> tuple[Column, Column]:
    """Unit and revision of material:<unit>:<revision>, split from the right; null revision if it is not one."""
    pattern = r"^material:(.+):([0-9]+)$"
    return F.nullif(F.regexp_extract(ref, pattern, 1), F.lit("")), F.nullif(F.nullif(F.regexp_extract(ref, pattern, 2), F.lit("")).cast("long"), F.lit(0).cast("long"))


def index_key(key: Column) -> dict[str, Column]:
    """Prefix, dimension and version of an index key."""
    pattern = r"^(.+)_d([0-9]+)_v([0-9]+)$"
    return {"prefix": F.regexp_extract(key, pattern, 1), "dimension": F.regexp_extract(key, pattern, 2).cast("int"), "version": F.regexp_extract(key, pattern, 3).cast("int")}


def memory_bytes(text: Column) -> Column:
    """Bytes of 1Gi, 1.5Gi, 512Mi (powers of 1024), 1g, 64k (powers of 1000) or a whole number; 0 if it is none of these."""
    low = F.lower(F.trim(text))
    n = F.trim(F.regexp_extract(low, r"^(.*?)([kmg]i?)?$", 1))
    unit = F.regexp_extract(low, r"([kmg]i?)$", 1)
    power = F.when(unit.startswith("k"), 1).when(unit.startswith("m"), 2).otherwise(3)
    scaled = F.when(n.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), n.cast("double") * F.pow(F.when(unit.endswith("i"), 1024).otherwise(1000), power)).cast("long")
    whole = F.when(n.rlike(r"^[+-]?[0-9]{1,18}$"), n.cast("long"))
    return F.coalesce(F.when(unit != "", scaled).otherwise(whole), F.lit(0).cast("long"))


def block_text(blocks: Column, most_blocks: int = 256, most_chars: int = 4096) -> Column:
    """Non-blank blocks, stripped, joined by line ends; null where there are too many or the text is too long."""
    parts = F.filter(F.transform(blocks, lambda x: F.trim(x)), lambda x: x != "")
    text = F.array_join(parts, "\n")
    return F.when((F.size(blocks) <= most_blocks) & (F.length(text) <= most_chars), text)


def model_text(text: Column, most_chars: int = 4096) -> Column:
    """A model's one text, stripped; null where it is blank or too long."""
    text = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when((text != "") & (F.length(text) <= most_chars), text)


def model_text_reason(text: Column, most_chars: int = 4096) -> Column:
    """Why a model's text is refused, or null."""
    stripped = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(text.isNull(), "input_payload_missing_text").when(stripped == "", "input_text_empty").when(F.length(stripped) > most_chars, "input_text_exceeds_bound")


def hours_before(at_ms: Column, hours: Column) -> Column:
    """A stated time less some hours, in milliseconds."""
    return at_ms - hours * 3_600_000


def most_keeps(duration_ms: Column, interval_ms: Column) -> Column:
    """How many frames or windows an interval between them allows at most."""
    return F.when(duration_ms <= 0, F.lit(1).cast("long")).otherwise(F.floor(duration_ms / interval_ms) + 1)


def normalised_box(box: Column, width: Column, height: Column) -> Column:
    return F.transform(box, lambda p: F.struct(F.round(p["x"] / width, 6).alias("x"), F.round(p["y"] / height, 6).alias("y")))


def merged_states(states: Column, changes: Column) -> Column:
    """A map with another's entries on top."""
    return F.map_concat(F.map_filter(states, lambda k, _: ~F.coalesce(F.map_contains_key(changes, k), F.lit(False))), changes)


def without_keys(reasons: Column, gone: Column) -> Column:
    return F.map_filter(reasons, lambda k, _: ~F.array_contains(gone, k))


def retry_delay_ms(base: Column, attempt: Column) -> Column:
    return F.least(base * F.pow(F.lit(2), attempt - 1), F.lit(1000)).cast("long")


def canonical_digest(text: Column) -> Column:
    """SHA-256 of the JSON with sorted keys and no spaces; null if it does not parse."""

    def each(values: pd.Series) -> pd.Series:
        return pd.Series([_canonical(v) for v in values], dtype=object)

    return F.pandas_udf(each, "string")(text)


def _canonical(value: str | None) -> str | None:
    try:
        return hashlib.sha256(json.dumps(json.loads(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    except (TypeError, ValueError):
        return None


def payload_text(text: Column) -> Column:
    """All strings of a JSON payload, in key order, joined by line ends; empty if it does not parse."""

    def each(values: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(_strings(v)) for v in values], dtype=object)

    return F.pandas_udf(each, "string")(text)


def _strings(value: str | None) -> list[str]:
    def walk(x) -> list[str]:
        if isinstance(x, str):
            return [x.strip()] if x.strip() else []
        items = [x[k] for k in sorted(x)] if isinstance(x, dict) else x if isinstance(x, list) else []
        return [s for y in items for s in walk(y)]

    try:
        return walk(json.loads(value))
    except (TypeError, ValueError):
        return []


def payload_bounds(text: Column, depth: int = 32, nodes: int = 4096) -> Column:
    """Why a payload is out of bounds, or null: payload_invalid, payload_too_deep, payload_too_large, payload_number_invalid."""

    def each(values: pd.Series) -> pd.Series:
        return pd.Series([_bounds(v, depth, nodes) for v in values], dtype=object)

    return F.pandas_udf(each, "string")(text)


def _bounds(value: str | None, depth: int, nodes: int) -> str | None:
    try:
        stack, n = [(json.loads(value), 1)], 0
    except (TypeError, ValueError):
        return "payload_invalid"
    while stack:
        x, level = stack.pop()
        n += 1
        if level > depth:
            return "payload_too_deep"
        if n > nodes:
            return "payload_too_large"
        if isinstance(x, float) and x - x != 0:
            return "payload_number_invalid"
        stack += [(y, level + 1) for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())]
    return None
