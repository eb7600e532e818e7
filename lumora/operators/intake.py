"""What an ingest run lets in: observations by ordered rules, source references by intervals, configurations by their schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.payloads import payload_limits
from ..functions.scalars import is_digest
from .helpers import first_failure

# Limits, states and names that reason codes rest on.
MOST_OBSERVATION_BYTES = 64 * 1024
MOST_MATERIAL_BYTES = 4 * 1024 * 1024
MOST_OBSERVATIONS = 1024
MOST_REFERENCES = 1024
MOST_WINDOW_MS = 300_000
QUALITY_STATES = ("partial", "final", "accepted", "rejected", "low_confidence", "failed", "conflict")
APPLICABILITIES = ("", "MODEL_APPLICABILITY_UNSPECIFIED", "MODEL_APPLICABILITY_MODEL_BASED", "MODEL_APPLICABILITY_NOT_APPLICABLE")
NOT_APPLICABLE = APPLICABILITIES[3]
MOST_EXACT_INTEGER = 1 << 53


def _blank(*names: str) -> Column:
    """Whether any of the columns is null or empty."""
    out = F.lit(False)
    for n in names:
        out = out | (F.coalesce(F.col(n), F.lit("")) == "")
    return out


def _given(*names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | (F.coalesce(F.col(n), F.lit("")) != "")
    return out


def _no_digest(name: str) -> Column:
    return ~F.coalesce(is_digest(F.col(name)), F.lit(False))


def _range_invalid(start: str, end: str) -> Column:
    return F.coalesce((F.col(start) < 0) | (F.col(end) <= F.col(start)), F.lit(True))


def contract_reason() -> Column:
    """The first rule of an observation's contract that it breaks, or null. A missing provenance is one without a plugin column's value."""
    outside = lambda n: F.isnan(n) | ~F.col(n).between(0.0, 1.0)
    plain = F.col("applicability") == NOT_APPLICABLE
    model = ("model_release_id", "model_id", "model_version")
    schema = ("schema_id", "schema_version", "schema_digest")
    return first_failure([
        (_blank("observation_id", "stream_id", "source_id", "item_id", "modality", "timing_source"), "missing_observation_identity"),
        (F.col("start_ms").isNull() | F.col("end_ms").isNull(), "missing_time_range"), (_range_invalid("start_ms", "end_ms"), "invalid_half_open_time_range"),
        (_no_digest("content_hash"), "invalid_sha256_digest"), (outside("confidence"), "invalid_confidence"), (outside("timing_confidence"), "invalid_confidence"),
        (F.col("confidence").isNull() & _blank("confidence_unavailable_reason"), "missing_confidence_reason"), (F.coalesce("created_ms", F.lit(0)) <= 0, "missing_creation_time"),
        (~F.coalesce(F.col("quality_state").isin(*QUALITY_STATES), F.lit(False)), "invalid_quality_state"), (F.col("plugin").isNull(), "missing_provenance"),
        (_blank("plugin", "plugin_version", "execution_backend"), "incomplete_provenance"), (_no_digest("artifact_digest"), "invalid_sha256_digest"),
        (plain & (_blank("processor_release_id") | _given(*model, "model_artifact_digest")), "non_model_provenance_invalid"),
        (~plain & _blank(*model), "incomplete_provenance"), (~plain & _no_digest("model_artifact_digest"), "invalid_sha256_digest"),
        (_no_digest("config_hash"), "invalid_sha256_digest"), (_given(*schema) & _blank(*schema), "incomplete_payload_schema"), (_given(*schema) & _no_digest("schema_digest"), "invalid_sha256_digest"),
    ])


def admitted(observations: DataFrame, identities: DataFrame, ledger: DataFrame, declared: DataFrame, window_ms: int, most_bytes: int = MOST_OBSERVATION_BYTES) -> DataFrame:
    """Each observation of a run with the first reason to reject it (null: admitted) and its window's start and end.

    identities: run_id, stream_id, source_id, duration_ms, a row a run. ledger: run_id, item_id, item_start, item_end. declared: run_id,
    item_id, observation_id, where the ledger names an item's observations. Observations have run_id, the contract's columns,
    payload (VARIANT) and n_bytes. Order: identity, ledger, payload, contract, size, range, window; a rejected one is in no window.
    """
    own = identities.select("run_id", F.col("stream_id").alias("_stream"), F.col("source_id").alias("_source"), "duration_ms")
    items = ledger.select("run_id", "item_id", "item_start", "item_end")
    named = declared.select("run_id", "item_id", "observation_id", F.lit(True).alias("_named")).distinct()
    strict = declared.select("run_id", "item_id", F.lit(True).alias("_strict")).distinct()
    at = observations.join(own, "run_id", "left").join(items, ["run_id", "item_id"], "left").join(strict, ["run_id", "item_id"], "left").join(named, ["run_id", "item_id", "observation_id"], "left")
    start = F.floor(F.col("start_ms") / window_ms) * window_ms
    at = at.withColumn("window_start", start).withColumn("window_end", F.least(start + window_ms, F.col("duration_ms")))
    contract = F.concat(F.lit("observation_contract_invalid: "), contract_reason())
    reason = F.coalesce(
        first_failure([
            (~F.col("stream_id").eqNullSafe(F.col("_stream")), "observation_stream_mismatch"), (~F.col("source_id").eqNullSafe(F.col("_source")), "observation_source_mismatch"),
            (F.col("item_start").isNull(), "observation_without_descriptor_ledger"), (F.col("_strict") & F.col("_named").isNull(), "observation_ledger_observation_mismatch"),
        ]),
        payload_limits(F.col("payload")), F.when(~F.coalesce(F.col("applicability").isin(*APPLICABILITIES), F.lit(True)), "model_applicability_invalid"), contract,
        first_failure([
            (F.col("n_bytes") > most_bytes, "observation_too_large"), ((F.col("start_ms") != F.col("item_start")) | (F.col("end_ms") != F.col("item_end")), "observation_ledger_range_mismatch"),
            (F.col("end_ms") > F.col("window_end"), "observation_crosses_window"), ((F.col("item_start") < F.col("window_start")) | (F.col("item_end") > F.col("window_end")), "source_reference_crosses_material_boundary"),
        ]),
    )
    return at.withColumn("reason_code", reason).drop("_stream", "_source", "_strict", "_named")


def rejection_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("reason_code", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def islands(references: DataFrame, keys: list[str]) -> DataFrame:
    """The union of each key's intervals [start_ms, end_ms): touching and nested ones are one island. One pass over each key's rows in order of starts."""
    before = Window.partitionBy(*keys).orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    at = references.select(*keys, "start_ms", "end_ms").withColumn("_new", F.coalesce(F.col("start_ms") > F.max("end_ms").over(before), F.lit(True)).cast("long"))
    at = at.withColumn("island", F.sum("_new").over(Window.partitionBy(*keys).orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, 0)))
    return at.groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("references"))


def uncovered(observations: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """The observations that no single reference of their key contains.

    Both sides are put in one order of starts: a reference that begins at or before an observation contains it if its
    end is not before the observation's, so the greatest end so far decides, whatever the number of references.
    """
    r = references.select(*keys, "start_ms", "end_ms", F.lit(0).alias("_kind"), F.lit(None).cast(observations.schema["observation_id"].dataType).alias("observation_id"))
    o = observations.select(*keys, "start_ms", "end_ms", F.lit(1).alias("_kind"), "observation_id")
    upto = Window.partitionBy(*keys).orderBy("start_ms", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    held = F.max(F.when(F.col("_kind") == 0, F.col("end_ms"))).over(upto)
    return r.unionByName(o).withColumn("_held", held).where("_kind = 1 AND coalesce(_held < end_ms, true)").select(*keys, "observation_id", "start_ms", "end_ms")


def source_coverage(windows: DataFrame, observations: DataFrame, references: DataFrame, most_window_ms: int = MOST_WINDOW_MS) -> DataFrame:
    """Each window with what refuses its fusion (null: nothing) and how its references cover it.

    windows: stream_id, window_start, window_end. references: stream_id, window_start, asset_id, content_hash, start_ms, end_ms.
    observations: stream_id, window_start, observation_id, start_ms, end_ms, n_bytes. One reference or observation that breaks a rule refuses the
    window. Equal references of an asset count once. covered_ms, islands and gaps are those of the union of all valid ranges.
    """
    keys = ["stream_id", "window_start"]
    r = references.join(windows, keys)
    own = first_failure([
        (_blank("asset_id"), "missing_asset_id"), (_no_digest("content_hash"), "invalid_sha256_digest"), (F.col("start_ms").isNull() | F.col("end_ms").isNull(), "missing_source_time_range"),
        (_range_invalid("start_ms", "end_ms"), "invalid_half_open_time_range"), ((F.col("start_ms") < F.col("window_start")) | (F.col("end_ms") > F.col("window_end")), "source_reference_outside_material"),
    ])
    r = r.withColumn("_own", own)
    valid = r.where("_own IS NULL").select(*keys, "window_end", "asset_id", "content_hash", "start_ms", "end_ms")
    by_asset = valid.groupBy(*keys, "asset_id").agg((F.min("content_hash") != F.max("content_hash")).alias("_differs"))
    conflict = by_asset.groupBy(*keys).agg(F.bool_or("_differs").alias("_conflict"))
    counts = valid.select(*keys, "asset_id", "start_ms", "end_ms").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("references"))
    ranks = ["missing_asset_id", "invalid_sha256_digest", "missing_source_time_range", "invalid_half_open_time_range", "source_reference_outside_material"]
    broken = r.where("_own IS NOT NULL").groupBy(*keys).agg(F.min(F.array_position(F.array(*map(F.lit, ranks)), F.col("_own"))).alias("_rank"))
    spans = islands(valid, keys).groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"), F.count(F.lit(1)).alias("islands"), F.min("start_ms").alias("_first"), F.max("end_ms").alias("_last"))
    bare = uncovered(observations, valid, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("uncovered"))
    seen = observations.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), F.max("n_bytes").alias("_largest"), F.sum("n_bytes").alias("_bytes"))
    at = windows
    for other in (conflict, counts, broken, spans, bare, seen):
        at = at.join(other, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    reason = F.coalesce(
        F.when(F.col("window_end") - F.col("window_start") > most_window_ms, "fusion_window_limit_exceeded"), first_failure([(F.col("_rank") == k, code) for k, code in enumerate(ranks, 1)]),
        first_failure([
            (F.col("_conflict"), "fusion_asset_digest_conflict"), (zero("uncovered") > 0, "fusion_observation_source_uncovered"), (F.col("_largest") > MOST_OBSERVATION_BYTES, "fusion_observation_bytes_exceeded"),
            (F.col("observations") > MOST_OBSERVATIONS, "fusion_observation_limit_exceeded"), (F.col("references") > MOST_REFERENCES, "fusion_source_limit_exceeded"),
            (zero("observations") == 0, "fusion_empty_observations"), (F.col("_bytes") > MOST_MATERIAL_BYTES, "fusion_material_bytes_exceeded"),
        ]),
    )
    edges = F.coalesce((F.col("_first") > F.col("window_start")).cast("long") + (F.col("_last") < F.col("window_end")).cast("long") + F.col("islands") - 1, F.lit(1))
    return at.select(
        *keys, "window_end", zero("observations").alias("observations"), zero("references").alias("references"), zero("uncovered").alias("uncovered"), zero("covered_ms").alias("covered_ms"),
        zero("islands").alias("islands"), edges.alias("gaps"), reason.alias("reason_code"),
    )


def configured(configs: DataFrame, schemas: DataFrame) -> DataFrame:
    """Each configuration with defaults filled in and integers restored: config_id, values (path to value) and reason_code (values null).

    configs: config_id, schema_id, values (a map of a JSON pointer to the value's JSON; an object has an entry {} of its own, the configuration
    itself is the pointer ""). schemas: schema_id, path, type, required, default (JSON, null: none). A default is filled in
    where its parent is there as an object and it is not; an explicit null stays. Parents come before children, so
    defaults within defaults are filled too. A whole number written as a float becomes an integer, up to 2 ** 53. One
    aggregate gathers a schema's rows, which its size limit bounds; a configuration is one row.
    """
    entry = F.struct(F.size(F.split("path", "/")).alias("level"), "path", "type", F.coalesce("required", F.lit(False)).alias("required"), "default")
    rules = schemas.groupBy("schema_id").agg(F.array_sort(F.collect_list(entry)).alias("_rules"))
    at = configs.join(rules, "schema_id", "left")
    parent = lambda path: F.regexp_replace(path, "/[^/]*$", "")
    holds = lambda values, path: F.coalesce(F.try_element_at(values, path).startswith("{"), F.lit(False))

    def fill(values: Column, rule: Column) -> Column:
        lacks = ~F.map_contains_key(values, rule["path"]) & holds(values, parent(rule["path"])) & rule["default"].isNotNull()
        return F.when(lacks, F.map_concat(values, F.map_from_arrays(F.array(rule["path"]), F.array(rule["default"])))).otherwise(values)

    filled = F.aggregate(F.coalesce("_rules", F.array().cast(at.schema["_rules"].dataType)), F.col("values"), fill)
    at = at.withColumn("_filled", filled)
    whole = r"^(-?[0-9]+)\.0+$"
    types = F.map_from_entries(F.transform("_rules", lambda r: F.struct(r["path"], r["type"])))
    numeric = lambda k: F.coalesce(F.try_element_at(F.col("_types"), k).isin("integer", "number"), F.lit(False))
    at = at.withColumn("_types", types)
    integers = lambda k, v: F.when(numeric(k) & v.rlike(whole), F.regexp_extract(v, whole, 1)).otherwise(v)
    at = at.withColumn("_values", F.transform_values("_filled", integers))
    # restored ones alone; a number given as an integer is exact
    imprecise = F.exists(F.map_entries("_filled"), lambda e: numeric(e["key"]) & e["value"].rlike(whole) & (F.abs(F.regexp_extract(e["value"], whole, 1).try_cast("decimal(38,0)")) > MOST_EXACT_INTEGER))
    fits = {"integer": "^-?[0-9]+$", "number": r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$", "string": '^".*"$', "boolean": "^(true|false)$", "object": r"^\{", "array": r"^\["}

    def breaks(rule: Column) -> Column:
        value = F.try_element_at(F.col("_values"), rule["path"])
        typed = F.lit(True)
        for name, pattern in fits.items():
            typed = F.when(rule["type"] == name, value.rlike(pattern)).otherwise(typed)
        lost = rule["required"] & value.isNull() & holds(F.col("_values"), parent(rule["path"]))
        return lost | (value.isNotNull() & ~F.coalesce(typed, F.lit(False)))

    reason = F.when(F.col("_rules").isNull(), "schema_invalid").when(F.coalesce(imprecise, F.lit(False)), "config_integer_precision_rejected").when(F.exists("_rules", breaks), "plugin_config_invalid")
    at = at.withColumn("reason_code", reason)
    return at.select("config_id", F.when(F.col("reason_code").isNull(), F.col("_values")).alias("values"), "reason_code")

