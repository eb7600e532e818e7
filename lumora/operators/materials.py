"""Operators over versioned material units: search, reads, lineage, append, hydration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_digest
from .helpers import first_failure, latest_by


class RequestError(ValueError):
    """A request that no plan is made for; its text is a stable code."""


@dataclass
class SearchRequest:
    """A keyword search; unset fields add no predicate."""

    owner: str
    query: str = ""
    start_ms: int | None = None
    end_ms: int | None = None
    tags: list[str] = field(default_factory=list)
    modalities: list[str] = field(default_factory=list)
    min_confidence: float | None = None
    limit: int = 20
    mode: str = "keyword"

    def check(self) -> None:
        """Raises the code of the first broken rule."""
        rules = [
            (self.mode not in ("keyword", "semantic"), "search_mode_invalid"),
            (not 1 <= self.limit <= 100, "search_limit_invalid"),
            (len(self.query) > 2000, "search_query_too_long"),
            (len(self.tags) > 32 or len(self.modalities) > 32, "search_filters_too_many"),
            (self.start_ms is not None and self.start_ms < 0, "search_range_invalid"),
            (self.end_ms is not None and self.end_ms <= (self.start_ms or 0), "search_range_invalid"),
            (self.min_confidence is not None and not 0 <= self.min_confidence <= 1, "search_confidence_invalid"),
            (self.mode == "semantic" and not self.query.strip(), "semantic_query_required"),
            (self.mode == "semantic" and bool(self.tags or self.modalities or self.start_ms is not None or self.end_ms is not None or self.min_confidence is not None), "semantic_filters_unsupported"),
        ]
        for bad, code in rules:
            if bad:
                raise RequestError(code)


def owned(df: DataFrame, stream: DataFrame, source: DataFrame, owner: str) -> DataFrame:
    """Rows of streams whose source has that owner. The filter reaches the source scan; AQE broadcasts it if it is small."""
    mine = stream.join(source.where(F.col("owner") == owner), "source_id").select("stream_id")
    return df.join(mine, "stream_id", "left_semi")


def latest_revision(material: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return latest_by(material, keys or ["unit_id"], [F.desc("revision")])


def literal_text(column: str, query: str) -> Column:
    """Case-insensitive substring; no character of the query is a wildcard."""
    return F.contains(F.lower(F.col(column)), F.lower(F.lit(query)))


def has_tags(tags: str, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), F.col(tags))) == 0


def keyword_search(material: DataFrame, observation: DataFrame, stream: DataFrame, source: DataFrame, request: SearchRequest) -> DataFrame:
    """The latest revisions that match, newest start first.

    The latest revision is picked first and failed ones go afterwards, so a failed latest revision hides its unit.
    Modality and confidence must hold on one observation; an unknown confidence never matches.
    """
    request.check()
    found = owned(latest_revision(material), stream, source, request.owner).where("status <> 'failed'")
    if request.query:
        found = found.where(literal_text("search_text", request.query))
    if request.start_ms is not None:
        found = found.where(F.col("end_ms") > request.start_ms)
    if request.end_ms is not None:
        found = found.where(F.col("start_ms") < request.end_ms)
    if request.tags:
        found = found.where(has_tags("tags", request.tags))
    if request.modalities or request.min_confidence is not None:
        fits = observation
        if request.modalities:
            fits = fits.where(F.col("modality").isin(request.modalities))
        if request.min_confidence is not None:
            fits = fits.where(F.col("confidence") >= request.min_confidence)
        found = found.join(fits, ["unit_id", "revision"], "left_semi")
    return found.orderBy(F.desc("start_ms"), "unit_id").limit(request.limit)


def lineage(material: DataFrame) -> DataFrame:
    """Every revision with the one before it and whether a newer one exists."""
    w = Window.partitionBy("unit_id")
    return material.withColumn("prev_revision", F.lag("revision").over(w.orderBy("revision"))).withColumn("superseded", F.col("revision") < F.max("revision").over(w))


def get_material(material: DataFrame, unit_id: int, revision: int | None = None) -> DataFrame:
    """One revision, the latest if none is named, with whether it is superseded."""
    rows = lineage(material.where(F.col("unit_id") == unit_id))
    return rows.where(F.col("revision") == revision) if revision is not None else rows.where(~F.col("superseded"))


def append_revisions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """What becomes of each incoming revision: inserted, replayed (same content) or conflict. Nothing stored changes."""
    known = stored.select("unit_id", "revision", F.col("content_hash").alias("stored_hash"))
    return incoming.join(known, ["unit_id", "revision"], "left").withColumn(
        "outcome", F.when(F.col("stored_hash").isNull(), "inserted").when(F.col("stored_hash") == F.col("content_hash"), "replayed").otherwise("conflict")
    )


def hydrate(hits: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Hits in their order with the facts they point to; a hit without facts stays, unresolved."""
    return hits.join(facts.withColumn("_there", F.lit(True)), keys, "left").withColumn("resolved", F.coalesce("_there", F.lit(False))).drop("_there")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page and the number of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # total is one row


def merge_observations(observations: DataFrame) -> DataFrame:
    """One row for each observation id, and whether the id came with different contents."""
    return observations.groupBy("observation_id").agg(F.count(F.lit(1)).alias("received"), F.min("content_hash").alias("content_hash"), (F.min("content_hash") != F.max("content_hash")).alias("conflict"))


def video_groups(material: DataFrame) -> DataFrame:
    """Per stream: extent, distinct tags and modalities, members in order."""
    return material.groupBy("stream_id").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count_distinct("unit_id").alias("n_units"),
        F.array_join(F.array_sort(F.collect_set("tag_brand")), ",").alias("tags"), F.array_join(F.array_sort(F.collect_set("modality")), ",").alias("modalities"),
    )


def catalog_union(builtin: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """All overrides, and the built-in rows that none overrides."""
    return override.unionByName(builtin.join(override.select(key), key, "left_anti"))


def next_revision(material: DataFrame, keys: list[str]) -> DataFrame:
    """The revision that a key's next row gets."""
    return material.groupBy(*keys).agg((F.coalesce(F.max("revision"), F.lit(0)) + 1).alias("next_revision"))


def validated(units: DataFrame) -> DataFrame:
    """Each unit with the first rule of its own that it breaks, or null: identity, range, digest, confidence, status, revision."""
    status = ("partial", "fast_ready", "enriched", "failed", "conflict", "low_confidence", "no_observations")
    label = F.coalesce(F.trim(F.col("unit_id").cast("string")), F.lit(""))
    confidence = F.col("confidence")
    return units.withColumn("reason_code", first_failure([
        ((label == "") | (F.length(label) > 256), "missing_material_identity"), (F.coalesce((F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms")), F.lit(True)), "invalid_half_open_time_range"),
        (~F.coalesce(is_digest(F.col("content_hash")), F.lit(False)), "invalid_sha256_digest"), (F.isnan(confidence) | ~confidence.between(0.0, 1.0), "invalid_confidence"),
        (~F.coalesce(F.col("status").isin(*status), F.lit(False)), "invalid_material_status"), (F.coalesce("revision", F.lit(0)) <= 0, "invalid_revision"),
    ]))


def merged_references(references: DataFrame, keys: list[str], most: int = 1024) -> DataFrame:
    """Per key: how many different references (asset, range) there are, and why they cannot stand together, or null.

    An asset with two digests is a conflict; so many ranges of one asset count as often as they differ. Sums are taken by asset first, so
    a key with many references is combined before it meets.
    """
    once = references.select(*keys, "asset_id", "start_ms", "end_ms").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("references"))
    by_asset = references.groupBy(*keys, "asset_id").agg((F.min("content_hash") != F.max("content_hash")).alias("_differs"))
    differs = by_asset.groupBy(*keys).agg(F.bool_or("_differs").alias("_conflict"), F.count(F.lit(1)).alias("assets"))
    reason = first_failure([(F.col("_conflict"), "fusion_asset_digest_conflict"), (F.col("references") > most, "fusion_source_limit_exceeded")])
    return once.join(differs, keys).select(*keys, "references", "assets", reason.alias("reason_code"))
