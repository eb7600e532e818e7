"""Operators over append-only ledgers: outbox, deliveries, leases, embeddings and their index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import payload_ref
from .helpers import first_failure, latest_by
from .vectors import dimension_state

EVENT_TYPE = r"^[a-z][a-z0-9_.]*$"


def claim(outbox: DataFrame, limit: int, where: Column | None = None) -> DataFrame:
    """The oldest unpublished rows. Who may claim is a matter of the single writer, not of this query."""
    waiting = outbox.where(F.col("published_ms").isNull() if where is None else where)
    return waiting.orderBy("created_ms", "event_id").limit(limit)


def claim_with_lease(outbox: DataFrame, as_of_ms: int, lease_ms: int, limit: int) -> DataFrame:
    """Unpublished rows that no live lease holds, oldest first, with the lease that they get."""
    free = F.col("published_ms").isNull() & (F.col("claim_until_ms").isNull() | (F.col("claim_until_ms") <= as_of_ms))
    return claim(outbox, limit, free).withColumn("claim_until_ms", F.lit(as_of_ms + lease_ms))


def relay_split(outbox: DataFrame) -> DataFrame:
    """Each row with what the relay does: publish, or reject with the first broken rule. One bad row stops no other."""
    rules = [
        (F.length("event_type") > 160, "event_type_too_long"),
        (~F.col("event_type").rlike(EVENT_TYPE), "event_type_invalid"),
        (F.col("envelope_id") != F.col("event_id"), "envelope_id_mismatch"),
        (F.col("attempt") >= 3, "attempts_exhausted"),
    ]
    return outbox.withColumn("reason_code", first_failure(rules)).withColumn("action", F.when(F.col("reason_code").isNull(), "publish").otherwise("reject"))


def archive_split(outbox: DataFrame, as_of_ms: int, keep_days: int) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): published rows older than so many days are archived."""
    old = F.col("published_ms").isNotNull() & (F.col("published_ms") < as_of_ms - keep_days * 86_400_000)
    return outbox.where(~old), outbox.where(old)


def pending_stats(outbox: DataFrame, as_of_ms: int) -> DataFrame:
    waiting = F.col("published_ms").isNull()
    return outbox.where(waiting).agg(F.count(F.lit(1)).alias("pending"), ((F.lit(as_of_ms) - F.min("created_ms")) / 1000).alias("oldest_age_s"), F.max("attempt").alias("max_attempt"))


def unseen(events: DataFrame, consumed: DataFrame, consumer: str) -> DataFrame:
    """One row for each event that the consumer has not recorded."""
    mine = consumed.where(F.col("consumer") == consumer).select("event_id")
    return events.dropDuplicates(["event_id"]).join(mine, "event_id", "left_anti")


def backoff_seconds(interval: Column, failures: Column) -> Column:
    return F.least(interval * F.pow(F.lit(2), F.least(failures, F.lit(6))), F.lit(30.0))


def reconcile(embedding: DataFrame, material: DataFrame, as_of_ms: int, stale_ms: int) -> DataFrame:
    """Embeddings that need work, with the first reason that holds: orphaned, failed, superseded, not purged, stale."""
    units = material.select("unit_id", F.col("revision"), "status", F.max("revision").over(Window.partitionBy("unit_id")).alias("newest"))
    at = embedding.join(units, ["unit_id", "revision"], "left")
    live = F.col("state") != "tombstoned"
    reason = first_failure([
        (live & F.col("status").isNull(), "orphaned"),
        (live & (F.col("status") == "failed"), "material_failed"),
        (live & (F.col("revision") < F.col("newest")), "superseded"),
        (~live & F.col("vector_ref").isNotNull(), "pending_vector_purge"),
        ((F.col("state") == "pending") & (F.col("updated_ms") < as_of_ms - stale_ms), "stale"),
    ])
    return at.withColumn("reason", reason).where(F.col("reason").isNotNull())


def tombstoned(embedding: DataFrame, doomed: DataFrame, as_of_ms: int) -> DataFrame:
    """The ledger with the doomed rows tombstoned; those already so keep their time."""
    marked = embedding.join(doomed.select("embedding_id", F.lit(True).alias("_doomed")), "embedding_id", "left")
    now = F.coalesce("_doomed", F.lit(False)) & (F.col("state") != "tombstoned")
    return marked.withColumn("updated_ms", F.when(now, as_of_ms).otherwise(F.col("updated_ms"))).withColumn("state", F.when(now, "tombstoned").otherwise(F.col("state"))).drop("_doomed")


def upserted(stored: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Stored and incoming rows, the latest of each key."""
    return latest_by(stored.unionByName(incoming), [key], order)


def ready_embeddings(embedding: DataFrame, material: DataFrame, stream: DataFrame, source: DataFrame, owner: str) -> DataFrame:
    """Ready rows whose material is there, not failed and of that owner; superseded is told, not filtered."""
    newest = material.withColumn("newest", F.max("revision").over(Window.partitionBy("unit_id")))
    mine = stream.join(source.where(F.col("owner") == owner), "source_id").select("stream_id")
    facts = newest.join(mine, "stream_id", "left_semi").where("status <> 'failed'").select("unit_id", "revision", "stream_id", (F.col("revision") < F.col("newest")).alias("superseded"))
    return embedding.where("state = 'ready'").join(facts, ["unit_id", "revision"])


def homogeneous(embedding: DataFrame, column: str = "release") -> DataFrame:
    """At most two distinct releases in use: two mean that vectors of different origin would be mixed."""
    return embedding.where("state = 'ready'").select(column).distinct().orderBy(column).limit(2)


def index_status(embedding: DataFrame) -> DataFrame:
    """Per unit: ready if all its live rows are, else the first state in the order failed, pending."""
    live = embedding.where("state <> 'tombstoned'")
    return live.groupBy("unit_id").agg(
        F.when(F.bool_and(F.col("state") == "ready"), "ready").when(F.bool_or(F.col("state") == "failed"), "failed").otherwise("pending").alias("status"), F.count(F.lit(1)).alias("rows")
    )


def expired(tasks: DataFrame, as_of_ms: int) -> DataFrame:
    """Open tasks past their deadline expire; those without attempts left are exhausted; others stay."""
    return tasks.withColumn("next_state", F.when(~F.col("open"), F.col("state")).when(F.col("deadline_ms") < as_of_ms, "expired").when(F.col("attempt") >= F.col("max_attempts"), "exhausted").otherwise(F.col("state")))


def indexed(events: DataFrame, material: DataFrame, observation: DataFrame, consumed: DataFrame, consumer: str, modalities: list[str], supported: str = "material.upserted", most_chars: int = 4096) -> DataFrame:
    """What an index consumer makes of each event: outcome, and of its material's observations how many are embedded or left out, and why.

    events: event_id, event_type, payload_ref. material: unit_id, revision. observation: unit_id, revision, modality, text. consumed: event_id, consumer. outcome, first that
    holds: unsupported_event_type, invalid_payload_ref, duplicate, event_missing_facts, consumed. Blank texts and too long ones are counted apart;
    other modalities are counted too, so nothing is left out silently. Observations are counted per material before events meet them.
    """
    unit, revision = payload_ref(F.col("payload_ref"))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    wanted = F.col("modality").isin(modalities)
    counts = observation.withColumn("_t", text).groupBy(F.col("unit_id").cast("string").alias("_unit"), F.col("revision").cast("long").alias("_revision")).agg(
        F.count(F.lit(1)).alias("observations"), F.count_if(~wanted).alias("skipped_modality"), F.count_if(wanted & (F.col("_t") == "")).alias("empty_text"),
        F.count_if(wanted & (F.length("_t") > most_chars)).alias("over_bound"), F.count_if(wanted & (F.col("_t") != "") & (F.length("_t") <= most_chars)).alias("embedded"),
    )
    known = material.select(F.col("unit_id").cast("string").alias("_unit"), F.col("revision").cast("long").alias("_revision")).distinct().withColumn("_there", F.lit(True))
    mine = consumed.where(F.col("consumer") == consumer).select("event_id").distinct().withColumn("_before", F.lit(True))
    at = events.withColumn("_unit", unit).withColumn("_revision", revision).join(known, ["_unit", "_revision"], "left").join(counts, ["_unit", "_revision"], "left").join(mine, "event_id", "left")
    outcome = F.coalesce(first_failure([
        (~F.col("event_type").eqNullSafe(F.lit(supported)), "unsupported_event_type"), (F.col("_unit").isNull() | F.coalesce(F.col("_revision") <= 0, F.lit(True)), "invalid_payload_ref"),
        (F.col("_before"), "duplicate"), (F.col("_there").isNull(), "event_missing_facts"),
    ]), F.lit("consumed"))
    names = ["observations", "skipped_modality", "empty_text", "over_bound", "embedded"]
    return at.withColumn("outcome", outcome).select("event_id", "outcome", *[F.when(F.col("outcome") == "consumed", F.coalesce(n, F.lit(0))).otherwise(0).alias(n) for n in names])


def sunk(requests: DataFrame, stored: DataFrame, dimension: int) -> DataFrame:
    """The state of each embedding that was asked for: pending until its vector is in the store, ready once the stored one is the same, else failed with a reason.

    requests: embedding_id, vector, index_dimension. stored: embedding_id, vector_digest of what the store holds. The declared dimension is
    checked against the index and the vector before anything is sent.
    """
    own = requests.withColumn("_check", dimension_state(F.lit(dimension), F.col("index_dimension"), F.col("vector"))).withColumn("_digest", F.sha2(F.array_join(F.transform("vector", lambda x: x.cast("string")), ","), 256))
    at = own.join(stored.groupBy("embedding_id").agg(F.max("vector_digest").alias("_stored")), "embedding_id", "left")
    reason = F.when(F.col("_check") != "ok", F.col("_check")).when(F.col("_stored") != F.col("_digest"), "vector_not_confirmed")
    state = F.when(reason.isNotNull(), "failed").when(F.col("_stored").isNull(), "pending").otherwise("ready")
    return at.select("embedding_id", state.alias("state"), reason.alias("reason_code"))
