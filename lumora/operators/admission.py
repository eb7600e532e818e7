"""Admission decisions: media formats, target nodes, task graphs and enrichment tasks, each by the first rule that fails."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.payloads import bound, kind
from ..functions.scalars import derived_id, memory_bytes
from .helpers import first_failure, overlap_join

# Container and codec names, colour numbers, limits and reason codes that results must equal.
CONTAINERS = {
    "video/quicktime": "mov", "audio/x-m4a": "m4a", "video/x-matroska": "mkv", "audio/x-matroska": "mkv", "video/webm": "webm", "audio/webm": "webm",
    "video/mpegts": "mpegts",
}
OTHER_CONTAINERS = {
    "video/x-msvideo": "avi", "video/x-flv": "flv", "application/ogg": "ogg", "audio/ogg": "ogg", "video/x-ms-asf": "asf", "video/x-ms-wmv": "asf",
    "video/x-wmv": "asf", "video/x-mjpeg": "mjpeg", "audio/x-wav": "wav", "video/x-dv": "dv", "video/x-msmpeg": "msmpeg", "video/x-mpeg": "mpeg_es",
    "audio/x-flac": "flac",
}
ELEMENTARY_STREAMS = [
    "video/x-h264", "video/x-h265", "video/x-vp8", "video/x-vp9", "video/x-av1", "video/x-mpeg", "video/mpeg", "audio/mpeg", "audio/x-ac3",
    "audio/x-eac3", "audio/x-dts",
]
CODECS = {
    "video/x-h264": "h264", "video/x-h265": "h265", "video/x-vp8": "vp8", "video/x-vp9": "vp9", "video/x-av1": "av1", "video/x-prores": "prores",
    "video/x-dnxhd": "dnxhd", "video/x-mpeg2": "mpeg2", "video/x-msmpeg": "msmpeg", "video/x-vc1": "vc1", "image/jp2": "jpeg2000",
    "audio/mpeg": "mpeg", "audio/x-opus": "opus", "audio/x-vorbis": "vorbis", "audio/x-raw": "pcm", "audio/x-ac3": "ac3", "audio/x-eac3": "eac3",
    "audio/x-dts": "dts", "audio/x-truehd": "truehd", "audio/x-flac": "flac", "audio/x-wav": "wav",
}
VIDEO_CODECS = ["video/x-h264", "video/x-h265", "video/x-vp8", "video/x-vp9"]
AUDIO_CODECS = ["audio/x-opus", "audio/x-vorbis", "audio/x-raw"]
#: name: (primaries, transfer, matrix)
COLORIMETRY = {
    "bt601": (4, 16, 4), "bt709": (1, 5, 3), "smpte240m": (5, 6, 5), "bt2020": (7, 11, 6), "bt2020-10": (7, 13, 6), "bt2100-pq": (7, 14, 6),
    "bt2100-hlg": (7, 15, 6),
}
PQ, HLG, BT2020 = 14, 15, 7
MOST_BITS, CHROMA, MOST_CHANNELS = 8, "4:2:0", 2
NODE_STATES = ["ready", "candidate", "enrolling"]
SHARED_MEMORY = ["cpu_shared_memory", "cuda_ipc", "metal_shared_memory"]
ACCELERATORS = ["metal", "coreml", "cuda", "tensorrt"]
HEARTBEAT_S = 60
PLACEMENTS = ["data_plane_local", "object_ref_allowed"]
JOINS = ["same_item", "same_stream_window", "window_contains"]
MOST_NODES, MOST_EDGES, MOST_ATTEMPTS, MOST_TASKS = 128, 1024, 16, 16384
MOST_LISTED = 32
FUSION_NODE = "timeline_fusion"
IDENTITY_FIELDS = ("plugin_version", "artifact_digest", "config_hash", "config_id", "release_id", "execution_mode", "input_selector")
DELAYED_FIELDS = ("id", "plugin_id", "plugin_version", "artifact_digest", "config_id", "config_hash", "consumes", "produces", "deadline_ms", "max_attempts")


def sanitised(text: Column) -> Column:
    """ASCII letters in lower case and digits; whatever is between them is one underscore, none at the ends; 'unknown' if nothing is left."""
    return F.coalesce(F.nullif(F.btrim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", "_")), F.lit("_")), F.lit("")), F.lit("unknown"))


def _named(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain(*table.items()))), key)


def colorimetry(text: Column) -> Column:
    """Struct of primaries, transfer and matrix of a name or of range:matrix:transfer:primaries; fields are null where neither."""
    low = F.lower(F.trim(text))
    parts = F.transform(F.split(low, ":"), lambda x: F.when(F.trim(x).rlike(r"^\+?[0-9]{1,10}$"), F.trim(x).cast("long")))
    whole = (F.size(parts) == 4) & F.forall(parts, lambda x: x.isNotNull() & (x < 1 << 32))

    def field(k: int, at: int) -> Column:
        named = F.coalesce(*[F.when(low == name, F.lit(values[k]).cast("long")) for name, values in COLORIMETRY.items()])
        return F.coalesce(named, F.when(whole, F.get(parts, at)))

    return F.struct(field(0, 3).alias("primaries"), field(1, 2).alias("transfer"), field(2, 1).alias("matrix"))


def colorimetry_rejection(text: Column) -> Column:
    """The code of a high dynamic range or a wide gamut, or null: what cannot be read is no reason."""
    low, fields = F.lower(F.trim(text)), colorimetry(text)
    return first_failure([
        ((fields["transfer"] == PQ) | low.contains("smpte2084") | low.contains("bt2100-pq"), "unsupported_transfer_characteristics_pq"),
        ((fields["transfer"] == HLG) | low.contains("hlg") | low.contains("arib-std-b67"), "unsupported_transfer_characteristics_hlg"),
        ((fields["primaries"] == BT2020) | low.contains("bt2020") | low.contains("bt2100"), "unsupported_color_primaries_bt2020"),
    ])


def _implied_bits(codec: Column, profile: Column) -> Column:
    """The bit depth that a codec and its profile fix, or null where they leave it open."""
    p = F.lower(F.trim(profile))
    deep = F.when(p.rlike("(^|-)10(-|$)"), 10).when(p.rlike("(^|-)12(-|$)"), 12)
    h265 = F.when(p.startswith("main") & ~p.contains("4:4:4"), 8)
    h264 = F.when(p.isin("baseline", "constrained-baseline", "main", "high", "progressive-high"), 8)
    vp9 = F.when(p.isin("0", "1"), 8).when(p.isin("2", "3"), 10)
    return F.when(codec == "video/x-vp8", 8).when(codec == "video/x-h265", F.coalesce(deep, h265)).when(codec == "video/x-h264", F.coalesce(deep, h264)).when(codec == "video/x-vp9", vp9)


def container_rejection(container: Column) -> Column:
    other = F.concat(F.lit("unsupported_container_"), F.coalesce(_named(OTHER_CONTAINERS, container), sanitised(container)))
    return (F.when(container.isNull(), "unknown_source_container").when(container.isin(list(CONTAINERS)), F.lit(None).cast("string"))
        .when(container.isin(ELEMENTARY_STREAMS), "unsupported_container_raw_es").otherwise(other))


def track_admission(tracks: DataFrame) -> DataFrame:
    """tracks (kind, container, codec, profile, bit_depth, chroma, colorimetry, mpegversion, channels) with reason_code, null where admitted.

    Outer dimensions come first: container, codec, bit depth, colour, chroma; for audio codec, object type, channels.
    What is not known is never taken as supported.
    """
    c = F.col
    bits = F.coalesce(c("bit_depth").cast("int"), _implied_bits(c("codec"), c("profile")))
    chroma = F.coalesce("chroma", F.when(c("codec") == "video/x-vp8", CHROMA))
    codec = F.concat(F.lit("unsupported_codec_"), F.coalesce(_named(CODECS, c("codec")), sanitised(c("codec"))))
    no_codec = F.when(c("codec").isNull(), "unknown_source_codec")
    video = F.coalesce(
        no_codec, F.when(~c("codec").isin(VIDEO_CODECS), codec), F.when(bits.isNull(), "unknown_source_bit_depth"),
        F.when(bits > MOST_BITS, F.concat(F.lit("unsupported_bit_depth_"), bits.cast("string"), F.lit("bit"))), colorimetry_rejection(c("colorimetry")),
        F.when(chroma.isNull(), "unknown_source_chroma_format"), F.when(chroma != CHROMA, F.concat(F.lit("unsupported_chroma_format_"), sanitised(chroma))),
    )
    mpeg = F.coalesce(
        F.when(c("mpegversion").isNull(), "unknown_source_codec_mpegversion"), F.when(c("mpegversion") != 4, "unsupported_codec_mp3"),
        F.when(c("profile").isNull(), "unknown_source_codec_profile"), F.when(F.lower("profile") != "lc", F.concat(F.lit("unsupported_codec_aac_"), sanitised(c("profile")))),
    )
    audio = F.coalesce(
        no_codec, F.when(c("codec") == "audio/mpeg", mpeg), F.when(~c("codec").isin([*AUDIO_CODECS, "audio/mpeg"]), codec),
        F.when(F.coalesce("channels", F.lit(0)) == 0, "unknown_channel_layout"), F.when(c("channels") > MOST_CHANNELS, "unsupported_channel_layout_multichannel"),
    )
    return tracks.withColumn("reason_code", F.coalesce(container_rejection(c("container")), F.when(c("kind") == "video", video).otherwise(audio)))


def node_admission(pairs: DataFrame) -> DataFrame:
    """Each plugin beside its target node, with reason_code: the first check that fails, null where the node is eligible.

    Of the node (columns null if it is not registered): node_id, status, heartbeat_age_s, co_located, artifacts (array), platform, arch,
    accelerators (array), cpu_cores, memory_bytes. Of the plugin: plugin_id, form, memory_kinds (array), provider, cpu, memory, digest,
    data_plane_node_id.
    """
    c, none = F.col, F.array().cast("array<string>")
    local = F.coalesce("co_located", F.lit(False)) | c("node_id").eqNullSafe(c("data_plane_node_id"))
    shares = F.arrays_overlap(F.coalesce("memory_kinds", none), F.array(*map(F.lit, SHARED_MEMORY)))
    form, artifacts = F.coalesce("form", F.lit("local_native")), F.coalesce("artifacts", none)
    provider = F.lower("provider")
    apple = F.coalesce((F.lower("platform") == "macos") & (F.lower("arch") == "aarch64"), F.lit(False))
    rules = [
        (c("node_id").isNull(), "node_not_found"),
        *[(c("status") == s, "node_" + s) for s in ("revoked", "offline", "draining")],
        (~F.coalesce(c("status").isin(NODE_STATES), F.lit(False)), "node_not_ready"),
        (c("heartbeat_age_s") > HEARTBEAT_S, "node_heartbeat_stale"),
        (shares & ~local, "data_locality_violation"),
        ((form == "container") & ~F.array_contains(artifacts, "container"), "container_runtime_unsupported"),
        ((form == "local_native") & ~F.array_contains(artifacts, "local_native"), "native_runtime_unsupported"),
        (F.lower("plugin_id").contains("mlx") & ~apple, "unsupported_platform"),
        (provider.isin(ACCELERATORS) & ~F.array_contains(F.coalesce("accelerators", none), provider), "accelerator_not_available"),
        (F.coalesce("cpu_cores", F.lit(1)) < F.coalesce(c("cpu").try_cast("double"), F.lit(1.0)), "insufficient_cpu"),
        ((c("memory_bytes") > 0) & (c("memory_bytes") < memory_bytes(F.coalesce("memory", F.lit("512Mi")))), "insufficient_memory"),
        (~F.coalesce(c("digest").startswith("sha256:") & (F.length("digest") == 71), F.lit(False)), "digest_mismatch"),
    ]
    return pairs.withColumn("reason_code", first_failure(rules))


def _truthy(value: Column) -> Column:
    """Whether a VARIANT is given and neither null, false, zero nor empty."""
    of = kind(value)
    size = F.when(of == "ARRAY", F.size(value.try_cast("array<variant>"))).when(of == "OBJECT", F.size(value.try_cast("map<string,variant>")))
    return F.coalesce(F.when(of == "STRING", value.try_cast("string") != "").when(of == "BOOLEAN", value.try_cast("boolean")).when(size.isNotNull(), size > 0).when(of == "VOID", F.lit(False)).otherwise(value.try_cast("double") != 0), F.lit(False))


def _delayed_breaks(entry: Column, own: dict | None) -> Column:
    """Whether a delayed enrichment breaks its rules. One with a release is free in its kind; one without must be the one that is built in, if any is."""
    at = lambda name, as_type: F.try_variant_get(entry, f"$.{name}", as_type)
    given = lambda name: _truthy(at(name, "variant"))
    lacks = kind(entry) != "OBJECT"
    for name in DELAYED_FIELDS:
        lacks = lacks | ~given(name)
    number = lambda name, most: F.coalesce(at(name, "long").between(1, most), F.lit(False))
    released = (F.coalesce(at("execution_mode", "string"), F.lit("")) == "async_enrichment") & ~given("required") & number("max_attempts", MOST_ATTEMPTS) & number("deadline_ms", 300_000)
    built_in = F.lit(False)
    if own:
        lists = lambda name: F.array_join(F.array_sort(at(name, "array<string>")), ",")
        built_in = F.coalesce((at("id", "string") == own["id"]) & (at("plugin_id", "string") == own["plugin_id"]) & (lists("consumes") == ",".join(sorted(own["consumes"]))) & (lists("produces") == ",".join(sorted(own["produces"]))), F.lit(False)) & ~given("required")
    return lacks | F.when(given("release_id"), ~released).otherwise(~built_in)


def _extension_errors(columns: list[str], own: dict | None) -> Column:
    """An entry for each optional part of a node that breaks its rule; parts that the table lacks are not given."""
    c, none = F.col, F.lit(None).cast("string")
    blank = F.lit(False)
    for name in IDENTITY_FIELDS:
        if name in columns:
            blank = blank | F.coalesce(F.trim(name) == "", F.lit(False))
    found = [F.when(blank, "invalid_orchestration_plugin_identity")]
    for name in ("input_contracts", "output_contracts"):
        if name in columns:
            listed = c(name).try_cast("array<variant>")
            wrong = listed.isNull() | (F.size(listed) > MOST_LISTED)
            found.append(F.when(c(name).isNotNull() & wrong, "invalid_orchestration_payload_contract"))
    policy = F.lit(False)
    if "execution_policy" in columns:
        policy = c("execution_policy").isNotNull() & c("execution_policy").try_cast("map<string,variant>").isNull()
        found.append(F.when(policy, "invalid_orchestration_execution_policy"))
    if "delayed_enrichments" in columns:
        entries = c("delayed_enrichments").try_cast("array<variant>")
        wrong = (c("node_id") != FUSION_NODE) | entries.isNull() | (F.size(entries) > MOST_LISTED) | F.coalesce(F.exists(entries, lambda e: _delayed_breaks(e, own)), F.lit(False))
        found.append(F.when(c("delayed_enrichments").isNotNull() & ~policy & wrong, "invalid_orchestration_delayed_enrichment"))
    return F.array_compact(F.array(*found, none))


def _cyclic(edges: Column) -> Column:
    """Whether edges (from_id, to_id) hold a cycle: those without an edge before them are taken until none is left that goes. No path is longer than the edges or the nodes of a valid graph are many."""
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(edges), F.lit(MOST_NODES))))
    going = lambda left: bound(left["to_id"], lambda ends: F.filter(left, lambda e: F.array_contains(ends, e["from_id"])))
    return F.aggregate(rounds, edges, lambda left, _: going(left), lambda left: F.size(left) > 0)


def graph_rule_failures(nodes: DataFrame, edges: DataFrame, built_in: dict | None = None) -> DataFrame:
    """(run_id, reason, n) of the rules that a submitted graph breaks; sizes first, then nodes, then edges, then cycles, each only if what is before holds.

    nodes: run_id, position, node_id, plugin_id, deadline_ms, max_attempts, placement, consumes, produces; optional are the identity's texts and, as
    VARIANT, input_contracts, output_contracts, execution_policy and delayed_enrichments. edges: run_id, position, from_id, to_id,
    modality, join_policy. A node or an edge counts for its first rule, a node that breaks none for each of its optional parts that does; a repeated one is
    an error where an earlier one was valid. built_in: the one delayed enrichment (id, plugin_id, consumes, produces) that needs no release.
    """
    c = F.col
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    repeats = lambda x: F.size(F.array_distinct(x)) < F.size(x)
    nodes = nodes.withColumn("node_id", F.trim("node_id")).withColumn("placement", F.lower(F.trim("placement")))
    unnamed = F.when(blank(c("node_id")) | blank(c("plugin_id")), "invalid_orchestration_node")
    own = F.coalesce(unnamed, first_failure([
        (F.coalesce("deadline_ms", F.lit(0)) <= 0, "invalid_orchestration_node_deadline"), (~F.coalesce("max_attempts", F.lit(1)).between(1, MOST_ATTEMPTS), "invalid_orchestration_attempt_budget"),
        (~F.coalesce("placement", F.lit(PLACEMENTS[0])).isin(PLACEMENTS), "invalid_orchestration_placement"), (repeats(c("consumes")) | repeats(c("produces")), "duplicate_orchestration_modality"),
    ]))
    known = F.struct((F.coalesce("placement", F.lit(PLACEMENTS[0])) != PLACEMENTS[0]).alias("away"), "produces", "consumes")
    nodes = nodes.select("run_id", F.struct(c("node_id").alias("id"), "position", own.alias("own"), _extension_errors(nodes.columns, built_in).alias("extra"), known.alias("known")).alias("node"))
    policy = F.lower(F.trim(F.coalesce("join_policy", F.lit(JOINS[0]))))
    edges = edges.select("run_id", F.struct(F.trim("from_id").alias("from_id"), F.trim("to_id").alias("to_id"), F.trim("modality").alias("modality"), policy.alias("join_policy")).alias("edge"))
    # nodes and edges without a run do not belong together
    rows = nodes.unionByName(edges, allowMissingColumns=True).withColumns({"part": F.when(c("run_id").isNull(), c("node").isNotNull()), "at": F.monotonically_increasing_id()})
    run = Window.partitionBy("run_id", "part")
    # windows read the rows of a run as they come from one sort: a run that is too large is counted, not held; of the others one row keeps the lists
    rows = rows.withColumns({"n_nodes": F.count("node").over(run), "n_edges": F.count("edge").over(run), "first": F.min("at").over(run)})
    size = first_failure([((c("n_nodes") == 0) | (c("n_nodes") > MOST_NODES), "invalid_orchestration_node_count"), (c("n_edges") > MOST_EDGES, "invalid_orchestration_edge_count")])
    rows = rows.withColumn("size", size)
    lists = {name + "s": F.collect_list(F.when(c("size").isNull(), c(name))).over(run) for name in ("node", "edge")}
    runs = rows.withColumns(lists).where("at = first").select("run_id", "size", "nodes", "edges")

    ids = F.transform("nodes", lambda x: x["id"])
    earlier = lambda x: F.coalesce(F.exists("nodes", lambda y: y["own"].isNull() & (y["id"] == x["id"]) & (y["position"] < x["position"])), F.lit(False))
    repeated = lambda x: F.when(c("same_ids") & earlier(x), "duplicate_orchestration_node_id").otherwise(x["own"])
    reasons = lambda x: bound(F.when(x["own"].eqNullSafe(F.lit("invalid_orchestration_node")), x["own"]).otherwise(repeated(x)), lambda own: F.when(own.isNotNull(), F.array(own)).otherwise(x["extra"]))
    runs = runs.withColumn("same_ids", repeats(ids)).withColumn("bad", F.when(c("size").isNull() & c("run_id").isNotNull(), F.flatten(F.transform("nodes", reasons))))

    def broken(e: Column, source: Column, target: Column) -> Column:
        return first_failure([
            (source.isNull(), "orchestration_edge_from_not_found"), (target.isNull(), "orchestration_edge_to_not_found"), ((e["from_id"] == e["to_id"]) | blank(e["modality"]), "invalid_orchestration_edge"),
            (~F.coalesce(F.array_contains(source["produces"], e["modality"]), F.lit(False)), "orchestration_edge_modality_not_produced"), (~F.coalesce(F.array_contains(target["consumes"], e["modality"]), F.lit(False)), "orchestration_edge_modality_not_consumed"),
            (~e["join_policy"].isin(JOINS), "invalid_orchestration_join_policy"), ((e["join_policy"] == "same_item") & (source["away"] | target["away"]), "same_item_requires_data_plane_local"),
        ])

    node = lambda of: F.array_max(F.transform(F.filter("nodes", lambda x: x["id"] == of), lambda x: x["known"]))
    verdict = lambda e: bound(node(e["from_id"]), lambda source: bound(node(e["to_id"]), lambda target: broken(e, source, target)))
    runs = runs.withColumn("verdicts", F.when(F.size("bad") == 0, F.transform("edges", verdict)))
    # edges of one key have one verdict, so of the valid ones all but as many as there are keys repeat another
    valid = F.filter("edges", lambda _, k: F.get("verdicts", k).isNull())
    key = lambda e: F.concat_ws(":", F.length(e["from_id"]), F.length(e["to_id"]), e["join_policy"], e["from_id"], e["to_id"], e["modality"])
    again = bound(F.transform(valid, key), lambda keys: F.array_repeat(F.lit("duplicate_orchestration_edge"), F.size(keys) - F.size(F.array_distinct(keys))))
    runs = runs.withColumn("broken", F.when(c("verdicts").isNotNull(), F.concat(F.array_compact("verdicts"), again)))
    cycle = F.when(F.size("broken") == 0, F.when(_cyclic(F.transform("edges", lambda e: F.struct(e["from_id"].alias("from_id"), e["to_id"].alias("to_id")))), F.array(F.lit("orchestration_cycle_detected"))))
    runs = runs.select("run_id", F.when(c("size").isNotNull(), F.array("size")).when(F.size("bad") > 0, c("bad")).when(F.size("broken") > 0, c("broken")).otherwise(cycle).alias("found"))
    counted = F.transform(F.array_distinct("found"), lambda r: F.struct(r.alias("reason"), F.size(F.filter("found", lambda x: x == r)).cast("long").alias("n")))
    return runs.select("run_id", F.inline(counted))


def enqueued_enrichments(inputs: DataFrame, units: DataFrame, existing: DataFrame, grid_ms: int, most: int = MOST_TASKS) -> DataFrame:
    """A task for each input (execution_id, node_id, ref, start_ms, end_ms): task_id, unit_id, outcome, and whether its execution is refused.

    An input belongs to the first unit (execution_id, unit_id, start_ms, end_ms) that its start is in. Ids are derived from the input, so
    repeats give one task. outcome: created, existing (in existing: task_id, unit_id), or a reason; a reason refuses the whole execution.
    """
    at = units.select("execution_id", "unit_id", F.col("start_ms").alias("other_start_ms"), F.col("end_ms").alias("other_end_ms"))
    keys = ["execution_id", "node_id", "ref", "start_ms", "end_ms"]
    tasks = inputs.select(*keys).distinct().withColumn("task_id", derived_id("enr_", *map(F.col, keys)))
    points = tasks.select("execution_id", "task_id", "start_ms", (F.col("start_ms") + 1).alias("point_end"))
    first = F.min_by("unit_id", F.struct("other_start_ms", "unit_id"))
    mapped = overlap_join(points, at, ["execution_id"], grid_ms, ("start_ms", "point_end")).groupBy("task_id").agg(first.alias("unit_id"))
    counts = tasks.groupBy("execution_id").agg(F.count(F.lit(1)).alias("_n"))
    both = tasks.join(mapped, "task_id", "left").join(existing.select("task_id", F.col("unit_id").alias("_unit")), "task_id", "left").join(counts, "execution_id")
    reason = first_failure([
        (F.col("_n") > most, "enrichment_task_budget_exceeded"), (F.col("unit_id").isNull(), "enrichment_input_range_unmapped"),
        (F.col("_unit") != F.col("unit_id"), "enrichment_task_identity_conflict"),
    ])
    judged = both.withColumn("reason", reason)
    refused = judged.where("reason IS NOT NULL").select("execution_id", F.lit(True).alias("refused")).distinct()
    outcome = F.coalesce("reason", F.when(F.col("_unit").isNotNull(), "existing"), F.lit("created"))
    return judged.join(refused, "execution_id", "left").select("task_id", "execution_id", "unit_id", outcome.alias("outcome"), F.coalesce("refused", F.lit(False)).alias("refused"))
