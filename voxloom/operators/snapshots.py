"""Snapshot manifests, the upload queue, revision graphs and restores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions import columns as C
from voxloom.sources.stored import removed, saved

QUEUE, LEASE_MS, MOST_DELAY_MS = 1_000, 3_600_000, 900_000
AUDIO_BYTES, AUDIO_FILES, NAME_CHARS = 512 << 20, 8, 240
#: Columns of a recording that go into its manifest.
RECORDING = (
    "id", "kind", "source_filename", "source_path", "source_size_bytes", "source_modified_ms", "created_ms", "started_ms", "completed_ms", "status", "duration_seconds", "model_version",
    "error", "audio_path", "completed_chunks", "total_chunks", "queue_visible",
)
AUDIO_KINDS = ("ogg", "wav", "flac", "mp3", "webm", "m4a")
STATES = ("pending", "uploading", "synced", "auth_required")
#: Fixed texts in an upload error that mean the user has to sign in again; letter case counts.
AUTH_ERRORS = ("revoked", "expired", "Connect Google", "invalid_client", "invalid_grant")


def build_snapshots(jobs: DataFrame, segments: DataFrame, audio: DataFrame, tracks: DataFrame | None = None, tree: DataFrame | None = None, lineage: DataFrame | None = None, device: str = "device", merges: DataFrame | None = None) -> DataFrame:
    """(id, manifest json) of recordings that aren't being recorded or recognised and have audio.

    The recording is in the manifest with all of :data:`RECORDING` that ``jobs`` has. ``merges`` is (id,
    merge_parents) of those that resolve a conflict.

    Segments are in order; ``audio`` is (id, name, bytes, sha256), ``tracks`` (id, file, offset_seconds),
    ``tree`` the nodes (id, kind, parent_id, name, position) of the folders above each recording
    (recording_id), ``lineage`` (id, original_id, revision). Folder ids are made canonical for the device.
    """
    part = F.struct("segment_index", "start_ms", "end_ms", "text", "source_track", "speaker_id")
    segs = segments.groupBy("tid").agg(F.sort_array(F.collect_list(part)).alias("segments"))
    files = audio.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("name").alias("original_filename"), "bytes", "sha256"))).alias("audio"))
    rows = jobs.where(~F.col("status").isin("preparing", "transcribing")).join(files, "id")
    rows = rows.join(segs.withColumnRenamed("tid", "id"), "id", "left")
    spark = jobs.sparkSession
    if tracks is None:
        tracks = spark.createDataFrame([], "id string, file string, offset_seconds double")
    offsets = tracks.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("file", "offset_seconds"))).alias("tracks"))
    if tree is None:
        tree = spark.createDataFrame([], "recording_id string, id string, kind string, parent_id string, name string, position long")
    canonical = lambda c: C.canonical_folder_id(F.col(c), F.lit(device))
    node = F.struct(F.when(F.col("kind") == "folder", canonical("id")).otherwise(F.col("id")).alias("id"), "kind", canonical("parent_id").alias("parent_id"), "name", "position")
    nodes = tree.groupBy(F.col("recording_id")).agg(F.sort_array(F.collect_list(node)).alias("organization")).withColumnRenamed("recording_id", "id")
    if lineage is None:
        lineage = spark.createDataFrame([], "id string, original_id string, revision string")
    parent = lineage.select("id", F.col("original_id").alias("o"), F.when(F.col("revision") != "", F.col("revision")).alias("parent_revision"))
    if merges is None:
        merges = spark.createDataFrame([], "id string, merge_parents array<string>")
    rows = rows.join(offsets, "id", "left").join(nodes, "id", "left").join(parent, "id", "left").join(merges.select("id", "merge_parents"), "id", "left")
    none = lambda c, df: F.coalesce(c, F.array().cast(df.schema[c].dataType)).alias(c)
    body = F.struct(
        F.lit(1).alias("version"), F.lit(device).alias("device_id"), F.struct(*[c for c in RECORDING if c in jobs.columns]).alias("recording"), none("segments", segs), none("audio", files), none("tracks", offsets),
        none("organization", nodes), F.coalesce("o", "id").alias("original_recording_id"), F.col("id").alias("organization_recording_id"), "parent_revision", "merge_parents",
    )
    return rows.select("id", F.to_json(body).alias("manifest"))


def manifest_hash(manifest: F.Column) -> F.Column:  # type: ignore[name-defined]
    """A digest of a JSON manifest without its own revision; the order of keys doesn't count.

    What isn't a JSON object is hashed as text.
    """
    fields = F.try_parse_json(manifest).try_cast("map<string, variant>") if hasattr(F.Column, "try_cast") else F.try_parse_json(manifest).cast("map<string, variant>")
    entries = F.transform(F.map_keys(fields), lambda k: F.struct(k.alias("k"), F.to_json(F.element_at(fields, k)).alias("v")))
    rest = F.array_sort(F.filter(entries, lambda e: e["k"] != "revision"))
    return F.sha2(F.coalesce(F.to_json(rest), manifest).cast("binary"), 256)


def dedupe_snapshots(candidates: DataFrame, queue: DataFrame) -> DataFrame:
    """Candidates (recording_id, manifest) without those whose recording has an equal unsynced manifest in the queue."""
    waiting = queue.where("state <> 'synced'").select("recording_id", manifest_hash(F.col("manifest")).alias("h")).distinct()
    return candidates.withColumn("h", manifest_hash(F.col("manifest"))).join(waiting, ["recording_id", "h"], "left_anti").drop("h")


def enqueue_outbox(queue: DataFrame, new: DataFrame, most: int = QUEUE) -> DataFrame:
    """New jobs (owner, id, payload, arrival) as pending: the first payload of an id wins, at most ``most`` unsynced per owner."""
    first = new.groupBy("owner", "id").agg(F.min_by("payload", "arrival").alias("payload"), F.min("arrival").alias("arrival")).join(queue.select("owner", "id"), ["owner", "id"], "left_anti")
    used = queue.where("state <> 'synced'").groupBy("owner").agg(F.count(F.lit(1)).alias("used"))
    rank = F.row_number().over(W.partitionBy("owner").orderBy("arrival", "id"))
    return first.withColumn("rank", rank).join(used, "owner", "left").where(F.col("rank") + F.coalesce("used", F.lit(0)) <= most).select("owner", "id", "payload", F.lit("pending").alias("state"), F.lit(0).alias("attempts"), F.lit(0).cast("long").alias("next_ms"))


def due_jobs(queue: DataFrame, now_ms: int, n: int) -> DataFrame:
    """The next ``n`` jobs of each owner that are due, leased for an hour."""
    rows = queue.where(F.col("state").isin("pending", "uploading") & (F.col("next_ms") <= now_ms))
    rank = F.row_number().over(W.partitionBy("owner").orderBy("next_ms", "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).withColumn("state", F.lit("uploading")).withColumn("next_ms", F.lit(now_ms + LEASE_MS).cast("long"))


def apply_upload_results(queue: DataFrame, results: DataFrame, now_ms: int) -> DataFrame:
    """Results (id, ok, error) on queue rows: synced, waiting for sign-in, or pending again after a growing delay.

    Of several results of a job, a success counts, else the last error by its text.
    """
    one = results.groupBy("id").agg(F.max(F.struct("ok", F.coalesce("error", F.lit("")).alias("error"))).alias("r"))
    rows = queue.join(one, "id", "left")
    auth = F.lit(False)
    for text in AUTH_ERRORS:
        auth = auth | F.col("r.error").contains(text)
    ok, failed = F.coalesce(F.col("r.ok"), F.lit(False)), F.coalesce(~F.col("r.ok"), F.lit(False))
    attempts = F.when(failed, F.col("attempts") + 1).otherwise(F.col("attempts"))
    delay = F.least(F.lit(1000) * F.pow(F.lit(2.0), F.least(F.col("attempts") + 1, F.lit(10))), F.lit(MOST_DELAY_MS)).cast("long")
    state = F.when(ok, "synced").when(failed & auth, "auth_required").when(failed, "pending").otherwise(F.col("state"))
    next_ms = F.when(failed, F.lit(now_ms) + delay).otherwise(F.col("next_ms"))
    return rows.withColumns({"state": state, "next_ms": next_ms, "attempts": attempts}).drop("r")


def recover_uploads(queue: DataFrame) -> DataFrame:
    """Uploads that a stop interrupted are pending again, at once."""
    cut = F.col("state") == "uploading"
    return queue.withColumns({"next_ms": F.when(cut, F.lit(0).cast("long")).otherwise(F.col("next_ms")), "state": F.when(cut, "pending").otherwise(F.col("state"))})


def resume_after_sign_in(queue: DataFrame) -> DataFrame:
    waiting = F.col("state") == "auth_required"
    return queue.withColumn("next_ms", F.when(waiting, F.lit(0).cast("long")).otherwise(F.col("next_ms"))).withColumn("state", F.when(waiting, "pending").otherwise(F.col("state")))


def outbox_status(queue: DataFrame) -> DataFrame:
    return queue.groupBy("owner").agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])


def validate_manifests(manifests: DataFrame) -> DataFrame:
    """Adds ``reason``, null for a valid manifest (version, revision, recording, merge_parents, audio, tracks)."""
    names = F.transform("audio", lambda a: a["original_filename"])
    safe = F.forall(names, lambda n: n.isNotNull() & (F.char_length(n) <= NAME_CHARS) & n.rlike(r"^[^/\\\x00]+$") & ~n.isin(".", ".."))
    merges = F.coalesce("merge_parents", F.array().cast("array<string>"))
    reason = (
        F.when(~F.col("version").eqNullSafe(F.lit(1)), "version").when(~F.coalesce(F.col("recording.id"), F.lit("")).rlike(r"^[A-Za-z0-9._:-]{1,240}$"), "id")
        .when(F.col("audio").isNull() | ~F.size("audio").between(1, AUDIO_FILES), "audio count").when(~safe | (F.size(F.array_distinct(names)) < F.size(names)), "audio name")
        .when(~F.forall("audio", lambda a: F.coalesce(a["sha256"].rlike("^[0-9a-f]{64}$"), F.lit(False))), "audio digest")
        .when(~F.forall("audio", lambda a: F.coalesce(a["bytes"].between(1, AUDIO_BYTES), F.lit(False))), "audio size")
        .when(F.exists("tracks", lambda t: ~F.array_contains(names, t["file"]) | t["offset_seconds"].isNull() | F.isnan(t["offset_seconds"]) | (t["offset_seconds"] < 0) | (t["offset_seconds"] == float("inf"))), "offset")
        .when((F.size(merges) > 0) & (~F.size(merges).between(2, 32) | (F.size(F.array_distinct(merges)) < F.size(merges)) | F.array_contains(merges, F.col("revision"))), "merge parents")
    )
    return manifests.withColumn("reason", reason)


def with_identity(manifests: DataFrame) -> DataFrame:
    """Adds original_id (null if there is none) and parent (null for blank or legacy)."""
    return manifests.withColumn("original_id", C.snapshot_identity(F.col("original_recording_id"), F.col("recording_id"))).withColumn("parent", C.parent_revision(F.col("parent_revision")))


def parents(snapshots: DataFrame) -> DataFrame:
    """(original_id, revision, parent) edges of snapshots (original_id, revision, parent_revision, merge_a, merge_b)."""
    all_ = F.array_distinct(F.array_compact(F.array("parent_revision", "merge_a", "merge_b")))
    return snapshots.select("original_id", "revision", F.explode(all_).alias("parent"))


def conflict_heads(snapshots: DataFrame) -> DataFrame:
    """(original_id, revision) of revisions that are nobody's parent."""
    used = parents(snapshots).select("original_id", F.col("parent").alias("revision")).distinct()
    return snapshots.select("original_id", "revision").distinct().join(used, ["original_id", "revision"], "left_anti")


def snapshot_branches(snapshots: DataFrame) -> DataFrame:
    """(original_id, revision, is_head, concurrent)."""
    heads = conflict_heads(snapshots).withColumn("is_head", F.lit(True))
    n = heads.groupBy("original_id").agg(F.count(F.lit(1)).alias("heads"))
    rows = snapshots.select("original_id", "revision").distinct().join(heads, ["original_id", "revision"], "left").join(n, "original_id", "left")
    head = F.coalesce("is_head", F.lit(False))
    return rows.select("original_id", "revision", head.alias("is_head"), (head & (F.coalesce("heads", F.lit(0)) > 1)).alias("concurrent"))


def validate_revision_graph(snapshots: DataFrame, content: str = "manifest") -> DataFrame:
    """(original_id, reason) of originals with a blank revision, a revision of two contents, or a cycle."""
    blank = snapshots.where(F.trim(F.coalesce("revision", F.lit(""))) == "").select("original_id", F.lit("blank").alias("reason"))
    double = snapshots.groupBy("original_id", "revision").agg(F.countDistinct(F.sha2(F.col(content).cast("binary"), 256)).alias("k")).where("k > 1").select("original_id", F.lit("duplicate").alias("reason"))
    known = snapshots.select("original_id", F.col("revision").alias("parent")).distinct()
    edges = parents(snapshots).join(known, ["original_id", "parent"], "left_semi")
    cyclic = cyclic_graphs(edges.select(F.col("original_id").alias("g"), F.col("revision").alias("a"), F.col("parent").alias("b")))
    return blank.union(double).union(cyclic.select(F.col("g").alias("original_id"), F.lit("cycle").alias("reason"))).distinct()


def cyclic_graphs(edges: DataFrame) -> DataFrame:
    """(g) of the graphs with a cycle, from directed edges (g, a, b).

    Nodes with a single edge out are passed over: pointer doubling leads each to the first node that
    has none or several, and edges to it end there instead. A chain that never ends is a cycle. What
    is left are the nodes with several edges, less those that lead nowhere; the edges are then turned
    round, as a cycle stays one, so nodes with a single edge in go too. A history of any length with
    few mergers takes rounds in the order of the logarithm of its length.
    """
    edges = saved(edges.distinct(), "graph-edges")
    found = [edges.where("a = b").select("g")]
    left, stuck = edges.count(), 0
    while left:
        out = saved(edges.groupBy("g", "a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("to")), "graph-nodes")
        ends, endless = chain_ends(out.where("n = 1").select("g", "a", "to"))
        bad = endless.select("g").distinct()
        found.append(bad)
        to = ends.select("g", F.col("a").alias("b"), "to")
        several = edges.join(out.where("n > 1").select("g", "a"), ["g", "a"], "left_semi").join(bad, "g", "left_anti")
        several = several.join(to, ["g", "b"], "left").select("g", "a", F.coalesce("to", "b").alias("b")).distinct()
        # An edge to a node without edges leads nowhere.
        several = saved(several, "graph-edges")
        found.append(several.where("a = b").select("g"))
        live = several.select("g", F.col("a").alias("b")).distinct()
        fewer = saved(several.where("a <> b").join(live, ["g", "b"], "left_semi").select("g", F.col("b").alias("a"), F.col("a").alias("b")), "graph-edges")
        edges, before, left = fewer, left, fewer.count()
        stuck = stuck + 1 if left == before else 0
        if stuck == 2:  # neither way round does an edge go: every node leads on
            found.append(edges.select("g"))
            break
    return reduce(DataFrame.union, found).distinct()


def chain_ends(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where chains of single steps (g, a, to) end, and the steps of those that don't, by pointer doubling.

    A round doubles the reach of every pointer. One that ends no more chains leaves only cycles, as a chain
    of some length has ends at every shorter distance.
    """
    live = steps.select("g", F.col("a").alias("to"), F.lit(True).alias("on"))
    steps = saved(steps.join(live, ["g", "to"], "left").select("g", "a", "to", F.coalesce("on", F.lit(False)).alias("on")), "graph-chains")
    left = steps.where("on").count()
    while left:
        over = steps.select("g", F.col("a").alias("to"), F.col("to").alias("far"), F.col("on").alias("more"))
        doubled = steps.join(over, ["g", "to"], "left")
        doubled = saved(doubled.select("g", "a", F.coalesce("far", "to").alias("to"), (F.col("on") & F.coalesce("more", F.lit(False))).alias("on")), "graph-chains")
        removed(steps)
        steps, before, left = doubled, left, doubled.where("on").count()
        if left == before:
            break
    return steps.where("not on"), steps.where("on")


def drive_presence(local: DataFrame, branches: DataFrame, complete: bool = True) -> DataFrame:
    """(id, presence) of local recordings (id, original_id, revision) against remote branches.

    Nothing is known of a recording without a whole lineage, nor if the listing isn't ``complete``.
    """
    conflict = branches.groupBy("original_id").agg(F.bool_or("concurrent").alias("conflict"))
    found = branches.select("original_id", "revision").distinct().withColumn("found", F.lit(True))
    rows = local.join(conflict, "original_id", "left").join(found, ["original_id", "revision"], "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    unsure = F.lit(not complete) | blank("original_id") | blank("revision") | F.coalesce(F.col("revision") == "legacy", F.lit(False))
    return rows.select("id", F.when(unsure, "unknown").when(F.coalesce("conflict", F.lit(False)), "conflict").when(F.col("found"), "revision-found").otherwise("unknown").alias("presence"))


def validate_merge_selection(selected: DataFrame, branches: DataFrame) -> DataFrame:
    """(original_id, ok): 2 to 32 distinct selected revisions, all concurrent heads of that original."""
    good = branches.where("concurrent").select("original_id", "revision", F.lit(True).alias("good"))
    rows = selected.join(good, ["original_id", "revision"], "left")
    n, d = F.count(F.lit(1)), F.countDistinct("revision")
    return rows.groupBy("original_id").agg(((n == d) & n.between(2, 32) & F.bool_and(F.coalesce("good", F.lit(False)))).alias("ok"))


def match_local_snapshots(remote: DataFrame, local: DataFrame, restored: DataFrame) -> DataFrame:
    """(remote_id, id): remote snapshots known by the restore table (remote_id, id) or by equal (original_id, revision)."""
    by_lineage = remote.join(local.select("id", "original_id", "revision"), ["original_id", "revision"]).select("remote_id", "id")
    return remote.join(restored, "remote_id").select("remote_id", "id").union(by_lineage).distinct()


MANIFEST_PARTS = {
    "tracks": "array<struct<file:string,offset_seconds:double>>", "organization": "array<struct<id:string,kind:string,parent_id:string,name:string,position:bigint>>",
    "original_recording_id": "string", "organization_recording_id": "string", "device_id": "string", "revision": "string", "local_folder_mappings": "map<string,string>",
}


def restored_folders(remote: DataFrame) -> DataFrame:
    """(tree, id, parent_id, name, position, ordinal): the folders of each snapshot (remote_id, organization), as ``tree.reconcile_restored_folders`` takes them."""
    rows = remote.select("remote_id", F.posexplode("organization").alias("ordinal", "n")).where("n.kind = 'folder'")
    return rows.select(F.col("remote_id").alias("tree"), "n.id", "n.parent_id", "n.name", "n.position", "ordinal")


def restore_snapshots(remote: DataFrame, restored: DataFrame, files: DataFrame) -> DataFrame:
    """New recordings of remote snapshots (remote_id, name, segments, audio), each restored once.

    Result: id, name, status, queue_visible, segments numbered anew, audio_path and tracks by their restored
    file names, the recording's folder and position, and its lineage (original_id, device_id, revision).
    What a snapshot has of :data:`MANIFEST_PARTS` is read, what is missing counts as null.

    A snapshot is rejected with an invalid segment; without audio, or if its files (remote_id, name, bytes, sha256)
    don't match its audio list or a name isn't safe or of a known kind; with an offset that isn't finite, is
    negative or of no file; with a bad folder tree, or if the recording lies in an unknown folder.
    """
    from voxloom.operators.tree import rejected_sources

    for c, kind in MANIFEST_PARTS.items():
        if c not in remote.columns:
            remote = remote.withColumn(c, F.lit(None).cast(kind))
    new = remote.join(restored.select("remote_id"), "remote_id", "left_anti")
    bad = F.exists("segments", lambda s: (s["end_ms"] <= s["start_ms"]) | (s["start_ms"] < 0) | s["text"].isNull())
    there = files.select("remote_id", F.col("name").alias("file"), F.col("bytes").alias("fb"), F.col("sha256").alias("fs"))
    flat = new.select("remote_id", F.explode("audio").alias("a")).join(there, "remote_id", "left")
    match = F.coalesce((F.col("a.original_filename") == F.col("file")) & (F.col("a.bytes") == F.col("fb")) & (F.col("a.sha256") == F.col("fs")), F.lit(False))
    whole = flat.groupBy("remote_id", F.col("a.original_filename").alias("f")).agg(F.bool_or(match).alias("ok")).groupBy("remote_id").agg(F.bool_and("ok").alias("ok")).where("ok")
    good = new.where(~F.coalesce(bad, F.lit(False))).join(whole.select("remote_id"), "remote_id", "left_semi")
    kind = lambda name: F.regexp_extract(name, r"\.([^.]*)$", 1)
    names = F.transform("audio", lambda a: a["original_filename"])
    safe = F.forall(names, lambda n: ~n.contains("/") & ~n.contains("\\") & ~n.contains("..") & (F.octet_length(n) <= NAME_CHARS) & kind(n).isin(*AUDIO_KINDS))
    offsets = F.forall("tracks", lambda t: F.coalesce((t["offset_seconds"] >= 0) & (t["offset_seconds"] < float("inf")) & F.array_contains(names, t["file"]), F.lit(False)))
    good = good.where((F.size("audio") <= AUDIO_FILES) & safe & F.coalesce(offsets, F.lit(True)))
    refused = rejected_sources(restored_folders(good)).select(F.col("tree").alias("remote_id"))
    good = good.join(refused, "remote_id", "left_anti")
    own = F.coalesce("organization_recording_id", "original_recording_id")
    node = F.get(F.filter("organization", lambda n: (n["kind"] == "recording") & (n["id"] == own)), F.lit(0))
    good = good.withColumn("node", node)
    known = F.exists("organization", lambda n: (n["kind"] == "folder") & (n["id"] == F.col("node.parent_id")))
    good = good.where(F.col("node.parent_id").isNull() | F.coalesce(known, F.lit(False)))
    place = lambda s: F.struct(s["start_ms"], s["segment_index"])
    in_order = F.array_sort("segments", lambda a, b: F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0))
    segments = F.transform(in_order, lambda s, i: s.withField("segment_index", i.cast("long")))
    file = lambda i: F.concat(F.lit("restored-"), i.cast("string"), F.lit("."), kind(F.get(names, i)))
    tracks = F.transform("tracks", lambda t: F.struct(file(F.array_position(names, t["file"]).cast("int") - 1).alias("file"), t["offset_seconds"].alias("offset_seconds")))
    hashed = C.canonical_folder_id(F.col("node.parent_id"), F.coalesce("device_id", F.lit("legacy")))
    folder = F.when(F.col("node.parent_id").isNotNull(), F.coalesce(F.try_element_at("local_folder_mappings", F.col("node.parent_id")), hashed))
    return good.select(
        "remote_id", F.concat(F.lit("restored-"), F.sha2(F.col("remote_id").cast("binary"), 256)).alias("id"), F.concat(F.col("name"), F.lit(" (Drive)")).alias("name"),
        F.lit("completed").alias("status"), F.lit(False).alias("queue_visible"), segments.alias("segments"), file(F.lit(0)).alias("audio_path"), tracks.alias("tracks"), folder.alias("folder_id"),
        F.when(F.col("node").isNotNull(), F.greatest(F.coalesce("node.position", F.lit(0)), F.lit(0))).alias("position"), F.col("original_recording_id").alias("original_id"), "device_id", "revision",
    )
