"""Registered queries over jobs, trees, exports, journals, snapshots and streams, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import columns as C
from voxloom.operators import export, jobs, journal, snapshots, tree
from voxloom.plans.adapters import view
from voxloom.plans.catalog import query, table
from voxloom.plans.registry import ALL_REGIONS, _ts
from voxloom.sources.stored import new_path
from voxloom.streaming import jobs as streams

# --- jobs --------------------------------------------------------------------------------------

ALLOWED = ", ".join(f"'{a}>{b}'" for a, b in jobs.TRANSITIONS)


@query(f"""+ c AS (SELECT *, ['preparing', 'transcribing', 'completed', 'failed', 'queued'][CAST(arrival % 5 + 1 AS INT)] AS t FROM v_recordings),
  g AS (SELECT *, CASE WHEN status || '>' || t IN ({ALLOWED}) THEN t END AS go FROM c)
  SELECT id, coalesce(go, status) AS status, coalesce(CASE WHEN go = 'preparing' THEN arrival + 9 WHEN go = 'queued' THEN NULL ELSE started_ms END, -1) AS started_ms,
  coalesce(CASE WHEN go IN ('completed', 'failed') THEN arrival + 9 WHEN go IN ('queued', 'preparing') THEN NULL ELSE completed_ms END, -1) AS completed_ms,
  CASE WHEN go = 'failed' THEN 'why' WHEN go IS NOT NULL THEN NULL ELSE error END AS error FROM g""", "v_recordings")
def q4_apply_transitions(spark, d):
    j = view(spark, d, "v_recordings")
    target = F.element_at(F.array(*[F.lit(x) for x in ("preparing", "transcribing", "completed", "failed", "queued")]), (F.col("arrival") % 5 + 1).cast("int"))
    latest = j.select("id", target.alias("target"), (F.col("arrival") + 9).alias("at_ms"), F.lit("why").alias("error"))
    older = j.select("id", F.lit("cancelled").alias("target"), F.col("arrival").alias("at_ms"), F.lit("old").alias("error"))
    return jobs.apply_transitions(j, latest.union(older)).select("id", "status", F.coalesce("started_ms", F.lit(-1)).alias("started_ms"), F.coalesce("completed_ms", F.lit(-1)).alias("completed_ms"), "error")


@query("""+ a AS (SELECT *, cancel_requested AND status IN ('preparing', 'transcribing') AS hit FROM v_recordings)
  SELECT id, CASE WHEN hit THEN 'cancelled' ELSE status END AS status, cancel_requested AND NOT hit AS cancel_requested, coalesce(CASE WHEN hit THEN 778 ELSE completed_ms END, -1) AS completed_ms FROM a""", "v_recordings")
def q5_acknowledge_cancel(spark, d):
    return jobs.acknowledge_cancel(view(spark, d, "v_recordings"), 778).select("id", "status", "cancel_requested", F.coalesce("completed_ms", F.lit(-1)).alias("completed_ms"))


@query("""+ g AS (SELECT id FROM v_jobs WHERE arrival % 3 = 0 AND status IN ('completed', 'cancelled', 'failed', 'interrupted'))
  SELECT id, -1 AS segment FROM v_jobs WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT concat('o', l_orderkey), l_linenumber FROM lineitem WHERE concat('o', l_orderkey) NOT IN (SELECT id FROM g)""", "v_jobs")
def q9_delete_history(spark, d):
    j = view(spark, d, "v_jobs")
    segments = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("tid"), F.col("l_linenumber").alias("segment"))
    kept, left = jobs.delete_history(j, segments, j.where("arrival % 3 = 0").select("id"))
    return kept.select("id", F.lit(-1).alias("segment")).union(left.select("tid", "segment"))


@query("SELECT id, CAST(row_number() OVER (ORDER BY created_ms DESC, arrival) AS BIGINT) AS place FROM (SELECT *, (arrival * 7919) % 100003 AS created_ms FROM v_jobs)", "v_jobs")
def q1_history_places(spark, d):
    j = view(spark, d, "v_jobs").withColumn("created_ms", (F.col("arrival") * 7919) % 100_003)
    return tree.numbered(j, "place", F.col("created_ms").desc(), F.col("arrival")).select("id", "place")


# --- trees -------------------------------------------------------------------------------------

@query("""SELECT concat('s', s_suppkey) AS id, 'folder' AS kind, NULL AS parent_id, s_name AS name, s_suppkey AS position FROM supplier
  UNION ALL SELECT concat('c', c_custkey), 'recording', CASE WHEN c_custkey % 3 = 0 THEN concat('s', c_custkey % 5) END, c_name,
  CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 10 ELSE row_number() OVER (ORDER BY c_custkey * 37 % 1000 DESC, concat('c', c_custkey)) - 1 END FROM customer""")
def o1_load_tree(spark, d):
    folders = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("position"))
    c = table(spark, d, "customer")
    recordings = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") * 37 % 1000).alias("created_ms"))
    places = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("s"), F.col("c_custkey") % 5).alias("parent_id"), (F.col("c_custkey") % 10).alias("position"))
    return tree.load_tree(folders, recordings, places)


@query("SELECT id, kind, position FROM v_nodes WHERE parent_id = 'n3'", "v_nodes")
def o5_children(spark, d):
    return tree.children(view(spark, d, "v_nodes"), "n3").select("id", "kind", "position")


@query("""+ m AS (SELECT id, CASE id WHEN 'n1' THEN 0 ELSE 1 END AS i FROM v_nodes WHERE id IN ('n1', 'n2')),
  t AS (SELECT parent_id AS p FROM v_nodes WHERE id IN ('n1', 'n2') UNION SELECT 'r4'),
  x AS (SELECT v.id, CASE WHEN m.id IS NULL THEN parent_id ELSE 'r4' END AS parent_id, position, CASE WHEN m.id IS NULL THEN row_number() OVER (PARTITION BY parent_id, m.id IS NOT NULL ORDER BY position, v.id) - 1 ELSE 0.5 + i / 8.0 END AS place FROM v_nodes v LEFT JOIN m ON m.id = v.id)
  SELECT id, parent_id, CASE WHEN parent_id IN (SELECT p FROM t) THEN row_number() OVER (PARTITION BY parent_id ORDER BY place, id) - 1 ELSE position END AS position FROM x""", "v_nodes")
def o6_move_nodes(spark, d):
    return tree.move_nodes(view(spark, d, "v_nodes"), ["n1", "n2"], "r4", 1).select("id", "parent_id", "position")


@query("SELECT id, CASE WHEN id = 'n3' THEN 'New' ELSE name END AS name FROM v_nodes", "v_nodes")
def o8_rename_folder(spark, d):
    return tree.rename_folder(view(spark, d, "v_nodes"), "n3", " New ").select("id", "name")


# A chain of folders for each customer's orders: as deep as there are orders.
@query("SELECT concat('o', o_orderkey) AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS depth, string_agg(CAST(o_orderkey AS VARCHAR), ' / ') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS path FROM orders")
def o4_deep_chains(spark, d):
    from pyspark.sql import Window as W

    above = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    nodes = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("tree"), F.concat(F.lit("o"), "o_orderkey").alias("id"), F.lit("folder").alias("kind"), F.concat(F.lit("o"), above).alias("parent_id"), F.col("o_orderkey").cast("string").alias("name"), F.lit(0).cast("long").alias("position"))
    depth = tree.visible_tree(nodes).select("id", "depth")
    return depth.join(tree.folder_paths(nodes).select("id", "path"), "id")


# --- export ------------------------------------------------------------------------------------

@query(f"SELECT l_orderkey, l_linenumber, {_ts('(l_orderkey * 97711 + l_partkey)', ',')} AS stamp FROM lineitem")
def k1_format_timestamp(spark, d):
    seconds = (F.col("l_orderkey") * 97_711 + F.col("l_partkey")) / 1000
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.format_timestamp(seconds, ",").alias("stamp"))


def _shorten(text: str) -> str:
    return f"{text[:5]}{len(text)}"


@query("""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, (length(text) - 1) // 300 + 1 AS k FROM documents WHERE trim(text) <> '' AND length(text) <= 1000000),
  n AS (SELECT id, k, text, list_transform(range(k), lambda i: substr(text, CAST(i * 300 + 1 AS INT), 5) || CAST(least(300, length(text) - i * 300) AS VARCHAR)) AS notes FROM t),
  j AS (SELECT *, array_to_string(notes, chr(10) || chr(10)) AS j FROM n)
  SELECT id, CASE WHEN k = 1 THEN j WHEN length(j) <= 300 THEN substr(j, 1, 5) || CAST(length(j) AS VARCHAR)
    ELSE array_to_string(list_transform(range(k), lambda i: '## Часть ' || CAST(i + 1 AS VARCHAR) || chr(10) || notes[CAST(i + 1 AS INT)]), chr(10) || chr(10)) END AS summary FROM j""")
def k9_summaries(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return export.summarize_map_reduce(texts, _shorten, 300).select("id", "summary")


# --- journal -----------------------------------------------------------------------------------

@query("""SELECT session_id, change_id, arrival, CAST(row_number() OVER (PARTITION BY session_id ORDER BY arrival) AS INT) AS cursor FROM (SELECT *, max(revision) OVER (PARTITION BY session_id, change_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v_changes) WHERE b IS NULL OR revision > b""", "v_changes")
def j3_journal_cursor(spark, d):
    return journal.journal_cursor(view(spark, d, "v_changes")).select("session_id", "change_id", "arrival", "cursor")


@query("""WITH f AS (SELECT doc_id // 3 AS s, doc_id % 3 AS t, strlen(text) AS size, CASE WHEN strlen(text) <= 16777216 THEN sha256(text) END AS h FROM documents WHERE text IS NOT NULL)
  SELECT concat('s', s) AS session_id, count(*) AS tracks, CAST(sum(size) AS BIGINT) AS bytes, max(size) AS duration, bool_and((3 * s + t) % 7 <> 0) AS ok, CASE WHEN count(h) = 1 THEN max(h) ELSE '' END AS content_hash
  FROM (SELECT s, t, size + CASE WHEN (3 * s + t) % 7 = 0 THEN 1 ELSE 0 END AS size, h FROM f) GROUP BY s""")
def j12_finalize_files(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    key = [F.concat(F.lit("s"), F.floor(F.col("doc_id") / 3)).alias("session_id"), (F.col("doc_id") % 3).cast("string").alias("track_id")]
    files = docs.select(*key, F.col("text").cast("binary").alias("content"))
    size = F.octet_length("text") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    return journal.finalize_archive(docs.select(*key, size.alias("bytes"), size.cast("long").alias("n")), files)


# --- snapshots ---------------------------------------------------------------------------------

@query("""SELECT id, CAST((SELECT count(*) FROM lineitem WHERE l_orderkey = arrival) AS INT) AS segments, CASE WHEN arrival % 3 = 0 THEN concat('z', arrival) ELSE id END AS original, CASE WHEN arrival % 3 = 0 AND arrival % 6 <> 0 THEN 'r1' END AS parent,
  source_filename AS file, status, 'device' AS device, 'a.wav' AS audio, CAST(arrival AS VARCHAR) AS bytes, 'drive-folder-' || sha256('device:f' || (arrival % 5)) AS folder FROM v_recordings WHERE status NOT IN ('preparing', 'transcribing') AND arrival % 2 = 0""", "v_recordings")
def j13_build_snapshots(spark, d):
    j = view(spark, d, "v_recordings")
    segments = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("tid"), F.col("l_linenumber").alias("segment_index"), F.lit(0).alias("start_ms"), F.lit(1).alias("end_ms"), F.col("l_returnflag").alias("text"), F.lit("file").alias("source_track"), F.lit(None).cast("string").alias("speaker_id"))
    audio = j.where("arrival % 2 = 0").select("id", F.lit("a.wav").alias("name"), F.col("arrival").alias("bytes"), F.lit("00").alias("sha256"))
    folder = F.concat(F.lit("f"), F.col("arrival") % 5)
    nodes = j.select(F.col("id").alias("recording_id"), folder.alias("id"), F.lit("folder").alias("kind"), F.lit(None).cast("string").alias("parent_id"), F.lit("Folder").alias("name"), F.lit(0).cast("long").alias("position"))
    nodes = nodes.union(j.select("id", "id", F.lit("recording"), folder, "source_filename", F.lit(0).cast("long")))
    lineage = j.where("arrival % 3 = 0").select("id", F.concat(F.lit("z"), "arrival").alias("original_id"), F.when(F.col("arrival") % 6 == 0, "").otherwise("r1").alias("revision"))
    m = snapshots.build_snapshots(j, segments, audio, tree=nodes, lineage=lineage).withColumn("v", F.from_json("manifest", "recording struct<source_filename:string,status:string>, device_id string, segments array<struct<text:string>>, original_recording_id string, parent_revision string, audio array<struct<original_filename:string,bytes:string>>, organization array<struct<id:string,kind:string>>"))
    folders = F.filter("v.organization", lambda n: n["kind"] == "folder")
    return m.select("id", F.size("v.segments").alias("segments"), F.col("v.original_recording_id").alias("original"), F.col("v.parent_revision").alias("parent"), F.col("v.recording.source_filename").alias("file"), F.col("v.recording.status").alias("status"), F.col("v.device_id").alias("device"), F.col("v.audio")[0]["original_filename"].alias("audio"), F.col("v.audio")[0]["bytes"].alias("bytes"), folders[0]["id"].alias("folder"))


@query("SELECT concat('o', o_orderkey) AS recording_id FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_orderkey % 4 <> 2 AND o_orderkey % 5 <> 0)")
def j14_dedupe_snapshots(spark, d):
    # Half of the recordings is in the queue, half of those synced, with other keys order and another revision; a fifth differs inside.
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k, F.concat(F.lit("o"), k).alias("recording_id"))
    new = o.select("recording_id", F.concat(F.lit('{"revision": "r1", "a": {"revision": "x", "y": 2}, "n": '), k, F.lit("}")).alias("manifest"))
    inner = F.when(k % 5 == 0, "z").otherwise("x")
    old = F.concat(F.lit('{"n":'), k, F.lit(',"a":{"y":2,"revision":"'), inner, F.lit('"},"revision":"r0"}'))
    queue = o.where("o_orderkey % 2 = 0").select("recording_id", F.when(k % 4 == 2, "synced").otherwise("pending").alias("state"), old.alias("manifest"))
    return snapshots.dedupe_snapshots(new, queue).select("recording_id")


REASONS = ("version", "id", "audio count", "audio name", "audio digest", "audio size", "offset", "merge parents", "merge parents", None)


@query("SELECT o_orderkey AS k, [%s][CAST(o_orderkey %% 10 + 1 AS INT)] AS reason FROM orders" % ", ".join(f"'{r}'" if r else "NULL" for r in REASONS))
def j19_validate_manifests(spark, d):
    k = F.col("o_orderkey") % 10
    track = F.struct(
        F.when(k == 3, "a/b.wav").otherwise("a.wav").alias("original_filename"), F.when(k == 4, "zz").otherwise(F.lit("0" * 64)).alias("sha256"), F.when(k == 5, 0).otherwise(F.col("o_orderkey") + 1).cast("long").alias("bytes"),
    )
    two = F.struct(F.lit("b.wav").alias("original_filename"), F.lit("1" * 64).alias("sha256"), F.lit(5).cast("long").alias("bytes"))
    audio = F.array(track, two)
    merges = F.when(k == 7, F.array(F.lit("x"))).when(k == 8, F.array(F.lit("x"), F.lit("r"))).when(k == 9, F.array(F.lit("x"), F.lit("y")))
    m = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), F.when(k == 0, 2).otherwise(1).alias("version"), F.struct(F.when(k == 1, "bad id!").otherwise("ok").alias("id")).alias("recording"), F.lit("r").alias("revision"), merges.alias("merge_parents"),
        F.when(k == 2, F.slice(audio, 1, 0)).otherwise(audio).alias("audio"), F.array(F.struct(F.lit("a.wav").alias("file"), F.when(k == 6, -1.0).otherwise(0.5).alias("offset_seconds"))).alias("tracks"),
    )
    return snapshots.validate_manifests(m).select("k", "reason")


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN concat('a', o_orderkey) WHEN o_orderkey % 5 <> 0 THEN concat('b', o_orderkey) END AS original_id, CASE WHEN o_orderkey % 4 = 2 THEN concat('p', o_orderkey) END AS parent FROM orders""")
def j20_identity(spark, d):
    k = F.col("o_orderkey")
    parent = F.when(k % 4 == 0, " ").when(k % 4 == 1, "legacy").when(k % 4 == 2, F.concat(F.lit("p"), k))
    m = table(spark, d, "orders").select(k.alias("k"), F.when(k % 3 == 0, F.concat(F.lit("a"), k)).otherwise(" ").alias("original_recording_id"), F.when(k % 5 != 0, F.concat(F.lit("b"), k)).otherwise("").alias("recording_id"), parent.alias("parent_revision"))
    return snapshots.with_identity(m).select("k", "original_id", "parent")


@query("""SELECT concat('m', o_orderkey) AS remote_id, concat('l', o_orderkey) AS id FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def j26_match_local(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    remote = o.select(F.concat(F.lit("m"), k).alias("remote_id"), F.concat(F.lit("z"), F.col("o_custkey")).alias("original_id"), F.concat(F.lit("r"), k).alias("revision"))
    local = o.where("o_orderkey % 2 = 0").select(F.concat(F.lit("l"), k).alias("id"), F.concat(F.lit("z"), F.col("o_custkey")).alias("original_id"), F.concat(F.lit("r"), k).alias("revision"))
    restored = o.where("o_orderkey % 3 = 0").select(F.concat(F.lit("m"), k).alias("remote_id"), F.concat(F.lit("l"), k).alias("id"))
    return snapshots.match_local_snapshots(remote, local, restored)


@query("""WITH l AS (SELECT l_orderkey AS k, l_returnflag AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, bool_or(l_partkey % 50 = 0) OVER (PARTITION BY l_orderkey) AS bad FROM lineitem)
  SELECT concat('restored-', sha256(concat('m', k))) AS id, concat('n', k, ' (Drive)') AS name, 'completed' AS status, false AS queue_visible, CAST(max(n) AS INT) AS n, string_agg(t, '' ORDER BY i) AS texts,
  'restored-0.wav' AS audio_path, CAST(k % 9 AS DOUBLE) / 2 AS offset_seconds, CASE WHEN k % 3 = 0 THEN 'mine' ELSE 'drive-folder-' || sha256('dev:f') END AS folder_id, k % 4 AS position, concat('z', k) AS original_id, concat('r', k) AS revision
  FROM l WHERE NOT bad AND k % 5 <> 0 AND k % 7 <> 0 AND k % 11 <> 0 AND k % 13 <> 0 GROUP BY k""")
def j27_restore_snapshots(spark, d):
    # A fifth is restored already, a seventh has another digest, an eleventh a folder below itself, a thirteenth an offset of no file, and an order with a bad line is rejected.
    k = F.col("l_orderkey")
    # Lines of one number and part, which the SQL leaves open, come by supplier, quantity and text.
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    end = lambda x: x["l_linenumber"] * 10 + F.when(x["l_partkey"] % 50 == 0, 0).otherwise(5)
    item = lambda x, i: F.struct(i.cast("long").alias("segment_index"), (x["l_linenumber"] * 10).alias("start_ms"), end(x).alias("end_ms"), x["l_returnflag"].alias("text"))
    remote = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(line)), item).alias("segments"))
    track = F.struct(F.lit("a.wav").alias("original_filename"), F.lit(5).cast("long").alias("bytes"), F.lit("00").alias("sha256"))
    remote = remote.select(F.concat(F.lit("m"), k).alias("remote_id"), F.concat(F.lit("n"), k).alias("name"), "segments", F.array(track).alias("audio"), k)
    files = remote.select("remote_id", F.lit("a.wav").alias("name"), F.lit(5).cast("long").alias("bytes"), F.when(k % 7 == 0, "11").otherwise("00").alias("sha256"))
    done = remote.where("l_orderkey % 5 = 0").select("remote_id")
    track = F.struct(F.when(k % 13 == 0, "b.wav").otherwise("a.wav").alias("file"), ((k % 9) / 2).alias("offset_seconds"))
    node = lambda i, kind, parent, position: F.struct(F.lit(i).alias("id"), F.lit(kind).alias("kind"), parent.cast("string").alias("parent_id"), F.lit("N").alias("name"), position.cast("long").alias("position"))
    tree = F.array(node("f", "folder", F.when(k % 11 == 0, "f"), F.lit(0)), node("rec", "recording", F.lit("f"), k % 4))
    remote = remote.withColumns({
        "tracks": F.array(track), "organization": tree, "organization_recording_id": F.lit("rec"), "original_recording_id": F.concat(F.lit("z"), k), "device_id": F.lit("dev"),
        "revision": F.concat(F.lit("r"), k), "local_folder_mappings": F.when(k % 3 == 0, F.create_map(F.lit("f"), F.lit("mine"))),
    })
    out = snapshots.restore_snapshots(remote.drop("l_orderkey"), done, files)
    return out.select(
        "id", "name", "status", "queue_visible", F.size("segments").alias("n"), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("texts"), "audio_path",
        F.col("tracks")[0]["offset_seconds"].alias("offset_seconds"), "folder_id", "position", "original_id", "revision",
    )


# --- streams, run until their input is drained ---------------------------------------------------

def _streamed(spark, rows: DataFrame) -> DataFrame:
    """A stream of the rows, written as files first, so many that their reading is dealt too: they pack to few bytes."""
    path = new_path(spark, "stream-input")
    rows.write.option("maxRecordsPerFile", 1_000_000).parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _drained(spark, stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream has given by the end of its input; each batch is a part of one table."""
    path = new_path(spark, "stream-output")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", new_path(spark, "stream-checkpoint"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("""SELECT idempotency_key AS key, CASE WHEN arrival % 11 = 0 THEN 'version' WHEN arrival % 13 = 0 THEN 'identity' WHEN arrival % 17 = 0 THEN 'position' WHEN arrival % 19 = 0 THEN 'geometry' WHEN arrival % 23 = 0 THEN 'digest' END AS reason FROM v_blocks WHERE arrival % 13 <> 0 OR arrival % 11 = 0
  UNION ALL SELECT ' ', 'identity' FROM v_blocks WHERE arrival % 13 = 0 AND arrival % 11 <> 0""", "v_blocks")
def st1_stream_blocks(spark, d):
    a = F.col("arrival")
    blocks = view(spark, d, "v_blocks").select(
        F.when(a % 11 == 0, 2).otherwise(1).alias("version"), "session_id", "track_id", F.when(a % 17 == 0, -1).otherwise(F.col("seq")).alias("seq"), F.when((a % 13 == 0) & (a % 11 != 0), " ").otherwise(F.col("idempotency_key")).alias("idempotency_key"),
        F.when(a % 19 == 0, 0).otherwise(48_000).alias("sample_rate"), (F.col("seq") * 480).alias("absolute_sample_start"), F.col("n").alias("duration_samples"), F.base64(F.col("session_id").cast("binary")).alias("payload"),
        F.when(a % 23 == 0, "00").otherwise(F.sha2(F.col("session_id").cast("binary"), 256)).alias("sha256"),
    )
    lines, good, bad = (new_path(spark, f"blocks-{x}") for x in ("lines", "good", "bad"))
    blocks.select(F.to_json(F.struct("*")).alias("value")).write.text(lines)
    streams.stream_blocks(spark, lines, good, bad, new_path(spark, "blocks-checkpoint")).awaitTermination()
    schema = f"{streams.BLOCKS}, reason string"
    kept = spark.read.schema(streams.BLOCKS).parquet(good).select(F.col("idempotency_key").alias("key"), F.lit(None).cast("string").alias("reason"))
    return kept.union(spark.read.schema(schema).parquet(bad).select("idempotency_key", "reason"))


@query("SELECT DISTINCT session_id, track_id, CAST(seq // 3 AS BIGINT) AS k FROM v_blocks", "v_blocks")
def st2_dedupe_blocks(spark, d):
    # Three blocks share a key; all are within the watermark.
    k = F.floor(F.col("seq") / 3).cast("long")
    blocks = view(spark, d, "v_blocks").select("session_id", "track_id", k.alias("k"), F.concat_ws(":", "session_id", "track_id", k).alias("idempotency_key"), F.timestamp_millis(F.col("arrival")).alias("ts"))
    return _drained(spark, streams.dedupe_blocks(_streamed(spark, blocks), "10 minutes"), "append").select("session_id", "track_id", "k")


@query("""+ o AS (SELECT DISTINCT session_id, track_id, seq FROM v_blocks), p AS (SELECT *, row_number() OVER (PARTITION BY session_id, track_id ORDER BY seq) - 1 AS k FROM o)
  SELECT session_id, track_id, coalesce(max(seq) FILTER (WHERE seq = k), -1) AS durable FROM p GROUP BY ALL""", "v_blocks")
def st3_durable_cursor(spark, d):
    blocks = view(spark, d, "v_blocks").select("session_id", "track_id", F.col("seq").cast("long").alias("seq"), F.timestamp_millis(F.col("arrival")).alias("ts"))
    out = _drained(spark, streams.stream_durable_cursor(_streamed(spark, blocks)), "update")
    return out.groupBy("session_id", "track_id").agg(F.max("durable").alias("durable"))


@query(ALL_REGIONS + """, whole AS (SELECT i.tid, min(s) AS start, coalesce(max(CASE WHEN closed THEN sil END) + 1920, 102400) AS stop, coalesce(max(CASE WHEN closed THEN sil END), 102400) - min(s) AS len FROM i GROUP BY i.tid, island)
  SELECT tid, greatest(min(start) - 1920, 0) AS start, least(max(stop), 102400) AS "end" FROM whole WHERE len >= 3200 GROUP BY tid""", "v_all_frames", "v_all_vad_len")
def st4_vad_segments(spark, d):
    # Six seconds a track: all its regions fit in one chunk.
    frames = view(spark, d, "v_all_frames").select("tid", F.lit("file").alias("track"), F.col("frame").cast("int").alias("frame"), (F.col("p100") / 100).alias("prob"), (F.col("frame") == 199).alias("final"))
    return _drained(spark, streams.stream_vad_segments(_streamed(spark, frames)), "append").select("tid", "start", "end")


@query("SELECT session_id, change_id, revision, payload FROM (SELECT *, row_number() OVER (PARTITION BY session_id, change_id ORDER BY revision DESC, arrival) AS k FROM v_changes) WHERE k = 1", "v_changes")
def st5_upsert_segments(spark, d):
    changes = view(spark, d, "v_changes")
    path = new_path(spark, "segments-table")
    # Two runs over two parts of the input, so that the second one merges into what the first one left.
    source, checkpoint = new_path(spark, "changes"), new_path(spark, "changes-checkpoint")
    for part in (changes.where("arrival % 2 = 0"), changes.where("arrival % 2 = 1")):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(changes.schema).parquet(source)
        streams.stream_upsert_segments(stream, path, checkpoint, 16).awaitTermination()
    return streams.read_upserted(spark, path, changes.schema).select("session_id", "change_id", "revision", "payload")


@query("""SELECT user_id AS session_id, event_type AS track_id, epoch_us(ts) // 10000000 AS bucket, count(*) AS packets, CAST(round(sqrt(sum(event_id % 50) / count(*)) * 1000) AS BIGINT) AS rms, CAST(sum(event_id % 7) AS BIGINT) AS gap_ms, count(*) FILTER (WHERE event_id % 5 = 0) AS resyncs FROM events GROUP BY 1, 2, 3""")
def st6_levels(spark, d):
    e = F.col("event_id")
    packets = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("track_id"), F.col("ts").cast("timestamp").alias("ts"), (e % 50).cast("double").alias("power"), F.lit(1).cast("long").alias("n"), (e % 7).alias("gap_ms"), (e % 5 == 0).alias("resync"))
    out = _drained(spark, streams.stream_levels(_streamed(spark, packets)), "complete")
    bucket = (F.unix_millis("window.start") / 10_000).cast("long")
    return out.select("session_id", "track_id", bucket.alias("bucket"), "packets", F.round(F.col("rms") * 1000).cast("long").alias("rms"), "gap_ms", "resyncs")


@query("""WITH x AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
  y AS (SELECT user_id, t, sum(CASE WHEN b IS NULL OR t - b >= 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM x)
  SELECT user_id AS session_id, min(t) AS start_us, max(t) + 86400000000 AS end_us, count(*) AS packets FROM y GROUP BY user_id, k""")
def st7_session_activity(spark, d):
    packets = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    out = _drained(spark, streams.session_activity(_streamed(spark, packets), "24 hours"), "complete")
    return out.select("session_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "packets")
