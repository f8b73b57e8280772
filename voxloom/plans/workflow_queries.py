"""Queries of whole jobs, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.operators import workflows
from voxloom.plans.adapters import view
from voxloom.plans.catalog import query
from voxloom.plans.registry import ECHO, GROUPS, LABELLED, LINKAGE, USED, _ts

MERGED = """+ merged AS (
  SELECT tid, row_number() OVER (PARTITION BY tid ORDER BY o, segment_index) - 1 AS segment_index, start_ms + o * 250 AS start_ms, end_ms + o * 250 AS end_ms, text, source_track, NULL::VARCHAR AS speaker_id
  FROM (SELECT *, CASE source_track WHEN 'microphone' THEN 0 WHEN 'system' THEN 1 ELSE 2 END AS o FROM v_segments) WHERE segment_index % 11 <> 5), """


@query(
    MERGED + ECHO.strip().lstrip("+").replace("v_segments", "merged") + ", " + LABELLED.format(t="kept") + ", " + GROUPS.replace("v_segments", "kept")
    + f""", doc AS (SELECT tid, string_agg('[' || {_ts("start_ms", ".")} || '] ' || labelled, chr(10) ORDER BY start_ms, segment_index) AS document FROM lab GROUP BY tid),
  passages AS (SELECT tid, string_agg(text, chr(10) ORDER BY group_id) AS passages FROM grouped GROUP BY tid)
  SELECT doc.tid, document, passages FROM doc LEFT JOIN passages ON passages.tid = doc.tid""",
    "v_segments",
)
def w2_live_sessions(spark, d):
    # Each segment comes as a draft and as its final text, for a third of them in the wrong order; some are deleted.
    s = view(spark, d, "v_segments").withColumn("track_order", F.when(F.col("source_track") == "microphone", 0).when(F.col("source_track") == "system", 1).otherwise(2))
    keep = ["tid", "track_order", "segment_index", "start_ms", "end_ms"]
    change = lambda rows, revision, arrival, text, deleted=False: rows.select(*keep, F.lit(revision).alias("revision"), arrival.alias("arrival"), F.lit(deleted).alias("deleted"), text.alias("text"))
    late = F.when(F.col("segment_index") % 3 == 0, 3).otherwise(1)
    changes = change(s, 1, late, F.upper("text")).union(change(s, 2, F.lit(2), F.col("text"))).union(change(s.where("segment_index % 11 = 5"), 3, F.lit(4), F.lit(""), True))
    tracks = s.select("tid", "track_order", F.col("source_track").alias("track"), (F.col("track_order") * 250).alias("offset_ms")).distinct()
    return workflows.live_sessions(changes, tracks).withColumn("passages", F.array_join("passages", "\n"))


@query(
    LINKAGE + """, votes AS (SELECT tid, window_id % 10 // 2 AS segment_index, speaker, count(*) AS n FROM clusters WHERE CAST(substr(tid, 2) AS BIGINT) % 4 <> 0 GROUP BY ALL),
  won AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY tid, segment_index ORDER BY n DESC, speaker DESC) = 1),
  seg AS (SELECT DISTINCT tid, window_id % 10 // 2 AS segment_index FROM v_short_recordings)
  SELECT seg.tid, seg.segment_index, CASE WHEN won.tid IS NULL THEN 'before' ELSE 'Speaker ' || (speaker + 1) END AS speaker_id, won.tid IS NOT NULL AS applied
  FROM seg LEFT JOIN won ON won.tid = seg.tid AND won.segment_index = seg.segment_index""",
    "v_short_recordings",
)
def w3_labelled_recordings(spark, d):
    windows = view(spark, d, "v_short_recordings").withColumn("segment_index", F.floor(F.col("window_id") % 10 / 2))
    segments = windows.select("tid", "segment_index").distinct().select(
        "tid", "segment_index", F.concat_ws(" ", "tid", "segment_index").alias("text"), (F.col("segment_index") * 6000).alias("start_ms"), (F.col("segment_index") * 6000 + 6000).alias("end_ms"), F.lit("before").alias("speaker_id")
    )
    jobs = windows.select(F.col("tid").alias("id")).distinct().withColumn("status", F.when(F.substring("id", 2, 20).cast("long") % 4 == 0, "failed").otherwise("completed"))
    return workflows.labelled_recordings(jobs, segments, windows).select("tid", "segment_index", "speaker_id", "applied")


@query(
    """+ e AS (SELECT *, CAST(substr(original_id, 2) AS BIGINT) % 10 AS k, CAST(substr(revision, 2) AS BIGINT) AS id, row_number() OVER w AS r, first_value(revision) OVER w AS latest FROM v_snapshots
    WINDOW w AS (PARTITION BY original_id ORDER BY CAST(substr(revision, 2) AS BIGINT) DESC)),
  sound AS (SELECT id, original_id, revision, CASE WHEN k = 3 AND r > 1 THEN coalesce(parent_revision, latest) ELSE parent_revision END AS parent_revision, merge_a, merge_b FROM e
    WHERE k <> 1 AND original_id NOT IN (SELECT original_id FROM e WHERE k = 3 AND r = 1 AND parent_revision IS NOT NULL)), """
    + USED.lstrip("+").replace("v_snapshots", "sound")
    + """, n AS (SELECT original_id, count(*) AS n FROM heads GROUP BY 1)
  SELECT 'f' || s.id AS remote_id, s.original_id, s.revision, h.revision IS NOT NULL AS is_head, h.revision IS NOT NULL AND n > 1 AS concurrent, id % 4 = 0 OR id % 7 = 0 AS known, h.revision IS NOT NULL AND NOT (id % 4 = 0 OR id % 7 = 0) AS restore
  FROM sound s LEFT JOIN heads h ON h.original_id = s.original_id AND h.revision = s.revision LEFT JOIN n ON n.original_id = s.original_id""",
    "v_snapshots",
)
def w4_snapshot_catalogue(spark, d):
    # A tenth of the originals has blank revisions, in a tenth the first revisions come after the last one. The optimizer may cast blank revisions, hence try_cast.
    s = view(spark, d, "v_snapshots").withColumn("k", F.substring("original_id", 2, 20).try_cast("long") % 10).withColumn("id", F.substring("revision", 2, 20).try_cast("long"))
    latest = F.max("id").over(W.partitionBy("original_id"))
    above = F.when((F.col("k") == 3) & (F.col("id") < latest), F.coalesce("parent_revision", F.concat(F.lit("o"), latest))).otherwise(F.col("parent_revision"))
    remote = s.select(
        F.concat(F.lit("f"), "id").alias("remote_id"), "original_id", F.when(F.col("k") == 1, " ").otherwise(F.col("revision")).alias("revision"), above.alias("parent_revision"), "merge_a", "merge_b", F.concat(F.lit("m"), "id").alias("manifest")
    )
    local = s.where("id % 4 = 0").select(F.concat(F.lit("r"), "id").alias("id"), "original_id", "revision")
    restored = s.where("id % 7 = 0").select(F.concat(F.lit("f"), "id").alias("remote_id"), F.concat(F.lit("r"), "id").alias("id"))
    return workflows.snapshot_catalogue(remote, local, restored)
