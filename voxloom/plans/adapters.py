"""Transcript tables derived from the test tables; integer milliseconds, the same SQL in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {}

VIEWS["v_segments"] = """
SELECT concat('c', conv_id) AS tid, turn*2 AS segment_index,
       turn*4000 + (conv_id % 5)*100 AS start_ms,
       turn*4000 + (conv_id % 5)*100 + 1000 + length(text) % 3500 AS end_ms, text,
       CASE role WHEN 'user' THEN 'microphone' WHEN 'assistant' THEN 'system' ELSE 'file' END AS source_track,
       CASE WHEN turn % 3 = 0 THEN NULL ELSE concat('Speaker ', turn % 2 + 1) END AS speaker_id
FROM conversations
UNION ALL
SELECT concat('c', conv_id), turn*2 + 1, turn*4000 + (conv_id % 5)*100 + 100,
       turn*4000 + (conv_id % 5)*100 + 1100 + length(text) % 3500, lower(text), 'microphone', NULL
FROM conversations WHERE role = 'assistant' AND (conv_id + turn) % 3 = 0
"""

VIEWS["v_jobs"] = """
SELECT concat('o', o_orderkey) AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'live' ELSE 'file' END AS kind,
       concat('Rec_', o_orderpriority, '_', o_custkey, '.wav') AS source_filename,
       o_custkey AS owner, o_orderkey AS arrival,
       CASE o_orderkey % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'preparing' WHEN 2 THEN 'transcribing'
            WHEN 3 THEN 'completed' WHEN 4 THEN 'cancelled' WHEN 5 THEN 'failed' ELSE 'interrupted' END AS status,
       o_orderkey % 3 <> 0 AS queue_visible, o_orderkey % 2 = 0 AS start_requested,
       o_orderkey % 11 = 0 AS cancel_requested
FROM orders
"""

# With the other columns of a recording.
VIEWS["v_recordings"] = f"""
SELECT x.*, arrival * 3 AS created_ms, CASE WHEN status <> 'queued' THEN arrival + 1 END AS started_ms,
       CASE WHEN status IN ('completed', 'cancelled', 'failed', 'interrupted') THEN arrival + 2 END AS completed_ms,
       CASE WHEN status = 'completed' THEN arrival % 90 + 0.5 END AS duration_seconds,
       CASE WHEN status IN ('failed', 'interrupted') THEN concat('e', arrival) END AS error,
       CASE arrival % 3 WHEN 0 THEN concat('a', arrival, '.wav') WHEN 1 THEN '' END AS audio_path,
       concat('/in/', source_filename) AS source_path, arrival % 9 AS completed_chunks,
       CASE WHEN arrival % 2 = 0 THEN arrival % 9 + 1 END AS total_chunks
FROM ({VIEWS["v_jobs"]}) x
"""

_FRAMES = """
SELECT concat('o', o_orderkey) AS tid, f AS frame, ((o_orderkey*31 + (f {div} 12)*17) % 100) AS p100
FROM orders {grid}
"""
VIEWS["v_frames"] = _FRAMES.format(div="div", grid="LATERAL VIEW explode(sequence(0, 199)) g AS f")

VIEWS["v_vad_len"] = """
SELECT concat('o', o_orderkey) AS tid, 200*512 - CAST(o_orderkey % 512 AS INT) AS audio_len
FROM orders
"""

# Names under which later queries read the same.
VIEWS["v_all_frames"], VIEWS["v_all_vad_len"] = VIEWS["v_frames"], VIEWS["v_vad_len"]

VIEWS["v_vectors"] = """
SELECT concat('r', vec_id % 20) AS tid, vec_id AS window_id, vec_id % 7 AS segment_index, embedding, label
FROM embeddings
"""

# Recordings of bounded length, so that their number grows with the table.
VIEWS["v_recording_vectors"] = """
SELECT concat('r', CAST(floor(vec_id / 50) AS INT)) AS tid, vec_id AS window_id, vec_id % 7 AS segment_index, embedding, label
FROM embeddings
"""

# Recordings of ten windows, short enough for clusters in SQL.
VIEWS["v_short_recordings"] = """
SELECT concat('r', CAST(floor(vec_id / 10) AS INT)) AS tid, vec_id AS window_id, embedding
FROM embeddings
"""

VIEWS["v_nodes"] = """
SELECT concat('r', r_regionkey) AS id, 'folder' AS kind, CAST(NULL AS STRING) AS parent_id, r_name AS name,
       CAST(r_regionkey AS BIGINT) AS position FROM region
UNION ALL SELECT concat('n', n_nationkey), 'folder', concat('r', n_regionkey), n_name, CAST(n_nationkey AS BIGINT) FROM nation
UNION ALL SELECT concat('s', s_suppkey), 'folder', concat('n', s_nationkey), s_name, CAST(s_suppkey AS BIGINT) FROM supplier
UNION ALL SELECT concat('c', c_custkey), 'recording', concat('n', c_nationkey), c_name, c_custkey FROM customer
"""

VIEWS["v_changes"] = """
SELECT concat('s', user_id) AS session_id, concat(user_id, ':', CAST(floor(value) AS INT) % 20) AS change_id,
       event_id AS arrival, (event_id * 7) % 50 AS revision, event_type = 'error' AS deleted, props AS payload
FROM events
"""

VIEWS["v_blocks"] = """
SELECT session_id, track_id, seq, event_id AS arrival, n,
       concat(session_id, ':', track_id, ':', seq) AS idempotency_key
FROM (SELECT concat('s', user_id) AS session_id,
             CASE WHEN event_type IN ('click','view','signup') THEN 'microphone' ELSE 'system' END AS track_id,
             row_number() OVER (PARTITION BY user_id, CASE WHEN event_type IN ('click','view','signup')
                 THEN 'microphone' ELSE 'system' END ORDER BY event_id) - 1 AS seq,
             event_id, CAST(480 + event_id % 480 AS INT) AS n FROM events) x
WHERE event_id % 37 <> 0
"""

VIEWS["v_snapshots"] = """
SELECT concat('k', o_custkey) AS original_id, concat('o', o_orderkey) AS revision,
       CASE WHEN o_orderkey % 3 = 0 THEN p2 ELSE p1 END AS parent_revision,
       CASE WHEN o_orderkey % 10 = 1 AND p2 IS NOT NULL THEN p1 END AS merge_a,
       CASE WHEN o_orderkey % 10 = 1 THEN p2 END AS merge_b
FROM (SELECT o_custkey, o_orderkey,
             lag(concat('o', o_orderkey), 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p1,
             lag(concat('o', o_orderkey), 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p2 FROM orders) x
"""

#: What differs in DuckDB.
DUCK = VIEWS | {"v_frames": _FRAMES.format(div="//", grid=", (SELECT unnest(range(200)) AS f) g")}
DUCK["v_all_frames"] = DUCK["v_frames"]

TABLES = {
    "v_segments": ["conversations"], "v_jobs": ["orders"], "v_frames": ["orders"], "v_vad_len": ["orders"], "v_all_frames": ["orders"], "v_all_vad_len": ["orders"], "v_vectors": ["embeddings"], "v_recording_vectors": ["embeddings"], "v_short_recordings": ["embeddings"], "v_recordings": ["orders"],
    "v_nodes": ["region", "nation", "supplier", "customer"], "v_changes": ["events"], "v_blocks": ["events"], "v_snapshots": ["orders"],
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table ``name`` over the tables in ``sf_dir``."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    sql = VIEWS[name]
    return spark.sql(_named(sql, list(tables)), **tables)


def _named(sql: str, tables: list[str]) -> str:
    import re

    for t in tables:
        sql = re.sub(rf"\b(FROM|from) {t}\b", rf"\1 {{{t}}}", sql)
    return sql


def cte(*names: str) -> str:
    """The derived tables as the beginning of a DuckDB query."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({DUCK[n]})" for n in names)
