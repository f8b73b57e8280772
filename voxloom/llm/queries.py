"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import chat, decontam, exact_dedup, lexical, merkle, mixing, near_dedup, quality, sharding, substring, token_files, toxicity, url_rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_report(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.preference_pairs(table(spark, sf_dir, "conversations"))
    spans = lambda c: F.array_join(F.transform(F.col(c), lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return rows.withColumn("chosen_mask", spans("chosen_mask")).withColumn("rejected_mask", spans("rejected_mask"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_verdicts(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix_counts(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.CONTRACT)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_token_files, op3_exact_dedup, op4_preference_chat, op5_source_mix, op6_substring_dedup, op7_decontamination, op8_near_dedup,
        op9_quality, op10_url_filter, op11_ranked_search, op12_ring_sharding, op13_merkle_manifest,
    )
}

ORACLES: dict[str, str] = {}

ORACLES["op3_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

MIX_CTE = r"""
sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash
  FROM {docs}),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS DOUBLE) AS weight
  FROM sized GROUP BY source),
leveled AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM totals WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, CASE WHEN cap <= weight * level THEN cap ELSE
         weight * (1.5::DOUBLE * sum(source_size) OVER () - sum(CASE WHEN cap <= weight * level THEN cap ELSE 0.0::DOUBLE END) OVER ())
         / sum(CASE WHEN cap <= weight * level THEN 0.0::DOUBLE ELSE weight END) OVER () END AS target
  FROM leveled),
placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY hash RANGE UNBOUNDED PRECEDING), 0) AS sum_to,
         sum(size) OVER (PARTITION BY s.source, hash) AS at_hash
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (
  SELECT *, CAST(whole + CASE WHEN sum_to - at_hash / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END AS BIGINT) AS copies FROM placed)
"""

ORACLES["op5_source_mix"] = "WITH " + MIX_CTE.format(docs="documents") + "SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM mixed"

LOWER_SQL = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAM_CTE = r"""
doc_words AS (SELECT doc_id, regexp_extract_all(coalesce({lower}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {docs}),
item_words AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(coalesce({lower}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_words WHERE len(w) > 0)),
spots AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS t
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc_words, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
found AS (SELECT doc_id, i, m, item_id FROM spots JOIN windows USING (m, t)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
"""

ORACLES["op7_decontamination"] = (
    "WITH " + DECONTAM_CTE.format(lower=LOWER_SQL.format(x="text"), docs="documents") + """
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
)

NEAR_CTE = r"""
near_words AS (SELECT doc_id, regexp_extract_all(coalesce({lower}, ''), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
near_sets AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS sh FROM near_words)),
near_sizes AS (SELECT doc_id, count(*) AS n FROM near_sets GROUP BY doc_id),
near_links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM near_sets x JOIN near_sets y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL) p
  JOIN near_sizes m ON m.doc_id = p.a JOIN near_sizes n ON n.doc_id = p.b WHERE 100 * c >= 85 * (m.n + n.n - c)),
near_edges AS (SELECT a, b FROM near_links UNION SELECT b, a FROM near_links),
near_reach AS (SELECT doc_id AS id, doc_id AS root FROM near_words UNION SELECT e.b, r.root FROM near_reach r JOIN near_edges e ON e.a = r.id),
near_parts AS (SELECT id, min(root) AS component_id FROM near_reach GROUP BY id)
"""

ORACLES["op8_near_dedup"] = (
    "WITH RECURSIVE " + NEAR_CTE.format(lower=LOWER_SQL.format(x="text"), docs="documents") + """
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM near_words d JOIN near_parts ON id = d.doc_id LEFT JOIN near_sizes s ON s.doc_id = d.doc_id
"""
)

ORACLES["op4_preference_chat"] = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
convs AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
opened AS (SELECT *, turns[1].role AS r, turns[1].text AS x, len(list_filter(turns, lambda s: s.role = 'assistant')) AS k FROM convs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r, x ORDER BY k DESC, conv_id) AS n FROM opened),
lasts AS (SELECT conv_id, turns, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS e FROM convs WHERE len(list_filter(turns, lambda s: s.role = 'assistant')) > 0),
joined AS (
  SELECT 'opening' AS pairing, c.conv_id AS chosen_id, c.turns AS chosen, j.conv_id AS rejected_id, j.turns AS rejected
  FROM ranked c JOIN ranked j ON c.n = 1 AND j.n > 1 AND c.r = j.r AND c.x = j.x
  UNION ALL
  SELECT 'swap', c.conv_id, c.turns, c.conv_id, CASE WHEN d.conv_id IS NULL THEN c.turns[1 : c.e - 1]
         ELSE list_append(c.turns[1 : c.e - 1], {'turn': c.turns[c.e].turn, 'role': c.turns[c.e].role, 'text': d.turns[d.e].text}) END
  FROM lasts c LEFT JOIN lasts d ON d.conv_id = c.conv_id + 1),
pairs AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[i].role <> rejected[i].role OR chosen[i].text <> rejected[i].text)) - 1,
                  least(len(chosen), len(rejected))) AS p FROM joined),
split AS (SELECT *, chosen[1 : p] AS head, chosen[p + 1 :] AS a, rejected[p + 1 :] AS b FROM pairs)
SELECT pairing, chosen_id, rejected_id, CAST(p AS INT) AS n_prompt_turns,
       coalesce(array_to_string(list_transform(head, lambda s: '<|' || s.role || '|>' || chr(10) || s.text || '<|end|>' || chr(10)), ''), '') AS prompt,
       coalesce(array_to_string(list_transform(a, lambda s: '<|' || s.role || '|>' || chr(10) || s.text || '<|end|>' || chr(10)), ''), '') AS chosen_completion,
       coalesce(array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: a[i].role = 'assistant'), lambda i:
         CAST(coalesce(list_sum(list_transform(a[1 : i - 1], lambda s: length(s.role) + length(s.text) + 13)), 0)::BIGINT + length(a[i].role) + 5 AS VARCHAR) || '-' ||
         CAST(list_sum(list_transform(a[1 : i], lambda s: length(s.role) + length(s.text) + 13))::BIGINT AS VARCHAR)), ','), '') AS chosen_mask,
       coalesce(array_to_string(list_transform(b, lambda s: '<|' || s.role || '|>' || chr(10) || s.text || '<|end|>' || chr(10)), ''), '') AS rejected_completion,
       coalesce(array_to_string(list_transform(list_filter(range(1, len(b) + 1), lambda i: b[i].role = 'assistant'), lambda i:
         CAST(coalesce(list_sum(list_transform(b[1 : i - 1], lambda s: length(s.role) + length(s.text) + 13)), 0)::BIGINT + length(b[i].role) + 5 AS VARCHAR) || '-' ||
         CAST(list_sum(list_transform(b[1 : i], lambda s: length(s.role) + length(s.text) + 13))::BIGINT AS VARCHAR)), ','), '') AS rejected_mask,
       len(a) + len(b) > 0 AS distinct_pair
FROM split
"""

ORACLES["op11_ranked_search"] = r"""
WITH doc_terms AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents) GROUP BY ALL),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM doc_terms GROUP BY doc_id),
whole AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS l FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM doc_terms GROUP BY term), whole),
item_terms AS (
  SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l)))) AS BIGINT) AS score
  FROM item_terms JOIN doc_terms USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20
""".format(lower=LOWER_SQL.format(x="text"))

CRC_CTE = """
crc_table AS (
  SELECT list(c ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)))
"""
#: Of a column of hexadecimal text.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen({h}) // 2), lambda k: CAST('0x' || substr({h}, 2 * k + 1, 2) AS BIGINT))),
            lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"""

#: The sequential rule: documents in the order of their second hash, each to the first shard clockwise that has room.
ORACLES["op12_ring_sharding"] = (
    "WITH RECURSIVE " + CRC_CTE + """,
tokens AS (
  SELECT s, CAST('0x' || substr(md5(s || ':' || v), 1, 4) AS BIGINT) AS token
  FROM (SELECT unnest(range(8)) AS s), (SELECT unnest(range(256)) AS v)),
keyed AS (
  SELECT doc_id, coalesce(text, '') AS x, hex(coalesce(text, '')) AS h, CAST('0x' || substr(md5('at:' || doc_id), 1, 4) AS BIGINT) AS place,
         CAST('0x' || substr(md5('order:' || doc_id), 1, 15) AS BIGINT) AS k FROM documents),
reach AS (SELECT doc_id, s, min((token - place + 65536) % 65536) AS d FROM keyed, tokens GROUP BY doc_id, s),
prefs AS (SELECT doc_id, list(s ORDER BY d, s) AS prefs FROM reach GROUP BY doc_id),
placed AS (SELECT doc_id, prefs, k, row_number() OVER (ORDER BY k) AS i FROM keyed JOIN prefs USING (doc_id)),
run AS (
  SELECT CAST(0 AS BIGINT) AS i, list_transform(range(8), lambda s: n // 8 + CASE WHEN s < n % 8 THEN 1 ELSE 0 END) AS room, CAST(NULL AS BIGINT) AS shard FROM (SELECT count(*) AS n FROM documents)
  UNION ALL
  SELECT i, list_transform(range(8), lambda s: room[s + 1] - CASE WHEN s = pick THEN 1 ELSE 0 END), pick
  FROM (SELECT p.i, r.room, list_filter(p.prefs, lambda s: r.room[s + 1] > 0)[1] AS pick FROM run r JOIN placed p ON p.i = r.i + 1))
SELECT doc_id, CAST(strlen(x) + 1 AS BIGINT) AS size, CAST(""" + CRC_SQL.format(h="h") + """ AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY k) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, CAST(prefs[1] AS INT) AS home
FROM run JOIN placed USING (i) JOIN keyed USING (doc_id, k), crc_table
"""
)

#: Levels of the tree that the SQL spells out: enough for 16^6 leaves in a source, and as many sources.
MERKLE_LEVELS = 6


def _merkle_sql() -> str:
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lower = LOWER_SQL.format(x="text")
    parts = [CRC_CTE, f"""
leaves AS (
  SELECT doc_id, source AS tree, {leaf("text")} AS leaf, CASE WHEN {CRC_SQL.format(h="h")} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS cur,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT *, hex(CAST(doc_id AS VARCHAR)) AS h FROM documents), crc_table),
s0 AS (SELECT tree, i, n, leaf AS d FROM leaves),
p0 AS (SELECT doc_id, tree, i, leaf, cur, '' AS sib FROM leaves)"""]

    def climb(nodes: str, paths: str, key: str) -> None:
        for k in range(MERKLE_LEVELS):
            parts.append(f"""
{nodes}r{k} AS (SELECT {key}, i // 16 AS i, max(n) AS n, list(d ORDER BY i) AS run FROM {nodes}{k} GROUP BY {key}, i // 16),
{nodes}{k + 1} AS (SELECT {key}, i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS d FROM {nodes}r{k}),
{paths}{k + 1} AS (
  SELECT p.* EXCLUDE (i, cur, sib), p.i // 16 AS i,
         CASE WHEN n > 1 THEN sha256(array_to_string(run[1 : p.i % 16], '') || cur || array_to_string(run[p.i % 16 + 2 :], '')) ELSE cur END AS cur,
         CASE WHEN n > 1 THEN sib || array_to_string(run[1 : p.i % 16], '') || array_to_string(run[p.i % 16 + 2 :], '') ELSE sib END AS sib
  FROM {paths}{k} p JOIN {nodes}r{k} r ON p.{key} IS NOT DISTINCT FROM r.{key} AND p.i // 16 = r.i)""")

    climb("s", "p", "tree")
    last = MERKLE_LEVELS
    parts.append(f"""
f0 AS (SELECT 0 AS forest, tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n, d FROM s{last}),
q0 AS (SELECT p.doc_id, p.leaf, p.cur, p.sib, f.d AS subroot, f.i, 0 AS forest FROM p{last} p JOIN f0 f ON p.tree IS NOT DISTINCT FROM f.tree)""")
    climb("f", "q", "forest")
    return "WITH " + ",".join(parts) + f"""
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM q{last}, (SELECT d AS root FROM f{last})
"""


ORACLES["op13_merkle_manifest"] = _merkle_sql()
