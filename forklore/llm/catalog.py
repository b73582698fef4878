"""The registered queries of the corpus operators, and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forklore.llm import ann, langid, linededup, merkle, mixing, multiindex, packing, pii, quality, repair, simhash, substring, winnow
from forklore.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, reach=3)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


LINES_SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone
  FROM keyed k LEFT JOIN common c ON c.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query("op8_line_dedup", LINES_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=5, min_chars=40)
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
each AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
  2.0::DOUBLE * source_size AS most FROM each),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
    - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
    / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM placed
  WINDOW w AS (ORDER BY most / weight, source NULLS LAST)),
filled AS (SELECT *, level * weight >= most AS full_up FROM levels),
targets AS (SELECT source, source_size, CASE WHEN full_up THEN most ELSE weight *
    (SELECT level FROM filled WHERE NOT full_up ORDER BY most / weight, source NULLS LAST LIMIT 1) END AS target
  FROM filled),
ranked AS (SELECT s.*, t.source_size, t.target,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS place,
    ('0x' || substr(md5('mix/' || coalesce('s' || s.source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
  FROM sized s JOIN targets t ON t.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
  ((floor(rate * place + start) - floor(rate * (place - 1) + start)) * size)::BIGINT AS taken
FROM ranked"""


@query("op9_mix_sources", MIX_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=4096)


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op2_nearest_neighbours")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


@query("op3_embedding_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


@query("op4_pii_surrogates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymize(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "text", "n_replaced", F.array_join("kinds", ",").alias("kinds"))


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


#: CRC-32 of the text ``{0}`` of plain ASCII, byte by byte and bit by bit; no engine function gives it.
CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ord(ch)::BIGINT FOR ch IN string_split({0}, '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

MERKLE_SQL = f"""
WITH RECURSIVE part AS (
  SELECT doc_id, source, text, concat(strlen(doc_id::VARCHAR), ':', doc_id) AS a,
    coalesce(concat(strlen(source), ':') || source, '-') || coalesce(concat(strlen(lang), ':') || lang, '-')
      || coalesce(concat(strlen(n_chars::VARCHAR), ':') || n_chars::VARCHAR, '-') AS b,
    CASE WHEN {CRC_SQL.format("doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut
  FROM documents),
leaf AS (
  SELECT doc_id, source, sha256(a || b || coalesce(concat(strlen(text), ':') || text, '-')) AS leaf,
    sha256(a || b || coalesce(concat(strlen(cut), ':') || cut, '-')) AS seen,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM part),
node AS (
  SELECT source, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM leaf
  UNION ALL
  SELECT source, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM node WHERE n > 1 GROUP BY source, lvl + 1, pos // 3),
sub AS (SELECT source, h AS subroot, lvl AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place
  FROM node WHERE n = 1),
top AS (
  SELECT 0 AS lvl, place AS pos, subroot AS h, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM top WHERE n > 1 GROUP BY lvl + 1, pos // 3),
near AS (
  SELECT l.doc_id, m.lvl, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < m.pos), '') AS before,
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > m.pos), '') AS after
  FROM leaf l JOIN node m ON m.source IS NOT DISTINCT FROM l.source AND m.n > 1 AND m.pos = l.pos // (3 ** m.lvl)::BIGINT
  JOIN node s ON s.source IS NOT DISTINCT FROM l.source AND s.lvl = m.lvl AND s.pos // 3 = m.pos // 3
  GROUP BY l.doc_id, m.lvl
  UNION ALL
  SELECT l.doc_id, b.height + m.lvl, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < m.pos), ''),
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > m.pos), '')
  FROM leaf l JOIN sub b ON b.source IS NOT DISTINCT FROM l.source
  JOIN top m ON m.n > 1 AND m.pos = b.place // (3 ** m.lvl)::BIGINT
  JOIN top s ON s.lvl = m.lvl AND s.pos // 3 = m.pos // 3
  GROUP BY l.doc_id, b.height, m.lvl),
proof AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY lvl)) AS proof_sha256, count(*) AS levels
  FROM near GROUP BY doc_id),
fold AS (
  SELECT doc_id, 0::BIGINT AS lvl, seen AS h FROM leaf
  UNION ALL
  SELECT f.doc_id, f.lvl + 1, sha256(s.before || f.h || s.after) FROM fold f JOIN near s ON s.doc_id = f.doc_id AND s.lvl = f.lvl),
folded AS (SELECT doc_id, max_by(h, lvl) AS folded_root FROM fold GROUP BY doc_id)
SELECT l.doc_id, l.leaf, b.subroot, r.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root,
  f.folded_root = r.h AS verified
FROM leaf l JOIN sub b ON b.source IS NOT DISTINCT FROM l.source JOIN top r ON r.n = 1
JOIN folded f ON f.doc_id = l.doc_id LEFT JOIN proof p ON p.doc_id = l.doc_id"""


@query("op12_merkle_manifest", MERKLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(table(spark, sf_dir, "documents"))


WORDS_SQL = r"""coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"""

WINNOW_SQL = f"""
WITH doc AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
item AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id::VARCHAR AS item, n, array_to_string(w[i + 1:i + n], ' ') AS span
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(len(w) - least(len(w), 10) + 1)) AS i
    FROM item WHERE len(w) > 0)),
run AS (
  SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS span
  FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i
    FROM doc CROSS JOIN (SELECT DISTINCT n FROM win))),
hit AS (SELECT r.doc_id, r.i, r.n, w.item FROM run r JOIN win w ON w.n = r.n AND w.span = r.span),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id"""


@query("op13_benchmark_decontamination", WINNOW_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


REPAIR_SQL = f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC_SQL.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS nth
  FROM src WHERE k <> 0),
counted AS (
  SELECT *, left(role, 1) AS initial, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM damaged),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS i FROM counted),
row AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS near FROM placed),
stats AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (near NOT IN ('su', 'ua', 'au')) AS illegal
  FROM row GROUP BY conv_id),
ins(state, way, cost, letters, lines) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (0, 2, 5, 'I', ['user:']),
  (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 5, 'I', ['user:']), (1, 3, 10, 'II', ['user:', 'assistant:']),
  (2, 2, 0, '', []), (2, 3, 5, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 5, 'I', ['user:'])),
step(way, letter, initial, cost, role, goal) AS (VALUES (0, 'D', '', 2, '', 0), (1, 'D', '', 2, '', 1), (2, 'D', '', 2, '', 2),
  (3, 'D', '', 2, '', 3), (0, 'K', 's', 0, '', 1), (0, 'K', 'u', 0, '', 2), (1, 'K', 'u', 0, '', 2), (2, 'K', 'a', 0, '', 3),
  (3, 'K', 'u', 0, '', 2), (0, 'R', '', 1, 'user', 2), (1, 'R', '', 1, 'user', 2), (2, 'R', '', 1, 'assistant', 3),
  (3, 'R', '', 1, 'user', 2)),
best AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS at FROM stats
  UNION ALL
  SELECT b.conv_id, r.i, s.goal, min({{'cost': (b.at.cost + n.cost + s.cost
      + CASE WHEN r.fault = 'truncated' AND s.letter <> 'D' THEN 5 ELSE 0 END)::BIGINT, 'audit': b.at.audit || n.letters || s.letter,
    'lines': b.at.lines || n.lines || CASE s.letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [r.role || ':' || r.text]
      ELSE [s.role || ':' || r.text] END}})
  FROM best b JOIN ins n ON n.state = b.state JOIN step s ON s.way = n.way
  JOIN row r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1
  WHERE s.letter = 'D' OR ((r.fault IS NULL OR r.fault = 'truncated') AND (s.letter = 'R' OR s.initial = r.initial))
  GROUP BY b.conv_id, r.i, s.goal),
done AS (
  SELECT t.conv_id, min({{'cost': (b.at.cost + n.cost)::BIGINT, 'audit': b.at.audit || n.letters, 'lines': b.at.lines || n.lines}}) AS at
  FROM best b JOIN stats t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.n = b.i
  JOIN ins n ON n.state = b.state AND n.way IN (0, 3) GROUP BY t.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(d.at.cost, 0)::BIGINT AS cost,
  coalesce(d.at.audit, '') AS audit, sha256(coalesce(array_to_string(d.at.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query("op11_conversation_repair", REPAIR_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_after_damage(table(spark, sf_dir, "conversations"))
