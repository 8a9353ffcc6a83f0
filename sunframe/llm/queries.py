"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (alignment, ann, bfd_packing, curriculum, exact_topk, hmm, langid, periodic_runs, pii, quoting,
               retrieval_packing, simhash, toxicity)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_retrieval_packing")
def op2(spark, sf_dir):
    return retrieval_packing.pack_report(table(spark, sf_dir, "documents"))


@query("op3_language_id")
def op3(spark, sf_dir):
    return langid.predictions(table(spark, sf_dir, "documents"))


@query("op5_curriculum_mix")
def op5(spark, sf_dir):
    return curriculum.mix_report(table(spark, sf_dir, "documents"))


@query("op7_simhash_pivots")
def op7(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_personal_data")
def op10(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query("op1_exact_topk")
def op1(spark, sf_dir):
    return exact_topk.top_twenty(table(spark, sf_dir, "embeddings"))


@query("op8_adaptive_scan")
def op8(spark, sf_dir):
    return ann.nearest_twenty(table(spark, sf_dir, "embeddings"))


@query("op9_hidden_markov")
def op9(spark, sf_dir):
    return hmm.score_documents(table(spark, sf_dir, "documents"))


@query("op6_best_fit_packing")
def op6(spark, sf_dir):
    return bfd_packing.pack(table(spark, sf_dir, "documents"))


#: The SQL twin of op4: lines, passages, sources and roots by plain joins and a recursive view.
OP4_SQL = r"""
WITH RECURSIVE rows_ AS (
  SELECT row_number() OVER () AS id, conv_id, turn, role, text FROM conversations),
lines AS (
  SELECT id, u.pos, u.line, length(regexp_replace(regexp_extract(u.line, '^([ \t]*>)+'), '[^>]', '', 'g')) AS level
  FROM (SELECT id, unnest(regexp_split_to_array(text, '\r?\n')) AS line,
               generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS pos FROM rows_) u),
bodies AS (
  SELECT id, pos, level, CASE WHEN level > 0 THEN regexp_replace(line, '^([ \t]*>)+ ?', '') ELSE line END AS body,
         level = 0 AND coalesce(lead(level) OVER (PARTITION BY id ORDER BY pos), 0) > 0 AND regexp_matches(line,
           '(?i)^[ \t]*(on .{1,200} wrote|am .{1,200} schrieb.*|le .{1,200} a écrit|el .{1,200} escribió)[ \t]*:[ \t]*$') AS intro,
         sum(CASE WHEN prev IS NULL OR prev <> level THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS run
  FROM (SELECT *, lag(level) OVER (PARTITION BY id ORDER BY pos) AS prev FROM lines)),
own AS (
  SELECT id, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (WHERE level = 0 AND NOT intro), ''),
                            '^\s+|\s+$', '', 'g') AS clean, max(level) AS top FROM bodies GROUP BY id),
msg AS (
  SELECT r.id, conv_id, turn, role, CASE WHEN top > 0 THEN clean ELSE text END AS clean_text, coalesce(top, 0) AS top
  FROM rows_ r LEFT JOIN own USING (id)),
runs AS (
  SELECT id, run, level, trim(regexp_replace(lower(string_agg(body, chr(10) ORDER BY pos)), '\s+', ' ', 'g')) AS plain
  FROM bodies WHERE level > 0 GROUP BY id, run, level),
quotes AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY run) - 1 AS pos, level, plain
  FROM runs WHERE regexp_matches(plain, '[\p{L}\p{N}]')),
said AS (
  SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(u), '\s+', ' ', 'g')) AS plain FROM (
    SELECT conv_id, turn, unnest(list_concat([clean_text], regexp_split_to_array(clean_text, '\n\s*\n'),
                                             regexp_split_to_array(clean_text, '\n'))) AS u FROM msg)
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND regexp_matches(u, '[\p{L}\p{N}]')),
asked AS (
  SELECT DISTINCT m.conv_id, m.turn, q.pos, q.level, q.plain FROM quotes q JOIN msg m USING (id)
  WHERE m.conv_id IS NOT NULL AND m.turn IS NOT NULL),
near AS (
  SELECT a.conv_id, a.turn, a.pos, a.level, a.plain, max(s.turn) AS near FROM asked a
  LEFT JOIN said s ON s.conv_id = a.conv_id AND s.plain = a.plain AND s.turn < a.turn GROUP BY ALL),
far AS (SELECT plain, min({'c': conv_id, 't': turn}) AS far FROM said GROUP BY plain),
links AS (
  SELECT * FROM (
    SELECT n.conv_id, n.turn, pos, level, CASE WHEN near IS NOT NULL THEN n.conv_id ELSE far.c END AS parent_conv,
           coalesce(near, far.t) AS parent_turn FROM near n LEFT JOIN far USING (plain))
  WHERE parent_turn IS NOT NULL AND NOT (parent_conv = conv_id AND parent_turn >= turn)),
parents AS (
  SELECT conv_id, turn, count(*) AS n_linked, min(CASE WHEN level = 1 THEN {'a': pos, 'c': parent_conv, 't': parent_turn} END) AS p
  FROM links GROUP BY conv_id, turn),
climb AS (
  SELECT conv_id, turn, p.t AS root, 1 AS depth FROM parents WHERE p.c = conv_id
  UNION ALL
  SELECT c.conv_id, c.turn, q.p.t, c.depth + 1 FROM climb c JOIN parents q ON q.conv_id = c.conv_id AND q.turn = c.root AND q.p.c = q.conv_id),
roots AS (SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM climb GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, role, clean_text,
       CAST((SELECT count(*) FROM quotes q WHERE q.id = m.id) AS BIGINT) AS n_quotes, CAST(top AS BIGINT) AS max_quote_level,
       CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, p.c AS parent_conv, p.t AS parent_turn,
       coalesce(root, m.turn) AS root_turn, CAST(coalesce(r.depth, 0) AS BIGINT) AS depth
FROM msg m LEFT JOIN parents pa ON pa.conv_id = m.conv_id AND pa.turn = m.turn
LEFT JOIN roots r ON r.conv_id = m.conv_id AND r.turn = m.turn
"""


@query("op4_quotation_links", OP4_SQL)
def op4(spark, sf_dir):
    return quoting.conversations_without_quotes(table(spark, sf_dir, "conversations"))


#: The SQL twin of op12: equal words of a document give (place, distance) pairs, their islands the runs.
OP12_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS id, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
hashed AS (
  SELECT id, doc_id, w, len(w) AS n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda s, c: list_reduce(range(8), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END,
                             xor(s, c)), CAST(4294967295 AS BIGINT))) END AS h FROM texts),
starts AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM hashed),
periods AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM starts),
words AS (
  SELECT id, i, w[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END] AS word
  FROM periods, unnest(range(n)) u(i)),
pairs AS (
  SELECT x.id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.id = y.id AND x.word = y.word AND x.i < y.i),
islands AS (SELECT id, q, i, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS g FROM pairs),
whole AS (
  SELECT id, q, min(i) AS s, max(i) + 1 + q AS e FROM islands GROUP BY id, q, g
  HAVING max(i) + 1 + q - min(i) >= greatest(12, 2 * q)),
runs AS (SELECT id, s, e, min(q) AS q FROM whole GROUP BY id, s, e),
gone AS (SELECT DISTINCT id, i FROM runs, unnest(range(s + q, e)) u(i)),
kept AS (
  SELECT id, string_agg(word, ' ' ORDER BY i) AS words FROM words ANTI JOIN gone USING (id, i) GROUP BY id),
listed AS (
  SELECT id, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS runs,
         max({'l': e - s, 's': -s, 'q': -q}) AS best FROM runs GROUP BY id)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(-best.s AS BIGINT) AS start,
       CAST(best.l AS BIGINT) AS length, CAST(-best.q AS BIGINT) AS period,
       CAST(1000 * best.l // -best.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(listed.runs, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM texts LEFT JOIN listed USING (id) LEFT JOIN kept USING (id)
"""


@query("op12_periodic_runs", OP12_SQL)
def op12(spark, sf_dir):
    return periodic_runs.run_report(table(spark, sf_dir, "documents"))


@query("op11_token_alignment")
def op11(spark, sf_dir):
    return alignment.alignment_report(table(spark, sf_dir, "documents"))


@query("op13_weak_toxicity")
def op13(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
