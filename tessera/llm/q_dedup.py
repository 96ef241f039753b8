"""Queries over ``documents``: line deduplication and source mixing."""

from __future__ import annotations

from tessera.llm.common import read
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.mixing import mix
from tessera.llm.registry import register

OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS win
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM d WHERE len(ls) >= 3)
      WHERE trim(ls[i], ' ') <> '' OR trim(ls[i + 1], ' ') <> '' OR trim(ls[i + 2], ' ') <> ''),
f AS (SELECT win, min({'d': doc_id, 'i': i}) AS first FROM w GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS pos
         FROM w JOIN f USING (win) WHERE doc_id <> first.d OR i <> first.i),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM d)
SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL), '') AS text,
       count(*) AS n_lines, count(gone.pos) AS n_removed
FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS th, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2 * source_size AS cap FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS caps_before,
        sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight,
        1.5::DOUBLE * sum(source_size) OVER () AS want
      FROM n WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT *, (want - caps_before) / open_weight AS level FROM c),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT arg_min(level, cap::DOUBLE / weight) FROM lv WHERE level * weight < cap)) AS target FROM n),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || th), 1, 13) AS BIGINT)
    / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source"""


@register("op7_line_dedup", OP7_SQL)
def op7_line_dedup(spark, sf_dir):
    """Kept text of every document, with its line count and lines removed."""
    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@register("op3_mixing", OP3_SQL)
def op3_mixing(spark, sf_dir):
    """Words taken of every document under the source targets."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
