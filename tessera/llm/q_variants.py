"""Query over ``documents``: spelling variants of the vocabulary."""

from __future__ import annotations

from tessera.llm.common import read
from tessera.llm.q_trie import CRC_SQL, crc_sql
from tessera.llm.registry import register
from tessera.llm.variants import noisy_words, variants

_BYTES = ("flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), "
          "lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c)::BIGINT - 64] END))")

OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
hashed AS (SELECT run, n, {crc_sql(_BYTES)} AS h FROM (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL), crc_table),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (
  SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS MATERIALIZED (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT less.word, w.word FROM less JOIN w ON less.rest = w.word
  UNION SELECT w.word, less.word FROM less JOIN w ON less.rest = w.word),
best AS (SELECT a AS word, count(*) AS n_near, min({{'less': -w.n, 'form': b}}) AS best FROM near JOIN w ON w.word = b GROUP BY a),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.best.less >= 10 * w.n THEN best.best.form END AS form,
    CASE WHEN -best.best.less >= 10 * w.n THEN -best.best.less END AS form_n
  FROM w LEFT JOIN best USING (word)),
way AS (SELECT word, word AS root, 0 AS step FROM forms
        UNION ALL SELECT way.word, f.form, step + 1 FROM way JOIN forms f ON f.word = way.root WHERE f.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(root, step) FROM way WHERE way.word = forms.word) AS root, n, n_near, form_n::BIGINT AS form_n FROM forms"""


@register("op13_variants", OP13_SQL)
def op13_variants(spark, sf_dir):
    """Every word with its form, the root of its forms, and its near words."""
    return variants(noisy_words(read(spark, sf_dir, "documents")))
