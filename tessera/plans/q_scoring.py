"""Registered scoring queries: labels by description, sentiment by rules.

The invented prose holds neither the original candidate labels' words nor
English negators, so the queries pass descriptions and rule lists made of words
that do occur; the operators default to the English lists.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import describe as ds
from tessera.operators import labels as lb
from tessera.operators import rules as rl
from tessera.plans import sqlbits as S
from tessera.plans.q_labels import _LEX_SQL, lexicon
from tessera.plans.q_models import PROBE_STOP_WORDS, _stop_sql, _terms
from tessera.plans.registry import register
from tessera.schemas import SENTIMENT_LABELS
from tessera.sources.tables import POSTS_SQL, posts, table, with_ctes

PROBE_LABELS = {
    "a text with French words": "pour dans sur avec pas",
    "a text with German words": "von den das mit sich",
    "a text with Spanish words": "del las por para con",
    "a text with English words": "than then thing thou at",
}
PROBE_SENTIMENTS = dict(zip(SENTIMENT_LABELS, ("than pour von thth", "dans thing sich thon", "sur mit por then")))
PROBE_RULES = rl.Rules(negators=("that", "la"), stronger=("it", "die", "er"), weaker=("was", "und"), contrast=("with", "que"))


def _fit_sql(descriptions: dict[str, str]) -> str:
    """CTEs of the fitted model: ``voc``, ``weights`` (label, term, w, seed)."""
    rows = ", ".join(f"({i}, {S.q(n)}, {S.q(d)})" for i, (n, d) in enumerate(descriptions.items()))
    return f"""descr(label, name, words) AS (VALUES {rows}),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents) GROUP BY 1, 2),
total AS (SELECT count(*)::DOUBLE AS n FROM documents),
voc AS MATERIALIZED (SELECT term, docs, ln((total.n + 1.0) / (docs + 1.0)) AS idf FROM (
    SELECT term, sum(c) AS n, count(*) AS docs FROM tf WHERE NOT list_contains({_stop_sql()}, term) GROUP BY term) g, total
  WHERE docs >= 3 AND docs <= 0.5 * total.n ORDER BY g.n DESC, term LIMIT 500),
seeds AS (SELECT label, term, count(*) AS c, any_value(idf) AS idf FROM (SELECT label, unnest({_terms('words')}) AS term FROM descr)
  JOIN voc USING (term) GROUP BY ALL),
apart AS (SELECT s.term AS seed, b.term, count(*) / sqrt(vs.docs::DOUBLE * vt.docs) AS a
  FROM (SELECT DISTINCT term FROM seeds) s JOIN tf t ON t.term = s.term JOIN tf b ON b.doc_id = t.doc_id
  JOIN voc vs ON vs.term = s.term JOIN voc vt ON vt.term = b.term GROUP BY s.term, b.term, vs.docs, vt.docs),
near AS (SELECT s.label, apart.term, round(sum(a) / any_value(z.n), 9) AS a
  FROM apart JOIN seeds s ON s.term = apart.seed JOIN (SELECT label, count(*) AS n FROM seeds GROUP BY label) z ON z.label = s.label
  WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.label = s.label AND x.term = apart.term) GROUP BY ALL),
added AS (SELECT label, term, a, row_number() OVER (PARTITION BY label ORDER BY a DESC, term) AS r FROM near),
raw AS (SELECT label, term, c * idf AS w, true AS seed FROM seeds
        UNION ALL SELECT label, term, 0.5 * a * idf, false FROM added JOIN voc USING (term) WHERE r <= 20),
weights AS MATERIALIZED (SELECT label, term, w / sqrt(sum(w * w) OVER (PARTITION BY label)) AS w, seed FROM raw)"""


def _score_sql(unit: str, counts: str, units: str, name: str) -> str:
    """CTEs ``<name>`` (unit, label, name, cosine) from term counts per unit."""
    return f"""{name}_norm AS (SELECT {unit}, sqrt(sum((c * idf) ** 2)) AS norm FROM {counts} JOIN voc USING (term) GROUP BY {unit}),
{name}_dot AS (SELECT {unit}, label, sum(c * idf * w) AS d, bool_or(seed) AS seeded FROM {counts} JOIN voc USING (term) JOIN weights USING (term)
  GROUP BY {unit}, label),
{name} AS MATERIALIZED (SELECT {unit}, descr.label, descr.name, coalesce(seeded, false) AS seeded, round(coalesce(d / norm, 0.0), 9) AS cosine
  FROM {units} CROSS JOIN descr LEFT JOIN {name}_dot USING ({unit}, label) LEFT JOIN {name}_norm USING ({unit}))"""


def _temperature_sql() -> str:
    """CTE ``heat`` (t) from ``cos``, the documents' cosines."""
    grid = ", ".join(f"({t}::DOUBLE)" for t in ds.TEMPERATURES)
    return f"""grid(t) AS (VALUES {grid}),
tried AS (SELECT t, doc_id, seeded, count_if(seeded) OVER one AS n, exp(cosine / t) / sum(exp(cosine / t)) OVER one AS p FROM cos, grid
  WINDOW one AS (PARTITION BY doc_id, t)),
loss AS (SELECT t, round(avg(-ln(p)), 9) AS l FROM tried WHERE seeded AND n = 1 GROUP BY t),
heat AS (SELECT coalesce((SELECT t FROM loss ORDER BY l, t LIMIT 1), 0.1) AS t)"""


def _share_sql(unit: str, source: str) -> str:
    return f"""share AS (SELECT {unit}, label, name, exp(cosine / t) / sum(exp(cosine / t)) OVER (PARTITION BY {unit}) AS score FROM {source}, heat),
best AS (SELECT {unit}, first(name ORDER BY round(score, 12) DESC, label) AS label, max(score) AS score FROM share GROUP BY {unit})"""


def _model(spark, sf, descriptions):
    return ds.fit_labels(table(spark, sf, "documents"), "doc_id", "text", descriptions, PROBE_STOP_WORDS)


@register("zero_shot_labels", f"""
WITH {_fit_sql(PROBE_LABELS)},
{_score_sql('doc_id', 'tf', '(SELECT doc_id FROM documents)', 'cos')}, {_temperature_sql()}, {_share_sql('doc_id', 'cos')}
SELECT doc_id, CASE WHEN score >= 0.5 THEN label ELSE 'UNSURE' END AS secondary_label,
  CASE WHEN score >= 0.5 THEN round(score, 6) ELSE 0.0::DOUBLE END AS secondary_score FROM best""")
def q_zero_shot_labels(spark, sf):
    """Every document's best label by description, UNSURE below one half."""
    model = _model(spark, sf, PROBE_LABELS)
    t = lb.top_label(F.transform("scores", lambda s: F.round(s, 12)), model.names, 0.5)
    return ds.score_labels(model, table(spark, sf, "documents"), ["doc_id"], "text").select(
        "doc_id", t["label"].alias("secondary_label"), F.round(t["score"], 6).alias("secondary_score"))


@register("label_cosines", f"""
WITH {_fit_sql(PROBE_LABELS)}, {_score_sql('doc_id', 'tf', '(SELECT doc_id FROM documents)', 'cos')}, {_temperature_sql()},
m AS (SELECT label, avg(cosine) AS mean FROM cos GROUP BY label)
SELECT doc_id, name, round(cosine, 6) AS cosine, round(1 / (1 + exp((mean - cosine) / t)), 6) AS score FROM cos JOIN m USING (label), heat""")
def q_label_cosines(spark, sf):
    """All labels of every document, each scored for itself."""
    model = _model(spark, sf, PROBE_LABELS)
    out = ds.score_labels(model, table(spark, sf, "documents"), ["doc_id"], "text", multi_label=True)
    names = F.array(*[F.lit(n) for n in model.names])
    rows = out.select("doc_id", F.inline(F.arrays_zip(names.alias("name"), F.col("cosines").alias("cosine"), F.col("scores").alias("score"))))
    return rows.select("doc_id", "name", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


@register("secondary_on_nontechnical", with_ctes(POSTS_SQL) + f"""
, {_fit_sql(PROBE_LABELS)},
{_score_sql('doc_id', 'tf', '(SELECT doc_id FROM documents)', 'cos')}, {_temperature_sql()}, {_share_sql('doc_id', 'cos')}
SELECT p.id,
  CASE WHEN p.primary_label IS DISTINCT FROM 'TECHNICAL' AND b.score >= 0.5 THEN b.label ELSE 'UNSURE' END AS secondary_label,
  CASE WHEN p.primary_label IS DISTINCT FROM 'TECHNICAL' AND b.score >= 0.5 THEN round(b.score, 6) ELSE 0.0::DOUBLE END AS secondary_score
FROM posts p JOIN best b ON b.doc_id = p.id""")
def q_secondary_on_nontechnical(spark, sf):
    """Secondary labels by description only for rows not labelled TECHNICAL
    (null counts as not technical); the rest get (UNSURE, 0.0)."""
    model = _model(spark, sf, PROBE_LABELS)
    scored = ds.score_labels(model, table(spark, sf, "documents"), ["doc_id"], "text").select(
        F.col("doc_id").alias("id"), F.transform("scores", lambda s: F.round(s, 12)).alias("scores"))
    p = posts(spark, sf).select("id", "primary_label").join(scored, "id")
    out = lb.label_where(p, ~F.col("primary_label").eqNullSafe("TECHNICAL"), F.col("scores"), model.names, 0.5)
    return out.select("id", "secondary_label", F.round("secondary_score", 6).alias("secondary_score"))


@register("chunk_classifier_sentiment", f"""
WITH {_fit_sql(PROBE_SENTIMENTS)},
{_score_sql('doc_id', 'tf', '(SELECT doc_id FROM documents)', 'cos')}, {_temperature_sql()},
w AS (SELECT doc_id, {S.words('text')} AS ws FROM documents),
ch AS (SELECT doc_id * 100000 + start // 300 AS unit, doc_id, array_to_string(list_slice(ws, start + 1, start + 300), ' ') AS chunk FROM (
  SELECT doc_id, ws, unnest(generate_series(0, len(ws) - 1, 300)) AS start FROM w WHERE len(ws) > 0)),
ctf AS (SELECT unit, term, count(*) AS c FROM (SELECT unit, unnest({_terms('chunk')}) AS term FROM ch) GROUP BY 1, 2),
{_score_sql('unit', 'ctf', '(SELECT unit FROM ch)', 'ccos')}, {_share_sql('unit', 'ccos')},
s AS (SELECT doc_id, sum(CASE WHEN label = 'positive' THEN score ELSE 0.0 END) AS a,
        sum(CASE WHEN label = 'neutral' THEN score ELSE 0.0 END) AS b,
        sum(CASE WHEN label = 'negative' THEN score ELSE 0.0 END) AS c FROM ch JOIN best USING (unit) GROUP BY doc_id)
SELECT d.doc_id, round(a / (a + b + c), 6) AS positive, round(b / (a + b + c), 6) AS neutral, round(c / (a + b + c), 6) AS negative
FROM documents d LEFT JOIN s USING (doc_id)""")
def q_chunk_classifier_sentiment(spark, sf):
    """The best sentiment description of every 300-word chunk, votes added up
    per document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = _model(spark, sf, PROBE_SENTIMENTS)
    r = lb.chunk_vote_sentiment(ds.score_chunks(model, docs, "doc_id", "text"), "doc_id", docs=docs)
    return r.select("doc_id", *[F.round(F.col("roberta_scores")[n], 6).alias(n) for n in SENTIMENT_LABELS])


def _list(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(S.q(w) for w in words) + ")"


_R = PROBE_RULES
_PUNCT = S.q(rl.PUNCTUATION)
_WORDS = f"""w AS (SELECT doc_id, regexp_matches(text, '\\p{{Ll}}') AS plain, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos
  FROM (SELECT doc_id, text, {S.words('text')} AS ws FROM documents)),
k AS (SELECT *, lower(trim(w, {_PUNCT})) AS core FROM w)"""


def _boost(j: int) -> str:
    return (f"CASE WHEN p{j} IN {_list(_R.stronger)} THEN {_R.boost * _R.fading[j - 1]!r}::DOUBLE "
            f"WHEN p{j} IN {_list(_R.weaker)} THEN {-_R.boost * _R.fading[j - 1]!r}::DOUBLE ELSE 0.0 END")


@register("rule_sentiment", f"""
WITH {_LEX_SQL}, {_WORDS},
h AS (SELECT *, pos // 300 AS chunk_no, pos % 300 AS place, lag(core, 1) OVER c AS p1, lag(core, 2) OVER c AS p2, lag(core, 3) OVER c AS p3
  FROM k WINDOW c AS (PARTITION BY doc_id, pos // 300 ORDER BY pos)),
v AS (SELECT doc_id, chunk_no, place, length(w) - length(replace(w, '!', '')) AS marks, CASE WHEN core IN {_list(_R.contrast)} THEN place END AS turn,
    (weight + sign(weight) * CASE WHEN plain AND length(core) > 1 AND upper(w) = w AND lower(w) <> w THEN {_R.capitals} ELSE 0.0 END
      + sign(weight) * ({_boost(1)} + {_boost(2)} + {_boost(3)}))
      * CASE WHEN p1 IN {_list(_R.negators)} OR p2 IN {_list(_R.negators)} OR p3 IN {_list(_R.negators)} THEN {_R.negation} ELSE 1.0 END AS v
  FROM h LEFT JOIN lex ON lex.word = h.core),
t AS (SELECT *, min(turn) OVER (PARTITION BY doc_id, chunk_no) AS first_turn FROM v),
s AS (SELECT doc_id, chunk_no, least(sum(marks), {_R.exclamations}) AS marks,
    coalesce(sum(v * CASE WHEN place < first_turn THEN {_R.before} WHEN place > first_turn THEN {_R.after} ELSE 1.0 END), 0.0)::DOUBLE AS s
  FROM t GROUP BY doc_id, chunk_no),
e AS (SELECT doc_id, s + sign(s) * marks * {_R.exclamation} AS s FROM s),
a AS (SELECT doc_id, avg(s / sqrt(s * s + 15.0)) AS score FROM e GROUP BY doc_id)
SELECT d.doc_id, round(score, 6) AS score, CASE WHEN score IS NULL THEN 'neutral' ELSE {S.polarity_label('score', 0.05, True)} END AS label
FROM documents d LEFT JOIN a USING (doc_id)""")
def q_rule_sentiment(spark, sf):
    """Sentiment of every document by rules over the order of its words."""
    r = rl.rule_sentiment(table(spark, sf, "documents"), "doc_id", "text", lexicon(spark, sf).select("word", "weight"), PROBE_RULES)
    return r.select("doc_id", F.round("score", 6).alias("score"), "label")


def _polarity_sql(rows: str) -> str:
    """CTE ``a`` (doc_id, p, q) from ``k`` (doc_id, pos, core)."""
    return f"""x AS (SELECT doc_id, core, lag(core, 1) OVER d AS p1, lag(core, 2) OVER d AS p2 FROM {rows} WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT doc_id, polarity, subjectivity, p1, p2,
    CASE WHEN p1 IN {_list(_R.stronger)} THEN {_R.more} WHEN p1 IN {_list(_R.weaker)} THEN {_R.fewer} ELSE 1.0 END::DOUBLE AS factor
  FROM x JOIN lex ON lex.word = x.core),
a AS (SELECT doc_id, avg(greatest(-1.0, least(1.0, polarity * factor)) * CASE WHEN p1 IN {_list(_R.negators)} OR (factor <> 1 AND p2 IN {_list(_R.negators)})
    THEN {_R.reversal} ELSE 1.0 END)::DOUBLE AS p, avg(greatest(0.0, least(1.0, subjectivity * factor)))::DOUBLE AS q FROM f GROUP BY doc_id)"""


@register("rule_polarity", f"""
WITH {_LEX_SQL}, {_WORDS}, {_polarity_sql('k')},
r AS (SELECT d.doc_id, coalesce(p, 0.0) AS p, coalesce(q, 0.0) AS q FROM documents d LEFT JOIN a USING (doc_id))
SELECT doc_id, round(p, 10) AS tb_polarity, round(q, 10) AS tb_subjectivity, {S.polarity_label('p', 0.05, False)} AS tb_sentiment FROM r""")
def q_rule_polarity(spark, sf):
    """Polarity and subjectivity of every document, with intensifiers and negators."""
    r = rl.rule_polarity(table(spark, sf, "documents"), "doc_id", "text", lexicon(spark, sf), PROBE_RULES)
    return r.select("doc_id", F.round("tb_polarity", 10).alias("tb_polarity"), F.round("tb_subjectivity", 10).alias("tb_subjectivity"), "tb_sentiment")


@register("query_sentiment", f"""
WITH {_LEX_SQL},
documents AS (SELECT item_id AS doc_id, substring(text, 1, 1000) AS text FROM benchmark), {_WORDS}, {_polarity_sql('k')},
r AS (SELECT d.doc_id AS item_id, coalesce(p, 0.0) AS p, coalesce(q, 0.0) AS s FROM documents d LEFT JOIN a USING (doc_id))
SELECT item_id, round(p, 6) AS query_polarity, round(s, 6) AS query_subjectivity, {S.polarity_label('p', 0.05, False)} AS query_sentiment_label FROM r""")
def q_query_sentiment(spark, sf):
    """Sentiment of each query text's first 1000 characters (search queries
    stand in as the ``benchmark`` passages), with intensifiers and negators."""
    def polarity(df, id_col, text_col, lex):
        return rl.rule_polarity(df, id_col, text_col, lex, PROBE_RULES)
    r = lb.query_sentiment(table(spark, sf, "benchmark"), "item_id", "text", lexicon(spark, sf), 1000, polarity)
    return r.select("item_id", F.round("query_polarity", 6).alias("query_polarity"),
                    F.round("query_subjectivity", 6).alias("query_subjectivity"), "query_sentiment_label")
