"""Registered label and sentiment queries.

Stand-ins: the sentiment lexicon is derived from the words of the
``benchmark`` passages (a deterministic weight per word), so it grows with
the data; classifier outputs per chunk and candidate-label scores follow
FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import labels as lb
from tessera.plans import sqlbits as S
from tessera.plans.registry import register
from tessera.schemas import PRIMARY_LABELS, SECONDARY_LABELS, SENTIMENT_LABELS
from tessera.session import stage_table
from tessera.sources.tables import POSTS_SQL, SCORERS_SQL, scorer_labels, table, with_ctes

_PS = with_ctes(POSTS_SQL, SCORERS_SQL)


def lexicon(spark, sf):
    """(word, weight, polarity, subjectivity) for every distinct benchmark word,
    staged, so that the planner knows its size."""
    b = table(spark, sf, "benchmark")
    w = b.select(F.explode(tx.words("text")).alias("w")).select(F.lower("w").alias("word")).distinct()
    n = F.length("word")
    return stage_table(w.select("word", (((n * 7) % 9 - 4) / 4.0).alias("weight"),
                                (((n * 5) % 9 - 4) / 4.0).alias("polarity"),
                                ((n % 4) / 3.0).alias("subjectivity")), "lexicon")


_LEX_SQL = f"""lex AS (
  SELECT word, ((length(word) * 7) % 9 - 4) / 4.0 AS weight, ((length(word) * 5) % 9 - 4) / 4.0 AS polarity,
    (length(word) % 4) / 3.0 AS subjectivity
  FROM (SELECT DISTINCT lower(unnest({S.words('text')})) AS word FROM benchmark))"""

_CHUNKS_SQL = f"""w AS (SELECT doc_id, {S.words('text')} AS ws FROM documents),
nch AS (SELECT doc_id, CAST(CASE WHEN len(ws) = 0 THEN 0 ELSE (len(ws) - 1) // 300 + 1 END AS INTEGER) AS n_chunks
        FROM w),
ch AS (SELECT doc_id, ws, unnest(generate_series(0, len(ws) - 1, 300)) AS start FROM w WHERE len(ws) > 0),
cw AS (SELECT doc_id, start // 300 AS chunk_no, lower(unnest(list_slice(ws, start + 1, start + 300))) AS word
       FROM ch)"""


@register("label_distribution", _PS + """
SELECT roberta_label, count(*) AS count,
  round_even(count(*) / sum(count(*)) OVER () * 100.0, 2) AS percent
FROM scorers GROUP BY roberta_label""")
def q_label_distribution(spark, sf):
    return lb.label_distribution(scorer_labels(spark, sf), "roberta_label")


@register("scorer_label_crosstab", _PS + """
, long AS (SELECT 'vader' AS scorer, vader_sentiment AS label FROM scorers
           UNION ALL SELECT 'textblob', tb_sentiment FROM scorers
           UNION ALL SELECT 'roberta', roberta_label FROM scorers)
SELECT label, count(*) FILTER (WHERE scorer = 'vader') AS vader,
  count(*) FILTER (WHERE scorer = 'textblob') AS textblob,
  count(*) FILTER (WHERE scorer = 'roberta') AS roberta
FROM long WHERE label IN ('positive', 'neutral', 'negative') GROUP BY label""")
def q_scorer_label_crosstab(spark, sf):
    s = scorer_labels(spark, sf)
    return lb.crosstab(s, {"vader": "vader_sentiment", "textblob": "tb_sentiment",
                           "roberta": "roberta_label"})


@register("scorer_agreement", _PS + """
SELECT round(avg(CAST(coalesce(roberta_label = vader_sentiment, false) AS INTEGER)), 6) AS roberta_vs_vader,
  round(avg(CAST(coalesce(roberta_label = tb_sentiment, false) AS INTEGER)), 6) AS roberta_vs_textblob
FROM scorers""")
def q_scorer_agreement(spark, sf):
    a = lb.agreement(scorer_labels(spark, sf), {"roberta_vs_vader": ("roberta_label", "vader_sentiment"),
                                                "roberta_vs_textblob": ("roberta_label", "tb_sentiment")})
    return a.select(*[F.round(c, 6).alias(c) for c in a.columns])


def _cand_sql(names: list[str]) -> str:
    arr = "[" + ", ".join(S.q(n) for n in names) + "]"
    return f"""c AS (
  SELECT doc_id, i, {arr}[i] AS label, CAST((doc_id * i) % 101 AS DOUBLE) / 100 AS score
  FROM documents, range(1, {len(names) + 1}) AS r(i)),
best AS (SELECT doc_id, first(label ORDER BY score DESC, i) AS label, max(score) AS score
         FROM c GROUP BY doc_id)"""


@register("top_label_threshold", f"""
WITH {_cand_sql(SECONDARY_LABELS)}
SELECT doc_id, CASE WHEN score >= 0.5 THEN label ELSE 'UNSURE' END AS secondary_label,
  CASE WHEN score >= 0.5 THEN score ELSE 0.0 END AS secondary_score FROM best""")
def q_top_label_threshold(spark, sf):
    d = table(spark, sf, "documents")
    scores = F.array(*[((F.col("doc_id") * k) % 101).cast("double") / 100
                       for k in range(1, len(SECONDARY_LABELS) + 1)])
    t = lb.top_label(scores, SECONDARY_LABELS, 0.5)
    return d.select("doc_id", t["label"].alias("secondary_label"), t["score"].alias("secondary_score"))


@register("primary_label", f"""
WITH {_cand_sql(PRIMARY_LABELS)}
SELECT doc_id, CASE WHEN score < 0.5 THEN 'UNSURE' WHEN contains(lower(label), 'technical') THEN 'TECHNICAL'
                    ELSE 'NON_TECHNICAL' END AS primary_label,
  CASE WHEN score >= 0.5 THEN score ELSE 0.0 END AS primary_score FROM best""")
def q_primary_label(spark, sf):
    d = table(spark, sf, "documents")
    scores = F.array(*[((F.col("doc_id") * k) % 101).cast("double") / 100
                       for k in range(1, len(PRIMARY_LABELS) + 1)])
    t = lb.top_label(scores, PRIMARY_LABELS, 0.5)
    return d.select("doc_id", lb.primary_from_top(t["label"]).alias("primary_label"),
                    t["score"].alias("primary_score"))


@register("chunked_lexicon_sentiment", f"""
WITH {_LEX_SQL}, {_CHUNKS_SQL},
sums AS (SELECT doc_id, chunk_no, sum(weight) AS s FROM cw JOIN lex USING (word) GROUP BY doc_id, chunk_no),
per AS (SELECT doc_id, sum(s / sqrt(s * s + 15.0)) AS tot FROM sums GROUP BY doc_id),
sc AS (SELECT nch.doc_id, CASE WHEN n_chunks > 0 THEN coalesce(tot, 0.0) / n_chunks END AS score
       FROM nch LEFT JOIN per USING (doc_id))
SELECT doc_id, round(score, 6) AS score,
  CASE WHEN score IS NULL THEN 'neutral' ELSE {S.polarity_label('score', 0.05, True)} END AS label
FROM sc""")
def q_chunked_lexicon_sentiment(spark, sf):
    d = table(spark, sf, "documents")
    r = lb.chunked_lexicon_sentiment(d, "doc_id", "text", lexicon(spark, sf).select("word", "weight"))
    return r.select("doc_id", F.round("score", 6).alias("score"), "label")


@register("lexicon_polarity", f"""
WITH {_LEX_SQL},
ww AS (SELECT doc_id, lower(unnest({S.words('text')})) AS word FROM documents),
a AS (SELECT doc_id, avg(polarity) AS p, avg(subjectivity) AS q FROM ww JOIN lex USING (word) GROUP BY doc_id),
r AS (SELECT d.doc_id, coalesce(p, 0.0) AS p, coalesce(q, 0.0) AS q FROM documents d LEFT JOIN a USING (doc_id))
SELECT doc_id, round(p, 6) AS tb_polarity, round(q, 6) AS tb_subjectivity,
  {S.polarity_label('p', 0.05, False)} AS tb_sentiment FROM r""")
def q_lexicon_polarity(spark, sf):
    d = table(spark, sf, "documents")
    r = lb.lexicon_polarity(d, "doc_id", "text", lexicon(spark, sf))
    return r.select("doc_id", F.round("tb_polarity", 6).alias("tb_polarity"),
                    F.round("tb_subjectivity", 6).alias("tb_subjectivity"), "tb_sentiment")


def chunk_classifier_output(spark, sf):
    """(doc_id, chunk_no, label, score): a deterministic stand-in for a
    per-chunk sentiment classifier."""
    d = table(spark, sf, "documents")
    # The stand-in scores depend only on the chunk number, so chunks are
    # enumerated from the word count instead of materialising chunk texts.
    n_chunks = F.ceil(tx.word_count("text") / F.lit(300.0)).cast("int")
    ch = d.select("doc_id", F.explode(F.when(n_chunks > 0, F.sequence(F.lit(0), n_chunks - 1))).alias("chunk_no"))
    names = F.array(*[F.lit(n) for n in SENTIMENT_LABELS])
    return ch.select("doc_id", "chunk_no",
                     F.element_at(names, ((F.col("doc_id") + F.col("chunk_no")) % 3 + 1).cast("int"))
                     .alias("label"),
                     (((F.col("doc_id") * 31 + F.col("chunk_no") * 17) % 100 + 1) / 100.0).alias("score"))


@register("chunk_vote_sentiment", f"""
WITH w AS (SELECT doc_id, {S.words('text')} AS ws FROM documents),
ch AS (SELECT doc_id, unnest(generate_series(0, len(ws) - 1, 300)) // 300 AS chunk_no FROM w WHERE len(ws) > 0),
o AS (SELECT doc_id, ['positive', 'neutral', 'negative'][CAST((doc_id + chunk_no) % 3 AS INTEGER) + 1] AS label,
        ((doc_id * 31 + chunk_no * 17) % 100 + 1) / 100.0 AS score FROM ch),
s AS (SELECT doc_id, sum(CASE WHEN label = 'positive' THEN score ELSE 0.0 END) AS a,
        sum(CASE WHEN label = 'neutral' THEN score ELSE 0.0 END) AS b,
        sum(CASE WHEN label = 'negative' THEN score ELSE 0.0 END) AS c FROM o GROUP BY doc_id),
n AS (SELECT doc_id, a / (a + b + c) AS pos, b / (a + b + c) AS neu, c / (a + b + c) AS neg FROM s)
SELECT d.doc_id,
  CASE WHEN pos = greatest(pos, neu, neg) THEN 'positive' WHEN neu = greatest(pos, neu, neg) THEN 'neutral'
       WHEN neg = greatest(pos, neu, neg) THEN 'negative' END AS roberta_label,
  round(pos, 6) AS roberta_pos_score, round(neg, 6) AS roberta_neg_score
FROM documents d LEFT JOIN n USING (doc_id)""")
def q_chunk_vote_sentiment(spark, sf):
    out = chunk_classifier_output(spark, sf)
    r = lb.chunk_vote_sentiment(out, "doc_id", docs=table(spark, sf, "documents"))
    return r.select("doc_id", "roberta_label", F.round("roberta_pos_score", 6).alias("roberta_pos_score"),
                    F.round("roberta_neg_score", 6).alias("roberta_neg_score"))
