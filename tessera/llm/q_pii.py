"""Query over ``documents``: personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm.common import read
from tessera.llm.pii import BASE, count_of, find_pii, joined
from tessera.llm.registry import register

#: name, pattern, condition on match m, score, context words, bonus
_TWIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 0.9,
     "mail|contact|write|adresse|correo", 0.1),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
     "list_max([CAST(p AS HUGEINT) FOR p IN string_split(m, '.')]) <= 255", 0.7, "ip|host|server|address|login", 0.2),
    ("card", r"[0-9]([\x20-]?[0-9])+", "luhn", 0.8, "card|visa|credit|karte|carte|tarjeta|payment", 0.2),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15", 0.7,
     "tel|phone|call|fax|mobile|telefon", 0.2),
    ("iban", r"[A-Z][A-Z][0-9][0-9]( ?[A-Z0-9])+", "iban", 0.8, "iban|bank|konto|account|compte|cuenta", 0.2),
    ("ssn", r"[0-9]+-[0-9]+-[0-9]+", "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')", 0.3,
     "ssn|social security", 0.5),
]
_LUHN = ("len(c) BETWEEN 13 AND 19 AND list_sum([CASE WHEN i % 2 = 0 AND CAST(c[len(c) - i + 1] AS INT) > 4 "
         "THEN 2 * CAST(c[len(c) - i + 1] AS INT) - 9 WHEN i % 2 = 0 THEN 2 * CAST(c[len(c) - i + 1] AS INT) "
         "ELSE CAST(c[len(c) - i + 1] AS INT) END FOR i IN range(1, len(c) + 1)]) % 10 = 0")
_IBAN = ("len(b) BETWEEN 15 AND 34 AND list_reduce("
         "[CAST(0 AS BIGINT)] || [CAST(x AS BIGINT) FOR x IN string_split(v, '')], lambda r, x: (r * 10 + x) % 97) = 1")


def _kind_sql(o, kind):
    name, pattern, valid, score, context, bonus = kind
    valid = {"luhn": _LUHN, "iban": _IBAN}.get(valid, valid)
    value = ("array_to_string([CASE WHEN x >= 'A' THEN CAST(ascii(x) - 55 AS VARCHAR) ELSE x END "
             "FOR x IN string_split(substr(b, 5) || substr(b, 1, 4), '')], '')")
    return f"""
SELECT doc_id, {o} AS o, '{name}' AS kind, start, start + len(m) AS stop FROM (
  SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS c, replace(m, ' ', '') AS b,
    CASE WHEN '{name}' = 'iban' THEN {value.replace("b,", "replace(m, ' ', ''),")} END AS v FROM (
    SELECT doc_id, ms[i] AS m, coalesce(list_sum([len(x) FOR x IN gs[1:i]]), 0)
        + coalesce(list_sum([len(x) FOR x IN ms[1:i - 1]]), 0) AS start,
      lower(right(gs[i], 40) || ' ' || left(gs[i + 1], 40)) AS near
    FROM (SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gs FROM d))))
WHERE {valid} AND {score} + CASE WHEN regexp_matches(near, '{context}') THEN {bonus} ELSE 0 END >= 0.6"""


OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_kind_sql(o, k) for o, k in enumerate(_TWIN))}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)},
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) FILTER (WHERE o < 4) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) AS spans
      FROM s GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""


@register("op1_pii", OP1_SQL)
def op1_pii(spark, sf_dir):
    """Counts and spans of personal data in every document."""
    found = find_pii(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin(BASE))
    return found.select("doc_id", *[count_of(F.col("spans"), k).alias(f"n_{k}") for k in BASE],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
