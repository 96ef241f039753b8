"""Query over ``conversations``: the prefix trie of the rebuilt conversations."""

from __future__ import annotations

from tessera.llm.common import read
from tessera.llm.registry import register
from tessera.llm.trie import ordered, prefix_trie, rebuild

#: The 256 values of the byte-wise crc32 (polynomial 0xEDB88320, a fixed value), by their rule.
CRC_SQL = """crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i)))"""


def crc_sql(byte_list: str) -> str:
    """crc32 of a list of bytes; ``tab`` of ``crc_table`` must be in scope."""
    return (f"xor(list_reduce(list_prepend(4294967295, {byte_list}), "
            "lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)")


OP12_SQL = f"""
WITH {CRC_SQL},
t AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
        ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, {crc_sql("list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)")} % 6 AS h FROM t, crc_table),
r AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
      FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, len(turns) AS n, d, turns[1:d] AS p FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
          FROM m GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
own AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(p[d].t) END AS saved
        FROM nodes LEFT JOIN kids USING (p, d)),
below AS (SELECT p[1:a] AS p, a AS d, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
          FROM (SELECT *, unnest(range(d + 1)) AS a FROM own) GROUP BY ALL)
SELECT o.conv_id, o.d::BIGINT AS depth, up.conv_id AS parent_conv_id, o.n_convs, o.n_children, b.n_leaves, b.saved_tokens, o.ends_sha256
FROM own o JOIN below b USING (p, d) LEFT JOIN nodes up ON up.d = o.d - 1 AND up.p = o.p[1:o.d - 1]"""


@register("op12_prefix_trie", OP12_SQL)
def op12_prefix_trie(spark, sf_dir):
    """Every distinct prefix of the rebuilt conversations, with its members, children, leaves and shared text."""
    return prefix_trie(rebuild(ordered(read(spark, sf_dir, "conversations")))).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
