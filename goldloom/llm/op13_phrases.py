"""Query op13: collocations of the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from goldloom.llm.collocations import collocations
from goldloom.llm.common import table


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (
    SELECT lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w
    FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    )
), g AS (
    SELECT lang, 1 AS m, w[i] AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p)
    UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM p)
    UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM p)
), f AS (
    SELECT lang, m, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY lang, m, phrase
), n AS (
    SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (
    SELECT lang, m, phrase, f AS a, w FROM f WHERE m > 1 AND f >= 10
), cuts AS (
    SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS left_part, array_to_string(w[k + 1:], ' ') AS right_part
    FROM (SELECT *, unnest(range(1, m)) AS k FROM c)
), s AS (
    SELECT x.lang, x.m, x.phrase, x.a, x.k, l.f AS l, r.f AS r, (1000000::HUGEINT * x.a * x.a // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.left_part JOIN f r ON r.lang = x.lang AND r.phrase = x.right_part
), best AS (
    SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
    SELECT lang, inner_phrase, max(a) AS a
    FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS inner_phrase FROM c WHERE m = 3) GROUP BY lang, inner_phrase
), kept AS (
    SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.inner_phrase = b.phrase AND b.m = 2 WHERE o.a IS NULL OR 100 * o.a < 50 * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang)
WHERE rank <= 2000
"""
