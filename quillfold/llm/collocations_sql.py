"""The phrase collocations as one DuckDB statement: every phrase of every piece, counted."""

from __future__ import annotations


def oracle(least: int = 10, top: int = 2000, inside_percent: int = 50) -> str:
    return f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM p UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY 1),
c AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE k > 1 AND a >= {least}),
cut AS (SELECT *, 1 AS j FROM c UNION ALL SELECT *, 2 FROM c WHERE k = 3),
side AS (SELECT *, lang || chr(9) || array_to_string(w[1 : j], ' ') AS lw, lang || chr(9) || array_to_string(w[j + 1 :], ' ') AS rw FROM cut),
known AS MATERIALIZED (SELECT lang || chr(9) || phrase AS key, a FROM f WHERE a >= {least}),
scored AS (SELECT side.*, x.a AS l, y.a AS r, 1000000 * side.a * side.a // (x.a * y.a) AS score FROM side JOIN known x ON x.key = lw JOIN known y ON y.key = rw),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_one AS (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3),
longer AS (SELECT lang, phrase, max(a) AS m FROM inner_one GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN longer ON longer.lang || chr(9) || longer.phrase = low.lang || chr(9) || low.phrase WHERE m IS NULL OR 100 * m < {inside_percent} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM kept JOIN total USING (lang) QUALIFY rank <= {top}"""
