"""DuckDB SQL of the two substring operators and the Jaccard join: the definitions, said by windows, sets and a recursive closure."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def substring(width: int = 13) -> str:
    words = _WORDS.format(text="text")
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
g AS MATERIALIZED (SELECT rid, doc_id, i, array_to_string(w[i : i + {width - 1}], ' ') AS key FROM d, unnest(range(1, len(w) - {width - 2})) AS u(i)),
f AS (SELECT key, min(doc_id) AS m FROM g GROUP BY 1),
gone AS (SELECT DISTINCT rid, i + o AS p FROM g JOIN f USING (key), unnest(range(0, {width})) AS u(o) WHERE m < doc_id),
word AS (SELECT rid, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (rid, p) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""


def suffix(width: int = 100) -> str:
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS MATERIALIZED (SELECT rid, doc_id, unnest(range(1, length(h) // 2 - {width - 2})) AS i, unnest(list_transform(range(1, length(h) // 2 - {width - 2}), lambda i: substr(h, 2 * i - 1, {2 * width}))) AS key FROM d),
f AS (SELECT key, min((doc_id, i)) AS m FROM g GROUP BY 1),
hit AS (SELECT rid, i FROM g JOIN f USING (key) WHERE m < (g.doc_id, g.i)),
edge AS (SELECT rid, i, CASE WHEN i <= max(i) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {width} THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS r FROM edge),
span AS (SELECT rid, r, min(i) AS a, max(i) + {width} AS b FROM run GROUP BY ALL),
cut AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, list(struct_pack(a, b) ORDER BY a) AS s FROM span GROUP BY 1),
left_over AS (SELECT d.*, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN s IS NULL THEN h ELSE substr(h, 1, 2 * (s[1].a - 1)) || array_to_string(list_transform(range(1, len(s) + 1), lambda k: substr(h, 2 * s[k].b - 1, CASE WHEN k < len(s) THEN 2 * (s[k + 1].a - s[k].b) ELSE length(h) END)), '') END AS k FROM d LEFT JOIN cut USING (rid))
SELECT doc_id, length(h) // 2 AS n_bytes, n_removed, n_spans, sha256(unhex(k)) AS kept_sha256 FROM left_over"""


def jaccard(n: int = 3, percent: int = 90) -> str:
    words = _WORDS.format(text=_LOWER)
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, doc_id, CASE WHEN len(w) < {n} THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + {n - 1}], ' ') END AS g FROM d, unnest(range(1, greatest(len(w) - {n - 2}, 2))) AS u(i) WHERE len(w) > 0),
size AS MATERIALIZED (SELECT rid, count(*) AS k FROM s GROUP BY 1),
pair AS (SELECT a.rid AS x, b.rid AS y, a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
link AS MATERIALIZED (SELECT DISTINCT i, j FROM pair JOIN size p ON p.rid = x JOIN size q ON q.rid = y WHERE 100 * c >= {percent} * (p.k + q.k - c)),
sides AS (SELECT i, j FROM link UNION SELECT j, i FROM link),
reach(a, b) AS (SELECT i, j FROM sides UNION SELECT r.a, e.j FROM reach r JOIN sides e ON r.b = e.i)
SELECT doc_id, coalesce(k, 0) AS n_shingles, least(doc_id, (SELECT min(b) FROM reach WHERE a = doc_id)) AS component_id FROM d LEFT JOIN size USING (rid)"""
