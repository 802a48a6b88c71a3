"""The exact decontamination as one DuckDB statement: all windows of all texts, by their words."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def oracle(width: int = 10) -> str:
    return f"""WITH b AS MATERIALIZED (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), {width}) AS n, unnest(list_transform(range(1, greatest(len(w) - {width - 2}, 2)), lambda i: array_to_string(w[i : i + {width - 1}], ' '))) AS key FROM b WHERE len(w) > 0),
size AS (SELECT DISTINCT n FROM win),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
spot AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS key FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, size WHERE len(w) >= n)),
hit AS MATERIALIZED (SELECT DISTINCT rid, spot.n, i, item_id FROM spot JOIN win ON spot.key = win.key AND spot.n = win.n),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, n, i FROM hit)) GROUP BY 1),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)"""
