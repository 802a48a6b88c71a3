"""The periodic runs as one DuckDB statement: for every period, the stretches of words that equal the word one period on."""

from __future__ import annotations


def crc32(text: str) -> str:
    """crc32 of an ASCII text, bit by bit: a byte enters, then eight shifts (-1) follow."""
    steps = f"list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length({text}) + 1), lambda i: [ascii(substr({text}, i, 1))::BIGINT] || [-1::BIGINT FOR k IN range(8)])))"
    return f"xor(list_reduce({steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"


def oracle(times: int = 4, least: int = 6) -> str:
    return f"""WITH base AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, {crc32("doc_id::VARCHAR")} AS h FROM documents),
shift AS (SELECT rid, doc_id, w, len(w) AS n, h, h // 10 AS g FROM base),
cut AS (SELECT rid, doc_id, w, n, h % 10 = 0 AND n > 0 AS planted, CASE WHEN n > 0 THEN g % n END AS a, g FROM shift),
d AS MATERIALIZED (SELECT rid, doc_id, n, CASE WHEN planted THEN list_transform(range(0, n), lambda i: CASE WHEN i >= a THEN w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] ELSE w[i + 1] END) ELSE w END AS w FROM cut),
word AS MATERIALIZED (SELECT rid, n, i, w[i + 1] AS x FROM d, unnest(range(0, n)) AS u(i)),
pair AS (SELECT p.rid, p.i, q.i - p.i AS q FROM word p JOIN word q ON p.rid = q.rid AND p.x = q.x AND q.i > p.i AND {times} * (q.i - p.i) <= p.n),
stretch AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM pair),
long_one AS MATERIALIZED (SELECT rid, q, min(i) AS s, count(*) + q AS len FROM stretch GROUP BY rid, q, k HAVING count(*) + q >= greatest({least}, {times} * q)),
run AS MATERIALIZED (SELECT * FROM long_one x WHERE NOT EXISTS (SELECT 1 FROM long_one y WHERE y.rid = x.rid AND y.q < x.q AND y.s <= x.s AND y.s + y.len >= x.s + x.len)),
gone AS (SELECT DISTINCT rid, s + k AS i FROM run, unnest(range(q, len)) AS u(k)),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (rid, i) GROUP BY rid),
best AS (SELECT rid, s, len, q FROM run QUALIFY row_number() OVER (PARTITION BY rid ORDER BY len::DOUBLE / q DESC, s, q) = 1),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, len::BIGINT AS length, q::BIGINT AS period, (1000 * len // q)::BIGINT AS exponent_milli,
  sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)"""
