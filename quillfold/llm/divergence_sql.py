"""The divergence rules as one DuckDB statement."""

from __future__ import annotations

from .divergence import ALL_WORDS, CLASSES, COMMON_WORDS, N_CLASSES, DivergenceRules


def oracle(rules: DivergenceRules = DivergenceRules()) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    words_in = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    classes = ", ".join(f"length(regexp_replace(t, {q(p)}, '', 'g')) AS c{k}" for k, p in enumerate(CLASSES.values()))
    n = len(CLASSES)
    counts = ", ".join(f"len(list_filter(low, lambda x: x = {q(w)})) AS w{k}" for k, w in enumerate(ALL_WORDS))
    seen = " - ".join(f"c{k}" for k in range(n))
    sums = ", ".join([*[f"sum(c{k}) AS c{k}" for k in range(N_CLASSES)], *[f"sum(w{k}) AS w{k}" for k in range(len(ALL_WORDS))]])
    term = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"

    def distance(lang: str, what: str, size: int) -> str:
        parts = " + ".join(f"({term(f'd.{what}[{k}]', f'r.{what}[{k}]')} + {term(f'r.{what}[{k}]', f'd.{what}[{k}]')})" for k in range(1, size + 1))
        return f"(SELECT sqrt(greatest(({parts}) / 2, 0)) FROM refs r WHERE r.lang = {q(lang)})"

    def shares(lang: str, n_words: str) -> str:
        own = [f"w{ALL_WORDS.index(w)}" for w in COMMON_WORDS[lang]]
        return "[" + ", ".join(f"{x}::DOUBLE / {n_words}" for x in own) + f", ({n_words} - ({' + '.join(own)}))::DOUBLE / {n_words}]"

    char_p = "[" + ", ".join(f"c{k}::DOUBLE / chars" for k in range(N_CLASSES)) + "]"
    refs = " UNION ALL BY NAME ".join(f"SELECT lang, {char_p} AS p, {shares(lang, 'n_words')} AS p_{lang}, " + ", ".join(f"NULL::DOUBLE[] AS p_{o}" for o in COMMON_WORDS if o != lang) + f" FROM pooled WHERE lang = {q(lang)}" for lang in COMMON_WORDS)
    own = ", ".join(f"CASE WHEN n_words > 0 THEN {shares(lang, 'n_words')} END AS p_{lang}" for lang in COMMON_WORDS)
    by_char = ", ".join(distance(lang, "p", N_CLASSES) for lang in COMMON_WORDS)
    by_word = ", ".join(distance(lang, f"p_{lang}", len(ws) + 1) for lang, ws in COMMON_WORDS.items())
    return f"""
WITH base AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, {words_in.format('t')} AS words, {words_in.format('lower(t)')} AS low,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM base),
counted AS (SELECT doc_id, lang, t, words, lines, len(words) AS n_words, length(t) AS chars,
  length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, {classes}, {counts} FROM split),
filled AS (SELECT *, chars - word_chars AS c{n}, word_chars - ({seen.replace(' - ', ' + ')}) AS c{n + 1} FROM counted),
pooled AS (SELECT lang, sum(n_words) AS n_words, sum(chars) AS chars, {sums} FROM filled WHERE n_words >= {rules.min_words} GROUP BY lang),
named AS (SELECT * FROM ({refs})),
refs AS (SELECT * FROM named),
windows AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM filled, unnest(range(1, greatest(n_words - 1, 1))) AS u(i)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS v(k) GROUP BY doc_id),
shaped AS (SELECT doc_id, n_words, word_chars, chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, CASE WHEN chars > 0 THEN {char_p} END AS p, {own} FROM filled),
judged AS (SELECT d.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  (n_words < {rules.min_words} OR 100 * coalesce(c.n, 0) > {rules.max_repeat_percent} * n_words) AS base_failed,
  CASE WHEN chars >= {rules.min_chars} THEN round(least({by_char}), 6) END AS char_distance,
  CASE WHEN n_words >= {rules.min_words} THEN round(least({by_word}), 6) END AS word_distance
  FROM shaped d LEFT JOIN covered c USING (doc_id))
SELECT *, NOT base_failed AND coalesce(char_distance, 0) <= {rules.max_char_distance} AND coalesce(word_distance, 0) <= {rules.max_word_distance} AS kept FROM judged
"""
