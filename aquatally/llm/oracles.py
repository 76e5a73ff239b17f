"""DuckDB SQL with the results of the queries that SQL can state."""

from __future__ import annotations

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINE_DEDUP = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
lines AS (
  SELECT doc_id, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS pos FROM docs),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {SPACES}), {LOWER}) AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.keeper AS dropped
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


QUALITY_RULES = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, unnest(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) AS word,
    generate_subscripts(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+'), 1) AS pos FROM docs),
windows AS (
  SELECT r, pos, word, CASE WHEN lead(pos, 4) OVER w IS NOT NULL THEN
    [word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w] END AS five
  FROM words WINDOW w AS (PARTITION BY r ORDER BY pos)),
twice AS (
  SELECT r, pos, word, five IS NOT NULL AND count(*) OVER (PARTITION BY r, five) >= 2 AS again FROM windows),
marked AS (
  SELECT r, word, bool_or(again) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS again
  FROM twice),
by_word AS (
  SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (WHERE again) AS n_repeat_words
  FROM marked GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
by_line AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
  WHERE regexp_matches(line, '[^ \\t\\n\\x0b\\f\\r]') GROUP BY r),
measured AS (
  SELECT d.r, doc_id, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs d LEFT JOIN by_word USING (r) LEFT JOIN by_line USING (r)),
ruled AS (SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repetitive,
  10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * n_lines AS same_lines,
  word_chars < 3 * n_words OR word_chars > 10 * n_words AS odd_words FROM measured),
failures AS (
  SELECT source, rule, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS k FROM (
    SELECT source, unnest(['short', 'repetitive', 'symbols', 'same_lines', 'odd_words']) AS rule,
      unnest([short, repetitive, symbols, same_lines, odd_words]) AS failed FROM ruled WHERE source IS NOT NULL)
  GROUP BY ALL),
prior AS (
  SELECT rule, count(*) AS hosts, sum(n) AS docs, sum(k) / sum(n) AS mean, sum(k * (k / n)) / sum(n) AS square
  FROM failures GROUP BY rule),
weighed AS (
  SELECT rule, mean, greatest(20, CASE
    WHEN square - mean * mean - mean * (1 - mean) * hosts / docs <= 0 OR hosts < 2 THEN docs / hosts
    WHEN mean * (1 - mean) <= square - mean * mean - mean * (1 - mean) * hosts / docs THEN 0
    ELSE mean * (1 - mean) / (square - mean * mean - mean * (1 - mean) * hosts / docs) - 1 END) AS weight
  FROM prior),
rates AS (
  SELECT source, rule, mean, (k + mean * weight) / (n + weight) AS rate FROM failures JOIN weighed USING (rule)),
verdicts AS (
  SELECT source AS host, bool_or(rate >= 0.9 AND rule IN ('short', 'repetitive')) AS all_of_it,
    bool_or(rate >= greatest(0.5, 2 * mean) AND rule = 'symbols') AS s,
    bool_or(rate >= greatest(0.5, 2 * mean) AND rule = 'same_lines') AS l,
    bool_or(rate >= greatest(0.5, 2 * mean) AND rule = 'odd_words') AS w
  FROM rates GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed,
  NOT (short OR repetitive) AND NOT coalesce(all_of_it, false)
    AND NOT coalesce(s AND symbols OR l AND same_lines OR w AND odd_words, false) AS kept
FROM ruled LEFT JOIN verdicts ON source = host
"""


_PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
}


def _pii() -> str:
    found = " UNION ALL ".join(
        f"SELECT r, {i} AS k, '{kind}' AS kind, regexp_extract_all(text, '{p}') AS m, "
        f"string_split_regex(text, '{p}') AS g FROM docs"
        for i, (kind, p) in enumerate(_PII_PATTERNS.items())
    )
    luhn = """list_sum(list_transform(range(length(d)), lambda i:
      CASE WHEN i % 2 = 0 THEN d[length(d) - i]::INT
        ELSE (d[length(d) - i]::INT * 2) // 10 + (d[length(d) - i]::INT * 2) % 10 END)) % 10 = 0"""
    mod = """list_reduce(list_prepend(0::BIGINT, list_transform(string_split(v[5:] || v[:4], ''), lambda c:
      CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, b:
      CASE WHEN b >= 10 THEN (a * 100 + b) % 97 ELSE (a * 10 + b) % 97 END) = 1"""
    near = r"(?i)\b(?:card|visa|mastercard|credit|karte|carte|tarjeta)\b"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
each AS (
  SELECT r, k, kind, unnest(m) AS v0, unnest(g[:len(m)]) AS gap, unnest(g[2:]) AS behind,
    unnest(range(len(m))) AS i FROM found WHERE len(m) > 0),
placed AS (
  SELECT *, sum(length(gap) + length(v0)) OVER (PARTITION BY r, k ORDER BY i) - length(v0) AS start,
    regexp_replace(v0, '[^0-9]', '', 'g') AS d, replace(v0, ' ', '') AS v FROM each),
judged AS (
  SELECT *, start + length(v0) AS stop, CASE
    WHEN kind = 'email' THEN true
    WHEN kind = 'ip' THEN list_bool_and(list_transform(string_split(v0, '.'), lambda x:
      length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS INT), 0) <= 255))
    WHEN kind = 'phone' THEN length(d) BETWEEN 8 AND 15
    WHEN kind = 'card' THEN length(d) BETWEEN 16 AND 19 AND {luhn}
    ELSE false END AS base, CASE
    WHEN kind = 'card' THEN length(d) BETWEEN 13 AND 15 AND {luhn}
      AND (regexp_matches(right(gap, 40), '{near}') OR regexp_matches(left(behind, 20), '{near}'))
    WHEN kind = 'iban' THEN length(v) BETWEEN 15 AND 34 AND {mod}
    ELSE false END AS added
  FROM placed),
kept AS (SELECT * FROM judged WHERE base OR added),
rows AS (
  SELECT r, count(*) FILTER (WHERE base AND kind = 'email') AS n_email, count(*) FILTER (WHERE base AND kind = 'ip') AS n_ip,
    count(*) FILTER (WHERE base AND kind = 'card') AS n_card, count(*) FILTER (WHERE base AND kind = 'phone') AS n_phone,
    string_agg(concat_ws(':', kind, start::BIGINT, stop::BIGINT), ',' ORDER BY k, start) FILTER (WHERE base) AS base_list,
    string_agg(concat_ws(':', kind, start::BIGINT, stop::BIGINT), ',' ORDER BY k, start) AS spans
  FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
  coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base_list, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN rows USING (r)
"""


SUFFIX_DEDUP = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM docs)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE first < doc_id),
breaks AS (
  SELECT doc_id, i, (i - lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) > 50)::INT AS fresh FROM hits),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM breaks),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, a, substr(h, 2 * before + 1, 2 * (a - before)) AS piece FROM (
    SELECT r.doc_id, h, a, lag(b, 1, 0) OVER (PARTITION BY r.doc_id ORDER BY a) AS before
    FROM (SELECT doc_id, a, b FROM runs UNION ALL
          SELECT doc_id, length(h) // 2, length(h) // 2 FROM docs WHERE doc_id IN (SELECT doc_id FROM runs)) r
    JOIN docs USING (doc_id))),
kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY a) AS k FROM gaps GROUP BY doc_id),
counts AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

CHAT_FORMATTING = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (
  SELECT *, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\/')) + 24
    + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


#: CRC-32 of a decimal id, bit by bit.
CRC32 = """
xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)
"""

#: Discounts of counts 1, 2, 3 or more from the numbers n1 to n4 of rare counts.
DISCOUNTS = """
SELECT *, n1 / (n1 + 2 * n2) AS y, 1 - 2 * y * n2 / n1 AS a1, 2 - 3 * y * n3 / n2 AS a2, 3 - 4 * y * n4 / n3 AS a3,
  coalesce(least(n1, n2, n3) > 0 AND a1 BETWEEN 0 AND 1 AND a2 BETWEEN 0 AND 2 AND a3 BETWEEN 0 AND 3, false) AS usable,
  if(usable, a1, 0.5::DOUBLE) AS d1, if(usable, a2, 1::DOUBLE) AS d2, if(usable, a3, 1.5::DOUBLE) AS d3 FROM (
  SELECT count(*) FILTER (WHERE {c} = 1)::DOUBLE AS n1, count(*) FILTER (WHERE {c} = 2)::DOUBLE AS n2,
    count(*) FILTER (WHERE {c} = 3)::DOUBLE AS n3, count(*) FILTER (WHERE {c} = 4)::DOUBLE AS n4,
    count(*) FILTER (WHERE {c} >= 3)::DOUBLE AS more, sum({c})::DOUBLE AS kinds FROM {table})
"""

LM_SCORING = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {CRC32} % 7 = 2 AS held_out,
    list_append(regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^ \\t\\n\\x0b\\f\\r]+'), ' ') AS words FROM documents),
tokens AS MATERIALIZED (
  SELECT r, held_out, unnest(words) AS w, unnest(list_prepend('  ', words[:-2])) AS h FROM docs),
pairs AS MATERIALIZED (SELECT h, w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY h, w),
words AS MATERIALIZED (SELECT w, sum(c)::BIGINT AS c, count(*) AS kinds FROM pairs GROUP BY w),
contexts AS MATERIALIZED (
  SELECT h, sum(c)::BIGINT AS total, count(*) FILTER (WHERE c = 1) AS m1, count(*) FILTER (WHERE c = 2) AS m2,
    count(*) FILTER (WHERE c >= 3) AS m3 FROM pairs GROUP BY h),
d AS MATERIALIZED ({DISCOUNTS.format(c="c", table="pairs")}),
e AS MATERIALIZED ({DISCOUNTS.format(c="kinds", table="words")}),
sizes AS MATERIALIZED (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM words),
unseen AS MATERIALIZED (
  SELECT CASE WHEN v > 0 THEN (d1 * n1 + d2 * n2 + d3 * more) / kinds ELSE 1 END / (v + 1) AS u FROM e, sizes),
alone AS MATERIALIZED (
  SELECT w, c, (words.kinds - CASE words.kinds WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END) / e.kinds + u AS p
  FROM words, e, unseen),
chances AS (
  SELECT r, coalesce(a.c, 0) AS c, coalesce(a.p, u) AS p, x.total, coalesce(p.c, 0) AS k, d1, d2, d3, m1, m2, m3, n, v
  FROM tokens t LEFT JOIN alone a ON t.w = a.w LEFT JOIN contexts x ON t.h = x.h
  LEFT JOIN pairs p ON t.h = p.h AND t.w = p.w, d, unseen, sizes),
scored AS (
  SELECT r, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, max(n) AS train_tokens,
    sum(log10((c + 1.0) / (n + v + 1))) AS base_score,
    sum(log10(CASE WHEN total IS NULL THEN p ELSE
      (k - CASE k WHEN 0 THEN 0 WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END) / total + (d1 * m1 + d2 * m2 + d3 * m3) / total * p
    END)) AS score
  FROM chances GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score
FROM docs JOIN scored USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_lm_scoring": LM_SCORING, "op1_quality_rules": QUALITY_RULES, "op2_suffix_array_dedup": SUFFIX_DEDUP, "op4_chat_formatting": CHAT_FORMATTING, "op5_line_dedup": LINE_DEDUP, "op10_pii": _pii()}
