"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .line_cleaning import BOILERPLATE, NAVIGATION

OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *,
    length(regexp_replace(text, '([\[<])(\\*)(/?(?:INST|ANS|SYS|ROLE|TURN)\]|/?s>)', '\1\2\\\3', 'g'))
      + CASE role WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 6 + 5 WHEN 'system' THEN 6 + 7
             ELSE 7 + 9 + 8 + length(regexp_replace(role, '([\[<])(\\*)(/?(?:INST|ANS|SYS|ROLE|TURN)\]|/?s>)', '\1\2\\\3', 'g')) END AS n,
    row_number() OVER w AS k,
    count(*) OVER (PARTITION BY conv_id) AS total
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), placed AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM marked
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR k = total)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM placed GROUP BY conv_id
"""

_GAP = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_ITEM = rf"{_WORD}(?:{_GAP}+[^\x20\x09-\x0D|>»]+){{0,2}}"
_SYMBOLS = "[#*$%&|<>]"

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS w, string_split(t, chr(10)) AS lines FROM d),
windows AS (SELECT r, unnest([array_to_string(w[k:k + 4], ' ') for k in range(1, len(w) - 3)]) AS v, unnest(range(1, len(w) - 3)) AS k FROM w),
again AS (SELECT r, k FROM windows QUALIFY count(*) OVER (PARTITION BY r, v) > 1),
covered AS (SELECT r, sum(n)::BIGINT AS n FROM (SELECT r, least(5, coalesce(lead(k) OVER (PARTITION BY r ORDER BY k) - k, 5)) AS n FROM again) GROUP BY r),
line AS (SELECT r, unnest(lines) AS x, unnest(range(len(lines))) AS k FROM w),
judged AS (SELECT r, x, k, regexp_matches(x, '{_WORD}') AND (
    length(x) - length(regexp_replace(x, '{_SYMBOLS}', '', 'g')) > 0.1 * length(regexp_replace(x, '{_GAP}', '', 'g'))
    OR NOT regexp_matches(x, '[.!?;:,…。！？"''”’)\]]') AND NOT regexp_matches(x, '(?:{_WORD}{_GAP}+){{3}}{_WORD}')
    OR regexp_matches(trim(x, ' '), '^{_ITEM}(?:{_GAP}+[|>»]{_GAP}+{_ITEM}){{2,}}\r?$')
    OR regexp_matches(lower(trim(x, ' ')), '^(?:{"|".join(NAVIGATION)})(?:{_GAP}+(?:{"|".join(NAVIGATION)}))*{_GAP}*$')
    OR regexp_matches(lower(x), '{"|".join(BOILERPLATE)}')) AS fails FROM line),
kept AS (SELECT r, coalesce(sum(length(regexp_replace(x, '{_GAP}', '', 'g'))) FILTER (NOT fails), 0) AS left_chars,
    count(*) FILTER (regexp_matches(x, '{_WORD}')) - count(DISTINCT x) FILTER (regexp_matches(x, '{_WORD}')) AS n_dup_lines FROM judged GROUP BY r),
counted AS (SELECT w.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '{_SYMBOLS}', '', 'g')))::BIGINT AS n_symbols, n_dup_lines, coalesce(n, 0) AS n_repeat_words, left_chars
  FROM w JOIN kept ON w.r = kept.r LEFT JOIN covered ON covered.r = w.r),
scored AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN 1 - left_chars / word_chars ELSE 0 END::DOUBLE AS lost FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= 0.5 AS kept, round(lost, 6) AS lost FROM scored
"""

OP11 = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS r, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
phrases AS (
  SELECT lang, size, array_to_string(w[k:k + size - 1], ' ') AS phrase FROM (
    SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size)
), f AS (SELECT lang, size, phrase, count(*) AS f FROM phrases GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, phrase, f AS a, size, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f::HUGEINT + y.f))::BIGINT AS score FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, a, array_to_string(w[i:j], ' ') AS phrase FROM candidates, range(1, 4) AS x(i), range(2, 5) AS y(j) WHERE i < j AND j <= size AND j - i + 1 < size
), longer AS (SELECT lang, phrase, max(a) AS most FROM inner_phrases GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, n, score
FROM scored s JOIN total USING (lang) LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase
WHERE most IS NULL OR 100 * most < 80 * a
QUALIFY rank <= 2000
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT *, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
    ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""

ORACLES = {"op1_prefix_targets": OP1, "op10_line_cleaning": OP10, "op11_collocations": OP11, "op13_fill_middle": OP13}
