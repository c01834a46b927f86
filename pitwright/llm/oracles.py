"""SQL of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from . import license


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CHAT = r"""
WITH given AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
sized AS (SELECT *,
  length(replace(replace(replace(role, '\', '\\'), '<turn', '<\turn'), '</turn', '<\/turn'))
  + length(replace(replace(replace(text, '\', '\\'), '<turn', '<\turn'), '</turn', '<\/turn')) + 21 AS chars FROM given)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _normalised(x: str) -> str:
    x = f"regexp_replace(lower({x}), '[^a-z0-9.+\\-]+', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(^| )[.\\-]+', '\\1', 'g'), '[.\\-]+( |\\z)', '\\1', 'g')"
    x = f"trim(regexp_replace({x}, ' +', ' ', 'g'), ' ')"
    for pattern, to in license.TEMPLATES:
        x = f"regexp_replace({x}, {_text(pattern)}, {_text(to)}, 'g')"
    return x


def license_sql() -> str:
    """The two readings of each text as rows, a join with the sentence table, and each rule's pattern."""
    table = ", ".join(f"({_text(s)}, {_text(i)})" for s, i in license.SENTENCES.items())
    rules = ", ".join(f"({n}, {_text(r.license)}, {_text(license.pattern_of(r.sequence))})" for n, r in enumerate(license.RULES))
    instead = ", ".join(f"({n}, {_text(x)})" for n, r in enumerate(license.RULES) for x in r.instead)
    ends = "regexp_replace({}, '([.!?])[ \\t]+', '\\1' || chr(1), 'g')"
    start = len(license.SPDX) + 1
    return rf"""
WITH known(s, id) AS (VALUES {table}),
rules(n, license, pattern) AS (VALUES {rules}),
instead(n, license) AS (VALUES {instead}),
likely AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
cleaned AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, {_text(license.BEFORE)}, '\1', 'g'), {_text(license.AFTER)}, '\1', 'g'), {_text(license.SHORT)}, '\1\2', 'g') AS t FROM likely),
readings AS (
  SELECT doc_id, 1 AS reading, {ends.format(r"replace(replace(regexp_replace(regexp_replace(t, ':\n', ':' || chr(1), 'g'), '\n\n+', chr(1), 'g'), '-' || chr(10), '-'), chr(10), ' ')")} AS t FROM cleaned
  UNION ALL SELECT doc_id, 2, replace({ends.format("t")}, chr(10), chr(1)) FROM cleaned),
sentences AS (SELECT doc_id, reading, unnest(string_split_regex(t, '\x01+')) AS s, generate_subscripts(string_split_regex(t, '\x01+'), 1) AS place FROM readings),
normal AS (SELECT doc_id, reading, place, {_normalised("s")} AS s FROM sentences),
parts AS (
  SELECT doc_id, reading, place, 1 AS part, s FROM normal WHERE NOT starts_with(s, {_text(license.SPDX)})
  UNION ALL SELECT doc_id, reading, place, unnest(range(1, len(p) + 1)), {_text(license.SPDX)} || unnest(p) FROM (SELECT *, string_split_regex(regexp_replace(substr(s, {start}), ' with [^ ]+', '', 'g'), ' (?:or|and) ') AS p FROM normal WHERE starts_with(s, {_text(license.SPDX)}))),
found AS (SELECT doc_id, string_agg(CASE WHEN reading = 1 THEN id END, ',' ORDER BY place, part) AS a, string_agg(CASE WHEN reading = 2 THEN id END, ',' ORDER BY place, part) AS b FROM parts JOIN known USING (s) GROUP BY doc_id),
joined AS (SELECT *, '|' || replace(coalesce(a, ''), ',', '|') || '||' || replace(coalesce(b, ''), ',', '|') || '|' AS ids FROM found),
matched AS (SELECT doc_id, n, license FROM joined JOIN rules ON regexp_matches(ids, pattern)),
names AS (SELECT DISTINCT doc_id, license FROM matched WHERE NOT EXISTS (SELECT 1 FROM matched m JOIN instead USING (n) WHERE m.doc_id = matched.doc_id AND instead.license = matched.license)),
counted AS (SELECT *, count(*) FILTER (WHERE license <> 'proprietary') OVER (PARTITION BY doc_id) AS others FROM names),
licensed AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses FROM counted WHERE license <> 'proprietary' OR others = 0 GROUP BY doc_id),
ruled AS (SELECT doc_id, string_agg(n::VARCHAR, ',' ORDER BY n) AS rules FROM matched GROUP BY doc_id)
SELECT d.doc_id, coalesce(licenses, '') AS licenses, coalesce(a, '') AS paragraph_ids, coalesce(b, '') AS line_ids, coalesce(rules, '') AS rules
FROM documents d LEFT JOIN joined j ON j.doc_id IS NOT DISTINCT FROM d.doc_id LEFT JOIN licensed l ON l.doc_id IS NOT DISTINCT FROM d.doc_id LEFT JOIN ruled r ON r.doc_id IS NOT DISTINCT FROM d.doc_id
"""
