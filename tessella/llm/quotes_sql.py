"""Quotation linking in SQL."""

from tessella.llm.quotes import ATTRIBUTION

_NORMAL = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
_BREAKS = "chr(13) || chr(10) || '|' || chr(13) || '|' || chr(10)"

QUOTES_SQL = f"""
WITH RECURSIVE base AS (SELECT row_number() OVER () AS uid, conv_id, turn, role, text FROM conversations),
split_ AS (SELECT uid, conv_id, turn, regexp_split_to_array(text, {_BREAKS}) AS l FROM base WHERE contains(text, '>')),
line AS (SELECT uid, conv_id, turn, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM split_),
mark_ AS (SELECT *, regexp_extract(line, '^[ \\t]*(?:>[ \\t]*)+') AS m FROM line),
lev AS (SELECT uid, conv_id, turn, line_no, length(m) - length(replace(m, '>', '')) AS level, substr(line, length(m) + 1) AS body FROM mark_),
quoting AS (SELECT uid FROM lev GROUP BY uid HAVING max(level) > 0),
opened AS (SELECT *, coalesce((level <> lag(level) OVER w)::INT, 1) AS opens, lead(level) OVER w AS next_level FROM lev WHERE uid IN (SELECT uid FROM quoting) WINDOW w AS (PARTITION BY uid ORDER BY line_no)),
run_ AS (SELECT *, sum(opens) OVER (PARTITION BY uid ORDER BY line_no) AS run FROM opened),
bare AS (SELECT uid, string_agg(body, chr(10) ORDER BY line_no) AS bare FROM run_ WHERE level = 0 AND NOT (regexp_matches(body, '{ATTRIBUTION}') AND coalesce(next_level, 0) > 0) GROUP BY uid),
quoted AS (SELECT * FROM run_ WHERE level > 0 AND trim(body) <> ''),
counted AS (SELECT uid, count(DISTINCT run) AS quoted_passages, max(level) AS quote_depth FROM quoted GROUP BY uid),
passage AS (SELECT uid, conv_id, turn, run, level, {_NORMAL.format("string_agg(body, chr(10) ORDER BY line_no)")} AS norm, list({_NORMAL.format("body")} ORDER BY line_no) AS lines FROM quoted WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
own AS (SELECT b.conv_id, b.turn, coalesce(bare, text, '') AS body FROM base b LEFT JOIN bare USING (uid) WHERE b.turn IS NOT NULL AND b.conv_id IN (SELECT conv_id FROM passage)),
own_lines AS (SELECT conv_id, turn, list_transform(list_filter(regexp_split_to_array(body, {_BREAKS}), lambda x: trim(x) <> ''), lambda x: {_NORMAL.format('x')}) AS lines FROM own),
own_line AS (SELECT conv_id, turn, lines, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS norm FROM own_lines),
found AS (
  SELECT p.uid, p.run, p.level, o.turn AS source FROM passage p JOIN own o ON o.conv_id = p.conv_id AND o.turn < p.turn AND {_NORMAL.format('o.body')} = p.norm
  UNION ALL SELECT p.uid, p.run, p.level, o.turn FROM passage p JOIN own_line o ON o.conv_id = p.conv_id AND o.turn < p.turn AND o.norm = p.lines[1] AND o.lines[o.i : o.i + len(p.lines) - 1] = p.lines),
exact AS (SELECT uid, run, level, max(source) AS source FROM found GROUP BY ALL),
asked AS (SELECT uid, conv_id, turn, run, level, len(lines) AS of_, unnest(range(1, len(lines) + 1)) AS line_no, unnest(lines) AS norm FROM passage),
latest AS (SELECT a.uid, a.run, a.level, a.of_, a.line_no, max(o.turn) AS source FROM asked a JOIN own_line o ON o.conv_id = a.conv_id AND o.norm = a.norm AND o.turn < a.turn GROUP BY ALL),
votes AS (SELECT uid, run, level, source, count(*) AS n FROM latest GROUP BY uid, run, level, of_, source HAVING 2 * count(*) > of_),
partial AS (SELECT uid, run, level, arg_max(source, (n, source)) AS source FROM votes GROUP BY ALL),
linked AS (SELECT coalesce(e.uid, p.uid) AS uid, coalesce(e.run, p.run) AS run, coalesce(e.level, p.level) AS level, coalesce(e.source, p.source) AS source FROM exact e FULL JOIN partial p ON p.uid = e.uid AND p.run = e.run),
answer AS (SELECT uid, arg_min(source, (level, run)) AS quoted_turn, count(*) AS linked_passages FROM linked GROUP BY uid),
turns AS (SELECT DISTINCT conv_id, turn FROM base WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
prev AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM turns),
told AS (
  SELECT b.conv_id, b.turn, b.role, trim(coalesce(bare, text, '')) AS text, coalesce(quoted_passages, 0)::BIGINT AS quoted_passages, coalesce(linked_passages, 0)::BIGINT AS linked_passages,
         coalesce(quote_depth, 0)::INT AS quote_depth, coalesce(quoted_turn, previous) AS parent_turn, quoted_turn IS NOT NULL AS linked
  FROM base b LEFT JOIN bare USING (uid) LEFT JOIN counted USING (uid) LEFT JOIN answer USING (uid) LEFT JOIN prev ON prev.conv_id = b.conv_id AND prev.turn = b.turn),
parent AS (SELECT conv_id, turn, arg_max(coalesce(parent_turn, -1), (linked, coalesce(parent_turn, -1))) AS up FROM told WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
climb AS (
  SELECT conv_id, turn, turn AS top, 0::BIGINT AS depth FROM parent
  UNION ALL SELECT c.conv_id, c.turn, p.up, c.depth + 1 FROM climb c JOIN parent p ON p.conv_id = c.conv_id AND p.turn = c.top WHERE p.up >= 0),
root AS (SELECT conv_id, turn, arg_max(top, depth) AS thread_turn, max(depth) AS reply_depth FROM climb GROUP BY ALL)
SELECT t.conv_id, t.turn, t.role, t.text, quoted_passages, linked_passages, quote_depth, parent_turn, linked, coalesce(thread_turn, t.turn) AS thread_turn, coalesce(reply_depth, 0)::BIGINT AS reply_depth
FROM told t LEFT JOIN root r ON r.conv_id = t.conv_id AND r.turn = t.turn
"""
