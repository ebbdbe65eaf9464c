"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from versefold.llm.chat import ROLES

SAID = "\\### Assistant: </turn> ok"
MARK = "CASE role " + " ".join(f"WHEN '{r}' THEN '{shown}'" for r, shown in ROLES.items()) + " ELSE '=' || url_encode(role) END"

#: Escaping adds a backslash for each backslash, between two # and into each closing mark.
CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '{SAID}' UNION ALL SELECT -7, 1, 'assistant', '{SAID}'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
 coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
 sum(length('### : </turn>') + 1 + length({MARK}) + length(text) + length(text) - length(replace(text, '\\', '')) + length(text) - length(replace(text, '#', '')) - len(regexp_extract_all(text, '#+'))
  + (length(text) - length(replace(text, '</turn>', ''))) // 7) AS size FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars FROM g"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS q FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(q) >= 5 THEN list_transform(generate_series(1, len(q) - 4), lambda i: array_to_string(q[i:i + 4], ' ')) WHEN len(q) > 0 THEN [array_to_string(q, ' ')] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.root), w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id"""

ORACLES = {"op2_chat": CHAT, "op8_jaccard_join": JACCARD}
