"""DuckDB SQL of the queries that SQL can express; the others are tested against brute force."""

# A copy of the template's fixed control strings in this engine's pattern spelling: each match takes one more character.
_CONTROL = r"[<\[]\\*(?:\|im_start\|>|\|im_end\|>|s>|/s>|INST\]|/INST\]|\|endoftext\|>)"

CHAT_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length('<|im_start|>') + length(role) + 1 + length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + length('<|im_end|>') + 1 AS chars,
    lead(turn) OVER w IS NULL AS last
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), run AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS prefix FROM sized
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(prefix) FILTER (WHERE role = 'assistant' OR last) AS BIGINT) AS formatted_chars
FROM run GROUP BY conv_id
"""

JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(b, w.doc_id)) AS component_id
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN least ON a = w.doc_id
"""



def merkle_sql(levels: int = 6) -> str:
    """Trees of up to 16 ** ``levels`` leaves, and as many sources: one step a level, siblings by a join of each run."""
    fields = " || ".join(f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')" for v in ("doc_id", "source", "lang", "n_chars", "{text}"))
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    byte = f"list_reduce(list_concat([xor(crc, b)], range(8)), lambda c, i: {step})"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(str_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda crc, b: {byte}), 4294967295)"
    ctes = [f"""start AS (
  SELECT row_number() OVER () AS id, doc_id, source AS tree, sha256({fields.format(text='text')}) AS leaf,
    CASE WHEN {crc} % 5 = 0 THEN sha256({fields.format(text=small)}) END AS given FROM documents
), rows_0 AS (
  SELECT *, coalesce(given, leaf) AS folded, '' AS proof, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, given NULLS FIRST, id) - 1 AS pos FROM start
), nodes_0 AS (SELECT tree, pos, leaf AS node FROM rows_0)"""]

    def climb(k: int, nodes: str, rows: str, more: str, key: str) -> str:
        return f"""{more}_sized_{k} AS (
  SELECT *, count(*) OVER (PARTITION BY tree) > 1 AS several, CASE WHEN count(*) OVER (PARTITION BY tree) > 1 THEN pos // 16 ELSE pos END AS above FROM {nodes}
), {nodes[:-1]}{k + 1} AS (
  SELECT tree, above AS pos, CASE WHEN bool_or(several) THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE any_value(node) END AS node FROM {more}_sized_{k} GROUP BY tree, above
), {rows[:-1]}{k + 1} AS (
  SELECT r.id, any_value(r.doc_id) AS doc_id, any_value(r.{key}) AS {key}, any_value(r.leaf) AS leaf, any_value(r.given) AS given,
    CASE WHEN bool_or(n.several) THEN sha256(string_agg(CASE WHEN n.pos = r.pos THEN r.folded ELSE n.node END, '' ORDER BY n.pos)) ELSE any_value(r.folded) END AS folded,
    any_value(r.proof) || coalesce(string_agg(n.node, '' ORDER BY n.pos) FILTER (n.pos <> r.pos AND n.several), '') AS proof,
    any_value(n.above) AS pos{', any_value(r.subroot) AS subroot' if key == 'top' else ''}
  FROM {rows} r JOIN {more}_sized_{k} n ON r.{key} IS NOT DISTINCT FROM n.tree AND n.above = CASE WHEN n.several THEN r.pos // 16 ELSE r.pos END GROUP BY r.id
)"""

    ctes += [climb(k, f"nodes_{k}", f"rows_{k}", "own", "tree") for k in range(levels)]
    ctes.append(f"""subroots AS (
  SELECT tree AS source, node, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos FROM nodes_{levels}
), top_nodes_0 AS (SELECT 0 AS tree, pos, node FROM subroots
), top_rows_0 AS (
  SELECT r.* EXCLUDE (pos, tree), 0 AS top, s.pos AS pos, s.node AS subroot FROM rows_{levels} r JOIN subroots s ON r.tree IS NOT DISTINCT FROM s.source
)""")
    ctes += [climb(k, f"top_nodes_{k}", f"top_rows_{k}", "all", "top") for k in range(levels)]
    return f"""WITH {', '.join(ctes)}
SELECT doc_id, leaf, subroot, n.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = n.node AS verified
FROM top_rows_{levels} JOIN top_nodes_{levels} n ON true"""


ORACLES = {"op2_chat_formatting": CHAT_SQL, "op3_ngram_jaccard_join": JACCARD_SQL, "op12_merkle_manifest": merkle_sql()}
