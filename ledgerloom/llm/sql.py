"""DuckDB SQL for the rows of those queries that SQL can express on whole tables.

The others have none: learnt scores (1), approximate search (2), Spark's hashes and CRC-32, which DuckDB lacks (3, 7,
8, 9), markup (4) and the tokenizer (7). Tests hold them against brute force.
"""

from __future__ import annotations

from .licenses import NOTICES, WIDTH


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _shingles(words: str) -> str:
    """Rows (pos, shingle) of a list of words."""
    return f"unnest(list_transform(range(0, greatest(0, len({words}) - {WIDTH - 1})), lambda i: {{'pos': i, 's': array_to_string({words}[i + 1 : i + {WIDTH}], ' ')}}))"


_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"

LICENSES = f"""
WITH notices(license, text) AS (VALUES {', '.join(f'({_text(k)}, {_text(v)})' for k, v in NOTICES.items())}),
worded AS (SELECT license, {_WORDS} AS w FROM notices),
wanted AS (SELECT DISTINCT license, x.s AS s FROM (SELECT license, {_shingles('w')} AS x FROM worded)),
sized AS (SELECT license, count(*) AS n, CAST(floor(log2(count(*))) AS BIGINT) AS class FROM wanted GROUP BY license),
strides AS (SELECT class, greatest(1, CAST(pow(2, class) AS BIGINT) // 2) AS stride, max(n) + greatest(1, CAST(pow(2, class) AS BIGINT) // 2) - 1 AS width FROM sized GROUP BY class),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
held AS (SELECT r, doc_id, x.pos AS pos, x.s AS s FROM (SELECT r, doc_id, {_shingles('w')} AS x FROM docs)),
hits AS (SELECT r, doc_id, license, n, pos, s, stride, width FROM held JOIN wanted USING (s) JOIN sized USING (license) JOIN strides USING (class)),
covered AS (SELECT r, doc_id, license, n, pos, s, unnest(range(greatest(0, CAST(floor((pos - width + stride) / stride) AS BIGINT)), pos // stride + 1)) AS k FROM hits),
windows AS (SELECT r, doc_id, license, k, count(DISTINCT s) / n AS containment, min(pos) AS first FROM covered GROUP BY r, doc_id, license, n, k),
kept AS (SELECT *, row_number() OVER (PARTITION BY r, license ORDER BY containment DESC, first) AS rank, count(*) OVER (PARTITION BY r, license) AS windows FROM windows WHERE containment >= 0.8)
SELECT doc_id, license, containment, CAST(first AS BIGINT) AS start_word, windows FROM kept WHERE rank = 1"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
scored AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_dot_product(q.e, v.e) AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""

CHAT = r"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
f AS (SELECT *, '### ' || CASE WHEN role IN ('system', 'user', 'assistant') THEN role ELSE '@' || replace(regexp_replace(role, '(\\|###|</turn>)', '\\\1', 'g'), ':', '\:') END
  || ': ' || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || '</turn>' || chr(10) AS formatted FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id"""
