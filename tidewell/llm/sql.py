"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "op5_topk": """WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5""",
    # Twenty bits, five hexadecimal digits, are four letters of base32.
    "op4_warc": """WITH p AS (SELECT page_id, COALESCE(html, '') AS html, sha1(COALESCE(html, '')) AS sha, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS letters FROM pages),
  r AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS lead, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) = 1 AS first FROM p),
  b AS (SELECT *, list_transform(range(1, 41, 5), lambda i: CAST('0x' || substr(sha, CAST(i AS INTEGER), 5) AS INTEGER)) AS parts FROM r)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(parts, lambda x: letters[(x >> 15) + 1] || letters[((x >> 10) & 31) + 1] || letters[((x >> 5) & 31) + 1] || letters[(x & 31) + 1]), '') AS payload_digest,
  CASE WHEN first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT first THEN lead END AS refers_to, true AS intact FROM b""",
    # A turn has 23 characters of marks; escaping adds one to a backslash and two to a control string.
    "op7_chat": r"""WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
  e AS (SELECT *, md5(role || chr(0) || text) AS tie, regexp_extract_all(role || chr(1) || text, '\\|<\|turn\|>|<\|body\|>|<\|end\|>|<\|endoftext\|>|<\|startoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>') AS marks FROM c),
  s AS (SELECT *, length(role) + length(text) + 23 + COALESCE(list_sum(list_transform(marks, lambda m: CASE WHEN m = '\' THEN 1 ELSE 2 END)), 0) AS size FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, tie)) AS turns_sha256,
  CAST(COALESCE(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, tie) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id""",
}
