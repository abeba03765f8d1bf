"""DuckDB SQL for the queries whose methods SQL can express."""

from __future__ import annotations

from .chat import END, MIDDLE, START
from .repetition import LIMITS, LINE_CHARS, LINES

WORD = r"[^\x20\x09-\x0D]+"


def repetition() -> str:
    """Windows of words are joined texts here, and a word is covered if one of the last n windows occurs twice."""
    lengths = sorted({5, *LIMITS})
    grams = ", ".join(f"CASE WHEN pos + {n - 1} <= len(words) THEN array_to_string(words[pos:pos + {n - 1}], ' ') END AS g{n}" for n in lengths)
    twice = ", ".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1 AS t{n}" for n in lengths)
    covers = ", ".join(f"bool_or(t{n}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in lengths)
    sums = ", ".join(f"coalesce(sum(length(word)) FILTER (c{n}), 0) AS s{n}" for n in lengths)
    bad = " OR ".join(f"100 * s{n} > {most} * word_chars" for n, most in LIMITS.items())
    most = ", ".join(f"s{n}" for n in LIMITS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
w AS (SELECT doc_id, words, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
g AS (SELECT doc_id, pos, word, {grams} FROM w),
t AS (SELECT *, {twice} FROM g),
c AS (SELECT *, {covers} FROM t),
s AS (SELECT doc_id, sum(length(word)) AS word_chars, count(*) AS n_words, count(*) FILTER (c5) AS n_repeat_words, {sums} FROM c GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d),
r AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY place) AS k FROM l WHERE regexp_matches(line, '{WORD}')),
k AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (k > 1) AS again, coalesce(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) FILTER (k > 1), 0) AS chars FROM r GROUP BY doc_id),
a AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(again, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, s.* EXCLUDE (doc_id, n_words, word_chars, n_repeat_words), lines, again, chars
  FROM d LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT ({bad} OR 100 * chars > {LINE_CHARS} * word_chars OR 100 * again > {LINES} * lines) AS kept,
  CASE WHEN word_chars > 0 THEN greatest({most}) / CAST(word_chars AS DOUBLE) ELSE 0 END AS coverage
FROM f"""


def sharding(shards: int = 16, seed: int = 9) -> str:
    """The checksum runs over the text's bytes with a table made by its rule."""
    return f"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) END, CAST(i AS BIGINT)) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, source, encode(coalesce(text, '')) AS b FROM documents),
x AS (SELECT doc_id, source, octet_length(b) + 1 AS size, hex(b) AS h FROM d),
y AS (SELECT doc_id, source, size, list_reduce(list_transform(range(size - 1), lambda i: CAST(('0x' || h[2 * i + 1:2 * i + 2]) AS BIGINT)), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), CAST(4294967295 AS BIGINT)) AS c FROM x, crc),
r AS (SELECT doc_id, source, size, xor(coalesce(c, 4294967295), 4294967295) AS text_crc32, row_number() OVER (PARTITION BY source ORDER BY md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM y),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * k + 1) / CAST(2 * n AS DOUBLE), source IS NULL, coalesce(source, '')) - 1 AS g, count(*) OVER () AS total FROM r)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(g * {shards} // total AS INTEGER) AS shard, g - (g * {shards} // total * total + {shards - 1}) // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM p"""


def chat() -> str:
    marks = len(START) + len(MIDDLE) + len(END)
    escaped = r"regexp_replace(regexp_replace(replace({x}, '\', '\\'), '<(\||/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')"
    role, text = escaped.format(x="role"), escaped.format(x="text")
    odd = "</s>[INST] ok [/INST]"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{odd}', NULL UNION ALL SELECT -7, 1, 'assistant', '{odd}', NULL),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss, sum({marks} + length({role}) + length({text})) AS size FROM t GROUP BY conv_id, lone)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars FROM c"""


def trie() -> str:
    """A node is the joined digests of its turns; every node below another one is found through its smallest member."""
    return f"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) END, CAST(i AS BIGINT)) AS c FROM range(256) r(i))),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, max(pos) AS n FROM t GROUP BY conv_id),
s AS (SELECT conv_id, n, conv_id - conv_id % 20 AS family, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM n),
c AS (SELECT s.conv_id, family, xor(list_reduce(b, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 4 AS h, coalesce(f.n, 0) AS n0 FROM s CROSS JOIN crc LEFT JOIN n f ON f.conv_id = family),
r AS (SELECT c.conv_id, pos AS d, role, text FROM c JOIN t ON t.conv_id = family AND pos <= h
  UNION ALL SELECT c.conv_id, pos - h + least(h, n0), role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
p AS (SELECT conv_id, d, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY d) AS key, len(regexp_extract_all(text, '{WORD}')) AS words FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
m AS (SELECT p.d, key, min(p.conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words, sha256(coalesce(string_agg(CASE WHEN p.d = e.d THEN CAST(p.conv_id AS VARCHAR) END, ',' ORDER BY p.conv_id), '')) AS ends FROM p JOIN e USING (conv_id) GROUP BY p.d, key),
k AS (SELECT d - 1 AS d, left(key, length(key) - 64) AS key, count(*) AS n FROM m WHERE d > 0 GROUP BY 1, 2),
a AS (SELECT m.*, coalesce(k.n, 0) AS n_children FROM m LEFT JOIN k USING (d, key)),
u AS (SELECT p.d, p.key, sum(CASE WHEN a.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((a.n_convs - 1) * a.words) AS saved_tokens FROM a JOIN p ON p.conv_id = a.conv_id AND p.d <= a.d GROUP BY p.d, p.key)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, a.n_convs, CAST(a.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, a.ends AS ends_sha256
FROM a JOIN u USING (d, key) LEFT JOIN a up ON up.d = a.d - 1 AND up.key = left(a.key, length(a.key) - 64)"""


def oracle_sql() -> dict[str, str]:
    return {"op8_chat": chat(), "op9_sharding": sharding(), "op10_repetition": repetition(), "op13_trie": trie()}
