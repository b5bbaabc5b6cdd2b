"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from veilframe.llm.shards import BLOCK


def _crc_table() -> list[int]:
    """The table of the reflected CRC-32 polynomial, by its rule."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.9),
reach(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.id),
least AS (SELECT id, min(c) AS c FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, c = vec_id AS kept
FROM embeddings JOIN least ON id = vec_id LEFT JOIN degree ON a = vec_id"""

SHARDS = f"""
WITH d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, hex(encode(coalesce(text, ''))) AS h, {_crc_table()} AS tbl FROM documents),
sized AS (
  SELECT doc_id, k, CAST(length(h) // 2 + 16 AS BIGINT) AS size,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
      lambda c, b: xor(c >> 8, CAST(tbl[(xor(c, b) & 255) + 1] AS BIGINT)))) AS text_crc32 FROM d),
bids AS (
  SELECT doc_id, size, text_crc32, k,
    list_transform(range(0, 41), lambda i: -ln((CAST('0x' || substr(md5(k || ':' || i), 1, 13) AS BIGINT) + 0.5) / 4503599627370496)) AS bid FROM sized),
won AS (
  SELECT *, list_position(bid, list_min(bid[1:40])) - 1 AS shard, CASE WHEN bid[41] < list_min(bid[1:40]) THEN 40 END AS new,
    CAST('0x' || substr(md5(k || ':' || text_crc32), 1, 8) AS BIGINT) % greatest(1, CAST(ceil((SELECT count(*) FROM documents) / {BLOCK * 40}.0) AS BIGINT)) AS block FROM bids)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, size, text_crc32) - 1 AS slot, CAST(coalesce(new, shard) AS INT) AS grown_shard FROM won"""

_HASHES = "coalesce(list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda x: length(x) - 2)), 0)"
_ESCAPED = f"length({{0}}) + length({{0}}) - length(replace({{0}}, chr(92), '')) + {_HASHES} + (length({{0}}) - length(replace({{0}}, '</turn>', ''))) // 7"

CHAT = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, i, x, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, x)),
said AS (SELECT *, CASE WHEN r = 'assistant' THEN t ELSE '' END AS learnt,
    {_ESCAPED.format("r")} + length(r) - length(replace(r, ':' || chr(10), chr(10))) + {_ESCAPED.format("t")} + 14 AS n FROM given)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  CAST(sum(length(learnt)) AS BIGINT) AS loss_chars, sha256(string_agg(learnt, '' ORDER BY turn, r, t)) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id"""

DIVERGENCE = """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
occ AS (SELECT id, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS ln FROM occ GROUP BY ALL HAVING count(DISTINCT id) >= 30),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS n FROM occ SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT grp.lang, grp.source, term, ln, coalesce(n, 0) AS n FROM grp JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, term)),
tot AS (SELECT lang, source, sum(n) AS big, sum(ln) AS lbig, count(*) AS v FROM cells GROUP BY ALL),
p AS (SELECT lang, source, term, n,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (big + 5 * v) AS BIGINT) AS p,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (ln + 5)) // (lbig + 5 * v) AS BIGINT) AS q FROM cells JOIN tot USING (lang, source)),
far AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL),
pairs AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM grp x JOIN grp y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN far ON far.lang = x.lang AND far.source = x.source AND far.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank
  FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""

#: op9 in SQL repeats each document once for each of its windows: too slow on whole tables, so
#: tests hold that query against brute force instead.
ORACLE_SQL: dict[str, str] = {"op2_embeddings": EMBEDDINGS, "op5_shards": SHARDS, "op11_chat": CHAT, "op12_divergence": DIVERGENCE}
