"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP5 = r"""
WITH captures AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS day,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)), '\.$', ''), '') AS host
  FROM pages
),
names AS (
  SELECT DISTINCT pattern FROM (
    SELECT host AS pattern FROM captures UNION ALL SELECT regexp_replace(host, '^[^.]+\.', '') FROM captures
  ) WHERE pattern IS NOT NULL
),
sums AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 7) AS BIGINT) AS c FROM names),
entries AS (
  SELECT pattern, DATE '2024-01-01' + CAST(CAST(floor(c / d) AS BIGINT) % 300 AS INTEGER) AS day, r
  FROM sums, (VALUES (7, 2), (11, 1), (13, 0), (17, 2)) AS t(d, r) WHERE c % 3 < 2
),
daily AS (SELECT pattern, day, max(r) AS r FROM entries GROUP BY ALL),
spans AS (SELECT pattern, day AS a, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS b, r FROM daily),
levels AS (
  SELECT page_id, day, unnest(range(1, len(string_split(host, '.')) + 1)) AS k, string_split(host, '.') AS parts FROM captures WHERE host IS NOT NULL
),
met AS (
  SELECT l.page_id, s.pattern, CASE s.r WHEN 2 THEN 'block' ELSE 'allow' END AS action,
    row_number() OVER (PARTITION BY l.page_id ORDER BY l.k) AS n
  FROM levels l JOIN spans s ON s.pattern = array_to_string(l.parts[l.k:], '.')
  WHERE s.r > 0 AND s.a <= l.day AND (s.b IS NULL OR l.day < s.b)
)
SELECT c.page_id, c.host, c.day, m.pattern, m.action, coalesce(m.action <> 'block', TRUE) AS kept
FROM captures c LEFT JOIN met m ON m.page_id = c.page_id AND m.n = 1
"""



def _op12(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """Codebooks round by round, every part against every entry."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""
a{r} AS MATERIALIZED (
  SELECT p.k, p.part, min(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) * {entries} + c.entry) AS best
  FROM parts p JOIN c{r} c ON c.part = p.part GROUP BY p.k, p.part
)"""
        )
        if r < rounds:
            steps.append(
                f"""
m{r} AS MATERIALIZED (
  SELECT part, entry, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END ORDER BY pos) AS v FROM (
    SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
      SELECT a.part, a.best % {entries} AS entry, unnest(p.v) AS x, unnest(range(1, len(p.v) + 1)) AS pos
      FROM a{r} a JOIN parts p ON p.k = a.k AND p.part = a.part
    ) GROUP BY part, entry, pos
  ) GROUP BY part, entry
),
c{r + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.part = c.part AND m.entry = c.entry
)"""
            )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS k, * FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  )
),
parts AS MATERIALIZED (
  SELECT k, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) AS t(part)
),
c0 AS MATERIALIZED (SELECT part, k AS entry, v FROM parts WHERE k < {entries}),
{",".join(steps)},
books AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM c{rounds})
),
coded AS (
  SELECT k, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error
  FROM a{rounds} GROUP BY k
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (k), books
"""


OP13 = r"""
WITH sized AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS k
  FROM documents
),
sources AS MATERIALIZED (
  SELECT *, 1 + (rank - 1) % 3 AS weight FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS words, CAST(sum(size) + count(*) AS BIGINT) AS units,
      row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source
  )
),
whole AS (SELECT sum(words) AS t, sum(weight) AS w, greatest(262144, (sum(units) + 65535) // 65536) AS per_shard FROM sources),
-- sources in the order in which a rising level passes their ceilings
climb AS (
  SELECT 3 * words AS ceiling, weight, t - coalesce(sum(3 * words) OVER before, 0) AS num, w - coalesce(sum(weight) OVER before, 0) AS den,
    row_number() OVER (ORDER BY 3 * words / weight, rank) AS n
  FROM sources, whole WINDOW before AS (ORDER BY 3 * words / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
level AS (SELECT arg_min(num, n) AS num, arg_min(den, n) AS den FROM climb WHERE ceiling * den >= num * weight),
aims AS MATERIALIZED (
  SELECT s.*, CAST(ceil(units / per_shard) AS BIGINT) AS n_shards,
    CASE WHEN num IS NULL OR 3 * words * den < num * weight THEN CAST(3 * words AS DOUBLE)
      ELSE CAST(num AS DOUBLE) * weight / CAST(den AS DOUBLE) END AS target
  FROM sources s, whole, level
),
placed AS MATERIALIZED (
  SELECT d.*, a.rank, a.words AS source_size, CAST('0x' || substr(d.k, 1, 15) AS BIGINT) % a.n_shards AS shard
  FROM sized d JOIN aims a ON a.source IS NOT DISTINCT FROM d.source
),
shards AS MATERIALIZED (
  SELECT rank, shard, w, CASE WHEN w > 0 THEN greatest(1, (2 * w + 256) // 512) ELSE 0 END AS n
  FROM (SELECT rank, shard, CAST(sum(size) AS BIGINT) AS w FROM placed GROUP BY rank, shard)
),
votes AS MATERIALIZED (
  SELECT a.rank, a.target, b.n_all, CASE WHEN words > 0 THEN target * n_all / words ELSE 0 END AS v
  FROM aims a JOIN (SELECT rank, CAST(sum(n) AS BIGINT) AS n_all FROM shards GROUP BY rank) b ON b.rank = a.rank
),
wanted AS (SELECT CAST(floor(sum(CAST(v AS DECIMAL(28, 9))) + 0.5) AS BIGINT) AS b FROM votes),
bids AS (
  SELECT rank, row_number() OVER (ORDER BY v / (2 * i - 1) DESC, rank) AS place
  FROM (SELECT rank, v, unnest(range(1, 3 * n_all + 1)) AS i FROM votes WHERE v > 0)
),
seats AS (SELECT rank, count(*) AS q FROM bids, wanted WHERE place <= b GROUP BY rank),
plan AS MATERIALIZED (
  SELECT rank, shard, w, n, target, passes, (past * rest) // g - ((past - n) * rest) // g AS more,
    CAST('0x' || substr(md5('17|' || rank || '|' || shard), 1, 15) AS BIGINT) % greatest(n, 1) AS turn
  FROM (
    SELECT s.*, v.target, greatest(v.n_all, 1) AS g, coalesce(q, 0) // greatest(v.n_all, 1) AS passes,
      coalesce(q, 0) % greatest(v.n_all, 1) AS rest, CAST(sum(s.n) OVER (PARTITION BY s.rank ORDER BY s.shard) AS BIGINT) AS past
    FROM shards s JOIN votes v ON v.rank = s.rank LEFT JOIN seats e ON e.rank = s.rank
  )
),
lined AS (
  SELECT p.*, CAST(sum(size) OVER (PARTITION BY rank, shard ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM placed p
)
SELECT doc_id, size, source_size, target,
  CAST(size * passes + CASE WHEN size > 0 AND more > 0 THEN list_sum(list_transform(
    range(((e - size + 1) * n - 1) // w, (e * n - 1) // w + 1),
    lambda i: CASE WHEN ((i + turn) * more) % n < more THEN least(e, ((i + 1) * w) // n) - greatest(e - size, (i * w) // n) ELSE 0 END
  )) ELSE 0 END AS BIGINT) AS taken,
  source, shard, CAST(passes * n + more AS BIGINT) AS quota
FROM lined JOIN plan USING (rank, shard)
"""


OP11 = r"""
WITH turns AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
opened AS (
  SELECT c.conv_id, c.own, b.own AS head, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(1, length(CAST(c.conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(c.conv_id AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT))),
    lambda crc, sign: list_reduce([xor(crc, sign), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))
  ), 4294967295) % 4 AS h
  FROM turns c LEFT JOIN turns b ON b.conv_id = c.conv_id - c.conv_id % 20
),
paths AS MATERIALIZED (
  SELECT conv_id, list_concat(coalesce(head, [])[1:h], own[h + 1:]) AS path FROM opened
),
prefixes AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM paths),
nodes AS MATERIALIZED (
  SELECT path[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(path) = depth) AS ends
  FROM prefixes GROUP BY ALL
),
valued AS MATERIALIZED (
  SELECT *, row_number() OVER () AS id, (n_convs - 1) * coalesce(len(regexp_extract_all(prefix[depth].t, '[^\x20\x09-\x0D]+')), 0) AS saved FROM nodes
),
links AS MATERIALIZED (SELECT c.id, p.id AS parent, p.conv_id AS parent_conv_id FROM valued c JOIN valued p ON p.depth = c.depth - 1 AND p.prefix = c.prefix[1:p.depth]),
children AS (SELECT parent AS id, count(*) AS n FROM links GROUP BY 1),
below AS (
  SELECT a.id, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, CAST(sum(d.saved) AS BIGINT) AS saved_tokens
  FROM valued d JOIN (SELECT id, unnest(range(0, depth + 1)) AS up FROM valued) u ON u.id = d.id
  JOIN valued a ON a.depth = u.up AND a.prefix = d.prefix[1:u.up] LEFT JOIN children k ON k.id = d.id
  GROUP BY a.id
)
SELECT v.conv_id, v.depth, l.parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves, b.saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM valued v LEFT JOIN links l ON l.id = v.id LEFT JOIN children k ON k.id = v.id JOIN below b ON b.id = v.id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filters": OP5, "op11_conversation_trie": OP11, "op12_vector_codes": _op12(), "op13_source_mix": OP13}
