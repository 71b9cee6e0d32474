"""DuckDB counterparts of the corpus queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_NOT_BLANK = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
  SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, dw.k, i FROM dw JOIN bw USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""

NEARDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_NOT_BLANK}) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT DISTINCT a AS id, a AS other FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT id, min(other) AS m FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, d.doc_id)::BIGINT AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id
"""

TOP_K = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 10
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p),
b AS (SELECT *, list_transform(range(0, 32), lambda i: (('0x' || h[(i * 5) // 4 + 1])::INTEGER * 16 + coalesce(nullif('0x' || h[(i * 5) // 4 + 2], '0x'), '0x0')::INTEGER)) AS x FROM d)
SELECT page_id, payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((x[i + 1] >> (3 - (i * 5) % 4)) & 31) + 1]), '') AS payload_digest,
CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM b
"""


# crc32 bit by bit; then, row after row, the least (cost, audit) for every last role.
REPAIR = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
x AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 20 AS kind FROM k),
m AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) FROM x WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
  left(role, 1) AS c, regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail FROM m),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM o),
f AS MATERIALIZED (SELECT *, tail = '' AS blank, tail <> '' AND nth > 1 AS dup, tail <> '' AND nth = 1 AND tail NOT IN ('.', '!', '?') AS trunc, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS pc FROM t),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(blank)::BIGINT AS blank, count_if(dup)::BIGINT AS duplicate, count_if(trunc)::BIGINT AS truncated,
  count_if(i > 1 AND pc || c NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(i) AS rows FROM f GROUP BY conv_id),
p AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS st, struct_pack(cost := 0::BIGINT, audit := '', kept := '') AS v FROM f
  UNION ALL SELECT conv_id, i, st, min(v) FROM (
    SELECT p.conv_id, f.i, p.st, struct_pack(cost := p.v.cost + 4, audit := p.v.audit || 'D', kept := p.v.kept) AS v FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1
    UNION ALL SELECT p.conv_id, f.i, q, struct_pack(cost := p.v.cost + 3 * (p.st || q IN ('a', 'sa', 'uu', 'aa'))::BIGINT + 3 * (f.c <> q)::BIGINT + 3 * f.trunc::BIGINT,
      audit := p.v.audit || CASE WHEN p.st || q IN ('a', 'sa', 'uu', 'aa') THEN 'I' ELSE '' END || CASE WHEN f.c = q THEN 'K' ELSE 'R' END,
      kept := p.v.kept || CASE p.st || q WHEN 'a' THEN 'user:' || chr(10) WHEN 'sa' THEN 'user:' || chr(10) WHEN 'aa' THEN 'user:' || chr(10) WHEN 'uu' THEN 'assistant:' || chr(10) ELSE '' END
        || CASE WHEN f.c = q THEN f.role WHEN q = 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text || chr(10))
      FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1, (VALUES ('s'), ('u'), ('a')) t(q) WHERE NOT f.blank AND NOT f.dup AND (q <> 's' OR (p.st = '' AND f.c = 's'))) GROUP BY ALL),
e AS (SELECT p.conv_id, min(struct_pack(cost := v.cost + CASE st WHEN 's' THEN 6 WHEN 'u' THEN 3 ELSE 0 END, audit := v.audit || CASE st WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END,
  kept := v.kept || CASE st WHEN 's' THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 'u' THEN 'assistant:' || chr(10) ELSE '' END)) AS v
  FROM p JOIN g ON p.conv_id IS NOT DISTINCT FROM g.conv_id AND p.i = g.rows GROUP BY p.conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
coalesce(v.cost, 0) AS cost, coalesce(v.audit, '') AS audit, sha256(CASE WHEN v.kept <> '' THEN left(v.kept, len(v.kept) - 1) ELSE '' END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN g ON d.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN e ON d.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def urls(rules: list, steps: int = 140) -> str:
    """The URL query: rules by length, then so many steps of PageRank of both kinds over host links, which is to the limit of doubles."""
    from fjordframe.llm.urlfilter import DAMPING, THRESHOLD

    order = sorted(rules, key=lambda r: -len(r.text))
    fits = lambda r: f"(host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}')"
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in order)
    verdict = " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in order)
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return rf"""
WITH RECURSIVE p AS (SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {lower}), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (SELECT page_id, html, host, path, CASE {rule} END AS rule FROM p),
k AS (SELECT *, CASE rule {verdict} END AS v FROM j),
s AS MATERIALIZED (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS share FROM (SELECT CASE v WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM k WHERE v IS NOT NULL AND host <> '' GROUP BY ALL)),
l AS (SELECT DISTINCT src, dst FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s<>]+)', 1)), {lower}) AS dst FROM p WHERE host <> '') WHERE src <> dst),
e AS (SELECT 'trust' AS kind, src, dst FROM l UNION ALL SELECT 'distrust', dst, src FROM l),
w AS MATERIALIZED (SELECT *, 1.0 / count(*) OVER (PARTITION BY kind, src) AS part FROM e),
r AS (SELECT 0 AS step, kind, host, share::DOUBLE AS rank FROM s
  UNION ALL SELECT step, kind, host, sum(rank) FROM (
    SELECT r.step + 1 AS step, w.kind, w.dst AS host, {DAMPING} * r.rank * w.part AS rank FROM r JOIN w ON r.kind = w.kind AND r.host = w.src WHERE r.step < {steps}
    UNION ALL SELECT g.step, s.kind, s.host, s.share * (1 - g.t) FROM s JOIN (
      SELECT r.step + 1 AS step, r.kind, {DAMPING} * sum(CASE WHEN o.src IS NULL THEN 0 ELSE r.rank END) AS t FROM r LEFT JOIN (SELECT DISTINCT kind, src FROM w) o ON r.kind = o.kind AND r.host = o.src WHERE r.step < {steps} GROUP BY 1, 2) g ON s.kind = g.kind) GROUP BY ALL),
h AS (SELECT host, coalesce(sum(rank) FILTER (WHERE kind = 'trust'), 0) AS t, coalesce(sum(rank) FILTER (WHERE kind = 'distrust'), 0) AS d FROM r WHERE step = {steps} GROUP BY host)
SELECT page_id, k.host, path, rule, coalesce(v, CASE WHEN coalesce(d, 0) > {THRESHOLD} * (coalesce(t, 0) + coalesce(d, 0)) THEN 'block' ELSE 'allow' END) AS verdict FROM k LEFT JOIN h ON k.host = h.host"""
