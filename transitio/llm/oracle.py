"""Independent DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH RECURSIVE t AS (
  SELECT md5(text) AS tk, min(doc_id) AS low,
         any_value(list_filter(string_split_regex(lower(text), '[\t\n\f\r ]+'), lambda x: x <> '')) AS w
  FROM documents WHERE text IS NOT NULL GROUP BY 1),
s AS (
  SELECT tk, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS sh
  FROM t WHERE len(w) > 0),
bag AS (SELECT tk, sh, count(*) AS c FROM s GROUP BY ALL),
total AS (SELECT tk, sum(c) AS n FROM bag GROUP BY 1),
inter AS (SELECT a.tk AS a, b.tk AS b, sum(least(a.c, b.c)) AS i
  FROM bag a JOIN bag b ON a.sh = b.sh AND a.tk < b.tk GROUP BY ALL),
link AS (SELECT a, b FROM inter JOIN total x ON x.tk = a JOIN total y ON y.tk = b
  WHERE i * 5 >= 4 * (x.n + y.n - i)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link UNION SELECT tk, tk FROM t),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
cls AS (SELECT r.a AS tk, min(t.low) AS class_id FROM reach r JOIN t ON t.tk = r.b GROUP BY 1)
SELECT d.doc_id, CASE WHEN len(t.w) > 0 THEN class_id ELSE d.doc_id END AS class_id,
       d.doc_id = CASE WHEN len(t.w) > 0 THEN class_id ELSE d.doc_id END AS kept
FROM documents d LEFT JOIN t ON t.tk = md5(d.text) LEFT JOIN cls ON cls.tk = t.tk
"""


OP2 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL
    AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON comp.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

OP9 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER w AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 10
"""


def _programme(k: int) -> str:
    out = ["d1 AS MATERIALIZED (SELECT j, len * c AS cost, 0 AS prev FROM g)"]
    for i in range(2, k + 1):
        out.append(f"""d{i} AS MATERIALIZED (SELECT j, min(cost) AS cost, min_by(i, (cost, i)) AS prev FROM (
          SELECT b.j, a.j AS i, a.cost + b.len * (b.c - p.c) AS cost FROM g b JOIN d{i - 1} a ON a.j < b.j
          JOIN g p ON p.j = a.j) GROUP BY j)""")
    every = " UNION ALL ".join(f"SELECT {i} AS k, j, prev FROM d{i}" for i in range(1, k + 1))
    return ",\n".join(out) + f",\nd AS ({every})"


OP4 = f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(doc_id::VARCHAR, md5(text), '') AS key,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\t\n\f\r ]+'), lambda x: x <> '')) AS n FROM documents),
c AS (SELECT doc_id, key, n, unnest(range(greatest(ceil(n / 2048)::BIGINT, 1))) AS piece FROM t),
p AS (SELECT doc_id, piece, piece * 2048 AS start, least(2048, n - piece * 2048) AS n_tokens,
    md5('pack:' || key || ':' || piece) AS h FROM c),
g AS MATERIALIZED (SELECT row_number() OVER (ORDER BY len) AS j, len, (sum(m) OVER (ORDER BY len))::BIGINT AS c
  FROM (SELECT n_tokens AS len, count(*) AS m FROM p GROUP BY 1)),
{_programme(8)},
walk(k, j) AS (SELECT least(8, max(j)), max(j) FROM g UNION ALL
  SELECT w.k - 1, d.prev FROM walk w JOIN d ON d.k = w.k AND d.j = w.j WHERE w.k > 1),
ends AS (SELECT len AS padded_len, row_number() OVER (ORDER BY len) - 1 AS bucket FROM walk JOIN g USING (j)),
b AS (SELECT p.*, (SELECT min(padded_len) FROM ends WHERE padded_len >= n_tokens) AS padded_len FROM p),
r AS (SELECT b.*, ends.bucket, row_number() OVER (PARTITION BY ends.bucket ORDER BY h, piece) - 1 AS pos,
    greatest(1, 16384 // greatest(b.padded_len, 1)) AS per FROM b JOIN ends USING (padded_len))
SELECT doc_id, piece, start, n_tokens, bucket, padded_len, pos // per AS batch, pos % per AS slot FROM r
"""

OP10 = """
WITH RECURSIVE m AS (SELECT source, coalesce(sum(length(text)), 0)::DOUBLE AS mass FROM documents GROUP BY 1),
w AS (SELECT source, mass, CASE WHEN mass > 0 THEN pow(mass, 0.5) ELSE 0 END AS want FROM m),
r AS (SELECT source, CASE WHEN mass > 0 THEN want / (SELECT sum(want) FROM w) * (SELECT sum(mass) FROM w) / mass
  ELSE 1.0 END AS rate FROM w),
q AS (SELECT source, greatest(1, ceil(rate / 32))::INT AS parts, rate / greatest(1, ceil(rate / 32)) AS mean FROM r),
k(source, mean, k, p, c) AS (SELECT source, mean, 0, exp(-mean), exp(-mean) FROM q UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM k
  WHERE k < floor(mean + 12 * sqrt(mean) + 20)),
cdf AS (SELECT source, list(c ORDER BY k) AS cdf FROM k GROUP BY 1),
d AS (SELECT documents.*, coalesce(doc_id::VARCHAR, md5(text), '') AS id, parts, cdf FROM documents
  JOIN q ON q.source IS NOT DISTINCT FROM documents.source JOIN cdf ON cdf.source IS NOT DISTINCT FROM documents.source),
n AS (SELECT *, list_sum(list_transform(range(parts), lambda j: len(list_filter(cdf, lambda c: c <=
  ('0x' || substr(md5('mix:' || id || ':' || j), 1, 13))::BIGINT / 4503599627370496::DOUBLE))))::BIGINT AS n FROM d),
e AS (SELECT *, unnest(range(1, n + 1)) AS copy FROM n WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, copy, md5('mix#' || id || '#' || copy) AS mix_key FROM e
"""


def _rounds(n: int) -> str:
    out = ["x0 AS (SELECT kind, host, seed, seed AS x FROM seeds)"]
    for i in range(n):
        out.append(f"""x{i + 1} AS MATERIALIZED (SELECT s.kind, s.host, s.seed,
          s.seed * (1 - 0.85::DOUBLE) + coalesce(g.got, 0) * 0.85::DOUBLE AS x FROM seeds s LEFT JOIN (
            SELECT e.kind, e.dst AS host, sum(x.x * e.w) AS got FROM links e JOIN x{i} x
            ON x.kind = e.kind AND x.host = e.src GROUP BY ALL) g ON g.kind = s.kind AND g.host = s.host)""")
    return ",\n".join(out)


OP6 = rf"""
WITH u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(kind, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'),
  ('block', 'net/es/'), ('block', 'net/fr/')),
r AS (SELECT kind, rule, split_part(rule, '/', 1) AS rh, substr(rule, strpos(rule, '/')) AS rp FROM rules),
j AS (SELECT p.*, (SELECT max_by(rule, length(rule)) FROM r
    WHERE (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)) AS rule FROM p),
judged AS (SELECT j.*, r.kind AS ruled FROM j LEFT JOIN r USING (rule)),
edges AS (SELECT src, dst, count(*) AS n FROM (
    SELECT host AS src, host AS dst FROM judged WHERE host <> '' UNION ALL
    SELECT host, translate(unnest(regexp_extract_all(html,
      '[Hh][Rr][Ee][Ff]\s*=\s*["'']?(?:[Hh][Tt][Tt][Pp][Ss]?:)?//([^/?#"''\s>]+)', 1)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM judged WHERE host <> '') GROUP BY ALL),
links AS MATERIALIZED (SELECT 'trust' AS kind, src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM edges UNION ALL
  SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY src) FROM edges),
hosts AS (SELECT src AS host FROM edges UNION SELECT dst FROM edges),
share AS (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS t,
  avg(CASE WHEN ruled = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS d FROM judged WHERE host <> '' GROUP BY 1),
seeds AS MATERIALIZED (SELECT 'trust' AS kind, host, coalesce(t, 0) AS seed FROM hosts LEFT JOIN share USING (host)
  UNION ALL SELECT 'distrust', host, coalesce(d, 0) FROM hosts LEFT JOIN share USING (host)),
{_rounds(10)},
scores AS (SELECT host, round(max(greatest(seed, x)) FILTER (kind = 'trust'), 6) AS trust,
  round(max(greatest(seed, x)) FILTER (kind = 'distrust'), 6) AS distrust FROM x10 GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust >= 0.5 AND distrust > trust THEN 'block'
  ELSE 'allow' END) AS verdict, trust, distrust FROM judged LEFT JOIN scores USING (host)
"""

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(no: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
  SELECT tk, {no} AS no, '{kind}' AS kind, p AS start, p + length(h[i]) AS stop, v[i] AS value FROM (
    SELECT tk, h, v, i, coalesce(list_sum(list_transform(q[1:i], lambda x: length(x))), 0)
           + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS p
    FROM (SELECT tk, h, v, q, unnest(range(1, len(h) + 1)) AS i FROM (
      SELECT tk, regexp_extract_all(text, '{pattern}', 0) AS h, regexp_extract_all(text, '{pattern}', {group}) AS v,
             string_split_regex(text, '{pattern}') AS q FROM t)))
  WHERE length(v[i]) >= {least}"""


OP7 = f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, md5(coalesce(text, '')) AS tk FROM documents),
t AS (SELECT tk, any_value(text) AS text FROM d GROUP BY 1),
base AS ({_matches(0, "assign", _ASSIGN, 2, 6)} UNION ALL {_matches(1, "access", "AKIA[A-Z0-9]+", 0, 20)}
  UNION ALL {_matches(2, "hex", "[0-9a-f]+", 0, 24)}),
run AS ({_matches(3, "copy", "[A-Za-z0-9+/_.=-]{6,}", 0, 6)} UNION {_matches(3, "copy", "[A-Za-z0-9+/_.-]+=*", 0, 6)}),
token AS (SELECT DISTINCT * REPLACE (rtrim(value, '.') AS value, start + length(rtrim(value, '.')) AS stop) FROM run),
bare AS (SELECT * FROM token c WHERE length(value) >= 6 AND value IN (SELECT rtrim(value, '.') FROM base)
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.tk = c.tk AND b.start < c.stop AND c.start < b.stop)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
owners AS (SELECT rtrim(value, '.') AS same, count(DISTINCT coalesce(source, chr(30))) AS n_owners
  FROM every JOIN d USING (tk) GROUP BY 1),
found AS (SELECT every.*, CASE WHEN n_owners >= 3 THEN 'example'
    WHEN len(list_distinct(string_split(value, ''))) >= 8 AND regexp_matches(value, '[0-9]') THEN 'live'
    ELSE 'plain' END AS verdict FROM every JOIN owners ON rtrim(value, '.') = same),
per AS (SELECT tk, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access,
    count(*) FILTER (no = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no, stop) FILTER (no < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no, stop) AS spans,
    count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example
  FROM found GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN per USING (tk)
"""

ORACLE: dict[str, str] = {
    "op1_bagminhash": OP1,
    "op2_int8_pairs": OP2,
    "op4_length_buckets": OP4,
    "op6_link_trust": OP6,
    "op7_secret_owners": OP7,
    "op9_histogram_topk": OP9,
    "op10_poisson_mix": OP10,
}


ORACLE["op11_filter_audit"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first
  FROM texts
), marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id
), facts AS (
  SELECT part, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
                'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
                'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(words.doc_id > first, false)} AS f,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM words LEFT JOIN marks ON words.doc_id = marks.doc_id
), cells AS (
  SELECT part, concat(CASE WHEN f.A THEN 'A' ELSE '' END, CASE WHEN f.B THEN 'B' ELSE '' END, CASE WHEN f.C THEN 'C' ELSE '' END,
                      CASE WHEN f.D THEN 'D' ELSE '' END, CASE WHEN f.E THEN 'E' ELSE '' END) AS fails,
         good, toxic, count(*) AS n
  FROM facts GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT concat(a.l, b.l, c.l, d.l, e.l) AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, s::INT AS step, substr(filter_order, s, 1) AS letter, substr(filter_order, 1, s - 1) AS before
  FROM orders, generate_series(1, 5) AS g(s)
), judged AS (
  SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS hit, fails = letter AS only_this,
         len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND fails <> '' AND before <> '' AS gone
  FROM cells, steps
), audit AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (only_this), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (NOT gone AND hit AND good), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (NOT gone AND hit AND toxic), 0)::BIGINT AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM audit
"""


ORACLE["op13_conv_trie"] = r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(text, '') AS x,
         sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS d, turn
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT c, x, d, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) AS pos FROM turns
), convs AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda v: ascii(v)::BIGINT)),
      lambda acc, v: list_reduce(list_concat([xor(acc, v)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
          lambda r, z: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM placed)
), rebuilt AS (
  SELECT convs.c, 0 AS own, pos, d, x FROM convs JOIN placed ON placed.c = base WHERE pos <= h
  UNION ALL
  SELECT convs.c, 1 AS own, pos, d, x FROM convs JOIN placed ON placed.c = convs.c WHERE pos > h
), seqs AS (
  SELECT convs.c, coalesce(list(d ORDER BY own, pos) FILTER (d IS NOT NULL), []) AS ds,
         coalesce(list(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) ORDER BY own, pos) FILTER (d IS NOT NULL), []) AS ws
  FROM convs LEFT JOIN rebuilt ON rebuilt.c = convs.c GROUP BY convs.c
), members AS (
  SELECT c, k AS depth, ds[1:k] AS p, CASE WHEN k = 0 THEN 0 ELSE ws[k] END AS w, k = len(ds) AS ends
  FROM seqs, generate_series(0, (SELECT max(len(ds)) FROM seqs)) AS g(k) WHERE k <= len(ds)
), nodes AS (
  SELECT p, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(w) AS saving,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY p, depth
), kids AS (
  SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), whole AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.p = nodes.p
), above AS (
  SELECT p[1:k] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saving) AS saved
  FROM whole, generate_series(0, (SELECT max(depth) FROM whole)) AS g(k) WHERE k <= depth GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
       above.n_leaves::BIGINT AS n_leaves, above.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM whole n JOIN above ON above.p = n.p LEFT JOIN nodes u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.p = n.p[1:n.depth - 1]
"""
