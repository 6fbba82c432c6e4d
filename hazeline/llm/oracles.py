"""DuckDB SQL of those queries that SQL can express on whole tables."""

from __future__ import annotations

from hazeline.llm import pii

NEAR_DEDUP = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3
    THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM cut),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
each AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y)
SELECT s.doc_id, CAST(n AS BIGINT) AS n_shingles, min(r.y) AS component_id, s.doc_id = min(r.y) AS kept
FROM sizes s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, n
"""

NEIGHBOURS = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (c.v[i] - q.v[i]) * (c.v[i] - q.v[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM near)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

# RE2 is linear and has no \G, so these are the patterns as they are meant.
RE2 = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
MOVED = "substr(replace(m, ' ', ''), 5) || left(replace(m, ' ', ''), 4)"
CHECKS = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0",
    "card": f"CASE WHEN len({DIGITS}) BETWEEN 12 AND 19 THEN list_sum(list_transform(range(1, len({DIGITS}) + 1), "
    f"lambda i: (CAST(substr(reverse({DIGITS}), i, 1) AS INTEGER) * (2 - i % 2)) // 10 + (CAST(substr(reverse({DIGITS}), i, 1) AS INTEGER) * (2 - i % 2)) % 10"
    ")) % 10 = 0 ELSE false END",
    "phone": f"len({DIGITS}) BETWEEN 9 AND 15",
    "iban": "NOT regexp_matches(before, '[A-Za-z0-9]$') AND NOT regexp_matches(after, '^[A-Za-z0-9]') AND "
    f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({MOVED}, ''), lambda c: "
    "CAST(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1 AS BIGINT))), lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1",
    "ssn": "NOT regexp_matches(before, '[0-9-]$') AND NOT regexp_matches(after, '^[0-9-]') "
    "AND regexp_matches(lower(before || ' ' || after), '(?:^|[^a-z])(?:ssn|social|security)') "
    "AND NOT regexp_matches(lower(before || ' ' || after), '(?:^|[^a-z])(?:order|version|invoice|isbn)')",
}


def spans_sql(kind: str) -> str:
    return f"""SELECT doc_id, {pii.KINDS.index(kind)} AS k, '{kind}' AS kind, first, first + length(m) AS last FROM (
      SELECT doc_id, ms[i] AS m, right(gaps[i], {pii.NEAR}) AS before, left(gaps[i + 1], {pii.NEAR}) AS after,
        CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS first
      FROM (SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, '{RE2[kind]}') AS ms, string_split_regex(text, '{RE2[kind]}') AS gaps FROM documents WHERE text IS NOT NULL
      ) WHERE len(ms) > 0)) WHERE {CHECKS[kind]}"""


PERSONAL = f"""
WITH spans AS ({" UNION ALL ".join(spans_sql(kind) for kind in pii.KINDS)}),
named AS (SELECT *, kind || ':' || first || ':' || last AS name FROM spans),
grouped AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in pii.BASE)},
    coalesce(string_agg(name, ',' ORDER BY first, k) FILTER (k < {len(pii.BASE)}), '') AS base, string_agg(name, ',' ORDER BY first, k) AS spans
  FROM named GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN grouped g ON g.doc_id = d.doc_id
"""

FILTERS = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marked AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
seen AS (SELECT *, coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, doc_id IS NULL AND min(doc_id) OVER (PARTITION BY t) IS NOT NULL) AS e FROM docs),
failed AS (
  SELECT part, CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
    + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS INTEGER)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(e AS INTEGER) AS mask,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM seen LEFT JOIN marked USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY 1, 2),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS earlier
  FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)),
counted AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (bit | earlier) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS removed, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM counted
"""

MIDDLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS hs FROM units),
cut AS (
  SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM parts),
split AS (SELECT *, string_split(o, CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS x FROM made),
back AS (
  SELECT *, CASE form WHEN 'plain' THEN o WHEN 'psm' THEN substr(x[1], 4) || string_split(x[2], '<M>')[2] || string_split(x[2], '<M>')[1]
    ELSE string_split(x[2], '<M>')[1] || string_split(x[2], '<M>')[2] || substr(x[1], 4) END AS r FROM split)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(o) AS output_sha256, sha256(r) AS restored_sha256 FROM back
"""

TOP_PRODUCTS = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: c.v[i] * q.v[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLES = {
    "op4_minmax_near_dedup": NEAR_DEDUP, "op6_block_matrix_neighbours": NEIGHBOURS, "op9_personal_data": PERSONAL,
    "op11_filter_audit": FILTERS, "op12_fill_in_middle": MIDDLE, "op13_threshold_top": TOP_PRODUCTS,
}
