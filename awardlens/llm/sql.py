"""The same as the queries, in SQL for DuckDB, where SQL can say it."""

from __future__ import annotations

from . import licenses, mixing

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP10 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOW}, {_WORDS}) AS ws FROM documents),
b AS (SELECT row_number() OVER () AS it, coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOW}, {_WORDS}) AS ws FROM benchmark),
win AS MATERIALIZED (SELECT it, item, p, least(len(ws), 10) AS m, array_to_string(ws[p:p + 9], ' ') AS g FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) x(p) WHERE len(ws) > 0),
pos AS (SELECT doc_id, i, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM d, (SELECT DISTINCT m FROM win) l, unnest(range(1, len(ws) - m + 2)) x(i)),
hit AS MATERIALIZED (SELECT doc_id, i, win.m, it, item, p FROM pos JOIN win ON pos.m = win.m AND pos.g = win.g),
cov AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1),
run AS (SELECT doc_id, max(n) AS n FROM (
  SELECT doc_id, count(*) + max(m) - 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, it, i - p ORDER BY i) AS run FROM hit) GROUP BY doc_id, it, i - p, run) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, cov.n IS NOT NULL AS contaminated, coalesce(run.n, 0)::BIGINT AS longest
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN its ON d.doc_id = its.doc_id LEFT JOIN run ON d.doc_id = run.doc_id
"""

OP8 = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array({_LOW}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) x(i) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM sh p JOIN sh q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2) pairs
    JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1
"""


def _templates() -> str:
    return ", ".join(f"('{name}', [{', '.join(repr(g) for g in licenses.bigrams(text))}])" for name, text in sorted(licenses.TEMPLATES.items()))


OP5 = rf"""
WITH t(name, grams) AS (VALUES {_templates()}),
plain AS (SELECT doc_id, regexp_replace({_LOW}, '[^a-z0-9\n]+', ' ', 'g') AS p FROM documents),
units AS (SELECT doc_id, unnest(list_distinct(list_transform(list_concat(string_split(p, chr(10)), string_split_regex(p, '\n *\n'), [p]), lambda u: trim(regexp_replace(u, '[ \n]+', ' ', 'g'), ' ')))) AS u FROM plain),
grams AS (SELECT doc_id, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own FROM (SELECT doc_id, u, string_split(u, ' ') AS w FROM units WHERE contains(u, ' '))),
dice AS (SELECT doc_id, u, name, 2.0::DOUBLE * len(list_intersect(own, grams.grams)) / (len(own) + len(grams.grams)) AS dice FROM (SELECT g.doc_id, g.u, g.own, t.name, t.grams FROM grams g, t) grams),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, u ORDER BY dice DESC, name) AS k FROM dice) WHERE k = 1 AND dice >= {licenses.THRESHOLD}),
top AS (SELECT doc_id, name, dice FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name) AS r FROM best) WHERE r = 1),
each AS (SELECT doc_id, count(*) AS n FROM best GROUP BY 1),
names AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS s FROM (SELECT DISTINCT doc_id, name FROM best) GROUP BY 1)
SELECT documents.doc_id, coalesce(each.n, 0)::BIGINT AS n_matches, top.name AS license, round(top.dice, 6) AS dice, coalesce(names.s, '') AS licenses
FROM documents LEFT JOIN each ON each.doc_id = documents.doc_id LEFT JOIN top ON top.doc_id = documents.doc_id LEFT JOIN names ON names.doc_id = documents.doc_id
"""


def _z(a: str) -> str:
    return f"list_sum(list_transform(p, lambda x: pow(x, {a})))"


def _entropy(a: str) -> str:
    return f"(ln({_z(a)}) - {a} * list_sum(list_transform(p, lambda x: pow(x, {a}) * ln(x))) / {_z(a)})"


OP2 = rf"""
WITH RECURSIVE u AS MATERIALIZED (
  SELECT source, unit, min(doc_id) AS doc_id, count(*) AS copies, sum(n)::BIGINT AS tokens FROM (
    SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS source, coalesce(doc_id::VARCHAR, '-') || '|' || coalesce(md5(text), '-') AS unit,
      len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')) AS n FROM documents) GROUP BY 1, 2),
src AS MATERIALIZED (SELECT source, sum(tokens)::BIGINT AS t FROM u GROUP BY 1),
sums AS MATERIALIZED (SELECT sum(t)::DOUBLE AS total, count(*) AS n, min(t) / sum(t)::DOUBLE AS least, max(t) / sum(t)::DOUBLE AS most FROM src WHERE t > 0),
shares AS MATERIALIZED (SELECT list(t / total) AS p FROM src, sums WHERE t > 0),
bis(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN {_entropy('mid')} >= {mixing.ENTROPY} * ln(n) THEN mid ELSE lo END, CASE WHEN {_entropy('mid')} >= {mixing.ENTROPY} * ln(n) THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid FROM bis WHERE i < {mixing.STEPS}) s, shares, sums),
two(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN pow(most / least, 1 - mid) > {mixing.REPEATS} THEN mid ELSE lo END, CASE WHEN pow(most / least, 1 - mid) > {mixing.REPEATS} THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid FROM two WHERE i < {mixing.STEPS}) s, sums),
first_ AS (SELECT CASE WHEN {_entropy('1.0')} >= {mixing.ENTROPY} * ln(n) THEN 1.0 ELSE (SELECT lo FROM bis WHERE i = {mixing.STEPS}) END AS a FROM shares, sums),
chosen AS MATERIALIZED (SELECT CASE WHEN pow(most / least, 1 - a) > {mixing.REPEATS} THEN (SELECT lo FROM two WHERE i = {mixing.STEPS}) + pow(2.0, -{mixing.STEPS}) ELSE a END AS a FROM first_, sums),
z AS MATERIALIZED (SELECT a, {_z('a')} AS z FROM chosen, shares),
w AS (SELECT source, t, CASE WHEN t > 0 THEN pow(t / total, a) / z ELSE 0 END AS weight, total * most / (pow(most, a) / z) AS size FROM src, sums, z),
plan AS MATERIALIZED (SELECT source, t, budget, quota, CASE WHEN t > 0 THEN budget // t ELSE 0 END AS whole FROM (
  SELECT source, t, CASE WHEN t > 0 THEN greatest(round(weight * size, 0)::BIGINT, 1) ELSE 0 END AS budget, greatest(round(weight * {mixing.BLOCK_TOKENS}, 0)::BIGINT, 1) AS quota FROM w)),
rows_ AS (SELECT u.*, t, budget, quota, whole, e AS epoch, md5('{mixing.SEED}|' || e || '|' || unit) AS h
  FROM u JOIN plan ON plan.source = u.source, unnest(range(0, CASE WHEN t > 0 THEN whole + (budget > whole * t)::BIGINT ELSE 1 END)) x(e)),
placed AS (SELECT *, (epoch * t + coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY h, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start,
  row_number() OVER (PARTITION BY source, epoch ORDER BY h, unit) - 1 AS nth FROM rows_),
kept AS (SELECT *, CASE WHEN t > 0 THEN start // quota ELSE nth // {mixing.BLOCK_ROWS} END AS block FROM placed WHERE epoch < whole OR start < budget OR t = 0)
SELECT doc_id, CASE WHEN source <> '-' THEN substring(source, 2) END AS source, epoch::BIGINT AS epoch, start, tokens, copies, block,
  row_number() OVER (PARTITION BY block ORDER BY md5('{mixing.SEED}b|' || epoch || '|' || source || '|' || unit), source, unit, epoch) AS position FROM kept
"""

ORACLE_SQL = {"op2_mixing": OP2, "op5_licenses": OP5, "op8_jaccard": OP8, "op10_decontamination": OP10}
