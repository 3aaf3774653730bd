"""SQL twins of this package's queries, where SQL can say it over whole tables. The others are tested against brute force in tests/llm."""

from __future__ import annotations

_WS = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _cn(x: str) -> str:
    return f"translate(lower(regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')), '-', '_')"


_FULL = f"regexp_matches(text, '[^{_WS}]')"
_KEY = "nullif(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '')"


def _tokens(table: str, key: str) -> str:
    """(id, tok, n): words of texts with at least 40, numbered where repeated."""
    w = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
    return f"SELECT id, w || '#' || row_number() OVER (PARTITION BY id, w) AS tok, n FROM (SELECT {key} AS id, unnest({w}) AS w, len({w}) AS n FROM {table} WHERE len({w}) >= 40)"


_NEAR = "HAVING 1.7 * count(*) >= 0.7 * (any_value(a.n) + any_value(b.n)) - 1e-6"

#: (item_id, k, g) and (doc_id, k, g): the words of every passage of 13, and the place of its first.
_GRAMS = """i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM holdout_items), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
      gi AS (SELECT item_id, k, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13)), gd AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13))"""

_N_WORDS = "len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))"
#: p: the plan's names; u: units of usable rows of each.
_MIX = f"""p AS (SELECT {_cn('name')} AS name, sum(target_count) AS t, min(CASE WHEN synthetic THEN 1 ELSE max_repeat END) AS r FROM (SELECT DISTINCT * FROM source_plan) GROUP BY 1),
      u AS (SELECT p.name, coalesce(sum(g.w), 0) AS n FROM p LEFT JOIN (SELECT @w AS w, {_cn('source')} AS s FROM golden_train WHERE {_FULL}) g ON g.s = p.name GROUP BY 1)"""
#: c: the plan's cells; u: usable rows of each.
_CELLS = f"""c AS (SELECT {_cn('category')} AS category, {_cn('sub_type')} AS sub_type, sum(target_count) AS t FROM (SELECT DISTINCT * FROM source_plan) GROUP BY 1, 2),
      u AS (SELECT c.category, c.sub_type, c.t, count(g.row_id) AS n FROM c LEFT JOIN (SELECT row_id, {_cn('category')} AS a, {_cn('sub_type')} AS b FROM golden_train WHERE {_FULL}) g ON g.a = c.category AND g.b = c.sub_type GROUP BY ALL)"""

SQL: dict[str, str] = {
    "p1_found": f"WITH t AS ({_tokens('golden_train', 'row_id')}) SELECT a.id AS row_id_a, b.id AS row_id_b FROM t a JOIN t b ON a.tok = b.tok AND a.id < b.id AND a.n <= 1.43 * b.n AND b.n <= 1.43 * a.n GROUP BY a.id, b.id {_NEAR}",
    "p5_found": f"WITH s AS ({_tokens('eval_samples', 'sample_id')}), t AS ({_tokens('golden_train', 'row_id')}) SELECT a.id AS sample_id, b.id AS row_id FROM s a JOIN t b ON a.tok = b.tok AND a.n <= 1.43 * b.n AND b.n <= 1.43 * a.n GROUP BY a.id, b.id {_NEAR}",
    "p2_found": f"""WITH {_MIX.replace('@w', '1')}
      SELECT name FROM u JOIN p USING (name) WHERE n * r < (SELECT sum(n) FROM u) * (t / CAST((SELECT sum(t) FROM p) AS DOUBLE))""",
    "p2_slots": f"""WITH {_MIX.replace('@w', _N_WORDS)}, x AS (SELECT name, n, r, (SELECT sum(n) FROM u) * (t / CAST((SELECT sum(t) FROM p) AS DOUBLE)) AS wanted, ceil(n / 1024.0) AS blocks FROM u JOIN p USING (name)),
      y AS (SELECT *, least(r, floor(wanted / n)) AS passes FROM x WHERE n > 0 AND wanted > 0)
      SELECT name, CAST(passes * blocks + CASE WHEN passes < r AND wanted > passes * n THEN least(blocks, ceil((wanted - passes * n) / 1024) + CASE WHEN n % 1024 > 0 THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS slots FROM y""",
    "p3_found": f"""WITH RECURSIVE k AS (SELECT sample_id AS id, {_KEY.format('prompt_template')} AS t, {_KEY.format("regexp_extract(regexp_replace(model, '(?s)^.*/', ''), '(?s)^[^:]*')")} AS m, {_KEY.format('content_domain')} AS d FROM eval_samples),
      e AS (SELECT id, 'm|' || t || '|' || m AS key FROM k WHERE t IS NOT NULL AND m IS NOT NULL UNION ALL SELECT id, 'd|' || t || '|' || d FROM k WHERE t IS NOT NULL AND d IS NOT NULL),
      l AS (SELECT DISTINCT a.id AS x, b.id AS y FROM e a JOIN e b USING (key)),
      r AS (SELECT id, id AS root FROM k UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.id WHERE r.root < l.y)
      SELECT min(root) AS first_id, id AS sample_id FROM r GROUP BY id HAVING min(root) < id""",
    "p4_found": f"WITH {_CELLS} SELECT category, sub_type FROM u WHERE n < (SELECT sum(n) FROM u) * 0.5 * (t / CAST((SELECT sum(t) FROM c) AS DOUBLE))",
    "p4_balance": f"""WITH {_CELLS}, x AS (SELECT *, (SELECT sum(n) FROM u) * 0.5 * (t / CAST((SELECT sum(t) FROM c) AS DOUBLE)) AS target FROM u)
      SELECT category, sub_type, n AS n_rows, round(target, 6) AS target, n < target AS short, true AS balanced FROM x""",
    "p9_found": f"WITH {_GRAMS} SELECT DISTINCT item_id, doc_id FROM gi JOIN gd USING (g)",
    "p9_items": f"""WITH {_GRAMS}, h AS (SELECT DISTINCT item_id, doc_id, gi.k AS a, gd.k - gi.k AS lane FROM gi JOIN gd USING (g)),
      r AS (SELECT item_id, doc_id, count(*) + 12 AS n FROM (SELECT *, a - row_number() OVER (PARTITION BY item_id, doc_id, lane ORDER BY a) AS run FROM h) GROUP BY item_id, doc_id, lane, run)
      SELECT item_id, split, content_domain, documents, longest FROM holdout_items JOIN (SELECT item_id, count(DISTINCT doc_id) AS documents, CAST(max(n) AS INT) AS longest FROM r GROUP BY 1) USING (item_id)""",
    "p1_groups": f"""WITH RECURSIVE t AS MATERIALIZED ({_tokens('golden_train', 'row_id')}), c AS MATERIALIZED (SELECT id, md5(string_agg(tok, ' ' ORDER BY tok)) AS cls FROM t GROUP BY 1),
      p AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.tok = b.tok AND a.id < b.id AND a.n <= 1.43 * b.n AND b.n <= 1.43 * a.n GROUP BY a.id, b.id {_NEAR}), l AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
      r AS (SELECT id, id AS root FROM c UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE r.root < l.b), n AS (SELECT l.a AS id, count(DISTINCT y.cls) AS k FROM l JOIN c x ON x.id = l.a JOIN c y ON y.id = l.b WHERE x.cls <> y.cls GROUP BY 1)
      SELECT c.id AS row_id, min(root) AS group_id, coalesce(any_value(k), 0) AS n_links FROM c JOIN r USING (id) LEFT JOIN n USING (id) GROUP BY 1""",
    "p3_totals": "SELECT s AS split, CAST(CASE WHEN s = 'train' THEN n - 2 * round(n * 0.1) ELSE round(n * 0.1) END AS BIGINT) AS n, 0 AS torn FROM (SELECT unnest(['train', 'validation', 'test']) AS s), (SELECT count(DISTINCT sample_id) AS n FROM eval_samples)",
    "p5_report": f"""WITH s AS ({_tokens('eval_samples', 'sample_id')}), t AS ({_tokens('golden_train', 'row_id')}), p AS (SELECT a.id AS sample_id, b.id AS row_id FROM s a JOIN t b ON a.tok = b.tok AND a.n <= 1.43 * b.n AND b.n <= 1.43 * a.n GROUP BY a.id, b.id {_NEAR})
      SELECT split, g.source, count(*) AS pairs, count(DISTINCT sample_id) AS eval_records, count(DISTINCT row_id) AS train_records FROM p JOIN eval_samples USING (sample_id) JOIN golden_train g USING (row_id) GROUP BY 1, 2""",
    "p7_stats": f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n'), lambda x: regexp_replace(x, '^[{_WS}]+|[{_WS}]+$', '', 'g')), lambda x: x <> '') AS l FROM documents)
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / CAST(greatest(len(w), 1) AS DOUBLE), 6) AS mean_word_length,
        round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?…。！？؟।][''"’”»)\\]]*$'))) / CAST(greatest(len(l), 1) AS DOUBLE), 6) AS line_end_ratio FROM w""",
}
