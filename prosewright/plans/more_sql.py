"""SQL twins of the queries in `more`."""

from __future__ import annotations

from prosewright.functions.labels import CATEGORIES, CATEGORY_OVERRIDES, DETECTOR_CATEGORY, DETECTOR_SUB_TYPE, SEMANTIC_LABELS
from prosewright.operators.filters import GENERATED
from prosewright.operators.sampling import INJECTION
from prosewright.plans import feature_sql as fs
from prosewright.plans.more import DROP_SOURCES, LICENCES, PROSE_SOURCES, SUBS
from prosewright.plans.oracle import _EVAL, _FLAGS, _H, _LONG, _PUNCT, HOLDS, cat_of, cn, ratio, tier1

_GOLD = f"g AS (SELECT row_id, text, model, {cn('category')} AS category, {cn('sub_type')} AS sub_type, {cn('source')} AS source FROM golden_train)"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(map(fs.q, values)) + ")"


def _case(x: str, table: dict[str, str], default: str) -> str:
    return f"CASE {' '.join(f'WHEN {x} = {fs.q(k)} THEN {fs.q(v)}' for k, v in table.items())} ELSE {default} END"


_FULL_LINES = f"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{fs.WSC}]'))"
_GENERATED = "(?i)" + "|".join(GENERATED)
#: u(vec_id, i, sub, cat, x): eight scores of each vector.
_SCORES = f"u AS (SELECT vec_id, unnest(range(0, 8)) AS i, unnest([{', '.join(map(fs.q, SUBS))}]) AS sub, unnest(CAST(embedding[1:8] AS DOUBLE[])) AS x FROM embeddings), z AS (SELECT *, 1 / (1 + exp(-x)) AS s, {cat_of('sub')} AS cat FROM u)"
#: k(row_id, label, src, annotator, flag), as in more._votes_of_flags.
_VOTES = f"""b AS (SELECT row_id, coalesce(max(CAST(tier1_agrees AS INT)), 0) AS a, coalesce(max(CAST(tier2_agrees AS INT)), 0) AS b FROM voting_log GROUP BY 1), n AS (SELECT unnest([{', '.join(map(fs.q, SEMANTIC_LABELS))}]) AS label),
    k AS (SELECT row_id, label, [{', '.join(map(fs.q, SEMANTIC_LABELS))}][row_id % 3 + 1] AS src, a + b + 1 AS ones FROM b, n)"""
_RECALL = "rc AS (SELECT label, avg(CAST(ones >= 2 AS INT)) FILTER (WHERE src = label) AS recall FROM k GROUP BY 1)"
_AGREEMENT = "ag AS (SELECT label, avg(greatest(ones, 3 - ones) / 3.0::DOUBLE) AS mean_agreement FROM k GROUP BY 1)"
_LAST = "row_number() OVER (PARTITION BY row_id ORDER BY voted_at DESC, received_at DESC, vote_id DESC)"

_EMPTY = "nullif(text, '')"

SQL: dict[str, str] = {
    "json_lines_read": "SELECT sample_id, text, split FROM eval_samples",
    "json_lines_gzip": "SELECT sample_id, text, split FROM eval_samples",
    "json_lines_tolerant": "SELECT split, count(*) AS n, min(sample_id) AS least FROM (SELECT sample_id, split FROM eval_samples UNION ALL SELECT sample_id, split FROM eval_samples UNION ALL SELECT -1, NULL) GROUP BY 1",
    "json_lines_classified": "SELECT sample_id, split, CAST(length(text) AS INT) AS chars FROM eval_samples",
    "csv_read": f"SELECT item_id, {_EMPTY} AS text, split FROM holdout_items",
    "parquet_renamed": "SELECT word AS token, freq_rank AS rank FROM wordlist",
    "first_available": "SELECT lang, count(*) AS n FROM wordlist GROUP BY 1",
    "parquet_appended": "SELECT lang, count(*) AS n, count(r) AS ranked FROM (SELECT lang, freq_rank AS r FROM wordlist WHERE lang = 'de' OR lang = 'xx' UNION ALL SELECT 'xx', NULL FROM wordlist) GROUP BY 1",
    "union_frames": f"SELECT label, split, count(*) AS n FROM (SELECT {cn('category')} AS label, NULL AS split FROM golden_train UNION ALL SELECT NULL, split FROM eval_samples) GROUP BY 1, 2",
    "line_errors": "SELECT CAST(n AS INT) AS line_number, CASE WHEN item_id % 7 = 0 THEN 'invalid JSON' ELSE 'sample failed schema validation' END AS error FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS n FROM holdout_items) WHERE item_id % 7 = 0 OR item_id % 5 = 0",
    "feature_csv": "SELECT round(CAST(format('{:.4f}', alpha_ratio::DOUBLE) AS DOUBLE), 1) AS alpha, count(*) AS n, round(max(CAST(format('{:.4f}', symbol_ratio::DOUBLE) AS DOUBLE)), 4) AS most FROM (SELECT * FROM feature_vector WHERE alpha_ratio IS NOT NULL AND symbol_ratio IS NOT NULL AND CAST(alpha_ratio AS VARCHAR) <> 'nan' AND CAST(symbol_ratio AS VARCHAR) <> 'nan') GROUP BY 1",
    "filter_route": tier1("(SELECT sample_id, text AS x FROM eval_samples UNION ALL SELECT -sample_id, prompt_template FROM eval_samples)", "sample_id", "x")
    + """, m AS (SELECT sample_id AS id, sample_id AS k, text AS x FROM eval_samples UNION ALL SELECT sample_id, -sample_id, prompt_template FROM eval_samples),
      j AS (SELECT id, x, x IS NOT NULL AND (strlen(x) < 50 OR category = 'prose' OR CAST(confidence AS FLOAT) < CAST(0.6 AS FLOAT)) AS ok FROM m JOIN tc USING (k))
      SELECT id AS sample_id, CASE WHEN bool_or(ok) THEN 'prose' ELSE 'skipped' END AS route, CAST(count(x) AS INT) AS n_fields FROM j GROUP BY 1""",
    "quality_filter": rf"""SELECT row_id, coalesce(len({_FULL_LINES}) >= 5 AND len(string_split(text, chr(10))) <= 500 AND NOT coalesce(regexp_matches({fs.trim(f'({_FULL_LINES})[1]')}, {fs.q(_GENERATED)}), false)
      AND len(regexp_extract_all(regexp_replace(text, '[ \n\r\t]', '', 'g'), '[\p{{C}}\p{{Z}}]')) / CAST(greatest(length(text), 1) AS DOUBLE) <= 0.10, false) AS quality_ok FROM golden_train""",
    "content_filters": f"""WITH {_GOLD} SELECT row_id, {' OR '.join(f"contains(upper(coalesce(source, '')), {fs.q(k)}) OR contains(upper(left(coalesce(text, ''), 500)), {fs.q(k)})" for k in LICENCES)} AS licence_ok,
      {_case('sub_type', CATEGORY_OVERRIDES, 'category')} AS category, {_case('sub_type', {x: c for c, xs in DETECTOR_CATEGORY.items() for x in xs}, "'unknown'")} AS detector, CAST(coalesce(nullif(list_position([{', '.join(map(fs.q, CATEGORIES))}], category), 0) - 1, 3) AS INT) AS place FROM g""",
    "clear_boundary": "SELECT sample_id, CASE WHEN boundary_pair IS NULL THEN 'clear' ELSE 'boundary' END AS side FROM eval_samples",
    "label_columns": f"SELECT source, length_bucket, coalesce(expected_category, {cn('sub_type')}) AS predicted_category, count(*) AS n FROM eval_samples GROUP BY ALL",
    "validate_json": f"WITH t AS (SELECT row_id, text, list_filter(string_split({fs.trim('text')}, chr(10)), lambda x: regexp_matches(x, '[^{fs.WSC}]')) AS l FROM golden_train WHERE text IS NOT NULL) SELECT row_id, json_valid(text) AS is_json, len(l) >= 2 AND len(list_filter(l[1:20], lambda x: json_valid(x))) = len(l[1:20]) AS is_jsonl FROM t",
    "json_texts": "SELECT vote_id, vote_id % 4 = 0 AS is_json, vote_id % 4 = 1 AS is_jsonl FROM voting_log",
    "delimited_texts": "SELECT DISTINCT word, lang, length(word) % 5 <> 0 AS is_csv, length(word) % 5 <> 0 AS is_tsv, false AS other FROM wordlist WHERE word IS NOT NULL AND lang IS NOT NULL",
    "reclassify_artifacts": f"""WITH {_GOLD}, {fs.prep("(SELECT row_id, replace(text, '\\n', '\\ n') AS x FROM g WHERE category IN ('artifact', 'skip') AND text IS NOT NULL)", "row_id", "x").removeprefix("WITH ")},
      f AS (SELECT k, {', '.join(f"CAST(CAST(CASE WHEN r = '' THEN 0.0 ELSE {fs.SQL[n]} END AS FLOAT) AS DOUBLE) AS {n}" for n in ('sentence_coherence_score', 'alpha_ratio', 'key_value_ratio', 'comment_ratio', 'delimiter_consistency'))},
        list_filter(list_transform(w, lambda x: regexp_replace(lower(x), '^[{_PUNCT}]+|[{_PUNCT}]+$', '', 'g')), lambda x: x <> '') AS tok FROM p),
      h AS (SELECT *, CASE WHEN len(tok) = 0 THEN 0 ELSE CAST(CAST(len(list_filter(tok, lambda x: x IN ('the', 'and', 'of', 'was'))) / CAST(len(tok) AS DOUBLE) AS FLOAT) AS DOUBLE) END AS dic FROM f)
      SELECT k AS row_id, CASE WHEN sentence_coherence_score > 0.3 AND dic > 0.5 THEN 'prose' WHEN key_value_ratio > 0.3 OR delimiter_consistency > 0.5 THEN 'structured' WHEN comment_ratio > 0.2 THEN 'code' WHEN dic > 0.5 AND alpha_ratio > 0.8 THEN 'prose' ELSE 'structured' END AS reclassified FROM h""",
    "cosine_dedup": """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), n AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS z FROM e),
      d AS (SELECT a.vec_id, b.vec_id AS nn, 1 - list_dot_product(a.x, b.x) / (a.z * b.z) AS d FROM n a JOIN n b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), nn) AS k FROM d),
      m AS MATERIALIZED (SELECT vec_id, nn, d, row_number() OVER (ORDER BY vec_id) AS i FROM r WHERE k = 1),
      s AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS gone UNION ALL SELECT m.i, CASE WHEN d < 0.7 AND NOT list_contains(gone, vec_id) THEN list_append(gone, greatest(vec_id, nn)) ELSE gone END FROM s JOIN m ON m.i = s.i + 1)
      SELECT vec_id FROM m WHERE NOT list_contains((SELECT gone FROM s ORDER BY i DESC LIMIT 1), vec_id)""",
    "standard_scores": "WITH e AS (SELECT vec_id, CAST(embedding[1:8] AS DOUBLE[]) AS x FROM embeddings) SELECT vec_id, round((x[1] - 0.1) / 2, 6) AS z0, CAST(0 AS DOUBLE) AS z1, round((x[3] + 0.1) / 0.5, 6) AS z2, CAST(8 - list_position(list_reverse(x), list_max(x)) AS INT) AS top, round(1 / (1 + exp(-x[1])), 6) AS s0 FROM e",
    "detections": f"WITH {_SCORES} SELECT vec_id, cat AS category, CAST(row_number() OVER (PARTITION BY vec_id, cat ORDER BY s DESC, i) - 1 AS INT) AS place, sub AS sub_type, round(s, 6) AS score FROM z WHERE s >= 0.55",
    "score_filter": f"WITH {_SCORES} SELECT vec_id, cat AS category, CAST(count(*) AS INT) AS n FROM z WHERE s >= 0.6 GROUP BY 1, 2",
    "reply_flags": "SELECT vote_id, CAST(coalesce(tier1_agrees, false) AS INT) AS log_content, CAST(coalesce(tier2_agrees, false) AS INT) AS stack_trace, 0 AS diff_patch FROM voting_log",
    "reply_arrays": "SELECT event_id, CAST([2, 1, 1, 0][event_id % 4 + 1] AS INT) AS items FROM events",
    "text_pieces": """SELECT row_id, replace(left(text, 40), chr(10), '\\n') AS preview, 'Label ' || coalesce(sub_type, '') || ' of ' || row_id || ': ' || coalesce(sub_type, '') AS prompt,
      CASE WHEN c IN ('c_cpp', 'objc', 'prose', 'other') THEN CASE WHEN c = 'other' THEN 'unknown' ELSE c END WHEN contains(c, 'c_cpp') THEN 'c_cpp' WHEN contains(c, 'objc') THEN 'objc' WHEN contains(c, 'prose') THEN 'prose' ELSE 'unknown' END AS vote
      FROM (SELECT *, """
    + f"lower({fs.trim('coalesce(category, chr(32))')})"
    + " AS c FROM golden_train)",
    "voted_labels": f"""WITH {_GOLD}, r AS (SELECT row_id, CASE WHEN action = 'drop' THEN 'drop' ELSE {cn('new_sub_type')} END AS x, voted_at, received_at, vote_id FROM voting_log), l AS (SELECT row_id, x, {_LAST} AS k FROM r WHERE x IS NOT NULL OR true),
      v AS (SELECT row_id, CASE WHEN x = 'prose_plain' THEN 'prose' WHEN x = 'other' THEN 'unknown' ELSE x END AS v FROM l WHERE k = 1)
      SELECT row_id, CASE WHEN v IS NULL OR v IN ('manual_review', 'unknown') THEN category WHEN v IN ('c_cpp', 'objc') THEN 'code' WHEN v = 'prose' THEN 'prose' ELSE 'unknown' END AS category, CASE WHEN v IS NULL OR v IN ('manual_review', 'unknown') THEN sub_type WHEN v = 'prose' THEN 'plain' ELSE v END AS sub_type
      FROM g LEFT JOIN v USING (row_id) WHERE NOT coalesce(v = 'drop', false)""",
    "bulk_relabels": f"""WITH {_GOLD}, h AS (SELECT *, coalesce(sub_type = 'unknown', false) AS u FROM g) SELECT row_id, CASE WHEN u AND coalesce(source IN {_in(PROSE_SOURCES)}, false) THEN 'prose' ELSE category END AS category, CASE WHEN u AND coalesce(source IN {_in(PROSE_SOURCES)}, false) THEN 'plain' ELSE sub_type END AS sub_type
      FROM h WHERE NOT (u AND coalesce(source IN {_in(DROP_SOURCES)}, false))""",
    "flag_agreement": f"WITH {_FLAGS} SELECT row_id, coalesce(CASE sub " + " ".join(f"WHEN '{x}' THEN pred_{x} = 1" for x in ("python", "sql", "shell", "markdown", "yaml")) + " ELSE false END, false) AS agrees FROM fl",
    "ghost_sub_types": f"""WITH {_GOLD} SELECT row_id, CASE WHEN sub_type IN ('ocr_garbage', 'pdf_dump') THEN {_case('category', DETECTOR_SUB_TYPE, "CASE WHEN coalesce(starts_with(source, 'pull'), false) THEN 'plain' ELSE 'unknown' END")} ELSE sub_type END AS sub_type FROM g""",
    "corrected_votes": "SELECT CASE WHEN coalesce(tier2_agrees, false) THEN 'TIE' WHEN coalesce(tier1_agrees, false) THEN 'KEEP_LABEL' ELSE 'CORRECT' END AS verdict, count(*) AS n FROM voting_log GROUP BY 1",
    "last_corrections": f"SELECT row_id, arg_max({cn('new_sub_type')}, vote_id) AS corrected FROM voting_log WHERE new_sub_type IS NOT NULL AND NOT coalesce(tier1_agrees, false) GROUP BY 1",
    "disputed_labels": f"WITH {_EVAL} SELECT sample_id FROM ev WHERE truth IS NOT NULL AND pred IS NOT NULL AND pred <> 'unknown' AND pred <> truth AND coalesce(temperature, 0) >= 0.5",
    "second_tier": f"SELECT vote_id, CASE WHEN NOT tier1_agrees THEN CASE {cn('original_sub_type')} WHEN 'python' THEN 'one' WHEN 'sql' THEN 'two' WHEN 'plain' THEN 'default' END END AS annotator FROM voting_log",
    "stratified_rest": f"""WITH {_EVAL}, a AS (SELECT sample_id, truth, coalesce(model, '__none__') AS m, {_H.format('sample_id')} AS h FROM ev WHERE truth IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY truth, m ORDER BY h, sample_id) AS r FROM a),
      c AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY r, m, h, sample_id) AS k FROM b) SELECT sample_id, truth FROM c WHERE k > 25""",
    "uniform_sample": f"SELECT row_id FROM golden_train ORDER BY {_H.format('row_id')}, row_id LIMIT 300",
    "first_passing": f"WITH {_GOLD} SELECT row_id FROM g WHERE category = 'code' AND regexp_matches(text, '[^{fs.WSC}]') ORDER BY row_id LIMIT 40",
    "injected_samples": " UNION ALL ".join(f"(SELECT row_id, 'inject_{x}' AS audit_source FROM golden_train WHERE regexp_matches(text, {fs.q('|'.join(f'(?:{p})' for p in INJECTION[x]))}) ORDER BY {_H.format('row_id')}, row_id LIMIT 40)" for x in ("stack_trace", "diff_patch")),
    "grouped_validation": "SELECT 1 AS sides, true AS close",
    "plan_pull": f"""WITH {_GOLD}, p AS (SELECT {cn('name')} AS name, CAST(sum(greatest(coalesce(target_count, 0), 0)) AS BIGINT) AS target FROM (SELECT DISTINCT * FROM source_plan) WHERE name IS NOT NULL GROUP BY 1), n AS (SELECT source, count(*) AS n FROM g WHERE regexp_matches(text, '[^{fs.WSC}]') GROUP BY 1)
      SELECT name, target, least(target, coalesce(n, 0)) AS taken, target - least(target, coalesce(n, 0)) AS missing FROM p LEFT JOIN n ON name = source""",
    "plan_pull_rows": f"""WITH {_GOLD}, p AS (SELECT name, sum(t) AS t FROM (SELECT DISTINCT {cn('name')} AS name, target_count // 50 AS t, category, sub_type, synthetic, notes, max_repeat FROM source_plan) GROUP BY 1),
      r AS (SELECT row_id, source, row_number() OVER (PARTITION BY source ORDER BY {_H.format('row_id')}, row_id) AS k FROM g WHERE regexp_matches(text, '[^{fs.WSC}]')) SELECT row_id, source FROM r JOIN p ON name = source WHERE k <= t""",
    "vote_tally": f"WITH v AS (SELECT {cn('original_sub_type')} AS o, {cn('sub_type')} AS s, {cn('new_sub_type')} AS w FROM voting_log), m AS (SELECT CASE WHEN o = s AND s = w THEN 'unanimous' WHEN o = s OR o = w OR s = w THEN 'majority' ELSE 'tie' END AS method FROM v) SELECT method, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM m) AS DOUBLE), 6) AS share FROM m GROUP BY 1",
    "confusion_wide": f"WITH {_EVAL} SELECT truth AS actual, count(*) AS n, count(*) FILTER (WHERE pred = 'prose') AS prose, count(*) FILTER (WHERE pred = 'code') AS code, count(*) FILTER (WHERE pred = 'structured') AS structured FROM ev WHERE truth IN ('prose', 'code', 'structured') AND pred IS NOT NULL GROUP BY 1",
    "aligned_tables": f"SELECT row_id, {', '.join(f'{HOLDS[x]} AS {x}' for x in ('python', 'sql', 'shell'))} FROM (SELECT row_id, coalesce(text, '') AS t FROM golden_train WHERE sub_type IS NOT NULL)",
    "tier_counts": tier1("documents", "doc_id", "text") + " SELECT 'structural' AS tier, confidence >= 0.9 AS sure, count(*) AS n FROM tc GROUP BY 2",
    "injected_recall": f"WITH {_VOTES}, {_RECALL} SELECT label, round(recall, 6) AS recall FROM rc",
    "audit_gate": f"WITH {_VOTES}, {_RECALL}, {_AGREEMENT} SELECT label, mean_agreement >= 0.6 AND coalesce(recall >= 0.5, false) AS passes FROM rc JOIN ag USING (label)",
    "label_buckets": f"""WITH {_FLAGS}, {_LONG}, {_VOTES}, g AS (SELECT label, count(*) AS n, count(*) FILTER (WHERE p = 1) AS t, count(*) FILTER (WHERE p = 1 AND sub = label) AS self FROM lo GROUP BY 1), s AS (SELECT *, t / CAST(n AS DOUBLE) AS rate, t - self AS cf, {ratio('t - self', 't')} AS cr FROM g),
      a AS (SELECT CASE label WHEN 'log_content' THEN 'python' WHEN 'diff_patch' THEN 'sql' ELSE 'shell' END AS label, avg(greatest(ones, 3 - ones) / 3.0::DOUBLE) AS m FROM k GROUP BY 1)
      SELECT label, rate < 0.01 OR cf < 10 AS weak, NOT (rate < 0.01 OR cf < 10) AND cf >= 100 AS strong, coalesce(m < 0.9, false) AS low_agreement, rate < 0.02 AND t > 0 AND cr < 0.3 AS suspicious FROM s LEFT JOIN a USING (label)""",
    "heuristic_pass_rates": f"SELECT sub AS sub_type, count(*) AS n, count(*) FILTER (WHERE CASE sub " + " ".join(f"WHEN '{x}' THEN {HOLDS[x]}" for x in ("python", "sql", "shell", "yaml", "markdown", "pipe_table")) + f" END) AS passed FROM (SELECT text AS t, {cn('sub_type')} AS sub FROM golden_train WHERE text IS NOT NULL) WHERE sub IN ('python', 'sql', 'shell', 'yaml', 'markdown', 'pipe_table') GROUP BY 1",
    "feature_divergence": f"""{fs.prep('documents', 'doc_id')}, o AS (SELECT k, CAST(CAST(CASE WHEN r = '' THEN 0.0 ELSE {fs.SQL['alpha_ratio']} END AS FLOAT) AS DOUBLE) AS a, CAST(CAST(CASE WHEN r = '' THEN 0.0 ELSE {fs.SQL['sentence_punctuation_rate']} END AS FLOAT) AS DOUBLE) AS b FROM p),
      f AS (SELECT doc_id, alpha_ratio::DOUBLE AS a, sentence_punctuation_rate::DOUBLE AS b, row_number() OVER (PARTITION BY doc_id ORDER BY featurized_at DESC, alpha_ratio DESC, sentence_punctuation_rate DESC) AS n FROM feature_vector WHERE alpha_ratio IS NOT NULL AND sentence_punctuation_rate IS NOT NULL AND CAST(alpha_ratio AS VARCHAR) <> 'nan' AND CAST(sentence_punctuation_rate AS VARCHAR) <> 'nan'),
      j AS (SELECT 'alpha_ratio' AS feature, o.a AS x, f.a AS y FROM o JOIN f ON k = doc_id AND n = 1 UNION ALL SELECT 'sentence_punctuation_rate', o.b, f.b FROM o JOIN f ON k = doc_id AND n = 1)
      SELECT feature, round(avg(abs(x - y)), 6) AS mean_abs_error, round(max(abs(x - y)), 6) AS max_abs_error, round(avg(x), 6) AS mean_a, round(avg(y), 6) AS mean_b FROM j GROUP BY 1""",
}
