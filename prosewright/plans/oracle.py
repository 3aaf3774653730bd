"""SQL twins of the core's queries, for the oracle."""

from __future__ import annotations

from prosewright.functions.labels import ALIASES, CATEGORY_OF, SUB_TYPES, VALID_SUB_TYPES
from prosewright.plans import feature_sql as fs
from prosewright.plans.catalogue import CHARS, FLAGS, LINES, SHAPES


def cn(x: str) -> str:
    return f"translate(lower({fs.trim(x)}), '-', '_')"


def cat_of(x: str) -> str:
    """Category of a sub-type; anything else is prose."""
    when = " ".join(f"WHEN {x} IN ({', '.join(map(fs.q, subs))}) THEN '{c}'" for c, subs in SUB_TYPES.items())
    return f"(CASE {when} ELSE 'prose' END)"


def f32(x: float) -> str:
    return f"CAST({x} AS FLOAT)"


def ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


_RULES = ["line_length_cv", "leading_whitespace_ratio", "tab_density", "sentence_punctuation_rate", "alpha_ratio", "symbol_ratio"]


def tier1(table: str, key: str, text: str, extra: str = "") -> str:
    """CTEs ending in tc(key, category, confidence)."""
    feats = ", ".join(f"CAST(CASE WHEN r = '' THEN 0.0 ELSE {fs.SQL[n]} END AS FLOAT) AS {n}" for n in _RULES)
    blank = f"NOT regexp_matches(r, '[^{fs.WSC}]')"
    short = f"len(list_filter(regexp_split_to_array(r, '[{fs.WSC}]+'), lambda x: x <> '')) < 5 AND length(r) < 20"
    rule = f"""CASE WHEN {blank} THEN 'prose|0.0' WHEN {short} THEN 'prose|0.5'
      WHEN alpha_ratio = 0 AND sentence_punctuation_rate = 0 THEN 'prose|0.0'
      WHEN lc >= 5 AND line_length_cv < {f32(0.15)} AND symbol_ratio < {f32(0.10)} AND (tab_density > {f32(0.03)} OR sentence_punctuation_rate < {f32(0.01)}) THEN 'structured|0.98'
      WHEN leading_whitespace_ratio > {f32(0.3)} AND symbol_ratio > {f32(0.08)} AND sentence_punctuation_rate < {f32(0.02)} THEN 'code|0.98'
      WHEN sentence_punctuation_rate > {f32(0.06)} AND alpha_ratio > {f32(0.85)} AND symbol_ratio < {f32(0.03)} AND leading_whitespace_ratio < {f32(0.1)} THEN 'prose|0.95'
      ELSE 'prose|0.4' END"""
    return f"""{fs.prep(table, key, text)}, tf AS (SELECT k, r, CASE WHEN r = '' THEN 0 ELSE n END AS lc, {feats} FROM p), tg AS (SELECT k, r, {rule} AS a FROM tf),
    tc AS (SELECT k, r, split_part(a, '|', 1) AS category, round(CAST(CAST(split_part(a, '|', 2) AS FLOAT) AS DOUBLE), 4) AS confidence FROM tg)"""


_EVAL = f"e AS (SELECT *, {cn('expected_category')} AS truth, {cn('sub_type')} AS sub FROM eval_samples), ev AS (SELECT *, CASE WHEN sub IS NOT NULL THEN {cat_of('sub')} END AS pred FROM e)"


def sliced(fields: list[str]) -> str:
    parts = " UNION ALL ".join(f"SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS value, truth, pred FROM ev WHERE {f} IS NOT NULL" for f in fields)
    return f"WITH {_EVAL}, s AS ({parts}) SELECT field, value, count(*) AS total, count(*) FILTER (WHERE truth = pred) AS correct, round({ratio('count(*) FILTER (WHERE truth = pred)', 'count(*)')}, 6) AS accuracy FROM s GROUP BY 1, 2"


# what a text of each kind holds, with its own patterns
def _any(t: str, *parts: str) -> str:
    return "(" + " OR ".join(f"contains({t}, {fs.q(p)})" for p in parts) + ")"


def _re(t: str, p: str) -> str:
    return f"regexp_matches({t}, {fs.q(p)})"


_FULL = f"list_filter(string_split({fs.trim('t')}, chr(10)), lambda x: regexp_matches(x, '[^{fs.WSC}]'))"


def _lines_share(p: str) -> str:
    return f"(len({_FULL}) > 0 AND len(list_filter({_FULL}, lambda x: {_re('x', p)})) / CAST(greatest(len({_FULL}), 1) AS DOUBLE) >= 0.3)"


_PIPES = f"list_filter({_FULL}, lambda x: contains(x, '|'))"
HOLDS = {
    "pipe_table": f"(len({_FULL}) >= 2 AND len({_PIPES}) >= len({_FULL}) * 0.7 AND len(list_distinct(list_transform({_PIPES}[1:20], lambda x: length(x) - length(replace(x, '|', ''))))) <= 2)",
    "python": _any("t", "def ", "import ", "class ", "print("),
    "javascript": _any("t", "function ", "const ", "let ", "=>", "require("),
    "typescript": _any("t", "function ", "const ", "let ", "=>", "require("),
    "rust": _any("t", "fn ", "let ", "struct ", "impl ", "use "),
    "go": _any("t", "func ", "package ", "import ("),
    "java": _any("t", "class ", "public ", "private ", "import "),
    "sql": _any("upper(t)", "SELECT", "INSERT", "CREATE", "ALTER"),
    "shell": "(starts_with(t, '#!/') OR " + _any("t", "if [", "then", "echo ", "fi") + ")",
    "html": _any("lower(t)", "<html", "<div", "<body", "<head"),
    "xml": "(" + _any("t", "<?xml") + " OR " + _re("t", r"(?s)<[a-z]+>.*</[a-z]+>") + ")",
    "css": "(contains(t, '{') AND " + _any("t", "color:", "margin:", "display:", "font-") + ")",
    "yaml": _re("t", r"(?m)^\w[\w\s]*:\s"),
    "toml": "(" + _re("t", r"(?m)^\[.+\]") + " AND " + _re("t", r"(?m)^\w[\w\s]*=\s") + ")",
    "ini": "(" + _re("t", r"(?m)^\[.+\]") + " AND " + _re("t", r"(?m)^\w[\w\s]*\s*=\s*") + ")",
    "dockerfile": _any("t", "FROM ", "RUN ", "CMD "),
    "makefile": _re("t", "(?m)^[^\\t\\n]+:\\s*$\\n\\t"),
    "markdown": "(" + _re("t", r"(?m)^#+ ") + " OR " + _any("t", "**", "```") + " OR " + _re("t", r"\[.+?\]\(.+?\)") + ")",
    "rst": "(contains(t, '.. ') OR " + _re("t", r":[a-z]+:") + " OR " + _re("t", r"(?m)^[=\-]{3,}$") + ")",
    "latex": _any("t", "\\begin{", "\\end{", "\\section", "\\documentclass"),
    "key_value": _lines_share(r"^\w[\w\s]*\s*[=:]\s*\S"),
    "log_lines": _lines_share(r"^\d+[\-:T]"),
}

_FLAGS = "fl AS (SELECT row_id, sub, " + ", ".join(f"CAST(coalesce(sub = '{x}', false) AS INT) AS det_{x}, CAST({HOLDS[x]} AS INT) AS pred_{x}" for x in FLAGS) + f" FROM (SELECT row_id, coalesce(text, '') AS t, {cn('sub_type')} AS sub FROM golden_train))"
_LONG = "lo AS (" + " UNION ALL ".join(f"SELECT sub, '{x}' AS label, det_{x} AS d, pred_{x} AS p FROM fl" for x in FLAGS) + ")"
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b FROM fl WHERE pred_{a} = 1 AND pred_{b} = 1" for i, a in enumerate(sorted(FLAGS)) for b in sorted(FLAGS)[i + 1 :])

_GOLD = f"SELECT row_id, {cn('category')} AS cat, {cn('sub_type')} AS sub FROM golden_train"
_H = "md5('42:' || CAST({} AS VARCHAR))"
_ALLOC = """c AS (SELECT sub, count(*) AS n_rows FROM g GROUP BY 1), f AS (SELECT *, least(15, floor(600 / greatest(count(*) OVER (), 1))) AS fl FROM c), b AS (SELECT *, least(fl, n_rows) AS base FROM f),
    x AS (SELECT *, n_rows - base AS lft, 600 - sum(base) OVER () AS budget, sum(n_rows - base) OVER () AS al FROM b),
    a AS (SELECT sub, n_rows, CAST(least(base + CASE WHEN budget > 0 AND al > 0 THEN floor(budget * lft / nullif(al, 0)) ELSE 0 END, n_rows) AS BIGINT) AS alloc FROM x)"""

_V = f"v AS (SELECT *, {cn('annotator')} AS ann, {cn('original_sub_type')} AS o, {cn('sub_type')} AS s, {cn('new_sub_type')} AS w FROM voting_log)"
_VALID = ", ".join(map(fs.q, VALID_SUB_TYPES))


def _vote4() -> str:
    votes = "[o, s, w, coalesce(s, 'unknown')]"
    u = f"(SELECT vote_id, o, unnest({votes}) AS x, unnest([1, 2, 3, 4]) AS i FROM v)"
    return f"""WITH {_V}, u AS (SELECT * FROM {u}), g AS (SELECT vote_id, x, count(*) AS n, min(i) AS f FROM u GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY vote_id ORDER BY n DESC, f) AS rk, count(*) OVER (PARTITION BY vote_id) AS kinds FROM g)
    SELECT b.vote_id, CASE WHEN n < 3 AND kinds = 2 THEN 'TIE' WHEN x = o THEN 'KEEP_LABEL' ELSE 'FIX_LABEL' END AS verdict, x AS winner FROM b JOIN v USING (vote_id) WHERE rk = 1"""


_WORDS = "SELECT DISTINCT lower(trim(word, ' ')) AS word FROM wordlist WHERE word IS NOT NULL AND trim(word, ' ') <> ''"
_PUNCT = r"!-/:-@\[-`{-~"

SQL: dict[str, str] = {
    "feat_chars": fs.feature_query(CHARS),
    "feat_lines": fs.feature_query(LINES),
    "feat_shapes": fs.feature_query(SHAPES),
    "feat_json_lines": f"{fs.prep('documents', 'doc_id')} SELECT k AS doc_id, {fs.rounded('json_lines_ratio')}, {fs.rounded('label_value_line_ratio')}, CAST(CASE WHEN r = '' THEN 0 ELSE n END AS INT) AS line_count FROM p",
    "feat_entropy": """WITH b AS (SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), '\\n', chr(10)), '')) AS ch FROM documents), c AS (SELECT doc_id, ch, count(*) AS n FROM b WHERE ch <> '' GROUP BY 1, 2),
      t AS (SELECT doc_id, n, sum(n) OVER (PARTITION BY doc_id) AS tot FROM c), e AS (SELECT doc_id, -sum((n / CAST(tot AS DOUBLE)) * log2(n / CAST(tot AS DOUBLE))) AS h FROM t GROUP BY 1)
      SELECT d.doc_id, round(CAST(CAST(abs(coalesce(h, 0)) AS FLOAT) AS DOUBLE), 4) AS char_entropy FROM documents d LEFT JOIN e USING (doc_id)""",
    "feat_ngrams": f"""{fs.prep('documents', 'doc_id')}, i AS (SELECT k, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM p), g AS (SELECT k, concat_ws(chr(31), w[i], w[i + 1], w[i + 2]) AS g, count(*) AS n FROM i GROUP BY 1, 2),
      a AS (SELECT k, count(*) FILTER (WHERE n > 1) / CAST(count(*) AS DOUBLE) AS v FROM g GROUP BY 1) SELECT p.k AS doc_id, round(CAST(CAST(coalesce(a.v, 0) AS FLOAT) AS DOUBLE), 4) AS repeated_ngram_ratio FROM p LEFT JOIN a ON p.k = a.k""",
    "feat_runs": f"""{fs.prep('documents', 'doc_id')}, u AS (SELECT k, n, unnest(t) AS x, unnest(range(1, len(t) + 1)) AS i FROM p),
      q AS (SELECT *, strlen(x) > 40 AND NOT regexp_matches(x, '[|{{}}\\t]') AND NOT starts_with(x, '#') AS para, starts_with(x, '```') AS fence FROM u),
      r AS (SELECT *, i - row_number() OVER (PARTITION BY k, para ORDER BY i) AS island, sum(CAST(fence AS INT)) OVER (PARTITION BY k ORDER BY i) % 2 AS inside FROM q),
      s AS (SELECT k, sum(c) AS c FROM (SELECT k, island, count(*) AS c FROM r WHERE para GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1), z AS (SELECT k, count(*) FILTER (WHERE inside = 1 AND NOT fence) AS c FROM r GROUP BY 1)
      SELECT p.k AS doc_id, round(CAST(CAST(coalesce(s.c, 0) / CAST(p.n AS DOUBLE) AS FLOAT) AS DOUBLE), 4) AS prose_paragraph_ratio, round(CAST(CAST(coalesce(z.c, 0) / CAST(p.n AS DOUBLE) AS FLOAT) AS DOUBLE), 4) AS code_fence_density FROM p LEFT JOIN s ON p.k = s.k LEFT JOIN z ON p.k = z.k""",
    "feat_dictionary": f"""WITH b AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(replace(coalesce(text, ''), '\\n', chr(10)), '[{fs.WSC}]+'), lambda x: regexp_replace(lower(x), '^[{_PUNCT}]+|[{_PUNCT}]+$', '', 'g')), lambda x: x <> '')) AS word FROM documents),
      h AS (SELECT doc_id, count(*) AS n, count(w.word) AS k FROM b LEFT JOIN ({_WORDS}) w USING (word) GROUP BY 1) SELECT d.doc_id, round(CAST(CAST(coalesce(k / CAST(n AS DOUBLE), 0) AS FLOAT) AS DOUBLE), 4) AS dictionary_word_ratio FROM documents d LEFT JOIN h USING (doc_id)""",
    "tier1_classify": tier1("documents", "doc_id", "text") + " SELECT k AS doc_id, category, confidence FROM tc",
    "tier1_summary": tier1("documents", "doc_id", "text") + " SELECT lang, category, confidence, count(*) AS n FROM tc JOIN documents ON doc_id = k GROUP BY ALL",
    "filter_categories": tier1("(SELECT sample_id, text AS x FROM eval_samples UNION ALL SELECT -sample_id, prompt_template FROM eval_samples)", "sample_id", "x").replace("coalesce(x, '') AS r", "x AS r0, coalesce(x, '') AS r")
    + ", m AS (SELECT sample_id AS k FROM eval_samples WHERE text IS NOT NULL UNION ALL SELECT -sample_id FROM eval_samples WHERE prompt_template IS NOT NULL) SELECT CASE WHEN strlen(r) < 50 THEN 'prose' ELSE category END AS category, count(*) AS n FROM tc JOIN m USING (k) GROUP BY 1",
    "metric_accuracy": f"WITH {_EVAL} SELECT count(*) AS total, count(*) FILTER (WHERE truth = pred) AS correct, round({ratio('count(*) FILTER (WHERE truth = pred)', 'count(*)')}, 6) AS accuracy FROM ev",
    "confusion_matrix": f"WITH {_EVAL} SELECT truth AS actual, pred AS predicted, count(*) AS n FROM ev WHERE truth IS NOT NULL AND pred IS NOT NULL GROUP BY 1, 2",
    "per_category_metrics": f"""WITH {_EVAL}, l AS (SELECT truth AS label FROM ev WHERE truth IS NOT NULL UNION SELECT pred FROM ev WHERE pred IS NOT NULL),
      m AS (SELECT label, (SELECT count(*) FROM ev WHERE truth = label AND pred = label) AS tp, (SELECT count(*) FROM ev WHERE truth = label) AS support, (SELECT count(*) FROM ev WHERE pred = label) AS found FROM l),
      r AS (SELECT label, {ratio('tp', 'found')} AS precision, {ratio('tp', 'support')} AS recall, support FROM m)
      SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round({ratio('2 * precision * recall', 'precision + recall')}, 6) AS f1, support FROM r""",
    "slice_grouping": sliced(["sub", "boundary_pair", "length_bucket", "split"]),
    "top_confusions": f"WITH {_EVAL} SELECT truth AS expected, pred AS predicted, length_bucket AS value, count(*) AS n FROM ev WHERE truth <> pred AND length_bucket IS NOT NULL GROUP BY 1, 2, 3 ORDER BY count(*) DESC, min(sample_id) LIMIT 10",
    "diversity_report": f"WITH {_EVAL} SELECT sub AS sub_type, count(*) AS n, count(DISTINCT temperature) AS temperatures, count(DISTINCT prompt_template) AS templates, count(DISTINCT content_domain) AS domains, coalesce(array_to_string(list_sort(list_distinct(list(length_bucket) FILTER (WHERE length_bucket IS NOT NULL))), ','), '') AS buckets FROM ev WHERE sub IS NOT NULL GROUP BY 1",
    "diversity_warnings": f"WITH {_EVAL}, g AS (SELECT sub AS sub_type, model, count(*) AS n FROM ev WHERE sub IS NOT NULL AND model IS NOT NULL GROUP BY 1, 2), s AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY sub_type) AS DOUBLE) AS share FROM g) SELECT sub_type, model, n, round(share, 6) AS share FROM s WHERE share > 0.1",
    "detection_metrics": f"""WITH {_FLAGS}, {_LONG}, g AS (SELECT CASE WHEN grouping(label) = 1 THEN 'micro' ELSE label END AS label, grouping(label) AS al, count(*) FILTER (WHERE d = 1 AND p = 1) AS tp, count(*) FILTER (WHERE d = 0 AND p = 1) AS fp, count(*) FILTER (WHERE d = 1 AND p = 0) AS fn, count(*) AS slots FROM lo GROUP BY ROLLUP (lo.label)),
      r AS (SELECT *, {ratio('tp', 'tp + fp')} AS pr, {ratio('tp', 'tp + fn')} AS re FROM g), f AS (SELECT *, {ratio('2 * pr * re', 'pr + re')} AS f1 FROM r)
      SELECT label, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, tp + fn AS support, round((SELECT avg(f1) FROM f WHERE al = 0), 6) AS macro_f1, round((SELECT (fp + fn) / CAST(slots AS DOUBLE) FROM f WHERE al = 1), 6) AS hamming_loss FROM f""",
    "fire_stats": f"WITH {_FLAGS}, {_LONG}, g AS (SELECT label, count(*) AS n, count(*) FILTER (WHERE p = 1) AS total_fires, count(*) FILTER (WHERE p = 1 AND sub = label) AS self_match FROM lo GROUP BY 1) SELECT label, total_fires, self_match, total_fires - self_match AS cross_fire, round(total_fires / CAST(n AS DOUBLE), 6) AS fire_rate, round({ratio('total_fires - self_match', 'total_fires')}, 6) AS cross_fire_ratio FROM g",
    "label_cooccurrence": f"WITH {_FLAGS} SELECT a, b, count(*) AS n FROM ({_PAIRS}) GROUP BY 1, 2",
    "sub_type_detections": f"WITH {_FLAGS}, {_LONG}, g AS (SELECT sub AS sub_type, label, count(*) AS n FROM lo WHERE p = 1 AND sub IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY sub_type ORDER BY n DESC, label) AS INT) AS rank FROM g) SELECT * FROM r WHERE rank <= 3",
    "heuristic_flags": "SELECT row_id, " + ", ".join(f"{HOLDS[n]} AS is_{n}" for n in HOLDS) + " FROM (SELECT row_id, coalesce(text, '') AS t FROM golden_train)",
    "sample_filters": f"""SELECT row_id, coalesce(strlen(text) BETWEEN 50 AND 50000, false) AS size_ok, coalesce(length({fs.trim('text')}) BETWEEN 50 AND 10000, false) AS length_ok,
      CASE WHEN k < 10 THEN 'short' WHEN k <= 50 THEN 'medium' ELSE 'long' END AS bucket, coalesce(NOT regexp_matches(text, '[^{fs.WSC}]'), true) AS blank FROM (SELECT *, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{fs.WSC}]'))) AS k FROM golden_train)""",
    "sample_schema": """SELECT sample_id, coalesce(length(text) > 0 AND expected_category IN ('prose', 'code', 'structured', 'artifact') AND (boundary_pair IS NULL OR (list_contains(string_split(boundary_pair, '_'), expected_category)
        AND split_part(boundary_pair, '_', 1) <> split_part(boundary_pair, '_', 2) AND split_part(boundary_pair, '_', 1) IN ('prose', 'code', 'structured', 'artifact') AND split_part(boundary_pair, '_', 2) IN ('prose', 'code', 'structured', 'artifact'))), false) AS sample_ok,
      coalesce(length(model) > 0 AND length(prompt_template) > 0 AND length(content_domain) > 0 AND length(sub_type) > 0 AND temperature BETWEEN 0 AND 2 AND length_bucket IN ('short', 'medium', 'long') AND reasoning_mode IS NOT NULL, false) AS provenance_ok FROM eval_samples""",
    "drop_synthetic": f"SELECT {cn('source')} AS source, count(*) AS n, CASE WHEN {cn('source')} = 'unknown' THEN 'archived' ELSE 'kept' END AS side FROM golden_train GROUP BY 1, 3",
    "stratified_round_robin": f"""WITH {_EVAL}, a AS (SELECT sample_id, truth, coalesce(model, '__none__') AS m, {_H.format('sample_id')} AS h FROM ev WHERE truth IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY truth, m ORDER BY h, sample_id) AS r FROM a),
      c AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY r, m, h, sample_id) AS k FROM b) SELECT sample_id, truth FROM c WHERE k <= 25""",
    "cap_two_level": f"""WITH g AS ({_GOLD}), a AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY {_H.format('row_id')}, row_id) AS k FROM g), b AS (SELECT row_id, cat, sub, row_number() OVER (PARTITION BY sub ORDER BY {_H.format('row_id')}, row_id) AS k FROM a WHERE k <= 400) SELECT row_id, cat, sub FROM b WHERE k <= 60""",
    "floor_allocation": f"WITH g AS ({_GOLD}), {_ALLOC} SELECT sub, n_rows, alloc FROM a",
    "stratified_floor_sample": f"WITH g AS ({_GOLD}), {_ALLOC}, r AS (SELECT row_id, sub, row_number() OVER (PARTITION BY sub ORDER BY {_H.format('row_id')}, row_id) AS k FROM g) SELECT r.row_id, r.sub FROM r JOIN a ON r.sub IS NOT DISTINCT FROM a.sub WHERE k <= alloc",
    "equal_share_sample": f"""WITH g AS ({_GOLD}), n AS (SELECT count(*) AS c FROM (SELECT DISTINCT sub FROM g)), r AS (SELECT row_id, sub, {_H.format('row_id')} AS h, row_number() OVER (PARTITION BY sub ORDER BY {_H.format('row_id')}, row_id) AS k FROM g),
      f AS (SELECT row_id, sub FROM r WHERE k <= (SELECT greatest(1, 500 // c) FROM n)), t AS (SELECT row_id, sub, row_number() OVER (ORDER BY h, row_id) AS j FROM r WHERE row_id NOT IN (SELECT row_id FROM f))
      SELECT row_id, sub FROM f UNION ALL SELECT row_id, sub FROM t WHERE j <= 500 - (SELECT count(*) FROM f)""",
    "injected_logs": "SELECT row_id, 'inject_log_content' AS audit_source FROM golden_train WHERE regexp_matches(text, '(?:\\b(INFO|WARN|ERROR|DEBUG|TRACE|FATAL)\\b.*\\d{4}-\\d{2}-\\d{2})|(?:\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}.*\\b(INFO|WARN|ERROR|DEBUG|TRACE|FATAL)\\b)|(?:\\[\\d{2}/\\w{3}/\\d{4}:\\d{2}:\\d{2}:\\d{2})') ORDER BY " + _H.format("row_id") + ", row_id LIMIT 40",
    "train_validation": f"WITH g AS ({_GOLD}), r AS (SELECT row_id, row_number() OVER (PARTITION BY cat ORDER BY {_H.format('row_id')}, row_id) AS k, count(*) OVER (PARTITION BY cat) AS n FROM g) SELECT row_id, CASE WHEN k <= round(n * 0.2) THEN 'validation' ELSE 'train' END AS split FROM r",
    "tiered_decide": f"WITH {_V}, a AS (SELECT vote_id, w, CASE WHEN coalesce(tier1_agrees, false) OR coalesce(tier2_agrees, false) THEN 'keep' WHEN tier2_agrees IS NULL THEN 'drop' WHEN coalesce(w IN ({_VALID}), false) THEN 'relabel' ELSE 'drop' END AS action FROM v) SELECT vote_id, action, CASE WHEN action = 'relabel' THEN w END AS new_label FROM a",
    "vote_three": f"WITH {_V} SELECT vote_id, CASE WHEN o = s OR o = w THEN o WHEN s = w THEN s ELSE 'manual_review' END AS label, CASE WHEN o = s AND s = w THEN 'unanimous' WHEN o = s OR o = w OR s = w THEN 'majority' ELSE 'tie' END AS method FROM v",
    "vote_four": _vote4(),
    "verdicts": f"""WITH {_V}, x AS (SELECT vote_id, {cat_of('o')} AS a, {cat_of('s')} AS b, {cat_of('w')} AS c FROM v) SELECT vote_id, CASE WHEN c = b AND c <> a THEN 'FIX_LABEL' WHEN c <> a AND c <> b THEN 'AMBIGUOUS' ELSE 'MODEL_WRONG' END AS error,
      CASE WHEN b = c AND b <> a THEN 'CORRECT' WHEN b <> c AND c <> a THEN 'AMBIGUOUS' ELSE 'KEEP' END AS label, CASE WHEN a <> b THEN CASE WHEN c = b THEN 'LIKELY_MISLABEL' WHEN c = a THEN 'REAL_MODEL_ERROR' ELSE 'AMBIGUOUS' END END AS detector FROM x""",
    "escalation_rates": f"WITH {_V} SELECT o AS sub_type, count(*) AS n, round(avg(CAST(tier1_agrees AS INT)), 6) AS agreement_rate, round(1 - avg(CAST(tier1_agrees AS INT)), 6) AS escalation_rate FROM v GROUP BY 1",
    "annotator_agreement": f"WITH {_V}, d AS (SELECT DISTINCT row_id, ann, o AS label, CAST(tier1_agrees AS INT) AS flag FROM v), r AS (SELECT row_id, label, count(*) FILTER (WHERE flag = 1) AS ones, count(*) AS k FROM d GROUP BY 1, 2), s AS (SELECT label, greatest(ones, k - ones) / CAST(k AS DOUBLE) AS sh FROM r) SELECT label, round(avg(sh), 6) AS mean_agreement, round(avg(CAST(sh = 1 AS INT)), 6) AS unanimous_rate, round(avg(CAST(sh < 1 AS INT)), 6) AS split_rate FROM s GROUP BY 1",
    "apply_relabels": f"WITH {_V}, r AS (SELECT row_id, w, row_number() OVER (PARTITION BY row_id ORDER BY voted_at DESC, received_at DESC, vote_id DESC) AS k FROM v WHERE action = 'relabel' AND new_sub_type IS NOT NULL), g AS ({_GOLD}) SELECT g.row_id, coalesce(r.w, g.sub) AS sub FROM g LEFT JOIN r ON r.row_id = g.row_id AND r.k = 1",
    "resume_pending": "SELECT row_id FROM golden_train WHERE row_id NOT IN (SELECT row_id FROM voting_log)",
    "detector_crosscheck": f"""WITH {_EVAL}, x AS (SELECT truth, pred, {cat_of('boundary_pair')} AS det FROM ev WHERE truth IS NOT NULL AND pred IS NOT NULL), n AS (SELECT count(*) AS total, count(*) FILTER (WHERE truth <> pred) AS errors, count(*) FILTER (WHERE det = truth) AS agrees_with_label, count(*) FILTER (WHERE det = pred) AS agrees_with_prediction,
      count(*) FILTER (WHERE det <> truth AND det <> pred) AS disagrees_with_both, count(*) FILTER (WHERE truth <> pred AND det = pred) AS mislabel_candidates, count(*) FILTER (WHERE truth <> pred AND det = truth) AS model_errors FROM x)
      SELECT *, errors - mislabel_candidates - model_errors AS ambiguous, round({ratio('total - errors + mislabel_candidates', 'total')}, 4) AS estimated_accuracy FROM n""",
    "class_weights": f"WITH g AS ({_GOLD}), c AS (SELECT sub AS sub_type, count(*) AS n FROM g WHERE sub IS NOT NULL GROUP BY 1) SELECT sub_type, n, round(sum(n) OVER () / (count(*) OVER () * CAST(n AS DOUBLE)), 6) AS weight FROM c",
    "feature_moments": """WITH f0 AS MATERIALIZED (SELECT alpha_ratio::DOUBLE AS a, sentence_punctuation_rate::DOUBLE AS b, dictionary_word_ratio::DOUBLE AS c, line_count::DOUBLE AS d FROM feature_vector),
      f AS (SELECT * FROM f0 WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND CAST(a AS VARCHAR) <> 'nan' AND CAST(b AS VARCHAR) <> 'nan' AND CAST(c AS VARCHAR) <> 'nan'),
      l AS (SELECT 'alpha_ratio' AS feature, a AS v FROM f UNION ALL SELECT 'sentence_punctuation_rate', b FROM f UNION ALL SELECT 'dictionary_word_ratio', c FROM f UNION ALL SELECT 'line_count', d FROM f)
      SELECT feature, round(avg(v), 5) AS mean, round(CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END, 5) AS std FROM l GROUP BY 1""",
    "plan_summary": "SELECT count(*) AS entries, CAST(sum(coalesce(target_count, 0)) AS BIGINT) AS target, CAST(coalesce(sum(target_count) FILTER (WHERE synthetic), 0) AS BIGINT) AS synthetic_target, CAST(coalesce(sum(target_count) FILTER (WHERE NOT synthetic), 0) AS BIGINT) AS real_target FROM (SELECT DISTINCT * FROM source_plan)",
    "nearest_cosine": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), n AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS z FROM e), d AS (SELECT a.vec_id, b.vec_id AS nn, 1 - list_dot_product(a.x, b.x) / (a.z * b.z) AS d FROM n a JOIN n b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), nn) AS k FROM d) SELECT vec_id, nn, round(d, 4) AS distance FROM r WHERE k = 1",
    "marginalised_scores": """WITH s AS (SELECT ['plain', 'markdown', 'python', 'sql', 'shell', 'csv', 'json', 'yaml'] AS subs, ['prose', 'prose', 'code', 'code', 'code', 'structured', 'structured', 'structured'] AS cats), u AS (SELECT vec_id, unnest(subs) AS sub, unnest(cats) AS cat, unnest(range(1, 9)) AS i, unnest(CAST(embedding[1:8] AS DOUBLE[])) AS x FROM embeddings, s),
      p AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM u), q AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS pr FROM p), c AS (SELECT vec_id, cat, sum(pr) AS pr, row_number() OVER (PARTITION BY vec_id ORDER BY sum(pr) DESC, min(i)) AS k FROM q GROUP BY 1, 2), t AS (SELECT vec_id, sub, pr, row_number() OVER (PARTITION BY vec_id ORDER BY pr DESC, i) AS k FROM q)
      SELECT c.vec_id, c.cat AS category, round(c.pr, 6) AS probability, t.sub AS sub_type, round(t.pr, 6) AS score FROM c JOIN t ON c.vec_id = t.vec_id AND t.k = 1 WHERE c.k = 1""",
    "json_path": "SELECT event_id, CASE WHEN json_type(json_extract(props, '$.k')) = 'VARCHAR' THEN json_extract_string(props, '$.k') END AS as_text, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS as_number FROM events",
    "reply_labels": "WITH r AS (SELECT *, 'I would say: ' || coalesce(sub_type, 'none') || '.' AS rep, " + cn("sub_type") + " AS c FROM eval_samples) SELECT sample_id, CASE " + " ".join(f"WHEN contains(rep, '{s}') THEN '{s}'" for s in sorted(VALID_SUB_TYPES, key=lambda s: (-len(s), s))) + " END AS sub_type, coalesce(CASE WHEN contains(lower(boundary_pair), 'prose') THEN 'prose' WHEN contains(lower(boundary_pair), 'code') THEN 'code' WHEN contains(lower(boundary_pair), 'structured') THEN 'structured' END, 'unknown') AS category, CASE " + " ".join(f"WHEN c = '{a}' THEN '{b}'" for a, b in ({s: s for s in CATEGORY_OF} | ALIASES).items()) + " ELSE 'unknown' END AS canonical FROM r",
    "heuristic_votes": r"""SELECT row_id, CASE WHEN coalesce(NOT regexp_matches(text, '\S'), true) THEN 'drop' WHEN regexp_matches(text, '@interface|@implementation|@property|@protocol|@synthesize|@class') THEN 'objc'
      WHEN regexp_matches(text, '#include|#define|#ifndef') OR regexp_matches(text, '\b(?:int|void|char|float|double|long|unsigned|signed|short|size_t|bool)\s+\w+\s*\(') OR regexp_matches(text, '\bstruct\s+\w+') THEN 'c_cpp'
      WHEN len(regexp_extract_all(text, '(?i)permission|license|granted|warranty|copyright|distribute|sublicense|merchantability|liability|damages|software|modification|restriction')) / CAST(greatest(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')), 1) AS DOUBLE) > 0.10 THEN 'prose_plain'
      WHEN len(regexp_extract_all(text, '[{};]')) >= 3 AND regexp_matches(text, '\*\w|\w\*|typedef\b|enum\s+\w+\s*\{|enum\s*\{|NULL\b|nullptr\b') THEN 'c_cpp' ELSE 'drop' END AS vote FROM golden_train""",
    "source_counts": f"SELECT {cn('source')} AS source, {cn('category')} AS category, count(*) AS n FROM golden_train GROUP BY 1, 2",
}
SQL["filter_categories"] = SQL["filter_categories"].replace("x AS r0, ", "")
SQL["stream_categories"] = tier1("documents", "doc_id", "text") + " SELECT strftime(make_timestamp(CAST(epoch(fetched_at) AS BIGINT) // 604800 * 604800 * 1000000), '%Y-%m-%d') AS start, category, count(*) AS n FROM tc JOIN documents ON doc_id = k WHERE fetched_at IS NOT NULL GROUP BY 1, 2"
_PARTS = ["feat_chars", "feat_lines", "feat_shapes", "feat_entropy", "feat_ngrams", "feat_runs", "feat_json_lines", "feat_dictionary"]
SQL["features_all"] = f"SELECT * FROM ({SQL[_PARTS[0]]}) " + " ".join(f"JOIN ({SQL[p]}) USING (doc_id)" for p in _PARTS[1:])
