"""The features in SQL, for the oracle. A second, independent form of the definitions; slow, so only for checking."""

from __future__ import annotations

WSC = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# letters, letter numbers and the vowel signs and other marks that count as alphabetic, for the scripts the tables hold
ALPHA = r"\p{L}\p{Nl}\x{93a}\x{93b}\x{93e}-\x{94c}\x{94e}\x{94f}\x{955}-\x{957}\x{900}-\x{903}\x{345}"
ALNUM = ALPHA + r"\p{N}"
DELIMS = ["','", "'|'", "chr(9)", "';'"]
# Fixed values, as in functions.features.
MOJIBAKE = ["Ã©", "Ã¨", "Ã¼", "Ã¶", "Ã¤", "Â°", "Â©", "â\u0080\u0093", "â\u0080\u0099", "â\u0080\u009c", "â\u0080\u009d"]
OPERATORS = ["==", "!=", ">=", "<=", "&&", "||", "=>", "->", "+=", "-=", "*=", "/=", "**", "<<", ">>", "::"]


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WSC}]+|[{WSC}]+$', '', 'g')"


def ltrim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WSC}]+', '')"


def rtrim(x: str) -> str:
    return f"regexp_replace({x}, '[{WSC}]+$', '')"


def lines(s: str) -> str:
    parts = f"regexp_split_to_array({s}, '\\r?\\n')"
    return f"CASE WHEN {s} = '' THEN CAST([] AS VARCHAR[]) WHEN {parts}[-1] = '' THEN {parts}[1:-2] ELSE {parts} END"


def prep(table: str, key: str, text: str = "text") -> str:
    """A chain of CTEs ending in p(key, r, s, l, t, ne, w, chars, n, m)."""
    return f"""WITH b AS (SELECT {key} AS k, coalesce({text}, '') AS r, replace(coalesce({text}, ''), '\\n', chr(10)) AS s FROM {table}),
    c AS (SELECT *, {lines("s")} AS l, list_filter(regexp_split_to_array(s, '[{WSC}]+'), lambda x: x <> '') AS w FROM b),
    d AS (SELECT *, list_transform(l, lambda x: {trim("x")}) AS t FROM c),
    p AS (SELECT *, list_filter(t, lambda x: x <> '') AS ne, greatest(length(s), 1) AS chars, greatest(len(l), 1) AS n, greatest(len(list_filter(t, lambda x: x <> '')), 1) AS m FROM d)"""


def share(cond: str, of: str, by: str) -> str:
    return f"len(list_filter({of}, lambda x: {cond})) / CAST({by} AS DOUBLE)"


def hits(pattern: str, of: str = "s") -> str:
    return f"len(regexp_extract_all({of}, {q(pattern)}))"


def count_of(needle: str, of: str = "s") -> str:
    return f"((length({of}) - length(replace({of}, {q(needle)}, ''))) / {len(needle)})"


def per_mille(count: str) -> str:
    return f"CAST(CAST(CAST({count} AS DOUBLE) / chars AS FLOAT) * CAST(1000 AS FLOAT) AS DOUBLE)"


def lead(x: str) -> str:
    return f"length(replace(regexp_extract({x}, '^[{WSC}]*'), chr(9), '    '))"


def mode(d: str) -> str:
    c = f"list_transform(l, lambda x: length(x) - length(replace(x, {d}, '')))"
    best = f"list_reverse_sort(list_transform(list_distinct({c}), lambda v: {{'f': len(list_filter({c}, lambda y: y = v)), 'p': -list_position({c}, v), 'v': v}}))[1]"
    return f"(CASE WHEN ({best}).v > 0 THEN ({best}).f / CAST(len(l) AS DOUBLE) ELSE 0.0 END)"


_kv_named = f"regexp_matches(left(x, strpos(x, %s) - 1), '[{ALNUM}]')"
KEY_VALUE = f"CASE WHEN strpos(x, ': ') > 0 THEN strpos(x, ': ') > 1 AND {_kv_named % q(': ')} ELSE strpos(x, '=') > 1 AND strpos(x, '=') < length(x) AND {_kv_named % q('=')} END"
SHAPE = f"concat_ws(',', len(list_filter(regexp_split_to_array(x, '[{WSC}]+'), lambda z: z <> '')), " + ", ".join(f"contains(x, {d})" for d in DELIMS) + ")"
SHAPES = f"list_transform(l[1:20], lambda x: {SHAPE})"
INDENTS = f"list_transform(list_filter(l, lambda x: regexp_matches(x, '^[{WSC}]+[^{WSC}]')), lambda x: {lead('x')})"
SHORT = "list_filter(t, lambda x: strlen(x) BETWEEN 1 AND 40)"

RAW = f"list_filter(list_transform({lines('r')}, lambda x: {trim('x')}), lambda x: x <> '')"

SQL: dict[str, str] = {
    "line_length_cv": "CASE WHEN len(l) < 2 OR list_sum(list_transform(l, lambda x: strlen(x))) / CAST(len(l) AS DOUBLE) < 1 THEN 0.0 ELSE list_stddev_pop(list_transform(l, lambda x: CAST(strlen(x) AS DOUBLE))) / (list_sum(list_transform(l, lambda x: strlen(x))) / CAST(len(l) AS DOUBLE)) END",
    "leading_whitespace_ratio": share(f"{lead('x')} > 2", "l", "n"),
    "tab_density": "(length(s) - length(replace(s, chr(9), ''))) / CAST(chars AS DOUBLE)",
    "sentence_punctuation_rate": f"{hits(f'[{ALPHA}][.!?](?:[{WSC}]|$)')} / CAST(greatest(len(w), 1) AS DOUBLE)",
    "paragraph_break_rate": "((length(s) - length(replace(s, chr(10) || chr(10), ''))) / 2) / CAST(n AS DOUBLE)",
    "alpha_ratio": f"{hits(f'[{ALNUM} ]')} / CAST(chars AS DOUBLE)",
    "line_uniqueness": "len(list_distinct(l[1:500])) / CAST(greatest(len(l[1:500]), 1) AS DOUBLE)",
    "short_line_ratio": share("strlen(x) BETWEEN 1 AND 14", "t", "n"),
    "symbol_ratio": hits(rf"[^{ALNUM} \n\t\r.,;:!?\-'" + r'"\x{2190}-\x{21FF}\x{2500}-\x{27BF}–—•°©®™…×÷]') + " / CAST(chars AS DOUBLE)",
    "delimiter_consistency": "CASE WHEN len(l) < 3 THEN 0.0 ELSE greatest(" + ", ".join(mode(d) for d in DELIMS) + ") END",
    "json_brace_depth": hits(r"[{}\[\]]") + " / CAST(chars AS DOUBLE)",
    "key_value_ratio": share(KEY_VALUE, "t", "n"),
    "xml_tag_ratio": share(f"regexp_matches(x, '</?[{ALPHA}]')", "l", "n"),
    "log_line_ratio": share(r"regexp_matches(x, '^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}:[0-9]{2}:[0-9]{2}|\[[0-9]{4})')", "t", "n"),
    "comment_ratio": share(r"regexp_matches(x, '^(?:#|//|/\*|--|%)')", "t", "n"),
    "numeric_field_ratio": "CASE WHEN len(w) = 0 THEN 0.0 ELSE " + share(r"regexp_matches(replace(x, ',', ''), '(?i)^[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf|infinity|nan)$')", "w", "len(w)") + " END",
    "repetitive_structure_score": f"CASE WHEN len(l) < 3 THEN 0.0 ELSE list_max(list_transform({SHAPES}, lambda v: len(list_filter({SHAPES}, lambda y: y = v)))) / CAST(len(l[1:20]) AS DOUBLE) END",
    "hyphenated_line_break_ratio": f"CASE WHEN len(l) < 2 THEN 0.0 ELSE len(list_filter(range(1, len(l)), lambda i: ends_with({rtrim('l[i]')}, '-') AND regexp_matches({ltrim('l[i + 1]')}, '^\\p{{Ll}}'))) / CAST(len(l) - 1 AS DOUBLE) END",
    "short_repeated_line_ratio": f"CASE WHEN len({SHORT}) < 2 THEN 0.0 ELSE len(list_filter({SHORT}, lambda v: len(list_filter({SHORT}, lambda y: y = v)) > 1)) / CAST(len({SHORT}) AS DOUBLE) END",
    "page_number_density": share(r"regexp_matches(x, '^[0-9]{1,4}$|^(?i:page)[ \t\f\r]+[0-9]{1,4}([ \t\f\r]+(?i:of)[ \t\f\r]+[0-9]{1,4})?$|^[0-9]{1,4}[ \t\f\r]*/[ \t\f\r]*[0-9]{1,4}')", "t", "n"),
    "table_fragment_score": share(f"{trim('x')} <> '' AND (len(regexp_extract_all(x, '[,|\\t;]')) >= 2 OR regexp_matches(x, '[^{WSC}][{WSC}]{{2,}}[^{WSC}]'))", "l", "m"),
    "uppercase_header_ratio": share(
        f"strlen(x) <= 80 AND len(regexp_extract_all(x, '[{ALPHA}]')) >= 3 AND CAST(len(regexp_extract_all(x, '\\p{{Lu}}')) / CAST(len(regexp_extract_all(x, '[{ALPHA}]')) AS DOUBLE) AS FLOAT) >= CAST(0.8 AS FLOAT) AND NOT regexp_matches(x, '[.!?]$')", "ne", "m"
    ),
    "encoding_error_ratio": "(" + " + ".join([count_of("�"), *map(count_of, MOJIBAKE)]) + ") / CAST(chars AS DOUBLE)",
    "sentence_coherence_score": share(r"regexp_matches(x, '(?s)^\p{Lu}(?:.*[.!?])$')", "ne", "m"),
    "avg_words_per_line": "len(w) / CAST(m AS DOUBLE)",
    "operator_density": per_mille("(" + " + ".join(map(count_of, OPERATORS)) + ")"),
    "inline_markup_count": per_mille(hits(r"\*\*[^*](?s:.*?)\*\*|`[^`]+`|\*[^*\s][^*]*\*|\[[^\]]+\]\([^)]+\)")),
    "indentation_consistency": f"CASE WHEN len({INDENTS}) < 3 THEN 0.0 ELSE greatest(" + ", ".join(f"len(list_filter({INDENTS}, lambda v: v % {b} = 0))" for b in (2, 3, 4)) + f") / CAST(len({INDENTS}) AS DOUBLE) END",
    "markup_heading_ratio": share("regexp_matches(x, " + q(r"^#+ .*\S|^[=\-*~^\"'`]{3,}$") + ")", "ne", "m"),
    "semicolon_line_ending_ratio": share("ends_with(x, ';')", "ne", "m"),
    "list_item_ratio": f"len(list_filter(l, lambda x: {trim('x')} <> '' AND regexp_matches({ltrim('x')}, '^(?:[-*•] |[0-9]+[.)] )[^{WSC}]'))) / CAST(m AS DOUBLE)",
    "parenthesis_density": per_mille(hits("[()]")),
    "section_header_ratio": share(r"regexp_matches(x, '^\[[A-Za-z0-9_ .\-]+\]$')", "ne", "m"),
    "label_value_line_ratio": share(rf"regexp_matches(x, '^[A-Za-z][A-Za-z0-9 _/().]{{0,31}}[ \t\f\r]*[:\-][ \t\f\r]+[^{WSC}]')", "t", "n"),
    "json_lines_ratio": f"CASE WHEN len({RAW}) = 0 THEN 0.0 ELSE len(list_filter({RAW}, lambda x: starts_with(x, '{{') AND ends_with(x, '}}'))) / CAST(len({RAW}) AS DOUBLE) END",
    "shebang_present": f"CAST(starts_with({ltrim('s')}, '#!') AS DOUBLE)",
}


def rounded(name: str) -> str:
    return f"round(CAST(CAST(CASE WHEN r = '' THEN 0.0 ELSE {SQL[name]} END AS FLOAT) AS DOUBLE), 4) AS {name}"


def feature_query(names: list[str], table: str = "documents", key: str = "doc_id") -> str:
    return f"{prep(table, key)}\nSELECT k AS {key}, " + ", ".join(rounded(n) for n in names) + " FROM p"
