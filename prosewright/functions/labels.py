"""Labels and the maps between them, as plain dicts and as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Categories in their order, and each sub-type's category.
CATEGORIES = ["prose", "code", "structured"]
SUB_TYPES = {
    "prose": ["plain", "markdown", "rst", "latex"],
    "code": ["python", "javascript", "typescript", "rust", "go", "java", "sql", "shell", "css", "dockerfile", "makefile", "c_cpp", "objc", "html", "xml", "sgml"],
    "structured": ["csv", "tsv", "pipe_table", "fixed_width", "json", "jsonl", "key_value", "log_lines", "yaml", "toml", "ini"],
}
CATEGORY_OF = {s: c for c, subs in SUB_TYPES.items() for s in subs} | {"unknown": "prose"}
VALID_SUB_TYPES = [s for s in CATEGORY_OF if s not in ("c_cpp", "objc")]

# Older names of sub-types.
ALIASES = {
    "minified_js": "javascript", "yaml_config": "yaml", "yaml_nested": "yaml", "toml_config": "toml", "ini_config": "ini",
    "csv_data": "csv", "tsv_data": "tsv", "json_object": "json", "simple": "json", "jsonl_data": "jsonl",
}

# Sub-types whose category is overridden before splitting.
CATEGORY_OVERRIDES = {"yaml": "structured", "toml": "structured", "ini": "structured"}

# Labels an external detector gives, and what they are here.
DETECTOR_SUB_TYPE = {
    "txt": "plain", "text": "plain", "markdown": "markdown", "rst": "rst", "latex": "latex", "tex": "latex",
    "python": "python", "javascript": "javascript", "typescript": "typescript", "java": "java", "rust": "rust", "go": "go",
    "sql": "sql", "shell": "shell", "bash": "shell", "css": "css", "html": "html", "xml": "xml", "svg": "xml",
    "dockerfile": "dockerfile", "makefile": "makefile", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl",
    "yaml": "yaml", "toml": "toml", "ini": "ini", "csv": "csv", "tsv": "tsv",
}
DETECTOR_CATEGORY = {
    "prose": ["txt", "text", "rtf", "pdf", "doc", "docx", "epub", "email", "eml", "mbox", "latex", "tex", "rst", "markdown", "asciidoc"],
    "code": [
        "python", "javascript", "typescript", "java", "c", "cpp", "csharp", "go", "rust", "ruby", "php", "perl", "scala", "kotlin", "swift", "r", "lua", "shell", "bash", "powershell", "sql", "css", "scss", "less", "html", "xml",
        "svg", "dockerfile", "makefile", "cmake", "hcl", "terraform",
    ],
    "structured": ["json", "jsonl", "ndjson", "yaml", "toml", "ini", "csv", "tsv", "plist", "properties"],
}

# File name extensions.
EXTENSIONS = {
    "md": "markdown", "rst": "rst", "tex": "latex", "txt": "plain", "py": "python", "js": "javascript", "ts": "typescript", "rs": "rust", "go": "go", "java": "java", "sql": "sql", "sh": "shell", "css": "css",
    "html": "html", "xml": "xml", "csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "jsonl", "yaml": "yaml", "yml": "yaml", "toml": "toml", "ini": "ini", "log": "log_lines",
}

# Labels of embedded phenomena, which are no sub-types.
SEMANTIC_LABELS = ["log_content", "stack_trace", "diff_patch"]


def lookup(table: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """table[key], else default (null if none)."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key)
    found = F.when(key.isNotNull(), found)
    return found if default is None else F.coalesce(found, default)


def category_of(sub_type: Column) -> Column:
    """Category of a sub-type; unknown ones, and null, are prose."""
    return lookup(CATEGORY_OF, sub_type, F.lit("prose"))


def canonical_sub_type(label: Column) -> Column:
    """Current name of a sub-type label, `unknown` for anything else."""
    return lookup({s: s for s in CATEGORY_OF} | ALIASES, label, F.lit("unknown"))


def detector_category(label: Column) -> Column:
    return lookup({x: c for c, xs in DETECTOR_CATEGORY.items() for x in xs}, label, F.lit("unknown"))


def category_order(category: Column) -> Column:
    """0, 1, 2 for the categories, 3 for others."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, CATEGORIES)), category), F.lit(0)).cast("int") - 1, F.lit(3))


def dimension(spark: SparkSession) -> DataFrame:
    """(sub_type, category, ordinal): the label dimension."""
    rows = [(s, c, i) for i, (s, c) in enumerate(CATEGORY_OF.items())]
    return spark.createDataFrame(rows, "sub_type string, category string, ordinal int")
