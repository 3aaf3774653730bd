"""Readers and writers of documents: JSON Lines with any fields, text files, CSV, Parquet, reports.

JSON documents are VARIANT columns, so fields nobody asked for survive a round trip. gzip is recognised by extension.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosewright.functions.textprims import WS, json_value
from prosewright.session import shared_path


def read_json_lines(spark: SparkSession, *paths: str, strict: bool = True) -> DataFrame:
    """(doc VARIANT, path, line): full lines of the files. A bad line is an error, or, if not strict, left out."""
    raw = spark.read.text(list(paths)).select(F.col("value"), F.col("_metadata.file_path").alias("path")).where(F.col("value").rlike(f"[^{WS}]"))
    d = raw.select(json_value(F.col("value")).alias("doc"), "path", F.col("value").alias("line"))
    if strict:
        bad = F.raise_error(F.concat(F.lit("no JSON value: "), F.substring("line", 1, 200))).cast("variant")
        return d.withColumn("doc", F.when(F.col("doc").isNull(), bad).otherwise(F.col("doc")))
    return d.where("doc IS NOT NULL")


def json_text(doc: Column, path: str) -> Column:
    """The string at a dotted path of objects; null where it is missing or no string."""
    json_path = "$" + "".join(f"['{p}']" for p in path.split("."))
    found = F.try_variant_get(doc, json_path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(doc, json_path, "string"))


def with_field(doc: Column, line: Column, name: str, value: Column) -> Column:
    """A JSON line with one more field, its other fields as they were. Empty maps and nulls of the value are left out."""
    inner = F.regexp_replace(line, rf"{WS}*\}}{WS}*$", "")
    comma = F.when(inner.rlike(rf"\{{{WS}*$"), F.lit("")).otherwise(F.lit(","))
    return F.concat(inner, comma, F.lit(json.dumps(name)), F.lit(":"), F.to_json(value), F.lit("}"))


def read_text_folder(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """(text, category, sub_type): whole files, labelled by folder and stem."""
    d = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}").select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("_p"))
    return d.select("text", F.regexp_extract("_p", r"([^/]+)/[^/]+$", 1).alias("category"), F.regexp_extract("_p", r"([^/]+)\.[^./]+$", 1).alias("sub_type"))


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header, quoted line ends, and fields of any size."""
    r = spark.read.options(header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1)
    return (r.schema(schema) if schema else r).csv(path)


def read_parquet_as(spark: SparkSession, path: str, **renamed: str) -> DataFrame:
    """Parquet with columns renamed (old=new)."""
    return spark.read.parquet(path).withColumnsRenamed(renamed)


def inline(spark: SparkSession, *texts: str | None) -> DataFrame:
    return spark.createDataFrame([(t,) for t in texts], "text string")


def from_stream(spark: SparkSession, lines, batch: int = 100_000) -> str:
    """The path of a text table in the shared folder with the lines of an open file, such as standard input; written batch by batch."""
    path, held = shared_path(spark, "input"), []

    def put():
        spark.createDataFrame([(x,) for x in held], "value string").write.mode("append").text(path)
        held.clear()

    for line in lines:
        held.append(line.rstrip("\r\n"))
        if len(held) >= batch:
            put()
    put()
    return path


def first_available(spark: SparkSession, candidates: list[str], format: str = "parquet") -> DataFrame:
    """The first path that can be read; an error naming all if none can."""
    tried = []
    for c in candidates:
        try:
            return spark.read.format(format).load(c)
        except Exception as e:  # noqa: BLE001 - any unreadable candidate means the next one
            tried.append(f"{c}: {type(e).__name__}")
    raise FileNotFoundError("; ".join(tried))


def read_words(spark: SparkSession, path: str, limit: int = 1_000_000) -> list[str]:
    """A word list from a text file of one word a line: a list of settings, of at most `limit` words."""
    rows = spark.read.text(path).select(F.trim(F.lower("value")).alias("w")).where("w <> ''").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} words in {path}")
    return [r[0] for r in rows]


def write_json_lines(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def replace_parquet(df: DataFrame, path: str) -> None:
    """Writes beside the target, then swaps: safe where the target is also read, and the old table is there until the new one is."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    side = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(side)
    target, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(side)
    fs = target.getFileSystem(conf)
    old = jvm.org.apache.hadoop.fs.Path(f"{side}.old")
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(staged, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"could not move {side} to {path}")
    if had:
        fs.delete(old, True)


def append_parquet(df: DataFrame, path: str) -> None:
    """Appends rows brought to the target's schema: missing columns are null, others an error."""
    schema = df.sparkSession.read.parquet(path).schema
    conform(df, schema).write.mode("append").parquet(path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    odd = set(df.columns) - set(schema.names)
    if odd:
        raise ValueError(f"columns the schema does not have: {sorted(odd)}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_feature_csv(df: DataFrame, features: list[str], path: str) -> None:
    """Features with four decimals, with a header."""
    df.select(*[F.format_string("%.4f", F.col(f).cast("double")).alias(f) for f in features]).write.mode("overwrite").option("header", True).csv(path)


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows; missing columns are null, numeric types widened."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def checksum(spark: SparkSession, path: str) -> str | None:
    """SHA-256 of a file, or of its parts' checksums in order of their names."""
    d = spark.read.format("binaryFile").load(path).select(F.col("path"), F.sha2("content", 256).alias("h"))
    rows = sorted((r["path"], r["h"]) for r in d.collect())
    if not rows:
        return None
    return rows[0][1] if len(rows) == 1 else spark.range(1).select(F.sha2(F.lit("".join(h for _, h in rows)).cast("binary"), 256)).first()[0]


def file_errors(spark: SparkSession, path: str, ok: Column) -> DataFrame:
    """(line_number, error) of a JSON Lines file's full lines that are no JSON or fail `ok` (over a VARIANT column doc). Line numbers need one reader: the file is read as one text."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "value")).where(F.col("value").rlike(f"[^{WS}]"))
    d = whole.withColumn("doc", json_value(F.col("value")))
    error = F.when(F.col("doc").isNull(), "invalid JSON").when(~F.coalesce(ok, F.lit(False)), "sample failed schema validation")
    return d.select((F.col("n") + 1).alias("line_number"), error.alias("error")).where("error IS NOT NULL")
