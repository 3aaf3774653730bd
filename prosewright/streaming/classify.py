"""The rule tier on streams: the classification is a stateless projection, so it runs unchanged; counts per window tolerate late documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosewright.operators.rules import classify
from prosewright.operators.voting import pending


def classified_stream(stream: DataFrame, text_col: str = "text", sample_bytes: int | None = 10_000) -> DataFrame:
    return classify(stream, text_col, sample_bytes=sample_bytes)


def windowed_categories(stream: DataFrame, time_col: str, window: str = "1 hour", late: str = "1 day", text_col: str = "text", sample_bytes: int | None = 10_000) -> DataFrame:
    """(window, category, n) of documents by event time; later ones than `late` are left out. sample_bytes None: by their whole texts."""
    d = classify(stream.withWatermark(time_col, late), text_col, sample_bytes=sample_bytes)
    return d.groupBy(F.window(time_col, window), F.col("classification.category").alias("category")).agg(F.count(F.lit(1)).alias("n"))


def resumable_sink(path: str, key: str):
    """For foreachBatch: appends rows whose key is not in the target yet, so that a repeated batch writes nothing twice."""

    def write(batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        try:
            batch = pending(batch, spark.read.parquet(path), key)
        except Exception as e:  # noqa: BLE001 - the first batch finds no target
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
        batch.write.mode("append").parquet(path)

    return write
