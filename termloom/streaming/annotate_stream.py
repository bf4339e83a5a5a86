"""Annotation of a stream of samples: each micro-batch goes through the same plan (an extension of our own)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from termloom.plans.annotate import Rules, Vocabulary, annotate


def annotate_stream(stream: DataFrame, vocabulary: Vocabulary, rules: Rules | None, out: str, checkpoint: str, available_now: bool = True):
    """Starts the query: ``kv`` rows from ``stream`` come out as Parquet under ``out/mapped`` and ``out/values``.

    A batch is written to a folder of its own number, in place of an earlier attempt at it.
    """

    def batch(df: DataFrame, number: int) -> None:
        mapped, values = annotate(df.sparkSession, df, vocabulary, rules)
        mapped.write.mode("overwrite").parquet(f"{out}/mapped/batch={number}")
        values.write.mode("overwrite").parquet(f"{out}/values/batch={number}")

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows of each key in tumbling windows, with rows later than ``late`` left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
