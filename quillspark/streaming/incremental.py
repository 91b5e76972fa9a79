"""Checking documents as they arrive, and counts of events in windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import tokens
from ..plans import api


def unknown_words(stream: DataFrame, forms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, word, n for the words of each arriving document that are no form: a stream joined to a table, without state."""
    words = stream.select(id_col, F.explode(tokens.words(F.col(text_col))).alias("w")).select(id_col, F.lower("w").alias("word"))
    return words.join(forms.select(F.col("form").alias("word")).distinct(), "word", "left_anti")


def counts_by_window(events: DataFrame, ts: str = "ts", key: str = "event_type", size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window_start, key, n, total; events later than late are dropped and their state with them."""
    grouped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), key, "n", "total")


def check_batches(origins: DataFrame, ctx: api.Context, out: str) -> DataStreamWriter:
    """The check action on origins (schema.ORIGINS) as they arrive: findings of each batch go to a folder of its own below out.

    A batch that is run again after a failure writes the same folder anew, so findings are there once. The caller names
    the checkpoint and the trigger, and starts it.
    """

    def each(batch: DataFrame, number: int) -> None:
        found = api.identified(api.check(batch, ctx))
        found.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return origins.writeStream.foreachBatch(each)
