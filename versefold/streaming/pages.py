"""Incremental processing: fetched pages as a stream, with progress merged batch by batch.

An extension: the collection has no event time; the stream replaces its per-poem state file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versefold.sources.pages import poems

STATE = "url string, status string, output string, title_vi string, sentence_pairs long, error string, seq long"


def outcome(pages: DataFrame, seq: int) -> DataFrame:
    """Progress rows of pages: written with the number of pairs, or skipped with the error."""
    p = poems(pages)
    good = F.col("error").isNull()
    return p.select("url", F.when(good, "written").otherwise("skipped").alias("status"), F.when(good, F.concat("uid", F.lit(".csv"))).alias("output"), "title_vi", F.when(good, F.size("lines_vi")).cast("long").alias("sentence_pairs"), "error", F.lit(seq).cast("long").alias("seq"))


def latest(spark: SparkSession, state: str) -> DataFrame:
    """The last outcome of each URL in the state folder."""
    rows = spark.read.schema(STATE).parquet(state)
    names = [f.name for f in rows.schema if f.name not in ("url", "seq")]
    best = F.max(F.struct("seq", *names)).alias("m")
    return rows.groupBy("url").agg(best).select("url", *(F.col(f"m.{n}").alias(n) for n in names))


def follow(spark: SparkSession, inbox: str, state: str, checkpoint: str):
    """Process what has arrived in the inbox (Parquet: url, html) since the last call, and append
    the outcomes to the state folder: a batch that is run again writes the same folder again."""

    def merge(batch: DataFrame, number: int) -> None:
        outcome(batch, number).write.mode("overwrite").parquet(f"{state}/batch={number}")

    stream = spark.readStream.schema("url string, html string").parquet(inbox)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
