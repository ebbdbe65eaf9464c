"""State documents of a collection: URL checkpoints, per-URL progress, reports, vocabularies."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versefold.config import CHECKPOINT_SCHEMAS
from versefold.sources.sinks import write_whole

CHECKPOINT = (
    "schema_version string, source string, strategy string, expected_total long, country_ids array<string>, age_partition_counts map<string, map<string, int>>, "
    "discovered_urls long, completed_partitions array<string>, partition_stats map<string, struct<configured_results: long, expected: long, strategy: string, collected_urls: long, new_unique_urls: long>>, "
    "unresolved_partitions array<struct<partition: string, results: long, error: string>>, complete boolean, urls array<string>"
)
ITEM = "struct<status: string, output: string, title_vi: string, sentence_pairs: long, url: string, error: string>"


PROGRESS_ROWS = "url string, status string, output string, title_vi string, sentence_pairs long, error string"
PROGRESS_COLUMNS = ("url", "status", "output", "title_vi", "sentence_pairs", "error")


class StateError(ValueError):
    """A state document that can't be used."""


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document as a row; a malformed one is an error."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def checkpoint(spark: SparkSession, path: str, source: str, fatal: bool = False) -> DataFrame | None:
    """A URL checkpoint, or None if there is none or it is of another source or schema (an error,
    if fatal); URLs must be a list."""
    if not exists(spark, path):
        if fatal:
            raise StateError(f"{path}: no checkpoint")
        return None
    doc = read_json(spark, path, CHECKPOINT)
    row = doc.select("schema_version", "source", F.col("urls").isNull().alias("no_urls")).first()
    if row is None or row["source"] != source or row["schema_version"] not in CHECKPOINT_SCHEMAS:
        if fatal:
            raise StateError(f"{path}: not a checkpoint of {source}")
        return None
    if row["no_urls"]:
        raise StateError(f"{path}: urls must be a list of strings")
    return doc


def checkpoint_urls(doc: DataFrame) -> DataFrame:
    """(url, url_idx): distinct, in order of first mention."""
    return doc.select(F.posexplode("urls").alias("url_idx", "url")).groupBy("url").agg(F.min("url_idx").alias("url_idx"))


def progress(spark: SparkSession, path: str, source: str, schema_version: str) -> DataFrame:
    """(url, status, output, title_vi, sentence_pairs, error) of a progress document; none without
    one; one of another source or schema is an error."""
    names = PROGRESS_COLUMNS[1:]
    if not exists(spark, path):
        return spark.createDataFrame([], PROGRESS_ROWS)
    doc = read_json(spark, path, f"schema_version string, source string, items map<string, {ITEM}>")
    row = doc.select("schema_version", "source").first()
    if row is None or (row["schema_version"], row["source"]) != (schema_version, source):
        raise StateError(f"{path}: not the progress of {source}")
    items = doc.select(F.explode("items").alias("url", "item")).where("item is not null")
    return items.select("url", *(F.nullif(F.col(f"item.{n}"), F.lit("")).alias(n) if n == "output" else F.col(f"item.{n}").alias(n) for n in names))


def save_progress(path: str, source: str, schema_version: str, items: dict[str, dict]) -> None:
    """Write a progress document whole; entries without a value are left out."""
    kept = {url: {k: v for k, v in item.items() if v is not None and (k != "url" or item["status"] == "skipped")} for url, item in items.items()}
    doc = {"schema_version": schema_version, "source": source, "items": kept}
    write_whole(path, iter([json.dumps(doc, ensure_ascii=False, indent=2) + "\n"]))


def vocabulary_json(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a vocabulary document."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "id"))


def files_below(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
