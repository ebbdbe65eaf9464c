"""Sinks: files that appear whole or not at all, written by one ordered task or as folders."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versefold.operators.vocab import SOURCE_SPECIALS, with_specials


def write_whole(path: str, pieces: Iterator[str]) -> None:
    """Write beside the target and rename; on failure the target is as it was."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(prefix=f".{os.path.basename(path)}.", dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            for piece in pieces:
                f.write(piece)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def csv_line(values: list) -> str:
    """One CSV record: quoted where needed, booleans as True and False."""
    out = []
    for v in values:
        s = "" if v is None else str(v)
        out.append('"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\r\n') else s)
    return ",".join(out) + "\n"


def export_csv(df: DataFrame, path: str, order: list[str], columns: list[str] | None = None) -> int:
    """One ordered CSV file for people; rows come to the driver a partition at a time. Returns
    how many. Large results are better kept as folders (write_csv)."""
    columns, n = columns or df.columns, 0

    def pieces() -> Iterator[str]:
        nonlocal n
        yield csv_line(columns)
        for row in df.orderBy(*order).select(*columns).toLocalIterator():
            n += 1
            yield csv_line(list(row))

    write_whole(path, pieces())
    return n


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of CSV parts, put in place by Spark's committer."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_poems(pairs: DataFrame, path: str, overwrite: bool = False) -> None:
    """Pairs (name, pos, vi, cn) as a folder for each poem. A poem that is there already is replaced
    if told, else an error; all others stay as they are."""
    ordered = pairs.repartition("name").sortWithinPartitions("name", "pos")
    if not overwrite:
        there = existing_poems(pairs.sparkSession, path)
        if again := pairs.select("name").distinct().join(there, "name", "left_semi").limit(1).collect():
            raise FileExistsError(f"{path}: {again[0]['name']} exists")
    out = ordered.select("name", "vi", "cn").write.partitionBy("name").option("header", True).option("escape", '"')
    out.option("partitionOverwriteMode", "dynamic").mode("overwrite" if overwrite else "append").csv(path)


def existing_poems(spark: SparkSession, path: str) -> DataFrame:
    """(name) of the poems in a folder of write_poems."""
    at = os.path.join(path, "*", "part-*.csv")
    try:
        files = spark.read.format("binaryFile").load(at).select("path")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "name string")
    return files.select(F.url_decode(F.regexp_extract("path", r"/name=([^/]*)/[^/]*$", 1)).alias("name")).distinct()


def export_json(df: DataFrame, path: str, **more) -> None:
    """A one-row result as an indented JSON document, with more entries after its own."""
    row = df.first().asDict(recursive=True) | more
    write_whole(path, iter([json.dumps(row, ensure_ascii=False, indent=2, default=str) + "\n"]))


def export_report(report: DataFrame, skipped: DataFrame, path: str, schema_version: str, source: str) -> None:
    """A collection's report: schema, source, totals, and the skipped poems, which are written one
    by one after the totals."""
    head = {"schema_version": schema_version, "source": source} | report.first().asDict()

    def pieces() -> Iterator[str]:
        yield json.dumps(head, ensure_ascii=False, indent=2)[:-2] + ',\n  "skipped": ['
        mark = "\n"
        for r in skipped.toLocalIterator():
            yield mark + "    " + json.dumps(r.asDict(), ensure_ascii=False)
            mark = ",\n"
        yield ("" if mark == "\n" else "\n  ") + "]\n}\n"

    write_whole(path, pieces())


def export_predictions(rows: DataFrame, path: str) -> int:
    """Predictions with their scores (metrics.details) in the order of row_idx."""
    columns = ["vi", "cn_ref", "cn_pred", "exact_match", "edit_distance", "substitutions", "deletions", "insertions", "news_fscore"]
    return export_csv(rows, path, ["row_idx"], columns)


def export_vocabulary(vocab: DataFrame, path: str, specials: tuple[str, ...] = SOURCE_SPECIALS) -> None:
    """token: id in order of ids, specials first."""

    def pieces() -> Iterator[str]:
        mark = "{\n"
        for r in with_specials(vocab, specials).orderBy("id").toLocalIterator():
            yield f"{mark}  {json.dumps(r['token'], ensure_ascii=False)}: {r['id']}"
            mark = ",\n"
        yield "\n}" if mark == ",\n" else "{}"

    write_whole(path, pieces())


def rewrite_lines(lines: DataFrame, path: str, dry_run: bool = False) -> int:
    """Lines (value, line_no, removed) without the removed ones over the file they came from, its
    mode kept; nothing is written if nothing goes or in a dry run. Returns how many went."""
    gone = lines.where("removed").count()
    if gone and not dry_run:
        mode = os.stat(path).st_mode
        write_whole(path, (r["value"] for r in lines.where("not removed").orderBy("line_no").select("value").toLocalIterator()))
        os.chmod(path, mode)
    return gone


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no) of a text file, line ends kept as they are. Lines are read by splits; their
    numbers grow with their place in the file, but aren't dense. The last line's end is what the
    file's last byte says."""
    lines = spark.read.option("lineSep", "\n").text(path).withColumn("line_no", F.monotonically_increasing_id())
    with open(path, "rb") as f:
        f.seek(0, os.SEEK_END)
        ended = f.tell() == 0 or (f.seek(-1, os.SEEK_END), f.read(1))[1] == b"\n"
    last = None if ended else lines.agg(F.max("line_no")).first()[0]
    end = F.lit("\n") if ended else F.when(F.col("line_no") == last, "").otherwise("\n")
    return lines.select(F.concat("value", end).alias("value"), "line_no")
