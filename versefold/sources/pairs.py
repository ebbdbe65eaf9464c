"""Pair files (vi, cn): one reader with a policy for each entry point."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versefold.functions.text import strip


@dataclass(frozen=True)
class Policy:
    """What a reader does with headers and with blank, half-blank and misshapen rows."""

    name: str
    any_columns: bool = False
    legacy: bool = True
    bom: bool = True
    strips: bool = True
    blank: str = "drop"
    half: str = "error"
    width: str = "error"


POLICIES = {
    p.name: p
    for p in (
        Policy("strict"),
        Policy("merge", bom=False, strips=False, blank="error"),
        Policy("lenient", any_columns=True, legacy=False, half="drop", width="ignore"),
        Policy("train", legacy=False, strips=False, blank="error", width="ignore"),
    )
}


#: Cells that typed reading takes for missing.
NOTHING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


class PairFileError(ValueError):
    """A file that its policy doesn't accept, with file and rule."""


def list_files(spark: SparkSession, folder: str, but: str | None = None, pattern: str = "*.csv") -> list[str]:
    """Paths of the folder's files, sorted by name, without the output itself; none is an error."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(f"no folder {folder}")
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(at, pattern)) or []
    names = sorted((str(s.getPath().getName()), str(s.getPath())) for s in found if s.isFile())
    out = [p for name, p in names if but is None or name != but.rsplit("/", 1)[-1]]
    if not out:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return out


def header(spark: SparkSession, path: str) -> list[str]:
    """The names in the first line; a byte order mark, which Spark's reader drops, stays."""
    first = spark.read.text(path).limit(1).collect()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    marked = [stream.read() for _ in range(3)] == [0xEF, 0xBB, 0xBF]
    stream.close()
    return ("\ufeff" * marked + first[0][0].lstrip("\ufeff").rstrip("\r")).split(",") if first else []


def checked_header(names: list[str], policy: Policy, path: str) -> list[str]:
    """The header without a byte order mark and quotes, the legacy name renamed."""
    if names and names[0].startswith("\ufeff"):
        if not policy.bom:
            raise PairFileError(f"{path}: expected CSV header vi,cn")
        names = [names[0][1:], *names[1:]]
    plain = [n.strip('"') for n in names]
    good = {"vi", "cn"} <= set(plain) if policy.any_columns else plain == ["vi", "cn"] or policy.legacy and plain == ["vi", "ch"]
    if not good:
        raise PairFileError(f"{path}: expected CSV header vi,cn, found {','.join(plain)}")
    return ["cn" if n == "ch" and policy.legacy else n for n in plain]


def read_file(spark: SparkSession, path: str, policy: Policy) -> DataFrame:
    """(genre, row_idx, vi, cn, bad): one file's rows with the rule each breaks, or null."""
    names = checked_header(header(spark, path), policy, path)
    schema = ", ".join(f"`{n}` string" for n in names) + ", _bad string"
    raw = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=True)
    raw = raw.withColumn("row_idx", F.monotonically_increasing_id())  # multiLine: a file is one split
    vi, cn = strip(F.col("vi")), strip(F.col("cn"))
    blank, half = (vi == "") & (cn == ""), (vi == "") != (cn == "")
    wide = F.col("_bad").isNotNull() if policy.width == "error" else F.lit(False)
    bad = F.when(wide, "width").when(blank, F.lit("blank")).when(half, F.lit("half"))
    kept = [vi.alias("vi"), cn.alias("cn")] if policy.strips else [F.coalesce("vi", F.lit("")).alias("vi"), F.coalesce("cn", F.lit("")).alias("cn")]
    genre = path.rsplit("/", 1)[-1]
    return raw.select(F.lit(genre).alias("genre"), "row_idx", *kept, bad.alias("bad"))


def read_pairs(spark: SparkSession, paths: list[str], policy: str = "strict", limit: int | None = None) -> DataFrame:
    """(genre, row_idx, vi, cn) of all files in the order of their names. Rows that the policy
    drops are left out; rows that it rejects raise an error with file, record and rule."""
    p, out = POLICIES[policy], None
    for path in sorted(paths, key=lambda x: x.rsplit("/", 1)[-1]):
        one = read_file(spark, path, p)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise FileNotFoundError("no pair files")
    wrong = [rule for rule, does in (("blank", p.blank), ("half", p.half), ("width", p.width)) if does == "error"]
    first = out.where(F.col("bad").isin(wrong)).select("genre", (F.col("row_idx") + 2).alias("record"), "bad").orderBy("genre", "record").limit(1).collect()
    if first:
        n = out.where(F.col("bad") == first[0]["bad"]).count()
        raise PairFileError(f"{first[0]['genre']}:{first[0]['record']}: {first[0]['bad']} row ({n} such rows in all)")
    rows = out.where("bad is null").drop("bad")
    return rows.orderBy("genre", "row_idx").limit(limit) if limit else rows


def violations(rows: DataFrame) -> DataFrame:
    """Rows by rule, of any table with vi and cn."""
    vi, cn = strip(F.col("vi")), strip(F.col("cn"))
    rule = F.when((vi == "") & (cn == ""), "blank").when((vi == "") | (cn == ""), "half").otherwise("full")
    return rows.groupBy(rule.alias("rule")).agg(F.count(F.lit(1)).alias("n_rows"))


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    """vi and cn of a file with typed reading: missing and NA-like cells drop the row."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if not {"vi", "cn"} <= set(raw.columns):
        raise PairFileError(f"{path}: needs columns vi and cn")
    return raw.select(*(F.when(~F.col(c).isin(*NOTHING), F.col(c)).alias(c) for c in ("vi", "cn"))).dropna()


def read_parallel_text(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(line_no, left, right) of two line-aligned text files."""
    lines = [spark.read.text(p, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", name)) for p, name in ((left, "left"), (right, "right"))]
    return lines[0].join(lines[1], "line_no").where("left <> '' or right <> ''")
