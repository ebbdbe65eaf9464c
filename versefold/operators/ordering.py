"""Order made explicit: dense ranks of large tables, first-seen and last-write rules, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_numbers(df: DataFrame, coarse: Column, order: list[Column], out: str = "row", by: list[str] | None = None) -> DataFrame:
    """Numbers from 1 in the order (coarse, order), per group `by` if given. `coarse` must not
    fall in that order and have few values: rows are numbered within each of its values and
    shifted by the counts of those before, so no task sees all rows."""
    by = by or []
    rows = df.withColumn("__coarse", coarse)
    counts = rows.groupBy(*by, "__coarse").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__coarse").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), F.col("__coarse").alias("__at"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    on = rows["__coarse"].eqNullSafe(shift["__at"])
    for i, c in enumerate(by):
        on &= rows[c].eqNullSafe(shift[f"__by{i}"])
    joined = rows.join(shift, on)
    within = Window.partitionBy(*by, "__coarse").orderBy(*order)
    numbered = joined.withColumn(out, (F.row_number().over(within) + F.col("__before")).cast("long"))
    return numbered.drop("__coarse", "__at", "__before", *(f"__by{i}" for i in range(len(by))))


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys, each with the least order it occurs at."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def last_write(df: DataFrame, key: str, seq: str, values: list[str]) -> DataFrame:
    """Each key's values at its largest seq, with the seq it was first written at."""
    best = F.max(F.struct(seq, *values)).alias("__m")
    return df.groupBy(key).agg(best, F.min(seq).alias(f"first_{seq}")).select(key, *(F.col(f"__m.{v}").alias(v) for v in values), f"first_{seq}")


def sampled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a seeded hash of their key; a smaller n gives a prefix of a larger one's."""
    ticket = F.sha2(F.concat_ws("\0", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"), 256)
    return df.withColumn("ticket", ticket).orderBy("ticket", key).limit(n)


def prefix(df: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first n rows; all of them for None or 0."""
    return df.orderBy(*order).limit(n) if n else df


def crossings(df: DataFrame, done: str, total: int, size: int, every: int) -> DataFrame:
    """Batches after which progress is told, by how many rows are done: the last one, and those in
    which a multiple of `every` was passed (none for 0)."""
    passed = F.col(done) % every < size if every else F.lit(False)
    return df.where((F.col(done) == total) | passed)


def stem_names(df: DataFrame, stem: str, uid: str, order: str, with_uid, taken: DataFrame | None = None) -> DataFrame:
    """`name`: the stem for its first user, the stem with the uid for later ones and for all users
    of a stem that is taken already (column `stem`)."""
    first = df.groupBy(stem).agg(F.min(order).alias("__first")).withColumnRenamed(stem, "__stem")
    if taken is not None:
        first = first.join(taken.select(F.col("stem").alias("__taken")).distinct(), F.col("__stem") == F.col("__taken"), "left")
        first = first.withColumn("__first", F.when(F.col("__taken").isNull(), F.col("__first"))).drop("__taken")
    rows = df.join(first, df[stem].eqNullSafe(first["__stem"]))
    own = F.coalesce(F.col(order) == F.col("__first"), F.lit(False))
    return rows.withColumn("name", F.when(own, F.col(stem)).otherwise(with_uid(F.col(stem), F.col(uid)))).drop("__first", "__stem")
