"""Stratified splits: largest-remainder sizes and a seeded order within each stratum."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versefold.config import RATIOS, SEED, SPLITS
from versefold.operators.ordering import dense_numbers


def checked_ratios(ratios: Sequence[float]) -> tuple[float, ...]:
    if len(ratios) != len(SPLITS):
        raise ValueError(f"expected {len(SPLITS)} ratios")
    if any(not math.isfinite(r) or r <= 0 for r in ratios):
        raise ValueError("ratios must be finite and greater than zero")
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError(f"ratios must sum to 1.0, not {sum(ratios):g}")
    return tuple(ratios)


def sizes(n: Column, ratios: Sequence[float] = RATIOS) -> Column:
    """Sizes of train, test and val for n rows: floors of the quotas, what is left to the largest
    fractions (ties: larger ratio, earlier split), then one row to each empty split from the
    largest (ties: larger ratio, earlier split). Under three rows it is an error."""
    names = SPLITS
    quota = F.array(*(F.struct((n * F.lit(r)).alias("q"), F.lit(r).alias("r"), F.lit(i).alias("i")) for i, r in enumerate(checked_ratios(ratios))))
    floor = lambda x: F.floor(x["q"])
    rest = n - F.aggregate(F.transform(quota, floor), F.lit(0).cast("long"), lambda a, x: a + x)
    ranked = F.transform(F.sort_array(F.transform(quota, lambda x: F.struct((x["q"] - floor(x)).alias("f"), x["r"].alias("r"), (-x["i"]).alias("m"))), asc=False), lambda x: -x["m"])
    first = F.transform(quota, lambda x: floor(x) + F.when(F.array_position(ranked, x["i"]) <= rest, 1).otherwise(0))

    def filled(now: Column, k: Column) -> Column:
        keyed = F.transform(now, lambda s, i: F.struct(s.alias("s"), F.element_at(F.array(*map(F.lit, ratios)), i + 1).alias("r"), (-i).alias("m")))
        donor = -F.array_max(keyed)["m"]
        moved = F.transform(now, lambda s, i: s + F.when(i == k, 1).otherwise(0) - F.when(i == donor, 1).otherwise(0))
        return F.when(F.element_at(now, k + 1) == 0, moved).otherwise(now)

    out = F.aggregate(F.array(*map(F.lit, range(len(names)))), first, filled)
    return F.when(n >= len(names), out).otherwise(F.raise_error(F.format_string("need at least 3 rows to fill every split; found %d", n)).cast("array<bigint>"))


def stratum_key(stratum: Column, row: Column, seed: int = SEED) -> Column:
    """The hash that orders rows within their stratum: other strata don't matter."""
    return F.sha2(F.concat(F.lit(f"{seed}\0"), stratum, F.lit("\0"), row.cast("string")).cast("binary"), 256)


def stratum_seed(stratum: Column, seed: int = SEED) -> Column:
    """The unsigned 64-bit seed of a stratum's exact shuffle, as a decimal."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}\0"), stratum).cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def split(rows: DataFrame, stratum: str, row: str, ratios: Sequence[float] = RATIOS, seed: int = SEED) -> DataFrame:
    """Add split and rank (from 1 in the stratum's seeded order): the first rows are train, then
    test, then val. Ranks go by the leading hex digits of the key, so that a stratum of any size
    is spread over tasks."""
    keyed = rows.withColumn("__key", stratum_key(F.col(stratum), F.col(row), seed))
    ranked = dense_numbers(keyed, F.substring("__key", 1, 3), [F.col("__key"), F.col(row)], "rank", [stratum])
    counts = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n")).select(F.col(stratum).alias("__s"), sizes(F.col("__n"), ratios).alias("__sizes"))
    train, test = F.col("__sizes")[0], F.col("__sizes")[0] + F.col("__sizes")[1]
    name = F.when(F.col("rank") <= train, SPLITS[0]).when(F.col("rank") <= test, SPLITS[1]).otherwise(SPLITS[2])
    return ranked.join(counts, ranked[stratum].eqNullSafe(counts["__s"])).withColumn("split", name).drop("__key", "__s", "__sizes")


def exact_seed(seed: int, stratum: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}\0{stratum}".encode()).digest()[:8], "big")


def exact_split(rows: DataFrame, stratum: str, row: str, ratios: Sequence[float] = RATIOS, seed: int = SEED) -> DataFrame:
    """The same with the standard library's seeded shuffle of a stratum, bit for bit; a stratum
    must fit a task, so it is for small corpora. Rows: (stratum, row) only."""

    def run(key: tuple[pa.Scalar], t: pa.Table) -> pa.Table:
        order = sorted(t.column(row).to_pylist())
        random.Random(exact_seed(seed, key[0].as_py())).shuffle(order)
        return pa.table({stratum: [key[0].as_py()] * len(order), row: order, "rank": pa.array(range(1, len(order) + 1), pa.int64())})

    one = rows.select(stratum, row)
    ranked = one.groupBy(stratum).applyInArrow(run, f"{stratum} string, {row} long, rank long")
    counts = rows.groupBy(stratum).agg(sizes(F.count(F.lit(1)), ratios).alias("s")).withColumnRenamed(stratum, "__s")
    name = F.when(F.col("rank") <= F.col("s")[0], SPLITS[0]).when(F.col("rank") <= F.col("s")[0] + F.col("s")[1], SPLITS[1]).otherwise(SPLITS[2])
    return ranked.join(counts, ranked[stratum] == counts["__s"]).withColumn("split", name).drop("__s", "s")


def final_order(rows: DataFrame, row: str, seed: int = SEED) -> DataFrame:
    """Add a key that mixes the strata of each split, by the seed plus the split's number."""
    number = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split")) - 1
    return rows.withColumn("mix_key", F.sha2(F.concat((F.lit(seed) + number).cast("string"), F.lit("\0"), F.col(row).cast("string")).cast("binary"), 256))


def split_counts(rows: DataFrame, stratum: str) -> DataFrame:
    """Rows by stratum and split, with sums by stratum and in all (nulls)."""
    return rows.rollup(stratum, "split").agg(F.count(F.lit(1)).alias("n_rows"))
