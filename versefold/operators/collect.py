"""Planning and resuming a collection: strategies by counts, checkpoints, progress, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versefold.config import ALL_PAGES_LIMIT, TWO_WINDOWS_LIMIT, WINDOW_PAGES
from versefold.functions.urls import partition_key


def country_strategy(n: Column, has_ages: Column) -> Column:
    """How to reach all results of a country: up to 100 all pages, under 200 two windows from both
    ends, else by period where it has any; else it stays unresolved."""
    return F.when(n <= ALL_PAGES_LIMIT, "all-pages").when(n < TWO_WINDOWS_LIMIT, "two-windows").when(has_ages, "by-age").otherwise("unresolved")


def age_strategy(n: Column, configured: Column | None = None) -> Column:
    """The same for a period; a configured 0 needs no request, and a count that isn't the
    configured one is unresolved."""
    plan = F.when(n <= ALL_PAGES_LIMIT, "all-pages").when(n < TWO_WINDOWS_LIMIT, "two-windows").otherwise("by-author")
    if configured is None:
        return plan
    return F.when(configured == 0, "skip").when(configured.isNotNull() & (configured != n), "unresolved").otherwise(plan)


def author_strategy(n: Column) -> Column:
    return F.when(n <= ALL_PAGES_LIMIT, "all-pages").otherwise("unresolved")


def shallow_strategy(n: Column) -> Column:
    """All pages of small partitions; of large ones a window by date from either end."""
    return F.when(n <= ALL_PAGES_LIMIT, "all-pages").otherwise("date-asc-desc-windows")


def plan(counts: DataFrame, has_ages: Column) -> DataFrame:
    """Add strategy and reachable to (country, results): what its strategy can reach by itself."""
    n = F.col("results")
    return counts.withColumns({"strategy": country_strategy(n, has_ages), "reachable": F.least(n, F.lit(TWO_WINDOWS_LIMIT))})


def totals(counts: DataFrame, n: str = "results") -> DataFrame:
    """Configured results, and how many of them two windows a partition can show."""
    return counts.agg(F.sum(n).alias("configured_results"), F.sum(F.least(F.col(n), F.lit(TWO_WINDOWS_LIMIT))).alias("window_capacity"))


def page_requests(partitions: DataFrame, pages: str, capped: bool) -> DataFrame:
    """One row a page to fetch: all, or the first ten of a window; at least the first."""
    last = F.greatest(F.lit(1), F.least(F.col(pages), F.lit(WINDOW_PAGES)) if capped else F.col(pages))
    return partitions.withColumn("page", F.explode(F.sequence(F.lit(1), last)))


def window_requests(partitions: DataFrame, url: str = "url") -> DataFrame:
    """The addresses of the windows by date, ascending (no SortOrder) and descending."""
    tails = F.array(F.lit("&Sort=Date"), F.lit("&Sort=Date&SortOrder=desc"))
    return partitions.select("*", F.posexplode(tails).alias("window", "tail")).withColumn("window_url", F.concat(url, "tail")).drop("tail")


def reopened(keys: DataFrame, countries: list[str], column: str = "key") -> DataFrame:
    """Checkpoint keys that survive a change of the countries' configured counts: their own keys,
    those of their periods, and the recovery windows go. Loose prefixes aren't keys of others."""
    gone = F.col(column).isin("recovery-country-asc", "recovery-country-desc")
    for c in countries:
        gone |= (F.col(column) == f"country={c}") | F.col(column).startswith(f"country={c}&age=")
    return keys.where(~gone)


def reopened_problems(items: DataFrame, countries: list[str], column: str = "partition") -> DataFrame:
    """Unresolved partitions that survive it; here any key that begins with the country's goes,
    so country 2 takes 29 along (kept as the collection has always done it)."""
    gone = F.lit(False)
    for c in countries:
        gone |= F.coalesce(F.col(column), F.lit("")).startswith(f"country={c}")
    return items.where(~gone)


def migrated(keys: DataFrame, column: str = "key") -> DataFrame:
    """Keys of checkpoints v2 and v3 that hold in v4: not the trees of countries 2 and 3, nor
    those of authors and recovery."""
    k = F.col(column)
    return keys.where(~(k.rlike(r"^country=[23](&|$)") | F.contains(k, F.lit("author_uid=")) | k.startswith("recovery-")))


def countries_of(keys: DataFrame, configured: list[str], column: str = "key") -> DataFrame:
    """Country ids of a checkpoint without a list: those of its whole countries and of configured periods,
    in numeric order."""
    own = keys.select(F.nullif(F.regexp_extract(column, r"^country=(\d+)$", 1), F.lit("")).alias("country")).where("country is not null")
    more = keys.sparkSession.createDataFrame([(c,) for c in configured], "country string")
    return own.unionByName(more).distinct().orderBy(F.col("country").cast("int"))


def partition_stats(found: DataFrame, order: str = "seq", configured: DataFrame | None = None) -> DataFrame:
    """(country, age) to URLs collected, and those no earlier partition had. found: country, age,
    url and an order of discovery; configured: country, age, results, which adds every configured
    partition with its results, those that can be expected of two windows, and its strategy."""
    first = found.groupBy("url").agg(F.min(order).alias("__first")).withColumnRenamed("url", "__url")
    rows = found.join(first, found["url"] == first["__url"])
    key = partition_key(F.col("country"), F.col("age"), F.lit(None).cast("string"))
    stats = rows.groupBy(key.alias("partition")).agg(F.count_distinct("url").alias("collected_urls"), F.count_if(F.col(order) == F.col("__first")).alias("new_unique_urls"))
    if configured is None:
        return stats
    n = F.col("results")
    wanted = configured.select(key.alias("partition"), n.alias("configured_results"), F.least(n, F.lit(TWO_WINDOWS_LIMIT)).alias("expected"), shallow_strategy(n).alias("strategy"))
    none = F.lit(0).cast("long")
    return wanted.join(stats, "partition", "full").withColumns({c: F.coalesce(c, none) for c in ("collected_urls", "new_unique_urls")})


def is_complete(unresolved: Column, found: Column, expected: Column) -> Column:
    return (unresolved == 0) & (found == expected)


DONE = ("written", "existing")


def to_fetch(urls: DataFrame, progress: DataFrame, files: DataFrame | None = None, retry: bool = False, overwrite: bool = False, trust: bool = False) -> DataFrame:
    """URLs still to fetch. Done ones are left out if progress is trusted or their output is among
    files (path), skipped ones unless they are retried; overwrite takes all."""
    if overwrite:
        return urls
    state = progress.select(F.col("url").alias("__url"), "status", "output")
    rows = urls.join(state, urls["url"] == state["__url"], "left")
    if trust or files is None:
        there = F.lit(trust)
    else:
        known = files.select(F.col("path").alias("__path"), F.lit(True).alias("__there")).distinct()
        rows = rows.join(known, rows["output"] == known["__path"], "left").drop("__path")
        there = F.coalesce("__there", F.lit(False))
    over = F.coalesce(F.col("status").isin(*DONE) & there, F.lit(False))
    if not retry:
        over |= F.coalesce(F.col("status") == "skipped", F.lit(False))
    return rows.where(~over).select(*urls.columns)


def report(progress: DataFrame, discovered: int | None = None) -> DataFrame:
    """One row: poems discovered, files written, sentence pairs (missing counts as 0), skipped."""
    done = F.col("status").isin(*DONE)
    found = F.count(F.lit(1)) if discovered is None else F.lit(discovered).cast("long")
    pairs = F.coalesce(F.sum(F.when(done, F.coalesce("sentence_pairs", F.lit(0)))), F.lit(0)).cast("long")
    return progress.agg(found.alias("discovered_poems"), F.count_if(done).alias("written_csv_files"), pairs.alias("sentence_pairs"), F.count_if(F.col("status") == "skipped").alias("skipped_poems"))


def skipped(progress: DataFrame) -> DataFrame:
    return progress.where("status = 'skipped'").select("status", "url", "error")
