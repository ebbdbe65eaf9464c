"""Set operations between tables by key: new, missing, kept and removed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versefold.functions.urls import author_from_url, is_poem_url


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of left that right lacks."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def missing(wanted: DataFrame, available: DataFrame, key: str) -> list:
    """Wanted keys that aren't available, sorted: none means a subset. For small sets of settings."""
    return sorted(r[0] for r in difference(wanted, available, key).collect())


def ordered_union(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """Union distinct by key; the order of a key is its first part's, then its own there."""
    tagged = [p.select(key, F.struct(F.lit(i).alias("part"), F.col(order).alias("at")).alias(order)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.min(order).alias(order))


def should_remove(url: Column, author_known: Column, scope: str) -> Column:
    """A listed author's URL: all of them, or only poems."""
    return author_known if scope == "all" else author_known & is_poem_url(url)


def sitemap(lines: DataFrame, authors: DataFrame, scope: str = "poem", hosts: tuple[str, ...] | None = None) -> DataFrame:
    """Add `removed` to lines (value): those whose <loc> is of a listed author (column author)."""
    url = F.regexp_extract("value", "<loc>([^<]+)</loc>", 1)
    author = author_from_url(url, hosts) if hosts else author_from_url(url)
    rows = lines.withColumns({"__url": url, "__author": author})
    known = authors.select(F.col("author").alias("__a")).distinct()
    hit = rows.join(known, rows["__author"] == known["__a"], "left")
    return hit.withColumn("removed", F.coalesce(should_remove(F.col("__url"), F.col("__a").isNotNull(), scope), F.lit(False))).drop("__url", "__author", "__a")
