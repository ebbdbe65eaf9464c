"""Discovery of a genre's poem URLs: rounds of requests, each planned from the pages before it.

A round is a DataFrame of requests whose pages are fetched once, stored, and read by Columns.
Partitions are countries, then periods, then authors; their strategy follows from their counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versefold.config import CHECKPOINT_SCHEMAS, LEAF_AGES, SITE, Genre
from versefold.functions.text import result_count
from versefold.functions.urls import author_catalog_url, author_uid, partition_key, partition_url
from versefold.operators import collect
from versefold.session import stored
from versefold.sources.pages import author_entries, fetched, options, poem_links, total_pages
from versefold.sources.sinks import write_whole

#: The orders in which authors of a partition are listed.
AUTHOR_SORTS = tuple((s, o) for s in ("Author", "Date", "Views", "BirthYear", "DeathYear", "Poster") for o in ("asc", "desc"))
PART = "key string, base string, country string, age string, results long, strategy string"


class DiscoveryError(RuntimeError):
    """Settings that the site doesn't have, or a discovery that isn't complete."""


def page_text(html):
    return F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " ")


def results_of(html):
    """The stated number of results, or else the number of poems listed."""
    return F.coalesce(result_count(page_text(html)), F.size(poem_links(html))).cast("long")


@dataclass
class Discovery:
    """One genre's discovery. `make` builds the fetch function where fetching is done."""

    spark: SparkSession
    genre: Genre
    make: Callable[[], Callable[[str], str]]
    found: list[DataFrame] = field(default_factory=list)
    unresolved: list[DataFrame] = field(default_factory=list)
    done: list[DataFrame] = field(default_factory=list)
    expected: int = 0
    completed: DataFrame | None = None
    country_ids: list[str] = field(default_factory=list)
    whole: bool = False

    # resuming

    def resume(self, doc: DataFrame) -> None:
        """Go on from a checkpoint (one row): its URLs are found, its partitions aren't asked again.
        Partitions of an older schema, of changed counts, and those that weren't resolved are reopened;
        the number of results and the countries are the checkpoint's."""
        row = doc.select("schema_version", "expected_total", "country_ids", "age_partition_counts").first()
        problems = doc.select(F.explode("unresolved_partitions").alias("p")).select("p.partition").where("partition is not null")
        keys = doc.select(F.explode(F.coalesce("completed_partitions", F.array().cast("array<string>"))).alias("key")).distinct()
        ids = [c for c in row["country_ids"] or [] if c.isdigit()]
        ids = list(self.genre.countries or ids) or [r[0] for r in collect.countries_of(keys, sorted(LEAF_AGES)).collect()]
        if self.genre.ages and (row["age_partition_counts"] or {}) != self.genre.ages:
            keys, problems = (f(df, sorted(self.genre.ages)) for f, df in ((collect.reopened, keys), (collect.reopened_problems, problems)))
        if row["schema_version"] != CHECKPOINT_SCHEMAS[-1]:
            keys = collect.migrated(keys)
        again = problems.select(F.explode(F.array("partition", F.split_part("partition", F.lit("&age="), F.lit(1)))).alias("key"))
        self.completed = stored(keys.join(again, "key", "left_anti"), "completed")
        self.done.append(self.completed)
        self.expected, self.country_ids = row["expected_total"] or 0, ids
        if self.genre.mode != "shallow" and (self.expected <= 0 or not ids):
            raise DiscoveryError("the checkpoint has no number of results or no countries")
        at = F.struct(F.lit(0).alias("page"), F.col("url_idx").cast("int").alias("pos"))
        urls = doc.select(F.posexplode("urls").alias("url_idx", "url")).groupBy("url").agg(F.min("url_idx").alias("url_idx"))
        self.keep(stored(urls.select(F.lit("").alias("key"), "url", at.alias("at")), "known"))

    def still_open(self, parts: DataFrame) -> DataFrame:
        return parts if self.completed is None else parts.join(self.completed, "key", "left_anti")

    # requests

    def pages(self, requests: DataFrame, url: str = "url") -> DataFrame:
        """requests with html; equal URLs are fetched once."""
        requests = stored(requests, "requests")
        got = fetched(requests.select(F.col(url).alias("url")).distinct().orderBy("url"), self.make)
        return stored(requests.join(got.withColumnRenamed("url", "__url"), F.col(url) == F.col("__url")).drop("__url"), "pages")

    def listing(self, parts: DataFrame, url: str, capped: bool) -> DataFrame:
        """(key, url, at): poems on all pages of each partition, or the first ten."""
        first = self.pages(parts.select("key", F.col(url).alias("first")), "first")
        more = collect.page_requests(first.select("key", "first", total_pages(F.col("html")).alias("n")), "n", capped).where("page > 1")
        rest = self.pages(more.select("key", F.concat("first", F.lit("&Page="), "page").alias("next"), "page"), "next")
        every = first.select("key", F.lit(1).alias("page"), "html").unionByName(rest.select("key", "page", "html"))
        rows = every.select("key", "page", F.posexplode(poem_links(F.col("html"))).alias("pos", "url"))
        return stored(rows.groupBy("key", "url").agg(F.min(F.struct("page", "pos")).alias("at")), "listing")

    def counted(self, parts: DataFrame) -> DataFrame:
        """Partitions with their results, from their first pages."""
        return self.pages(parts, "base").withColumn("results", results_of(F.col("html"))).drop("html")

    # strategies

    def resolved(self, parts: DataFrame) -> DataFrame:
        """Collect partitions whose strategy is all-pages or two-windows; returns those whose
        windows don't cover them."""
        parts = stored(parts.selectExpr("key", "base", "country", "age", "results", "strategy"), "parts")
        small = parts.where("strategy in ('all-pages', 'skip')")
        self.keep(self.listing(small.where("strategy = 'all-pages'"), "base", False))
        two = parts.where("strategy = 'two-windows'")
        windows = collect.window_requests(two, "base").select("key", "window_url")
        rows = self.listing(windows, "window_url", True)
        n = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        judged = two.join(n, "key", "left").withColumn("whole", F.coalesce(F.col("n") == F.col("results"), F.lit(False)))
        whole = stored(judged.where("whole").select("key"), "whole")
        self.keep(rows.join(whole, "key", "left_semi"))
        self.done += [small.select("key"), whole]
        return stored(judged.where("not whole").drop("n", "whole"), "short")

    def keep(self, rows: DataFrame) -> None:
        self.found.append(rows.select("key", "url", F.struct(F.lit(len(self.found)).alias("round"), "key", "at").alias("seq")))

    def give_up(self, parts: DataFrame, why: str) -> None:
        self.unresolved.append(parts.select(F.col("key").alias("partition"), "results", F.lit(why).alias("error")))

    def partitions(self, rows: DataFrame) -> DataFrame:
        """Keys and addresses of (country, age)."""
        search, none = F.lit(self.genre.search_url), F.lit(None).cast("string")
        return rows.select(partition_key(F.col("country"), F.col("age"), none).alias("key"), partition_url(search, F.col("country"), F.col("age")).alias("base"), "country", "age")

    def countries(self) -> DataFrame:
        """The requested countries; one that the form doesn't have is an error. The checkpoint's, if
        there is one: then the form isn't read again."""
        if self.country_ids:
            return self.spark.createDataFrame([(c, None) for c in self.country_ids], "country string, age string")
        form = self.pages(self.spark.createDataFrame([(self.genre.search_url,)], "url string"))
        row = form.select(options(F.col("html"), "Country").alias("c"), results_of(F.col("html")).alias("n")).first()
        wanted = list(self.genre.countries or row["c"])
        if missing := sorted(set(wanted) - set(row["c"])):
            raise DiscoveryError(f"no countries {missing}")
        self.expected, self.country_ids = row["n"], wanted
        return self.spark.createDataFrame([(c, None) for c in wanted], "country string, age string")

    def ages(self, countries: DataFrame) -> DataFrame:
        """Periods of countries with the configured count, if any."""
        known = [(c, a, self.genre.ages.get(c, {}).get(a)) for c, ages in (LEAF_AGES | self.genre.ages).items() for a in ages]
        table = self.spark.createDataFrame(known, "country string, age string, configured long")
        return countries.select("country").join(table, "country")

    def by_age(self, countries: DataFrame) -> None:
        ages = stored(self.ages(countries), "ages")
        parts = self.still_open(self.partitions(ages)).join(ages, ["country", "age"])
        zero = parts.where("configured = 0").select("key", "base", "country", "age", F.lit(0).cast("long").alias("results"), F.lit("skip").alias("strategy"))
        asked = self.counted(parts.where("configured is null or configured <> 0"))
        judged = stored(asked.withColumn("strategy", collect.age_strategy(F.col("results"), F.col("configured"))), "judged")
        self.give_up(judged.where("strategy = 'unresolved'"), "count isn't the configured one")
        short = self.resolved(zero.unionByName(judged.drop("configured").where("strategy in ('all-pages', 'two-windows')")))
        self.by_author(judged.drop("configured").where("strategy = 'by-author'").unionByName(short))

    def by_author(self, parts: DataFrame) -> None:
        """All authors of a partition, listed in turn in each order until there are enough."""
        parts = stored(parts, "byauthor")
        known: DataFrame | None = None
        left = parts.select("key", "country", "age")
        for sort, order in AUTHOR_SORTS:
            if not left.limit(1).count():
                break
            url = author_catalog_url(F.col("country"), F.col("age"), F.lit(sort), F.lit(order))
            first = self.pages(left.withColumn("first", url), "first")
            more = collect.page_requests(first.withColumn("n", total_pages(F.col("html"))).drop("html"), "n", True).where("page > 1")
            rest = self.pages(more.withColumn("next", F.concat("first", F.lit("&Page="), "page")), "next")
            every = first.select("key", "html").unionByName(rest.select("key", "html"))
            rows = every.select("key", F.explode(F.map_keys(author_entries(F.col("html")))).alias("author"))
            stated = F.regexp_extract(page_text(F.col("html")), r"tổng số\s+\d+\s+trang\s+\(([\d.]+)\s+tác giả\)", 1)
            want = first.select("key", F.replace(stated, F.lit("."), F.lit("")).try_cast("long").alias("want"))
            known = stored((rows if known is None else known.unionByName(rows)).distinct(), "authors")
            have = known.groupBy("key").agg(F.count(F.lit(1)).alias("have"))
            left = stored(left.join(want, "key").join(have, "key", "left").where("coalesce(have, 0) < want").select("key", "country", "age"), "left")
        if known is None:
            return
        self.give_up(parts.join(left, "key", "left_semi"), "not all authors found")
        good = parts.select("key", "country", "age").join(left, "key", "left_anti")
        uid = author_uid(F.col("author"))
        each = known.join(good, "key").select(partition_key(F.col("country"), F.col("age"), uid).alias("key"), F.concat(partition_url(F.lit(self.genre.search_url), F.col("country"), F.col("age")), F.lit("&IAuthor="), F.url_encode(uid)).alias("base"), "country", "age")
        judged = stored(self.counted(self.still_open(each)).withColumn("strategy", collect.author_strategy(F.col("results"))), "authorparts")
        self.give_up(judged.where("strategy = 'unresolved'"), "more than a window by one author")
        self.resolved(judged.where("strategy = 'all-pages'"))
        self.done += [judged.where("strategy = 'unresolved'").select("key"), good.select("key")]

    # whole discoveries

    def country_age(self) -> DataFrame:
        countries = self.counted(self.still_open(self.partitions(self.countries())))
        has_ages = F.col("country").isin(*(LEAF_AGES | self.genre.ages))
        judged = stored(countries.withColumn("strategy", collect.country_strategy(F.col("results"), has_ages)), "countries")
        short = self.resolved(judged.where("strategy in ('all-pages', 'two-windows')"))
        deep = judged.where("strategy = 'by-age'").unionByName(short.where(has_ages))
        self.give_up(judged.where("strategy = 'unresolved'").unionByName(short.where(~has_ages)), "too many results")
        if deep.limit(1).count():
            self.by_age(stored(deep, "deep"))
        if self.urls().count() < self.expected:
            self.recover()
        return self.urls()

    def recover(self) -> None:
        """Poems without a country come first or last when all are sorted by it."""
        tails = [("recovery-country-asc", "&Sort=Country"), ("recovery-country-desc", "&Sort=Country&SortOrder=desc")]
        parts = self.still_open(self.spark.createDataFrame([(k, self.genre.search_url + t) for k, t in tails], "key string, base string"))
        self.keep(self.listing(parts, "base", True))
        self.done.append(parts.select("key"))

    def shallow(self, countries: list[str] | None = None) -> DataFrame:
        """Configured partitions only: all pages of small ones, two windows of large ones."""
        wanted = countries or list(self.genre.ages)
        if missing := sorted(set(wanted) - set(self.genre.ages)):
            raise DiscoveryError(f"no counts are configured for countries {missing}")
        rows = self.spark.createDataFrame([(c, a, n) for c in wanted for a, n in self.genre.ages[c].items()], "country string, age string, results long")
        self.expected = rows.agg(F.sum("results")).first()[0]
        parts = stored(self.still_open(self.partitions(rows)).join(rows, ["country", "age"]).withColumn("strategy", collect.shallow_strategy(F.col("results"))), "shallow")
        self.keep(self.listing(parts.where("strategy = 'all-pages'"), "base", False))
        windows = collect.window_requests(parts.where("strategy <> 'all-pages'"), "base")
        self.keep(self.listing(windows.select("key", "window_url"), "window_url", True))
        self.done.append(parts.select("key"))
        self.whole = True
        return self.urls()

    def urls(self) -> DataFrame:
        """(url, seq): distinct, by where each was found first."""
        rows = self.spark.createDataFrame([], "url string, seq struct<round:int,key:string,at:struct<page:int,pos:int>>")
        for more in [f.select("url", "seq") for f in self.found]:
            rows = rows.unionByName(more)
        return rows.groupBy("url").agg(F.min("seq").alias("seq"))

    def problems(self) -> DataFrame:
        out = self.spark.createDataFrame([], "partition string, results long, error string")
        for more in self.unresolved:
            out = out.unionByName(more)
        return out

    def stats(self) -> list:
        """Each partition's URLs, and those that none before had. One row a partition."""
        first = self.urls().select(F.col("url").alias("__url"), F.col("seq").alias("__first"))
        rows = self.spark.createDataFrame([], "key string, url string, seq struct<round:int,key:string,at:struct<page:int,pos:int>>")
        for more in self.found:
            rows = rows.unionByName(more.select("key", "url", "seq"))
        rows = rows.where("key <> ''").join(first, F.col("url") == F.col("__url"))
        return rows.groupBy("key").agg(F.count_distinct("url").alias("collected_urls"), F.count_if(F.col("seq") == F.col("__first")).alias("new_unique_urls")).orderBy("key").collect()

    def is_complete(self) -> bool:
        """Shallow: all configured partitions are done. Else: none is unresolved and all results are
        found."""
        if self.genre.mode == "shallow":
            return self.whole
        return not self.problems().limit(1).count() and self.urls().count() == self.expected

    def save(self, path: str, source: str) -> bool:
        """Write the checkpoint document; returns whether the discovery is complete."""
        import json

        rows = [r["url"] for r in self.urls().orderBy("seq").select("url").toLocalIterator()]
        done = sorted({r["key"] for d in self.done for r in d.collect()})
        doc = {"schema_version": CHECKPOINT_SCHEMAS[-1], "source": source, "strategy": self.genre.mode, "expected_total": self.expected, "country_ids": self.country_ids, "age_partition_counts": self.genre.ages, "discovered_urls": len(rows), "completed_partitions": done, "partition_stats": {r["key"]: {k: r[k] for k in ("collected_urls", "new_unique_urls")} for r in self.stats()}, "unresolved_partitions": [r.asDict() for r in self.problems().collect()], "complete": self.is_complete(), "urls": rows}
        write_whole(path, iter([json.dumps(doc, ensure_ascii=False, indent=2) + "\n"]))
        return doc["complete"]


def group_tree(spark: SparkSession, start: str, make: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(url, at): poems of a group page and of its sections, in order."""
    from versefold.sources.pages import group_links

    top = stored(fetched(spark.createDataFrame([(start,)], "url string"), make), "group")
    sections, _ = group_links(F.col("html"))
    wanted = stored(top.select(F.posexplode(sections).alias("section", "url")), "sections")
    below = stored(fetched(wanted.select("url"), make), "sectionpages")
    every = below.join(wanted, "url").select("section", "html").unionByName(top.select(F.lit(-1).alias("section"), "html"))
    _, poems = group_links(F.col("html"))
    rows = every.select("section", F.posexplode(poems).alias("pos", "url"))
    return rows.groupBy("url").agg(F.min(F.struct("section", "pos")).alias("at"))


def limited(spark: SparkSession, genre: Genre, make: Callable[[], Callable[[str], str]], n: int) -> DataFrame:
    """The first n poems of the plain search; no checkpoint is read or written."""
    d = Discovery(spark, genre, make)
    one = spark.createDataFrame([("limit", genre.search_url)], "key string, base string")
    return d.listing(one, "base", True).orderBy("at").limit(n)


__all__ = ["AUTHOR_SORTS", "Discovery", "DiscoveryError", "SITE", "group_tree", "limited"]
