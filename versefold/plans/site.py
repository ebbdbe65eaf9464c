"""Registered queries on pages, addresses and collection state, made of the shared test tables:
parts and customers stand in for poems and authors, and their pages are built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versefold import config
from versefold.functions import text, urls
from versefold.operators import collect, ordering, sets
from versefold.plans.catalog import COUNTS_SQL, STATUS_SQL, market, norm_sql, progress_state, query, quoted
from versefold.sources import pages

SITE = quoted(config.SITE)
#: Ten parts make a page; their links, in the order of keys.
LISTED_SQL = "parts AS (SELECT p_partkey // 10 AS page, p_partkey AS k, p_partkey % 10 AS pos, p_name AS name, p_partkey % 3 AS kind FROM part)"


def gathered(rows: DataFrame, page: Column, order: str, piece: Column, before: Column, after: Column) -> DataFrame:
    """(page, html): each page's pieces in order, between a head and a foot."""
    pieces = F.transform(F.sort_array(F.collect_list(F.struct(order, piece.alias("s")))), lambda x: x["s"])
    return rows.groupBy(page.alias("page")).agg(F.concat(before, F.array_join(pieces, "\n"), after).alias("html"))


def list_item(href: Column, name: Column) -> Column:
    return F.concat(F.lit('<h4 class="x list-item-header">\n<a title="t" href="'), href, F.lit('"><b>'), name, F.lit("</b></a></h4>"))


def listing_pages(t) -> DataFrame:
    """Result pages: poems, authors, and every tenth poem mentioned twice, with a page select."""
    k = F.col("p_partkey")
    href = F.when(k % 3 == 0, F.concat(F.lit("/x/author-a"), k)).when(k % 3 == 1, F.concat(F.lit("/x/poem-p"), k)).otherwise(F.concat(F.lit(f"{config.SITE}/y/poem-p"), k, F.lit("?a=1&amp;b=2")))
    twice = F.when(k % 10 == 4, F.concat(list_item(href, F.col("p_name")), list_item(href, F.lit("again")))).otherwise(list_item(href, F.col("p_name")))
    page = F.floor(k / 10)
    foot = F.concat(F.lit('<select name="Page"><option value="1">1</option><option value="'), F.first(page), F.lit('"></select><a href="?q=1&amp;Page='), F.first(page * 7 % 100), F.lit('">n</a><a href="/x/poem-other">o</a>'))
    return gathered(t("part").select("p_partkey", "p_name"), page, "p_partkey", twice, F.lit("<html>"), foot)


@query(f"WITH {LISTED_SQL} SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY k) - 1 AS INTEGER) AS pos, {SITE} || CASE kind WHEN 1 THEN '/x/poem-p' || k ELSE '/y/poem-p' || k || '?a=1&b=2' END AS url, 'p' || k AS uid FROM parts WHERE kind > 0")
def search_page(t) -> DataFrame:
    """Poem links of result pages."""
    rows = listing_pages(t).select("page", F.posexplode(pages.poem_links(F.col("html"))).alias("pos", "url"))
    return rows.select("page", "pos", "url", urls.poem_uid(F.col("url")).alias("uid"))


@query(f"WITH {LISTED_SQL} SELECT page, CAST(greatest(1, page, page * 7 % 100) AS INTEGER) AS total_pages FROM parts GROUP BY page")
def total_pages(t) -> DataFrame:
    return listing_pages(t).select("page", pages.total_pages(F.col("html")).alias("total_pages"))


@query("SELECT r_regionkey AS region, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS countries FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def country_options(t) -> DataFrame:
    """Countries of search forms."""
    option = F.concat(F.lit('<option value="'), F.col("n_nationkey"), F.lit('">'), F.col("n_name"), F.lit("</option>"))
    forms = gathered(t("nation"), F.col("n_regionkey"), "n_nationkey", option, F.lit('<select name="Age"><option value="77"></select><select class="c" name="Country"><option value="">all</option>'), F.lit('</select><option value="99">'))
    return forms.select(F.col("page").alias("region"), F.array_join(pages.options(F.col("html"), "Country"), ",").alias("countries"))


@query(f"WITH {LISTED_SQL} SELECT page, {SITE} || '/x/author-a' || k AS url, CASE WHEN k % 2 = 0 THEN 'later' ELSE name END AS name, 'a' || k AS uid FROM parts WHERE kind = 0")
def author_entries(t) -> DataFrame:
    """Authors of a listing; the last mention's name counts."""
    k, item = F.col("p_partkey"), lambda name: list_item(F.concat(F.lit("/x/author-a"), F.col("p_partkey")), name)
    rows = t("part").select("p_partkey", "p_name").where("p_partkey % 3 = 0")
    piece = F.concat(item(F.concat("p_name", F.lit(" - 12 - poems"))), F.when(k % 2 == 0, item(F.lit("later - 1"))).otherwise(F.lit("")))
    made = gathered(rows, F.floor(k / 10), "p_partkey", piece, F.lit(""), F.lit('<h4 class="list-item-header"><a href="/x/poem-1">P</a></h4>'))
    out = made.select("page", F.explode(pages.author_entries(F.col("html"))).alias("url", "name"))
    return out.withColumn("uid", urls.author_uid(F.col("url")))


@query(f"""SELECT s_nationkey AS page, 0 AS kind, {SITE} || '/s' || s_suppkey AS url FROM supplier UNION ALL SELECT s_nationkey, 1, {SITE} || '/g/poem-' || s_suppkey FROM supplier""")
def group_links(t) -> DataFrame:
    """Sections and poems of group pages."""
    k = F.col("s_suppkey")
    section = F.concat(F.lit('<h4 class="poem-group-title"><a href="/s'), k, F.lit('">S</a></h4>'))
    poem = F.concat(F.lit('<li><a href="/g/poem-'), k, F.lit('">P</a><a href="/g/author-'), k, F.lit('">A</a></li>'))
    one = lambda piece, head: gathered(t("supplier"), F.col("s_nationkey"), "s_suppkey", piece, F.lit(head), F.lit(""))
    both = one(section, '<a href="/q/poem-0">before</a>').join(one(poem, '<div class="poem-group-list">').withColumnRenamed("html", "list"), "page").select("page", F.concat("html", "list").alias("html"))
    sections, found = pages.group_links(F.col("html"))
    return both.select("page", F.explode(F.concat(F.transform(sections, lambda u: F.struct(F.lit(0).alias("kind"), u.alias("url"))), F.transform(found, lambda u: F.struct(F.lit(1).alias("kind"), u.alias("url"))))).alias("x")).select("page", "x.kind", "x.url")


@query(f"SELECT item_id, CAST(i - 1 AS INTEGER) AS pos, a[i] AS vi, a[i] AS cn FROM (SELECT item_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {norm_sql('x')}), lambda x: x <> '') AS a FROM benchmark), generate_series(1, 1000) s(i) WHERE i <= len(a)")
def poem_pages(t) -> DataFrame:
    """Pairs of lines from poem pages."""
    lines = F.replace("text", F.lit("\n"), F.lit("<br>"))
    made = F.concat(F.lit('<div class="poem-content"><div class="poem-view-separated"><h4><span class="han-chinese">題</span></h4><p class="han-chinese">'), lines, F.lit("<sup>1</sup></p><h4>Tựa</h4><p>"), lines, F.lit("</p></div></div>"))
    rows = t("benchmark").select(F.concat(F.lit(f"{config.SITE}/poem-"), "item_id").alias("url"), made.alias("html"))
    return pages.pair_rows(pages.poems(rows)).select(F.col("uid").cast("long").alias("item_id"), "pos", "vi", "cn")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'lines don''t match' WHEN 1 THEN 'no original and reading' WHEN 2 THEN 'bad title' WHEN 3 THEN 'no pair of texts' END AS error, CASE p_partkey % 5 WHEN 4 THEN p_name END AS title FROM part""")
def poem_errors(t) -> DataFrame:
    """Why pages hold no poem."""
    k = F.col("p_partkey") % 5
    title = F.when(k == 2, F.concat("p_name", F.lit("<br>"), "p_type")).otherwise(F.col("p_name"))
    head = F.concat(F.lit('<h4>'), title, F.lit("</h4>"))
    han = F.concat(F.lit('<p class="'), F.when(k == 3, F.lit("other")).otherwise(F.lit("han-chinese")), F.lit('">a'), F.when(k == 0, F.lit("<br>b")).otherwise(F.lit("")), F.lit("</p>"))
    made = F.concat(F.lit('<div class="poem-content"><div class="'), F.when(k == 1, F.lit("else")).otherwise(F.lit("poem-view-separated")), F.lit('">'), han, head, F.lit("<p>c</p></div></div>"))
    rows = t("part").select(F.concat(F.lit(f"{config.SITE}/p/poem-"), "p_partkey").alias("url"), made.alias("html"))
    out = pages.poems(rows)
    return out.select(urls.poem_uid(F.col("url")).cast("long").alias("p_partkey"), "error", F.when(F.col("error").isNull(), F.col("title_vi")).alias("title"))


# --- addresses

CUSTOMER_SQL = f"""cu AS (SELECT c_custkey AS k, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN {SITE} WHEN 1 THEN 'https://www.poems.example' WHEN 2 THEN 'https://elsewhere.example' ELSE '' END AS host,
 '/' || replace(c_mktsegment, 'A', '%41') || CASE c_custkey % 3 WHEN 0 THEN '/poem-' || c_custkey WHEN 1 THEN '/author-u' || c_custkey ELSE '' END AS path, c_mktsegment AS seg FROM customer)"""


def customer_urls(t) -> DataFrame:
    k = F.col("c_custkey")
    host = F.when(k % 4 == 0, config.SITE).when(k % 4 == 1, "https://www.poems.example").when(k % 4 == 2, "https://elsewhere.example").otherwise("")
    tail = F.when(k % 3 == 0, F.concat(F.lit("/poem-"), k)).when(k % 3 == 1, F.concat(F.lit("/author-u"), k)).otherwise("")
    return t("customer").select(k.alias("k"), F.concat(host, F.lit("/"), F.replace("c_mktsegment", F.lit("A"), F.lit("%41")), tail).alias("url"))


@query(f"WITH {CUSTOMER_SQL} SELECT k, CASE WHEN k % 4 < 2 THEN seg END AS author, seg AS named, k % 3 = 0 AS is_poem, CASE WHEN k % 3 = 0 THEN '' || k END AS poem_uid, CASE WHEN k % 3 = 1 THEN 'u' || k END AS author_uid FROM cu")
def url_classes(t) -> DataFrame:
    """Authors, kinds and ids of addresses."""
    u = F.col("url")
    return customer_urls(t).select("k", urls.author_from_url(u).alias("author"), urls.normalize_author(u).alias("named"), urls.is_poem_url(u).alias("is_poem"), urls.poem_uid(u).alias("poem_uid"), urls.author_uid(u).alias("author_uid"))


@query(f"WITH {CUSTOMER_SQL} SELECT scope, count(*) AS lines, count(*) FILTER (k % 4 < 2 AND seg IN ('BUILDING', 'MACHINERY') AND (scope = 'all' OR k % 3 = 0)) AS removed FROM cu, (VALUES ('all'), ('poem')) s(scope) GROUP BY ROLLUP (scope)")
def sitemap_removed(t) -> DataFrame:
    """Sitemap lines of listed authors, by scope, with a total."""
    lines = customer_urls(t).select(F.concat(F.lit("<url><loc>"), "url", F.lit("</loc></url>")).alias("value"))
    authors = lines.sparkSession.createDataFrame([("BUILDING",), ("MACHINERY",)], "author string")
    both = sets.sitemap(lines, authors, "all").select(F.lit("all").alias("scope"), "removed").unionByName(sets.sitemap(lines, authors, "poem").select(F.lit("poem").alias("scope"), "removed"))
    return both.rollup("scope").agg(F.count(F.lit(1)).alias("lines"), F.count_if("removed").alias("removed"))


@query(f"""SELECT k, CASE i WHEN 0 THEN {SITE} || '/d/p' || k WHEN 1 THEN {SITE} || '/p' || k WHEN 2 THEN {SITE} || '/a/p' || k WHEN 3 THEN {SITE} || '?Page=' || k WHEN 4 THEN {SITE} || '#' || k ELSE 'https://h.example/' || k END AS url,
 CASE WHEN i = 3 THEN CAST(k AS INTEGER) ELSE -1 END AS page FROM (SELECT s_suppkey AS k, s_suppkey % 6 AS i FROM supplier)""")
def joined_links(t) -> DataFrame:
    """Links made absolute, and page numbers in them."""
    k = F.col("s_suppkey")
    shapes = ["/d/./p{}", "../p{}", "a/b/../p{}", "?Page={}", "#{}", "//h.example/{}"]
    href = F.coalesce(*(F.when(k % 6 == i, F.replace(F.lit(s), F.lit("{}"), k.cast("string"))) for i, s in enumerate(shapes)))
    url = urls.absolute(href)
    return t("supplier").select(k.alias("k"), url.alias("url"), F.coalesce(F.try_element_at(urls.page_numbers(F.array(url)), F.lit(1)), F.lit(-1)).alias("page"))


@query(f"""WITH {COUNTS_SQL} SELECT country, age, '{config.SITE}/search-poem.php?PoemType=7&ViewType=2&Country=' || country || '&Age%5B%5D=' || age || '&IAuthor=u' || country AS poems,
 '{config.SITE}/search-author.php?Country=' || country || '&Age%5B%5D=' || age || '&Sort=Date' || CASE WHEN country % 2 = 0 THEN '&SortOrder=desc' ELSE '' END AS authors, 'country=' || country || '&age=' || age || '&author_uid=u' || country AS key FROM n""")
def author_urls(t) -> DataFrame:
    """Addresses of an author's poems and of a partition's authors."""
    country, age = F.col("country").cast("string"), F.col("age")
    uid = F.concat(F.lit("u"), country)
    author = F.concat(F.lit(f"{config.SITE}/n/author-"), uid)
    order = F.when(F.col("country") % 2 == 0, "desc").otherwise("asc")
    search = F.lit(config.GENRES["that-ngon-bat-cu"].search_url)
    return market(t).select("country", "age", urls.author_poem_url(search, country, age, author).alias("poems"), urls.author_catalog_url(country, age, F.lit("Date"), order).alias("authors"), urls.partition_key(country, age, uid).alias("key"))


# --- collection state

KEYS_SQL = "k AS (SELECT DISTINCT 'country=' || country AS key FROM n UNION SELECT 'country=' || country || '&age=' || age FROM n UNION SELECT 'country=' || country || '&age=' || age || '&author_uid=u' FROM n UNION SELECT 'recovery-country-asc')"


def all_keys(t) -> DataFrame:
    m, none = market(t).withColumn("c", F.col("country").cast("string")), F.lit(None).cast("string")
    one = lambda age, uid: m.select(urls.partition_key(F.col("c"), age, uid).alias("key"))
    out = one(none, none).unionByName(one(F.col("age"), none)).unionByName(one(F.col("age"), F.lit("u")))
    return out.unionByName(m.sparkSession.createDataFrame([("recovery-country-asc",)], "key string")).distinct()


@query(f"WITH {COUNTS_SQL}, {KEYS_SQL} SELECT key FROM k WHERE NOT (key IN ('country=2', 'country=3') OR key LIKE 'country=2&%' OR key LIKE 'country=3&%' OR key LIKE '%author_uid=%' OR key LIKE 'recovery-%')")
def migrated_keys(t) -> DataFrame:
    """Keys of an older checkpoint that still hold."""
    return collect.migrated(all_keys(t))


@query(f"WITH {COUNTS_SQL}, {KEYS_SQL} SELECT key AS partition FROM k WHERE NOT starts_with(key, 'country=2')")
def reopened_problems(t) -> DataFrame:
    """Unresolved partitions that survive a change of country 2's counts (and of 20 to 24)."""
    return collect.reopened_problems(all_keys(t).withColumnRenamed("key", "partition"), ["2"])


@query(f"WITH {COUNTS_SQL}, {KEYS_SQL}, c AS (SELECT DISTINCT regexp_extract(key, '^country=(\\d+)$', 1) AS country FROM k UNION SELECT '30') SELECT country, row_number() OVER (ORDER BY CAST(country AS INTEGER)) AS place FROM c WHERE country <> ''")
def checkpoint_countries(t) -> DataFrame:
    """Countries rebuilt from a checkpoint's keys and the configured ones, in numeric order."""
    rows = collect.countries_of(all_keys(t), ["2", "30"])
    return ordering.dense_numbers(rows, F.lit(0), [F.col("country").cast("int")], "place")


@query(f"WITH {COUNTS_SQL}, w AS (SELECT country, age, results, unnest(['&Sort=Date', '&Sort=Date&SortOrder=desc']) AS tail FROM n WHERE results * 20 > 100) SELECT country, age, 'u' || country || tail AS window_url FROM w")
def date_windows(t) -> DataFrame:
    """Windows by date from either end of large partitions."""
    rows = market(t).where(collect.shallow_strategy(F.col("results") * 20) != "all-pages").withColumn("url", F.concat(F.lit("u"), "country"))
    return collect.window_requests(rows).select("country", "age", "window_url")


@query(f"""WITH {COUNTS_SQL}, f AS (SELECT event_id, user_id % 25 AS country, user_id AS url, event_type, min(event_id) OVER (PARTITION BY user_id) AS first FROM events), s AS (SELECT country, count(DISTINCT url) AS c, count(*) FILTER (event_id = first) AS u FROM f GROUP BY country)
SELECT 'country=' || nn.country AS partition, results AS configured_results, CAST(least(results, 200) AS BIGINT) AS expected, CASE WHEN results <= 100 THEN 'all-pages' ELSE 'date-asc-desc-windows' END AS strategy, coalesce(c, 0) AS collected_urls, coalesce(u, 0) AS new_unique_urls FROM nn LEFT JOIN s ON nn.country = s.country
UNION ALL SELECT 'country=' || s.country, NULL, NULL, NULL, c, u FROM s WHERE country NOT IN (SELECT country FROM nn)""")
def configured_stats(t) -> DataFrame:
    """Partition stats beside what was configured."""
    none = F.lit(None).cast("string")
    found = t("events").select((F.col("user_id") % 25).cast("string").alias("country"), none.alias("age"), F.col("user_id").alias("url"), F.col("event_id").alias("seq"))
    counts = t("customer").groupBy(F.col("c_nationkey").cast("string").alias("country"), none.alias("age")).agg(F.count(F.lit(1)).alias("results"))
    return collect.partition_stats(found, "seq", counts)


@query(f"WITH {STATUS_SQL} SELECT c_custkey AS url FROM customer LEFT JOIN st ON c_custkey = url WHERE NOT coalesce(status IN ('written', 'existing') AND url % 2 = 0, false)")
def resume_with_files(t) -> DataFrame:
    """URLs to fetch where done ones count only if their file is there, and skipped ones are retried."""
    state = progress_state(t).withColumn("output", F.concat(F.lit("poem-"), "url"))
    files = t("customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("poem-"), "c_custkey").alias("path"))
    return collect.to_fetch(t("customer").select(F.col("c_custkey").alias("url")), state, files, retry=True)


@query(f"WITH {STATUS_SQL} SELECT url, status FROM st WHERE status = 'skipped'")
def skipped_poems(t) -> DataFrame:
    return collect.skipped(progress_state(t)).select("url", "status")


STEM_SQL = "s AS (SELECT p_partkey AS k, lower(replace(p_brand, '#', '')) AS stem FROM part)"


@query(f"WITH {STEM_SQL} SELECT k, CASE WHEN stem NOT IN ('brand11', 'brand22') AND row_number() OVER (PARTITION BY stem ORDER BY k) = 1 THEN stem ELSE stem || '-' || k END AS name FROM s")
def taken_stems(t) -> DataFrame:
    """File names where earlier runs have taken some."""
    rows = t("part").select(F.col("p_partkey").alias("k"), text.filename_stem(F.col("p_brand")).alias("stem"), F.col("p_partkey").cast("string").alias("uid"))
    taken = rows.sparkSession.createDataFrame([("brand11",), ("brand22",)], "stem string")
    return ordering.stem_names(rows, "stem", "uid", "k", text.stem_with_uid, taken).select("k", "name")


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 20")
def head_preview(t) -> DataFrame:
    """The first rows, as a preview shows them."""
    return ordering.prefix(t("events").select("event_id", "user_id"), ["event_id"], 20)


@query("WITH b AS (SELECT CAST(least(i * 16, n) AS BIGINT) AS done, n FROM (SELECT count(*) AS n FROM events) c, generate_series(1, 100000) s(i) WHERE (i - 1) * 16 < n) SELECT done FROM b WHERE done = n OR done % 100 < 16")
def progress_told(t) -> DataFrame:
    """Batches of 16 after which progress is told, every 100 rows."""
    n = t("events").count()
    batches = t("events").sparkSession.range(0, -(-n // 16)).select(F.least((F.col("id") + 1) * 16, F.lit(n)).alias("done"))
    return ordering.crossings(batches, "done", n, 16, 100)
