"""URL functions on Columns: parts, classes, authors, and the site's search addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from versefold.config import HOSTS, SITE


def unescape_html(text: Column) -> Column:
    """The references that URLs in XML have: amp, lt, gt, quot, apos and #39."""
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return text


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def decoded(text: Column) -> Column:
    """Percent-decoded; a plus sign stays one; what can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def author_from_url(url: Column, hosts: tuple[str, ...] = HOSTS) -> Column:
    """First path segment of the site's URLs, decoded; null for others."""
    plain = unescape_html(url)
    return F.when(host(plain).isin(*hosts), decoded(F.try_element_at(segments(plain), F.lit(1))))


def normalize_author(value: Column) -> Column:
    """An author's name from a URL or a path; null if there is none."""
    value = F.trim(value)
    first = F.when(F.contains(value, F.lit("://")), F.try_element_at(segments(value), F.lit(1))).otherwise(F.split_part(F.regexp_replace(value, "^/+|/+$", ""), F.lit("/"), F.lit(1)))
    return decoded(F.nullif(first, F.lit("")))


def is_poem_url(url: Column) -> Column:
    """Whether any path segment is a poem's."""
    return F.exists(segments(unescape_html(url)), lambda s: s.rlike(r"^poem-[A-Za-z0-9_-]+$"))


def poem_uid(url: Column) -> Column:
    return F.nullif(F.regexp_extract(path(url), r"/poem-([A-Za-z0-9_-]+)$", 1), F.lit(""))


def author_uid(url: Column) -> Column:
    return F.nullif(F.regexp_extract(path(url), r"/author-([A-Za-z0-9_-]+)$", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path from the root without "." and ".." segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    step = lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), step)
    tail = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), tail)).otherwise(path)


def absolute(href: Column, base: str = SITE) -> Column:
    """A link on the site made absolute, as seen from its root: with a scheme it stays, `//host` gets
    one, paths lose their dots; `?query` and `#part` follow the root, and an empty link is the root."""
    link = F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    ending = F.regexp_extract(link, r"^[^?#]*([?#].*)?$", 1)
    own = F.regexp_extract(link, r"^([^?#]*)", 1)
    rooted = F.when(own == "", own).when(own.startswith("/"), without_dots(own)).otherwise(without_dots(F.concat(F.lit("/"), own)))
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.lit("https:"), link)).otherwise(F.concat(F.lit(base), rooted, ending))


def page_numbers(urls: Column) -> Column:
    """Numbers in the Page parameter of an array of URLs."""
    found = F.transform(urls, lambda u: F.regexp_extract(u, r"[?&]Page=(\d+)(?:[&#]|$)", 1))
    return F.transform(F.filter(found, lambda x: x != ""), lambda x: x.cast("int"))


def partition_url(search: Column, country: Column, age: Column, page: Column | None = None) -> Column:
    """A search limited to a country and, if not null, a period and page."""
    url = F.concat(search, F.lit("&Country="), country, F.coalesce(F.concat(F.lit("&Age%5B%5D="), age), F.lit("")))
    return url if page is None else F.concat(url, F.coalesce(F.concat(F.lit("&Page="), page.cast("string")), F.lit("")))


def author_poem_url(search: Column, country: Column, age: Column, author: Column) -> Column:
    return F.concat(partition_url(search, country, age), F.lit("&IAuthor="), F.url_encode(author_uid(author)))


def author_catalog_url(country: Column, age: Column, sort: Column, order: Column, base: str = SITE) -> Column:
    """The authors of a partition; ascending order is the absence of SortOrder."""
    tail = F.when(order == "desc", "&SortOrder=desc").otherwise("")
    return F.concat(F.lit(f"{base}/search-author.php?Country="), country, F.lit("&Age%5B%5D="), age, F.lit("&Sort="), sort, tail)


def partition_key(country: Column, age: Column, author: Column) -> Column:
    """country=X&age=Y&author_uid=Z, null parts left out."""
    return F.concat_ws("&", F.concat(F.lit("country="), country), F.concat(F.lit("age="), age), F.concat(F.lit("author_uid="), author))
